"""A small random market with every irregularity, and the reports on it in plain Python."""

from __future__ import annotations

import datetime
import random
from collections import defaultdict

from ledgerlens.plans.snapshot import Snapshot
from ledgerlens.schemas import CONTRACTS, CURRENCIES, TRADES, TRANSFERS

START = datetime.date(2022, 12, 26)
WEEK = [START + datetime.timedelta(d) for d in range(7)]
FIRST = START - datetime.timedelta(20)


class Market:
    """Rows of the five tables. Some trades lack a block, a rate, a collection or a price."""

    def __init__(self, seed: int, trades: int = 400) -> None:
        rng = random.Random(seed)
        self.contracts = [
            (f"0xc{i}", "ERC721", None if i == 3 else f"name{i % 5}", f"S{i}", 100 + 4 * i)
            for i in range(12)
        ]
        days = [FIRST + datetime.timedelta(d) for d in range(40)]
        # Two blocks a day; the numbers rise with the date, with gaps.
        self.blocks = []
        for i, day in enumerate(days):
            for part in range(2):
                self.blocks.append((100 + 3 * i + part, 1_600_000_000 + i * 86400 + part, day))
        self.rates = [(day, 1000.0 + 10.25 * i) for i, day in enumerate(days) if i % 9 != 4]
        numbers = [b[0] for b in self.blocks] + [9999, None]
        people = [f"0xp{i}" for i in range(9)] + [None]
        self.trades, self.transfers = [], []
        for i in range(trades):
            contract = "0xc0" if rng.random() < 0.33 else f"0xc{rng.randrange(14)}"
            token = str(rng.randrange(4))
            block = rng.choice(numbers)
            price = rng.choice([None, 0.0, 1e-15, 0.5, 2.25, 3.1, 139000.0, rng.random() * 50])
            currency = rng.choice([*CURRENCIES, "0xother", None])
            seller, buyer = rng.choice(people), rng.choice(people)
            market = rng.choice(["opensea", "looksrare", None])
            self.trades.append(
                (f"0xt{i}", block, contract, token, seller, buyer, currency, price, market)
            )
            self.transfers.append((f"0xt{i}", contract, seller, buyer, token, block, None))
        for rows in (self.contracts, self.blocks, self.rates, self.trades, self.transfers):
            rng.shuffle(rows)

    def snapshot(self, spark, partitions: int | None = None, **options) -> Snapshot:
        def frame(rows, schema):
            df = spark.createDataFrame(rows, schema)
            return df.repartition(partitions) if partitions else df

        return Snapshot(
            contracts=frame(self.contracts, CONTRACTS),
            blocks=frame(self.blocks, "block_number BIGINT, timestamp_of_block BIGINT, date DATE"),
            rates=frame(self.rates, "date DATE, eth_usd_rate DOUBLE"),
            trades=frame(self.trades, TRADES),
            transfers=frame(self.transfers, TRANSFERS),
            **options,
        )

    # -- brute force -------------------------------------------------------------------

    def window(self) -> tuple[int, int]:
        numbers = [b[0] for b in self.blocks if b[2] in WEEK]
        return min(numbers), max(numbers)

    def enriched(self, scope: str = "all") -> list[dict]:
        date_of = {b[0]: b[2] for b in self.blocks}
        rate_of = dict(self.rates)
        name_of = {c[0]: c[2] for c in self.contracts}
        lo, hi = self.window()
        found = []
        for _, block, contract, token, seller, buyer, currency, price, market in self.trades:
            rate = rate_of.get(date_of.get(block))
            if currency not in CURRENCIES or rate is None or contract not in name_of:
                continue
            if scope == "week" and not lo <= block <= hi:
                continue
            found.append({
                "block": block, "contract": contract, "token": token, "seller": seller,
                "buyer": buyer, "market": market, "name": name_of[contract], "price": price,
                "usd": None if price is None else price * rate,
            })
        return found

    def grouped(self, scope: str, *keys: str) -> dict[tuple, list[dict]]:
        groups = defaultdict(list)
        for trade in self.enriched(scope):
            groups[tuple(trade[k] for k in keys)].append(trade)
        return groups

    def holders(self) -> dict[tuple, tuple]:
        last = {}
        for _, contract, sender, receiver, token, block, _ in self.transfers:
            def none_first(v):
                return (v is not None, v if v is not None else "")
            place = ((block is not None, block or 0), none_first(receiver), none_first(sender))
            if (contract, token) not in last or place > last[contract, token][0]:
                last[contract, token] = (place, receiver, sender)
        return {key: value[1:] for key, value in last.items()}

    def active_traders(self, cutoff: datetime.date) -> set:
        block = max(b[0] for b in self.blocks if b[2] <= cutoff)
        last = {}
        for trade in self.enriched():
            def none_first(v):
                return (v is not None, v if v is not None else "")
            place = (trade["block"], none_first(trade["seller"]), none_first(trade["buyer"]))
            key = trade["contract"], trade["token"]
            if key not in last or place > last[key][0]:
                last[key] = (place, trade)
        recent = [trade for _, trade in last.values() if trade["block"] > block]
        return {t["seller"] for t in recent} | {t["buyer"] for t in recent}


def total(values) -> float | None:
    known = [v for v in values if v is not None]
    return sum(known) if known else None


def average(values) -> float | None:
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else None
