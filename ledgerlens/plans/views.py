"""What every report asks for: trade measures and token transfers, by scope."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numeric import exact_sum, mean
from ledgerlens.operators.aggregates import latest_per_key, merge_rollup, trade_rollup
from ledgerlens.operators.windows import BlockWindow, block_at
from ledgerlens.plans.enrich import eth_trades, price_calendar, with_usd_price
from ledgerlens.plans.snapshot import Snapshot
from ledgerlens.session import remove_path, scratch_path

WEEK = "week"
ALL = "all"
SCOPES = (WEEK, ALL)
TOKEN = ["contract_address", "token_id"]


def named(keys: Sequence[str]) -> list[str]:
    """``keys``, with the collection's name where they include the collection."""
    return [*keys, "contract_name"] if "contract_address" in keys else list(keys)


def by_scope(flagged: DataFrame) -> DataFrame:
    """Rows of all time, and those with ``in_week`` once more for the week."""
    both = F.array(*[F.lit(s) for s in SCOPES])
    return flagged.withColumn(
        "scope", F.explode(F.when(F.col("in_week"), both).otherwise(F.array(F.lit(ALL))))
    )


class MarketView:
    """Measures computed straight from the tables, one scan per question.

    Trades are aggregated by collection (and finer) before they meet the
    collection table, so the join never moves single trades and a hot
    collection is one row by then.
    """

    def __init__(
        self,
        snapshot: Snapshot,
        start: str | datetime.date | None = None,
        days: int = 7,
        cutoff: str | datetime.date | None = None,
        resolve: bool = False,
    ) -> None:
        """``resolve`` looks the block bounds up at once, for JDBC sources."""
        self.snapshot = snapshot
        self.scale = snapshot.scale
        self.resolve = resolve
        window = BlockWindow(snapshot.blocks, start, days)
        self.window = window.resolved() if resolve else window
        self.cutoff = self.window.first_day if cutoff is None else cutoff
        self.labels = snapshot.contracts.select("contract_address", "contract_name")

    # -- row-level frames ------------------------------------------------------

    def trades(self, scope: str = ALL) -> DataFrame:
        """Priced trades of a scope, collections not checked yet."""
        rows = self._rows("trades", scope)
        return with_usd_price(eth_trades(self.snapshot, rows), price_calendar(self.snapshot))

    def _rows(self, name: str, scope: str) -> DataFrame:
        if scope == WEEK:
            return self.snapshot.within(name, self.window.low, self.window.high)
        return getattr(self.snapshot, name)

    def enriched(self, scope: str = ALL) -> DataFrame:
        return self.trades(scope).join(self.snapshot.contracts, "contract_address")

    def transfers(self, scope: str = ALL) -> DataFrame:
        return self._rows("transfers", scope)

    # -- measures ----------------------------------------------------------------

    def measures(self, keys: Sequence[str], scope: str = ALL) -> DataFrame:
        """Trade measures by ``keys`` over known collections, labelled where keyed by one."""
        fine = list(dict.fromkeys([*keys, "contract_address"]))
        labelled = trade_rollup(self.trades(scope), fine, self.scale).join(
            self.labels, "contract_address"
        )
        return labelled if set(fine) == set(keys) else merge_rollup(labelled, keys)

    def in_week(self) -> Column:
        return F.coalesce(self.window.holds(), F.lit(False))

    def scoped(self, keys: Sequence[str]) -> DataFrame:
        """Measures of both scopes (column ``scope``) from one pass over all trades."""
        fine = list(dict.fromkeys([*keys, "contract_address"]))
        return merge_rollup(by_scope(self.finest(fine)), ["scope", *named(keys)])

    def token_extents(self) -> DataFrame:
        """Trades, highest and mean price of every token of a known collection, for both scopes.

        Columns: the token, contract_name, and for each scope ``<scope>_trades``, ``_top`` and
        ``_mean``. A token is one group, so it is shuffled once.
        """
        trades = self.trades().withColumn("in_week", self.in_week())
        priced = trades.select(
            *TOKEN, "in_week", F.col("price_value").alias(ALL),
            F.when(F.col("in_week"), F.col("price_value")).alias(WEEK))
        tokens = priced.groupBy(*TOKEN).agg(
            F.count(F.lit(1)).alias(f"{ALL}_trades"), F.count_if("in_week").alias(f"{WEEK}_trades"),
            *[f for s in SCOPES for f in (
                exact_sum(s, self.scale).alias(f"{s}_sum"), F.count(s).alias(f"{s}_prices"), F.max(s).alias(f"{s}_top"))])
        return tokens.join(self.labels, "contract_address").withColumns({
            f"{s}_mean": mean(F.col(f"{s}_sum"), F.col(f"{s}_prices")) for s in SCOPES})

    def scoped_tokens(self) -> DataFrame:
        """Number of traded tokens by scope and known collection, from one pass."""
        tokens = self.trades().groupBy(*TOKEN).agg(F.max(self.in_week()).alias("in_week"))
        counted = by_scope(tokens).groupBy("scope", "contract_address").agg(
            F.count(F.lit(1)).alias("tokens"))
        return counted.join(self.labels, "contract_address")

    def scoped_transfers(self) -> DataFrame:
        """Number of transfers of both scopes, from one pass."""
        counts = self.transfers().agg(
            F.count_if(self.in_week()).alias(WEEK), F.count(F.lit(1)).alias(ALL))
        return counts.unpivot([], list(SCOPES), "scope", "transfers")

    def first_trades(self) -> DataFrame:
        """Block of the first trade of every collection traded up to the window's end."""
        trades = eth_trades(self.snapshot).where(F.col("block_number") <= self.window.hi)
        priced = with_usd_price(trades, price_calendar(self.snapshot))
        first = priced.groupBy("contract_address").agg(F.min("block_number").alias("first_block"))
        return first.join(self.labels, "contract_address")

    def transfers_by(self, keys: Sequence[str], scope: str = ALL) -> DataFrame:
        """Transfer counts by ``keys``."""
        return self.transfers(scope).groupBy(*keys).agg(F.count(F.lit(1)).alias("transfers"))

    def tokens_by_contract(self) -> DataFrame:
        """Distinct transferred tokens by collection."""
        tokens = self.transfers().groupBy(*TOKEN).agg(F.count(F.lit(1)).alias("transfers"))
        return tokens.groupBy("contract_address").agg(F.count(F.lit(1)).alias("tokens"))

    def finest(self, keys: Sequence[str]) -> DataFrame:
        """Measures by ``keys`` (the collection among them) and ``in_week``, labelled; from one pass."""
        flagged = self.trades().withColumn("in_week", self.in_week())
        return trade_rollup(flagged, [*keys, "in_week"], self.scale).join(self.labels, "contract_address")

    def rollups(self, stored: Callable[[str, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """Measures of both scopes by token and by market, from one pass over all trades that ``stored`` keeps."""
        finest = stored("trades", self.finest([*TOKEN, "market"]))
        return (merge_rollup(by_scope(finest), ["scope", *TOKEN, "contract_name"]),
                merge_rollup(by_scope(finest), ["scope", "market"]))

    def held(self) -> DataFrame:
        """Last receiver and last sender of every token, and the number of its transfers."""
        return latest_per_key(
            self.transfers(), TOKEN, order=["block_number"],
            values=["to_address", "from_address"], transfers=F.count(F.lit(1)),
        )

    def holders(self) -> DataFrame:
        """Last sender and last receiver of every token."""
        return latest_per_key(
            self.transfers(), TOKEN,
            order=["block_number"],
            values=["to_address", "from_address"],
        )

    def active_tokens(self) -> DataFrame:
        """Seller, buyer and block of the last sale of tokens last sold after the cutoff.

        A token is last sold after the cutoff exactly when it has a sale after it,
        so the older sales need not be read.
        """
        cutoff = block_at(self.snapshot.blocks, self.cutoff, self.resolve)
        recent = eth_trades(self.snapshot).where(F.col("block_number") > cutoff)
        last = latest_per_key(
            with_usd_price(recent, price_calendar(self.snapshot)), TOKEN,
            order=["block_number"],
            values=["seller", "buyer", "block_number"],
        )
        return last.join(self.labels.select("contract_address"), "contract_address")


class StoredView(MarketView):
    """The same answers from stored rollups, for reports that ask many questions.

    ``store`` reads all trades once and rolls them up by token and market, and transfers
    by token; tokens, collections and markets of both scopes are rolled up from there.
    All are written under the shared scratch folder: lineage ends there, and a lost
    executor costs no second scan. As a context manager it removes them at the end.
    """

    def __init__(
        self, view: MarketView, measured: dict[str, DataFrame], tokens: DataFrame, paths: list[str]
    ) -> None:
        self.__dict__.update(view.__dict__)
        # Those of the week come from wherever the view has them.
        self._week_transfers = view.transfers_by
        self._measured = measured
        self._tokens = tokens
        self._paths = paths

    @classmethod
    def store(cls, view: MarketView) -> "StoredView":
        spark = view.snapshot.trades.sparkSession
        paths: list[str] = []

        def stored(name: str, df: DataFrame) -> DataFrame:
            path = scratch_path(spark, name)
            paths.append(path)
            df.write.option("compression", "zstd").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        def trades() -> dict[str, DataFrame]:
            by_token, by_market = view.rollups(stored)
            tokens = stored("tokens", by_token)
            return {
                "token_id": tokens,
                "contract_address": stored("collections", merge_rollup(
                    tokens, ["scope", "contract_address", "contract_name"], tokens=F.count(F.lit(1)))),
                "market": stored("markets", by_market),
            }

        def holdings() -> DataFrame:
            return stored("holdings", view.held())

        try:
            # The two do not depend on each other; run together they share the executors.
            with ThreadPoolExecutor(max_workers=2) as pool:
                held = pool.submit(inheritable_thread_target(spark)(holdings))
                measured = pool.submit(inheritable_thread_target(spark)(trades))
                return cls(view, measured.result(), held.result(), paths)
        except BaseException:
            for path in paths:
                remove_path(spark, path)
            raise

    def drop(self) -> None:
        """Remove the stored rollups; frames computed from them cannot be read any more."""
        spark = self._tokens.sparkSession
        while self._paths:
            remove_path(spark, self._paths.pop())

    def __enter__(self) -> "StoredView":
        return self

    def __exit__(self, *failure) -> None:
        self.drop()

    def scoped(self, keys: Sequence[str]) -> DataFrame:
        if not keys:
            return merge_rollup(self._measured["market"], ["scope"])
        return self._measured[keys[-1]]

    def measures(self, keys: Sequence[str], scope: str = ALL) -> DataFrame:
        rows = self._measured[keys[-1] if keys else "market"].where(F.col("scope") == scope).drop("scope")
        return rows if keys else merge_rollup(rows, [])

    def token_extents(self) -> DataFrame:
        of_scope = {
            s: {"trades": F.col("trades"), "top": F.col("price_max"),
                "mean": mean(F.col("eth"), F.col("eth_prices"))} for s in SCOPES}
        return self.scoped(TOKEN).select(*TOKEN, "contract_name", *[
            F.when(F.col("scope") == s, value).alias(f"{s}_{name}")
            for s, values in of_scope.items() for name, value in values.items()])

    def scoped_tokens(self) -> DataFrame:
        return self.scoped(["contract_address"]).select("scope", "contract_address", "tokens")

    def first_trades(self) -> DataFrame:
        return self.measures(["contract_address"])

    def held(self) -> DataFrame:
        return self._tokens

    def transfers_by(self, keys: Sequence[str], scope: str = ALL) -> DataFrame:
        if scope == WEEK:
            return self._week_transfers(keys, scope)
        return self._tokens.groupBy(*keys).agg(
            F.coalesce(F.sum("transfers"), F.lit(0)).alias("transfers")
        )

    def tokens_by_contract(self) -> DataFrame:
        return self._tokens.groupBy("contract_address").agg(F.count(F.lit(1)).alias("tokens"))

    def holders(self) -> DataFrame:
        return self._tokens.select(*TOKEN, "to_address", "from_address")
