from __future__ import annotations

import pytest
from market import Market

from ledgerlens.plans import enrich
from ledgerlens.schemas import TRADES
from ledgerlens.streaming import ingest
from ledgerlens.streaming.priced import PricedStore


def bag(df, columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=repr)


@pytest.fixture(scope="module")
def snapshot(spark):
    return Market(7).snapshot(spark)


@pytest.fixture(scope="module")
def calendar(snapshot):
    return enrich.price_calendar(snapshot)


@pytest.fixture(scope="module")
def expected(snapshot, calendar):
    return enrich.with_usd_price(snapshot.trades, calendar)


@pytest.fixture
def store(tmp_path, snapshot, calendar):
    return PricedStore(str(tmp_path / "store"), snapshot.trades, calendar)


def test_waiting_trades_move_over(store, snapshot, calendar, expected):
    early = calendar.where("block_number < 150")
    first, second = snapshot.trades.where("token_id < 2"), snapshot.trades.where("token_id >= 2")
    assert store.absorb(first, early, "a", 0) and store.absorb(second, early, "a", 1)
    known = enrich.with_usd_price(snapshot.trades, early)
    assert bag(store.priced(), expected.columns) == bag(known, expected.columns)
    assert store.waiting().count() == snapshot.trades.count() - known.count()
    # Read with more blocks, before anything is moved.
    assert bag(store.priced(calendar), expected.columns) == bag(expected, expected.columns)

    before = sum(p.rows for p in store.parts(False))
    assert store.reprice(calendar)
    assert bag(store.priced(), expected.columns) == bag(expected, expected.columns)
    waiting = bag(store.waiting(), TRADES.fieldNames())
    assert waiting == bag(enrich.on_block(snapshot.trades, calendar, "left_anti"), TRADES.fieldNames())
    assert sum(p.rows for p in store.parts(False)) == len(waiting) < before

    version = store.manifest.version()
    assert not store.reprice(calendar) and store.manifest.version() == version


def test_a_batch_counts_once(store, snapshot, calendar, expected):
    for _ in range(2):
        store.absorb(snapshot.trades, calendar, "a", 0)
    assert not store.absorb(snapshot.trades, calendar, "a", 0)
    assert store.priced().count() == expected.count()
    # Another stream numbers its batches by itself; its equal rows are rows of their own.
    assert store.absorb(snapshot.trades, calendar, "b", 0)
    assert store.priced().count() == 2 * expected.count()


def test_failure_between_the_two_writes(store, snapshot, calendar, expected, monkeypatch):
    early = calendar.where("block_number < 150")
    store.absorb(snapshot.trades, early, "a", 0)

    def lost(*_):
        raise RuntimeError("driver lost")

    for step in (lambda: store.reprice(calendar),
                 lambda: store.absorb(snapshot.trades, calendar, "a", 1)):
        with monkeypatch.context() as broken:
            broken.setattr(store.manifest, "commit", lost)
            with pytest.raises(RuntimeError):
                step()
        known = enrich.with_usd_price(snapshot.trades, early)
        assert bag(store.priced(), expected.columns) == bag(known, expected.columns)
    assert store.reprice(calendar)
    assert bag(store.priced(), expected.columns) == bag(expected, expected.columns)


def test_merged_parts(store, snapshot, calendar, expected):
    for batch in range(4):
        rows = snapshot.trades.where(f"pmod(hash(transaction_hash), 4) = {batch}")
        store.absorb(rows, calendar, "a", batch)
    largest = max(p.rows for p in store.parts(True))
    assert not store.compact(1)
    assert store.compact(largest)
    kept = [p.rows for p in store.parts(True)]
    assert largest in kept and len(kept) == 2
    waiting = bag(store.waiting(), TRADES.fieldNames())
    store.vacuum()
    assert bag(store.priced(), expected.columns) == bag(expected, expected.columns)
    assert bag(store.waiting(), TRADES.fieldNames()) == waiting
    assert not store.absorb(snapshot.trades, calendar, "a", 3)


def test_empty_and_untouched_stores(store, snapshot, calendar, expected):
    assert store.priced().columns == expected.columns and store.priced(calendar).count() == 0
    assert not store.reprice(calendar) and not store.compact(10)
    assert store.absorb(snapshot.trades.limit(0), calendar, "a", 0)
    assert store.parts(True) == store.parts(False) == []
    assert not store.absorb(snapshot.trades, calendar, "a", 0)


@pytest.mark.parametrize("ranges", [False, True])
def test_following_a_stream(spark, tmp_path, store, snapshot, calendar, expected, ranges):
    calendar = enrich.price_calendar(enrich.with_price_ranges(snapshot)) if ranges else calendar
    source, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    snapshot.trades.where("token_id < 2").repartition(3).write.parquet(source)

    def follow():
        stream = ingest.trade_stream(spark, source, TRADES, files_per_batch=1)
        store.follow(stream, calendar, progress).awaitTermination()

    follow()
    follow()
    snapshot.trades.where("token_id >= 2").repartition(2).write.mode("append").parquet(source)
    follow()
    assert bag(store.priced(), expected.columns) == bag(expected, expected.columns)


def test_repricing_reads_waiting_rows_only(store, snapshot, calendar):
    store.absorb(snapshot.trades, calendar.where("block_number < 150"), "a", 0)
    files = store.waiting().inputFiles()
    assert files and all("/priced=false/" in f for f in files)
