"""Stores that grow: updates, windows, late rows, failures between the two writes."""

from __future__ import annotations

import datetime
import pathlib
from dataclasses import replace

import pytest
from market import START, Market
from pyspark.sql import functions as F

from checks import queries
from ledgerlens.plans import cohorts, leaderboards, totals, views
from ledgerlens.plans.rollups import FIRST, ArrivalStore, HoldingStore, RolledView, TradeStore
from ledgerlens.plans.views import TOKEN, MarketView, StoredView


@pytest.fixture(scope="module")
def snapshot(spark):
    return Market(7).snapshot(spark)


@pytest.fixture
def store(spark, snapshot, tmp_path):
    return TradeStore(spark, str(tmp_path / "trades"), snapshot)


def ranges(store):
    return [(s.first, s.last) for s in store.segments()]


def held(store):
    return sorted(map(tuple, store.merged(store.read(store.segments())).collect()), key=repr)


def whole(snapshot, store):
    return sorted(map(tuple, store.rolled(snapshot, store.rows(snapshot), []).collect()), key=repr)


def test_updates_equal_one_run_and_a_repeat_changes_nothing(snapshot, store):
    assert store.segments() == [] and store.read([]).collect() == []
    assert store.cover(snapshot, upto=130) and store.cover(snapshot, upto=180)
    assert ranges(store) == [(FIRST, 130), (131, 180)]
    assert store.cover(snapshot) and ranges(store)[2] == (181, 218)
    assert held(store) == whole(snapshot, store)
    version = store.version()
    assert not store.cover(snapshot) and not store.cover(snapshot, cuts=[131, 500]) and store.version() == version


def test_an_update_scans_new_blocks_only(snapshot, store, monkeypatch):
    store.cover(snapshot, upto=180)
    asked = []
    rolled = store.rolled
    monkeypatch.setattr(store, "rolled", lambda s, rows, keys: asked.append(rows) or rolled(s, rows, keys))
    store.cover(snapshot)
    low, high = asked[0].agg(F.min("block_number"), F.max("block_number")).first()
    assert 181 <= low <= high <= 218
    optimized = asked[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "block_number" in optimized and ">= 181" in optimized and "<= 218" in optimized


def test_a_window_becomes_whole_segments(snapshot, store):
    store.cover(snapshot)
    assert store.cover(snapshot, cuts=[150, 171])
    assert ranges(store) == [(FIRST, 149), (150, 170), (171, 218)]
    week = store.read(store.segments(), (150, 170)).where("in_week").drop("in_week")
    rows = store.rows(snapshot).where("block_number BETWEEN 150 AND 170")
    assert sorted(map(tuple, store.merged(week).collect()), key=repr) == sorted(
        map(tuple, store.rolled(snapshot, rows, []).collect()), key=repr)
    assert held(store) == whole(snapshot, store)


def test_compaction_and_vacuum_keep_what_is_held(snapshot, store):
    for upto in (120, 150, 180, None):
        store.cover(snapshot, upto=upto)
    assert store.compact(before=181) and ranges(store) == [(FIRST, 180), (181, 218)]
    assert not store.compact(before=181)
    store.vacuum()
    assert held(store) == whole(snapshot, store)
    assert {f.name for f in (store_path(store) / "segments").iterdir()} == {
        s.folder.split("/")[1] for s in store.segments()}


def store_path(store):
    return pathlib.Path(store.path)


def test_late_rows_are_seen_after_a_refresh(snapshot, store):
    early = replace(snapshot, trades=snapshot.trades.where("block_number NOT BETWEEN 139 AND 159 OR block_number IS NULL"))
    store.cover(early, upto=160)
    store.cover(early)
    assert held(store) == whole(early, store) != whole(snapshot, store)
    assert store.refresh(snapshot, 139, 159) and held(store) == whole(snapshot, store)
    assert ranges(store) == [(FIRST, 160), (161, 218)]


def test_a_failure_between_the_writes_leaves_the_old_state(snapshot, store, monkeypatch):
    store.cover(snapshot, upto=150)
    before, version = held(store), store.version()

    def fail(segments):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(store, "_commit", fail)
        with pytest.raises(RuntimeError):
            store.cover(snapshot)
    assert held(store) == before and store.version() == version
    store.cover(snapshot)
    assert held(store) == whole(snapshot, store)


def test_no_blocks_and_an_empty_window(spark, snapshot, tmp_path):
    bare = replace(snapshot, blocks=snapshot.blocks.where("false"))
    store = TradeStore(spark, str(tmp_path / "bare"), bare)
    assert not store.cover(bare) and store.version() == 0
    view = RolledView(MarketView(snapshot, datetime.date(1999, 1, 1)), TradeStore(spark, str(tmp_path / "t"), snapshot))
    assert leaderboards.collection_volume(view, "week").collect() == []
    assert leaderboards.collection_volume(view, "all").count() == leaderboards.collection_volume(
        MarketView(snapshot, START), "all").count()


def test_holdings_follow_blocks_that_are_not_known_yet(spark, snapshot, tmp_path):
    """Transfers of unknown blocks count as in the direct report."""
    direct = MarketView(snapshot, START)
    rolled = RolledView(direct, TradeStore(spark, str(tmp_path / "t"), snapshot),
                        HoldingStore(spark, str(tmp_path / "h"), snapshot))
    assert sorted(rolled.holders().collect(), key=repr) == sorted(direct.holders().collect(), key=repr)
    for scope in ("week", "all"):
        assert rolled.transfers_by([], scope).collect() == direct.transfers_by([], scope).collect()


def test_holders_after_each_batch_with_late_blocks(spark, snapshot, tmp_path, monkeypatch):
    monkeypatch.setattr(ArrivalStore, "MOST_SEGMENTS", 2)
    transfers = snapshot.transfers.withColumn("batch", F.pmod(F.xxhash64("transaction_hash"), F.lit(4)))
    store = ArrivalStore(spark, str(tmp_path / "a"), snapshot.transfers)
    for batch in range(4):
        rows = transfers.where(F.col("batch") == batch).drop("batch")
        assert store.absorb(rows, batch) and not store.absorb(rows, batch)
        so_far = replace(snapshot, transfers=transfers.where(F.col("batch") <= batch).drop("batch"))
        assert sorted(store.holders().collect(), key=repr) == sorted(
            MarketView(so_far, START).holders().collect(), key=repr)
    assert len(store.segments()) < 4


def test_reports_on_transfers_need_no_store_of_trades(spark, snapshot, tmp_path):
    direct = MarketView(snapshot, START)
    rolled = RolledView(direct, holdings=HoldingStore(spark, str(tmp_path / "h"), snapshot))
    for report in (cohorts.holder_summary, totals.contributors, totals.volume_totals):
        assert sorted(report(rolled).collect(), key=repr) == sorted(report(direct).collect(), key=repr)


@pytest.mark.parametrize("name", ["rolled_holder_summary", "rolled_transfer_totals"])
def test_queries_on_transfers_roll_no_trades_up(spark, monkeypatch, name):
    monkeypatch.setattr(TradeStore, "cover", lambda *a, **b: pytest.fail("trades are not asked for"))
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 1


def test_a_report_on_segments_stores_them_no_second_time(spark, snapshot, tmp_path, monkeypatch):
    """Also where collections are listed twice, under one name or two."""
    listed = snapshot.contracts
    again = listed.where("init_block % 3 = 0").unionByName(
        listed.where("init_block % 5 = 0").withColumn("contract_name", F.lit("second name")))
    direct = MarketView(replace(snapshot, contracts=listed.unionByName(again)), START)
    rolled = RolledView(direct, TradeStore(spark, str(tmp_path / "t"), direct.snapshot))
    labels = []
    path = views.scratch_path
    monkeypatch.setattr(views, "scratch_path", lambda s, label: labels.append(label) or path(s, label))
    with StoredView.store(rolled) as stored:
        assert "trades" not in labels
        with StoredView.store(direct) as expected:
            for keys in (TOKEN, ["contract_address"], ["market"]):
                columns = expected.scoped(keys).columns
                assert stored.scoped(keys).columns == columns
                assert sorted(map(tuple, stored.scoped(keys).collect()), key=repr) == sorted(
                    map(tuple, expected.scoped(keys).collect()), key=repr)
