"""Bitmaps of members: counts against plain Python, updates, merges, numbers, failures."""

from __future__ import annotations

import datetime
from dataclasses import replace

import pytest
from market import START, Market
from pyspark.sql import functions as F

from ledgerlens.plans import bitmaps
from ledgerlens.plans.bitmaps import MEMBERS, MemberStore
from ledgerlens.plans.views import MarketView

MARKET = Market(11)
BEFORE = START - datetime.timedelta(7)


@pytest.fixture(scope="module")
def snapshot(spark):
    return MARKET.snapshot(spark)


@pytest.fixture
def store(spark, snapshot, tmp_path):
    return MemberStore(spark, str(tmp_path / "members"), snapshot, MEMBERS)


def expected(keep) -> tuple[int, int, int]:
    """Collections, tokens and traders of the enriched trades that ``keep`` holds."""
    trades = [t for t in MARKET.enriched() if keep(t["block"])]
    return (len({t["contract"] for t in trades}), len({(t["contract"], t["token"]) for t in trades}),
            len({t["seller"] for t in trades} | {t["buyer"] for t in trades}))


def sets_of(lo, hi):
    trades = [t for t in MARKET.enriched() if lo <= t["block"] <= hi]
    return ({t["contract"] for t in trades}, {(t["contract"], t["token"]) for t in trades},
            {p for t in trades for p in (t["seller"], t["buyer"])})


def rows(df):
    return {r.scope: tuple(r)[1:] for r in df.collect()}


def week_blocks(start):
    days = {start + datetime.timedelta(d) for d in range(7)}
    numbers = [b[0] for b in MARKET.blocks if b[2] in days]
    return min(numbers), max(numbers)


def test_members_of_week_and_all_time(snapshot, store):
    lo, hi = MARKET.window()
    for upto in (120, 160):
        assert store.cover(snapshot, upto=upto)
    counted = rows(bitmaps.members(store, MarketView(snapshot, START)))
    assert counted == {"week": expected(lambda b: lo <= b <= hi), "all": expected(lambda b: True)}
    version = store.version()
    assert rows(bitmaps.members(store, MarketView(snapshot, START))) == counted and store.version() == version


def test_two_weeks_merge(snapshot, store):
    week, before = week_blocks(START), week_blocks(BEFORE)
    counted = rows(bitmaps.returning(store, MarketView(snapshot, START), MarketView(snapshot, BEFORE)))
    pairs = list(zip(sets_of(*week), sets_of(*before)))
    assert counted == {
        "week": tuple(len(a) for a, _ in pairs), "before": tuple(len(b) for _, b in pairs),
        "any": tuple(len(a | b) for a, b in pairs), "both": tuple(len(a & b) for a, b in pairs)}


def test_numbers_are_unique_dense_and_stay(snapshot, store, monkeypatch):
    monkeypatch.setattr(bitmaps, "KEYS_PER_GROUP", 7)
    store.cover(snapshot, upto=140)
    first = {k: {tuple(r)[:-1]: r.number for r in n.known().collect()} for k, n in store.numbers.items()}
    store.cover(snapshot)
    for kind, numbers in store.numbers.items():
        known = [tuple(r) for r in numbers.known().collect()]
        now = {k[:-1]: k[-1] for k in known}
        assert len(now) == len(known) == len(set(now.values())) and min(now.values()) == 1
        assert first[kind].items() <= now.items()
    assert rows(store.distinct({"all": None})) == {"all": expected(lambda b: True)}


def test_a_failed_update_keeps_the_numbers_and_counts_nothing_twice(snapshot, store, monkeypatch):
    store.cover(snapshot, upto=140)
    counted = rows(store.distinct({"all": None}))

    def broken(segments):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(store, "_commit", broken)
        with pytest.raises(OSError):
            store.cover(snapshot)
    assert rows(store.distinct({"all": None})) == counted == {"all": expected(lambda b: b <= 140)}
    learnt = {k: n.known().count() for k, n in store.numbers.items()}
    store.cover(snapshot)
    assert {k: n.known().count() for k, n in store.numbers.items()} == learnt
    assert rows(store.distinct({"all": None})) == {"all": expected(lambda b: True)}


def test_compaction_keeps_counts_and_a_cut_range_is_an_error(snapshot, store):
    for upto in (120, 150, None):
        store.cover(snapshot, upto=upto)
    with pytest.raises(ValueError, match="cuts the segment"):
        store.distinct({"part": (130, 160)})
    assert store.compact(before=151) and len(store.segments()) == 2
    store.vacuum()
    assert rows(store.distinct({"all": None})) == {"all": expected(lambda b: True)}


def test_late_collections_count_after_a_refresh(spark, snapshot, store):
    fewer = replace(snapshot, contracts=snapshot.contracts.where("contract_address <> '0xc0'"))
    store.cover(fewer)
    assert rows(store.distinct({"all": None}))["all"][0] == expected(lambda b: True)[0] - 1
    assert store.refresh(snapshot, 0, 10_000)
    assert rows(store.distinct({"all": None})) == {"all": expected(lambda b: True)}


def test_no_trades_and_an_empty_window(spark, snapshot, tmp_path):
    empty = replace(snapshot, trades=snapshot.trades.limit(0))
    store = MemberStore(spark, str(tmp_path / "none"), empty, MEMBERS)
    assert rows(bitmaps.members(store, MarketView(empty, START))) == {"week": (0, 0, 0), "all": (0, 0, 0)}
    far = MarketView(empty, datetime.date(1999, 1, 1))
    assert rows(bitmaps.members(store, far)) == {"week": (0, 0, 0), "all": (0, 0, 0)}


def test_scratch_is_removed_and_bitmaps_are_small(snapshot, store):
    store.cover(snapshot)
    assert not store._scratch
    held = store.read(store.segments())
    assert held.count() == len(MEMBERS)  # one bucket a kind
    assert {r.n for r in held.select(F.octet_length("bits").alias("n")).collect()} == {4096}
