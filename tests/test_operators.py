from __future__ import annotations

import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import dates, numeric, text
from ledgerlens.operators import aggregates, intervals, joins, quality, sets, topk
from ledgerlens.sources import tables


def rows(df):
    return [tuple(row) for row in df.collect()]


def bag(df):
    return sorted(rows(df), key=repr)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def values(spark, items, kind):
    return spark.createDataFrame([(v,) for v in items], f"v {kind}")


# -- inline examples with results worked out by hand --------------------------------------

def test_price_statistics_by_token(spark):
    fares = tables.frame(spark, {
        "route": ["north", "south", "north", "north", None],
        "stop": [4, 4, 4, 9, 4],
        "fare": [12, 40, 18, 7, None],
    }, "route STRING, stop BIGINT, fare BIGINT")
    keys = ["route", "stop"]
    ranked = topk.top_k(aggregates.price_stats(fares, keys, "fare", 4), "avg_fare", keys, None)
    assert rows(ranked) == [
        (None, 4, None, None, None, 1),
        ("south", 4, 40, 40, 40.0, 1),
        ("north", 4, 12, 18, 15.0, 2),
        ("north", 9, 7, 7, 7.0, 1),
    ]
    assert bag(aggregates.sum_all(fares, keys, 4)) == sorted(
        [("north", 4, 30), ("north", 9, 7), ("south", 4, 40), (None, 4, None)], key=repr)


def test_filter_and_group_count(spark):
    df = tables.frame(spark, {"floor": [2, 5, 2, 8], "room": [21, 50, 22, None]},
                      "floor BIGINT, room BIGINT")
    assert rows(df.where(F.col("floor") > 4).orderBy("floor")) == [(5, 50), (8, None)]
    assert bag(aggregates.group_count(df, ["floor"])) == [(2, 2), (5, 1), (8, 1)]


def test_epoch_text_ignores_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/Lima"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert one(spark, dates.epoch_text(F.lit(86_400 * 365 + 3_661))) == ("1971-01-01 01:01:01",)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


# -- scalar functions ------------------------------------------------------------------------

def test_dates(spark):
    first, last = dates.date_span("2022-12-26", 7)
    assert one(spark, dates.date_text(first), dates.date_text(last)) == ("2022-12-26", "2023-01-01")


def test_integer_arithmetic(spark):
    pairs = [(a, b) for a in (-7, -6, 0, 6, 7) for b in (-3, -2, 2, 3)]
    df = spark.createDataFrame(pairs, "a BIGINT, b BIGINT")
    a, b = F.col("a"), F.col("b")
    for x, y, quotient in rows(df.select("a", "b", numeric.floor_div(a, b))):
        assert quotient == x // y
    zero = F.lit(0).cast("bigint")
    assert one(spark, numeric.floor_div(F.lit(5), zero), numeric.ratio(F.lit(5), zero),
               numeric.page_count(F.lit(5), zero)) == (None, None, None)
    assert one(spark, numeric.add(F.lit(2**63 - 1), F.lit(1)), numeric.add(F.lit(2), F.lit(3))) == (None, 5)
    assert one(spark, numeric.page_count(F.lit(10), F.lit(5)), numeric.page_count(F.lit(11), F.lit(5))) == (2, 3)


def test_first_integer(spark):
    df = values(spark, ["12 GB", "size 34, 56", "none", None, "9" * 30], "STRING")
    assert rows(df.select(text.first_integer(F.col("v")))) == [(12,), (34,), (None,), (None,), (None,)]


def test_url_shape(spark):
    good = ["http://a.com", "https://a.b.co/x?y=1#z", "ftp://user:pw@host.org:21/f",
            "http://localhost:8080/", "http://10.0.0.1/x", "http://a.com?q=1"]
    bad = ["a.com", "http://", "http:///x", "mailto:a@b.c", "http://a b.com", "http://nodots/x",
           "http://a.com:port/", "https://a.com/with space", ""]
    df = values(spark, good + bad, "STRING")
    assert rows(df.select("v", text.is_url(F.col("v")))) == [(u, u in good) for u in good + bad]


@pytest.mark.parametrize("scale", [1, 4, 6, 7, 18])
def test_exact_sum_is_the_rounded_true_sum(spark, scale):
    from fractions import Fraction
    rng = random.Random(scale)
    numbers = [rng.choice([1, -1]) * rng.random() * 10 ** rng.randrange(-3, 12) for _ in range(500)]
    numbers += [0.0, 0.5, -0.5, 999999.9999999999, 1e6, -1e6]
    got = values(spark, [*numbers, None], "DOUBLE").agg(numeric.exact_sum("v", scale)).first()[0]
    true = sum(Fraction(n) for n in numbers)
    # Each value is off by half a unit of the last decimal at most, and by the sixth-digit
    # products of a double.
    allowed = Fraction(len(numbers), 2 * 10**scale) + Fraction(len(numbers), 10**15)
    assert abs(Fraction(got) - true) <= allowed


def test_exact_sum_does_not_depend_on_order(spark):
    rng = random.Random(5)
    numbers = [rng.random() * 10 ** rng.randrange(-12, 12) for _ in range(2000)]
    found = set()
    for partitions in (1, 3, 8):
        rng.shuffle(numbers)
        df = values(spark, numbers, "DOUBLE").repartition(partitions)
        found.add(df.agg(numeric.exact_sum("v", 18)).first()[0])
    assert len(found) == 1


def test_exact_sum_edges(spark):
    assert values(spark, [None], "DOUBLE").agg(numeric.exact_sum("v", 18)).first()[0] is None
    tiny = values(spark, [1e-15, 2e-15], "DOUBLE").agg(numeric.exact_sum("v", 18).cast("double"))
    assert tiny.first()[0] == 3e-15
    huge = values(spark, [1e20, -3e19, 0.25], "DOUBLE").agg(numeric.exact_sum("v", 4)).first()[0]
    assert huge == Decimal("70000000000000000000.25")
    for bad in (float("nan"), float("inf"), 1e25):
        with pytest.raises(Exception, match="CAST_OVERFLOW"):
            values(spark, [1.0, bad], "DOUBLE").agg(numeric.exact_sum("v", 4)).collect()
    with pytest.raises(ValueError):
        numeric.exact_sum("v", 0)


# -- joins and sets ------------------------------------------------------------------------------

def test_join_renames_collisions(spark):
    left = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "id INT, k INT, v STRING")
    right = spark.createDataFrame([(7, 10, "x"), (8, 30, "y")], "id INT, k INT, w STRING")
    joined = joins.join_frames(left, right, "k")
    assert joined.columns == ["k", "id", "v", "id_right", "w"]
    assert rows(joined) == [(10, 1, "a", 7, "x")]
    pairs = joins.join_frames(left, right, {"k": "k"})
    assert pairs.columns == ["id", "k", "v", "id_right", "k_right", "w"]
    assert rows(pairs) == [(1, 10, "a", 7, 10, "x")]
    named = joins.join_frames(left, right.withColumnRenamed("k", "key"), {"k": "key"}, "right")
    assert bag(named) == [(1, 10, "a", 7, 10, "x"), (None, None, None, 8, 30, "y")]


def test_membership_and_nulls(spark):
    df = values(spark, [1, 1, 2, None], "INT")
    wanted = values(spark, [1, 3, None, None], "INT")
    assert bag(joins.members(df, "v", wanted)) == [(1,), (1,)]
    assert bag(joins.non_members(df, "v", wanted)) == [(2,), (None,)]
    assert bag(tables.where_in(df, "v", [1, 3])) == [(1,), (1,)]


def test_value_sets(spark):
    a, b = values(spark, [1, 1, 2, None], "INT"), values(spark, [2, 3, None], "INT")
    assert bag(sets.union_values(a, b)) == [(1,), (2,), (3,), (None,)]
    assert bag(sets.difference_values(a, b)) == [(1,)]
    assert bag(sets.distinct_values(a, "v", "w")) == [(1,), (2,), (None,)]
    assert aggregates.distinct_count(a, ["v"]).first()[0] == 3
    swapped = spark.createDataFrame([(1, 2)], "x INT, y INT")
    other = spark.createDataFrame([(3, 4)], "y INT, x INT")
    assert rows(sets.concat(swapped, other)) == [(1, 2), (4, 3)]


# -- aggregates and order --------------------------------------------------------------------------

def test_latest_per_key_ignores_row_order(spark):
    trades = [("a", 1, "x"), ("a", 3, "y"), ("a", 3, "z"), ("b", None, "w"), ("b", None, None), (None, 2, "q")]
    expected = [("a", "z"), ("b", "w"), (None, "q")]
    for seed in range(4):
        random.Random(seed).shuffle(trades)
        df = spark.createDataFrame(trades, "k STRING, b INT, v STRING").repartition(seed + 1)
        assert bag(aggregates.latest_per_key(df, ["k"], ["b"], ["v"])) == sorted(expected, key=repr)


def test_all_column_aggregates(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", None), (2, None, 7)], "k INT, s STRING, n INT")
    assert bag(aggregates.aggregate_all(df, ["k"], F.max)) == [(1, "b", 5), (2, None, 7)]
    assert bag(aggregates.aggregate_all(df, ["k"], F.min)) == [(1, "a", 5), (2, None, 7)]
    assert bag(aggregates.sum_all(df, ["k"], 2)) == [(1, 5), (2, 7)]


def test_top_k_puts_nulls_first_and_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("c", 1), ("a", 2), ("b", 2), ("d", None)], "k STRING, m INT")
    assert rows(topk.top_k(df, "m", ["k"], 3)) == [("d", None), ("a", 2), ("b", 2)]


def test_pages_cover_the_table_once(spark):
    df = spark.range(25).withColumn("half", (F.col("id") / 2).cast("int"))
    pages = [rows(topk.page(df, ["half", "id"], start, 10)) for start in (0, 10, 20, 30)]
    assert [len(p) for p in pages] == [10, 10, 5, 0]
    assert sum(pages, []) == rows(df.orderBy("half", "id"))
    assert topk.sample_rows(df, 7).count() == 7


# -- validation -----------------------------------------------------------------------------------------

def test_validation_rules(spark):
    parcels = spark.createDataFrame([
        ("p1", "250", "air", "https://track.example.org/p1"),
        ("p2", "2.5", "sea", "track.example.org/p2"),
        (None, None, "rail", None),
        ("p4", "-3", None, "http://localhost:80/"),
    ], "parcel STRING, grams STRING, route STRING, link STRING")
    rules = [
        quality.required_text("parcel"),
        quality.integer("grams", required=True),
        quality.choice("route", ["air", "sea"]),
        quality.url("link"),
    ]
    assert rows(quality.valid_rows(parcels, rules).select("parcel")) == [("p1",), ("p4",)]
    assert rows(quality.invalid_rows(parcels, rules).select("parcel", "violations")) == [
        ("p2", "grams_integer,link_url"),
        (None, "parcel_required,grams_integer,route_choice"),
    ]
    assert {r.rule: (r.checked, r.violations) for r in quality.violation_counts(parcels, rules).collect()} == {
        "parcel_required": (4, 1), "grams_integer": (4, 2), "route_choice": (4, 1), "link_url": (4, 1),
    }


def test_runs_end_at_gaps_other_values_and_bins(spark):
    rows = [(b, "x") for b in [-3, -2, -1, 0, 1, 2, 5, 6, 6, 1023, 1024]] + [(7, "y"), (8, "y"), (2, "y"), (None, "x"), (9, None), (10, None)]
    found = intervals.runs(spark.createDataFrame(rows, "n BIGINT, v STRING"), "n", ["v"]).collect()
    assert sorted((r.range_low, r.range_high, r.v or "") for r in found) == [
        (-3, -1, "x"), (0, 2, "x"), (2, 2, "y"), (5, 5, "x"), (6, 6, "x"), (6, 6, "x"), (7, 8, "y"), (9, 10, ""),
        (1023, 1023, "x"), (1024, 1024, "x")]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_range_join_equals_a_join_on_numbers(spark, how):
    rnd = random.Random(3)
    numbers = spark.createDataFrame(
        [(n, rnd.choice("ab")) for n in range(-2000, 6000) if rnd.random() < 0.8 for _ in range(rnd.choice([1, 1, 1, 2]))],
        "n BIGINT, v STRING")
    rows = spark.range(-2500, 6500, 3).selectExpr("id", "IF(id % 50 = 0, NULL, id) AS n")
    table = intervals.RangeTable(intervals.runs(numbers, "n", ["v"]))
    got, want = table.join(rows, "n", how), rows.join(numbers, "n", how)
    assert set(got.columns) == set(want.columns)
    assert Counter(got.select("id", *want.drop("id").columns).collect()) == Counter(
        want.select("id", *want.drop("id").columns).collect())
