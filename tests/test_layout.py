"""Bucketed tables: keys chosen by measure, no shuffle by them, equal results."""

from __future__ import annotations

import uuid
from dataclasses import replace

import pytest
from market import START, Market
from pyspark.sql import functions as F

from checks import queries
from ledgerlens.plans import leaderboards
from ledgerlens.plans.views import TOKEN, MarketView
from ledgerlens.sources import layout
from ledgerlens.sources.layout import largest_buckets, write_clustered

CHOICES = [["contract_address"], TOKEN]


@pytest.fixture
def name(spark):
    name = f"t_{uuid.uuid4().hex}"
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def trades(spark, collection: str, token: str):
    """40,000 trades; ``collection`` and ``token`` are SQL of their row number ``id``."""
    return spark.range(40_000).selectExpr(
        f"{collection} AS contract_address", f"{token} AS token_id", "id AS block_number", "id * 0.5 AS price_value")


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def grouped(df, keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("price_value").alias("total"))


def test_even_keys_group_without_a_shuffle(spark, name, tmp_path):
    rows = trades(spark, "id % 1000", "id % 7000")
    assert write_clustered(rows, name, CHOICES, ["block_number"], 8, str(tmp_path / "t")) == ["contract_address"]
    stored = spark.table(name)
    # A bucket by collection also holds all rows of its tokens.
    for keys in CHOICES:
        assert "Exchange" not in physical(grouped(stored, keys))
        assert sorted(map(tuple, grouped(stored, keys).collect())) == sorted(map(tuple, grouped(rows, keys).collect()))
    assert len(list((tmp_path / "t").glob("part-*"))) == 8


def test_a_hot_collection_leaves_buckets_by_token(spark, name, tmp_path):
    rows = trades(spark, "IF(id % 3 = 0, 0, id % 1000)", "id % 7000")
    assert write_clustered(rows, name, CHOICES, [], 8, str(tmp_path / "t")) == TOKEN
    stored = spark.table(name)
    assert "Exchange" not in physical(grouped(stored, TOKEN))
    assert "Exchange hashpartitioning(contract_address" in physical(grouped(stored, ["contract_address"]))
    for keys in CHOICES:
        assert sorted(map(tuple, grouped(stored, keys).collect())) == sorted(map(tuple, grouped(rows, keys).collect()))


def test_a_hot_token_leaves_no_buckets(spark, name, tmp_path):
    rows = trades(spark, "IF(id % 3 = 0, 0, id % 1000)", "IF(id % 3 = 0, 0, id % 7000)")
    assert write_clustered(rows, name, CHOICES, [], 8, str(tmp_path / "t")) == []
    stored = spark.table(name)
    assert "Exchange hashpartitioning" in physical(grouped(stored, TOKEN)) and stored.count() == 40_000


def test_sizes_are_those_of_the_written_buckets(spark, name, tmp_path):
    rows = trades(spark, "IF(id % 50 = 0, NULL, id % 1000)", "id % 7000")
    write_clustered(rows, name, CHOICES, [], 8, str(tmp_path / "t"))
    files = spark.table(name).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert largest_buckets(rows, CHOICES, 8)[0] == files


def test_no_rows(spark, name, tmp_path):
    rows = trades(spark, "id", "id").limit(0)
    assert write_clustered(rows, name, CHOICES, [], None, str(tmp_path / "t")) == ["contract_address"]
    assert spark.table(name).collect() == []


def test_reports_do_not_shuffle_trades(spark, name, tmp_path):
    snapshot = Market(5).snapshot(spark, block_bound=80, rate_bound=40, rates_per_day=1)
    assert write_clustered(snapshot.trades, name, [TOKEN], ["block_number"], 2, str(tmp_path / "t")) == TOKEN
    clustered = replace(snapshot, trades=spark.table(name))
    reports = [leaderboards.token_prices(MarketView(s, START), scope="all", k=None) for s in (snapshot, clustered)]
    shuffled = "Exchange hashpartitioning(contract_address#"
    tokens = [f for f in physical(reports[1]).splitlines() if shuffled in f and "token_id" in f]
    assert not tokens and any(shuffled in f and "token_id" in f for f in physical(reports[0]).splitlines())
    plain, stored = ([tuple(r) for r in df.collect()] for df in reports)
    assert sorted(plain, key=repr) == sorted(stored, key=repr) and plain


def bucket_count(spark, name) -> int:
    found = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").first()
    return int(found.data_type)


@pytest.mark.parametrize(("per_bucket", "buckets"), [(100_000, 8), (1_000, 40)])
def test_buckets_grow_with_the_rows_from_the_least(spark, name, tmp_path, monkeypatch, per_bucket, buckets):
    monkeypatch.setattr(layout, "ROWS_PER_BUCKET", per_bucket)
    rows = trades(spark, "id % 1000", "id % 7000")
    write_clustered(rows, name, CHOICES, [], path=str(tmp_path / "t"), least=8)
    assert bucket_count(spark, name) == buckets and spark.table(name).count() == 40_000


def test_the_clustered_query_holds_its_rows_a_bucket(spark, tmp_path, monkeypatch):
    lines = spark.range(3_000).selectExpr(
        "id AS l_orderkey", "id % 500 AS l_partkey", "id % 11 AS l_suppkey", "1 AS l_linenumber", "1D AS l_quantity",
        "id * 0.5D AS l_extendedprice", "0D AS l_discount", "0D AS l_tax", "'A' AS l_returnflag", "'O' AS l_linestatus",
        "TIMESTAMP_NTZ'1995-03-07' AS l_shipdate")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    for table in ("part", "orders"):
        spark.createDataFrame([], queries.testdata.SCHEMAS[table]).write.parquet(str(tmp_path / f"{table}.parquet"))
    monkeypatch.setattr(layout, "ROWS_PER_BUCKET", 250)
    stored = queries.clustered_view(spark, str(tmp_path)).snapshot.trades
    files = [r.n for r in stored.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()]
    assert sum(files) == 3_000 and max(files) <= 250 * layout.MOST_SHARE


def test_the_weekly_queries_join_sales_once_and_group_them_without_a_shuffle(spark):
    sf = "/root/testdata/sf0.001"
    laid_out, plain = queries.laid_out_view(spark, sf), queries.view(spark, sf, parties=True)
    for ask in (MarketView.held, MarketView.active_tokens, lambda v: v.finest([*TOKEN, "market"])):
        plan = physical(ask(laid_out))
        assert "l_orderkey" not in "".join(f for f in plan.splitlines() if "Join" in f)
        assert not [f for f in plan.splitlines() if "Exchange hashpartitioning(contract_address#" in f and "token_id" in f]
        assert sorted(map(tuple, ask(laid_out).collect()), key=repr) == sorted(map(tuple, ask(plain).collect()), key=repr)
