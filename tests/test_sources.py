from __future__ import annotations

import datetime
import json
from types import SimpleNamespace

import pytest
from market import START, Market
from pyspark.sql import functions as F

from ledgerlens import __main__ as job
from ledgerlens.plans import enrich
from ledgerlens.plans.report import COLUMNS, weekly_report
from ledgerlens.plans.snapshot import load_snapshot
from ledgerlens.plans.views import MarketView
from ledgerlens.schemas import BLOCKS, TABLES, TRANSFERS
from ledgerlens.session import scratch_path
from ledgerlens.sources import sinks, stats, tables
from ledgerlens.sources.tables import Source


def test_jdbc_options():
    source = Source("jdbc", table="trade_record", options={"url": "jdbc:x", "user": "u"},
                    partition_column="block_number", lower=0, upper=100, partitions=4)
    assert tables.jdbc_options(source) == {
        "url": "jdbc:x", "user": "u", "dbtable": "trade_record",
        "partitionColumn": "block_number", "lowerBound": "0", "upperBound": "100",
        "numPartitions": "4", "fetchsize": "10000",
    }
    assert "partitionColumn" not in tables.jdbc_options(Source("jdbc", table="t"))
    with pytest.raises(ValueError):
        tables.jdbc_options(Source("jdbc"))
    with pytest.raises(ValueError):
        tables.jdbc_options(Source("jdbc", table="t", partition_column="b"))


def test_conform_selects_casts_and_drops(spark):
    raw = spark.createDataFrame(
        [("7", 9, "2023-01-01", "junk")],
        "block_number STRING, timestamp_of_block INT, date_of_block STRING, id STRING",
    )
    got = tables.conform(raw, BLOCKS)
    assert [f.dataType for f in got.schema] == [f.dataType for f in BLOCKS]
    assert tuple(got.first()) == (7, 9, datetime.date(2023, 1, 1))
    bad = raw.withColumn("block_number", F.lit("seven"))
    assert tables.conform(bad, BLOCKS, strict=False).first()[0] is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.conform(bad, BLOCKS).collect()


def test_optional_columns_read_as_null(spark):
    raw = tables.empty_frame(spark, TRANSFERS).drop("value")
    assert "value" in tables.conform(raw, TRANSFERS, ("value",)).columns


def test_row_count_and_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).withColumn("x", F.lit(1)).write.parquet(path)
    source = Source("parquet", path=path)
    assert tables.read_table(spark, source, ["id"]).columns == ["id"]
    assert tables.row_count(tables.read_table(spark, source)).first()[0] == 10


def test_table_stats(spark, tmp_path):
    path = tmp_path / "t"
    spark.range(0, 1000, 1, 5).write.parquet(str(path))
    spark.range(0).coalesce(1).write.mode("append").parquet(str(path))
    files = [f.stat().st_size for f in path.glob("*.parquet")]
    assert len(files) == 6  # the one without rows counts
    got = stats.table_stats(spark, str(path), target_bytes=1000)
    assert tuple(got.first()) == (1000, 6, sum(files), -(-sum(files) // 1000))
    assert "ReadSchema: struct<>" in got._jdf.queryExecution().toString()
    assert tuple(stats.table_stats(spark, str(next(path.glob("*.parquet")))).first())[1] == 1


def test_file_stats(spark, tmp_path):
    path = tmp_path / "t"
    spark.range(0, 1000, 1, 5).write.parquet(str(path))
    spark.range(0).coalesce(1).write.mode("append").parquet(str(path))
    got = {r.file.rsplit("/", 1)[1]: r for r in stats.file_stats(spark, str(path)).collect()}
    assert {name: r.bytes for name, r in got.items()} == {f.name: f.stat().st_size for f in path.glob("*.parquet")}
    assert sorted(r.rows for r in got.values()) == [0, 200, 200, 200, 200, 200]


def test_table_pages(spark):
    for n, pages in ((0, 0), (1, 1), (10, 1), (11, 2)):
        assert tuple(stats.table_pages(spark.range(n), 10).first()) == (n, 10, pages)


def test_sinks(spark, tmp_path, capsys):
    df = spark.range(30).withColumn("text", F.repeat(F.lit("x"), 120))
    sinks.show(df)
    printed = capsys.readouterr().out
    assert "only showing top 20 rows" in printed and "x" * 97 + "..." in printed
    for _ in range(2):
        sinks.write_report(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 30
    sinks.write_table(df.withColumn("part", F.col("id") % 3), str(tmp_path / "p"), ["part"])
    assert sorted(p.name for p in (tmp_path / "p").glob("part=*")) == ["part=0", "part=1", "part=2"]


def stub_session(master: str, folder: str | None):
    settings = {"spark.checkpoint.dir": folder} if folder else {}
    return SimpleNamespace(
        conf=SimpleNamespace(get=settings.get),
        sparkContext=SimpleNamespace(master=master, applicationId=f"{master}-{folder}"),
    )


def test_scratch_folder_comes_from_the_session(spark):
    shared = scratch_path(stub_session("yarn", "hdfs:///shared/"), "x")
    assert shared.startswith("hdfs:///shared/x-")
    assert shared != scratch_path(stub_session("yarn", "hdfs:///shared/"), "x")
    with pytest.raises(ValueError):
        scratch_path(stub_session("yarn", None), "x")
    assert "ledgerlens-" in scratch_path(stub_session("local[2]", None), "x")


@pytest.fixture(scope="module")
def stored_market(spark, tmp_path_factory):
    """The five tables of a market as parquet folders with a surrogate column."""
    base = tmp_path_factory.mktemp("market")
    market = Market(3)
    snapshot = market.snapshot(spark)
    frames = {
        "contract_info": snapshot.contracts,
        "block_info": snapshot.blocks.withColumnRenamed("date", "date_of_block"),
        "rate_info": snapshot.rates.withColumnRenamed("date", "date_of_rate"),
        "trade_record": snapshot.trades,
        "transfer_record": snapshot.transfers.drop("value"),
    }
    for name, df in frames.items():
        df.withColumn("id", F.monotonically_increasing_id()).write.parquet(str(base / name))
    return market, base


def test_load_snapshot(spark, stored_market):
    market, base = stored_market
    loaded = load_snapshot(
        spark, {name: Source("parquet", path=str(base / name)) for name in TABLES}
    )
    assert loaded.block_bound == len(market.blocks) and loaded.rate_bound == len(market.rates)
    assert loaded.rates_per_day == 1 and loaded.calendar_bound == len(market.blocks)
    assert "id" not in enrich.enriched_trades(loaded).columns
    assert enrich.enriched_trades(loaded).count() == len(market.enriched())


def test_report_job(spark, stored_market, tmp_path, capsys):
    market, base = stored_market
    config = {name: {"format": "parquet", "path": str(base / name)} for name in TABLES}
    (tmp_path / "sources.json").write_text(json.dumps(config))
    out = str(tmp_path / "report")
    job.main([START.isoformat(), "--sources", str(tmp_path / "sources.json"), "--output", out])
    printed = capsys.readouterr().out
    assert "collection_volume_usd" in printed and "market cap" in printed
    written = spark.read.json(out)
    assert set(written.columns) <= set(COLUMNS)
    direct = weekly_report(MarketView(market.snapshot(spark), START))
    assert written.count() == direct.count()
    values = {(r.scope, r.metric): r.value for r in direct.where("rank IS NULL").collect()}
    assert values["all", "trades"] == len(market.enriched())
