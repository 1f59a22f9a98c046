"""Physical plans: pruned scans, checked broadcasts, split hot keys."""

from __future__ import annotations

import dataclasses
import datetime
import re

import pytest
from pyspark.sql import functions as F

from checks.compare import difference, oracle_connection
from checks.queries import QUERIES, view
from ledgerlens.operators import joins
from ledgerlens.operators.joins import broadcast_bounded
from ledgerlens.operators.windows import BlockWindow
from ledgerlens.plans import enrich, leaderboards, report, totals
from ledgerlens.plans.snapshot import Snapshot
from ledgerlens.plans.views import MarketView, StoredView
from ledgerlens.schemas import CURRENCIES, TRANSFERS
from ledgerlens.sources.tables import conform

SF = "/root/testdata/sf0.001"
FIRST = datetime.date(2020, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def scanned_rows(df) -> list[int]:
    """Rows each file scan of an executed plan returned."""
    df.collect()
    found = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("Scan"):
            found.append(node.metrics().get("numOutputRows").get().value())
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    """Tables on disk with block-sorted trades: 100 blocks a day over 400 days."""
    base = str(tmp_path_factory.mktemp("chain"))
    days = (F.col("id") / 100).cast("int")
    date = F.date_add(F.lit(FIRST), days)
    spark.range(40_000).select(
        F.col("id").alias("block_number"), F.col("id").alias("timestamp_of_block"),
        date.alias("date"),
    ).write.parquet(base + "/blocks")
    spark.range(400).select(
        F.date_add(F.lit(FIRST), F.col("id").cast("int")).alias("date"),
        (F.col("id") + 1000.0).alias("eth_usd_rate"),
    ).write.parquet(base + "/rates")
    # A third of the trades is in one collection.
    hot = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000)
    spark.range(0, 800_000, 1, 4).select(
        F.hex("id").alias("transaction_hash"),
        (F.col("id") / 20).cast("bigint").alias("block_number"),
        F.concat(F.lit("0xc"), hot).alias("contract_address"),
        (F.col("id") % 50).cast("string").alias("token_id"),
        F.lit("s").alias("seller"), F.lit("b").alias("buyer"),
        F.lit(CURRENCIES[0]).alias("currency_address"),
        (F.col("id") % 7 + 0.5).alias("price_value"),
        F.lit("m").alias("market"),
    ).write.option("parquet.block.size", 200_000).parquet(base + "/trades")
    spark.range(1000).select(
        F.concat(F.lit("0xc"), "id").alias("contract_address"), F.lit("t").alias("contract_type"),
        F.concat(F.lit("n"), "id").alias("contract_name"), F.lit("s").alias("contract_symbol"),
        F.col("id").alias("init_block"),
    ).write.parquet(base + "/contracts")

    def read(name):
        return spark.read.parquet(f"{base}/{name}")

    return Snapshot(
        contracts=read("contracts"), blocks=read("blocks"), rates=read("rates"),
        trades=read("trades"), transfers=spark.createDataFrame([], TRANSFERS),
    )


def test_window_bounds_skip_row_groups(chain):
    """Both bounds reach the scan although they are only known at run time."""
    window = BlockWindow(chain.blocks, FIRST + datetime.timedelta(200), 7)
    week = chain.trades.where(window.holds()).agg(F.count(F.lit(1)))
    assert week.first()[0] == 7 * 100 * 20
    (read,) = scanned_rows(week)
    assert read < 800_000 / 4


def test_resolved_bounds_are_literals_in_the_scan(chain):
    """What a source without runtime filters, such as JDBC, gets to see."""
    lazy = MarketView(chain, FIRST + datetime.timedelta(200))
    fixed = MarketView(chain, FIRST + datetime.timedelta(200), resolve=True)
    pushed = plan(fixed.transfers("week")) + plan(fixed.trades("week"))
    assert "GreaterThanOrEqual(block_number,20000), LessThanOrEqual(block_number,20699)" in pushed
    assert "GreaterThan(block_number,20099)" in plan(fixed.active_tokens())
    assert fixed.trades("week").count() == lazy.trades("week").count() == 14_000


def test_week_report_reads_few_columns_and_filters_early(spark, chain):
    view = MarketView(chain, FIRST + datetime.timedelta(200))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(view.measures(["contract_address"], "week").select("contract_address", "usd"))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    trade_scans = [s for s in re.findall(r"ReadSchema: (struct<[^>]*>)", text) if "price_value" in s]
    assert trade_scans
    for schema in trade_scans:
        assert "seller" not in schema and "token_id" not in schema
    assert "In(currency_address" in text


def test_calendar_is_broadcast_only_within_its_bound(spark, chain):
    assert "ResolvedHint" not in broadcast_bounded(chain.rates, None)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in broadcast_bounded(chain.rates, 400)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in broadcast_bounded(chain.rates, 400, limit=399)._jdf.queryExecution().analyzed().toString()


def test_ranges_of_blocks_spare_the_shuffle_of_trades(spark, chain):
    """A calendar too large to broadcast by block: its ranges are, and no trade moves."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        unbounded = dataclasses.replace(chain, block_bound=None)
        assert "SortMergeJoin" in plan(enrich.with_usd_price(chain.trades, enrich.price_calendar(unbounded)))
        ranged = enrich.with_price_ranges(unbounded)
        priced = enrich.with_usd_price(chain.trades, enrich.price_calendar(ranged))
        physical = priced._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in physical and "hashpartitioning" not in physical and "SortMergeJoin" not in physical
        # 400 days, cut at 40 borders of bins, against 40,000 blocks.
        assert ranged.price_ranges.ranges.count() <= 440
        assert priced.agg(F.count("price_usd"), F.sum("eth_usd_rate")).first() == enrich.with_usd_price(
            chain.trades, enrich.price_calendar(unbounded)).agg(F.count("price_usd"), F.sum("eth_usd_rate")).first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_too_many_ranges_leave_the_calendar_as_it_is(chain):
    gaps = dataclasses.replace(chain, blocks=chain.blocks.where("block_number % 2 = 0"))
    assert enrich.with_price_ranges(gaps, limit=10_000) is gaps
    assert enrich.with_price_ranges(gaps, limit=20_000).price_ranges.ranges.count() == 20_000


def test_hot_collection_is_split_in_the_join(spark, chain):
    """A third of the rows under one key: the adaptive join splits its partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.shuffle.partitions": "20",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        bounded = Snapshot(chain.contracts, chain.blocks, chain.rates, chain.trades, chain.transfers)
        enriched = enrich.enriched_trades(bounded)
        assert enriched.write.format("noop").mode("overwrite").save() is None
        enriched.collect()
        text = enriched._jdf.queryExecution().executedPlan().toString()
        assert "isSkew=true" in text or "skewed" in text
        assert enriched.count() == 800_000
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_hot_key_shrinks_before_the_shuffle(chain):
    view = MarketView(chain, FIRST)
    assert "partial_sum" in plan(view.measures(["contract_address"]))
    latest = view.active_tokens()
    text = latest._jdf.queryExecution().executedPlan().toString()
    assert "partial_max(struct(" in text


EXPENSIVE = re.compile(
    r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython|MapInPandas|"
    r"FlatMapGroupsInPandas|Exchange SinglePartition.*\n.*Sort "
)


def test_calendar_bound_holds_with_several_rates_a_day(spark):
    day = datetime.date(2021, 5, 1)
    blocks = spark.createDataFrame([(i, 0, day) for i in range(10)],
                                   "block_number BIGINT, timestamp_of_block BIGINT, date DATE")
    rates = spark.createDataFrame([(day, float(i)) for i in range(5)], "date DATE, eth_usd_rate DOUBLE")
    empty = spark.createDataFrame([], TRANSFERS)
    bounded = Snapshot(rates, blocks, rates, empty, empty, block_bound=10, rate_bound=5, rates_per_day=5)
    assert enrich.price_calendar(bounded).count() == bounded.calendar_bound == 50
    unknown = Snapshot(rates, blocks, rates, empty, empty, block_bound=10, rate_bound=5)
    assert unknown.calendar_bound is None


@pytest.mark.parametrize("kind", ["int", "bigint", "decimal(20,0)", "string"])
@pytest.mark.parametrize("resolve", [False, True])
def test_window_reaches_scans_of_other_types(spark, chain, tmp_path, kind, resolve):
    """Numbers of any type prune; text is compared as numbers, after the scan."""
    path = str(tmp_path / "transfers")
    spark.range(0, 90_000, 1, 1).selectExpr(
        "'t' AS transaction_hash", "'c' AS contract_address", "'a' AS from_address",
        "'b' AS to_address", "'1' AS token_id", f"CAST(id DIV 10 AS {kind}) AS block_number",
    ).write.option("parquet.block.size", 20_000).parquet(path)
    raw = spark.read.parquet(path)
    shape = (TRANSFERS, ("value",), True)
    stored = Snapshot(
        chain.contracts, chain.blocks, chain.rates, chain.trades, conform(raw, *shape),
        raw={"transfers": raw}, shapes={"transfers": shape},
    )
    view = MarketView(stored, FIRST + datetime.timedelta(20), resolve=resolve)
    week = view.transfers("week").select("block_number")
    assert sorted({r.block_number for r in week.collect()}) == list(range(2000, 2700))
    read = max(scanned_rows(week))
    assert read == 90_000 if kind == "string" else read < 45_000


def test_pages_take_one_scan(spark, chain):
    paged = enrich.paged_trades(chain, [5_000, 10_000, 20_000])
    read = scanned_rows(paged.agg(F.count(F.lit(1)), F.count_if(F.col("page") == 1)))
    assert sorted(read)[-1] == 800_000 and sum(n == 800_000 for n in read) == 1


def test_extremes_shuffle_tokens_once(chain):
    text = plan(leaderboards.price_extremes(MarketView(chain, FIRST + datetime.timedelta(200))))
    physical = text[text.index("== Physical Plan"):]
    assert physical.count("hashpartitioning(contract_address") <= 2  # tokens, and labels if they are not broadcast
    assert "hashpartitioning(scope" not in physical and physical.count("hashpartitioning(contract_address#") >= 1


def test_both_scopes_take_one_scan(chain):
    view = MarketView(chain, FIRST + datetime.timedelta(200))
    for report in (leaderboards.price_extremes, totals.volume_totals, totals.contributors,
                   totals.trade_totals, totals.market_mean):
        assert sum(n == 800_000 for n in scanned_rows(report(view))) == 1, report


def test_queries_agree_without_broadcast(spark):
    """The shuffle plan, which large tables get, against SQL too."""
    connection = oracle_connection(SF)
    names = ["enrich_trades", "volume_collections_week", "market_cap", "price_extremes", "volume_totals",
             "active_traders", "week_trades"]
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    limit = joins.BROADCAST_ROWS
    try:
        joins.broadcast_bounded.__defaults__ = (-1,)
        for setting in settings:
            spark.conf.set(setting, "-1")
        for name in names:
            assert difference(spark, connection, name, SF) is None
            text = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in text
    finally:
        joins.broadcast_bounded.__defaults__ = (limit,)
        for setting in settings:
            spark.conf.unset(setting)


def test_checks_can_tell_right_from_wrong(spark):
    """Filters keep some rows and drop some, so that a broken one would show."""
    def count(name):
        return QUERIES[name](spark, SF).count()

    held, active, idle = count("holders"), count("active_held_tokens"), count("idle_held_tokens")
    assert 0 < active < held and 0 < idle < held and active + idle == held
    (figures,) = QUERIES["active_holding"](spark, SF).collect()
    assert 0 < figures.held_tokens < held
    assert 0 < count("valid_pages") < 50 and 0 < count("invalid_turns") < 87
    for name in ("validate_pages", "validate_conversations"):
        assert all(0 < r.violations < r.checked for r in QUERIES[name](spark, SF).collect())


# weekly_report, stream_enrich and the rolled reports write first; theirs is the plan of what
# they return. The rolled ones read their stores alike, so two of them stand for all.
PLANNED = {n for n in QUERIES if not n.startswith("rolled_")} | {"rolled_price_extremes", "rolled_market_cap"}


@pytest.mark.parametrize("name", sorted(PLANNED))
def test_no_cross_join_no_python_in_any_plan(spark, name):
    text = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not EXPENSIVE.search(text), text


def test_no_cross_join_in_the_report_from_rollups(spark):
    with StoredView.store(view(spark, SF, parties=True)) as stored:
        text = report._report(stored)._jdf.queryExecution().executedPlan().toString()
    assert not EXPENSIVE.search(text), text
