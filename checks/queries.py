"""The registered queries: report operators on the test data."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import dates, numeric, text
from ledgerlens.operators import aggregates, joins, quality, sets, topk
from ledgerlens.operators.windows import block_at
from ledgerlens.plans import bitmaps, cohorts, enrich, leaderboards, report, totals
from ledgerlens.plans.rollups import ArrivalStore, HoldingStore, RolledView, TradeStore
from ledgerlens.plans.views import ALL, TOKEN, WEEK, MarketView
from ledgerlens.session import scratch_path
from ledgerlens.sources import balance, layout, stats, tables, testdata
from ledgerlens.streaming import ingest
from ledgerlens.streaming.priced import PricedStore

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def view(
    spark: SparkSession, sf_dir: str, parties: bool = False, cutoff: str | None = None
) -> MarketView:
    snapshot = testdata.snapshot(spark, sf_dir, parties)
    return MarketView(snapshot, testdata.WEEK_START, testdata.WEEK_DAYS, cutoff)


def register(name: str, report, parties: bool = False, cutoff: str | None = None, **options) -> None:
    """A report on the market view as a query."""
    QUERIES[name] = lambda spark, sf_dir: report(view(spark, sf_dir, parties, cutoff), **options)


def iso(df: DataFrame) -> DataFrame:
    """Dates as ISO text, the form they have in reports."""
    return df.withColumn("date", dates.date_text(F.col("date")))


# -- enriched trades and windows --------------------------------------------------

@query
def enrich_trades(spark, sf_dir):
    return iso(enrich.enriched_trades(testdata.snapshot(spark, sf_dir, parties=True)))


@query
def enrich_trades_by_range(spark, sf_dir):
    """The same with the calendar as ranges of blocks, as for chains of many blocks."""
    snapshot = enrich.with_price_ranges(testdata.snapshot(spark, sf_dir, parties=True))
    return iso(enrich.enriched_trades(snapshot))


@query
def minute_prices(spark, sf_dir):
    """Events priced by minute: ranges with gaps, repeated minutes and several rates a day."""
    return iso(enrich.with_usd_price(testdata.minute_trades(spark, sf_dir), enrich.price_calendar(
        enrich.with_price_ranges(testdata.minute_snapshot(spark, sf_dir)))))


@query
def unpriced_minutes(spark, sf_dir):
    """Events whose minute has no price."""
    snapshot = enrich.with_price_ranges(testdata.minute_snapshot(spark, sf_dir))
    return enrich.on_block(
        testdata.minute_trades(spark, sf_dir), enrich.price_calendar(snapshot), "left_anti")


@query
def week_window(spark, sf_dir):
    return view(spark, sf_dir).window.frame()


@query
def week_trades(spark, sf_dir):
    return iso(view(spark, sf_dir, parties=True).enriched(WEEK))


@query
def week_transfers(spark, sf_dir):
    return view(spark, sf_dir, parties=True).transfers(WEEK)


@query
def cutoff_block(spark, sf_dir):
    blocks = testdata.ship_blocks(spark, sf_dir)
    # The cutoff next to the blocks of the last day before it, kept as rows.
    return blocks.where(F.col("block_number") == block_at(blocks, testdata.WEEK_START)).select(
        "block_number", dates.date_text(F.col("date")).alias("date")
    )


# -- leaderboards ---------------------------------------------------------------------

for _scope in (WEEK, ALL):
    register(f"volume_collections_{_scope}", leaderboards.collection_volume, scope=_scope)
    register(f"volume_markets_{_scope}", leaderboards.market_volume, parties=True, scope=_scope)
    register(f"trades_collections_{_scope}", leaderboards.collection_trades, scope=_scope)
    register(f"trades_tokens_{_scope}", leaderboards.token_trades, scope=_scope)
    register(f"price_stats_collections_{_scope}", leaderboards.collection_prices, scope=_scope)
    register(f"price_stats_tokens_{_scope}", leaderboards.token_prices, scope=_scope)

register("volume_collections_ranked", leaderboards.collection_volume, scope=ALL, k=None)


@query
def price_extremes(spark, sf_dir):
    return leaderboards.price_extremes(view(spark, sf_dir))


def _as_text(df: DataFrame) -> DataFrame:
    """Without the columns that only repeat the collection."""
    return iso(df.drop("contract_type", "contract_symbol", "init_block"))


@query
def token_max_all_columns(spark, sf_dir):
    return _as_text(leaderboards.token_columns(view(spark, sf_dir, parties=True), F.max))


@query
def token_min_all_columns(spark, sf_dir):
    return _as_text(leaderboards.token_columns(view(spark, sf_dir, parties=True), F.min))


@query
def token_sum_all_columns(spark, sf_dir):
    return leaderboards.token_sums(view(spark, sf_dir)).drop("contract_name")


@query
def token_price_summary(spark, sf_dir):
    market = view(spark, sf_dir)
    prices = aggregates.price_stats(market.trades(), TOKEN, "price_value", testdata.SCALE)
    return prices.join(market.labels, "contract_address").drop("contract_name")


# -- reports from rollups that grow -------------------------------------------------------

STORES = {"trades": TradeStore, "holdings": HoldingStore}


def rolled_view(market: MarketView, *kinds: str) -> RolledView:
    """Stores that are brought up to date twice: to the end of 1996, then to the newest block."""
    spark = market.snapshot.trades.sparkSession
    path = scratch_path(spark, "rollups")
    stores = {kind: STORES[kind](spark, f"{path}/{kind}", market.snapshot) for kind in kinds}
    for store in stores.values():
        store.cover(market.snapshot, upto=testdata.FIRST_UPDATE)
    return RolledView(market, **stores)


def laid_out_view(spark: SparkSession, sf_dir: str) -> MarketView:
    """A view for reports that read trades and transfers many times: sales joined once, in buckets."""
    path = scratch_path(spark, "sales")
    sales = testdata.clustered_trades(spark, sf_dir, "sales_" + path.rsplit("-", 1)[1], path)
    return MarketView(testdata.snapshot(spark, sf_dir, sales=sales), testdata.WEEK_START, testdata.WEEK_DAYS)


def register_rolled(name: str, report, *kinds: str, **options) -> None:
    """A report from the stores of ``kinds``, those that it asks for figures."""
    kinds = kinds or ("trades",)
    QUERIES[f"rolled_{name}"] = lambda spark, sf_dir: report(
        rolled_view(view(spark, sf_dir, "holdings" in kinds), *kinds), **options)


for _scope in (WEEK, ALL):
    register_rolled(f"volume_collections_{_scope}", leaderboards.collection_volume, scope=_scope)
register_rolled("price_stats_tokens_all", leaderboards.token_prices, scope=ALL)
register_rolled("price_extremes", leaderboards.price_extremes)
register_rolled("volume_totals", totals.volume_totals)
register_rolled("contributors", totals.contributors)
register_rolled("new_collections", cohorts.new_collections)
register_rolled("market_cap", totals.market_cap, "trades", "holdings")
register_rolled("transfer_totals", totals.transfer_totals, "holdings")
register_rolled("holder_summary", cohorts.holder_summary, "holdings")


@query
def rolled_weekly_report(spark, sf_dir):
    return report.weekly_report(rolled_view(laid_out_view(spark, sf_dir), "trades", "holdings"))


@query
def arrived_holders(spark, sf_dir):
    """Holders from transfers that arrive in three batches, each with late blocks; one comes twice."""
    transfers = testdata.snapshot(spark, sf_dir, parties=True).transfers
    store = ArrivalStore(spark, scratch_path(spark, "arrivals"), transfers)
    for batch in (0, 1, 1, 2):
        store.absorb(transfers.where(F.pmod(F.xxhash64("transaction_hash"), F.lit(3)) == batch), batch)
    return store.holders()


# -- reports on trades in buckets ---------------------------------------------------------

def clustered_view(spark: SparkSession, sf_dir: str) -> MarketView:
    """Trades in eight buckets or more by collection, or by token if a collection is hot."""
    snapshot = testdata.snapshot(spark, sf_dir)
    path = scratch_path(spark, "clustered")
    name = "trades_" + path.rsplit("-", 1)[1]
    layout.write_clustered(
        snapshot.trades, name, [["contract_address"], TOKEN], ["block_number"], path=path, least=8)
    clustered = dataclasses.replace(snapshot, trades=spark.table(name))
    return MarketView(clustered, testdata.WEEK_START, testdata.WEEK_DAYS)


def register_clustered(name: str, report, **options) -> None:
    QUERIES[f"clustered_{name}"] = lambda spark, sf_dir: report(clustered_view(spark, sf_dir), **options)


register_clustered("price_stats_tokens_all", leaderboards.token_prices, scope=ALL)
register_clustered("volume_collections_week", leaderboards.collection_volume, scope=WEEK)
register_clustered("contributors", totals.contributors)


# -- distinct counts from bitmaps ---------------------------------------------------------

def member_store(spark: SparkSession, sf_dir: str, market: MarketView, *kinds: str) -> bitmaps.MemberStore:
    """Bitmaps of the blocks to the end of 1996; reports bring the rest up to date."""
    store = bitmaps.MemberStore(spark, scratch_path(spark, "bitmaps"), market.snapshot, kinds)
    store.cover(market.snapshot, upto=testdata.FIRST_UPDATE)
    return store


@query
def bitmap_contributors(spark, sf_dir):
    market = view(spark, sf_dir)
    return bitmaps.members(member_store(spark, sf_dir, market, "collections", "tokens"), market)


@query
def bitmap_traders(spark, sf_dir):
    market = view(spark, sf_dir, parties=True)
    return bitmaps.members(member_store(spark, sf_dir, market, "traders"), market)


@query
def bitmap_returning(spark, sf_dir):
    """Collections, tokens and traders of two weeks, of either and of both."""
    market = view(spark, sf_dir, parties=True)
    before = MarketView(market.snapshot, testdata.WEEK_BEFORE, testdata.WEEK_DAYS)
    return bitmaps.returning(member_store(spark, sf_dir, market, *bitmaps.MEMBERS), market, before)


# -- totals ------------------------------------------------------------------------------

register("market_cap", totals.market_cap)
register("market_cap_tokens", totals.market_cap, weight="tokens")
register("volume_totals", totals.volume_totals)
register("contributors", totals.contributors)
register("transfer_totals", totals.transfer_totals)
register("trade_totals", totals.trade_totals)
register("market_mean", totals.market_mean)
register("summary_lines", totals.summary_lines, parties=True)


# -- cohorts ---------------------------------------------------------------------------------

register("new_collections", cohorts.new_collections)
register("new_mints", cohorts.new_mints)
register("new_mints_bounded", cohorts.new_mints, bounded=True)
register("holders", MarketView.holders, parties=True)
register("holder_summary", cohorts.holder_summary, parties=True)
# A late cutoff, so that only some holders count as active.
register("active_traders", cohorts.active_traders, parties=True, cutoff=testdata.LATE_CUTOFF)
register("active_holding", cohorts.active_holding, parties=True, cutoff=testdata.LATE_CUTOFF)


@query
def new_collections_by_sets(spark, sf_dir):
    """The same collections as the difference of two value sets."""
    market = view(spark, sf_dir)
    week = sets.distinct_values(market.trades(WEEK), "contract_address")
    earlier = market.trades().where(F.col("block_number") < market.window.lo)
    fresh = sets.difference_values(week, sets.distinct_values(earlier, "contract_address"))
    return joins.members(fresh, "contract_address", market.labels.select("contract_address"))


@query
def active_held_tokens(spark, sf_dir):
    """Tokens held by an active trader, as a semi-join."""
    market = view(spark, sf_dir, True, testdata.LATE_CUTOFF)
    return joins.members(market.holders(), "to_address", cohorts.active_traders(market))


@query
def idle_held_tokens(spark, sf_dir):
    """Tokens whose holder is not an active trader, as an anti-join."""
    market = view(spark, sf_dir, True, testdata.LATE_CUTOFF)
    return joins.non_members(market.holders(), "to_address", cohorts.active_traders(market))


@query
def distinct_holders(spark, sf_dir):
    holders = view(spark, sf_dir, parties=True).holders()
    return aggregates.distinct_count(holders, ["to_address"], "holders")


@query
def weekly_report(spark, sf_dir):
    return report.weekly_report(laid_out_view(spark, sf_dir))


# -- samples, pages, ingest ------------------------------------------------------------------

@query
def latest_blocks_inner(spark, sf_dir):
    return iso(enrich.latest_blocks(testdata.snapshot(spark, sf_dir)))


@query
def latest_trades_right(spark, sf_dir):
    blocks = testdata.order_blocks(spark, sf_dir)
    return enrich.latest_trades(testdata.snapshot(spark, sf_dir, True, blocks))


TRADE_ORDER = [
    "block_number", "contract_address", "token_id", "price_value", "transaction_hash",
    "currency_address", "seller",
]


@query
def page_at_offset(spark, sf_dir):
    trades = enrich.eth_trades(testdata.snapshot(spark, sf_dir))
    return topk.page(trades, TRADE_ORDER, offset=2000, size=1000)


@query
def chunked_enrich(spark, sf_dir):
    snapshot = testdata.snapshot(spark, sf_dir)
    # Yearly block ranges from 1996 to 2001.
    bounds = [9496, 9862, 10227, 10592, 10957, 11323]
    return iso(enrich.paged_trades(snapshot, bounds))


def _arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades arriving as several files, two of them a micro-batch."""
    arrived = scratch_path(spark, "arrived")
    lines = testdata.table(spark, sf_dir, "lineitem")
    lines.select("l_returnflag", "l_partkey", "l_extendedprice", "l_shipdate").repartition(6).write.parquet(arrived)
    stream = ingest.trade_stream(
        spark, arrived, lines.select("l_returnflag", "l_partkey", "l_extendedprice", "l_shipdate").schema,
        files_per_batch=2,
    )
    return tables.where_in(
        stream.selectExpr(
            "l_returnflag AS currency_address",
            "l_partkey AS contract_address",
            "l_extendedprice AS price_value",
            f"{testdata.day_number('l_shipdate')} AS block_number",
        ),
        "currency_address", testdata.CURRENCIES,
    )


@query
def stream_enrich(spark, sf_dir):
    """Arriving trades, priced."""
    return iso(ingest.ingest(
        _arriving(spark, sf_dir), enrich.price_calendar(testdata.snapshot(spark, sf_dir)),
        scratch_path(spark, "priced"), scratch_path(spark, "priced-progress"),
    ))


def _repriced(spark: SparkSession, sf_dir: str) -> PricedStore:
    """A store of arriving trades whose later blocks are known only after all batches."""
    trades = _arriving(spark, sf_dir)
    calendar = enrich.price_calendar(testdata.snapshot(spark, sf_dir))
    store = PricedStore(scratch_path(spark, "priced-store"), trades, calendar)
    early = calendar.where(F.col("block_number") <= testdata.FIRST_UPDATE)
    store.follow(trades, early, scratch_path(spark, "priced-progress")).awaitTermination()
    store.reprice(calendar)
    return store


@query
def stream_repriced(spark, sf_dir):
    """Trades priced on arrival or once their block was known, each once, in merged parts."""
    store = _repriced(spark, sf_dir)
    store.compact(testdata.SMALL_PART)
    return iso(store.priced())


@query
def stream_waiting(spark, sf_dir):
    """Trades that wait on when all blocks are known: those of days without a rate."""
    return _repriced(spark, sf_dir).waiting()


@query
def balanced_enrich(spark, sf_dir):
    """Priced trades read part by part, the parts being equal in rows."""
    snapshot = testdata.snapshot(spark, sf_dir)
    parts = balance.balanced_predicates(snapshot.trades, "block_number", 6, spread="token_id")
    calendar = enrich.price_calendar(snapshot)
    return iso(sets.concat(*[
        enrich.with_usd_price(enrich.eth_trades(snapshot, snapshot.trades.where(part)), calendar) for part in parts]))


# -- sources -----------------------------------------------------------------------------------

@query
def table_row_counts(spark, sf_dir):
    """Rows of the five report tables."""
    s = testdata.snapshot(spark, sf_dir)
    named = {
        "contracts": s.contracts, "blocks": s.blocks, "rates": s.rates,
        "trades": s.trades, "transfers": s.transfers,
    }
    return sets.concat(*[
        tables.row_count(df).select(F.lit(name).alias("table_name"), "rows")
        for name, df in named.items()
    ])


STAT_TABLES = ("lineitem", "orders", "part")


@query
def table_stats(spark, sf_dir):
    return sets.concat(*[
        stats.table_stats(spark, f"{sf_dir}/{name}.parquet", target_bytes=4 * 1024 * 1024)
        .select(F.lit(name).alias("table_name"), "*")
        for name in STAT_TABLES
    ])


@query
def file_rows(spark, sf_dir):
    """Rows of tables added up from those of their files."""
    return sets.concat(*[
        stats.file_stats(spark, f"{sf_dir}/{name}.parquet").agg(F.sum("rows").alias("rows"))
        .select(F.lit(name).alias("table_name"), "rows")
        for name in STAT_TABLES
    ])


@query
def table_stat_rows(spark, sf_dir):
    """The part of the table statistics that SQL knows too."""
    return table_stats(spark, sf_dir).select("table_name", "rows")


@query
def table_pages(spark, sf_dir):
    """Rows of tables cut into pages."""
    return sets.concat(*[
        stats.table_pages(testdata.table(spark, sf_dir, name), 1388)
        .select(F.lit(name).alias("table_name"), "*")
        for name in STAT_TABLES
    ])


@query
def where_in_currency(spark, sf_dir):
    lines = testdata.table(spark, sf_dir, "lineitem")
    return tables.where_in(lines, "l_returnflag", testdata.CURRENCIES).select(
        "l_orderkey", "l_partkey", "l_extendedprice", "l_returnflag"
    )


@query
def block_range_filter(spark, sf_dir):
    """Closed numeric range combined with a strict comparison."""
    trades = testdata.trades(spark, sf_dir, parties=False)
    return trades.where(
        F.col("block_number").between(9500, 9800) & (F.col("price_value") > 50000)
    )


# -- joins ----------------------------------------------------------------------------------------

@query
def dated_rates(spark, sf_dir):
    """Blocks and rates on differently named keys; both key columns stay."""
    rates = testdata.rates(spark, sf_dir).withColumnRenamed("date", "date_of_rate")
    joined = joins.join_frames(testdata.ship_blocks(spark, sf_dir), rates, {"date": "date_of_rate"})
    return iso(joined).withColumn("date_of_rate", dates.date_text(F.col("date_of_rate")))


@query
def trades_and_orders(spark, sf_dir):
    """A join whose sides share a column name beside the key."""
    trades = testdata.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS id", f"{testdata.day_number('l_shipdate')} AS block_number"
    )
    orders = testdata.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", f"{testdata.day_number('o_orderdate')} AS block_number"
    )
    return joins.join_frames(trades, orders, "id")


@query
def trades_without_block(spark, sf_dir):
    """Right outer join: trades per block date, with those of unknown blocks under null."""
    blocks = testdata.order_blocks(spark, sf_dir).select("block_number", "date")
    trades = aggregates.group_count(
        testdata.trades(spark, sf_dir, parties=False), ["block_number"], "trades"
    )
    return iso(joins.join_frames(blocks, trades, "block_number", how="right"))


# -- validation and scalar functions ----------------------------------------------------------------

# Parts of page addresses and turns, such that each rule holds for some rows only.

def _page_parts(spark, sf_dir) -> DataFrame:
    return testdata.table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        "regexp_replace(url, '^https://', '') AS url",
        "nullif(regexp_extract(url, '[?]([^#]*)', 1), '') AS parameters",
        "regexp_extract(url, '/([^/]*)$', 1) AS number",
    )


def _turn_parts(spark, sf_dir) -> DataFrame:
    return testdata.table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "role",
        r"nullif(regexp_extract(text, '\\n([^\\n]*)', 1), '') AS second_line",
    )


PAGE_RULES = [quality.url("url"), quality.required_text("parameters"), quality.integer("number")]

TURN_RULES = [
    quality.required_text("second_line"),
    quality.choice("role", ["user", "assistant"], required=True),
]


@query
def validate_pages(spark, sf_dir):
    return quality.violation_counts(_page_parts(spark, sf_dir), PAGE_RULES)


@query
def valid_pages(spark, sf_dir):
    """Addresses that are one and end in a number."""
    rules = [quality.url("url"), quality.integer("number")]
    return quality.valid_rows(_page_parts(spark, sf_dir), rules).select("page_id", "url")


@query
def validate_conversations(spark, sf_dir):
    return quality.violation_counts(_turn_parts(spark, sf_dir), TURN_RULES)


@query
def invalid_turns(spark, sf_dir):
    return quality.invalid_rows(_turn_parts(spark, sf_dir), TURN_RULES).select(
        "conv_id", "turn", "role", "violations"
    )


def _events(spark, sf_dir) -> DataFrame:
    return testdata.table(spark, sf_dir, "events")


@query
def scalar_dates(spark, sf_dir):
    events = _events(spark, sf_dir)
    ts = F.col("ts")
    epoch = F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), ts)
    day = dates.as_date(dates.date_text(ts))
    return events.select(
        "event_id",
        dates.date_text(ts).alias("day"),
        F.date_format(ts, dates.TIMESTAMP_FORMAT).alias("second"),
        dates.epoch_text(epoch).alias("from_epoch"),
        dates.date_text(F.date_sub(day, 7)).alias("week_before"),
        dates.date_text(F.date_add(day, 6)).alias("week_end"),
        (F.datediff(day, dates.as_date("2024-01-01"))).cast("bigint").alias("days_in"),
    )


@query
def scalar_text(spark, sf_dir):
    events = _events(spark, sf_dir)
    number = text.first_integer(F.col("props"))
    return events.select(
        "event_id",
        number.alias("first_number"),
        text.report_line(
            "event %d: %s by user %d", F.col("event_id"), F.col("event_type"), F.col("user_id")
        ).alias("line"),
    )


@query
def scalar_numbers(spark, sf_dir):
    events = _events(spark, sf_dir)
    id_, user = F.col("event_id"), F.col("user_id")
    return events.select(
        "event_id",
        numeric.add(id_, user).alias("added"),
        (F.col("value") * F.col("value")).alias("multiplied"),
        numeric.ratio(id_, user % 3).alias("divided"),
        numeric.floor_div(id_, user % 7).alias("floor_divided"),
        F.try_mod(id_, user % 7).alias("remainder"),
        numeric.page_count(id_, user % 7).alias("pages"),
        numeric.money(numeric.exact(F.col("value"), 4), 1).alias("rounded"),
        (id_ >= user).alias("not_less"),
        ((id_ < 5000) & (user > 10)).alias("both"),
    )
