"""The whole weekly report as one table of figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.numeric import mean, money, ratio
from ledgerlens.operators.sets import concat
from ledgerlens.operators.topk import descending
from ledgerlens.plans import cohorts, leaderboards, totals
from ledgerlens.plans.enrich import malformed_trades
from ledgerlens.plans.views import ALL, TOKEN, WEEK, MarketView, StoredView
from ledgerlens.session import scratch_path

COLUMNS = ("scope", "metric", "rank", "contract_address", "token_id", "label", "value")

#: What a place on a board is worth: metric names of its value and of two more figures.
BOARDS = {
    "collection_volume": ("collection_volume_usd",),
    "collection_trades": ("collection_trades",),
    "collection_price": ("collection_price_avg", "collection_price_max", "collection_price_min"),
    "token_trades": ("token_trades",),
    "token_price": ("token_price_avg", "token_price_max", "token_price_min"),
}


def _cells(df: DataFrame, cells: list[Column]) -> DataFrame:
    """``cells`` (structs of scope, metric and value) of every row as rows of figures without keys."""
    rows = df.select(F.inline(F.array(*cells))).where(F.col("metric").isNotNull())
    return rows.select("scope", "metric", F.lit(None).cast("bigint").alias("rank"),
                       *[F.lit(None).cast("string").alias(c) for c in (*TOKEN, "label")], "value")


def _cell(scope: Column, metric: str | Column, value: Column | str) -> Column:
    metric = F.lit(metric) if isinstance(metric, str) else metric
    value = F.col(value) if isinstance(value, str) else value
    return F.struct(scope.alias("scope"), metric.alias("metric"), value.cast("double").alias("value"))


def _boards(view: StoredView) -> DataFrame:
    """All boards of collections and tokens, ranked in one pass over both rollups."""
    collections, tokens = view.scoped(["contract_address"]), view.scoped(TOKEN)
    no_token = F.lit(None).cast(tokens.schema["token_id"].dataType).alias("token_id")
    price = (mean(F.col("eth"), F.col("eth_prices")), F.col("price_max"), F.col("price_min"))

    def entries(rollup: DataFrame, token: Column, boards: dict[str, tuple[Column, ...]]) -> DataFrame:
        values = [
            F.struct(F.lit(board).alias("board"), *[
                (found[i] if i < len(found) else F.lit(None)).cast("double").alias(f"value_{i}") for i in range(3)])
            for board, found in boards.items()
        ]
        return rollup.select("scope", "contract_address", token, F.col("contract_name").alias("label"),
                             F.inline(F.array(*values)))

    every = entries(collections, no_token, {
        "collection_volume": (money(F.col("usd"), 4),), "collection_trades": (F.col("trades"),), "collection_price": price,
    }).unionByName(entries(tokens, F.col("token_id"), {"token_trades": (F.col("trades"),), "token_price": price}))
    place = Window.partitionBy("scope", "board").orderBy(*descending("value_0", TOKEN))
    ranked = every.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= leaderboards.TOP)
    names = F.create_map(*[F.lit(x) for board, own in BOARDS.items() for x in (
        board, "|".join(own))])
    figures = ranked.withColumn("metrics", F.split(names[F.col("board")], "[|]"))
    return figures.select(
        "scope", F.posexplode("metrics").alias("i", "metric"), F.col("rank").cast("bigint").alias("rank"),
        *[F.col(c).cast("string").alias(c) for c in TOKEN], "label",
        F.array("value_0", "value_1", "value_2").alias("values"),
    ).withColumn("value", F.col("values")[F.col("i")]).select(*COLUMNS)


def _markets(view: StoredView) -> DataFrame:
    """Every venue by volume."""
    measured = view.scoped(["market"]).select("scope", "market", money(F.col("usd")).alias("value"))
    place = Window.partitionBy("scope").orderBy(*descending("value", ["market"]))
    return measured.select(
        "scope", F.lit("market_volume_usd").alias("metric"), F.row_number().over(place).cast("bigint").alias("rank"),
        *[F.lit(None).cast("string").alias(c) for c in TOKEN], F.col("market").alias("label"), "value")


def _extremes(view: StoredView) -> DataFrame:
    return leaderboards.price_extremes(view).selectExpr(
        "scope", "extreme AS metric", "CAST(NULL AS BIGINT) AS rank",
        "CAST(contract_address AS STRING) AS contract_address", "CAST(token_id AS STRING) AS token_id",
        "contract_name AS label", "price AS value",
    )


def _scope_totals(view: StoredView) -> DataFrame:
    """Volumes, counts and means of both scopes, and the collections new in the week, in one aggregate."""
    fresh = (F.col("scope") == ALL) & F.col("first_block").between(view.window.lo, view.window.hi)
    counts = ["collections", "tokens", "trades", "new_collections"]
    figures = totals.every_scope(view, view.scoped(["contract_address"]).groupBy("scope").agg(
        money(F.sum("eth")).alias("volume_eth"), money(F.sum("usd")).alias("volume_usd"),
        F.count(F.lit(1)).alias("collections"), F.sum("tokens").alias("tokens"), F.sum("trades").alias("trades"),
        mean(F.sum("eth"), F.sum("eth_prices")).alias("price_mean"), F.count_if(fresh).alias("new_collections"),
    ), counts)
    scope = F.col("scope")
    # First trades are known for all time; what they tell is a figure of the week.
    new = F.when(scope == ALL, "new_collections")
    return _cells(figures, [
        *[_cell(scope, m, m) for m in ("volume_eth", "volume_usd", "collections", "tokens", "trades", "price_mean")],
        _cell(F.lit(WEEK), new, "new_collections")])


def _caps(view: StoredView) -> DataFrame:
    """Market caps by both weights, from one rollup of what is held."""
    weights = view.held().groupBy("contract_address").agg(
        F.sum("transfers").alias("transfers"), F.count(F.lit(1)).alias("tokens"))
    caps = totals.capped(view, weights, {"": "transfers", "tokens_": "tokens"})
    return _cells(caps, [_cell(F.lit(ALL), c, c) for c in caps.columns])


def _holders(view: StoredView) -> DataFrame:
    """Holders, active traders and what they hold; every address is one row before they meet."""
    held = view.held().groupBy("to_address").agg(
        F.count(F.lit(1)).alias("tokens"), F.sum("transfers").alias("transfers"), F.lit(True).alias("holds"))
    active = cohorts.active_traders(view).withColumn("active", F.lit(True))
    both = held.join(active, F.col("to_address") == F.col("trader"), "full_outer").agg(
        F.count("holds").alias("holders"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("held_tokens"),
        F.coalesce(F.sum("transfers"), F.lit(0)).alias("transfers"), F.count("active").alias("active_traders"),
        F.coalesce(F.sum(F.when(F.col("active"), F.col("tokens"))), F.lit(0)).alias("active_held_tokens"),
    ).withColumns({
        "average_holding": ratio(F.col("held_tokens"), F.col("holders")),
        "active_average_holding": ratio(F.col("active_held_tokens"), F.col("active_traders")),
    })
    return _cells(both, [_cell(F.lit(ALL), c, c) for c in both.columns])


def _row_counts(view: StoredView) -> DataFrame:
    """Figures that count rows of the tables themselves: one aggregate over what each adds."""
    created = F.col("init_block") >= view.window.lo
    nothing = [(WEEK, "transfers"), (ALL, "malformed_trades"), (WEEK, "new_mints"), (WEEK, "new_mints_bounded")]
    spark = view.snapshot.trades.sparkSession

    def counted(df: DataFrame, scope: str, metric: str, n: Column) -> DataFrame:
        return df.select(F.lit(scope).alias("scope"), F.lit(metric).alias("metric"), n.cast("bigint").alias("n"))

    one = F.lit(1)
    rows = concat(
        spark.createDataFrame([(*key, 0) for key in nothing], "scope STRING, metric STRING, n BIGINT"),
        counted(view.transfers_by([], WEEK), WEEK, "transfers", F.col("transfers")),
        counted(malformed_trades(view.snapshot), ALL, "malformed_trades", one),
        counted(view.snapshot.contracts.where(created), WEEK, "new_mints", one),
        counted(view.snapshot.contracts.where(created & (F.col("init_block") <= view.window.hi)),
                WEEK, "new_mints_bounded", one),
    )
    return _cells(rows.groupBy("scope", "metric").agg(F.sum("n").alias("n")),
                  [_cell(F.col("scope"), F.col("metric"), "n")])


def weekly_report(view: MarketView) -> DataFrame:
    """All reports as rows of (scope, metric, rank, keys, label, value).

    Nearly all figures come from stored rollups, see :class:`StoredView`. For a plain
    view they are written first and removed afterwards, also when the report fails;
    what stays is the report itself, some hundred rows in the scratch folder.
    """
    if isinstance(view, StoredView):
        return _report(view)
    with StoredView.store(view) as stored:
        spark = view.snapshot.trades.sparkSession
        path = scratch_path(spark, "report")
        report = _report(stored)
        report.write.parquet(path)
        return spark.read.schema(report.schema).parquet(path)


def _report(view: StoredView) -> DataFrame:
    parts = [_boards, _markets, _extremes, _scope_totals, _caps, _holders, _row_counts]
    return concat(*[part(view) for part in parts]).select(*COLUMNS)
