from __future__ import annotations

from market import Market

from ledgerlens.plans import enrich
from ledgerlens.schemas import TRADES
from ledgerlens.streaming import ingest


def bag(df, columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=repr)


def test_incremental_ingest_equals_one_batch(spark, tmp_path):
    market = Market(4)
    snapshot = market.snapshot(spark)
    calendar = enrich.price_calendar(snapshot)
    expected = enrich.with_usd_price(snapshot.trades, calendar)
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    first = snapshot.trades.where("block_number IS NULL OR block_number < 160")
    second = snapshot.trades.where("block_number >= 160")

    first.repartition(5).write.parquet(source)
    stream = ingest.trade_stream(spark, source, TRADES, files_per_batch=2)
    query = ingest.append_trades(stream, calendar, out, progress)
    query.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 3

    # New files arrive: a rerun takes only those.
    second.repartition(2).write.mode("append").parquet(source)
    done = ingest.ingest(ingest.trade_stream(spark, source, TRADES), calendar, out, progress)
    assert bag(done, expected.columns) == bag(expected, expected.columns)

    # Nothing new: nothing is appended.
    again = ingest.ingest(ingest.trade_stream(spark, source, TRADES), calendar, out, progress)
    assert again.count() == expected.count()


def test_nothing_to_ingest(spark, tmp_path):
    snapshot = Market(4).snapshot(spark)
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    snapshot.trades.limit(0).write.parquet(source)
    stream = ingest.trade_stream(spark, source, TRADES)
    done = ingest.ingest(stream, enrich.price_calendar(snapshot), out, progress)
    assert done.count() == 0 and "price_usd" in done.columns


def test_trades_wait_for_their_block_and_rate(spark, tmp_path):
    market = Market(7)
    snapshot = market.snapshot(spark)
    whole = enrich.price_calendar(snapshot)
    early = whole.where("block_number < 150 AND block_number % 2 = 0")
    expected = enrich.with_usd_price(snapshot.trades, whole)
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    snapshot.trades.where("token_id < 2").write.parquet(source)

    def run(calendar):
        stream = ingest.trade_stream(spark, source, TRADES)
        done = ingest.ingest(stream, calendar, out, progress)
        return bag(done, expected.columns), ingest.pending(stream, calendar, out).count()

    first, waiting = run(early)
    assert first == bag(enrich.with_usd_price(
        snapshot.trades.where("token_id < 2"), early), expected.columns) and waiting
    # Blocks and rates arrive, and more trades.
    snapshot.trades.where("token_id >= 2").write.mode("append").parquet(source)
    second, waiting = run(whole)
    assert second == bag(expected, expected.columns)
    assert waiting == snapshot.trades.count() - expected.count()


def test_registered_query_takes_several_batches(spark):
    from checks.queries import QUERIES

    assert QUERIES["stream_enrich"](spark, "/root/testdata/sf0.001").count() > 0


def test_pages_equal_the_whole_scan(spark):
    market = Market(5)
    snapshot = market.snapshot(spark)
    whole = enrich.with_usd_price(enrich.eth_trades(snapshot), enrich.price_calendar(snapshot))
    for bounds in ([], [150], [110, 150, 150, 190]):
        paged = enrich.paged_trades(snapshot, bounds)
        assert bag(paged, whole.columns) == bag(whole, whole.columns)
        edges = [None, *sorted(set(bounds)), None]
        for n, (lo, hi) in enumerate(zip(edges, edges[1:])):
            page = enrich.trade_page(snapshot, lo, hi)
            assert bag(page, whole.columns) == bag(paged.where(f"page = {n}"), whole.columns)


def test_latest_samples(spark):
    market = Market(6)
    snapshot = market.snapshot(spark)
    date_of = {b[0]: b[2] for b in market.blocks}
    for k in (3, 40, 10_000):
        dated = sorted(
            ((date_of[t[1]], t[1]) for t in market.trades if t[1] in date_of), reverse=True
        )[:k]
        got = [(r.date, r.block_number) for r in enrich.latest_blocks(snapshot, k).collect()]
        assert got == dated

        # Trades without a block first, then by date; within one block by the other columns.
        def place(t):
            day = date_of.get(t[1])
            rest = [(v is not None, v if v is not None else "") for v in (t[0], *t[2:])]
            return ((day is not None, -day.toordinal() if day else 0),
                    (t[1] is not None, -(t[1] or 0)), rest)

        expected = sorted(market.trades, key=place)[:k]
        got = [tuple(r) for r in enrich.latest_trades(snapshot, k).collect()]
        assert got == expected
