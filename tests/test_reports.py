"""Every report against plain Python on small irregular markets."""

from __future__ import annotations

import datetime

import pytest
from market import START, Market, average, total

from ledgerlens.plans import cohorts, enrich, leaderboards, totals
from ledgerlens.plans.report import weekly_report
from ledgerlens.plans.rollups import HoldingStore, RolledView, TradeStore
from ledgerlens.plans.views import MarketView, StoredView
from ledgerlens.schemas import CURRENCIES

SCOPES = ("week", "all")


@pytest.fixture(scope="module")
def market():
    return Market(1)


@pytest.fixture(scope="module", params=["direct", "resolved", "stored", "rolled"])
def view(request, spark, market, tmp_path_factory):
    view = MarketView(market.snapshot(spark), START, resolve=request.param == "resolved")
    if request.param == "rolled":
        base = str(tmp_path_factory.mktemp("rolled"))
        stores = TradeStore(spark, base + "/trades", view.snapshot), HoldingStore(spark, base + "/holdings", view.snapshot)
        for store in stores:
            store.cover(view.snapshot, upto=130)
        return RolledView(view, *stores)
    return StoredView.store(view) if request.param == "stored" else view


def rows(df):
    return [tuple(row) for row in df.collect()]


def close(value):
    return pytest.approx(value, rel=1e-9, abs=1e-15)


def null_first(value):
    """Sort key of a descending metric with nulls first."""
    return (value is not None, -(value or 0))


def text_first(value):
    return (value is not None, value or "")


def test_enriched_trades(spark, market):
    got = enrich.enriched_trades(market.snapshot(spark)).select(
        "block_number", "contract_address", "token_id", "seller", "buyer", "market",
        "contract_name", "price_value", "price_usd",
    )
    expected = [tuple(t[k] for k in ("block", "contract", "token", "seller", "buyer", "market",
                                     "name", "price", "usd")) for t in market.enriched()]
    assert sorted(rows(got), key=repr) == sorted(expected, key=repr)


def test_week_window(view, market):
    assert rows(view.window.frame()) == [market.window()]


@pytest.mark.parametrize("scope", SCOPES)
def test_collection_volume(view, market, scope):
    groups = market.grouped(scope, "contract", "name")
    expected = [(c, n, total(t["usd"] for t in ts)) for (c, n), ts in groups.items()]
    expected.sort(key=lambda r: (null_first(r[2]), r[0]))
    got = rows(leaderboards.collection_volume(view, scope))
    assert [r[:2] for r in got] == [r[:2] for r in expected[:10]]
    for a, b in zip(got, expected):
        assert a[2] == (None if b[2] is None else pytest.approx(b[2], abs=1e-4))


@pytest.mark.parametrize("scope", SCOPES)
def test_market_volume(view, market, scope):
    groups = market.grouped(scope, "market")
    got = dict(rows(leaderboards.market_volume(view, scope)))
    assert got == {
        m: pytest.approx(total(t["usd"] for t in ts), abs=0.01) for (m,), ts in groups.items()
    }


@pytest.mark.parametrize("scope", SCOPES)
def test_trade_counts(view, market, scope):
    groups = market.grouped(scope, "contract", "name")
    expected = sorted(((c, n, len(ts)) for (c, n), ts in groups.items()),
                      key=lambda r: (-r[2], r[0]))
    assert rows(leaderboards.collection_trades(view, scope)) == expected[:10]
    groups = market.grouped(scope, "contract", "token", "name")
    expected = sorted(((c, k, n, len(ts)) for (c, k, n), ts in groups.items()),
                      key=lambda r: (-r[3], r[0], r[1]))
    assert rows(leaderboards.token_trades(view, scope)) == expected[:10]


@pytest.mark.parametrize("scope", SCOPES)
@pytest.mark.parametrize("level", ["collection", "token"])
def test_price_stats(view, market, scope, level):
    keys = ("contract",) if level == "collection" else ("contract", "token")
    report = leaderboards.collection_prices if level == "collection" else leaderboards.token_prices
    expected = []
    for key, ts in market.grouped(scope, *keys, "name").items():
        prices = [t["price"] for t in ts if t["price"] is not None]
        expected.append((*key, average(prices), max(prices, default=None),
                         min(prices, default=None), len(ts)))
    n = len(keys) + 1
    got = rows(report(view, scope, k=None))
    assert len(got) == len(expected)
    by_key = {r[:n]: r[n:] for r in expected}
    for row in got:
        mean, top, low, count = by_key[row[:n]]
        assert row[n + 1:] == (top, low, count)
        assert row[n] == (None if mean is None else close(mean))
    order = [(null_first(r[n]), r[:n - 1]) for r in got]
    assert order == sorted(order)
    assert rows(report(view, scope)) == got[:10]


@pytest.mark.parametrize("scope", SCOPES)
def test_price_extremes(view, market, scope):
    tokens = []
    for key, ts in market.grouped(scope, "contract", "token", "name").items():
        prices = [t["price"] for t in ts if t["price"] is not None]
        tokens.append((key, max(prices, default=None), average(prices)))

    def ranked(i):
        return sorted(tokens, key=lambda t: (null_first(t[i]), t[0][:2]))

    positive = [t for t in ranked(1) if (t[1] or 0) > 0]
    picks = {"highest_max": (ranked(1)[0], 1), "lowest_max": (positive[-1], 1),
             "highest_avg": (ranked(2)[0], 2), "lowest_avg": (ranked(2)[-1], 2)}
    got = [r for r in rows(leaderboards.price_extremes(view)) if r[0] == scope]
    assert {r[1] for r in got} == set(picks)
    for row in got:
        token, i = picks[row[1]]
        assert row[0] == scope and row[2:5] == token[0]
        assert row[5] == (None if token[i] is None else close(token[i]))


def test_market_cap(view, market):
    prices = {c: (average(t["price"] for t in ts), average(t["usd"] for t in ts))
              for (c,), ts in market.grouped("all", "contract").items()}
    moved = [(t[1], t[4]) for t in market.transfers]
    for weight, items in (("transfers", moved), ("tokens", set(moved))):
        eth = total(prices[c][0] for c, _ in items if c in prices)
        usd = total(prices[c][1] for c, _ in items if c in prices)
        assert rows(totals.market_cap(view, weight)) == [
            (pytest.approx(eth, abs=0.01), pytest.approx(usd, abs=0.01))
        ]
    with pytest.raises(ValueError):
        totals.market_cap(view, "volume")


def test_totals(view, market):
    lo, hi = market.window()
    for scope in SCOPES:
        trades = market.enriched(scope)
        moved = [t for t in market.transfers
                 if scope == "all" or (t[5] is not None and lo <= t[5] <= hi)]
        volume = {r[0]: r[1:] for r in rows(totals.volume_totals(view))}[scope]
        assert volume == (
            pytest.approx(total(t["price"] for t in trades), abs=0.01),
            pytest.approx(total(t["usd"] for t in trades), abs=0.01),
            len({t["contract"] for t in trades}),
        )
        assert (scope, len({t["contract"] for t in trades}),
                len({(t["contract"], t["token"]) for t in trades})) in rows(totals.contributors(view))
        assert (scope, len(trades)) in rows(totals.trade_totals(view))
        assert (scope, len(moved)) in rows(totals.transfer_totals(view))
        means = {r[0]: r[1:] for r in rows(totals.market_mean(view))}[scope]
        assert means == (
            close(average(t["price"] for t in trades)),
            pytest.approx(total(t["price"] for t in trades), abs=0.01),
        )


def test_summary_lines(view, market):
    lines = [r[0] for r in rows(totals.summary_lines(view))]
    moved = len(market.transfers)
    assert f"all: {moved} transfers" in lines
    assert any(line.startswith("week: traded ") for line in lines)
    assert any(line.startswith("all: market cap ") for line in lines)
    trades, week = market.enriched(), market.enriched("week")
    assert f"all: {len(trades)} trades" in lines and f"week: {len(week)} trades" in lines
    assert f"week: {len({(t['contract'], t['token']) for t in week})} tokens traded" in lines
    assert f"all: {len(market.active_traders(START))} active traders" in lines
    assert f"week: {cohorts.new_collections(view).count()} new collections" in lines
    assert f"week: {cohorts.new_mints(view).count()} collections minted" in lines
    assert any(line.startswith("all: mean price ") for line in lines)
    holders = len({to for to, _ in market.holders().values()})
    assert any(line.startswith(f"all: {holders} holders with ") for line in lines)
    assert len(lines) == 15


def test_new_collections(view, market):
    lo, _ = market.window()
    before = {t["contract"] for t in market.enriched() if t["block"] < lo}
    week = {t["contract"] for t in market.enriched("week")}
    assert {r[0] for r in rows(cohorts.new_collections(view))} == week - before


def test_new_mints(view, market):
    lo, hi = market.window()
    born = {c[0]: c[4] for c in market.contracts}
    assert {r[0] for r in rows(cohorts.new_mints(view))} == {c for c, b in born.items() if b >= lo}
    assert {r[0] for r in rows(cohorts.new_mints(view, bounded=True))} == {
        c for c, b in born.items() if lo <= b <= hi
    }


def test_holders(view, market):
    expected = market.holders()
    got = {r[:2]: r[2:] for r in rows(view.holders())}
    assert got == expected
    held_by = {receiver for receiver, _ in expected.values()}
    assert None in held_by  # an unknown holder counts once
    assert rows(cohorts.holder_summary(view)) == [
        (len(held_by), len(expected), close(len(expected) / len(held_by)))
    ]


def test_active_traders(view, market):
    expected = market.active_traders(START)
    assert {r[0] for r in rows(cohorts.active_traders(view))} == expected
    held = sum(receiver in expected - {None} for receiver, _ in market.holders().values())
    assert rows(cohorts.active_holding(view)) == [
        (len(expected), held, close(held / len(expected)))
    ]


def test_cutoff_is_a_parameter(spark, market):
    cutoff = START - datetime.timedelta(5)
    view = MarketView(market.snapshot(spark), START, cutoff=cutoff)
    assert {r[0] for r in rows(cohorts.active_traders(view))} == market.active_traders(cutoff)


def test_row_order_and_partitioning_do_not_matter(spark, market):
    def report(snapshot):
        return sorted(rows(weekly_report(MarketView(snapshot, START))), key=repr)

    assert report(market.snapshot(spark)) == report(market.snapshot(spark, partitions=7))


def test_broadcast_bound_does_not_change_results(spark, market):
    hinted = market.snapshot(spark, block_bound=100, rate_bound=100, rates_per_day=1)
    plain = market.snapshot(spark)
    assert sorted(rows(enrich.enriched_trades(hinted)), key=repr) == sorted(
        rows(enrich.enriched_trades(plain)), key=repr
    )


def test_window_of_all_dates_is_everything(spark, market):
    view = MarketView(market.snapshot(spark), "2022-01-01", days=730)
    assert sorted(rows(view.enriched("week")), key=repr) == sorted(rows(view.enriched()), key=repr)


def test_volumes_add_up(view):
    boards = leaderboards.collection_volume(view, "all", k=None).collect()
    whole = {r.scope: r.volume_usd for r in totals.volume_totals(view).collect()}["all"]
    assert sum(r.price_usd for r in boards if r.price_usd is not None) == pytest.approx(whole, abs=0.01)


@pytest.mark.parametrize("resolve", [False, True])
def test_empty_window(spark, market, resolve):
    view = MarketView(market.snapshot(spark), "2030-01-01", resolve=resolve)
    assert rows(view.window.frame()) == [(None, None)]
    assert view.enriched("week").count() == 0
    assert rows(leaderboards.collection_volume(view, "week")) == []
    assert [r for r in rows(leaderboards.price_extremes(view)) if r[0] == "week"] == []
    assert ("week", 0) in rows(totals.trade_totals(view))
    assert ("week", None, None, 0) in rows(totals.volume_totals(view))
    assert cohorts.new_collections(view).count() == 0
    assert rows(cohorts.active_holding(view)) == [(0, 0, None)]


def test_no_transfers(spark, market):
    empty = Market(1, trades=0)
    view = MarketView(empty.snapshot(spark), START)
    assert rows(cohorts.holder_summary(view)) == [(0, 0, None)]
    assert rows(totals.market_cap(view)) == [(None, None)]


def test_default_window_is_the_days_up_to_today(spark):
    today = datetime.datetime.now(datetime.timezone.utc).date()
    days = [(i, today - datetime.timedelta(20 - i)) for i in range(25)]
    blocks = spark.createDataFrame(days, "block_number BIGINT, date DATE")
    from ledgerlens.operators.windows import BlockWindow
    assert rows(BlockWindow(blocks, days=8).frame()) == [(13, 20)]


def test_report_lists_every_venue(spark, market):
    many = Market(8)
    many.trades = [(*t[:8], f"venue{i % 12}") for i, t in enumerate(many.trades)]
    report = weekly_report(MarketView(many.snapshot(spark), START))
    listed = report.where("scope = 'all' AND metric = 'market_volume_usd'").collect()
    assert sorted(r.label for r in listed) == sorted({t["market"] for t in many.enriched()})
    assert len(listed) == 12 and sorted(r.rank for r in listed) == list(range(1, 13))


def test_malformed_prices_are_set_apart_and_counted(spark, market):
    other = Market(1)
    bad = [float("nan"), float("inf"), -float("inf"), 1e13]
    template = next(t for t in other.trades if t[6] == CURRENCIES[0])
    other.trades += [(*template[:7], price, template[8]) for price in bad]
    view = MarketView(other.snapshot(spark), START)
    same = MarketView(market.snapshot(spark), START)
    assert enrich.malformed_trades(view.snapshot).count() == len(bad)
    assert rows(totals.volume_totals(view)) == rows(totals.volume_totals(same))
    counted = weekly_report(view).where("metric = 'malformed_trades'").collect()
    assert [r.value for r in counted] == [len(bad)]


def test_report_leaves_no_rollups(spark, market, tmp_path, monkeypatch):
    for module in ("views", "report"):
        monkeypatch.setattr(
            f"ledgerlens.plans.{module}.scratch_path", lambda _, label: str(tmp_path / label))

    class Broken(MarketView):
        def transfers(self, scope="all"):
            raise RuntimeError("no transfers")

    with pytest.raises(RuntimeError):
        weekly_report(Broken(market.snapshot(spark), START))
    assert list(tmp_path.iterdir()) == []
    report = weekly_report(MarketView(market.snapshot(spark), START))
    assert report.count() > 50
    assert [p.name for p in tmp_path.iterdir()] == ["report"]
