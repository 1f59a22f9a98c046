"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores and ``BENCH_QUERIES``
(comma-separated, optional) a subset. Every query runs once untimed in a shared
session, then ``BENCH_RUNS`` times; the median counts. Results are fully computed
and thrown away, nothing is cached between runs.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from checks.queries import QUERIES
from ledgerlens.session import build_session

HEADLINE = [
    "enrich_trades", "week_trades",
    "volume_collections_week", "volume_collections_all",
    "volume_markets_week", "volume_markets_all",
    "trades_collections_week", "trades_collections_all", "trades_tokens_all",
    "price_stats_collections_all", "price_stats_tokens_week", "price_stats_tokens_all",
    "price_extremes", "token_max_all_columns",
    "market_cap", "market_cap_tokens", "volume_totals", "contributors",
    "transfer_totals", "trade_totals", "market_mean",
    "new_collections", "new_mints", "holders", "holder_summary",
    "active_traders", "active_holding",
    "latest_blocks_inner", "latest_trades_right", "page_at_offset",
    "chunked_enrich", "stream_enrich",
    "validate_pages", "validate_conversations", "scalar_dates", "scalar_text",
    "weekly_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(runs)), 4)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
