"""Weekly report job: ``python -m ledgerlens 2022-12-26 --sources sources.json --output DIR``.

``sources.json`` maps each source table to the fields of ``Source``, for instance
``{"rate_info": {"format": "parquet", "path": "/data/rates"}}``. Connection options
such as user and password of a JDBC source are read from there and nowhere else.
"""

from __future__ import annotations

import argparse
import json

from ledgerlens.functions.dates import as_date
from ledgerlens.operators.joins import BROADCAST_ROWS
from ledgerlens.plans.enrich import with_price_ranges
from ledgerlens.plans.report import weekly_report
from ledgerlens.plans.snapshot import load_snapshot
from ledgerlens.plans.totals import summary_lines
from ledgerlens.plans.views import MarketView, StoredView
from ledgerlens.session import build_session, remove_path
from ledgerlens.sources.sinks import show, write_report
from ledgerlens.sources.tables import Source


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ledgerlens", description="weekly market report")
    parser.add_argument("start", nargs="?", help="first day, ISO; default: the days up to today")
    parser.add_argument("--sources", required=True, help="JSON file naming the five tables")
    parser.add_argument("--output", required=True, help="folder of the finished report")
    parser.add_argument("--format", default="json")
    parser.add_argument("--days", type=int, default=7)
    parser.add_argument("--cutoff", help="active traders sold or bought after this day")
    options = parser.parse_args(argv)

    with open(options.sources, encoding="utf-8") as file:
        sources = {name: Source(**fields) for name, fields in json.load(file).items()}
    spark = build_session("ledgerlens")
    snapshot = load_snapshot(spark, sources)
    if snapshot.calendar_bound > BROADCAST_ROWS:
        snapshot = with_price_ranges(snapshot)
    cutoff = as_date(options.cutoff) if options.cutoff else None
    remote = any(source.format == "jdbc" for source in sources.values())
    market = MarketView(snapshot, options.start, options.days, cutoff, resolve=remote)
    with StoredView.store(market) as view:
        show(summary_lines(view))
        write_report(weekly_report(view), options.output, options.format)
    written = spark.read.format(options.format).load(options.output)
    # The totals and the first places.
    show(written.where("rank IS NULL OR rank = 1").orderBy("scope", "metric"))
    if snapshot.price_ranges:
        remove_path(spark, snapshot.price_ranges.path)


if __name__ == "__main__":
    main()
