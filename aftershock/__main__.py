"""Build all marts, checks and reports from stored base tables, and export the report frames.

``python -m aftershock <root> --database marts --csv <folder>``, or through spark-submit.
"""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import functions as F

from aftershock.functions.calendar import within
from aftershock.pipeline import build_checks, build_marts, build_reports, exports_of, save_tables
from aftershock.session import build_session
from aftershock.sinks.write import export_csv, save_bucketed
from aftershock.sources.star import Star, read_star
from aftershock.specs import INCIDENT_PHASES, CohortSpec, PhaseSpec, Span, cohort_of

LINKED_FACTS = ("fact_orders", "fact_delivery_performance", "fact_ratings")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="aftershock", description=__doc__.splitlines()[0])
    day = {"type": date.fromisoformat}
    span = {**day, "nargs": 2, "metavar": ("START", "END")}
    parser.add_argument("root", help="folder with one Parquet table per base table")
    parser.add_argument("--database", help="database of the marts; the current one by default")
    parser.add_argument("--csv", help="folder for the report exports, a file <name>.csv each")
    parser.add_argument("--csv-parts", action="store_true", help="export folders of part files instead")
    parser.add_argument("--normalized", action="store_true", help="the tables were stored by save_star")
    parser.add_argument("--buckets", type=int, help="store orders, deliveries and ratings bucketed by order first")
    parser.add_argument("--crisis-start", **day, default=INCIDENT_PHASES.crisis_start)
    parser.add_argument("--post-start", **day, default=INCIDENT_PHASES.post_start)
    parser.add_argument("--cohort", **span, help="default: the month before the crisis")
    parser.add_argument("--experience", **span, help="default: the crisis")
    parser.add_argument("--outcome", **span, help="default: the month after the crisis")
    parser.add_argument("--cohort-name", help="default: the first day of the cohort")
    options = parser.parse_args(arguments)

    spark = build_session()
    star = read_star(spark, options.root, normalized=options.normalized)
    phases = PhaseSpec(options.crisis_start, options.post_start)
    derived = cohort_of(phases)
    windows = {w: Span(*getattr(options, w)) if getattr(options, w) else getattr(derived, w) for w in ("cohort", "experience", "outcome")}
    cohort = CohortSpec(options.cohort_name or windows["cohort"].start.isoformat(), **windows)
    if options.csv and star.fact_orders.filter(within(F.col("order_timestamp"), cohort.cohort)).isEmpty():
        parser.error(f"no orders from {cohort.cohort.start} to {cohort.cohort.end}: the cohort to export is empty")

    prefix = f"{quoted(options.database)}." if options.database else ""
    if options.database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(options.database)}")
    if options.buckets:
        star = bucketed(star, prefix, options.buckets)
    save = save_tables(quoted(options.database) if options.database else None)
    marts = build_marts(star, phases, save)
    checks = build_checks(star, marts, save)
    for row in checks["grain_report"].filter("repeated_keys > 0").collect():
        print(f"{row.table_name}: {row.repeated_keys} values of {row.grain} occur more than once")
    reports = build_reports(star, phases, cohort, marts["linked_days"], save)
    if options.csv:
        export_csv(exports_of(reports), options.csv, single=not options.csv_parts)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def bucketed(star: Star, prefix: str, buckets: int) -> Star:
    """The star with the facts that are linked by order stored in buckets of the order id."""
    stored = {n: save_bucketed(getattr(star, n), f"{prefix}bucketed_{n}", "order_id", buckets) for n in LINKED_FACTS}
    return Star(lambda name: stored[name] if name in stored else getattr(star, name))


if __name__ == "__main__":
    main()
