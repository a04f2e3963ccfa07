"""Jobs for spark-submit.

    spark-submit -m tramwise export --base <tables> --out <folder>
    spark-submit -m tramwise report <name> --base <tables> [--set days=7 ...]
    spark-submit -m tramwise import --feed <json> --lines <json> --base <tables>
    spark-submit -m tramwise load --landed <folder> --tables trips ... --base <tables>
    spark-submit -m tramwise cards --base <tables>
    spark-submit -m tramwise maintain --base <tables>
"""

from __future__ import annotations

import argparse
import ast
from datetime import datetime

from pyspark.sql import SparkSession

from .operators.ingest import feed_rejects
from .plans.export import export_pack
from .plans.importer import load_network
from .plans.load import landed, with_card_statistics
from .plans.refresh import current, maintain, refresh
from .plans.reports import REPORTS, Transit, to_records
from .schema import LAYOUTS
from .session import configure
from .sources import feed, seed


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tramwise")
    jobs = top.add_subparsers(dest="job", required=True)
    export = jobs.add_parser("export", help="write the export pack")
    export.add_argument("--out", required=True)
    export.add_argument("--sorted", action="store_true")
    report = jobs.add_parser("report", help="print the first rows of a report")
    report.add_argument("name", choices=sorted(REPORTS))
    report.add_argument("--limit", type=int, default=20)
    report.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    load = jobs.add_parser("import", help="load stations, routes and timetable")
    load.add_argument("--feed", required=True)
    load.add_argument("--lines", required=True)
    load.add_argument("--sample", type=int, metavar="STATIONS_PER_BOROUGH")
    facts = jobs.add_parser("load", help="load landed tables")
    facts.add_argument("--landed", required=True)
    facts.add_argument("--tables", nargs="+", required=True, choices=sorted(LAYOUTS))
    facts.add_argument("--form", choices=("parquet", "json"), default="parquet")
    facts.add_argument("--append", action="store_true", help="keep the rows stored before")
    cards = jobs.add_parser("cards", help="write card statistics from the trips")
    upkeep = jobs.add_parser("maintain", help="store partial sums of new snapshots")
    for job in (export, report, load, facts, cards, upkeep):
        job.add_argument("--base", required=True, help="folder of the stored tables")
        job.add_argument("--as-of", type=datetime.fromisoformat, default=None)
    return top


def _value(text: str):
    """Numbers, booleans and lists as Python writes them; else plain text."""
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def run(spark: SparkSession, arguments: list[str] | None = None) -> None:
    given = parser().parse_args(arguments)
    if given.job == "export":
        tables = current(spark, given.base)
        manifest = export_pack(tables, given.out, given.as_of, sort=given.sorted)
        for entry in to_records(manifest):
            print(f"{entry['rows']:>12} {entry['path']}")
    elif given.job == "report":
        params = {k: _value(v) for k, v in (pair.split("=", 1) for pair in given.set)}
        if given.as_of is not None:
            params["as_of"] = given.as_of
        transit = Transit(current(spark, given.base))
        shown = transit.records(given.name, given.limit + 1, **params)
        for record in shown[: given.limit]:
            print(record)
        if len(shown) > given.limit:
            print(f"... only the first {given.limit} rows; --limit shows more")
    elif given.job == "import":
        raw = feed.read_feed(spark, given.feed)
        load_network(
            raw,
            feed.read_stop_lists(spark, given.lines),
            seed.borough_zones(spark),
            given.base,
            _stamp(given),
            sample=given.sample,
        )
        _print_sizes(spark, given)
        print(f"{feed_rejects(raw).count():>12} rows of the feed were rejected")
    elif given.job == "load":
        tables = landed(spark, given.landed, given.tables, given.form)
        refresh(tables, given.base, _stamp(given), append=given.tables if given.append else ())
        _print_sizes(spark, given)
    elif given.job == "maintain":
        for entry in maintain(spark, given.base):
            print(entry)
    else:
        maintain(spark, given.base, ["card_counts"])
        refresh(with_card_statistics(current(spark, given.base)), given.base, _stamp(given))
        _print_sizes(spark, given)


def _stamp(given: argparse.Namespace) -> str:
    return (given.as_of or datetime.now()).strftime("%Y%m%d_%H%M%S")


def _print_sizes(spark: SparkSession, given: argparse.Namespace) -> None:
    """The sizes of all tables that are stored now."""
    stored = Transit(current(spark, given.base))
    for entry in stored.records("volume_summary"):
        print(f"{entry['n']:>12} {entry['table_name']}")


def main() -> None:
    spark = configure(SparkSession.builder.appName("tramwise").getOrCreate())
    run(spark)
    spark.stop()


if __name__ == "__main__":
    main()
