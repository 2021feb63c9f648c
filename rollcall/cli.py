"""Command line: ``python -m rollcall.cli --inputs PATH... --output DIR``."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import SparkSession

from .config import Config, read_json
from .plans.pipeline import run
from .sinks import write_candidates, write_report_json, write_report_text
from .sources.discover import discover, is_url
from .sources.remote import http

log = logging.getLogger("rollcall")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="rollcall", description="Resolve, merge and score person records.")
    p.add_argument("--inputs", nargs="+", required=True, help="files, folders or URLs")
    p.add_argument("--config", help="output configuration (JSON)")
    p.add_argument("--pipeline-config", help="settings of the run (JSON)")
    p.add_argument("--output", default="output", help="folder for a JSON file per profile; a .json path means the folder output beside it")
    p.add_argument("--report", help="file for the whole report (JSON)")
    p.add_argument("--report-text", help="file for the whole report (text)")
    p.add_argument("--log-level", default="INFO")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    """Exit code: 0, or 1 for a missing input, a broken output configuration or a failed run."""
    args = arguments(argv)
    logging.basicConfig(level=args.log_level.upper(), format="%(levelname)s %(message)s")
    for path in args.inputs:
        if not is_url(path) and "://" not in path and not os.path.exists(path):
            log.error("no such input: %s", path)
            return 1
    output = None
    if args.config and (output := read_json(args.config)) is None:
        log.error("the output configuration can't be read: %s", args.config)
        return 1
    if args.pipeline_config and read_json(args.pipeline_config) is None:
        log.warning("the settings can't be read, defaults are used: %s", args.pipeline_config)
    spark = SparkSession.builder.appName("rollcall").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        result = run(spark, args.inputs, Config.load(args.pipeline_config), output, http)
        sources, read = discover(spark, args.inputs), result.records.select("source_path").distinct()
        for r in sources.join(read, sources.path == read.source_path, "left_anti").orderBy("seq").toLocalIterator():
            log.warning("no records from %s", r["path"])
        folder = os.path.join(os.path.dirname(args.output), "output") if args.output.endswith(".json") else args.output
        write_candidates(result, folder, text=bool(args.report_text))
        if args.report:
            write_report_json(result, args.report)
        if args.report_text:
            write_report_text(result, args.report_text)
        for p in result.profiles.orderBy("cluster_id").selectExpr("full_name", "overall_confidence", "size(emails) e", "size(skills) s").toLocalIterator():
            log.info("%s (confidence=%.2f, emails=%d, skills=%d)", p["full_name"] or "Unknown", p["overall_confidence"], p["e"], p["s"])
    except Exception:
        log.exception("the run failed")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
