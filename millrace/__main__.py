"""python -m millrace run|validate|version|help"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from millrace import __version__


def _session(settings: dict[str, str]):
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").config(map=settings).getOrCreate()


def main(argv: list[str] | None = None) -> int:
    """Exit code 0 if the command succeeded."""
    argv = sys.argv[1:] if argv is None else argv
    parser = argparse.ArgumentParser(prog="millrace", add_help=True)
    parser.add_argument("--version", action="store_true")
    sub = parser.add_subparsers(dest="command")
    run_ = sub.add_parser("run", help="run a pipeline document")
    run_.add_argument("path")
    run_.add_argument("--config", help="settings of the engine and of Spark")
    run_.add_argument("--metrics", help="file for the figures of the run, in the text format of Prometheus")
    run_.add_argument("--run-id", default="", help="go on with the run of this id")
    run_.add_argument("--stream", action="store_true", help="files and responses flow through the steps")
    run_.add_argument("--dry-run", action="store_true", help="only check")
    run_.add_argument("-v", "--verbose", action="count", default=0)
    sub.add_parser("validate", help="check a pipeline document").add_argument("path")
    sub.add_parser("version")
    sub.add_parser("help")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 1
    if args.version or args.command == "version":
        print(__version__)
        return 0
    if args.command == "help":
        parser.print_help()
        return 0
    if args.command is None:
        parser.print_usage()
        return 1
    from millrace.plans.parse import PipelineError, parse_file
    from millrace.plans.validate import validate

    if args.command == "validate":
        try:
            findings = validate(parse_file(args.path))
        except PipelineError as e:
            print(f"pipeline is invalid\n{e}")
            return 1
        bad = any(f.severity == "error" for f in findings)
        print("pipeline is invalid" if bad else "pipeline is valid")
        for f in findings:
            print(f"{f.severity}: {f.field}: {f.message}")
        return int(bad)
    from millrace.plans.config import metrics, read_config, spark_settings, with_defaults
    from millrace.plans.engine import run
    from millrace.plans.stream import run_stream

    try:
        config = read_config(args.config) if args.config else {}
        document = with_defaults(json.loads(Path(args.path).read_text(encoding="utf-8")), config) if config else args.path
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    level = {"trace": "DEBUG", "warn": "WARNING"}.get(config.get("engine", {}).get("log_level", "warn"), config.get("engine", {}).get("log_level", "warn").upper())
    logging.basicConfig(level=logging.DEBUG if args.verbose > 1 else logging.INFO if args.verbose else level)
    more = {"dag_run_id": args.run_id} if args.run_id else {}
    if state := config.get("request_queue", {}).get("db_path"):
        more["state_dir"] = state
    spark = None if args.dry_run else _session(spark_settings(config))
    report = run_stream(spark, document, **more) if args.stream and not args.dry_run else run(spark, document, dry_run=args.dry_run, **more)
    if args.metrics:
        Path(args.metrics).write_text(metrics(report), encoding="utf-8")
    for w in report.warnings:
        print(f"warning: {w}")
    print(f"requests: {report.total_requests} total, {report.successes} ok, {report.failures} failed, {report.retries} retried, {report.skipped} skipped")
    for step, path in report.outputs.items():
        print(f"{step}: {path}")
    print(f"elapsed: {report.elapsed_sec:.1f} s")
    if report.error_message:
        print(f"error: {report.error_message}", file=sys.stderr)
    return 0 if report.success else 1


if __name__ == "__main__":
    sys.exit(main())
