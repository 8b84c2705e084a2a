"""Command line: ``python -m tamis extract --source PATH [--dry-run]`` or ``python -m tamis daemon``."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import SparkSession

from tamis.config import from_environment, load, merged, properties
from tamis.plans.extraction import extract_source
from tamis.plans.observability import JsonFormatter
from tamis.streaming.daemon import Daemon


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tamis")
    parser.add_argument("--config", action="append", default=["configs/application.json"], help="configuration file; later ones win")
    parser.add_argument("--set", action="append", default=[], metavar="SECTION.KEY=VALUE", help="a single property; wins over files and environment")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("extract", help="one run over a file or folder")
    one.add_argument("--source", "-s", required=True)
    one.add_argument("--dry-run", action="store_true")
    commands.add_parser("daemon", help="watch the inbox and aggregate")
    options = parser.parse_args(args)
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(JsonFormatter())
    logging.getLogger("tamis").addHandler(handler)
    logging.getLogger("tamis").setLevel(logging.INFO)
    spark = SparkSession.builder.appName("tamis").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    chosen = [tuple(p.partition("=")[::2]) for p in options.set]
    config = merged(load(*options.config, overrides=from_environment(os.environ)), properties(chosen))
    try:
        if options.command == "extract":
            print(extract_source(spark, options.source, config, dry_run=options.dry_run))
        else:
            Daemon(spark, config).run()
    except Exception as e:  # noqa: BLE001 - the exit code tells
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
