"""Command line: version, validate-config, run, ingest, describe-output, inspect-tile."""

from __future__ import annotations

import argparse
import json
import logging
import sys
import time

from sunplane.config import Config
from sunplane.schema import OUTPUT, VERSION


class JsonLines(logging.Formatter):
    """One JSON object a record."""

    def format(self, record: logging.LogRecord) -> str:
        row = {"ts": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(record.created)), "level": record.levelname, "logger": record.name, "msg": record.getMessage()}
        if record.exc_info:
            row["exc"] = self.formatException(record.exc_info)
        return json.dumps(row)


def _session(config: Config):
    from pyspark.sql import SparkSession

    return SparkSession.builder.master(config.compute.spark_master).appName("sunplane").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sunplane")
    p.add_argument("-v", "--verbose", action="store_true")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    commands.add_parser("validate-config").add_argument("config")
    run = commands.add_parser("run")
    for name in ("polygons", "footprints", "tiles", "points", "output"):
        run.add_argument(f"--{name}", required=True)
    run.add_argument("--config")
    run.add_argument("--tile-base", default="")
    run.add_argument("--tile-template", default="{name}.las")
    run.add_argument("--tile-name", default="Name")
    run.add_argument("--bbox", type=float, nargs=4, metavar=("X0", "Y0", "X1", "Y1"))
    run.add_argument("--max-polygons", type=int)
    run.add_argument("--run-id")
    run.add_argument("--no-resume", action="store_true")
    run.add_argument("--dry-run", action="store_true")
    ingest = commands.add_parser("ingest")
    ingest.add_argument("las")
    ingest.add_argument("table")
    commands.add_parser("describe-output").add_argument("output", nargs="?")
    commands.add_parser("inspect-tile").add_argument("tile")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    handler = logging.StreamHandler(sys.stdout)
    handler.setFormatter(JsonLines())
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO, handlers=[handler], force=True)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    if args.command == "version":
        print(VERSION)
    elif args.command == "validate-config":
        print(f"ok {Config.from_file(args.config).hash}")
    elif args.command == "inspect-tile":
        from sunplane.sources.las import read_header

        print(json.dumps(read_header(args.tile).__dict__, indent=1))
    elif args.command == "describe-output" and not args.output:
        for f in OUTPUT:
            print(f"{f.name}: {f.dataType.simpleString()}{'' if f.nullable else ' not null'}")
    elif args.command == "describe-output":
        from sunplane.operators.stats import run_stats
        from sunplane.plans.run import existing

        print(json.dumps(run_stats(existing(_session(Config()), args.output)), indent=1, default=str))
    elif args.command == "ingest":
        from sunplane.plans.run import ingest as ingest_files

        ingest_files(_session(Config()), args.las, args.table)
    else:
        from sunplane.plans.run import Inputs, run_pipeline

        config = Config.from_file(args.config) if args.config else Config()
        inputs = Inputs(args.polygons, args.footprints, args.tiles, args.points, args.tile_base, args.tile_template, args.tile_name)
        out = run_pipeline(_session(config), config, inputs, args.output, bbox=args.bbox, max_polygons=args.max_polygons, resume=not args.no_resume, dry_run=args.dry_run, run_id=args.run_id)
        print(json.dumps(out["counts"]))
    return 0
