"""python -m rowfeed.cli copy|attach|show|throughput: the tools on the command line."""

from __future__ import annotations

import argparse
import importlib
import json
import time
from collections.abc import Sequence

from pyspark.sql import SparkSession

from rowfeed.sinks import writer
from rowfeed.sources.scan import Scan


def session(args: argparse.Namespace) -> SparkSession:
    builder = SparkSession.builder.appName("rowfeed")
    if args.master:
        builder = builder.master(args.master)
    for pair in args.conf or []:
        key, _, value = pair.partition("=")
        if not value:
            raise SystemExit(f"--conf {pair}: key=value is needed")
        builder = builder.config(key, value)
    return builder.getOrCreate()


def throughput(spark: SparkSession, scan: Scan, warmup: int, measured: int) -> dict[str, float]:
    """Decoded rows a second of a scan that is read again and again, after some rows to warm up."""
    rows = scan.where(num_epochs=None).decoded(spark, scan.schema(spark))
    for _ in range(warmup):
        next(rows)
    began = time.perf_counter()
    for _ in range(measured):
        next(rows)
    took = time.perf_counter() - began
    rows.close()
    return {"samples": measured, "seconds": took, "samples_per_second": measured / took}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rowfeed", description=__doc__)
    p.add_argument("--master")
    p.add_argument("--conf", action="append", metavar="KEY=VALUE")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("copy", help="copy columns by pattern and rows without nulls")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--fields", nargs="+")
    c.add_argument("--not-null", nargs="+", default=[])
    c.add_argument("--overwrite", action="store_true")
    c.add_argument("--files", type=int)
    c.add_argument("--row-group-mb", type=float)
    a = sub.add_parser("attach", help="declare the schema of a dataset")
    a.add_argument("path")
    a.add_argument("schema", help="module:attribute of a Schema")
    s = sub.add_parser("show", help="print the schema and indexes of a dataset")
    s.add_argument("path")
    s.add_argument("--no-schema", action="store_true")
    s.add_argument("--no-index", action="store_true")
    s.add_argument("--values", action="store_true")
    t = sub.add_parser("throughput", help="measure rows a second")
    t.add_argument("path")
    t.add_argument("--fields", nargs="+")
    t.add_argument("--warmup", type=int, default=200)
    t.add_argument("--measured", type=int, default=1000)
    return p


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session(args)
    if args.command == "copy":
        writer.copy(spark, args.source, args.target, args.fields, args.not_null, args.overwrite, args.files, args.row_group_mb)
    elif args.command == "attach":
        module, _, name = args.schema.partition(":")
        writer.attach(spark, args.path, getattr(importlib.import_module(module), name))
    elif args.command == "show":
        print(writer.describe(spark, args.path, not args.no_schema, not args.no_index, args.values))
    else:
        print(json.dumps(throughput(spark, Scan(args.path, args.fields), args.warmup, args.measured)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
