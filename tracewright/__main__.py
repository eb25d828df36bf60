"""python -m tracewright SOURCE [TARGET] [-f FORMAT] [-r] [-e EXTENSION]: convert logs; exit 1 if a file failed or none was found."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tracewright.sources.writers import convert


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tracewright", description="Convert event logs to CSV, JSON, JSON lines or XML.")
    p.add_argument("source", nargs="?")
    p.add_argument("target", nargs="?")
    p.add_argument("-i", "--input", dest="input")
    p.add_argument("-o", "--output", dest="output")
    p.add_argument("-f", "--format", default="csv")
    p.add_argument("-r", "--recursive", action="store_true")
    p.add_argument("-e", "--extension", default=".evtx")
    a = p.parse_args(argv)
    source = a.input or a.source
    if not source:
        p.error("no source")
    spark = SparkSession.builder.appName("tracewright").getOrCreate()
    rows = convert(spark, source, a.output or a.target, a.format, a.recursive, a.extension).collect()
    for r in rows:
        print(f"{'ok' if r['ok'] else 'FAILED'} {r['source']} -> {r['target']} ({r['rows']} rows){'' if r['ok'] else ': ' + r['error']}")
    return 0 if rows and all(r["ok"] for r in rows) else 1


if __name__ == "__main__":
    sys.exit(main())
