"""DataFrames to files: CSV, JSON lines, a JSON array, event XML, and batch conversion."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import payload
from tracewright.functions.text import html_escape
from tracewright.operators.records import clean, from_json_events
from tracewright.operators.views import converter_order
from tracewright.schema import CANONICAL
from tracewright.sources.readers import find_files, raw_events, read_any, read_evtx, read_many

FORMATS = {"csv": ".csv", "json": ".json", "jsonl": ".jsonl", "xml": ".xml"}
# Fixed value: name space of event XML.
NAMESPACE = "http://schemas.microsoft.com/win/2004/08/events/event"


def output_path(source: str, target: str | None, kind: str) -> str:
    """Where a converted file goes: ``target`` itself if it has an extension, else the source's name in that folder; an unknown format is csv."""
    ext = FORMATS.get(kind.lower(), ".csv")
    name = os.path.splitext(os.path.basename(source))[0] + ext
    if not target:
        return os.path.join(os.path.dirname(source), name)
    return target if os.path.splitext(target)[1] else os.path.join(target, name)


def event_xml(have: list[str]) -> Column:
    """One ``Event`` element of a row with (cleaned) canonical columns."""
    v = lambda n: F.coalesce(F.col(n), F.lit("")) if n in have else F.lit("")
    e = lambda n: html_escape(v(n))

    def tag(name: str, content: Column) -> Column:
        return F.concat(F.lit(f"    <{name}>"), content, F.lit(f"</{name}>\n"))

    pairs = F.transform(F.map_entries(payload.as_map(v("EventData"))), lambda x: F.concat(F.lit('    <Data Name="'), html_escape(x["key"]), F.lit('">'), html_escape(F.coalesce(x["value"], F.lit(""))), F.lit("</Data>")))
    bare = F.transform(F.map_values(payload.as_map(v("EventData"))), lambda x: F.concat(F.lit("    <Data>"), html_escape(F.coalesce(x, F.lit(""))), F.lit("</Data>")))
    body = F.array_join(F.when(F.startswith(F.trim(v("EventData")), F.lit("{")), pairs).otherwise(bare), "\n")
    data = F.when(v("EventData") == "", F.lit("")).otherwise(F.concat(F.lit("\n"), F.coalesce(body, F.lit("")), F.lit("\n  ")))
    guid = F.when(v("ProviderGuid") != "", F.concat(F.lit(' Guid="'), e("ProviderGuid"), F.lit('"'))).otherwise(F.lit(""))
    rendered = F.when(v("Message") != "", F.concat(F.lit("\n  <RenderingInfo>\n    <Message>"), e("Message"), F.lit("</Message>\n    <Level>"), e("LevelName"), F.lit("</Level>\n  </RenderingInfo>"))).otherwise(F.lit(""))
    return F.concat(
        F.lit(f'<Event xmlns="{NAMESPACE}">\n  <System>\n    <Provider Name="'), e("Provider"), F.lit('"'), guid, F.lit("/>\n"),
        *[tag(n, e(n)) for n in ("EventID", "Version", "Level", "Task", "Opcode", "Keywords")],
        F.lit('    <TimeCreated SystemTime="'), e("TimeCreated"), F.lit('"/>\n'), tag("EventRecordID", e("RecordID")), tag("Channel", e("Channel")), tag("Computer", e("Computer")),
        F.lit('    <Security UserID="'), e("UserID"), F.lit('"/>\n  </System>\n  <EventData>'), data, F.lit("</EventData>"), rendered, F.lit("\n</Event>"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_xml(df: DataFrame, path: str) -> None:
    """Event elements, one a row; parts of the folder joined in a root element make a document."""
    c = clean(df)
    c.select(event_xml(c.columns).alias("value")).write.mode("overwrite").text(path)


def write_file(df: DataFrame, path: str, kind: str) -> int:
    """One local file, streamed row by row through the driver: for exports of a size that one file is meant for. Returns the rows."""
    import csv
    import json

    n = 0
    c = clean(df) if kind == "xml" else df
    rows = (c.select(event_xml(c.columns).alias("v")) if kind == "xml" else c).toLocalIterator()
    with open(path, "w", encoding="utf-8", newline="") as f:
        if kind == "xml":
            f.write('<?xml version="1.0" encoding="utf-8"?>\n<Events>\n')
        elif kind == "json":
            f.write("[")
        writer = csv.writer(f) if kind == "csv" else None
        if writer:
            writer.writerow(df.columns)
        for r in rows:
            if writer:
                writer.writerow(["" if x is None else x for x in r])
            elif kind == "xml":
                f.write(r["v"] + "\n")
            elif kind == "json":
                f.write(("," if n else "") + "\n  " + json.dumps(r.asDict(), ensure_ascii=False, indent=2, default=str).replace("\n", "\n  "))
            else:
                f.write(json.dumps(r.asDict(), ensure_ascii=False, default=str) + "\n")
            n += 1
        f.write("</Events>\n" if kind == "xml" else "\n]\n" if kind == "json" else "")
    return n


def _lines(df: DataFrame, kind: str, columns: list[str]) -> Column:
    if kind == "xml":
        return event_xml(df.columns)
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    return F.to_csv(row, {"quoteAll": "true", "escape": '"', "emptyValue": ""}) if kind == "csv" else F.to_json(row, {"ignoreNullFields": "false"})


#: What stands before, between and after the lines of a file.
_FRAMES = {"csv": ("", "", ""), "jsonl": ("", "", ""), "json": ("[", ",", "]\n"), "xml": ('<?xml version="1.0" encoding="utf-8"?>\n<Events>\n', "", "</Events>\n")}


def write_files(df: DataFrame, targets: dict[str, str], kind: str, source: str, error: str | None = None, lost: str | None = None) -> DataFrame:
    """One file for each value of ``source``, written by the tasks in converter order; a result row a file (source, target, rows, ok, error, lost).

    Targets must lie where every machine can write. A file is written beside its target and
    moved there when it is complete, so a task that runs again does no harm. ``error`` and
    ``lost`` name columns with what went wrong while a source was read.
    """
    spark = df.sparkSession
    columns = [c for c in df.columns if c not in (source, error, lost)]
    none = F.lit(None).cast("string")
    rows = df.select(F.col(source).alias("source"), *[c.alias(n) for c, n in zip(converter_order(F.col("RecordID"), F.col("TimeCreated")), ("o1", "o2"))], (F.when(F.col(error).isNull() & F.col(lost).isNull(), _lines(df, kind, columns)) if error else _lines(df, kind, columns)).alias("line"), (F.col(error) if error else none).alias("error"), (F.col(lost) if lost else none).cast("long").alias("lost"))
    # Every file has a row of its own first, so that one without records is written as well.
    names = spark.createDataFrame(list(targets.items()), "source string, target string")
    first = names.select("source", F.lit(None).cast("long").alias("o1"), none.alias("o2"), none.alias("line"), none.alias("error"), F.lit(0).cast("long").alias("lost"))
    head, between, foot = _FRAMES[kind]
    if kind == "csv":
        head = ",".join('"' + c.replace('"', '""') + '"' for c in columns) + "\n"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, f, n, wrong, gone = None, None, 0, None, 0

        def done() -> pd.DataFrame:
            f.write(foot)
            f.close()
            target = targets[now]
            if wrong is None:
                os.replace(f.name, target)
            else:
                os.remove(f.name)
            return pd.DataFrame([(now, target, n if wrong is None else 0, wrong is None, wrong, gone)], columns=["source", "target", "rows", "ok", "error", "lost"])

        for frame in frames:
            for name, line, error_, lost_ in frame.itertuples(index=False):
                if name != now:
                    if f is not None:
                        yield done()
                    now, n, wrong, gone = name, 0, None, 0
                    os.makedirs(os.path.dirname(targets[name]) or ".", exist_ok=True)
                    f = open(f"{targets[name]}.{os.getpid()}.part", "w", encoding="utf-8", newline="")  # noqa: SIM115
                    f.write(head)
                if isinstance(error_, str):
                    wrong = error_
                if lost_ == lost_ and lost_ is not None:
                    gone += int(lost_)
                if isinstance(line, str):
                    f.write((between if n else "") + ("\n" if kind == "json" else "") + line + ("" if kind == "json" else "\n"))
                    n += 1
        if f is not None:
            yield done()

    spread = first.unionByName(rows).repartition(max(1, len(targets)), "source").sortWithinPartitions("source", "o1", "o2")
    return spread.select("source", "line", "error", "lost").mapInPandas(run, "source string, target string, rows long, ok boolean, error string, lost long")


def convert(spark: SparkSession, source: str, target: str | None = None, kind: str = "csv", recursive: bool = False, extension: str = ".evtx", progress: Callable[[int, int, str], None] | None = None, tool: str | None = None, in_tasks: bool = True) -> DataFrame:
    """Convert all files found; one result row a file (source, target, rows, ok, error, lost). A file that fails does not stop the others.

    Files are written by the tasks, many at a time. With ``in_tasks=False``, or if the job as
    a whole fails, they go one after the other through the driver, which then tells which failed.
    """
    kind = kind if kind in FORMATS else "csv"
    files, shape = find_files(source, extension, recursive), "source string, target string, rows long, ok boolean, error string, lost long"
    targets = {f: output_path(f, target, kind) for f in files}
    if files and in_tasks and len(set(targets.values())) == len(files):
        try:
            if extension == ".evtx":
                raw = raw_events(spark, files, tool, errors=True)
                ends = raw.where("value is null").select(*[F.lit(None).cast("string").alias(c) for c in CANONICAL], "source", "error", "lost")
                rows = from_json_events(raw.where("value is not null"), keep=["source", "error", "lost"]).unionByName(ends)
                out = write_files(clean(rows, ["source", "error", "lost"]), targets, kind, "source", "error", "lost").collect()
            else:
                out = write_files(clean(read_many(spark, files, full=True), ["SourceLog"]), targets, kind, "SourceLog").collect()
        except Exception:  # noqa: BLE001 - which file it was shows below
            pass
        else:
            out = sorted(out, key=lambda r: r["source"])
            for i, r in enumerate(out, 1):
                if progress:
                    progress(i, len(files), r["source"])
            return spark.createDataFrame(out, shape)
    out = []
    for i, f in enumerate(files, 1):
        path = targets[f]
        try:
            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
            df = read_evtx(spark, [f], tool) if extension == ".evtx" else clean(read_any(spark, f))
            df = df.orderBy(*converter_order(F.col("RecordID"), F.col("TimeCreated")))
            out.append((f, path, write_file(df, path, kind), True, None, 0))
        except Exception as e:  # noqa: BLE001 - any failure becomes a row
            out.append((f, path, 0, False, str(e)[:500], 0))
        if progress:
            progress(i, len(files), f)
    return spark.createDataFrame(out, shape)
