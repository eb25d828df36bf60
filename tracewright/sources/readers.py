"""Log files to DataFrames of strings."""

from __future__ import annotations

import glob as globbing
import json
import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.operators.records import clean, from_json_events
from tracewright.schema import CANONICAL
from tracewright.session import scratch_folder


def local_path(path: str) -> str:
    """Without quotes, with ``~`` and variables expanded; URIs stay as they are."""
    p = path.strip().strip("'\"")
    return p if "://" in p else os.path.abspath(os.path.expanduser(os.path.expandvars(p)))


def find_files(path: str, extension: str = ".evtx", recursive: bool = False, chosen: Iterable[str] | None = None) -> list[str]:
    """Files at a path (file, pattern or folder) with an extension, sorted; ``chosen`` bounds them by name."""
    p = local_path(path)
    if os.path.isfile(p):
        found = [p]
    elif any(c in p for c in "*?["):
        found = globbing.glob(p, recursive=recursive)
    else:
        found = [os.path.join(d, f) for d, _, fs in os.walk(p) for f in fs if recursive or d == p]
    names = set(chosen) if chosen is not None else None
    return sorted(f for f in found if f.lower().endswith(extension) and (names is None or os.path.basename(f) in names))


def all_strings(df: DataFrame) -> DataFrame:
    """Every column as text; nested values as JSON."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[(F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`").cast("string")).alias(f.name) for f in df.schema])


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Header row, all strings, quoted line breaks; CSV knows no null, so what is empty is empty text."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"', emptyValue="").na.fill("")


def read_json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """One object a line. A schema saves the pass that finds the columns."""
    r = spark.read.schema(schema) if schema else spark.read.option("primitivesAsString", True)
    return all_strings(r.json(path))


def read_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One object a line, or one array a file: lines are tried first."""
    lines = spark.read.option("primitivesAsString", True).json(path)
    if lines.columns and lines.columns != ["_corrupt_record"] and "_corrupt_record" not in lines.columns:
        return all_strings(lines)
    return all_strings(spark.read.option("primitivesAsString", True).option("multiLine", True).json(path))


def read_raw_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Canonical rows of raw events, one JSON object a line, as dump tools write them."""
    return from_json_events(spark.read.text(path))


_READERS = {".csv": read_csv, ".jsonl": read_json_lines, ".ndjson": read_json_lines, ".json": read_json}


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By extension: csv, jsonl, ndjson, json, orc, avro-free parquet for anything else."""
    ext = os.path.splitext(path)[1].lower()
    if ext in _READERS:
        return _READERS[ext](spark, path)
    return all_strings(spark.read.orc(path) if ext == ".orc" else spark.read.parquet(path))


def _header(path: str) -> str:
    """First line of a CSV file that the driver can open; files of unlike headers are read apart."""
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.readline()
    except OSError:
        return path


def _file_name(path: Column) -> Column:
    """A file's path as the reader names it, without scheme and escapes."""
    return F.url_decode(F.replace(F.regexp_replace(path, "^file:/+", "/"), F.lit("+"), F.lit("%2B")))


def read_many(spark: SparkSession, paths: list[str], full: bool = False) -> DataFrame:
    """All files as one table; missing columns are null, ``SourceLog`` is the name of the file or folder given (its path if ``full``).

    Files of one format (and CSV files of one header) are one scan, however many they are.
    """
    if not paths:
        raise ValueError("no files")
    groups: dict[tuple, list[str]] = {}
    for p in paths:
        ext = os.path.splitext(p)[1].lower()
        groups.setdefault((ext, _header(p) if ext == ".csv" else ""), []).append(p)
    out = None
    for (ext, _), own in groups.items():
        if ext == ".csv":
            df = spark.read.csv(own, header=True, inferSchema=False, multiLine=True, quote='"', escape='"', emptyValue="")
        elif ext in (".jsonl", ".ndjson", ".json"):
            first = spark.read.option("primitivesAsString", True)
            lines = first.json(own) if ext == ".json" else None
            multi = lines is not None and (not lines.columns or "_corrupt_record" in lines.columns)
            df = first.option("multiLine", True).json(own) if multi else lines if lines is not None else first.json(own)
        else:
            df = spark.read.orc(own, mergeSchema=True) if ext == ".orc" else spark.read.option("mergeSchema", True).parquet(*own)
        columns = df.columns
        named = _file_name(F.col("_metadata.file_path"))
        for p in own:
            if os.path.isdir(p):  # parts of a folder go by the folder's name
                named = F.when(F.startswith(_file_name(F.col("_metadata.file_path")), F.lit(local_path(p).rstrip("/") + "/")), F.lit(local_path(p))).otherwise(named)
        df = df.select("*", named.alias("__path"))
        part = all_strings(df).withColumn("SourceLog", F.col("__path") if full else F.element_at(F.split(F.col("__path"), "/"), -1)).drop("__path")
        if ext == ".csv":
            part = part.na.fill("", subset=columns)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def load_canonical(spark: SparkSession, path: str) -> DataFrame:
    """Any file in the canonical columns, null words as empty text."""
    return clean(read_any(spark, path))


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows held in memory, in the canonical columns and their own."""
    names = list(dict.fromkeys([*CANONICAL, *(k for r in rows for k in r)]))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows], schema)


def from_memory(spark: SparkSession, held: object, name: str = "upload.csv", tool: str | None = None) -> DataFrame:
    """A pandas frame, bytes, or a binary stream (whose format ``name`` tells) as a table of strings.

    Bytes are put into the session's shared scratch folder first, so that executors can read them.
    """
    if isinstance(held, pd.DataFrame):
        schema = T.StructType([T.StructField(str(c), T.StringType()) for c in held.columns])
        rows = [tuple(None if x is None or x is pd.NA or x != x else str(x) for x in row) for row in held.itertuples(index=False)]
        return spark.createDataFrame(rows, schema)
    if not isinstance(held, bytes | bytearray | memoryview):
        held = held.read()
    jvm = spark._jvm.org.apache.hadoop.fs
    path = jvm.Path(f"{scratch_folder(spark, 'upload')}/{os.path.basename(name) or 'upload'}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(held))
    finally:
        out.close()
    where = path.toString()
    return read_evtx(spark, [where.removeprefix("file:")], tool=tool) if name.lower().endswith(".evtx") else read_any(spark, where)


# Binary event logs. A dump tool or the pure-Python parser reads them on the executors, one
# file a task; neither is part of this package.

TOOL_VARIABLE = "EVTX_DUMP_PATH"
#: Where a dump tool may stand besides the search path.
TOOL_PLACES = ["/usr/local/bin/evtx_dump", "/usr/bin/evtx_dump", "/opt/evtx/evtx_dump", "~/.cargo/bin/evtx_dump", "~/bin/evtx_dump"]
#: A record that is not complete after this many characters is given up, and counted as lost.
RECORD_LIMIT = 10_000_000


def works(tool: str) -> bool:
    """Whether a tool tells its version within five seconds."""
    try:
        return subprocess.run([tool, "--version"], capture_output=True, timeout=5).returncode == 0
    except (OSError, subprocess.SubprocessError):
        return False


def dump_tool() -> str | None:
    """Path of a dump tool that works: from the environment, else from known places, else from the search path."""
    places = [os.environ.get(TOOL_VARIABLE), *map(os.path.expanduser, TOOL_PLACES), shutil.which("evtx_dump")]
    return next((p for p in places if p and os.path.isfile(p) and works(p)), None)


def join_records(lines: Iterable[str], limit: int = RECORD_LIMIT, lost: list[int] | None = None) -> Iterator[str]:
    """JSON objects that may run over several lines; the length of what grows beyond the limit, or is cut off at the end, goes to ``lost``."""
    held: list[str] = []
    size = 0
    for line in lines:
        if not held and not line.lstrip().startswith("{"):
            continue
        held.append(line)
        size += len(line)
        if line.rstrip().endswith("}"):
            text = "".join(held)
            try:
                json.loads(text)
            except ValueError:
                pass
            else:
                yield text
                held, size = [], 0
                continue
        if size > limit:
            if lost is not None:
                lost.append(size)
            held, size = [], 0
    if held and lost is not None:
        lost.append(size)


def _events_of(path: str, tool: str | None, lost: list[int]) -> Iterator[str]:
    tool = tool or dump_tool()
    if tool:
        with tempfile.TemporaryFile() as errors, subprocess.Popen([tool, path, "-o", "jsonl"], stdout=subprocess.PIPE, stderr=errors, text=True, errors="replace") as p:
            yield from join_records(p.stdout, lost=lost)
            if p.wait() != 0:
                errors.seek(max(0, errors.seek(0, os.SEEK_END) - 2_000))
                raise RuntimeError(f"{os.path.basename(tool)} ended with {p.returncode} on {path}: {errors.read().decode(errors='replace').strip()}")
        return
    try:
        from Evtx.Evtx import Evtx
    except ImportError as e:
        raise RuntimeError(f"no reader for binary logs: set {TOOL_VARIABLE} or install python-evtx") from e
    import xml.etree.ElementTree as ET

    def value(el: ET.Element) -> object:
        out: dict = {"#attributes": dict(el.attrib)} if el.attrib else {}
        for child in el:
            tag = child.tag.rpartition("}")[2]
            v = value(child)
            out[tag] = [*(out[tag] if isinstance(out[tag], list) else [out[tag]]), v] if tag in out else v
        text = (el.text or "").strip()
        return ({**out, "#text": text} if text else out) if out else text

    with Evtx(path) as log:
        for record in log.records():
            try:
                yield json.dumps(value(ET.fromstring(record.xml())))
            except Exception:  # noqa: BLE001 - a broken record is counted, the others stay
                lost.append(0)


def raw_events(spark: SparkSession, files: list[str], tool: str | None = None, errors: bool = False) -> DataFrame:
    """(value, source, error, lost) of binary logs, one task a file: a raw event a row, and one row at a file's end with the number of records lost.

    A file that cannot be read fails the job; with ``errors`` it becomes a row with its error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path in f["path"]:
                lost: list[int] = []
                batch: list[str] = []
                error = None
                try:
                    for e in _events_of(path, tool, lost):
                        batch.append(e)
                        if len(batch) == 5_000:
                            yield pd.DataFrame({"value": batch, "source": path, "error": None, "lost": None}, dtype=object)
                            batch = []
                except Exception as e:  # noqa: BLE001 - any failure becomes a row if the caller wants that
                    if not errors:
                        raise
                    error = str(e)[:500]
                end = pd.DataFrame({"value": [None], "source": [path], "error": [error], "lost": [len(lost)]}, dtype=object)
                yield pd.concat([pd.DataFrame({"value": batch, "source": path, "error": None, "lost": None}, dtype=object), end]) if batch else end

    paths = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, len(files)), "path")
    return paths.mapInPandas(run, "value string, source string, error string, lost long")


def read_evtx(spark: SparkSession, files: list[str], tool: str | None = None) -> DataFrame:
    """Canonical rows of binary logs; one task a file. A tool that fails fails the job; broken records are left out (``raw_events`` counts them)."""
    return from_json_events(raw_events(spark, files, tool).where("value is not null"))
