"""Time windows of a log: skew-tolerant order, anchored sliding windows, token-bounded chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.text import or_null, uuid5


def islands(df: DataFrame, keys: list[str], at_us: str, gap_us: int, out: str = "island_us", block_us: int | None = None) -> DataFrame:
    """``df`` plus the start of the stretch of rows, at most ``gap_us`` apart, that a row belongs to (null without a time).

    Stretches are found per (keys, time block) and joined over blocks by their ends, so a
    key of any size is spread over its blocks.
    """
    block_us = block_us or max(4 * gap_us, 3_600_000_000)
    k = [F.col(f"`{c}`") for c in keys]
    t = F.col(f"`{at_us}`")
    w = Window.partitionBy(*k, "__block").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    step = Window.partitionBy(*k, "__block").orderBy(t)
    rows = df.withColumn("__block", F.floor(t / block_us))
    new = F.lag(t).over(step).isNull() | (t - F.lag(t).over(step) > gap_us)
    rows = rows.withColumn("__new", F.when(new & t.isNotNull(), t)).withColumn("__local", F.last("__new", ignorenulls=True).over(w)).drop("__new")
    names = [f"__k{i}" for i in range(len(keys))]
    ends = rows.where(t.isNotNull()).groupBy(*[c.alias(n) for c, n in zip(k, names)], "__block", "__local").agg(F.max(t).alias("__stop"))
    of_key = Window.partitionBy(*names).orderBy("__local")
    ends = ends.withColumn("__head", F.when(F.lag("__stop").over(of_key).isNull() | (F.col("__local") - F.lag("__stop").over(of_key) > gap_us), F.col("__local")))
    ends = ends.withColumn(out, F.last("__head", ignorenulls=True).over(of_key.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.select(*names, F.col("__block").alias("__b"), F.col("__local").alias("__l"), out)
    same = (F.col("__block") == F.col("__b")) & (F.col("__local") == F.col("__l"))
    for c, n in zip(k, names):
        same = same & c.eqNullSafe(F.col(n))
    return rows.join(ends, same, "left").drop(*names, "__b", "__l", "__block", "__local")


def skew_order(df: DataFrame, keys: list[str], at_us: str, seq: str, skew_us: int = 5_000_000) -> DataFrame:
    """``df`` plus ``cluster_us``: rows in order of (cluster_us, seq) follow time, but keep their own order where times are within the skew. Rows without time come first (null)."""
    return islands(df, keys, at_us, skew_us, "cluster_us")


def sliding(df: DataFrame, keys: list[str], at_us: str, length_us: int = 600_000_000, overlap_us: int = 120_000_000) -> DataFrame:
    """One row per (row, window it lies in): ``df`` plus ``window_us`` (start). Windows start at the first event of a key, step by length - overlap, and start anew at the next event wherever a window would be empty.

    Where a window can be empty, events are more than a length apart; so anchors change at
    starts of stretches only, and one pass over a key's stretches in order finds them all.
    """
    if overlap_us >= length_us:
        raise ValueError("the overlap must be shorter than the window")
    step = length_us - overlap_us
    rows = islands(df.where(F.col(f"`{at_us}`").isNotNull()), keys, at_us, length_us)
    names = [f"__k{i}" for i in range(len(keys))]
    spans = rows.groupBy(*[F.col(f"`{c}`").alias(n) for c, n in zip(keys, names)], "island_us").agg(F.max(at_us).alias("stop"))
    spans = spans.repartition(*names).sortWithinPartitions(*names, "island_us")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchor, stop = None, 0, 0
        for b in batches:
            found = []
            for *key, start, end in zip(*[c.to_pylist() for c in b.columns]):
                # First window start behind the stretch before.
                after = anchor + step * ((stop - anchor) // step + 1)
                if key != now or start >= after + length_us:
                    anchor = start
                now, stop = key, end
                found.append(anchor)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.int64())], [*names, "__start", "__anchor"])

    shape = T.StructType([*[T.StructField(n, spans.schema[n].dataType) for n in names], T.StructField("__start", T.LongType()), T.StructField("__anchor", T.LongType())])
    anchors = spans.mapInArrow(run, shape)
    same = F.col("island_us") == F.col("__start")
    for c, n in zip(keys, names):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(n))
    rows = rows.join(anchors, same)
    since = F.col(f"`{at_us}`") - F.col("__anchor")
    last = F.floor(since / step)
    first = F.greatest(F.lit(0), F.ceil((since - length_us + 1) / step))
    return rows.withColumn("__n", F.explode(F.sequence(first, last))).withColumn("window_us", F.col("__anchor") + F.col("__n") * step).drop(*names, "__start", "__anchor", "__n", "island_us")


def slices(df: DataFrame, by: list[str], order: list[str], tokens: str, budget: int = 512, out: str = "slice") -> DataFrame:
    """``df`` plus the number of the slice within ``by``: rows in order, a new slice where the next row would pass the budget; a row over the budget stands alone.

    Rows stream through in order; no group is held.
    """
    cols = df.columns
    at, keys = cols.index(tokens), [cols.index(c) for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, n = None, 0, 0
        for b in batches:
            ks = list(zip(*[b.column(i).to_pylist() for i in keys]))
            got = []
            for k, t in zip(ks, b.column(at).to_pylist()):
                t = t or 0
                if k != now:
                    now, used, n = k, t, 0
                elif used + t > budget:
                    used, n = t, n + 1
                else:
                    used += t
                got.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.int32())], [*cols, out])

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.IntegerType())])
    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def chunk_id(host: Column, start_utc: Column, nth: Column) -> Column:
    """UUID of host, start and, beyond the first, slice number."""
    base = F.concat_ws(":", F.coalesce(host, F.lit("UNKNOWN_HOST")), F.coalesce(start_utc, F.lit("NO_TIMESTAMP")))
    return uuid5(F.when(nth > 0, F.concat(base, F.lit(":"), nth.cast("string"))).otherwise(base))


def _member(name: str):
    return lambda r: r[name]


def chunks(df: DataFrame, by: list[str], order: list[Column], at_us: str, line: str, fields: dict[str, str], row_id: str | None = None) -> DataFrame:
    """One row per ``by`` (bounded by the slices' budget): joined lines, times, row count, and the distinct values of each field in order of appearance; ``source_rows`` are the ids of its rows if ``row_id`` names them."""
    ids = {"source_rows": F.col(row_id).cast("string")} if row_id else {}
    packed = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(line).alias("line"), *[or_null(F.col(c)).alias(n) for n, c in fields.items()], *[c.alias(n) for n, c in ids.items()])
    g = df.groupBy(*by).agg(F.array_sort(F.collect_list(packed)).alias("rows"), F.min(at_us).alias("start_us"), F.max(at_us).alias("end_us"), F.count(F.lit(1)).alias("raw_row_count"))
    distinct = [F.array_distinct(F.filter(F.transform("rows", _member(n)), lambda v: v.isNotNull())).alias(n) for n in fields]
    return g.select(*by, F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"), "start_us", "end_us", "raw_row_count", *distinct, *[F.transform("rows", _member(n)).alias(n) for n in ids])
