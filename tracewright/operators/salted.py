"""Aggregation per key where a few keys hold most rows: two stages with salts on heavy keys.

Stage one aggregates per key and salt, stage two merges the partial results per key. The
salt is a hash of the row's own values, never ``rand()``: a task that runs again after a
lost executor gives its rows the same salts. For distinct counts the salt comes from the
counted value, so that a value lies under one salt only and partial counts add up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.session import fresh, parallelism


#: Part of the rows that heavy keys are looked for in.
SAMPLE = 0.1
#: Least number of parts that the work is meant to fall into.
LEAST_PARTS = 500


def heavy_keys(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Keys with more than ``share`` of all rows and their number of salts: at most ``1 / share`` rows, whatever the data.

    Salts are given so that no salt of a key holds much more than ``share`` of the rows.
    """
    seen = Observation()
    n = fresh(keys, "n")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)).observe(seen, F.sum(n).alias("total"))
    # One pass: the most frequent keys, as many as can be heavy, and the number of rows on the way.
    found = counts.orderBy(F.desc(n)).limit(int(1 / share) + 1).collect()
    limit = share * ((seen.get["total"] or 0) if found else 0)
    rows = [(*tuple(r)[:-1], int(-(-r[n] // max(1, int(limit))))) for r in found if r[n] > limit]
    schema = df.select(*keys).schema.add(fresh(keys, "salts"), T.IntegerType())
    return df.sparkSession.createDataFrame(rows, schema)


def default_share(spark: SparkSession) -> float:
    """Share of the rows from which on a key is heavy: half of what a shuffle partition would get if all were equal."""
    return 1.0 / max(LEAST_PARTS, 2 * parallelism(spark))


def with_salt(df: DataFrame, keys: list[str], spread: Column, share: float | None, salt: str, sample: DataFrame | None = None) -> DataFrame:
    """``df`` plus ``salt``: 0 for ordinary keys, else a hash of ``spread`` below the key's number of salts.

    Heavy keys are looked for in a sample of the rows: ``sample``, if the caller has one that
    costs less than to draw from ``df``. Which keys count as heavy decides how
    the work is spread, never a result: salts depend on key and ``spread`` alone.
    """
    few = df.select(*keys).sample(SAMPLE, seed=7) if sample is None else sample.select(*keys)
    heavy = heavy_keys(few, keys, share or default_share(df.sparkSession))
    names = {k: fresh(df.columns, f"__{i}k") for i, k in enumerate(keys)}
    n = fresh(df.columns, "__n")
    heavy = heavy.toDF(*[names[k] for k in keys], n)
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(names[k])) for k in keys])
    salted = df.join(F.broadcast(heavy), same, "left").withColumn(salt, F.when(F.col(n).isNotNull(), F.pmod(F.xxhash64(spread), F.col(n))).otherwise(F.lit(0)).cast("int"))
    return salted.drop(n, *names.values())


def salted_distinct(df: DataFrame, keys: list[str], per: list[str], counted: str, out: str, share: float | None = None, sample: DataFrame | None = None) -> DataFrame:
    """Number of distinct, non-null ``counted`` for each ``keys + per``; ``keys`` are those that may be heavy (``sample``: see :func:`with_salt`).

    An empty input gives an empty table; null keys form a group of their own; repeated rows count once.
    """
    salt = fresh(df.columns, "__salt")
    s = with_salt(df.select(*keys, *per, counted), keys, F.col(counted), share, salt, sample)
    partial = s.groupBy(*keys, *per, salt).agg(F.count_distinct(counted).alias(out))
    return partial.groupBy(*keys, *per).agg(F.sum(out).alias(out))


#: Merge step of the partial results that :func:`salted_aggregate` can take.
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def salted_aggregate(df: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, str]], share: float | None = None) -> DataFrame:
    """``aggregates``: output name -> (count | sum | min | max, column or ``*``), per ``keys``, in two salted stages.

    Equal to one plain ``groupBy``; an empty input gives an empty table, null keys form a group.
    """
    salt = fresh(df.columns, "__salt")
    spread = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    s = with_salt(df, keys, spread, share, salt)
    first = [getattr(F, how)(F.lit(1) if c == "*" else F.col(c)).alias(name) for name, (how, c) in aggregates.items()]
    partial = s.groupBy(*keys, salt).agg(*first)
    return partial.groupBy(*keys).agg(*[_MERGE[how](name).alias(name) for name, (how, _) in aggregates.items()])
