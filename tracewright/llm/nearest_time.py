"""Nearest record in time for the same entity, within a tolerance.

Time is cut into buckets as wide as the tolerance, so that a partner lies in the same
bucket or in one beside it. Both sides are first reduced to distinct (key, time); a
bucket's times then meet the partner times of the same bucket, and of each adjacent
bucket the one time that can be nearest: the last of the bucket before, the first of the
bucket after. That equals a join on key and same or adjacent bucket with all but the
nearest filtered away, without the pairs of a dense bucket ever being listed. Rows meet
their partner through their time at the end; that join has one partner row a (key, time),
so a hot time can be split.

Defined results: rows with null key parts or time have no partner; the tolerance is
inclusive and may be 0; of equally near rows the earlier one wins, then the smaller id; repeated rows
count once; an empty side gives an empty table; further columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], at_us: str, tolerance_us: int, row_id: str) -> DataFrame:
    """(left_id, right_id, distance_us) for every left row that has a right row of equal ``keys`` near enough."""
    k = [f"k{i}" for i in range(len(keys))]
    bucket = F.floor(F.col("t") / max(tolerance_us, 1)).alias("bucket")

    def shape(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).alias(n) for c, n in zip(keys, k)], F.col(at_us).alias("t"), F.col(row_id).alias("id")).dropna(subset=[*k, "t", "id"])

    rows, partners = shape(left), shape(right).groupBy(*k, "t").agg(F.min("id").alias("id"))
    probes = rows.select(*k, "t").distinct().select(*k, bucket, "t", F.lit(None).alias("cand"))
    cand = partners.select(*k, bucket, "t", F.struct("t", "id").alias("cand"))
    edges = cand.groupBy(*k, "bucket").agg(F.min("cand").alias("low"), F.max("cand").alias("high"))
    beside = edges.select(*k, F.explode(F.array(F.struct((F.col("bucket") - 1).alias("bucket"), F.col("low").alias("cand")), F.struct((F.col("bucket") + 1).alias("bucket"), F.col("high").alias("cand")))).alias("e"))
    beside = beside.select(*k, F.col("e.bucket").alias("bucket"), F.col("e.cand.t").alias("t"), F.col("e.cand").alias("cand"))
    met = probes.unionByName(cand).unionByName(beside)
    up = Window.partitionBy(*k, "bucket").orderBy("t", F.col("cand").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*k, "bucket").orderBy(F.desc("t"), F.col("cand").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("before", F.last("cand", ignorenulls=True).over(up)).withColumn("after", F.last("cand", ignorenulls=True).over(down)).where("cand is null")
    back, ahead = F.col("t") - F.col("before.t"), F.col("after.t") - F.col("t")
    first = F.coalesce(back <= ahead, back.isNotNull())
    best = met.select(*k, "t", F.when(first, F.col("before")).otherwise(F.col("after")).alias("best")).select(*k, "t", F.col("best.id").alias("partner"), F.abs(F.col("best.t") - F.col("t")).alias("distance_us"))
    best = best.where(F.col("distance_us") <= tolerance_us)
    return rows.distinct().join(best, [*k, "t"]).select(F.col("id").alias("left_id"), F.col("partner").alias("right_id"), "distance_us")
