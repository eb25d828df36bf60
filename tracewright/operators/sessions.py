"""Activity sessions by sweep line.

Every event adds one at its time and takes one away at its time plus the gap. Where the
running sum comes back to zero a session closes; at equal times the additions come first,
so that neighbours exactly one gap apart stay together.

Time is cut into cells one gap wide. Events of one cell are never further apart than the
gap, so a cell lies in one session as a whole, and the sweep needs its first and last event
only: it sees at most (time span / gap) cells of a key, however many events the key has.
Cells are aggregated before anything is moved, and a cell of very many rows gets salts.

Ids are counted once a cell. An id that comes back in another cell of the same session would
count again: such ids are found by their first and last cell, and only their rows are
looked at once more. Ids of one moment, like record ids, never are.

Defined results: rows with null key parts or time are left out; repeated rows count once;
an id that is seen at several times counts once in each session; null ids keep a session
going but are not counted; an empty table gives an empty table; further columns of the
input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.salted import with_salt
from tracewright.session import broadcast_if_small, cut

#: More ids that come back than this are looked up by shuffle.
BROADCAST_IDS = 1_000_000


def _sweep(df: DataFrame, by: list[str], opens: str, closes: Column) -> DataFrame:
    """Rows of ``df`` plus ``since``: the start of the session they lie in, within ``by``."""
    deltas = F.array(F.struct(F.col(opens).alias("at"), F.lit(1).alias("delta")), F.struct(closes.alias("at"), F.lit(-1).alias("delta")))
    w = Window.partitionBy(*by).orderBy("at", F.desc("delta")).rowsBetween(Window.unboundedPreceding, 0)
    swept = df.withColumn("d", F.explode(deltas)).select(*df.columns, F.col("d.at").alias("at"), F.col("d.delta").alias("delta"))
    swept = swept.withColumn("open", F.sum("delta").over(w))
    # The sum is one after an addition only if it was zero before: a session starts here.
    starts = (F.col("delta") == 1) & (F.col("open") == 1)
    return swept.withColumn("since", F.max(F.when(starts, F.col("at"))).over(w)).where("delta = 1").drop("at", "delta", "open")


def sessions(df: DataFrame, keys: list[str], at_us: str, gap_us: int, counted: str, sample: DataFrame | None = None) -> DataFrame:
    """``keys``, start_us, end_us, n_records: maximal stretches without a pause over ``gap_us``; ``n_records`` counts distinct ``counted``.

    ``sample``: rows like those of ``df`` in which to look for cells of very many rows.
    """
    width = gap_us + 1  # times are whole, so two of one cell are at most one gap apart
    k = [f"k{i}" for i in range(len(keys))]

    def cut_up(rows: DataFrame) -> DataFrame:
        e = rows.select(*[F.col(c).alias(n) for c, n in zip(keys, k)], F.col(at_us).alias("t"), F.col(counted).cast("string").alias("id"))
        return e.dropna(subset=[*k, "t"]).withColumn("cell", F.floor(F.col("t") / width))

    e = cut_up(df)
    salted = with_salt(e, [*k, "cell"], F.col("id"), None, "salt", None if sample is None else cut_up(sample))
    parts = salted.groupBy(*k, "cell", "salt").agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.count_distinct("id").alias("n"))
    # Parts go straight to where their key is swept: salts of a cell are merged there.
    cells = parts.repartition(*k).groupBy(*k, "cell").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n"))
    swept = _sweep(cells, k, "start", F.col("stop") + gap_us)
    again = _repeats(e.where("id is not null").select(*k, "id", "cell"), k)
    told = swept.select(*k, "since", "stop", "n")
    if again is not None:
        inside = swept.select(*k, "cell", "since").join(again, [*k, "cell"]).where(F.col("before") >= F.floor(F.col("since") / width))
        told = told.unionByName(inside.select(*k, "since", F.lit(None).cast("long").alias("stop"), (-F.col("times")).alias("n")))
    return told.groupBy(*k, "since").agg(F.max("stop").alias("end_us"), F.sum("n").alias("n_records")).select(*[F.col(a).alias(c) for a, c in zip(k, keys)], F.col("since").alias("start_us"), "end_us", "n_records")


def _repeats(e: DataFrame, k: list[str]) -> DataFrame | None:
    """(k, cell, before, times): how many ids of a cell were last seen in the earlier cell ``before``; None if no id is in two cells.

    Candidates are found by a hash of key and id, which only narrows; the ids themselves are compared then.
    """
    h = F.xxhash64(*[F.col(c) for c in k], F.col("id"))
    far = cut(e.groupBy(h.alias("h")).agg(F.min("cell").alias("lo"), F.max("cell").alias("hi")).where("lo < hi").select("h"))
    if far.isEmpty():
        return None
    rows = e.withColumn("h", h).join(broadcast_if_small(far, BROADCAST_IDS), "h", "left_semi").select(*k, "id", "cell").distinct()
    seen = rows.withColumn("before", F.lag("cell").over(Window.partitionBy(*k, "id").orderBy("cell")))
    return seen.where("before is not null").groupBy(*k, "cell", "before").agg(F.count(F.lit(1)).alias("times"))
