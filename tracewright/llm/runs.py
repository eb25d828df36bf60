"""Runs of near-identical consecutive events, by optimal segmentation.

The segmentation of an entity's ordered events minimises the dissimilarity of neighbours
within segments plus a penalty for each boundary. It is found by dynamic programming whose
candidates for the last boundary are pruned as soon as they cannot win any more
(:func:`segment`). Neighbours differ by ``label_weight`` if their labels differ, by
``gap_weight`` if they are further apart than allowed, and, where a text is given, by
``text_weight`` times the share of their words that only one of them has (1 - Jaccard). The
first two default to more than the penalty, so that the optimum has a boundary at just those
places; texts that differ in some words stay together.

An entity may hold any share of the rows: segments are found per (entity, time block), and
only the first and last segment of each block meet again, in a second segmentation over at
most two rows a block. As dissimilarity adds up over neighbours, whether a boundary pays is
decided by its two neighbours alone, so cutting at blocks and joining again is exact.

Defined results: events without entity or instant are left out; events without label
are like no other; a null text has no words, and texts without words are alike; ties in time go by the order column, then by record; exact copies count
once; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dissimilarity across entities or blocks.
HARD = 1e9
#: What dissimilarities are multiples of.
STEP = 2.0**-20
SEGMENTS = "entity string, block long, seq long, label long, first_record string, last_record string, start_us long, end_us long, n_records long, closed boolean"

WORDS = ", first_words array<bigint>, last_words array<bigint>"


def unlike(last: pa.Array, first: pa.Array) -> np.ndarray:
    """1 - Jaccard of each word set of ``last`` and that of ``first`` beside it; sets are lists of distinct hashes, two empty ones are alike."""
    n = len(last)
    lens = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (last, first)]
    row = np.concatenate([np.repeat(np.arange(n), k) for k in lens])
    word = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in (last, first)])
    order = np.lexsort((word, row))
    row, word = row[order], word[order]
    both = np.bincount(row[1:][(row[1:] == row[:-1]) & (word[1:] == word[:-1])], minlength=n) if len(row) else np.zeros(n)
    all_ = lens[0] + lens[1] - both
    return 1.0 - np.where(all_ > 0, both / np.maximum(all_, 1), 1.0)


def segment(d: np.ndarray, penalty: float) -> list[int]:
    """Starts of the segments of ``len(d) + 1`` items in an optimal segmentation; ``d[i]``: dissimilarity of items i and i + 1.

    ``best[t]`` is the least cost of the first t items. A start s is dropped at t if
    ``best[s] + cost(s, t) >= best[t]``: then t is as good a start for all that follows. Of
    equal optima the one with fewer boundaries is taken. Dissimilarities count in steps of
    ``STEP``, so that their sums are exact; at ``HARD`` ones the items fall apart beforehand.
    """
    hard = np.flatnonzero(d >= HARD) + 1
    if len(hard):
        return [int(a) + s for a, b in zip([0, *hard], [*hard, len(d) + 1]) for s in segment(d[a : b - 1], penalty)]
    n = len(d) + 1
    d = np.round(d / STEP) * STEP
    cost = np.concatenate([[0.0], np.cumsum(d, dtype=float)]).tolist()  # cost(s, t) = cost[t - 1] - cost[s]
    best, prev = [-penalty], [0]
    starts = [0]
    for t in range(1, n + 1):
        c = cost[t - 1]
        if len(starts) == 1:
            s = starts[0]
            least = best[s] + c - cost[s]
        else:
            least, s = min((best[s] + c - cost[s], s) for s in starts)
        least += penalty
        best.append(least)
        prev.append(s)
        starts = [s for s in starts if best[s] + c - cost[s] < least]
        starts.append(t)
    out, t = [], n
    while t > 0:
        t = prev[t]
        out.append(t)
    return out[::-1]


def _dissimilar(label: np.ndarray, known: np.ndarray, start: np.ndarray, end: np.ndarray, max_gap_us: int, label_weight: float, gap_weight: float) -> np.ndarray:
    same = (label[1:] == label[:-1]) & known[1:] & known[:-1]
    return label_weight * ~same + gap_weight * (start[1:] - end[:-1] > max_gap_us)


def _segments(df: DataFrame, max_gap_us: int, penalty: float, label_weight: float, gap_weight: float, text_weight: float, joining: bool) -> DataFrame:
    """Segments of rows (in the form of ``SEGMENTS``, with ``WORDS`` if texts count) that stand in order within their partition.

    Within one block if ``joining`` is false; else across blocks, never inside one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        seq: dict = {"of": None, "n": 0}

        def cut_up(t: pa.Table, last: bool) -> tuple[pa.Table | None, pa.Table | None]:
            """Finished segments, and the one still open."""
            col = {n: t.column(n) for n in t.column_names}
            entity = col["entity"].combine_chunks().dictionary_encode().indices.to_numpy()
            block, known = col["block"].to_numpy(), col["label"].is_valid().to_numpy()
            label = col["label"].fill_null(0).to_numpy()
            start, end, n = col["start_us"].to_numpy(), col["end_us"].to_numpy(), col["n_records"].to_numpy()
            first, final = np.array(col["first_record"].to_pylist(), object), np.array(col["last_record"].to_pylist(), object)
            other = entity[1:] != entity[:-1]
            far = other | (block[1:] == block[:-1]) if joining else other | (block[1:] != block[:-1])
            if not joining:  # exact copies stand side by side
                copy = np.concatenate([[False], (first[1:] == final[:-1]) & (start[1:] == end[:-1]) & ~far & (label[1:] == label[:-1]) & (known[1:] == known[:-1])])
                if copy.any():
                    return cut_up(t.filter(pa.array(~copy)), last)
            d = _dissimilar(label, known, start, end, max_gap_us, label_weight, gap_weight) + HARD * far
            words = [col[c].combine_chunks() for c in ("first_words", "last_words") if c in col]
            if words:
                d = d + text_weight * unlike(words[1].slice(0, len(d)), words[0].slice(1))
            at = np.array(segment(d, penalty))
            to = np.append(at[1:], len(label)) - 1
            total = np.add.reduceat(n, at)
            rows = pa.table([col["entity"].take(pa.array(at)), pa.array(block[to]), pa.array(np.zeros(len(at), np.int64)), col["label"].take(pa.array(at)), pa.array(first[at], pa.string()), pa.array(final[to], pa.string()), pa.array(start[at]), pa.array(end[to]), pa.array(total), pa.array(np.ones(len(at), bool)), *[w.take(pa.array(i)) for w, i in zip(words, (at, to))]], names=t.column_names)
            return (rows, None) if last else (rows.slice(0, len(at) - 1), rows.slice(len(at) - 1))

        def marked(t: pa.Table, after: pa.Table | None) -> Iterator[pa.RecordBatch]:
            """Number the segments within their block; closed: neither the first nor the last of it."""
            keys = list(zip(t.column("entity").to_pylist(), t.column("block").to_pylist()))
            keys.append((after.column("entity")[0].as_py(), after.column("block")[0].as_py()) if after is not None else None)
            seqs = []
            for k in keys[:-1]:
                seq["n"] = seq["n"] + 1 if seq["of"] == k else 0
                seq["of"] = k
                seqs.append(seq["n"])
            t = t.set_column(2, "seq", pa.array(seqs, pa.int64()))
            t = t.set_column(9, "closed", pa.array([n > 0 and k == x for n, k, x in zip(seqs, keys, keys[1:])], pa.bool_()))
            yield from t.combine_chunks().to_batches()

        for b in batches:
            t = pa.Table.from_arrays(b.columns, names=b.schema.names)  # without the batch's nullability
            if joining:  # what is closed already only passes through
                closed = t.column("closed")
                yield from t.filter(closed).combine_chunks().to_batches()
                t = t.filter(pc.invert(closed))
            if not t.num_rows:
                continue
            done, held = cut_up(pa.concat_tables([held, t]) if held is not None else t, False)
            if done.num_rows:
                yield from marked(done, held)
        if held is not None:
            yield from marked(cut_up(held, True)[0], None)

    return df.mapInArrow(run, SEGMENTS + (WORDS if "first_words" in df.columns else ""))


def word_set(text: Column) -> Column:
    """Sorted hashes of the distinct words of a text, whatever the case; empty for null."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def runs(df: DataFrame, entity: Column, at_us: str, order: Column, label: Column, record: str, max_gap_us: int, least: int = 2, penalty: float = 0.5, label_weight: float = 1.0, gap_weight: float = 1.0, block_us: int = 21_600_000_000, text: Column | None = None, text_weight: float = 1.0) -> DataFrame:
    """(entity, label, first_record, last_record, start_us, end_us, duration_us, n_records) of runs of at least ``least`` events."""
    words = [] if text is None else [word_set(text).alias("first_words"), word_set(text).alias("last_words")]
    e = df.select(entity.cast("string").alias("entity"), F.floor(F.col(at_us) / block_us).alias("block"), F.lit(0).cast("long").alias("seq"), label.cast("long").alias("label"), F.col(record).cast("string").alias("first_record"), F.col(record).cast("string").alias("last_record"), F.col(at_us).alias("start_us"), F.col(at_us).alias("end_us"), F.lit(1).cast("long").alias("n_records"), F.lit(False).alias("closed"), *words, order.alias("o"))
    # Copies go before anything is moved by entity: a row repeated any number of times is one row a task here.
    e = e.where("entity is not null and start_us is not null").distinct().repartition("entity", "block").sortWithinPartitions("entity", "block", "start_us", "o", "first_record", "label").drop("o")
    weights = (max_gap_us, penalty, label_weight, gap_weight, text_weight)
    local = _segments(e, *weights, False)
    # A finished run goes through the second pass untouched, spread by its block; one of too few events ends here.
    rim = local.where(~F.col("closed") | (F.col("n_records") >= least)).repartition("entity", F.when(F.col("closed"), F.col("block")))
    out = _segments(rim.sortWithinPartitions("closed", "entity", "block", "seq"), *weights, True).where(F.col("n_records") >= least)
    return out.select("entity", "label", "first_record", "last_record", "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n_records")
