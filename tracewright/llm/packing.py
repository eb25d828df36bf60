"""Texts into containers of fixed capacity, by exact complements.

Only lengths matter to the plan, and there are at most ``capacity`` of them: the histogram
of lengths, which the driver plans on, has the same size for any corpus. A container opens
with the longest length left. Its gap is looked up in the index of single, pair and triple
sums of the lengths that are still available; a combination that fills the gap exactly is
taken, as often as the counts allow. Without one the longest length that fits goes in (best
fit) and the smaller gap is looked up again. The result is a list of patterns with their
multiplicities.

Texts get a rank among those of equal length, without any task seeing all of a length: rank
within (length, bucket) plus the number of texts in the buckets before. Length and rank lead
to a container through the plan's intervals, one binary search an item.

Defined results: a text longer than the capacity is split into full pieces and a rest (only
such texts are split); null and blank texts, and texts without tokens, have 0 tokens and no
container; texts of equal length are interchangeable, repeated rows are items of their own;
an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tracewright.session import cut

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CAPACITY = 2048
#: Texts of one length that one task ranks at a time, about.
RANKED_AT_ONCE = 100_000


@lru_cache(maxsize=4)
def tokenizer(folder: str, vocabulary: str):
    """The public tokenizer of a rank file; the pattern that splits text is stated beside it."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("_public_tokenizers", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row; whole texts are tokenised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(folder, vocabulary)
        for b in batches:
            n = [len(own.encode_ordinary(x)) if x and x.strip() else 0 for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], [doc_id, "n_tokens"])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, n_tokens long")


class _Stock:
    """Counts of lengths with an index of their single, pair and triple sums."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.tolist()
        self.stale = True

    def sums(self) -> None:
        self.have = [a for a in range(len(self.n) - 1, 0, -1) if self.n[a] > 0]
        self.one = sum(1 << a for a in self.have)
        self.two = 0
        for a in self.have:
            self.two |= self.one << a
        self.two &= (1 << len(self.n)) - 1
        self.three = 0
        for a in self.have:
            self.three |= self.two << a
        self.stale = False

    def fits(self, used: dict[int, int], add: tuple[int, ...]) -> bool:
        return all(self.n[a] - used.get(a, 0) >= add.count(a) for a in add)

    def exact(self, gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        """One, two or three available lengths that sum to ``gap``; fewer and longer ones first."""
        if self.one >> gap & 1 and self.fits(used, (gap,)):
            return (gap,)
        if self.two >> gap & 1:
            for a in self.have:
                if a < gap and a * 2 >= gap and self.one >> (gap - a) & 1 and self.fits(used, (a, gap - a)):
                    return (a, gap - a)
        if self.three >> gap & 1:
            for a in self.have:
                if a < gap and a * 3 >= gap and self.two >> (gap - a) & 1:
                    for b in self.have:
                        c = gap - a - b
                        if b <= a and 0 < c <= b and self.one >> c & 1 and self.fits(used, (a, b, c)):
                            return (a, b, c)
        return None

    def largest(self, gap: int, used: dict[int, int]) -> int | None:
        for a in self.have:
            if a <= gap and self.n[a] > used.get(a, 0):
                return a
        return None


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a container, number of such containers); ``counts[n]``: items of length n."""
    stock = _Stock(np.asarray(counts[: capacity + 1], np.int64))
    out: list[tuple[tuple[int, ...], int]] = []
    if stock.n[capacity]:
        out.append(((capacity,), stock.n[capacity]))
        stock.n[capacity] = 0
    while any(stock.n[1:]):
        if stock.stale:
            stock.sums()
        first = next(a for a in stock.have if stock.n[a] > 0)
        inside, gap, used = [first], capacity - first, {first: 1}
        while gap > 0:
            found = stock.exact(gap, used)
            if found is None:
                a = stock.largest(gap, used)
                if a is None:
                    break
                found = (a,)
            for a in found:
                inside.append(a)
                used[a] = used.get(a, 0) + 1
                gap -= a
        times = min(stock.n[a] // k for a, k in used.items())
        for a, k in used.items():
            stock.n[a] -= k * times
            stock.stale |= stock.n[a] == 0
        out.append((tuple(inside), times))
    return out


def intervals(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, copies in a container, first container, first slot), in order of length and rank."""
    taken: dict[int, int] = {}
    rows, container = [], 0
    for inside, times in patterns:
        slot = 0
        for a in sorted(set(inside), reverse=True):
            k = inside.count(a)
            rows.append((a, taken.get(a, 0), k, container, slot))
            taken[a] = taken.get(a, 0) + k * times
            slot += k
        container += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, doc_id: str, text: str, capacity: int = CAPACITY, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, n_tokens, container_id, slot): every text, or piece of an over-long text, in its container."""
    sizes = cut(token_counts(docs, doc_id, text, folder, vocabulary).toDF("id", "tokens"))
    pieces = F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1)).cast("int")
    items = sizes.select("id", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"), "tokens").select("id", "piece", F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("piece") * capacity).alias("n_tokens"))
    histogram = items.where("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for n_tokens, n in histogram:
        counts[n_tokens] = n
    table = intervals(plan(counts, capacity))
    shift = 40
    keys = (table[:, 0] << shift) + table[:, 1]

    buckets = int(max(1, counts.sum() // RANKED_AT_ONCE + 1))
    filled = items.where("n_tokens > 0").withColumn("bucket", F.pmod(F.xxhash64(F.col("id").cast("string"), "piece"), F.lit(buckets)))
    each = filled.groupBy("n_tokens", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = each.withColumn("offset", F.sum("n").over(Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("n_tokens", "bucket", F.coalesce("offset", F.lit(0)).alias("offset"))
    ranked = filled.withColumn("nth", F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("id", "piece")) - 1)
    ranked = ranked.join(before, ["n_tokens", "bucket"]).withColumn("rank", F.col("offset") + F.col("nth"))

    @pandas_udf("container long, slot int")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, (length.to_numpy(np.int64) << shift) + rank.to_numpy(np.int64), side="right") - 1
        row = table[at]
        within = rank.to_numpy(np.int64) - row[:, 1]
        return pd.DataFrame({"container": row[:, 3] + within // row[:, 2], "slot": (row[:, 4] + within % row[:, 2]).astype(np.int32)})

    placed = ranked.withColumn("p", place("n_tokens", "rank")).select(F.col("id").alias(doc_id), "piece", "n_tokens", F.col("p.container").alias("container_id"), F.col("p.slot").alias("slot"))
    empty = items.where("n_tokens <= 0").select(F.col("id").alias(doc_id), "piece", "n_tokens", F.lit(None).cast("long").alias("container_id"), F.lit(None).cast("int").alias("slot"))
    return placed.unionByName(empty)
