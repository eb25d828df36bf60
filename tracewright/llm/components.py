"""Groups of records that are linked directly or through others.

Union-find runs inside each partition of the links and keeps only a spanning forest: every
node points at the root of its local tree. A node that got different roots in different
partitions links these roots; such links, between roots only, are the input of the next
level. Levels repeat until no node has two roots. Labels then go back down, one join a level.

No task holds more than a bounded number of links: a level has as many partitions as its
links need at ``max_links`` each, and a partition that grows beyond that writes its forest
out and starts anew. Once a level fits one partition, its forest is global. Levels with
several partitions bring the links of a node to its smaller neighbours together, smaller in
the order of a hash; then every node that beats its neighbours disappears, so the graph
shrinks by a constant factor each time, chains included.

Each level is written to the shared checkpoint folder; the driver sees only counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import cut

#: Links that one task may hold at once.
MAX_LINKS = 4_000_000


def roots_of(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest number of each node's tree: union by smaller root, with path halving, over all links at once."""
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def forest(a: np.ndarray, b: np.ndarray, ranks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Spanning forest of the links as (node, root, rank of each node), with a row for each root itself.

    Roots are the smallest nodes of their trees, by ``ranks`` (of all ends of ``a``, then of
    ``b``; ties by text) if they are given, else by text.
    """
    codes, names = pd.factorize(np.concatenate([a, b]))
    names = np.asarray(names, object)
    if ranks is None:
        order = np.argsort(names, kind="stable")
    else:
        of = np.zeros(len(names), np.int64)
        of[codes] = ranks
        order = np.lexsort((names, of))
        ranks = of[order]
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    codes = place[codes]
    root = roots_of(codes[: len(a)], codes[len(a) :], len(names))
    names = names[order]
    return names, names[root], ranks


def _forests(links: DataFrame, hashed: bool, max_links: int) -> DataFrame:
    """(node, root) of each partition's spanning forest; roots are smallest by text, or by Spark's hash if ``hashed``."""
    if hashed:
        links = links.select("a", "b", F.xxhash64("a").alias("ha"), F.xxhash64("b").alias("hb"))
    schema = pa.schema([("node", pa.string()), ("root", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = root = np.zeros(0, object)
        rank = np.zeros(0, np.int64)
        held: list[list[np.ndarray]] = []
        n = 0

        def fold() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            a, b = np.concatenate([node, *[h[0] for h in held]]), np.concatenate([root, *[h[1] for h in held]])
            if not hashed:
                return (*forest(a, b)[:2], rank)
            at = pd.Index(node).get_indexer(root)  # every root is a node of its own
            return forest(a, b, np.concatenate([rank, *[h[2] for h in held], rank[at], *[h[3] for h in held]]))

        def out() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(node), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(node[i : i + 50_000], pa.string()), pa.array(root[i : i + 50_000], pa.string())], schema=schema)

        for batch in batches:
            ends = [np.asarray(batch.column(i).to_pylist(), object) for i in (0, 1)]
            held.append(ends + [batch.column(i).to_numpy() for i in (2, 3)] if hashed else ends)
            n += batch.num_rows
            if n >= max(200_000, len(node)):  # fold in steps that keep pace with the forest, so that folding stays linear
                (node, root, rank), held, n = fold(), [], 0
                if len(node) > max_links:
                    yield from out()
                    node = root = np.zeros(0, object)
                    rank = np.zeros(0, np.int64)
        if held:
            node, root, rank = fold()
        yield from out()

    return links.mapInArrow(run, "node string, root string")


def components(links: DataFrame, a: str, b: str, max_links: int = MAX_LINKS) -> DataFrame:
    """(node, label): one label for all nodes that ``links`` connect; the label is the smallest node by text.

    Links with a null end are left out, links of a node to itself keep it as a group of its
    own, repeated links change nothing; without links the table is empty.
    """
    todo = links.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).dropna()
    levels: list[DataFrame] = []
    hashed = False
    while True:
        star = cut(_forests(todo, hashed, max_links).distinct())
        low = star.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        levels.append(low.select("node", "low"))
        torn = low.where("low <> high").select("node", "low")
        pairs = star.join(torn, "node").where("root <> low").select(F.col("low").alias("a"), F.col("root").alias("b")).distinct()
        todo = cut(pairs)
        n = todo.count()
        if n == 0:
            break
        if n <= max_links:
            # The last level: one forest of at most two nodes a link.
            levels.append(_forests(todo.coalesce(1), False, 2 * max_links).select("node", F.col("root").alias("low")))
            break
        hashed = True
        order = lambda c: F.struct(F.xxhash64(c), F.col(c))
        todo = todo.repartition(-(-n // max_links), F.when(order("a") > order("b"), F.col("a")).otherwise(F.col("b")))
    label = levels[-1].select("node", F.col("low").alias("label"))
    for level in reversed(levels[:-1]):
        up = label.select(F.col("node").alias("low"), F.col("label").alias("over"))
        label = level.join(up, "low", "left").select("node", F.coalesce("over", "low").alias("label"))
    if hashed:
        smallest = label.groupBy("label").agg(F.min("node").alias("smallest"))
        label = label.join(smallest, "label").select("node", F.col("smallest").alias("label"))
    return label


def record_groups(rows: DataFrame, record: str, shared: list[str], max_links: int = MAX_LINKS) -> DataFrame:
    """(record, group_id) for records that share a value of ``shared`` columns with another, directly or indirectly.

    ``group_id`` is the group's smallest record by text. Each shared value is a node of its
    own between its records, so a value of many records gives as many links as records.
    Rows with a null record or value link nothing; a record alone has no row.
    """
    value = F.concat_ws("\x1f", F.lit("v"), *[F.col(c).cast("string") for c in shared])
    links = rows.dropna(subset=[record, *shared]).select(F.concat(F.lit("r"), F.col(record).cast("string")).alias("a"), value.alias("b"))
    label = components(links, "a", "b", max_links).where(F.startswith("node", F.lit("r")))
    label = label.select(F.substring("node", 2, 1 << 30).alias(record), F.substring("label", 2, 1 << 30).alias("group_id"))
    others = label.where(F.col(record) != F.col("group_id"))
    heads = others.select("group_id").distinct().select(F.col("group_id").alias(record), "group_id")
    return others.unionByName(heads)
