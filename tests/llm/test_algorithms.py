from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.llm import components, nearest_time, runs


# Nearest in time.


def brute_nearest(left, right, tol):
    out = set()
    for k, t, i in left:
        if k is None or t is None or i is None:
            continue
        best = min(((abs(t2 - t), t2, i2) for k2, t2, i2 in right if k2 == k and t2 is not None and i2 is not None and abs(t2 - t) <= tol), default=None)
        if best:
            out.add((i, best[2], best[0]))
    return out


@pytest.mark.parametrize("seed,span", [(1, 40), (2, 400), (3, 4000)])
def test_nearest_equals_brute_force(spark, seed, span):
    r = random.Random(seed)

    def some(n, base):
        return [(r.choice(["hot", "hot", "a", None]), r.choice([None, *[r.randrange(-span, span)] * 9]), base + i) for i in range(n)]

    left, right = some(200, 0), some(200, 1000)
    left += left[:20]
    right += right[:20] + [(k, t, i + 5000) for k, t, i in right[:40]]
    schema = "k string, t long, id long, bucket int, cand string"
    a, b = (spark.createDataFrame([(*x, 1, "c") for x in rows], schema) for rows in (left, right))
    got = {tuple(x) for x in nearest_time.nearest_in_time(a, b, ["k"], "t", 10, "id").collect()}
    assert got == brute_nearest(left, right, 10)


def test_nearest_edges(spark):
    a = spark.createDataFrame([("k", 100, 1), ("k", 111, 2)], "k string, t long, id long")
    b = spark.createDataFrame([("k", 90, 9), ("k", 110, 8), ("k", 110, 7), ("k", 90, 10)], "k string, t long, id long")
    assert sorted(map(tuple, nearest_time.nearest_in_time(a, b, ["k"], "t", 10, "id").collect())) == [(1, 9, 10), (2, 7, 1)]
    assert [tuple(x) for x in nearest_time.nearest_in_time(a, a.withColumn("id", F.col("id") + 10), ["k"], "t", 0, "id").orderBy("left_id").collect()] == [(1, 11, 0), (2, 12, 0)]
    assert nearest_time.nearest_in_time(a.limit(0), b, ["k"], "t", 10, "id").count() == 0
    assert nearest_time.nearest_in_time(a, b.limit(0), ["k"], "t", 10, "id").count() == 0


# Components.


def brute_groups(links):
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60), st.booleans())
def test_forest_spans_and_is_no_larger_than_its_nodes(links, hashed):
    a, b = (np.array([f"n{x[i]:02d}" for x in links], object) for i in (0, 1))
    ranks = np.array([hash(("r", x)) % 7 for x in np.concatenate([a, b])], np.int64) if hashed else None
    node, root, rank = components.forest(a, b, ranks)
    if hashed:
        of = dict(zip(node, zip(rank.tolist(), node)))
        assert all(of[r] <= of[n] for n, r in zip(node, root))
    assert len(node) == len(set(node))
    mine, other = defaultdict(set), defaultdict(set)
    for n, r in zip(node, root):
        mine[r].add(n)
    for n, r in brute_groups(zip(a, b)).items():
        other[r].add(n)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, other.values()))


@pytest.mark.parametrize("max_links", [4_000_000, 40, 7])
def test_components_equal_brute_force(spark, max_links):
    r = random.Random(max_links)
    links = [(f"{r.randrange(400):03d}", f"{r.randrange(400):03d}") for _ in range(250)] + [(None, "1"), ("2", None), ("999", "999")]
    links += links[:30]
    df = spark.createDataFrame(links, "a string, b string").repartition(5)
    assert {x["node"]: x["label"] for x in components.components(df, "a", "b", max_links).collect()} == brute_groups(links)


def test_long_chain_through_many_partitions(spark):
    links = [(f"{i:04d}", f"{i + 1:04d}") for i in range(300)]
    random.Random(0).shuffle(links)
    got = components.components(spark.createDataFrame(links, "a string, b string").repartition(8), "a", "b", 60)
    assert {x["label"] for x in got.collect()} == {"0000"} and got.count() == 301


def test_record_groups(spark):
    rows = [("3", "x", "v1"), ("1", "x", "v1"), ("1", "y", "v2"), ("2", "y", "v2"), ("2", "y", "v2"), ("9", "x", "v9"), (None, "x", "v1"), ("5", "x", None), ("7", "y", "v1")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "rec string, kind string, val string, node string")
    got = {(r["rec"], r["group_id"]) for r in components.record_groups(df, "rec", ["kind", "val"]).collect()}
    assert got == {("1", "1"), ("2", "1"), ("3", "1")}
    assert components.record_groups(df.limit(0), "rec", ["kind", "val"]).count() == 0


def test_hub_value_gives_as_many_links_as_records(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("rec"), F.lit("hub").alias("val"))
    assert components.record_groups(df.repartition(6), "rec", ["val"], max_links=500).select("group_id").distinct().count() == 1


# Runs.


def plain_optimum(d, penalty):
    """Least cost over all segmentations, by dynamic programming without pruning."""
    n = len(d) + 1
    best = [-penalty] + [0.0] * n
    for t in range(1, n + 1):
        best[t] = min(best[s] + sum(d[s : t - 1]) + penalty for s in range(t))
    return best[n]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.2, 0.5, 0.7, 1.0, 2.0]), max_size=14), st.sampled_from([0.5, 1.0]))
def test_pruned_segmentation_is_optimal(d, penalty):
    starts = runs.segment(np.array(d), penalty)
    assert starts[0] == 0 and starts == sorted(set(starts))
    cost = (len(starts) - 1) * penalty + sum(x for i, x in enumerate(d) if i + 1 not in starts)
    assert cost == pytest.approx(plain_optimum(d, penalty))


def brute_runs(rows, gap, least):
    by = defaultdict(set)
    for e, t, label, rec in rows:
        if e is not None and t is not None:
            by[e].add((t, int(rec), label, rec))
    out = set()
    for e, v in by.items():
        v = sorted(v, key=lambda x: (x[0], x[1]))
        a = 0
        for i in range(1, len(v) + 1):
            if i == len(v) or v[i][2] is None or v[i][2] != v[i - 1][2] or v[i][0] - v[i - 1][0] > gap:
                if i - a >= least:
                    out.add((e, v[a][3], v[i - 1][3], i - a))
                a = i
    return out


@pytest.mark.parametrize("block", [3, 17, 100, 10**9])
def test_runs_equal_brute_force(spark, block):
    r = random.Random(block)
    rows = [(r.choice(["hot", "hot", "hot", "h2", None]), r.choice([None, *[r.randrange(900)] * 20]), r.choice([1, 1, 1, 1, 2, None]), str(i)) for i in range(900)]
    rows += rows[100:160]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "e string, t long, l long, r string, entity string, closed int")
    out = runs.runs(df, F.col("e"), "t", F.col("r").cast("long"), F.col("l"), "r", 5, 3, block_us=block)
    got = {(x["entity"], x["first_record"], x["last_record"], x["n_records"]) for x in out.collect()}
    assert got == brute_runs(rows, 5, 3)
    assert all(x["duration_us"] == x["end_us"] - x["start_us"] for x in out.collect())


def test_runs_of_nothing(spark):
    df = spark.createDataFrame([], "e string, t long, l long, r string")
    assert runs.runs(df, F.col("e"), "t", F.col("r").cast("long"), F.col("l"), "r", 5).count() == 0


@pytest.mark.parametrize("block", [7, 40, 10**6])
def test_near_identical_texts_stay_together(spark, block):
    r = random.Random(block)
    words = ["refused", "logon", "of", "user", "x1", "x2", "from"]
    rows = [(r.choice(["hot", "hot", "b"]), i // 2, str(i), r.choice([7, 7, 7, None, 9]), r.choice([None, "", *[" ".join(r.sample(words, r.choice([2, 3, 4]))) for _ in range(5)]])) for i in range(260)]
    df = spark.createDataFrame(rows + rows[:20], "e string, t long, r string, l long, x string")
    out = runs.runs(df, F.col("e"), "t", F.col("r").cast("long"), F.col("l"), "r", 5, 2, block_us=block, text=F.col("x"))
    got = {(x["first_record"], x["last_record"], x["n_records"], x["duration_us"]) for x in out.collect()}
    expected = set()
    for e in ("hot", "b"):
        mine, run = sorted((x for x in rows if x[0] == e), key=lambda x: (x[1], int(x[2]))), []
        for x in [*mine, None]:
            if run and x is not None:
                a, b = set((run[-1][4] or "").lower().split()), set((x[4] or "").lower().split())
                d = 1 - len(a & b) / len(a | b) if a | b else 0.0
                if x[3] is not None and x[3] == run[-1][3] and x[1] - run[-1][1] <= 5 and d <= 0.5:
                    run.append(x)
                    continue
            if len(run) >= 2:
                expected.add((run[0][2], run[-1][2], len(run), run[-1][1] - run[0][1]))
            run = [x]
    assert got == expected and len(got) > 5
