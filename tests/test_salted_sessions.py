from __future__ import annotations

import random
from collections import defaultdict

import pytest

from tracewright.operators.salted import heavy_keys, salted_aggregate, salted_distinct
from tracewright.operators.sessions import sessions


def rows(n=3000, seed=1):
    r = random.Random(seed)
    keys = ["hot"] * 6 + ["warm"] * 2 + [None, "a", "b", "c"]
    return [(r.choice(keys), r.choice(["x", "y", None]), r.choice(["d1", "d2"]), r.choice([None, *range(200)]), r.random()) for _ in range(n)]


SCHEMA = "k string, __salt string, day string, id long, __n double"


def test_distinct_counts_equal_the_plain_ones(spark):
    data = rows()
    data += data[:100]
    expected = defaultdict(set)
    for k, s, d, i, _ in data:
        expected[k, s, d]
        if i is not None:
            expected[k, s, d].add(i)
    got = salted_distinct(spark.createDataFrame(data, SCHEMA), ["k", "__salt"], ["day"], "id", "n", share=0.05)
    assert {tuple(r)[:3]: r["n"] for r in got.collect()} == {k: len(v) for k, v in expected.items()}


def test_aggregates_equal_the_plain_ones(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = salted_aggregate(df, ["k"], {"n": ("count", "*"), "s": ("sum", "id"), "lo": ("min", "id"), "hi": ("max", "id")}, share=0.05)
    plain = df.groupBy("k").agg({"*": "count", "id": "sum"}).collect()
    assert {r["k"]: (r["n"], r["s"]) for r in got.collect()} == {r["k"]: (r["count(1)"], r["sum(id)"]) for r in plain}


def test_heavy_keys_are_bounded_and_split(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    h = {r["k"]: r["salts"] for r in heavy_keys(df, ["k"], 0.1).collect()}
    assert set(h) == {"hot", "warm"} and h["hot"] >= 5
    assert heavy_keys(df.limit(0), ["k"], 0.1).count() == 0
    assert salted_distinct(df.limit(0), ["k"], ["day"], "id", "n").count() == 0


def brute(data, gap):
    by = defaultdict(list)
    for k, t, i in data:
        if k is not None and t is not None:
            by[k].append((t, i))
    out = set()
    for k, v in by.items():
        v.sort(key=lambda x: x[0])
        cur = [v[0]]
        for x in v[1:]:
            if x[0] - cur[-1][0] > gap:
                out.add((k, cur[0][0], cur[-1][0], len({i for _, i in cur if i is not None})))
                cur = []
            cur.append(x)
        out.add((k, cur[0][0], cur[-1][0], len({i for _, i in cur if i is not None})))
    return out


@pytest.mark.parametrize("seed", [7, 50, 1000])
def test_sessions_equal_brute_force(spark, seed):
    r = random.Random(seed)
    data = [(r.choice(["hot", "hot", "hot", "a", None]), r.choice([None, *range(0, 3000)]), r.choice([None, *map(str, range(60))])) for _ in range(700)]
    data += data[:50]
    df = spark.createDataFrame([(*x, 1, "c") for x in data], "k string, t long, id string, at int, sid string")
    got = {tuple(x) for x in sessions(df, ["k"], "t", 10, "id").collect()}
    assert got == brute(data, 10)


def test_session_edges(spark):
    data = [("k", 0, "a"), ("k", 10, "b"), ("k", 21, "c"), ("k", 21, "c"), ("z", 5, "a")]
    df = spark.createDataFrame(data, "k string, t long, id string")
    assert {tuple(x) for x in sessions(df, ["k"], "t", 10, "id").collect()} == {("k", 0, 10, 2), ("k", 21, 21, 1), ("z", 5, 5, 1)}
    assert sessions(df.limit(0), ["k"], "t", 10, "id").count() == 0


def test_ids_that_come_back_and_gap_zero(spark):
    data = [("k", t, i) for t, i in [(0, "a"), (9, "b"), (18, "a"), (27, "a"), (60, "a"), (69, "c"), (78, "b"), (200, None)]]
    df = spark.createDataFrame(data, "k string, t long, id string")
    assert {tuple(x) for x in sessions(df, ["k"], "t", 10, "id").collect()} == brute(data, 10) == {("k", 0, 27, 2), ("k", 60, 78, 3), ("k", 200, 200, 0)}
    assert {tuple(x) for x in sessions(df, ["k"], "t", 0, "id").collect()} == brute(data, 0)


def test_one_entity_of_a_million_rows(spark):
    from pyspark.sql import functions as F

    n = 1_000_000
    # An hour of one entity, with ids that come back after half an hour, then a pause and the same ids again.
    df = spark.range(n).select(F.lit("hot").alias("k"), (F.col("id") * 3600).alias("t"), F.pmod("id", F.lit(n // 2)).cast("string").alias("i"))
    df = df.unionByName(df.withColumn("t", F.col("t") + 10_000_000_000))
    got = {tuple(x) for x in sessions(df, ["k"], "t", 600_000_000, "i").collect()}
    last = (n - 1) * 3600
    assert got == {("hot", 0, last, n // 2), ("hot", 10_000_000_000, 10_000_000_000 + last, n // 2)}
