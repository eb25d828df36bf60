from __future__ import annotations

import random

import numpy as np
import pytest

from tracewright.operators import vectors


def brute(rows, queries, k):
    out = set()
    for qi, qv, qg in queries:
        if qv is None or qg is None or not np.any(qv):
            continue
        found = []
        for i, v, g in rows:
            if v is not None and np.any(v) and g == qg and i != qi:
                a, b = np.array(qv), np.array(v)
                found.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6), i))
        out |= {(qi, i, -s + 0.0, n) for n, (s, i) in enumerate(sorted(set(found))[:k], 1)}
    return out


@pytest.mark.parametrize("bytes_", [10**9, 200])
def test_nearest_of_one_label(spark, monkeypatch, bytes_):
    monkeypatch.setattr(vectors, "QUERY_BYTES", bytes_)
    r = random.Random(3)
    rows = [(f"r{i:03d}", [float(r.randrange(-2, 3)) for _ in range(3)], r.choice(["a", "a", "b", None])) for i in range(150)] + [("n", None, "a"), ("z", [0.0, 0.0, 0.0], "a")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "id string, v array<double>, g string, score int")
    asked = [x for i, x in enumerate(rows) if i % 10 == 0]
    q = df.where(df.id.isin([x[0] for x in asked]))
    assert {tuple(x) for x in vectors.nearest(df, q, "id", "v", 4, "g").collect()} == brute(rows, asked, 4)
    every = [(i, v, "x") for i, v, _ in rows]
    assert {tuple(x) for x in vectors.nearest(df, q, "id", "v", 4).collect()} == brute(every, [(i, v, "x") for i, v, _ in asked], 4)
    assert vectors.nearest(df, q.limit(0), "id", "v", 4, "g").count() == 0 and vectors.nearest(df.limit(0), q, "id", "v", 4, "g").count() == 0


def test_pooling():
    hidden = np.array([[[3.0, 4.0], [1.0, 0.0], [9.0, 9.0]], [[0.0, 2.0], [0.0, 0.0], [5.0, 5.0]]])
    mask = np.array([[1, 1, 0], [1, 0, 0]])
    assert np.allclose(vectors.pooled(hidden, mask, "cls"), [[0.6, 0.8], [0, 1]])
    assert np.allclose(vectors.pooled(hidden, mask, "mean"), [[2**-0.5, 2**-0.5], [0, 1]])
    with pytest.raises(ValueError):
        vectors.pooled(hidden, mask, "max")


def field(n, value):
    """One field of a binary model file."""

    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    return varint(n << 3) + varint(value) if isinstance(value, int) else varint(n << 3 | 2) + varint(len(value)) + value


def model_file(path, weight):
    """A model whose token vectors are the rows of ``weight``."""

    def tensor(name, kind, dims):
        shape = b"".join(field(1, field(2, d.encode()) if isinstance(d, str) else field(1, d)) for d in dims)
        return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))

    held = b"".join(field(1, d) for d in weight.shape) + field(2, 1) + field(8, b"w") + field(9, weight.astype("<f4").tobytes())
    node = field(1, b"w") + field(1, b"input_ids") + field(2, b"out") + field(4, b"Gather")
    graph = field(1, node) + field(2, b"g") + field(5, held) + field(11, tensor(b"input_ids", 7, ["b", "t"])) + field(12, tensor(b"out", 1, ["b", "t", weight.shape[1]]))
    path.write_bytes(field(1, 8) + field(7, graph) + field(8, field(1, b"") + field(2, 13)))


@pytest.fixture
def folder(tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("onnxruntime")
    vocabulary = {"[PAD]": 0, "[UNK]": 1, "query": 2, "logon": 3, "failed": 4, ":": 5}
    t = tokenizers.Tokenizer(tokenizers.models.WordLevel(vocabulary, "[UNK]"))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    t.save(str(tmp_path / "tokenizer.json"))
    model_file(tmp_path / "model.onnx", np.array([[9, 9], [0, 1], [1, 1], [1, 0], [3, 4], [0, 2]], float))
    return str(tmp_path)


def test_model_of_a_folder(spark, folder):
    e = vectors.model_folder(folder, dimension=2, pooling="mean", query_prefix="query: ", batch=2)
    assert isinstance(e, vectors.ModelEmbedder) and isinstance(vectors.model_folder("/no/such"), vectors.HashingEmbedder)
    got = e.embed(["logon", "logon failed", "other"])
    assert np.allclose(got, [[1, 0], [2**-0.5, 2**-0.5], [0, 1]], atol=1e-6)
    assert np.allclose(e.embed_query("failed"), np.array([4.0, 7.0]) / np.sqrt(65), atol=1e-6)
    first = vectors.model_folder(folder, dimension=2, pooling="cls")
    assert np.allclose(first.embed(["failed logon"]), [[0.6, 0.8]], atol=1e-6) and np.allclose(vectors.query_vector(first, "logon"), [1, 0])
    rows = spark.createDataFrame([(1, "logon"), (2, None)], "id long, t string")
    assert [len(r["embedding"]) for r in vectors.embedded(rows, "t", vectors.HashingEmbedder(8)).collect()] == [8, 8]
    assert np.allclose(vectors.embedded(rows.where("id = 1"), "t", e).first()["embedding"], [1, 0])


def test_dense_and_sparse_together(spark):
    rows = [(1, "Failed logon of a user"), (2, "logon ok, LOGON again"), (3, None), (4, "something else")]
    df = spark.createDataFrame(rows, "id long, t string")
    e = vectors.HashingEmbedder(16)
    h = {r["id"]: r for r in vectors.hybrid(df, "id", "t", e).collect()}
    sparse = {(r["id"], r["term"]): r["weight"] for r in vectors.sparse(df, "id", "t").collect()}
    assert sparse == {(i, t): w for i, r in h.items() for t, w in r["terms"].items()} and h[3]["terms"] == {} and len(h[3]["embedding"]) == 16
    dense, idf = vectors.hybrid_query(df, "t", "Failed logon?", e)
    assert np.allclose(dense, e.embed(["Failed logon?"])[0])
    score = {i: sum(idf[t] * r["terms"].get(t, 0.0) for t in idf) for i, r in h.items()}
    told = {r["id"]: r["score"] for r in vectors.bm25(df, "id", "t", ["failed", "logon"]).collect()}
    assert {i: pytest.approx(s) for i, s in score.items() if s} == told
