"""Embeddings, pre-filtered nearest vectors, and BM25."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tracewright.session import cut

_TERM = re.compile("[a-z0-9]+")
#: Bytes of query vectors that one pass holds; more queries are searched in blocks.
QUERY_BYTES = 64_000_000


class Embedder(Protocol):
    """Anything that turns texts into unit vectors of one length."""

    dimension: int
    name: str

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Bag of tokens, hashed with signs into a fixed number of places, to unit length; needs no model files."""

    def __init__(self, dimension: int = 384):
        self.dimension, self.name = dimension, f"hashing-{dimension}"

    def embed(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, t in enumerate(texts):
            for token in re.findall(r"[\w<>*]+", (t or "").lower()):
                h = xxhash.xxh64_intdigest(token)
                out[i, h % self.dimension] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1.0)


def pooled(hidden: np.ndarray, mask: np.ndarray, how: str) -> np.ndarray:
    """Unit vectors of token vectors (texts, tokens, dimension): of the first token (``cls``), or the mean over those that ``mask`` counts (``mean``)."""
    if how == "cls":
        out = hidden[:, 0].astype(np.float64)
    elif how == "mean":
        m = mask[:, :, None].astype(np.float64)
        out = (hidden * m).sum(1) / np.maximum(m.sum(1), 1.0)
    else:
        raise ValueError(how)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1.0)).astype(np.float32)


class ModelEmbedder:
    """A transformer from a local folder (``tokenizer.json`` and ``model.onnx``), read where it is first used.

    ``pooling``: ``cls`` or ``mean``; ``query_prefix`` goes in front of questions but not of
    texts; texts go through the model ``batch`` at a time, up to ``longest`` tokens. The
    folder must be there on every machine; the object itself is small and travels with tasks.
    """

    def __init__(self, folder: str, dimension: int = 384, pooling: str = "cls", query_prefix: str = "", batch: int = 32, longest: int = 512, name: str | None = None):
        self.folder, self.dimension, self.pooling, self.query_prefix, self.batch, self.longest = folder, dimension, pooling, query_prefix, batch, longest
        self.name = name or os.path.basename(folder.rstrip("/"))
        self._loaded = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": None}

    def _model(self):
        if self._loaded is None:
            import onnxruntime
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(os.path.join(self.folder, "tokenizer.json"))
            tokenizer.enable_truncation(self.longest)
            tokenizer.enable_padding()
            session = onnxruntime.InferenceSession(os.path.join(self.folder, "model.onnx"), providers=["CPUExecutionProvider"])
            wanted = {i.name for i in session.get_inputs()}

            def forward(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
                e = tokenizer.encode_batch(texts)
                given = {"input_ids": [x.ids for x in e], "attention_mask": [x.attention_mask for x in e], "token_type_ids": [x.type_ids for x in e]}
                given = {k: np.array(v, np.int64) for k, v in given.items()}
                return session.run(None, {k: v for k, v in given.items() if k in wanted})[0], given["attention_mask"]

            self._loaded = forward
        return self._loaded

    def embed(self, texts: list[str]) -> np.ndarray:
        forward = self._model()
        parts = [pooled(*forward(texts[k : k + self.batch]), self.pooling) for k in range(0, len(texts), self.batch)]
        return np.concatenate(parts) if parts else np.zeros((0, self.dimension), np.float32)

    def embed_query(self, question: str) -> np.ndarray:
        return self.embed([self.query_prefix + question])[0]


def query_vector(embedder: Embedder, question: str) -> np.ndarray:
    """Vector of a question; an embedder with a way of its own for questions takes that."""
    own = getattr(embedder, "embed_query", None)
    return own(question) if own else embedder.embed([question])[0]


def model_folder(folder: str | None, **options: object) -> Embedder:
    """The model of a folder if it is there, else the hashing embedder that needs no files."""
    if folder and all(os.path.isfile(os.path.join(folder, f)) for f in ("tokenizer.json", "model.onnx")):
        return ModelEmbedder(folder, **options)
    return HashingEmbedder()


def embedded(df: DataFrame, text: str, embedder: Embedder, out: str = "embedding") -> DataFrame:
    """``df`` plus the vector of a text column; null text is embedded as empty text."""

    @pandas_udf("array<float>")
    def vector(t: pd.Series) -> pd.Series:
        return pd.Series(list(embedder.embed([x or "" for x in t])))

    return df.withColumn(out, vector(F.col(text)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def nearest(rows: DataFrame, queries: DataFrame, row_id: str, vector: str, k: int, same: str | None = None, digits: int = 6) -> DataFrame:
    """(query_id, row_id, score, rank): the ``k`` rows of highest cosine for each query, other than itself; ties go to the smaller id.

    ``same``: a column in which query and row must agree. Rows of other values are left out
    in the scan, and vectors are multiplied value by value, never across. Queries go to the
    tasks in blocks of ``QUERY_BYTES``; each task keeps its own best k of each query, so what
    is shuffled is bounded by queries, k and tasks. Rows without vector, and queries without
    vector or value, have no neighbours.
    """
    spark = rows.sparkSession
    meta = [same] if same else []
    asked = queries.where(F.col(vector).isNotNull())
    src = rows.where(F.col(vector).isNotNull()).select(row_id, vector, *meta)
    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    blocks = max(1, -(-n * (width or 1) * 8 // QUERY_BYTES))
    keyed = asked.select(row_id, vector, *meta).withColumn("b", F.pmod(F.xxhash64(row_id), F.lit(blocks)))
    id_type = rows.schema[row_id].dataType.simpleString()
    out = None
    for b in range(blocks):
        block = [r for r in keyed.where(F.col("b") == b).drop("b").collect() if not same or r[2] is not None]  # about QUERY_BYTES
        values = sorted({r[2] for r in block}) if same else []
        own = src.where(F.col(same).isin(values)) if same and len(values) <= SCAN_VALUES else src
        held = spark.sparkContext.broadcast(([r[0] for r in block], np.array([r[1] for r in block], float), [r[2] for r in block] if same else None))
        part = own.mapInArrow(_scorer(held, k, digits), f"query_id {id_type}, `{row_id}` {id_type}, score double")
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), row_id)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: More values of ``same`` than this are not named in the scan.
SCAN_VALUES = 1_000


def _best(query: np.ndarray, score: np.ndarray, rid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k entries of highest score, then smallest id, of each query."""
    order = np.lexsort((rid, -score, query))
    query, score, rid = query[order], score[order], rid[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return query[place < k], score[place < k], rid[place < k]


def _scorer(held, k: int, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, meta = held.value
        if not ids:
            return
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        own: dict = {}
        for i, m in enumerate(meta if meta is not None else [None] * len(ids)):
            own.setdefault(m, []).append(i)
        kept = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object))
        waiting: list[tuple] = []
        size = 0

        def settled() -> tuple:
            query, score, rid = (np.concatenate(x) for x in zip(kept, *waiting))
            distinct, rank = np.unique(rid, return_inverse=True)  # ids of any type are compared by rank
            query, score, rank = _best(query, score, rank, k)
            return query, score, distinct[rank]

        for b in batches:
            if not b.num_rows:
                continue
            rid = np.array(b.column(0).to_pylist(), object)
            v = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(float)
            norm = np.linalg.norm(v, axis=1)
            v = v / np.maximum(norm, 1e-300)[:, None]
            of = b.column(2).to_pylist() if meta is not None else None
            groups: dict = {None: np.flatnonzero(norm > 0)} if of is None else {}
            for j, m in enumerate(of or []):
                if m in own and norm[j] > 0:
                    groups.setdefault(m, []).append(j)
            for m, at in groups.items():
                mine, at = np.array(own[m]), np.asarray(at)
                s = np.round(q[mine] @ v[at].T, digits)
                s[np.array([ids[i] for i in mine], object)[:, None] == rid[at][None, :]] = -np.inf
                if s.shape[1] > k:
                    edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                    a, c = np.nonzero((s >= edge[:, None]) & (s > -np.inf))  # with all ties at the edge
                else:
                    a, c = np.nonzero(s > -np.inf)
                waiting.append((mine[a], s[a, c], rid[at[c]]))
                size += len(a)
            if size > max(1_000_000, 4 * len(kept[0])):
                kept, waiting, size = settled(), [], 0
        query, score, rid = settled() if waiting else kept
        for i in range(0, len(query), 50_000):
            p = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in query[p].tolist()]), pa.array(rid[p].tolist()), pa.array(score[p] + 0.0, pa.float64())], ["query_id", "row", "score"])

    return run


def model_metadata(embedder: Embedder) -> dict:
    """What an index should say about the vectors in it."""
    return {"model_name": embedder.name, "dimension": embedder.dimension, "distance": "cosine", "normalised": True}


def changed(templates: DataFrame, indexed: DataFrame) -> DataFrame:
    """``templates`` plus ``action``: embed (new, or its text differs), update (only counts or times differ) or skip."""
    old = indexed.select(F.col("template_id").alias("__t"), F.col("text_hash").alias("__h"), F.col("total_count").alias("__n"), F.col("last_seen_utc").alias("__l"))
    j = templates.withColumn("text_hash", F.sha1(F.col("template_string"))).join(old, F.col("template_id") == F.col("__t"), "left")
    action = F.when(F.col("__t").isNull() | ~F.col("text_hash").eqNullSafe(F.col("__h")), F.lit("embed")).when(~F.col("total_count").eqNullSafe(F.col("__n")) | ~F.col("last_seen_utc").eqNullSafe(F.col("__l")), F.lit("update")).otherwise(F.lit("skip"))
    return j.withColumn("action", action).drop("__t", "__h", "__n", "__l")


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def occurrences(lowered: Column, term: str) -> Column:
    """How often a lower-case text has a term as a whole token; texts without it are not searched token by token."""
    if not _TERM.fullmatch(term):
        return F.lit(0)
    return F.when(F.contains(lowered, F.lit(term)), F.regexp_count(lowered, F.lit(f"(?<![a-z0-9]){term}(?![a-z0-9])"))).otherwise(0)


def bm25(docs: DataFrame, doc_id: str, text: str, terms: list[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(doc_id, score) of documents with any of the terms. Counts cover all documents with text; no token is listed."""
    terms = sorted(set(terms))
    d = docs.where(F.col(text).isNotNull()).select(F.col(doc_id), F.lower(F.col(text)).alias("t"))
    d = d.select(doc_id, F.regexp_count("t", F.lit("[a-z0-9]+")).alias("len"), *[occurrences(F.col("t"), x).alias(f"tf{i}") for i, x in enumerate(terms)])
    d = cut(d)  # texts are read once; what is kept of each is a few numbers
    stats = d.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *[F.sum(F.when(F.col(f"tf{i}") > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        df_ = stats[f"df{i}"] or 0
        idf = float(np.log(1.0 + ((stats["n"] or 0) - df_ + 0.5) / (df_ + 0.5)))
        tf = F.col(f"tf{i}").cast("double")
        score = score + F.lit(idf) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.lit(float(stats["avg"] or 1.0))))
    return d.withColumn("score", score).where("score > 0").select(doc_id, "score")


def _average_length(docs: DataFrame, text: str) -> float:
    return docs.where(F.col(text).isNotNull()).agg(F.avg(F.regexp_count(F.lower(F.col(text)), F.lit("[a-z0-9]+")))).first()[0] or 1.0


def sparse(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, term, weight): term frequencies damped by length, the document side of BM25 as sparse vectors. Terms are counted within the row; nothing is moved."""
    avg, kind = _average_length(docs, text), docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, terms, weights = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                found = weights_of(t, avg)
                at += [i] * len(found)
                terms += found.keys()
                weights += found.values()
                if len(at) > 200_000:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(terms, pa.string()), pa.array(weights, pa.float64())], [doc_id, "term", "weight"])
                    at, terms, weights = [], [], []
            if at:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(terms, pa.string()), pa.array(weights, pa.float64())], [doc_id, "term", "weight"])

    lowered = docs.where(F.col(text).isNotNull()).select(F.col(doc_id), F.lower(F.col(text)).alias("t"))
    return lowered.mapInArrow(run, f"`{doc_id}` {kind}, term string, weight double")


def weights_of(lowered: str, average: float, k1: float = 1.5, b: float = 0.75) -> dict[str, float]:
    """Weight of each term of a lower-case text."""
    found = _TERM.findall(lowered)
    damp = k1 * (1 - b + b * len(found) / average)
    return {t: n * (k1 + 1) / (n + damp) for t, n in Counter(found).items()}


def hybrid(docs: DataFrame, doc_id: str, text: str, embedder: Embedder) -> DataFrame:
    """(doc_id, embedding, terms): dense vector and sparse weights (a map) of each text, null text as empty text."""
    avg = _average_length(docs, text)

    @pandas_udf("map<string,double>")
    def terms(t: pd.Series) -> pd.Series:
        return pd.Series([weights_of(x or "", avg) for x in t])

    return embedded(docs.select(doc_id, text), text, embedder).select(doc_id, "embedding", terms(F.lower(F.col(text))).alias("terms"))


def hybrid_query(docs: DataFrame, text: str, question: str, embedder: Embedder) -> tuple[np.ndarray, dict[str, float]]:
    """(dense vector, inverse document frequency of each term) of a question over the given texts; the product of the terms with a text's weights is its BM25 score."""
    terms = sorted(set(_TERM.findall(question.lower())))
    d = docs.where(F.col(text).isNotNull()).select(tokens(F.col(text)).alias("w"))
    n, *held = d.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(F.array_contains("w", t).cast("int")), F.lit(0)) for t in terms]).first()
    return query_vector(embedder, question), {t: float(np.log(1.0 + (n - h + 0.5) / (h + 0.5))) for t, h in zip(terms, held)}
