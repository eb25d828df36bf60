"""Incremental and streaming maintenance: derived tables that grow with new records only.

State lives in parquet folders. Batches are idempotent: a record that is mapped already is
left out by an anti-join on its key, so a batch that runs again after a failure adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewright.operators import correlate, templates, vectors
from tracewright.operators.order import numbered_within
from tracewright.session import cut


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A parquet folder, None where there is none yet."""
    jvm = spark._jvm.org.apache.hadoop.fs
    p = jvm.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.parquet(path)


def new_rows(batch: DataFrame, key: str, stored: DataFrame | None, stored_key: str) -> DataFrame:
    """Rows of the batch whose key is not stored; of repeated keys within the batch one stays."""
    b = batch.dropDuplicates([key])
    return b if stored is None else templates.unmapped(b, key, stored, stored_key)


class TemplateStore:
    """Mined templates, their instances, and the trees that mine them, kept in a folder.

    Trees go on where the last batch left them; known texts keep their cluster, and clusters
    keep their number, so batches in the order of the records give what one run over all
    would. Every batch writes its tables under a version of its own, and the version counts
    once all of them are there: a batch that fails half-way is simply written again.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: templates.Settings | None = None):
        self.spark, self.folder, self.settings = spark, folder, settings

    def version(self) -> int:
        """The last complete version, -1 if there is none."""
        done = _stored(self.spark, f"{self.folder}/commits")
        return -1 if done is None else done.agg(F.max("n")).first()[0]

    def _table(self, name: str, newest: bool) -> DataFrame | None:
        v, t = self.version(), _stored(self.spark, f"{self.folder}/{name}")
        if t is None or v < 0:
            return None
        return t.where((F.col("v") == v) if newest else (F.col("v") <= v)).drop("v")

    def instances(self) -> DataFrame | None:
        return self._table("instances", False)

    def templates(self) -> DataFrame | None:
        return self._table("templates", True)

    def clusters(self) -> DataFrame | None:
        """What the trees remember (see ``templates.CLUSTERS``), with each cluster's number."""
        return self._table("clusters", True)

    def add(self, records: DataFrame) -> int:
        """Template new records (as from ``templates.prepared``); returns how many were new."""
        fresh = cut(new_rows(records, "seq", self.instances(), "instance_id"))
        n = fresh.count()
        if not n:
            return 0
        known, old, v = self._table("signatures", False), self.clusters(), self.version() + 1
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{self.folder}/{name}/v={v}")
        texts = fresh.groupBy("channel", "masked").agg(F.min("seq").alias("first"))
        if known is not None:
            texts = texts.join(known, ["channel", "masked"], "left_anti")
        found, grown = templates.walk(texts, None if old is None else old.drop("cluster"), self.settings)
        put(found.select("channel", "masked", "opener"), "signatures")
        if old is None:
            clusters = numbered_within(grown, "channel", ["opened", "opener"], "cluster")
        else:
            opened = numbered_within(grown.join(old.select("channel", "opener"), ["channel", "opener"], "left_anti"), "channel", ["opened", "opener"], "nth")
            last = old.groupBy("channel").agg(F.max("cluster").alias("last"))
            opened = opened.join(last, "channel", "left").withColumn("cluster", F.col("nth") + F.coalesce("last", F.lit(0))).drop("nth", "last")
            grown = grown.join(old.select("channel", "opener", "cluster"), ["channel", "opener"])
            rest = old.join(grown.select("channel", "opener"), ["channel", "opener"], "left_anti")
            clusters = opened.unionByName(grown).unionByName(rest)
        put(clusters, "clusters")
        here = self.spark.read.parquet(f"{self.folder}/clusters/v={v}").select("channel", "opener", "cluster", "template_string")
        told = self.spark.read.parquet(f"{self.folder}/signatures").where(F.col("v") <= v).drop("v").join(here, ["channel", "opener"]).drop("opener")
        mined = cut(fresh.join(told, ["channel", "masked"]))
        added, stored = templates.rollup(mined), self.templates()
        put(added if stored is None else templates.merge(stored, added), "templates")
        put(templates.instances(mined), "instances")
        self.spark.createDataFrame([(v,)], "n int").write.mode("append").parquet(f"{self.folder}/commits")
        return n

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``."""
        return lambda batch, _: self.add(batch) and None


class EntityStore:
    """The entity index, kept in a folder; records that have entities there are left out when they come again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def index(self) -> DataFrame | None:
        return _stored(self.spark, self.path)

    def add(self, records: DataFrame) -> None:
        correlate.build_index(records, self.index()).write.mode("append").parquet(self.path)


class VectorStore:
    """One vector a template: new or changed texts are embedded, other changes only rewrite their figures, the rest stays.

    Each change is a new version of the folder; the newest one counts.
    """

    def __init__(self, spark: SparkSession, path: str, embedder: vectors.Embedder):
        self.spark, self.path, self.embedder = spark, path, embedder

    def vectors(self) -> DataFrame | None:
        t = _stored(self.spark, self.path)
        return None if t is None else t.where(F.col("v") == t.agg(F.max("v")).first()[0]).drop("v")

    def add(self, templates_: DataFrame) -> dict[str, int]:
        """Bring the store up to date with a template table; returns how many were embedded, updated and skipped."""
        old = self.vectors()
        if old is None:
            todo = templates_.withColumn("text_hash", F.sha1("template_string")).withColumn("action", F.lit("embed"))
        else:
            todo = vectors.changed(templates_, old)
        done = {r["action"]: r["count"] for r in todo.groupBy("action").count().collect()}
        if set(done) - {"skip"}:
            new = vectors.embedded(todo.where("action = 'embed'").drop("action"), "template_string", self.embedder)
            if old is not None:
                kept = todo.where("action <> 'embed'").drop("action").join(old.select("template_id", "embedding"), "template_id")
                gone = old.join(templates_.select("template_id"), "template_id", "left_anti")
                new = new.unionByName(kept).unionByName(gone, allowMissingColumns=True)
            version = 0 if old is None else _stored(self.spark, self.path).agg(F.max("v")).first()[0] + 1
            new.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        return {k: done.get(k, 0) for k in ("embed", "update", "skip")}


def append_new(spark: SparkSession, path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that appends rows with keys not stored yet."""

    def run(batch: DataFrame, _: int) -> None:
        new_rows(batch, key, _stored(spark, path), key).write.mode("append").parquet(path)

    return run


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything there is now, in batches, then stop; the checkpoint makes the next run go on from there."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, by: list[str], length: str = "10 minutes", step: str = "8 minutes", late: str = "5 seconds") -> DataFrame:
    """Counts per sliding window and ``by``; windows follow the clock, and rows later than ``late`` are dropped by the watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, length, step), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n")


def session_counts(stream: DataFrame, ts: str, by: list[str], gap: str = "30 minutes", late: str = "5 seconds") -> DataFrame:
    """Counts per session of ``by``, closed by a pause."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *by, "n")


def running_totals(stream: DataFrame, key: str, value: Column) -> DataFrame:
    """Totals per key over all micro-batches, as custom state: (key, n, total) after each batch."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["v"].sum())
        state.update((n, total))
        yield pd.DataFrame({"key": [k[0]], "n": [n], "total": [total]})

    rows = stream.select(F.col(key).cast("string").alias("key"), value.cast("double").alias("v"))
    return rows.groupBy("key").applyInPandasWithState(update, "key string, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)
