"""Bringing a table of records and everything derived from it to a folder, only when its content changed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import correlate, templates, vectors
from tracewright.streaming.incremental import _stored

TABLES = ["canonical_logs", "log_templates", "template_instances", "entity_correlations", "template_vectors"]


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """(rows, sum of row hashes): the same for equal content in any order, and in all likelihood for nothing else."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    n, s = df.agg(F.count(F.lit(1)), F.sum(F.pmod(h, F.lit(1 << 40)))).first()
    return n, s or 0


def sync(spark: SparkSession, records: DataFrame, seq: F.Column, folder: str, force: bool = False, embedder: vectors.Embedder | None = None) -> dict:
    """Write records, templates, instances, entity index and template vectors under a new sync id, unless the newest one has the same content.

    All tables of a sync share its id, so nothing of an older load is mixed in; the log of
    syncs is written last, so that a load that fails half-way does not count.
    """
    log = _stored(spark, f"{folder}/syncs")
    rows, content = fingerprint(records)
    if log is not None and not force:
        last = log.orderBy(F.desc("n")).first()
        if (last["rows"], last["content"]) == (rows, content):
            return {"reloaded": False, "sync_id": last["sync_id"], "rows": rows}
    n = 0 if log is None else log.agg(F.max("n")).first()[0] + 1
    sync_id, embedder = uuid.uuid4().hex[:12], embedder or vectors.HashingEmbedder()
    at = lambda t: f"{folder}/{sync_id}/{t}"
    records.withColumn("row_uid", seq).write.parquet(at(TABLES[0]))
    stored = spark.read.parquet(at(TABLES[0]))
    mined = templates.mine(templates.prepared(stored, F.col("row_uid")))
    templates.rollup(mined).write.parquet(at(TABLES[1]))
    templates.instances(mined).write.parquet(at(TABLES[2]))
    correlate.build_index(stored).write.parquet(at(TABLES[3]))
    vectors.embedded(templates.representative(spark.read.parquet(at(TABLES[1]))), "text", embedder).write.parquet(at(TABLES[4]))
    spark.createDataFrame([(n, sync_id, rows, content)], "n long, sync_id string, rows long, content long").write.mode("append").parquet(f"{folder}/syncs")
    return {"reloaded": True, "sync_id": sync_id, "rows": rows} | {t: spark.read.parquet(at(t)).count() for t in TABLES}
