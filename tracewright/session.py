"""Session helpers: checkpoint folder, size-checked broadcast, partition sizing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder: the session's own, else that of ``spark.checkpoint.dir``; on a local master also a temporary one.

    Other masters have no folder that all machines see unless they name one, so without it
    this is an error. What is written there is compressed, and removed by Spark's cleaner as
    soon as nothing refers to it any more, unless the session says otherwise.
    """
    sc = spark.sparkContext
    conf = sc._jsc.sc().conf()
    conf.setIfMissing("spark.checkpoint.compress", "true")
    conf.setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    sc.setCheckpointDir(checkpoint_root(sc.master, sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint_root(master: str, named: str | None) -> str:
    """Where checkpoints may go."""
    if named:
        return named
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return tempfile.mkdtemp(prefix="tracewright-")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, removed when the session's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()


def parallelism(spark: SparkSession) -> int:
    """Partitions of a shuffle as the session sets them, one at least."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))


#: Bytes of text and values that a hinted broadcast may have, about.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if a bounded look shows at most ``max_rows`` rows of ``max_bytes`` in all; else leave the join to the planner.

    The look stops after ``max_rows + 1`` rows, so it costs no full scan of a large side.
    """
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    width = sum(texts, F.lit(16 * len(df.columns)))
    n, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return F.broadcast(df) if n <= max_rows and (size or 0) <= max_bytes else df


def fresh(columns: list[str], wanted: str) -> str:
    """A column name that starts with ``wanted`` and clashes (in any case) with none of ``columns``."""
    taken, name, n = {c.lower() for c in columns}, wanted, 0
    while name.lower() in taken:
        n += 1
        name = f"{wanted}_{n}"
    return name


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a context: Python workers there need not see the driver's folders."""
    sc = spark.sparkContext
    if getattr(sc, "_tracewright_shipped", False):
        return
    import importlib.util
    import os
    import zipfile

    root = os.path.dirname(importlib.util.find_spec("tracewright").origin)
    path = os.path.join(tempfile.mkdtemp(prefix="tracewright-"), "tracewright.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._tracewright_shipped = True
