from __future__ import annotations

import gc
import os
import time

import pytest

from tracewright.session import broadcast_if_small, checkpoint_root, cut, ensure_checkpoint_dir


def test_only_a_local_master_goes_without_a_shared_folder():
    assert checkpoint_root("spark://host:7077", "/shared/x") == "/shared/x"
    assert os.path.isdir(checkpoint_root("local[2]", None))
    with pytest.raises(RuntimeError):
        checkpoint_root("spark://host:7077", None)


def test_checkpoints_are_removed_when_nothing_needs_them(spark):
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    df = cut(spark.range(1000).selectExpr("id", "id % 7 AS k"))
    kept = set(os.listdir(root)) - before
    assert df.groupBy("k").count().count() == 7 and kept
    del df
    for _ in range(40):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)
        if not kept & set(os.listdir(root)):
            break
    assert not kept & set(os.listdir(root))


def test_broadcasts_are_bounded_in_rows_and_bytes(spark):
    df = spark.range(100).selectExpr("id", "repeat('x', 1000) AS t", "CAST(NULL AS string) AS u")
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(broadcast_if_small(df, 100)) and not hinted(broadcast_if_small(df, 99)) and not hinted(broadcast_if_small(df, 100, 100_000))
    assert hinted(broadcast_if_small(df.limit(0), 1))
