from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import templates, vectors, views
from tracewright.plans.ingest import TABLES, fingerprint, sync
from tracewright.streaming.incremental import EntityStore, TemplateStore, VectorStore

COLUMNS = "RecordID string, TimeCreated string, EventID string, LevelName string, Channel string, Provider string, Computer string, ProcessID string, EventData string, Message string"
ROWS = [(str(i), f"2026-09-15T10:00:{i:02d}Z", "4624", "LogAlways", "Security", "P", "H", "672", '{"IpAddress":"10.0.0.%d"}' % i, f"logon {i} ok") for i in range(12)]


def test_sync_reloads_only_changed_content(spark, tmp_path):
    df = spark.createDataFrame(ROWS, COLUMNS)
    uid = F.col("RecordID").cast("long")
    a = sync(spark, df, uid, str(tmp_path))
    assert a["reloaded"] and a["canonical_logs"] == a["template_instances"] == 12 and a["log_templates"] == 1
    assert not sync(spark, df.repartition(3), uid, str(tmp_path))["reloaded"]
    changed = df.withColumn("Message", F.when(F.col("RecordID") == "3", "other").otherwise(F.col("Message")))
    b = sync(spark, changed, uid, str(tmp_path))
    assert b["reloaded"] and b["sync_id"] != a["sync_id"]
    assert sync(spark, changed, uid, str(tmp_path), force=True)["reloaded"]
    assert all((tmp_path / b["sync_id"] / t).is_dir() for t in TABLES)
    assert fingerprint(df.limit(0)) == (0, 0)


def test_entity_store_numbers_on_and_skips_known_records(spark, tmp_path):
    df, store = spark.createDataFrame(ROWS, COLUMNS), EntityStore(spark, str(tmp_path / "e"))
    store.add(df.where("RecordID < '2'"))
    store.add(df)
    store.add(df)
    ids = [r[0] for r in store.index().select("correlation_id").collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1)) and store.index().select("event_record_id").distinct().count() == 12
    assert len(ids) == 12 * 3


def test_vector_store_embeds_only_what_changed(spark, tmp_path):
    t = spark.createDataFrame([("a", "text one", 1, "t1"), ("b", "text two", 1, "t1")], "template_id string, template_string string, total_count long, last_seen_utc string")
    store = VectorStore(spark, str(tmp_path / "v"), vectors.HashingEmbedder(16))
    assert store.add(t) == {"embed": 2, "update": 0, "skip": 0}
    assert store.add(t) == {"embed": 0, "update": 0, "skip": 2}
    u = spark.createDataFrame([("a", "text one", 5, "t2"), ("b", "text 2 new", 1, "t1"), ("c", "three", 1, "t1")], t.schema)
    assert store.add(u) == {"embed": 2, "update": 1, "skip": 0}
    got = {r["template_id"]: r for r in store.vectors().collect()}
    assert set(got) == {"a", "b", "c"} and got["a"]["total_count"] == 5 and len(got["c"]["embedding"]) == 16


def test_findings(spark):
    df = spark.createDataFrame(ROWS, COLUMNS).withColumn("ts", F.to_timestamp("TimeCreated"))
    f = views.findings(df, "ts", 24, 1)
    assert f["records"] == 12 and f["duration"] == "11s" and f["hosts"] == ["H"] and f["scope_percent"] == 50.0 and f["events"][0][2] == "Successful account logon"
    assert "Records: 12" in views.card("q", f)
    assert "No records" in views.card("q", views.findings(df.limit(0), "ts"))


PREPARED = "record_id string, seq long, channel string, provider string, event_id string, level string, time string, masked string"


def random_texts(n, seed=1):
    r = random.Random(seed)
    words = ["disk", "logon", "of", "user", "failed", "ok", "on", "port", "7", "x9", "from", "net"]
    return [(str(i), i, r.choice(["Security", "System"]), "P", "1", "Information", f"t{i:04d}", " ".join(r.choice(words) for _ in range(r.choice([3, 5, 6])))) for i in range(n)]


@pytest.mark.parametrize("settings", [templates.Settings(), templates.Settings(0.6, 5, 3), templates.Settings(max_clusters=4)])
def test_batches_give_what_one_run_gives(spark, tmp_path, settings):
    rows = random_texts(240)
    df = spark.createDataFrame(rows, PREPARED)
    whole = {r["seq"]: r["cluster"] for r in templates.mine(df, settings).select("seq", "cluster").collect()}
    store = TemplateStore(spark, str(tmp_path / "s"), settings)
    for a, b in ((0, 100), (100, 103), (50, 240)):  # rows that come again are left out
        store.add(df.where(f"seq >= {a} and seq < {b}"))
        store = TemplateStore(spark, str(tmp_path / "s"), settings)  # a new process goes on with what is stored
    ids = {r["instance_id"]: int(r["template_id"].rsplit("_", 1)[1]) for r in store.instances().collect()}
    assert ids == whole and store.version() == 2
    assert templates.integrity(df, store.instances(), store.templates()).first()["integrity_valid"]
    texts = {(r["channel"], r["cluster"]): r["template_string"] for r in store.clusters().collect()}
    if settings.max_clusters > 100:
        assert texts == {(r["channel"], r["cluster"]): r["template_string"] for r in templates.mine(df, settings).collect()}


def test_a_batch_that_failed_is_written_again(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(random_texts(60), PREPARED)
    store = TemplateStore(spark, str(tmp_path / "s"))
    store.add(df.where("seq < 30"))
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(templates, "instances", lambda _: (_ for _ in ()).throw(RuntimeError()))
        store.add(df)
    assert store.version() == 0 and store.instances().count() == 30
    assert store.add(df) == 30
    assert templates.integrity(df, store.instances(), store.templates()).first()["integrity_valid"]


def test_the_cluster_joined_longest_ago_leaves_the_tree():
    t = templates.Tree(templates.Settings(max_clusters=2))
    a, b = t.add("a b c".split(), 1), t.add("d e f".split(), 2)
    assert t.add("a b x".split(), 3) == a
    c = t.add("g h i".split(), 4)
    assert b not in t.live and {a, c} == set(t.live)
    assert t.add("d e f".split(), 5) not in (a, b, c)


def test_settings_of_an_ini_file(tmp_path):
    p = tmp_path / "m.ini"
    p.write_text("[DRAIN]\nsim_th = 0.7\ndepth = 5\nmax_clusters = 50\nparametrize_numeric_tokens = false\n[MASKING]\nmasking = []\n")
    assert templates.Settings.from_ini(str(p)) == templates.Settings(0.7, 5, 100, 50, False)
    p.write_text("[OTHER]\n")
    assert templates.Settings.from_ini(str(p)) == templates.Settings()


def test_a_hundred_thousand_signatures_have_numbers_of_their_own(spark, tmp_path):
    n = 100_000
    word = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    df = spark.range(n).select(F.col("id").cast("string").alias("record_id"), F.col("id").alias("seq"), F.lit("Security").alias("channel"), F.lit("P").alias("provider"), F.lit("1").alias("event_id"), F.lit("Error").alias("level"), F.lit("t").alias("time"), F.concat(word, F.lit(" a "), word).alias("masked"))
    store = TemplateStore(spark, str(tmp_path / "s"), templates.Settings(max_children=n, max_clusters=None))
    store.add(df.where("seq < 60000"))
    store.add(df)
    assert store.templates().count() == n and store.instances().select("template_id").distinct().count() == n
    assert store.clusters().agg(F.max("cluster")).first()[0] == n
