from __future__ import annotations

import random

from pyspark.sql import functions as F

from tracewright.operators import correlate, templates

COLS = "RecordID string, TimeCreated string, EventID string, LevelName string, Channel string, Provider string, Message string, EventData string"


def rec(i, event, text, level="Information", channel="Security", provider="P", data=None, time=None):
    return (str(i), time or f"2026-09-15T10:{i % 60:02d}:00Z", event, level, channel, provider, text, data)


def prepared(spark, rows):
    return templates.prepared(spark.createDataFrame(rows, COLS), F.col("RecordID").cast("long"))


def test_repetitive_messages_collapse(spark):
    rows = [rec(i, "4624", f"An account was successfully logged on from 192.168.1.{i} port {i + 1000}") for i in range(85)]
    rows += [rec(85 + i, "4634", f"An account was logged off. Session {i}") for i in range(15)]
    t = templates.rollup(templates.mine(prepared(spark, rows))).orderBy(F.desc("total_count")).collect()
    assert [r["total_count"] for r in t] == [85, 15]
    assert t[0]["template_id"].startswith("TPL_SECURITY_4624_") and "<IP>" in t[0]["template_string"] and "<*>" in t[0]["template_string"]


def test_three_patterns(spark):
    rows = [rec(i, "4625", f"Failed logon for user u{i} from 10.0.0.{i % 250}", "Error") for i in range(80)]
    rows += [rec(100 + i, "7036", f"The service S{i} entered the running state now", channel="System") for i in range(15)]
    rows += [rec(200 + i, "1000", f"Faulting application C:\\apps\\a{i}.exe", channel="Application") for i in range(10)]
    p = prepared(spark, rows)
    m = templates.mine(p)
    t = templates.rollup(m)
    assert sorted(r["total_count"] for r in t.collect()) == [10, 15, 80]
    check = templates.integrity(p, templates.instances(m), t).first()
    assert check["integrity_valid"] and check["canonical_count"] == 105 and check["template_count"] == 3
    assert not templates.integrity(p, templates.instances(m).limit(5), t).first()["integrity_valid"]


def test_tree_splits_and_wildcards():
    tree = templates.Tree()
    a = tree.add("user alice logged on ok".split(), 1)
    assert tree.add("user bob logged on ok".split(), 2) != a  # the tree's path holds the second token
    b = tree.add("disk 17 is full now".split(), 3)
    assert tree.add("disk 18 is full now".split(), 4) == b
    assert tree.clusters[b].tokens == ["disk", "<*>", "is", "full", "now"]
    wide = templates.Tree(templates.Settings(max_children=3))
    for w in ("a", "b", "c", "d", "e"):
        wide.add([w, "x", "y"], 1)
    assert set(wide.root.below) <= {"a", "b", "c", "<*>"} and len(wide.root.below) <= 3


def test_levels_times_and_merge(spark):
    rows = [rec(1, "1", "same text", "Warning", time="b"), rec(2, "1", "same text", "Critical", time="a"), rec(3, "1", "same text", None, time=" "), rec(4, "1", None, "Odd", data="payload only")]
    s = templates.signatures(prepared(spark, rows))
    t = {r["template_string"]: r for r in templates.rollup(s).collect()}
    assert (t["same text"]["level"], t["same text"]["first_seen_utc"], t["same text"]["last_seen_utc"], t["same text"]["total_count"]) == ("Critical", "a", "b", 3)
    assert "payload only" in t
    both = templates.merge(templates.rollup(s.where("seq <= 1")), templates.rollup(s.where("seq > 1")))
    assert both.agg(F.sum("total_count")).first()[0] == 4
    assert templates.rollup(templates.mine(prepared(spark, rows).limit(0))).count() == 0


def test_drain_queries_mine_the_payload(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tracewright.plans.loganalysis import QUERIES
    from tracewright.schema import CANONICAL

    texts = [("Job done", '{"a": "alpha"}'), ("Job done", '{"completely": "different", "second": "member"}'), (None, "payload only"), (None, "quite another payload text"), ("Job done", None)]
    rows = [dict.fromkeys(CANONICAL) | {"RecordID": str(i), "TimeCreated": "2026-09-15T10:00:00Z", "EventID": "1", "Channel": "System", "Provider": "P", "Message": m, "EventData": d} for i, (m, d) in enumerate(texts)]
    pq.write_table(pa.Table.from_pylist(rows, pa.schema([(c, pa.string()) for c in CANONICAL])), str(tmp_path / "canonical_logs.parquet"))
    t = {r["template_string"] for r in QUERIES["drain_templates"](spark, str(tmp_path)).collect()}
    assert len(t) == 5 and {"Job done", "payload only", "quite another payload text"} <= t and sum("| Payload:" in x for x in t) == 2
    assert len({r["template_id"] for r in QUERIES["drain_instances"](spark, str(tmp_path)).collect()}) == 5


def test_colliding_record_ids_do_not_multiply(spark):
    df = spark.createDataFrame([("1", "Security", 0), ("1", "System", 1), ("1", "Application", 2)], "RecordID string, Channel string, uid long")
    inst = spark.createDataFrame([(0, "1", "T1"), (1, "1", "T1"), (2, "1", "T2")], "instance_id long, event_record_id string, template_id string")
    assert templates.records_of(df, "uid", inst, ["T1"]).count() == 2
    assert templates.unmapped(df, "uid", inst.where("instance_id < 2")).count() == 1


def test_variables():
    assert templates.extracted("Logon of <*> from <IP>.", "Logon of  bob from 10.0.0.1.") == '{"0": "bob", "1": "10.0.0.1"}'
    assert templates.extracted("a", "b") == "{}" and templates.extracted(None, "b") == "{}"


# Links.

EVENTS = [
    ("1001", "2026-09-15 10:00:00", "4624", "Security", "672", "A-1", '{"TargetLogonId":"0x35be7590","IpAddress":"192.168.1.50","SubjectUserName":"DC$"}', "S-1-5-18"),
    ("1002", "2026-09-15 10:00:14", "4672", "Security", "672", "a-1", '{"SubjectLogonId":"0x35BE7590"}', None),
    ("1003", "2026-09-15 13:00:00", "4688", "Security", "4", None, '{"SubjectLogonId":"0x35be7590","TargetLogonId":"0x3e7"}', None),
    ("2001", "2026-09-15 10:00:45", "7036", "System", "672.0", None, None, None),
    ("2002", "2026-09-15 14:00:00", "7036", "System", "672", None, "cut {", None),
    ("3001", "2026-09-15 10:05:00", "1", "Sysmon", "18404", None, "{}", None),
    ("3002", "2026-09-15 12:05:00", "1", "Sysmon", "18404", "00000000-0000-0000-0000-000000000000", None, None),
]


def index(spark):
    df = spark.createDataFrame(EVENTS, "RecordID string, TimeCreated string, EventID string, Channel string, ProcessID string, ActivityID string, EventData string, UserID string")
    e = correlate.extract(df)
    return e.select(F.col("record_id").alias("event_record_id"), "source_type", "event_id", "provider", F.to_timestamp("time").alias("ts"), "entity_type", "entity_value", "confidence", F.col("weight").alias("confidence_weight"), (F.col("record_id").cast("long") * 100 + F.col("seq")).alias("correlation_id"))


def test_extraction(spark):
    got = {(r["event_record_id"], r["entity_type"], r["entity_value"]) for r in index(spark).collect()}
    assert ("1001", "logon_id", "0x35be7590") in got and ("1001", "ip_address", "192.168.1.50") in got and ("1001", "user_id", "S-1-5-18") in got
    assert not any(v == "DC$" or v == "0x3e7" for _, _, v in got)
    assert ("2001", "process_id", "672") in got and ("3001", "process_id_disambiguated", "PID:18404@2026-09-15 10:05:00") in got
    assert not any(r == "3002" and t == "activity_id" for r, t, _ in got)


def test_links_of_an_anchor(spark):
    i = index(spark)
    out = correlate.linked_to(i, "1001").collect()
    assert [r["event_record_id"] for r in out] == ["1002", "1003", "2001"]
    assert out[0]["time_delta"] == "+14s" and out[1]["time_delta"] == "+3h 0m"
    assert out[0]["relation"].startswith("Shared Logon Id: `")
    assert [r["event_record_id"] for r in correlate.linked_to(i, "3001").collect()] == []
    assert [r["event_record_id"] for r in correlate.linked_to(i, "1001", types=["process_id"]).collect()] == ["1002", "2001"]
    assert "2002" in {r["event_record_id"] for r in correlate.linked_to(i, "1001", overrides={"process_id": 50_000}).collect()}
    assert correlate.linked_to(i, "nobody").count() == 0


def test_counts_equal_brute_force(spark):
    r = random.Random(3)
    rows = [("ip_address", r.choice("aab"), str(n), r.randrange(0, 9_000) * 1_000_000) for n in range(300)]
    df = spark.createDataFrame(rows, "entity_type string, entity_value string, event_record_id string, t_us long")
    got = {(x["entity_value"], x["event_record_id"]): x["n_linked"] for x in correlate.link_counts(df, ["ip_address"]).collect()}
    assert got == {(v, i): sum(1 for _, v2, i2, t2 in rows if v2 == v and i2 != i and abs(t2 - t) <= 3_600_000_000) for _, v, i, t in rows}


def test_latest_start_before(spark):
    rows = [("1", "h", "7", "t1", "4688", None, 1), ("2", "h.x", "7", "t2", "5", None, 2), ("3", "H", "7", "t3", "1", '{"UtcTime": "u3"}', 3), ("4", "h", "7.0", "t4", "5", None, 4), ("5", "g", "7", "t9", "5", None, 9), ("6", "h", "7", "t0", "5", None, 0), ("7", "h", "7", "tx", "5", None, None), ("8", "h", None, "t5", "5", None, 5)]
    df = spark.createDataFrame(rows, "RecordID string, Computer string, ProcessID string, TimeCreated string, EventID string, EventData string, at long")
    got = {r["RecordID"]: r["s"] for r in correlate.with_last_start(df, "at", "s").collect()}
    expected = {"1": "t1", "2": "t1", "3": "u3", "4": "u3", "5": None, "6": None, "7": None, "8": None}
    assert got == expected
    for block in (1, 2, 3):  # a start in an earlier block counts as well
        out = correlate.with_last_start(df.withColumn("__h", F.lit(1)), "at", "s", block)
        assert out.columns == [*df.columns, "__h", "s"] and {r["RecordID"]: r["s"] for r in out.collect()} == expected


def test_windows_labels_and_weights_can_be_set(spark):
    assert correlate.link_rules({"user_id": 5, "service": (60, "Own", 0.9), "other": 7})["user_id"] == (5, "Medium-high", 0.8)
    rules = {r["entity_type"]: tuple(r)[1:] for r in correlate.rule_table(spark, {"service": (60, "Own", 0.9), "other": 7}).collect()}
    assert rules["service"] == (60, "Own", 0.9) and rules["other"] == (7, "Medium", 0.5)
    df = spark.createDataFrame([("1", "H", "672"), ("1", "H", "672")], "RecordID string, Computer string, ProcessID string")
    got = {r["entity_type"]: (r["confidence"], r["confidence_weight"]) for r in correlate.build_index(df, overrides={"computer": (9, "Strong", 0.95)}).collect()}
    assert got == {"computer": ("Strong", 0.95), "process_id": ("Low", 0.3)}
