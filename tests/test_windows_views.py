from __future__ import annotations

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import payload, text
from tracewright.operators import records, vectors, views, windows


def brute_windows(times, length, step):
    out, times = set(), sorted(times)
    if not times:
        return out
    w = times[0]
    while w <= times[-1]:
        inside = [t for t in times if w <= t < w + length]
        if inside:
            out |= {(t, w) for t in inside}
            w += step
        else:
            nxt = min(t for t in times if t >= w)
            w = nxt if nxt >= w + length else w + step
    return out


@pytest.mark.parametrize("length,overlap", [(10, 2), (10, 7), (6, 0)])
def test_sliding_windows_equal_brute_force(spark, length, overlap):
    r = random.Random(length + overlap)
    rows, expected = [], set()
    for k in ("a", "b", None):
        t, times = r.randrange(50), []
        for _ in range(60):
            t += r.choice([0, 1, 1, 2, length, length - overlap, 2 * length - overlap, 2 * length, 37])
            times.append(t)
        rows += [(k, x) for x in times]
        expected |= {(k, x, w) for x, w in brute_windows(times, length, length - overlap)}
    df = spark.createDataFrame([*rows, ("a", None)], "k string, t long")
    out = windows.sliding(df, ["k"], "t", length, overlap)
    assert {(x["k"], x["t"], x["window_us"]) for x in out.collect()} == expected
    assert {x for x in rows} == {(x["k"], x["t"]) for x in out.collect()}  # nothing is lost


def test_overlap_must_be_shorter(spark):
    with pytest.raises(ValueError):
        windows.sliding(spark.createDataFrame([(1,)], "t long"), [], "t", 5, 5)


def test_skew_keeps_source_order(spark):
    df = spark.createDataFrame([("h", 3_000_000, 0), ("h", 1_000_000, 1), ("h", 9_000_000, 2), ("h", None, 3), ("g", 2_000_000, 4)], "h string, t long, seq int")
    got = [r["seq"] for r in windows.skew_order(df.where("h = 'h'"), ["h"], "t", "seq").orderBy(F.col("cluster_us").asc_nulls_first(), "seq").collect()]
    assert got == [3, 0, 1, 2]


def test_islands_cross_blocks(spark):
    df = spark.createDataFrame([("k", i * 4) for i in range(100)] + [("k", 500), ("j", 1)], "k string, t long")
    got = {(r["k"], r["t"]): r["i"] for r in windows.islands(df, ["k"], "t", 4, "i", block_us=10).collect()}
    assert got[("k", 396)] == 0 and got[("k", 500)] == 500 and got[("j", 1)] == 1


def test_slices_and_chunks(spark):
    rows = [("h", 0, i, f"line {i}", tokens, "4624" if i % 2 else None) for i, tokens in enumerate([200, 200, 200, 600, 1, None, 511])]
    df = spark.createDataFrame(rows, "h string, w long, t long, line string, tokens int, e string")
    s = windows.slices(df, ["h", "w"], ["t"], "tokens")
    assert [r["slice"] for r in s.orderBy("t").collect()] == [0, 0, 1, 2, 3, 3, 3]
    c = windows.chunks(s, ["h", "w", "slice"], [F.col("t")], "t", "line", {"ids": "e"}).orderBy("slice").collect()
    assert [r["raw_row_count"] for r in c] == [2, 1, 1, 3] and c[0]["text"] == "line 0\nline 1" and c[0]["ids"] == ["4624"]


def test_burst_loses_nothing(spark):
    df = spark.createDataFrame([("h", 0, i, "x" * 400, 100) for i in range(125)], "h string, w long, t long, line string, tokens int")
    s = windows.slices(df, ["h", "w"], ["t"], "tokens")
    assert s.count() == 125 and s.groupBy("slice").sum("tokens").agg(F.max("sum(tokens)")).first()[0] <= 512


def test_text_forms(spark):
    df = spark.createDataFrame([("DC-PRIMARY:2026-09-14T08:00:10Z", " A  b\n", "N/A", 125.9)], "a string, b string, c string, d double")
    r = df.select(
        text.uuid5(F.col("a")).alias("u"), text.collapse(F.col("b")).alias("b"), text.or_null(F.col("c")).alias("c"), text.delta_text(-F.col("d")).alias("d"), text.duration_text(F.lit(90_000)).alias("e"),
        text.mask(F.lit("0xAF at 10.0.0.1:443 by S-1-5-21-1-2 in C:\\a\\b.exe")).alias("m"), text.token_estimate(F.lit("abc")).alias("t"), text.capitalize(F.lit("sYSTEM log")).alias("k"), text.html_escape(F.lit("<a&'\">")).alias("h"),
        text.family_label(F.lit("4625"), F.lit("x")).alias("f"), text.family_label(F.lit("9"), F.lit("Sec")).alias("g"), text.basename(F.lit("C:\\a\\b.exe")).alias("n"), text.cell(F.lit("a|b\nc")).alias("l"), text.display_time(F.lit("2026-09-14 08:00:10").cast("timestamp")).alias("w"),
    ).first()
    assert r["u"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, "DC-PRIMARY:2026-09-14T08:00:10Z")) == "851720fa-d468-5786-93f3-e475a69d6def"
    assert (r["b"], r["c"], r["d"], r["e"]) == ("A b", None, "-2m 5s", "1d 1h")
    assert r["m"] == "<HEX> at <IP> by <SID> in <PATH>" and r["t"] == 1 and r["k"] == "System log" and r["h"] == "&lt;a&amp;&#x27;&quot;&gt;"
    assert (r["f"], r["g"], r["n"], r["l"], r["w"]) == ("Event 4625: Failed Logon", "Sec Event 9", "b.exe", "a\\|b c", "9/14/26, 8:00:10 AM")


def test_summaries(spark):
    rows = [('{"a": "1", "b": null}', "m", None, "5"), ("[7, 8]", "m", None, "5"), ('{"a": "1", "b', "m", None, "5"), ("plain text", "m", None, "5"), (None, " told\n us ", None, "5"), ("", "", '{"u": 2}', "5"), (None, None, None, "5"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "e string, m string, u string, t string")
    assert [r[0] for r in df.select(payload.summary(F.col("e"), F.col("m"), F.col("u"), F.col("t"))).collect()] == ["a=1", "Data1=7, Data2=8", 'Data1={"a": "1", "b', "Data1=plain text", "told us", "u=2", "Task: 5", "-"]


def test_lines_and_documents(spark):
    df = spark.createDataFrame([("1", "t", "{'#text': 4624}", "Error", "Security", "H", "nan", "  big   text ", "x"), (None, None, "", "null", "N/A", None, None, " ", None)], "RecordID string, TimeCreated string, EventID string, LevelName string, Channel string, Computer string, UserID string, Message string, Extra string")
    at = {"time": "TimeCreated", "computer": "Computer", "channel": "Channel", "event_id": "EventID", "level": "LevelName", "user_id": "UserID", "message": "Message"}
    assert [r[0] for r in df.select(records.semantic_line({k: F.col(c) for k, c in at.items()})).collect()] == ["[t] H | Security | EventID: 4624 (Error) | Details: big text", records.EMPTY]
    d = records.documents(df).collect()
    assert d[0]["row_id"] == "1" and d[0]["text"].endswith("Message: big text | Extra: x") and d[0]["levels"] == ["Error"]
    assert len(d[1]["row_id"]) == 36 and d[1]["text"] == records.EMPTY


def test_raw_events():
    e = {"Event": {"System": {"EventRecordID": 7, "EventID": {"#text": 4624, "#attributes": {"Qualifiers": "16384"}}, "Level": 2, "TimeCreated": {"#attributes": {"SystemTime": "T"}}, "Provider": {"#attributes": {"Name": "P", "Guid": "G"}}, "Execution": {"#attributes": {"ProcessID": 1, "ThreadID": 2}}, "Security": {"#attributes": {"UserID": "S"}}, "Correlation": None}, "EventData": {"Data": [{"#attributes": {"Name": "a"}, "#text": "1"}, {"#attributes": {"Name": "b"}, "#text": None}]}, "RenderingInfo": {"Message": "hello"}}}
    r = records.row_of(e)
    assert (r["RecordID"], r["EventID"], r["Qualifiers"], r["LevelName"], r["TimeCreated"], r["Provider"], r["ProviderGuid"], r["ProcessID"], r["UserID"], r["EventData"], r["Message"], r["ActivityID"]) == ("7", "4624", "16384", "Error", "T", "P", "G", "1", "S", '{"a": "1", "b": ""}', "hello", "")
    assert records.scalar([None, "a", "NULL", 3]) == "a, 3" and records.scalar({"Name": "n", "Value": 2}) == "n=2" and records.payload_text({"x": []}) == '{"x": []}' and records.payload_text(None) == ""


def test_clean_replaces_null_words(spark):
    df = spark.createDataFrame([(" None ", '{"a": null, "b": "NaN", "c": ["null", 1], "d": "x, null, y"}', "keep null here")], "recordid string, EventData string, Message string")
    r = records.clean(df).first()
    assert r["RecordID"] == "" and r["Message"] == "keep null here" and r["EventData"].replace(" ", "") == '{"a":"","b":"","c":["",1],"d":"x,null,y"}' and r["Version"] == ""


def test_views(spark):
    df = spark.createDataFrame([("1", "a", '{"Image": "C:\\\\x\\\\p.exe", "Status": "0x0"}'), ("2", "b", '{"IpAddress": "-", "TargetUserName": "bob"}'), ("10", "a", "no json"), ("x", "nan", None)], "id string, v string, e string")
    assert [tuple(r) for r in views.top(df, F.col("v"), "v", 1).collect()] == [("a", 2)]
    assert [r["id"] for r in views.page(df, [views.record_order(F.col("id")).desc(), F.col("id")], 99, 3).collect()] == ["x"]
    assert {tuple(r) for r in views.payload_facets(df, F.col("e")).collect()} == {("processes", "p.exe", 1), ("users", "bob", 1)}
    assert [r[0] for r in views.pick_list(df, "v").collect()] == ["a", "b"]
    assert views.dedup_ratio(100, 5) == 95.0 and views.dedup_ratio(0, 0) == 0.0
    b = views.markdown_batches(df, [F.col("id")], ["id", "v"], 3).orderBy("batch").collect()
    assert len(b) == 2 and b[1]["text"].startswith("### LOG BATCH [4 to 4 of 4]")
    assert df.limit(0).count() == 0 and views.markdown_batches(df.limit(0), [F.col("id")], ["id"]).count() == 0


def test_nearest_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)], i % 3) for i in range(130)] + [(900, None, 1), (901, [0.0] * 8, 1)]
    rows.append((902, rows[20][1], 2))
    df = spark.createDataFrame(rows, "id long, v array<double>, g int").repartition(3)
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in vectors.nearest(df, df.where("id % 20 = 0"), "id", "v", 4, "g").collect()}
    real = {i: (np.array(v), g) for i, v, g in rows if v is not None and any(v)}
    for q in [i for i in real if i % 20 == 0]:
        a, g = real[q]
        best = sorted((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6), i) for i, (b, h) in real.items() if i != q and h == g)[:4]
        assert [got[q, n + 1] for n in range(4)] == [(i, pytest.approx(-s, abs=2e-6)) for s, i in best]


def test_embedder_and_bm25(spark):
    e = vectors.HashingEmbedder(32)
    v = e.embed(["alpha beta gamma", "gamma alpha beta", "", None])
    assert np.allclose(v[0], v[1]) and np.isclose(np.linalg.norm(v[0]), 1) and not v[2].any()
    df = spark.createDataFrame([(1, "logon logon failed"), (2, "nothing here"), (3, None), (4, "")], "id int, t string")
    assert [r["id"] for r in vectors.bm25(df, "id", "t", ["logon"]).collect()] == [1]
    assert vectors.bm25(df.limit(0), "id", "t", ["x"]).count() == 0
    s = vectors.embedded(df, "t", e).withColumn("c", vectors.cosine(F.col("embedding"), F.col("embedding")))
    assert [r["c"] and round(r["c"], 5) for r in s.orderBy("id").collect()] == [1.0, 1.0, None, None]
