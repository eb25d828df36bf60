from __future__ import annotations

import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from tracewright.__main__ import main
from tracewright.operators import templates
from tracewright.plans.pipeline import CITATION, NOTHING, MockBackend, Pipeline, PipelineConfig, append_audit, backend, batches_of, diagnose
from tracewright.plans.parser import parse
from tracewright.schema import CANONICAL
from tracewright.sources import readers, writers
from tracewright.streaming import incremental

ROWS = [{"RecordID": "1", "EventID": "4624", "Provider": 'P "q"', "ProviderGuid": "{g}", "EventData": '{"a": "<1>", "b": "x,y"}', "Message": "line one\nline two", "LevelName": "Error"}, {"RecordID": "2", "EventID": "7", "EventData": "[1, 2]", "Message": ""}]


def test_csv_round_trip_keeps_quotes_and_lines(spark, tmp_path):
    df = readers.from_rows(spark, ROWS).na.fill("")
    p = str(tmp_path / "x.csv")
    assert writers.write_file(df, p, "csv") == 2
    back = {r["RecordID"]: r.asDict() for r in readers.read_csv(spark, p).collect()}
    assert back["1"]["Message"] == "line one\nline two" and back["1"]["EventData"] == ROWS[0]["EventData"] and back["2"]["Message"] == ""
    writers.write_csv(df, str(tmp_path / "folder"))
    assert readers.read_csv(spark, str(tmp_path / "folder")).count() == 2


@pytest.mark.parametrize("kind", ["json", "jsonl"])
def test_json_round_trips(spark, tmp_path, kind):
    df = readers.from_rows(spark, ROWS)
    p = str(tmp_path / f"x.{kind}")
    writers.write_file(df, p, kind)
    back = {r["RecordID"]: r for r in readers.read_any(spark, p).collect()}
    assert back["1"]["Provider"] == 'P "q"'


def test_json_numbers_stay_text(spark, tmp_path):
    (tmp_path / "n.json").write_text('[{"RecordID": 672, "X": {"a": 1}}]')
    r = readers.read_json(spark, str(tmp_path / "n.json")).first()
    assert r["RecordID"] == "672" and json.loads(r["X"]) == {"a": "1"}


def test_many_files_and_canonical_columns(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"RecordID": "1", "Channel": "null"}\n')
    (tmp_path / "b.csv").write_text("RecordID,Extra\n2,x\n")
    m = readers.read_many(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.csv")])
    assert {(r["RecordID"], r["SourceLog"]) for r in m.collect()} == {("1", "a.jsonl"), ("2", "b.csv")}
    c = readers.load_canonical(spark, str(tmp_path / "a.jsonl"))
    assert c.columns == CANONICAL and c.first()["Channel"] == ""


def test_event_xml_is_well_formed(spark, tmp_path):
    p = str(tmp_path / "x.xml")
    writers.write_file(readers.from_rows(spark, ROWS), p, "xml")
    events = ET.parse(p).getroot()
    ns = {"e": writers.NAMESPACE}
    data = [d.text for d in events[0].findall(".//e:EventData/e:Data", ns)]
    assert len(events) == 2 and data == ["<1>", "x,y"] and events[0].find(".//e:Provider", ns).get("Name") == 'P "q"'
    assert [d.text for d in events[1].findall(".//e:EventData/e:Data", ns)] == ["1", "2"] and events[1].find(".//e:RenderingInfo", ns) is None


def test_files_and_targets(tmp_path):
    for n in ("b.evtx", "a.EVTX", "c.txt"):
        (tmp_path / n).write_text("")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "e.evtx").write_text("")
    names = lambda fs: [f.rsplit("/", 1)[1] for f in fs]
    assert names(readers.find_files(f'"{tmp_path}"')) == ["a.EVTX", "b.evtx"]
    assert names(readers.find_files(str(tmp_path), recursive=True)) == ["a.EVTX", "b.evtx", "e.evtx"]
    assert names(readers.find_files(f"{tmp_path}/*.evtx")) == ["b.evtx"] and readers.find_files(str(tmp_path), chosen=["b.evtx"])[0].endswith("b.evtx")
    assert writers.output_path("/x/a.evtx", None, "odd") == "/x/a.csv" and writers.output_path("/x/a.evtx", "/o", "xml") == "/o/a.xml" and writers.output_path("/x/a.evtx", "/o/n.json", "json") == "/o/n.json"


def test_records_over_several_lines():
    lines = ["noise\n", '{"a":\n', "1}\n", '{"b": 2}\n', "{broken\n"]
    assert [json.loads(x) for x in readers.join_records(lines)] == [{"a": 1}, {"b": 2}]
    assert list(readers.join_records(["{" + "x" * 50 + "\n", '{"c": 3}\n'], limit=20)) == ['{"c": 3}\n']


def test_conversion_reports_each_file(spark, tmp_path, capsys):
    (tmp_path / "good.jsonl").write_text('{"RecordID": "1"}\n')
    (tmp_path / "empty.jsonl").write_text("")
    seen = []
    out = writers.convert(spark, str(tmp_path), str(tmp_path / "out"), "csv", extension=".jsonl", progress=lambda *a: seen.append(a)).collect()
    assert {r["source"].rsplit("/", 1)[1]: r["ok"] for r in out}["good.jsonl"] and len(seen) == 2
    assert main([str(tmp_path / "good.jsonl"), "-o", str(tmp_path / "o2"), "-f", "json", "-e", ".jsonl"]) == 0 and (tmp_path / "o2" / "good.json").exists()
    assert main(["-i", str(tmp_path / "none"), "-e", ".jsonl"]) == 1


def test_raw_event_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"Event": {"System": {"EventRecordID": 9, "Level": 3}}}\nnot json\n[1]\n')
    rows = readers.read_raw_events(spark, str(tmp_path / "r.jsonl")).collect()
    assert len(rows) == 1 and rows[0]["RecordID"] == "9" and rows[0]["LevelName"] == "Warning"


# Streams and increments.

PREPARED = "record_id string, seq long, channel string, provider string, event_id string, level string, time string, masked string"


def test_template_store_is_idempotent(spark, tmp_path):
    rows = [(str(i), i, "Security", "P", "1", "Error" if i == 3 else "Information", f"t{i}", ["first text", "quite another one"][i % 2]) for i in range(6)]
    store = incremental.TemplateStore(spark, str(tmp_path))
    df = spark.createDataFrame(rows, PREPARED)
    assert store.add(df.where("seq < 4")) == 4 and store.add(df.where("seq < 4")) == 0 and store.add(df) == 2
    t = {r["template_string"]: r for r in store.templates().collect()}
    assert t["first text"]["total_count"] == 3 and t["quite another one"]["level"] == "Error" and t["quite another one"]["last_seen_utc"] == "t5"
    assert store.instances().count() == 6
    assert templates.integrity(df, store.instances(), store.templates()).first()["integrity_valid"]


def test_stream_appends_each_key_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string").write.parquet(src)
    stream = spark.readStream.schema("k long, v string").parquet(src)
    for _ in range(2):
        incremental.run_available(stream, incremental.append_new(spark, out, "k"), str(tmp_path / "cp")).awaitTermination()
        spark.createDataFrame([(2, "b"), (3, "c")], "k long, v string").write.mode("append").parquet(src)
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == [1, 2, 3][: spark.read.parquet(out).count()] and spark.read.parquet(out).count() >= 2


def test_session_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("u", "2026-01-01 00:00:00"), ("u", "2026-01-01 00:10:00"), ("u", "2026-01-01 05:00:00")], "u string, s string").select("u", F.to_timestamp("s").alias("ts")).write.parquet(src)
    stream = spark.readStream.schema("u string, ts timestamp").parquet(src)
    q = incremental.session_counts(stream, "ts", ["u"]).writeStream.format("memory").queryName("s1").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["n"] for r in spark.table("s1").collect()} <= {2, 1}


# The pipeline.


@pytest.fixture(scope="module")
def pipeline(spark):
    rows = [(str(100 + i), f"2026-09-16T08:{i:02d}:00Z", "1000" if i % 2 else "4624", "Error" if i % 2 else "LogAlways", "Application" if i % 2 else "Security", "WS", '{"k": 1}') for i in range(60)]
    df = spark.createDataFrame(rows, "RecordID string, TimeCreated string, EventID string, LevelName string, Channel string, Computer string, EventData string").withColumn("ts", F.to_timestamp("TimeCreated"))
    t = spark.createDataFrame([("T1", "Application", "P", "1000", "Error", "application crash in <*>", "2026-09-16T08:00:00Z", "2026-09-16T09:00:00Z", 30)], "template_id string, source_type string, provider string, event_id string, level string, template_string string, first_seen_utc string, last_seen_utc string, total_count long")
    return Pipeline(df, "ts", "RecordID", t)


def test_question_to_audit(pipeline, spark, tmp_path):
    r = pipeline.ask("show the application crash on 2026-09-16")
    assert r.records.count() == 30 and r.filter.event_id == "1000"
    assert "TEMPLATE AGGREGATE" in r.batches[0] and r.batches[1].startswith("--- BATCH 1 OF 2")
    assert r.answer.citations and set(r.answer.citations) <= set(r.final_ids)
    append_audit(r.audit, str(tmp_path / "audit"))
    append_audit(r.audit, str(tmp_path / "audit"))
    row = spark.read.parquet(str(tmp_path / "audit")).first()
    assert row["citations"] == r.answer.citations and row["latency_ms"] > 0


def test_nothing_found(pipeline):
    r = pipeline.ask("errors in system log on 2026-09-16")
    assert r.batches[0].startswith("TOTAL_RECORDS: 0") and r.answer.text == NOTHING and r.final_ids == []
    q = parse("system log process 4 on 2020-01-01", None, ("2026-09-16T08:00:00Z", "2026-09-16T09:00:00Z"))
    assert any("channel System" in x for x in diagnose(pipeline.records, q, ("a", "b"))) and any("outside" in x for x in diagnose(pipeline.records, q, ("a", "b")))


def test_batches_and_backends():
    b = batches_of([(str(i), f"RecordID={i} | TimeCreated=t | Channel=S | x") for i in range(31)], [], 99, PipelineConfig())
    assert len(b) == 4 and "99 total" in b[-1]
    a = MockBackend().generate("", "", b)
    assert a.citations == ["0", "1", "2", "3", "4"] and CITATION.search(a.text)
    assert isinstance(backend("auto"), MockBackend)
    with pytest.raises(ValueError):
        backend("other")


def test_answers_of_a_model_server():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from tracewright.plans.pipeline import MockBackend, ServerBackend, backend

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = f"Seen [Record #7, Channel: Security] by {asked['model']} of {len(asked['messages'])} messages."
            told = {"choices": [{"message": {"content": text}}], "model": "m-1"} if self.path == "/chat" else {"message": {"content": text}}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(told).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    one = backend("server", url=f"{url}/chat", model="m")
    assert one.reachable()
    a = one.generate("s", "q", ["b"])
    assert (a.text, a.citations, a.model_version, a.backend) == ("Seen [Record #7, Channel: Security] by m of 2 messages.", ["7"], "m-1", "server")
    assert ServerBackend(f"{url}/other", "m").generate("s", "q", []).citations == ["7"]
    server.shutdown()
    server.server_close()
    assert not ServerBackend("http://127.0.0.1:9", "m").reachable() and isinstance(backend(), MockBackend)
    with pytest.raises(ValueError):
        backend("nothing")


def test_a_channel_among_sixty_is_not_denied(spark):
    df = spark.createDataFrame([(str(i), f"Channel {i:02d}") for i in range(60)], "RecordID string, Channel string")
    q = parse("nothing")
    q.source_type = "channel 59"
    assert diagnose(df, q, None) == []
    q.source_type = "Channel 60"
    assert "does not occur" in diagnose(df, q, None)[0]


@pytest.fixture
def tool(tmp_path):
    """A dump tool that prints a file as it is, and fails on some."""
    p = tmp_path / "dump"
    p.write_text('#!/bin/sh\n[ "$1" = --version ] && exit 0\ncat "$1"\ncase "$1" in *bad*) echo broken chunk >&2; exit 3;; esac\n')
    p.chmod(0o755)
    return str(p)


def raw(i, level=3):
    return json.dumps({"Event": {"System": {"EventRecordID": i, "Level": level, "Computer": 'h "q"'}}})


def test_a_failing_dump_tool_is_no_success(spark, tmp_path, tool):
    (tmp_path / "good.evtx").write_text("\n".join(raw(i) for i in (10, 9, 2)) + "\n{cut off")
    (tmp_path / "bad.evtx").write_text(raw(1) + "\n")
    (tmp_path / "empty.evtx").write_text("")
    assert readers.read_evtx(spark, [str(tmp_path / "good.evtx")], tool).count() == 3
    with pytest.raises(Exception, match="broken chunk"):
        readers.read_evtx(spark, [str(tmp_path / "bad.evtx")], tool).count()
    for kind in ("csv", "json", "jsonl", "xml"):
        out = {r["source"].rsplit("/", 1)[1]: r for r in writers.convert(spark, str(tmp_path), str(tmp_path / kind), kind, tool=tool).collect()}
        assert (out["good.evtx"]["rows"], out["good.evtx"]["lost"], out["good.evtx"]["ok"]) == (3, 1, True) and out["empty.evtx"]["ok"]
        assert not out["bad.evtx"]["ok"] and "ended with 3" in out["bad.evtx"]["error"] and not (tmp_path / kind / f"bad.{kind}").exists()
        if kind == "xml":
            assert len(ET.parse(tmp_path / kind / "good.xml").getroot()) == 3 and len(ET.parse(tmp_path / kind / "empty.xml").getroot()) == 0
        else:
            rows = readers.read_any(spark, str(tmp_path / kind / f"good.{kind}")).collect()
            assert {r["RecordID"] for r in rows} == {"2", "9", "10"} and rows[0]["Computer"] == 'h "q"'
    text = (tmp_path / "jsonl" / "good.jsonl").read_text().splitlines()
    assert [json.loads(x)["RecordID"] for x in text] == ["2", "9", "10"]
    one = {r["source"].rsplit("/", 1)[1]: r["ok"] for r in writers.convert(spark, str(tmp_path), str(tmp_path / "o"), "csv", tool=tool, in_tasks=False).collect()}
    assert one == {"good.evtx": True, "bad.evtx": False, "empty.evtx": True}


def test_finding_a_dump_tool(tmp_path, tool, monkeypatch):
    monkeypatch.setattr(readers, "TOOL_PLACES", [str(tmp_path / "none"), tool])
    monkeypatch.delenv(readers.TOOL_VARIABLE, raising=False)
    assert readers.dump_tool() == tool
    broken = tmp_path / "broken"
    broken.write_text("#!/bin/sh\nexit 1\n")
    broken.chmod(0o755)
    monkeypatch.setenv(readers.TOOL_VARIABLE, str(broken))
    assert readers.dump_tool() == tool and not readers.works(str(tmp_path / "none"))


def test_what_is_held_in_memory(spark, tool):
    import io

    import pandas as pd

    frame = pd.DataFrame({"RecordID": [1, 2], "Message": ["a", None]})
    assert [tuple(r) for r in readers.from_memory(spark, frame).collect()] == [("1", "a"), ("2", None)]
    assert readers.from_memory(spark, b"RecordID,Message\n7,x\n", "u.csv").first()["RecordID"] == "7"
    assert readers.from_memory(spark, io.BytesIO(b'{"RecordID": 8}\n'), "u.jsonl").first()["RecordID"] == "8"
    assert readers.from_memory(spark, raw(5).encode(), "u.evtx", tool).first()["RecordID"] == "5"


def test_many_files_are_few_scans(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"x {i}+.csv").write_text("RecordID,Extra\n%d,\n" % i)
    (tmp_path / "y.csv").write_text("Other,RecordID\no,9\n")
    spark.createDataFrame([("11",), ("12",)], "RecordID string").write.parquet(str(tmp_path / "z.parquet"))
    df = readers.read_many(spark, [str(tmp_path / f"x {i}+.csv") for i in range(6)] + [str(tmp_path / "y.csv"), str(tmp_path / "z.parquet")])
    got = {(r["RecordID"], r["SourceLog"], r["Extra"], r["Other"]) for r in df.collect()}
    assert got == {*((str(i), f"x {i}+.csv", "", None) for i in range(6)), ("9", "y.csv", None, "o"), ("11", "z.parquet", None, None), ("12", "z.parquet", None, None)}
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 3
