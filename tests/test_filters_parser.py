from __future__ import annotations

from datetime import datetime, timezone

import pytest

from tracewright.operators import filters
from tracewright.operators.filters import EntityFilters, QueryFilter, TimeRange
from tracewright.plans.parser import parse
from tracewright.schema import resolve_columns

REF = datetime(2026, 9, 16, 14, 0, tzinfo=timezone.utc)

COLUMNS = "event_record_id string, source_type string, provider string, event_id string, level string, time_created_utc string, process_id string, thread_id string, computer string, user_id string, event_data string, message string"
AUDIT = "Microsoft-Windows-Security-Auditing"
ROWS = [
    ("REC_00001", "Security", AUDIT, "4625", "Error", "2026-09-15T08:15:00Z", "672", "10", "DC-1", "S-1-5-21-1-2", '{"IpAddress":"192.168.1.50","Status":"0xC000006D"}', "m"),
    ("REC_00002", "Security", AUDIT, "4624", "Information", "2026-09-15T08:20:00Z", "672.0", "10", "DC-1", None, '{"IpAddress":"192.168.1.50","TargetLogonId":"0x3e7"}', "m"),
    ("REC_00003", "Security", AUDIT, "4625", "Error", "2026-09-15T09:15:00Z", "0x2a0", "11", "DC-2", "bob", '{"IpAddress":"10.0.0.5","Status":"0xC000006D"}', "m"),
    ("REC_00004", "System", "Service Control Manager", "7036", "Information", "2026-09-15T09:20:00Z", "1064", "12", "DC-2", "S-1-5-18", '{"param1":"Spooler"}', "m"),
    ("REC_00005", "System", "Tcpip", "4227.0", "Warning", "2026-09-15T09:25:00Z", "4", "13", "WS-1", "S-1-5-18", '{"SourceAddress":"10.0.0.5"}', "m"),
    ("REC_00006", "Application", "Application Error", "1000", "Error", "bad time", "77", None, "WS-1", "bob", "Faulting application svc.exe", "crash 100%"),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def ids(d):
    return sorted(int(r["event_record_id"][-1]) for r in d.collect())


E = EntityFilters
MATRIX = [
    (QueryFilter(source_type="security", level="Error"), None, [1, 3]),
    (QueryFilter(entity_filters=E(ip_address="192.168.1.50")), None, [1, 2]),
    (QueryFilter(source_type="Security", level="Error", entity_filters=E(ip_address="10.0.0.5")), None, [3]),
    (QueryFilter(entity_filters=E(ip_address="10.0.0.5")), None, [3, 5]),
    (QueryFilter(level="Error"), ["REC_00001", "REC_00002", "REC_00004"], [1]),
    (QueryFilter(level="Error"), [], []),
    (QueryFilter(TimeRange("2026-09-15T08:00:00Z", "2026-09-15T08:45:00Z"), "Security", E(process_id="672"), "4625", "Error"), None, [1]),
    (QueryFilter(entity_filters=E(user_id="SYSTEM")), None, [4, 5]),
    (QueryFilter(entity_filters=E(process_id="0x428")), None, [4]),
    (QueryFilter(entity_filters=E(process_id="672")), None, [1, 2, 3]),
    (QueryFilter(entity_filters=E(provider="service control manager")), None, [4]),
    (QueryFilter(entity_filters=E(status_code="0xc000006d")), None, [1, 3]),
    (QueryFilter(entity_filters=E(logon_id="0x3E7")), None, [2]),
    (QueryFilter(entity_filters=E(thread_id="12")), None, [4]),
    (QueryFilter(entity_filters=E(computer="ws-1")), None, [5, 6]),
    (QueryFilter(entity_filters=E(event_record_id="REC_00006")), None, [6]),
    (QueryFilter(event_id="4227"), None, [5]),
    (QueryFilter(), None, [1, 2, 3, 4, 5, 6]),
]


@pytest.mark.parametrize("f,candidates,expected", MATRIX)
def test_six_rows(spark, df, f, candidates, expected):
    c = None if candidates is None else spark.createDataFrame([(x,) for x in candidates], "id string")
    assert ids(filters.run(df, f, c)) == expected


def test_filters_reach_the_scan(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "t"))
    plan = filters.run(spark.read.parquet(str(tmp_path / "t")), QueryFilter(source_type="Security")).select("event_record_id", "time_created_utc")._jdf.queryExecution().executedPlan().toString()
    assert "event_data" not in plan.split("ReadSchema")[1]


def test_like_wildcards_and_literal_keywords(df):
    assert ids(filters.run(df, QueryFilter(entity_filters=E(provider="service_control")))) == [4]
    assert ids(filters.keyword(df, "100%", ["message", "event_data", "missing"])) == [6]
    assert ids(filters.keyword(df, "10_0", ["message", "event_data"])) == []


def test_facets_fetch_and_expressions(df):
    assert ids(filters.facets(df, {"source_type": ["System"], "level": []})) == [4, 5]
    assert ids(filters.fetch(df, "event_record_id", ["REC_00002"])) == [2]
    assert ids(filters.where_ids(df, "level = 'Warning'", "event_record_id")) == [5]


def test_hunts_and_fallback(df):
    assert filters.hunt("Any brute force, or 9999?")["event_ids"] == ["4625", "4740", "4776", "9999"]
    assert filters.hunt("nothing at all")["threat_level"] == "Informational"
    assert ids(filters.fallback_search(df, "what about 192.168.1.50", ["event_data"], ["event_record_id"])) == [1, 2]
    assert ids(filters.fallback_search(df, "any log", ["event_data"], ["event_record_id"], "level", 2)) == [1, 2]


def test_aliases():
    got = resolve_columns(["SystemTime", "Id", "Hostname", "Severity", "SecurityUserID", "Source", "Payload"])
    assert got == {"time": "SystemTime", "event_id": "Id", "computer": "Hostname", "level": "Severity", "user_id": "SecurityUserID", "channel": "Source", "event_data": "Payload"}
    assert resolve_columns(["Level", "LevelName"])["level"] == "LevelName"
    assert resolve_columns(["x", "RecordID"], {"record_id": "x"})["record_id"] == "x"


@pytest.mark.parametrize(
    "question,expected",
    [
        ("show the failed logon around 3pm yesterday for process 1064", dict(range=("2026-09-15T14:30:00Z", "2026-09-15T15:30:00Z"), source="Security", event="4625", intent="specific_instance", level=None, process_id="1064")),
        ("how often did the USB reader error occur", dict(range=None, source=None, intent="pattern_or_aggregate", level="Error")),
        ("How often did the USB reader error occur last week?", dict(range=("2026-09-09T14:00:00Z", "2026-09-16T14:00:00Z"), intent="pattern_or_aggregate")),
        ("what else happened around the time of the failed login", dict(intent="correlation", event="4625", source="Security")),
        ("What happened around 3pm yesterday on this machine?", dict(source=None)),
        ("Did the SQL server ever fail to connect?", dict(source=None)),
        ("Show security logons for user admin", dict(source="Security", user_id="admin")),
        ("Check application crash in test.exe", dict(source="Application", event="1000", process_name="test.exe")),
        ("Find system error from service control manager", dict(source="System")),
        ("Check failed logins yesterday", dict(range=("2026-09-15T00:00:00Z", "2026-09-15T23:59:59Z"), raw="yesterday")),
        ("show failed logins", dict(intent="ambiguous")),
        ("Show logon from IP 192.168.1.100", dict(ip_address="192.168.1.100")),
        ("Find events for user jsmith", dict(user_id="jsmith")),
        ("Find events for S-1-5-21-3623811015-3361044348-30300820-1013", dict(user_id="S-1-5-21-3623811015-3361044348-30300820-1013")),
        ("Show session with logon id 0x3e7", dict(logon_id="0x3e7")),
        ("Activity on host SEC-SRV-01", dict(computer="SEC-SRV-01")),
        ("Fetch record REC_00452", dict(event_record_id="REC_00452")),
        ("Show events where user is SYSTEM", dict(user_id="SYSTEM")),
        ("Check host where computer is DESKTOP-AULEN0J", dict(computer="DESKTOP-AULEN0J")),
        ("Show activity for user CONTOSO\\Administrator", dict(user_id="CONTOSO\\Administrator")),
        ("Find events from provider Service Control Manager", dict(provider="Service Control Manager")),
        ("Application crash in svchost.exe", dict(process_name="svchost.exe")),
        ("Logon failure with status 0xC000006D", dict(status_code="0xC000006D")),
        ("Find events for process 0x428", dict(process_id="0x428")),
        ("Show logon failure for user Administrator", dict(source="Security", event="4625", level=None)),
        ("between 2026-09-14 14:00 and 2026-09-14 16:00", dict(range=("2026-09-14T14:00:00Z", "2026-09-14T16:00:00Z"))),
        ("errors on May 7th", dict(range=("2026-05-07T00:00:00Z", "2026-05-07T23:59:59Z"))),
        ("past 24 hours", dict(range=("2026-09-15T14:00:00Z", "2026-09-16T14:00:00Z"))),
        ("events at 30 degrees", dict(range=None)),
        ("", dict(range=None, intent="ambiguous")),
    ],
)
def test_questions(question, expected):
    q = parse(question, REF)
    got = dict(q.entity_filters.__dict__, range=q.time_range and (q.time_range.start_utc, q.time_range.end_utc), raw=q.time_range and q.time_range.raw_expression, source=q.source_type, event=q.event_id, intent=q.intent, level=q.level)
    assert {k: got[k] for k in expected} == expected


def test_residue_and_coverage():
    assert "USB reader error" in parse("how often did the USB reader error occur", REF).semantic_query
    assert "narrow down" in parse("show failed logins", REF).clarifying_question
    q = parse("what happened yesterday", None, ("2026-01-01T00:00:00Z", "2026-01-02T12:00:00Z"))
    assert q.time_range.start_utc == "2026-01-01T00:00:00Z" and not q.time_range.outside_coverage
    assert parse("on 2027-01-01", REF, ("2026-01-01 00:00:00", "2026-01-02 12:00:00")).time_range.outside_coverage
