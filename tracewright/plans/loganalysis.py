"""Registered queries of the log-analysis operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import payload, text
from tracewright.functions.entities import integer_form
from tracewright.operators import correlate, filters, records, templates, vectors, views, windows
from tracewright.operators.order import numbered_rows
from tracewright.operators.filters import EntityFilters, QueryFilter, TimeRange
from tracewright.plans.base import INDEX_SQL, RECORDS_SQL, entity_index, logs
from tracewright.plans.base import records as timed
from tracewright.plans.parser import parse
from tracewright.plans import pipeline
from tracewright.plans.pipeline import Pipeline
from tracewright.plans.tables import table
from tracewright.schema import CANONICAL, EVENT_DESCRIPTIONS, EVENT_FAMILIES, MASKS
from tracewright.session import broadcast_if_small, cut, scratch_folder
from tracewright.sources import readers, writers
from tracewright.streaming import incremental

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def q(s: str) -> str:
    return s.replace("'", "''")


# Filters. Exact copies of a record count once.

_SHOWN = ["RecordID", "EventID", "Channel"]
_DEDUP = "SELECT DISTINCT RecordID, EventID, Channel FROM canonical_logs WHERE "
_PLAIN = lambda c: f"regexp_replace(trim({c}), '\\.0$', '')"


def _filtered(spark: SparkSession, folder: str, **kw) -> DataFrame:
    f = QueryFilter(**{k: v for k, v in kw.items() if k in ("source_type", "event_id", "level")}, entity_filters=EntityFilters(**{k: v for k, v in kw.items() if k not in ("source_type", "event_id", "level")}))
    df = logs(spark, folder)
    return df.where(filters.predicate(f, df.columns)).select(*_SHOWN).distinct()


def _held(keys: list[str], *values: str) -> str:
    j = "TRY_CAST(EventData AS JSON)"
    return "(" + " OR ".join(f"lower(json_extract_string({j}, '$.{k}')) = '{q(v.lower())}'" for k in keys for v in values) + ")"


_FILTERS = {
    "filter_channel_level": (dict(source_type="system", level="Error"), "lower(Channel) = 'system' AND lower(LevelName) IN ('2', 'error', 'failure', 'audit failure')"),
    "filter_level_information": (dict(level="Information"), "lower(LevelName) IN ('4', '0', 'information', 'informational', 'info', 'audit success', 'logalways')"),
    "filter_event_id_cast": (dict(event_id="4625"), f"{_PLAIN('EventID')} = '4625'"),
    "filter_json_ip": (dict(ip_address="10.44.0.9"), _held(payload.keys_of("ip_address"), "10.44.0.9")),
    "filter_json_ip_by_event": (dict(event_id="4624", ip_address="10.44.0.9"), f"{_PLAIN('EventID')} = '4624' AND " + _held(["IpAddress"], "10.44.0.9")),
    "filter_logon_id": (dict(logon_id="0x3E7"), _held(payload.keys_of("logon_id"), "0x3e7")),
    "filter_process_id_hex_dec": (dict(process_id="0x428"), "(lower(trim(ProcessID)) IN ('1064', '1064.0', '0x428') OR " + _held(payload.keys_of("process_id"), "1064", "0x428") + ")"),
    "filter_process_name": (dict(process_name="umbauth.exe"), "(" + _held(payload.keys_of("process_name"), "umbauth.exe") + " OR lower(json_extract_string(TRY_CAST(EventData AS JSON), '$.NewProcessName')) LIKE '%umbauth.exe%' OR lower(json_extract_string(TRY_CAST(EventData AS JSON), '$.ProcessName')) LIKE '%umbauth.exe%')"),
    "filter_thread_id": (dict(thread_id="102"), f"{_PLAIN('ThreadID')} = '102'"),
    "filter_provider_like": (dict(provider="service control"), "lower(Provider) LIKE '%service control%'"),
    "filter_computer": (dict(computer="dc-core-01"), "(lower(Computer) LIKE '%dc-core-01%' OR " + _held(payload.keys_of("computer"), "dc-core-01") + ")"),
    "filter_user_sid_equivalence": (dict(user_id="S-1-5-18"), "(lower(UserID) IN ('s-1-5-18', 'system') OR " + _held(payload.keys_of("user_id"), "s-1-5-18", "system") + ")"),
    "filter_record_id": (dict(event_record_id="1000000004"), f"{_PLAIN('RecordID')} = '1000000004'"),
}
for _name, (_kw, _where) in _FILTERS.items():
    query(_name, _DEDUP + _where)(lambda spark, folder, kw=_kw: _filtered(spark, folder, **kw))

# The payloads of this log hold no status; it stands in the message and is put into one here.
_STATUS = "0xC000E7ED"


@query("filter_status_code", f"SELECT DISTINCT RecordID, EventID, Channel FROM canonical_logs WHERE regexp_extract(Message, 'status (0x[0-9A-Fa-f]+)', 1) = '{_STATUS}'")
def _(spark, folder):
    df = logs(spark, folder).withColumn("EventData", F.to_json(F.struct(F.nullif(F.regexp_extract("Message", "status (0x[0-9A-Fa-f]+)", 1), F.lit("")).alias("Status"))))
    return df.where(filters.predicate(QueryFilter(entity_filters=EntityFilters(status_code=_STATUS.lower())), df.columns)).select(*_SHOWN).distinct()


_RANGE = ("2014-10-12T06:00:00Z", "2014-10-19T18:30:00Z")
_IN_RANGE = "ts BETWEEN TIMESTAMP '2014-10-12 06:00:00' AND TIMESTAMP '2014-10-19 18:30:00'"


@query("filter_time_range", f"WITH {RECORDS_SQL} SELECT RecordID, TimeCreated, EventID FROM records WHERE {_IN_RANGE}")
def _(spark, folder):
    df = logs(spark, folder).select("RecordID", "TimeCreated", "EventID", "Computer").distinct()
    return filters.run(df, QueryFilter(time_range=TimeRange(*_RANGE)), zones=table(spark, folder, "host_zones")).select("RecordID", "TimeCreated", "EventID")


@query("filter_combined", f"WITH {RECORDS_SQL} SELECT RecordID, TimeCreated FROM records WHERE {_IN_RANGE} AND lower(Channel) = 'security' AND {_PLAIN('EventID')} = '4624' AND " + _FILTERS["filter_user_sid_equivalence"][1])
def _(spark, folder):
    df = logs(spark, folder).select("RecordID", "TimeCreated", "EventID", "Channel", "Computer", "UserID", "EventData").distinct()
    f = QueryFilter(time_range=TimeRange(*_RANGE), source_type="Security", event_id="4624", entity_filters=EntityFilters(user_id="S-1-5-18"))
    return filters.run(df, f, zones=table(spark, folder, "host_zones")).select("RecordID", "TimeCreated")


@query("keyword_search", "SELECT DISTINCT RecordID, EventID, Channel FROM canonical_logs WHERE contains(lower(Message), 'paused') OR contains(lower(Provider), 'paused') OR contains(lower(EventData), 'paused')")
def _(spark, folder):
    return filters.keyword(logs(spark, folder), "PAUSED", ["Message", "Provider", "EventData"]).select(*_SHOWN).distinct()


@query("facet_filter", "SELECT DISTINCT RecordID, EventID, Channel FROM canonical_logs WHERE EventID IN ('4624', '4625') AND LevelName IN ('LogAlways', 'Error') AND Channel IN ('Security')")
def _(spark, folder):
    return filters.facets(logs(spark, folder), {"EventID": ["4624", "4625"], "LevelName": ["LogAlways", "Error"], "Channel": ["Security"], "Computer": []}).select(*_SHOWN).distinct()


@query("where_expression", "SELECT DISTINCT RecordID FROM canonical_logs WHERE Level = '2' AND Channel = 'System'")
def _(spark, folder):
    return filters.where_ids(logs(spark, folder), "Level = '2' AND Channel = 'System'", "RecordID").distinct()


@query("fetch_by_ids", "SELECT DISTINCT RecordID, EventID, Channel FROM canonical_logs WHERE RecordID IN ('1000000000', '1000000004', '1000000008')")
def _(spark, folder):
    return filters.fetch(logs(spark, folder), "RecordID", ["1000000000", "1000000004", "1000000008"]).select(*_SHOWN).distinct()


@query("template_keyword", "SELECT template_id, event_id FROM log_templates WHERE lower(template_string) LIKE '%account%' OR event_id LIKE '%account%'")
def _(spark, folder):
    return filters.template_keyword(table(spark, folder, "log_templates"), "account").select("template_id", "event_id")


@query("template_time_overlap", "SELECT template_id, source_type FROM log_templates WHERE last_seen_utc >= '2014-10-20T00:00:00Z' AND first_seen_utc <= '2014-10-21T00:00:00Z' AND source_type = 'Security'")
def _(spark, folder):
    t = table(spark, folder, "log_templates")
    return t.where(filters.overlapping(t, "first_seen_utc", "last_seen_utc", "2014-10-20T00:00:00Z", "2014-10-21T00:00:00Z") & (F.col("source_type") == "Security")).select("template_id", "source_type")


_HUNT = "Any brute force against the domain?"


@query("hunt_events", "SELECT DISTINCT RecordID, EventID, Channel FROM canonical_logs WHERE EventID IN ('4625', '4740', '4776')")
def _(spark, folder):
    return logs(spark, folder).where(F.col("EventID").isin(filters.hunt(_HUNT)["event_ids"])).select(*_SHOWN).distinct()


@query("fallback_search", "SELECT DISTINCT RecordID, EventID, Channel FROM canonical_logs WHERE contains(lower(Message), 'quillagent') OR contains(lower(EventData), 'quillagent') OR contains(lower(Message), 'changed') OR contains(lower(EventData), 'changed')")
def _(spark, folder):
    return filters.fallback_search(logs(spark, folder), "show when QuillAgent changed", ["Message", "EventData"], ["RecordID"]).select(*_SHOWN).distinct()


@query("nl_filter", f"WITH {RECORDS_SQL} SELECT RecordID, TimeCreated, Channel FROM records WHERE lower(Channel) = 'security' AND {_PLAIN('EventID')} = '4624' AND ts BETWEEN TIMESTAMP '2014-10-10 00:00:00' AND TIMESTAMP '2014-10-10 23:59:59'")
def _(spark, folder):
    f = parse("all successful logon events on 2014-10-10", datetime(2014, 10, 30, tzinfo=timezone.utc))
    return filters.run(timed(spark, folder, "EventID", "Channel"), f, instant="ts").select("RecordID", "TimeCreated", "Channel")


# Joins between records, instances and templates.


@query("candidate_semi_join", "SELECT DISTINCT RecordID, EventID, Channel FROM canonical_logs WHERE lower(LevelName) IN ('2', 'error', 'failure', 'audit failure') AND RecordID IN (SELECT event_record_id FROM template_instances WHERE template_id IN ('tpl_0002', 'tpl_0015'))")
def _(spark, folder):
    ids = table(spark, folder, "template_instances").where(F.col("template_id").isin("tpl_0002", "tpl_0015")).select("event_record_id")
    return filters.run(logs(spark, folder), QueryFilter(level="Error"), ids, ordered=False).select(*_SHOWN).distinct()


@query("unmapped_anti_join", "SELECT DISTINCT RecordID FROM canonical_logs WHERE RecordID NOT IN (SELECT event_record_id FROM template_instances WHERE event_record_id IS NOT NULL)")
def _(spark, folder):
    return templates.unmapped(logs(spark, folder), "RecordID", table(spark, folder, "template_instances"), "event_record_id").select("RecordID").distinct()


@query("records_of_template", "SELECT DISTINCT RecordID, template_id FROM canonical_logs JOIN template_instances ON RecordID = event_record_id WHERE template_id IN ('tpl_0003', 'tpl_0009')")
def _(spark, folder):
    return templates.records_of(logs(spark, folder), "RecordID", table(spark, folder, "template_instances"), ["tpl_0003", "tpl_0009"], "event_record_id").select("RecordID", "template_id").distinct()


@query("instances_per_template", "SELECT template_id, CAST(count(DISTINCT instance_id) AS BIGINT) AS n_instances, CAST(count(DISTINCT event_record_id) AS BIGINT) AS n_records FROM template_instances GROUP BY template_id")
def _(spark, folder):
    return table(spark, folder, "template_instances").groupBy("template_id").agg(F.count_distinct("instance_id").alias("n_instances"), F.count_distinct("event_record_id").alias("n_records"))


@query("consolidated_union", "SELECT \"SourceLog\", template_id, CAST(count(*) AS BIGINT) AS n, CAST(count(instance_id) AS BIGINT) AS n_instances FROM (SELECT 'log_templates.parquet' AS \"SourceLog\", template_id, NULL AS instance_id FROM log_templates UNION ALL SELECT 'template_instances.parquet', template_id, instance_id FROM template_instances) GROUP BY ALL")
def _(spark, folder):
    both = readers.read_many(spark, [f"{folder}/log_templates.parquet", f"{folder}/template_instances.parquet"])
    return both.groupBy("SourceLog", "template_id").agg(F.count(F.lit(1)).alias("n"), F.count("instance_id").alias("n_instances"))


@query("ordered_union_of_ids", "SELECT id, CAST(min(s) AS INTEGER) AS source FROM (SELECT RecordID AS id, 0 AS s FROM canonical_logs WHERE EventID = '4672' UNION ALL SELECT event_record_id, 1 FROM entity_correlations WHERE entity_type = 'logon_id') GROUP BY id")
def _(spark, folder):
    a = logs(spark, folder).where("EventID = '4672'").select(F.col("RecordID").alias("id"), F.lit(0).alias("source"))
    b = table(spark, folder, "entity_correlations").where("entity_type = 'logon_id'").select(F.col("event_record_id").alias("id"), F.lit(1).alias("source"))
    return a.union(b).groupBy("id").agg(F.min("source").alias("source"))


@query("family_labels", "WITH f(id, label) AS (VALUES " + ", ".join(f"('{k}', '{q(v)}')" for k, v in EVENT_FAMILIES.items()) + f") SELECT DISTINCT RecordID, 'Event ' || trim(EventID) AS plain, CASE WHEN label IS NOT NULL THEN 'Event ' || trim(EventID) || ': ' || label WHEN coalesce(Channel, '') <> '' THEN Channel || ' Event ' || trim(EventID) ELSE 'Event ' || trim(EventID) END AS family FROM canonical_logs LEFT JOIN f ON trim(EventID) = id")
def _(spark, folder):
    return logs(spark, folder).select("RecordID", F.concat(F.lit("Event "), F.trim("EventID")).alias("plain"), text.family_label(F.col("EventID"), F.col("Channel")).alias("family")).distinct()


# Figures and pages.


@query("kpi_distinct_counts", "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT EventID) AS BIGINT) AS \"n_EventID\", CAST(count(DISTINCT Provider) AS BIGINT) AS \"n_Provider\", CAST(count(DISTINCT Channel) AS BIGINT) AS \"n_Channel\" FROM canonical_logs")
def _(spark, folder):
    return views.distinct_counts(logs(spark, folder), ["EventID", "Provider", "Channel"])


_WORDS = "('', 'null', 'none', 'nan', 'n/a', 'na', '<na>', 'undefined')"


def _top_sql(expr: str, name: str, k: int) -> str:
    return f"SELECT {expr} AS {name}, CAST(count(*) AS BIGINT) AS n FROM canonical_logs WHERE {expr} IS NOT NULL AND lower(trim({expr})) NOT IN {_WORDS} GROUP BY 1 ORDER BY n DESC, 1 LIMIT {k}"


@query("top_event_ids", _top_sql(_PLAIN("EventID"), "event_id", 10))
def _(spark, folder):
    return views.top(logs(spark, folder), text.strip_dot0(F.col("EventID")), "event_id", 10)


@query("top_providers", _top_sql("Provider", "provider", 8))
def _(spark, folder):
    return views.top(logs(spark, folder), F.col("Provider"), "provider", 8)


@query("top_process_ids", _top_sql(_PLAIN("ProcessID"), "pid", 5))
def _(spark, folder):
    return views.top(logs(spark, folder), text.strip_dot0(F.col("ProcessID")), "pid", 5)


@query("top_users_in_payload", "SELECT json_extract_string(TRY_CAST(EventData AS JSON), '$.TargetUserName') AS account, CAST(count(*) AS BIGINT) AS n FROM canonical_logs WHERE lower(trim(json_extract_string(TRY_CAST(EventData AS JSON), '$.TargetUserName'))) NOT IN " + _WORDS + " GROUP BY 1 ORDER BY n DESC, 1 LIMIT 4")
def _(spark, folder):
    return views.top(logs(spark, folder), payload.field(F.col("EventData"), "TargetUserName"), "account", 4)


@query("severity_distribution", f"SELECT LevelName AS level, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM canonical_logs WHERE lower(trim(LevelName)) NOT IN {_WORDS} GROUP BY 1")
def _(spark, folder):
    return views.distribution(logs(spark, folder), F.col("LevelName"), "level")


@query("coverage_span", f"WITH {RECORDS_SQL}, g AS (SELECT min(ts) AS a, max(ts) AS b FROM records), s AS (SELECT a, b, CAST(floor((epoch_us(b) - epoch_us(a)) / 1000000) AS BIGINT) AS n FROM g) SELECT strftime(a, '%Y-%m-%dT%H:%M:%SZ') AS first_utc, strftime(b, '%Y-%m-%dT%H:%M:%SZ') AS last_utc, n AS seconds, (n // 86400) || 'd ' || ((n % 86400) // 3600) || 'h' AS duration FROM s")
def _(spark, folder):
    return views.span(timed(spark, folder), "ts").select(text.utc_second(F.col("first_ts")).alias("first_utc"), text.utc_second(F.col("last_ts")).alias("last_utc"), "seconds", "duration")


@query("page_of_records", "SELECT DISTINCT RecordID, TimeCreated, Channel FROM canonical_logs ORDER BY CAST(RecordID AS BIGINT) DESC LIMIT 50 OFFSET 100")
def _(spark, folder):
    return views.page(logs(spark, folder).select("RecordID", "TimeCreated", "Channel").distinct(), [views.record_order(F.col("RecordID")).desc()], 3, 50)


@query("converter_order", "SELECT RecordID, CAST(row_number() OVER (ORDER BY CAST(RecordID AS BIGINT)) - 1 AS BIGINT) AS place FROM (SELECT DISTINCT RecordID, TimeCreated FROM canonical_logs)")
def _(spark, folder):
    r = logs(spark, folder).select("RecordID", "TimeCreated").distinct()
    return numbered_rows(r, views.converter_order(F.col("RecordID"), F.col("TimeCreated")), "place").select("RecordID", "place")


@query("event_descriptions", "WITH d(id, label) AS (VALUES " + ", ".join(f"('{k}', '{q(v)}')" for k, v in EVENT_DESCRIPTIONS.items()) + f") SELECT {_PLAIN('EventID')} AS event_id, any_value(label) AS description, CAST(count(*) AS BIGINT) AS n FROM canonical_logs LEFT JOIN d ON {_PLAIN('EventID')} = id GROUP BY 1")
def _(spark, folder):
    e = text.strip_dot0(F.col("EventID"))
    return logs(spark, folder).groupBy(e.alias("event_id")).agg(F.count(F.lit(1)).alias("n")).withColumn("description", text.description(F.col("event_id")))


def _most_sql(source: str, expr: str, k: int, how: str) -> str:
    """``how`` of the k most frequent values v (with n), in their order."""
    return f"(SELECT coalesce(string_agg({how}, ', ' ORDER BY n DESC, v), 'N/A') FROM (SELECT {expr} AS v, count(*) AS n FROM {source} WHERE {expr} IS NOT NULL AND lower(trim({expr})) NOT IN {_WORDS} GROUP BY 1 ORDER BY n DESC, v LIMIT {k}))"


def _card_sql() -> str:
    # Comma groups up to a billion.
    number = lambda e: f"regexp_replace(regexp_replace(CAST({e} AS VARCHAR), '(\\d)(\\d{{3}})$', '\\1,\\2'), '(\\d)(\\d{{3}}),', '\\1,\\2,')"
    facets = " ".join(f"UNION ALL SELECT '{f.capitalize()}: ' || string_agg(value, ', ' ORDER BY n DESC, value) FROM (SELECT * FROM fac WHERE facet = '{f}' ORDER BY n DESC, value LIMIT 3) HAVING count(*) > 0" for f in views.FACETS)
    described = " ".join(f"WHEN '{k}' THEN ' ({q(v)})'" for k, v in EVENT_DESCRIPTIONS.items())
    return f"""WITH {RECORDS_SQL}, m AS (SELECT *, {_PLAIN('EventID')} AS eid FROM records WHERE {_PLAIN('EventID')} = '4624'),
g AS (SELECT min(ts) AS a, max(ts) AS b, count(*) AS n, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000) AS BIGINT) AS secs FROM m),
fac AS (SELECT facet, value, count(*) AS n FROM ({_facet_rows('m')}) GROUP BY ALL)
SELECT 'Question: successful logons' AS line
UNION ALL SELECT 'Records: ' || {number('n')} || ' (' || printf('%.2f', n / (SELECT count(*) FROM records) * 100) || ' % of the scope)' FROM g
UNION ALL SELECT 'Span: ' || strftime(a, '%Y-%m-%dT%H:%M:%SZ') || ' to ' || strftime(b, '%Y-%m-%dT%H:%M:%SZ') || ' (' || (secs // 86400) || 'd ' || ((secs % 86400) // 3600) || 'h)' FROM g
UNION ALL SELECT 'Hosts: ' || {_most_sql('m', 'Computer', 2, 'v')}
UNION ALL SELECT 'Users: ' || {_most_sql('m', 'UserID', 3, 'v')}
UNION ALL SELECT 'Levels: ' || {_most_sql('m', 'LevelName', 20, "v || ': ' || " + number('n'))}
UNION ALL SELECT 'Events: ' || {_most_sql('m', 'eid', 3, f"'Event ' || v || CASE v {described} ELSE '' END || ': ' || " + number('n'))}
{facets}"""


def _facet_rows(source: str) -> str:
    parts = []
    for facet, (keys, none) in views.FACETS.items():
        for k in keys:
            v = f"trim(json_extract_string(TRY_CAST(EventData AS JSON), '$.{k}'))"
            shown = f"regexp_replace({v}, '^.*[\\\\/]', '')" if facet == "processes" else v
            drop = "" if not none else f" AND {v} NOT IN ({', '.join(repr(n) for n in none)})"
            parts.append(f"SELECT rid, '{facet}' AS facet, {shown} AS value FROM (SELECT row_number() OVER () AS rid, EventData FROM {source}) WHERE {v} IS NOT NULL AND lower({v}) NOT IN {_WORDS}{drop}")
    return " UNION ".join(parts)


@query("findings_card", _card_sql())
def _(spark, folder):
    r = timed(spark, folder, "EventID", "Computer", "UserID", "LevelName", "Provider", "EventData")
    f = views.findings(r.where(text.strip_dot0(F.col("EventID")) == "4624"), "ts", r.count())
    lines = [x[2:] for x in views.card("successful logons", f).splitlines() if x.startswith("- ")]
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query("first_fifty_in_time", f"WITH {RECORDS_SQL} SELECT RecordID, TimeCreated FROM records ORDER BY ts NULLS LAST, RecordID LIMIT 50")
def _(spark, folder):
    df = logs(spark, folder).select("RecordID", "TimeCreated", "Computer").distinct()
    return filters.run(df, QueryFilter(), None, 50, zones=table(spark, folder, "host_zones")).select("RecordID", "TimeCreated")


@query("pick_list", f"SELECT DISTINCT trim(Provider) AS value FROM canonical_logs WHERE lower(trim(Provider)) NOT IN {_WORDS}")
def _(spark, folder):
    return views.pick_list(logs(spark, folder), "Provider")


@query("payload_facets", f"SELECT facet, value, CAST(count(*) AS BIGINT) AS n FROM ({_facet_rows('canonical_logs')}) GROUP BY ALL")
def _(spark, folder):
    return views.payload_facets(logs(spark, folder), F.col("EventData"))


@query("dedup_ratio", "SELECT CAST(count(DISTINCT instance_id) AS BIGINT) AS records, CAST(count(DISTINCT template_id) AS BIGINT) AS templates, round((1 - count(DISTINCT template_id) / count(DISTINCT instance_id)) * 100, 6) AS saved_percent FROM template_instances")
def _(spark, folder):
    n, t = table(spark, folder, "template_instances").agg(F.count_distinct("instance_id"), F.count_distinct("template_id")).first()
    return spark.createDataFrame([(n, t, round(views.dedup_ratio(n, t), 6))], "records long, templates long, saved_percent double")


# Templates.


def _masked_sql(expr: str) -> str:
    for p, m in MASKS:
        expr = f"regexp_replace({expr}, '{q(p)}', '{m}', 'g')"
    return expr


_COLLAPSED = "trim(regexp_replace(Message, '\\s+', ' ', 'g'))"


@query("mask_signatures", f"SELECT masked, CAST(count(*) AS BIGINT) AS n FROM (SELECT {_masked_sql(_COLLAPSED)} AS masked FROM canonical_logs WHERE Message IS NOT NULL) GROUP BY 1")
def _(spark, folder):
    return logs(spark, folder).where("Message is not null").select(text.mask(text.collapse(F.col("Message"))).alias("masked")).groupBy("masked").agg(F.count(F.lit(1)).alias("n"))


_MINED_COLUMNS = ["RecordID", "TimeCreated", "EventID", "LevelName", "Channel", "Provider", "Message"]


def _prepared(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of all records, exact copies once; the sequence is the numeric record id."""
    return templates.prepared(logs(spark, folder).select(*_MINED_COLUMNS).distinct(), integer_form(F.col("RecordID")), payload_too=False)


def _whole(spark: SparkSession, folder: str) -> DataFrame:
    """Messages and payloads of all records; mining itself counts copies once, without moving the payloads for that."""
    return templates.prepared(logs(spark, folder).select(*_MINED_COLUMNS, "EventData"), integer_form(F.col("RecordID")))


_WIDE = lambda c: f"CASE WHEN {c} IS NULL OR lower(trim({c})) IN {_WORDS} THEN NULL ELSE trim({c}) END"
_CAP = lambda e: f"upper(substr({e}, 1, 1)) || lower(substr({e}, 2))"
_PREPARED_SQL = f"""
d AS (SELECT DISTINCT RecordID, TimeCreated, EventID, LevelName, Channel, Provider, Message FROM canonical_logs),
d1 AS (SELECT RecordID, CAST(RecordID AS BIGINT) AS seq, trim(TimeCreated) AS time, coalesce({_WIDE("Channel")}, 'Unknown') AS c0, coalesce({_WIDE("Provider")}, 'Unknown') AS provider,
       coalesce({_WIDE(_PLAIN("EventID"))}, '0') AS event_id, coalesce({_WIDE("LevelName")}, 'Information') AS l0,
       coalesce(nullif(trim(Message), ''), 'EventID ' || coalesce(EventID, '0') || ' from ' || coalesce(Provider, 'Unknown')) AS body FROM d),
d2 AS (SELECT *, {_CAP("c0")} AS channel, {_CAP("l0")} AS level, {_masked_sql("trim(regexp_replace(body, '\\s+', ' ', 'g'))")} AS masked FROM d1),
d3 AS (SELECT *, min(seq) OVER (PARTITION BY channel, masked) AS opened FROM d2),
d4 AS (SELECT *, dense_rank() OVER (PARTITION BY channel ORDER BY opened, masked) AS cluster FROM d3),
d5 AS (SELECT *, 'TPL_' || upper(regexp_replace(channel, '[^A-Za-z0-9]', '', 'g')) || '_' || CASE WHEN regexp_replace(event_id, '[^A-Za-z0-9]', '', 'g') = '' THEN '0' ELSE regexp_replace(event_id, '[^A-Za-z0-9]', '', 'g') END || '_' || CASE WHEN cluster < 10000 THEN lpad(CAST(cluster AS VARCHAR), 4, '0') ELSE CAST(cluster AS VARCHAR) END AS template_id FROM d4)
"""
_LEVEL_RANK = "(CASE level WHEN 'Critical' THEN 4 WHEN 'Error' THEN 3 WHEN 'Warning' THEN 2 WHEN 'Verbose' THEN 0 ELSE 1 END)"
_ROLLED = f"""min(channel) AS source_type, arg_min(provider, seq) AS provider, min(event_id) AS event_id, arg_max(level, {_LEVEL_RANK} * 1000000000000 - seq) AS level,
  arg_max(masked, seq) AS template_string, min(nullif(time, '')) AS first_seen_utc, max(nullif(time, '')) AS last_seen_utc, CAST(count(*) AS BIGINT) AS total_count"""
_ROLLUP_SQL = f"WITH {_PREPARED_SQL} SELECT template_id, {_ROLLED} FROM d5 GROUP BY template_id"
_MERGE_SQL = f"""WITH {_PREPARED_SQL}, half AS (SELECT template_id, seq % 2 AS age, {_ROLLED} FROM d5 GROUP BY template_id, seq % 2)
SELECT template_id, arg_min(source_type, age) AS source_type, arg_min(provider, age) AS provider, arg_min(event_id, age) AS event_id, arg_max(level, {_LEVEL_RANK} * 10 - age) AS level,
  arg_max(template_string, age) AS template_string, min(first_seen_utc) AS first_seen_utc, max(last_seen_utc) AS last_seen_utc, CAST(sum(total_count) AS BIGINT) AS total_count FROM half GROUP BY template_id"""


@query("signature_template_rollup", _ROLLUP_SQL)
def _(spark, folder):
    return templates.rollup(templates.signatures(_prepared(spark, folder)))


@query("template_merge", _MERGE_SQL)
def _(spark, folder):
    s = templates.signatures(_prepared(spark, folder))
    even = F.col("seq") % 2 == 0
    return templates.merge(templates.rollup(s.where(even)), templates.rollup(s.where(~even)))


@query("integrity_check", f"WITH {_PREPARED_SQL}, n AS (SELECT CAST(count(*) AS BIGINT) AS c, CAST(count(DISTINCT template_id) AS BIGINT) AS t FROM d5) SELECT c AS canonical_count, c AS instance_count, c AS template_sum_count, t AS template_count, true AS integrity_valid FROM n")
def _(spark, folder):
    p = _prepared(spark, folder)
    s = templates.signatures(p)
    return templates.integrity(p, templates.instances(s), templates.rollup(s))


@query("drain_templates")
def _(spark, folder):
    return templates.rollup(templates.mine(_whole(spark, folder)))


@query("drain_instances")
def _(spark, folder):
    return templates.instances(templates.mine(_whole(spark, folder)))


_WILD = r"<\*>|<[A-Z]+>"
_VARIABLES_SQL = rf"""WITH t AS (SELECT template_id, trim(regexp_replace(template_string, '\s+', ' ', 'g')) AS t FROM log_templates),
p AS (SELECT template_id, len(regexp_extract_all(t, '{_WILD}')) AS k, '^' || regexp_replace(regexp_replace(t, '([.^$*+?()\[\]{{}}|\\])', '\\\1', 'g'), '<\\\*>|<[A-Z]+>', '(.+?)', 'g') || '$' AS p FROM t),
b AS (SELECT DISTINCT instance_id, k, p, trim(regexp_replace(Message, '\s+', ' ', 'g')) AS body FROM template_instances JOIN p USING (template_id) JOIN canonical_logs ON event_record_id = RecordID)
SELECT instance_id, CASE WHEN NOT coalesce(regexp_matches(body, p), false) THEN '{{}}' ELSE '{{' || array_to_string(list_transform(range(k), lambda i: '"' || i || '": ' || CAST(to_json(CASE i {" ".join(f"WHEN {i} THEN regexp_extract(body, p, {i + 1})" for i in range(9))} END) AS VARCHAR)), ', ') || '}}' END AS variables FROM b"""


@query("template_variables", _VARIABLES_SQL)
def _(spark, folder):
    # The templates are those of the distinct messages, so their number is looked at before they are broadcast.
    t = broadcast_if_small(table(spark, folder, "log_templates").select("template_id", "template_string"), 100_000)
    i = table(spark, folder, "template_instances").join(t, "template_id")
    m = logs(spark, folder).select("RecordID", "Message").distinct()
    return i.join(m, F.col("event_record_id") == F.col("RecordID")).select("instance_id", templates.variables(F.col("template_string"), F.col("Message")).alias("variables")).distinct()


_FAM_VALUES = ", ".join(f"('{k}', '{q(v)}')" for k, v in EVENT_FAMILIES.items())


@query("representative_documents", f"WITH f(id, label) AS (VALUES {_FAM_VALUES}) SELECT template_id, '[Source: ' || source_type || '] [Level: ' || {_CAP("coalesce(level, 'Information')")} || '] [EventID: ' || event_id || '] [Family: ' || CASE WHEN label IS NOT NULL THEN 'Event ' || event_id || ': ' || label ELSE source_type || ' Event ' || event_id END || '] [Provider: ' || provider || '] Template: ' || template_string AS text, total_count FROM log_templates LEFT JOIN f ON event_id = id")
def _(spark, folder):
    return templates.representative(table(spark, folder, "log_templates"))


# Entities and links.


def _extract_sql() -> str:
    j = lambda k: f"trim(json_extract_string(j, '$.{k}'))"
    no = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
    rows: list[tuple[str, str]] = []
    rows += [("logon_id", f"CASE WHEN lower({j(k)}) NOT IN {no(correlate.NO_LOGON)} THEN {j(k)} END") for k in correlate.LOGON_KEYS]
    for own, k in (("ActivityID", "ActivityID"), ("RelatedActivityID", "RelatedActivityID")):
        v = f"coalesce(nullif(trim({own}), ''), {j(k)})"
        rows.append(("activity_id", f"CASE WHEN regexp_replace({v}, '[-0{{}}]', '', 'g') <> '' THEN {v} END"))
    rows.append(("user_id", f"CASE WHEN lower(trim(UserID)) NOT IN {no(correlate.NO_USER)} THEN trim(UserID) END"))
    rows += [("user_id", f"CASE WHEN lower({j(k)}) NOT IN {no(correlate.NO_USER)} AND NOT suffix({j(k)}, '$') THEN {j(k)} END") for k in correlate.NAME_KEYS]
    rows += [("user_id", f"CASE WHEN prefix({j(k)}, 'S-1-') THEN {j(k)} END") for k in correlate.SID_KEYS]
    rows += [("ip_address", f"CASE WHEN {j(k)} NOT IN {no(correlate.NO_ADDRESS)} THEN {j(k)} END") for k in correlate.ADDRESS_KEYS]
    pid0 = f"regexp_replace(trim(coalesce(nullif(trim(ProcessID), ''), {j('ProcessId')}, {j('NewProcessId')})), '\\.0$', '')"
    pid = f"CASE WHEN {pid0} <> '0' THEN {pid0} END"
    start = f"CASE WHEN {_PLAIN('EventID')} IN ('1', '4688') THEN coalesce({j('UtcTime')}, TimeCreated) END"
    rows.append(("process_id_disambiguated", f"CASE WHEN {start} IS NOT NULL THEN 'PID:' || ({pid}) || '@' || ({start}) END"))
    rows.append(("process_id", f"CASE WHEN {start} IS NULL THEN {pid} END"))
    rows.append(("thread_id", f"CASE WHEN {_PLAIN('ThreadID')} <> '0' THEN {_PLAIN('ThreadID')} END"))
    host = f"coalesce(nullif(trim(Computer), ''), {j('WorkstationName')}, {j('ComputerName')})"
    rows.append(("computer", f"CASE WHEN {host} NOT IN ('-', 'None', 'null') THEN {host} END"))
    cells = " UNION ALL ".join(f"SELECT rid, {_PLAIN('RecordID')} AS record_id, {i} AS seq, '{t}' AS entity_type, {v} AS entity_value FROM r" for i, (t, v) in enumerate(rows))
    return f"WITH r AS (SELECT *, row_number() OVER () AS rid, TRY_CAST(EventData AS JSON) AS j FROM (SELECT DISTINCT * FROM canonical_logs)), x AS ({cells}), y AS (SELECT * FROM x WHERE entity_value IS NOT NULL AND entity_value <> '' AND lower(entity_value) NOT IN ('nan', 'none', 'null')) SELECT record_id, entity_type, arg_min(entity_value, seq) AS entity_value, min(seq) AS seq FROM y GROUP BY rid, record_id, entity_type, lower(entity_value)"


_ENTITY_COLUMNS = ["RecordID", "TimeCreated", "EventID", "Channel", "Provider", "Computer", "UserID", "ProcessID", "ThreadID", "ActivityID", "RelatedActivityID", "EventData"]


@query("entity_extract", f"SELECT record_id, entity_type, entity_value FROM ({_extract_sql()})")
def _(spark, folder):
    # Copies go by the columns that entities come from; no other is read.
    return correlate.extract(logs(spark, folder).select(*_ENTITY_COLUMNS).distinct()).select("record_id", "entity_type", "entity_value")


@query("process_starts_before", f"WITH {RECORDS_SQL} SELECT RecordID, max(CASE WHEN {_PLAIN('EventID')} IN ('1', '4688') THEN {{'t': t_us, 's': coalesce(json_extract_string(TRY_CAST(EventData AS JSON), '$.UtcTime'), TimeCreated)}} END) OVER (PARTITION BY host, {_PLAIN('ProcessID')} ORDER BY t_us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW).s AS started FROM records WHERE t_us IS NOT NULL AND ProcessID IS NOT NULL")
def _(spark, folder):
    r = timed(spark, folder, "EventID", "ProcessID", "EventData").where("t_us is not null and ProcessID is not null")
    return correlate.with_last_start(r, "t_us", "started").select("RecordID", "started")


_ANCHOR = "1000000000"
_SECONDS = "CAST(floor(abs(delta_s)) AS BIGINT)"
_DELTA = f"CASE WHEN delta_s >= 0 THEN '+' ELSE '-' END || CASE WHEN {_SECONDS} < 60 THEN {_SECONDS} || 's' WHEN {_SECONDS} < 3600 THEN ({_SECONDS} // 60) || 'm ' || ({_SECONDS} % 60) || 's' ELSE ({_SECONDS} // 3600) || 'h ' || (({_SECONDS} % 3600) // 60) || 'm' END"
_TOLD_SQL = f"""SELECT *, 'Shared ' || array_to_string(list_transform(string_split(entity_type, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ': `' || entity_value || '` (' || time_delta || ' in ' || coalesce(source_type, 'None') || ')' AS relation
  FROM (SELECT event_record_id, source_type, event_id, entity_type, entity_value, confidence, confidence_weight, delta_s, {_DELTA} AS time_delta FROM m WHERE n = 1 ORDER BY confidence_weight DESC, abs(delta_s), event_record_id LIMIT 100)"""
_LINKED_SQL = f"""WITH {INDEX_SQL},
rules(entity_type, window_s, w) AS (VALUES ('logon_id', 43200, 1.0), ('activity_id', 43200, 1.0), ('user_id', 14400, 0.8), ('ip_address', 3600, 0.6), ('process_id_disambiguated', 43200, 1.0), ('process_id', 300, 0.3), ('thread_id', 300, 0.2), ('computer', 86400, 0.1)),
a AS (SELECT idx.entity_type, lower(entity_value) AS v, min(correlation_id) AS o, (SELECT min(t_us) FROM idx i JOIN rules r2 ON i.entity_type = r2.entity_type WHERE i.event_record_id = '{_ANCHOR}' AND r2.w >= 0.2) AS t0, any_value(window_s) AS window_s FROM idx JOIN rules ON idx.entity_type = rules.entity_type WHERE event_record_id = '{_ANCHOR}' AND w >= 0.2 GROUP BY ALL),
m AS (SELECT idx.event_record_id, idx.source_type, idx.event_id, idx.entity_type, idx.entity_value, idx.confidence, idx.confidence_weight, (idx.t_us - a.t0) / 1e6 AS delta_s, row_number() OVER (PARTITION BY idx.event_record_id ORDER BY idx.confidence_weight DESC, a.o, abs(idx.t_us - a.t0), idx.correlation_id) AS n
      FROM idx JOIN a ON idx.entity_type = a.entity_type AND lower(idx.entity_value) = a.v WHERE idx.event_record_id <> '{_ANCHOR}' AND abs(idx.t_us - a.t0) <= CAST(a.window_s AS BIGINT) * 1000000)
{_TOLD_SQL}"""


@query("correlate_anchor", _LINKED_SQL)
def _(spark, folder):
    return correlate.linked_to(entity_index(spark, folder), _ANCHOR)


@query("correlate_all_counts", f"""WITH {INDEX_SQL}, e AS (SELECT DISTINCT entity_type, entity_value, event_record_id, t_us, CASE entity_type WHEN 'logon_id' THEN 43200000000 ELSE 3600000000 END AS w FROM idx WHERE entity_type IN ('logon_id', 'ip_address'))
SELECT a.event_record_id, a.entity_type, a.entity_value, CAST(count(*) - 1 AS BIGINT) AS n_linked FROM e a JOIN e b ON a.entity_type = b.entity_type AND a.entity_value = b.entity_value AND b.t_us BETWEEN a.t_us - a.w AND a.t_us + a.w GROUP BY a.event_record_id, a.entity_type, a.entity_value, a.t_us""")
def _(spark, folder):
    return correlate.link_counts(entity_index(spark, folder), ["logon_id", "ip_address"]).select("event_record_id", "entity_type", "entity_value", "n_linked")


@query("entity_index_build", f"SELECT CAST(row_number() OVER (ORDER BY record_id, seq, entity_value) AS BIGINT) AS correlation_id, record_id AS event_record_id, entity_type, entity_value FROM ({_extract_sql()})")
def _(spark, folder):
    return correlate.build_index(logs(spark, folder).select(*_ENTITY_COLUMNS).distinct()).select("correlation_id", "event_record_id", "entity_type", "entity_value")


@query("annotated_records", _LINKED_SQL.replace("SELECT *, 'Shared '", "SELECT DISTINCT RecordID, time_delta AS link_delta, confidence AS link_confidence, relation AS link_relation FROM canonical_logs LEFT JOIN (SELECT *, 'Shared '") + ") ON RecordID = event_record_id")
def _(spark, folder):
    return correlate.annotate(logs(spark, folder).select("RecordID").distinct(), "RecordID", correlate.linked_to(entity_index(spark, folder), _ANCHOR))


# Time windows.


@query("clock_skew_order", f"""WITH {RECORDS_SQL}, g AS (SELECT *, t_us - lag(t_us) OVER (PARTITION BY host ORDER BY t_us, seq) AS gap FROM records WHERE t_us IS NOT NULL),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 60000000 THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY t_us, seq) AS island FROM g)
SELECT RecordID, host, min(t_us) OVER (PARTITION BY host, island) AS cluster_us, seq FROM s UNION ALL SELECT RecordID, host, NULL, seq FROM records WHERE t_us IS NULL""")
def _(spark, folder):
    return windows.skew_order(timed(spark, folder), ["host"], "t_us", "seq", 60_000_000).select("RecordID", "host", "cluster_us", "seq")


_SLIDING_SQL = f"""{RECORDS_SQL},
g AS (SELECT *, t_us - lag(t_us) OVER (PARTITION BY host ORDER BY t_us, seq) AS gap FROM records WHERE t_us IS NOT NULL AND host IS NOT NULL),
i AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY t_us, seq) AS island FROM g),
stretch AS (SELECT host, island, min(t_us) AS a, max(t_us) AS b FROM i GROUP BY ALL),
fold AS (SELECT host, island, a AS anchor, b FROM stretch WHERE island = 1
  UNION ALL SELECT s.host, s.island, CASE WHEN s.a >= fold.anchor + 480000000 * ((fold.b - fold.anchor) // 480000000 + 1) + 600000000 THEN s.a ELSE fold.anchor END, s.b FROM fold JOIN stretch s ON s.host = fold.host AND s.island = fold.island + 1),
at_window AS (SELECT i.*, anchor, unnest(range(greatest(0, (i.t_us - anchor) // 480000000 - 1), (i.t_us - anchor) // 480000000 + 1)) AS k FROM i JOIN fold ON i.host = fold.host AND i.island = fold.island),
windowed AS (SELECT *, anchor + k * 480000000 AS window_us FROM at_window WHERE t_us < anchor + k * 480000000 + 600000000)"""


@query("sliding_windows", f"WITH RECURSIVE {_SLIDING_SQL} SELECT RecordID, host, window_us FROM windowed")
def _(spark, folder):
    return windows.sliding(timed(spark, folder).where("host is not null"), ["host"], "t_us").select("RecordID", "host", "window_us")


_LINE = {"time": "TimeCreated", "computer": "Computer", "channel": "Channel", "event_id": "EventID", "level": "LevelName", "user_id": "UserID", "message": "Message"}


_WIDE_LINE = {k: _WIDE(c) for k, c in _LINE.items()}
_LINE_SQL = "concat_ws(' | ', nullif(concat_ws(' ', '[' || {time} || ']', {computer}), ''), {channel}, CASE WHEN {event_id} IS NOT NULL AND {level} IS NOT NULL THEN 'EventID: ' || {event_id} || ' (' || {level} || ')' WHEN {event_id} IS NOT NULL THEN 'EventID: ' || {event_id} WHEN {level} IS NOT NULL THEN 'Level: ' || {level} END, 'User: ' || {user_id}, 'Details: ' || substr(trim(regexp_replace({message}, '\\s+', ' ', 'g')), 1, 300))".format(**_WIDE_LINE)
_HEX_ID = lambda x: f"substr({x}, 1, 8) || '-' || substr({x}, 9, 4) || '-5' || substr({x}, 14, 3) || '-' || lower(to_hex((CAST('0x' || substr({x}, 17, 2) AS INTEGER) & 63) | 128)) || substr({x}, 19, 2) || '-' || substr({x}, 21, 12)"
_NAME_HASH = lambda x: f"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({x}))"
_CHUNK_FIELDS = {"event_ids": "EventID", "levels": "LevelName", "users": "UserID"}
_CHUNK_SQL = f"""WITH RECURSIVE {_SLIDING_SQL},
lined AS (SELECT *, {_LINE_SQL} AS line, row_number() OVER (PARTITION BY host, window_us ORDER BY t_us, seq) AS rn FROM windowed),
sized AS (SELECT *, greatest(1, length(line) // 4) AS tokens FROM lined),
filled AS (SELECT host, window_us, rn, tokens AS used, 0 AS slice FROM sized WHERE rn = 1
  UNION ALL SELECT z.host, z.window_us, z.rn, CASE WHEN used + z.tokens > 512 THEN z.tokens ELSE used + z.tokens END, CASE WHEN used + z.tokens > 512 THEN slice + 1 ELSE slice END FROM filled f JOIN sized z ON z.host = f.host AND z.window_us = f.window_us AND z.rn = f.rn + 1),
grouped AS (SELECT host, window_us, slice, string_agg(line, chr(10) ORDER BY rn) AS text, min(t_us) AS start_us, max(t_us) AS end_us, CAST(count(*) AS BIGINT) AS raw_row_count, {", ".join(f"list({_WIDE(c)} ORDER BY rn) FILTER ({_WIDE(c)} IS NOT NULL) AS {n}" for n, c in _CHUNK_FIELDS.items())}, string_agg(RecordID, ',' ORDER BY rn) AS source_rows
  FROM sized JOIN filled USING (host, window_us, rn) GROUP BY host, window_us, slice),
hashed AS (SELECT *, {_NAME_HASH("host || ':' || strftime(make_timestamp(start_us), '%Y-%m-%dT%H:%M:%SZ') || CASE WHEN slice > 0 THEN ':' || slice ELSE '' END")} AS x FROM grouped)
SELECT host, window_us, slice, text, start_us, end_us, raw_row_count, {", ".join(f"coalesce(array_to_string(list_filter({n}, lambda v, i: list_position({n}, v) = i), ','), '') AS {n}" for n in _CHUNK_FIELDS)}, source_rows, {_HEX_ID("x")} AS chunk_id FROM hashed"""


@query("window_chunks", _CHUNK_SQL)
def _(spark, folder):
    r = timed(spark, folder, *_LINE.values()).where("host is not null").withColumn("line", records.semantic_line({k: F.col(c) for k, c in _LINE.items()}))
    w = windows.sliding(r.withColumn("tokens", text.token_estimate(F.col("line"))), ["host"], "t_us")
    w = w.select("host", "window_us", "t_us", "seq", "line", "tokens", "RecordID", *_CHUNK_FIELDS.values())
    s = windows.slices(w, ["host", "window_us"], ["t_us", "seq"], "tokens")
    c = windows.chunks(s, ["host", "window_us", "slice"], [F.col("t_us"), F.col("seq")], "t_us", "line", _CHUNK_FIELDS, "RecordID")
    c = c.withColumns({n: F.array_join(n, ",") for n in [*_CHUNK_FIELDS, "source_rows"]})
    return c.withColumn("chunk_id", windows.chunk_id(F.col("host"), text.utc_second(F.timestamp_micros("start_us")), F.col("slice")))


@query("uuid5_of_rows", f"SELECT RecordID, {_HEX_ID('x')} AS chunk_id FROM (SELECT DISTINCT RecordID, {_NAME_HASH("concat_ws(':', Computer, TimeCreated)")} AS x FROM canonical_logs)")
def _(spark, folder):
    return logs(spark, folder).select("RecordID", text.uuid5(F.concat_ws(":", "Computer", "TimeCreated")).alias("chunk_id")).distinct()


@query("semantic_rows", f"SELECT DISTINCT RecordID, {_LINE_SQL} AS line FROM canonical_logs")
def _(spark, folder):
    return logs(spark, folder).select("RecordID", records.semantic_line({k: F.col(c) for k, c in _LINE.items()}).alias("line")).distinct()


def _document_sql() -> str:
    parts = []
    for c in records.DOCUMENT_ORDER:
        t = f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
        if c in records.LONG:
            t = f"CASE WHEN length({t}) > 300 THEN substr({t}, 1, 300) || '...' ELSE {t} END"
        parts.append(f"CASE WHEN {c} IS NOT NULL AND lower(trim({c})) NOT IN {_WORDS} THEN '{c}: ' || {t} END")
    rest = "CASE WHEN ProviderGuid IS NOT NULL AND lower(trim(ProviderGuid)) NOT IN " + _WORDS + " THEN 'ProviderGuid: ' || trim(ProviderGuid) END"
    return f"SELECT RecordID AS row_id, concat_ws(' | ', {', '.join(parts)}, {rest}) AS text FROM (SELECT DISTINCT * FROM canonical_logs)"


@query("row_documents", _document_sql())
def _(spark, folder):
    # Copies go by what comes out, which is shorter than the rows.
    return records.documents(logs(spark, folder)).select("row_id", "text").distinct()


@query("event_summaries")
def _(spark, folder):
    c = F.col
    return logs(spark, folder).select("RecordID", payload.summary(c("EventData"), c("Message"), c("UserData"), c("Task")).alias("summary")).distinct()


_CLEAN_COLUMNS = [c for c in CANONICAL if c not in records.LONG]


@query("clean_records", "SELECT DISTINCT " + ", ".join(f"CASE WHEN {c} IS NULL OR lower(trim({c})) IN ('', 'null', 'none', 'nan') THEN '' ELSE trim({c}) END AS \"{c}\"" for c in _CLEAN_COLUMNS) + " FROM canonical_logs")
def _(spark, folder):
    return records.clean(logs(spark, folder)).select(*_CLEAN_COLUMNS).distinct()


@query("clean_payloads")
def _(spark, folder):
    return records.clean(logs(spark, folder)).select("RecordID", *records.LONG).distinct()


@query("xml_events")
def _(spark, folder):
    c = records.clean(logs(spark, folder))
    return c.select("RecordID", writers.event_xml(c.columns).alias("xml")).distinct()


@query("markdown_batches", f"""WITH {RECORDS_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY ts NULLS FIRST, RecordID) - 1 AS i, count(*) OVER () AS total FROM records),
c AS (SELECT i, total, {", ".join(f"coalesce(replace(regexp_replace({c}, '[\\r\\n]+', ' ', 'g'), '|', chr(92) || '|'), 'None') AS {c}" for c in ("RecordID", "Channel", "Message"))} FROM n)
SELECT i // 15 AS batch, '### LOG BATCH [' || (i // 15 * 15 + 1) || ' to ' || least((i // 15 + 1) * 15, any_value(total)) || ' of ' || any_value(total) || ']' || chr(10) || 'Columns: RecordID, Channel, Message' || chr(10) || chr(10) || '| RecordID | Channel | Message |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
string_agg('| ' || RecordID || ' | ' || Channel || ' | ' || Message || ' |', chr(10) ORDER BY i) AS text FROM c GROUP BY i // 15""")
def _(spark, folder):
    return views.markdown_batches(timed(spark, folder, "Channel", "Message"), [F.col("ts"), F.col("RecordID")], ["RecordID", "Channel", "Message"])


# Vectors and words.


@query("vector_topk_prefiltered", """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def _(spark, folder):
    e = table(spark, folder, "embeddings")
    return vectors.nearest(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 5, "label")


_TERMS = ["logon", "service", "parser"]


def _bm25_sql() -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(_TERMS))
    st = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS df{i}" for i in range(len(_TERMS)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.5 / (tf{i} + 1.5 * (0.25 + 0.75 * len / a))" for i in range(len(_TERMS)))
    return f"WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, len(w) AS len, {tf} FROM d), s AS (SELECT count(*) AS n, avg(len) AS a, {st} FROM t) SELECT doc_id, round({score}, 6) AS score FROM t, s WHERE {' OR '.join(f'tf{i} > 0' for i in range(len(_TERMS)))}"


@query("bm25_scores", _bm25_sql())
def _(spark, folder):
    return vectors.bm25(table(spark, folder, "documents"), "doc_id", "text", _TERMS).withColumn("score", F.round("score", 6))


@query("sparse_vectors", "WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), a AS (SELECT avg(len(w)) AS a FROM d), e AS (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM d), t AS (SELECT doc_id, l, term, count(*) AS tf FROM e GROUP BY ALL) SELECT doc_id, term, round(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a)), 6) AS weight FROM t, a")
def _(spark, folder):
    return vectors.sparse(table(spark, folder, "documents"), "doc_id", "text").withColumn("weight", F.round("weight", 6))


@query("template_vectors_to_do", "SELECT template_id, CASE WHEN template_id <= 'tpl_0005' THEN 'embed' WHEN template_id <= 'tpl_0010' THEN 'update' ELSE 'skip' END AS action FROM log_templates")
def _(spark, folder):
    t = table(spark, folder, "log_templates")
    old = t.where("template_id > 'tpl_0005'").withColumn("text_hash", F.sha1("template_string")).withColumn("total_count", F.when(F.col("template_id") <= "tpl_0010", F.col("total_count") - 1).otherwise(F.col("total_count")))
    return vectors.changed(t, old).select("template_id", "action")


# The whole way from a question to an audit row.


_QUESTION = "what happened after the successful logon on 2014-10-06"
# Templates of event 4624: the only ones that the question's event and channel allow.
_CHOSEN = ["tpl_0001"]


def _ask(spark: SparkSession, folder: str):
    """Whole records, templates as they are, their instances and the entity index: every stage of the way has rows to work on.

    The stages look at the records several times, so their instants are worked out once and written down.
    """
    return Pipeline(cut(timed(spark, folder)), "ts", "RecordID", table(spark, folder, "log_templates"), table(spark, folder, "template_instances"), entity_index(spark, folder)).ask(_QUESTION)


_DIRECT_SQL = f"""direct AS (SELECT *, row_number() OVER (ORDER BY ts, RecordID) AS place FROM (SELECT * FROM records WHERE lower(Channel) = 'security' AND {_PLAIN('EventID')} = '4624' AND ts BETWEEN TIMESTAMP '2014-10-06 00:00:00' AND TIMESTAMP '2014-10-06 23:59:59'
  AND RecordID IN (SELECT event_record_id FROM template_instances WHERE template_id IN ('tpl_0001')) ORDER BY ts, RecordID LIMIT 50))"""
_RULES_SQL = "rules(entity_type, window_s, w) AS (VALUES ('logon_id', 43200, 1.0), ('activity_id', 43200, 1.0), ('user_id', 14400, 0.8), ('ip_address', 3600, 0.6), ('process_id_disambiguated', 43200, 1.0), ('process_id', 300, 0.3), ('thread_id', 300, 0.2), ('computer', 86400, 0.1))"
_FOUND_SQL = f"""{RECORDS_SQL}, {INDEX_SQL}, {_RULES_SQL}, {_DIRECT_SQL},
anchor AS (SELECT RecordID AS r FROM direct WHERE place = 1),
mine AS (SELECT idx.entity_type, lower(entity_value) AS v, min(correlation_id) AS o, min(t_us) AS t, any_value(window_s) AS window_s FROM idx JOIN rules ON idx.entity_type = rules.entity_type WHERE event_record_id IN (SELECT r FROM anchor) AND w >= 0.2 GROUP BY ALL),
ra AS (SELECT min(t) AS t0 FROM mine),
near AS (SELECT idx.event_record_id, idx.source_type, idx.event_id, idx.entity_type, idx.entity_value, idx.confidence, idx.confidence_weight, (idx.t_us - t0) / 1e6 AS delta_s,
  row_number() OVER (PARTITION BY idx.event_record_id ORDER BY idx.confidence_weight DESC, mine.o, abs(idx.t_us - t0), idx.correlation_id) AS n
  FROM idx JOIN mine ON idx.entity_type = mine.entity_type AND lower(idx.entity_value) = mine.v, ra WHERE idx.event_record_id NOT IN (SELECT r FROM anchor) AND abs(idx.t_us - t0) <= CAST(window_s AS BIGINT) * 1000000),
links AS (SELECT *, 'Shared ' || array_to_string(list_transform(string_split(entity_type, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ': `' || entity_value || '` (' || time_delta || ' in ' || coalesce(source_type, 'None') || ')' AS relation, row_number() OVER (ORDER BY confidence_weight DESC, abs(delta_s), event_record_id) AS place
  FROM (SELECT *, {_DELTA} AS time_delta FROM near WHERE n = 1 ORDER BY confidence_weight DESC, abs(delta_s), event_record_id LIMIT 50)),
wanted AS (SELECT RecordID AS r FROM direct UNION SELECT event_record_id FROM links),
shown AS (SELECT *, row_number() OVER (ORDER BY ts NULLS LAST, RecordID) - 1 AS i FROM (SELECT * FROM records WHERE RecordID IN (SELECT r FROM wanted) ORDER BY ts NULLS LAST, RecordID LIMIT 50))"""


@query("nl_pipeline_records", f"WITH {_FOUND_SQL} SELECT RecordID, TimeCreated, Channel FROM records WHERE RecordID IN (SELECT r FROM wanted)")
def _(spark, folder):
    return _ask(spark, folder).records.select("RecordID", "TimeCreated", "Channel")


def _context_sql() -> str:
    v = lambda c: f"coalesce({c}, '')"
    body = f"CASE WHEN trim({v('EventData')}) IN ('', '{{}}') THEN {v('Message')} ELSE {v('EventData')} END"
    named = {"RecordID": v(_PLAIN("RecordID")), "TimeCreated": v("TimeCreated"), "Channel": v("Channel"), "EventID": v("EventID"), "Level": v("LevelName"), "Provider": v("Provider"), "Computer": v("Computer"), "UserID": v("UserID"), "ProcessID": v(_PLAIN("ProcessID")), "ThreadID": v(_PLAIN("ThreadID")), "EventData": f"substr(trim(regexp_replace({body}, '\\s+', ' ', 'g')), 1, 140)"}
    line = " || ' | ' || ".join(f"'{n}=' || {c}" for n, c in named.items())
    number = lambda e: f"regexp_replace(CAST({e} AS VARCHAR), '(\\d)(\\d{{3}})$', '\\1,\\2')"
    return f"""WITH {_FOUND_SQL},
lines AS (SELECT i, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS t, {line} || coalesce(' [Correlation: Δt=' || time_delta || ', Confidence=' || l.confidence || ', Reason=' || relation || ']', '') AS line FROM shown LEFT JOIN links l ON RecordID = l.event_record_id),
blocks AS (SELECT i // 15 AS b, '--- BATCH ' || (i // 15 + 1) || ' OF ' || ((SELECT count(*) - 1 FROM shown) // 15 + 1) || ' (Chronological Window: ' || arg_min(t, i) || ' -> ' || arg_max(t, i) || ' UTC) ---' || chr(10) || '{pipeline.SCHEMA_LINE}' || chr(10) || string_agg(line, chr(10) ORDER BY i) AS text FROM lines GROUP BY i // 15),
all_blocks AS (SELECT -1 AS b, '{pipeline.SUMMARY_LINE}' || chr(10) || string_agg('- Template `' || template_id || '`: Total Occurrences=' || {number('total_count')} || ' (First Seen: ' || first_seen_utc || ', Last Seen: ' || last_seen_utc || ') | Pattern: "' || template_string || '"', chr(10) ORDER BY template_id) AS text FROM log_templates WHERE template_id IN ('tpl_0001') AND (SELECT count(*) FROM shown) > 0 HAVING count(*) > 0
  UNION ALL SELECT b, text FROM blocks
  UNION ALL SELECT 0, {" || chr(10) || ".join(f"'{x}'" for x in pipeline.EMPTY_CONTEXT.splitlines())} WHERE NOT EXISTS (FROM shown)
  UNION ALL SELECT 999, replace(replace('{pipeline.CAP_NOTE.replace("{:,}", "#").replace("{}", "@")}', '@', CAST((SELECT count(*) FROM shown) AS VARCHAR)), '#', {number('(SELECT count(*) FROM wanted)')}) FROM (SELECT count(*) AS n FROM wanted) WHERE n > (SELECT count(*) FROM shown))
SELECT CAST(row_number() OVER (ORDER BY b) - 1 AS INTEGER) AS batch, text FROM all_blocks"""


@query("pipeline_context", _context_sql())
def _(spark, folder):
    return spark.createDataFrame(list(enumerate(_ask(spark, folder).batches)), "batch int, text string")


@query("pipeline_audit", f"""WITH {_FOUND_SQL}
SELECT '{_QUESTION}' AS user_query, 'correlation' AS intent, 'tpl_0001' AS template_ids, coalesce((SELECT string_agg(RecordID, ',' ORDER BY place) FROM direct), '') AS direct_record_ids, coalesce((SELECT string_agg(event_record_id, ',' ORDER BY place) FROM links), '') AS correlated_record_ids,
  CAST((SELECT count(*) FROM wanted) AS BIGINT) AS n_final, CAST(least(5, (SELECT count(*) FROM shown)) AS BIGINT) AS n_citations, 'mock' AS backend""")
def _(spark, folder):
    a = _ask(spark, folder).audit
    joined = [F.array_join(c, ",").alias(c) for c in ("template_ids", "direct_record_ids", "correlated_record_ids")]
    return a.select("user_query", "intent", *joined, F.size("final_record_ids").cast("long").alias("n_final"), F.size("citations").cast("long").alias("n_citations"), "backend")


# Questions as the parser reads them, at a fixed time: each rule for times, entities, events, channels, levels and intents.

_ASKED_AT = datetime(2026, 9, 16, 14, 0, tzinfo=timezone.utc)
_BOUNDS = ("2026-09-10T00:00:00Z", "2026-09-12T23:59:59Z")
_ASKED = [
    ("show me the logon event for process 1064 around 3pm yesterday", "2026-09-15T14:30:00Z", "2026-09-15T15:30:00Z", True, True, "Security", None, None, "specific_instance", "process_id=1064", "logon"),
    ("what happened at 16:45", "2026-09-16T16:15:00Z", "2026-09-16T17:15:00Z", True, True, None, None, None, "ambiguous", "", "what happened at 16:45"),
    ("Check failed logins yesterday", "2026-09-15T00:00:00Z", "2026-09-15T23:59:59Z", True, True, None, None, "Error", "ambiguous", "", "failed logins"),
    ("How often did the USB reader error occur last week?", "2026-09-09T14:00:00Z", "2026-09-16T14:00:00Z", True, False, None, None, "Error", "pattern_or_aggregate", "", "USB reader error occur"),
    ("past 3 days of service started events", "2026-09-13T14:00:00Z", "2026-09-16T14:00:00Z", True, True, "System", "7036", None, "specific_instance", "", "service started"),
    ("errors of last month", "2026-08-17T14:00:00Z", "2026-09-16T14:00:00Z", True, False, None, None, "Error", "ambiguous", "", "errors"),
    ("application crash on September 11th, 2026", "2026-09-11T00:00:00Z", "2026-09-11T23:59:59Z", False, False, "Application", "1000", "Error", "specific_instance", "", "application crash"),
    ("warnings between 2026-09-14 14:00 and 2026-09-14T16:00:30", "2026-09-14T14:00:00Z", "2026-09-14T16:00:30Z", False, True, None, None, None, "ambiguous", "", "warnings"),
    ("what else happened around the time of this failed login", None, None, None, None, "Security", "4625", None, "correlation", "", "else time this failed login"),
    ("Logon failure with status 0xC000006D for user CONTOSO\\Administrator", None, None, None, None, "Security", "4625", None, "specific_instance", "status_code=0xC000006D;user_id=CONTOSO\\Administrator", "Logon failure"),
    ("Find events from provider Service Control Manager on host SEC-SRV-01", None, None, None, None, "System", None, None, "specific_instance", "computer=SEC-SRV-01;provider=Service Control Manager", "from"),
    ("event id 4688 of svchost.exe, thread 12, record REC_00452, from 10.0.0.7 in logon 0x3e7", None, None, None, None, "Security", "4688", None, "specific_instance", "event_record_id=REC_00452;ip_address=10.0.0.7;logon_id=0x3e7;process_name=svchost.exe;thread_id=12", "from"),
    ("how many critical events are there", None, None, None, None, None, None, "Critical", "pattern_or_aggregate", "", "critical are there"),
    ("show me S-1-5-21-1004336348-1177238915-682003330-512", None, None, None, None, None, None, None, "specific_instance", "user_id=S-1-5-21-1004336348-1177238915-682003330-512", "show me S-1-5-21-1004336348-1177238915-682003330-512"),
]
_ASKED_COLUMNS = {"question": "string", "start_utc": "string", "end_utc": "string", "is_relative": "boolean", "outside": "boolean", "source_type": "string", "event_id": "string", "level": "string", "intent": "string", "entities": "string", "about": "string"}


def _literal(x: object) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, bool) else f"'{q(str(x))}'"


@query("questions", f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, row)) + ')' for row in _ASKED)}) t({', '.join(_ASKED_COLUMNS)})")
def _(spark, folder):
    rows = []
    for asked, *_ in _ASKED:
        f = parse(asked, _ASKED_AT, _BOUNDS)
        named = ";".join(f"{k}={v}" for k, v in sorted(asdict(f.entity_filters).items()) if v)
        t = f.time_range
        rows.append((asked, *((t.start_utc, t.end_utc, t.is_relative, t.outside_coverage) if t else (None,) * 4), f.source_type, f.event_id, f.level, f.intent, named, f.semantic_query))
    return spark.createDataFrame(rows, ", ".join(f"{k} {v}" for k, v in _ASKED_COLUMNS.items()))


# Streams, run over what is there now.


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_dir(spark, path) else f"{folder}/events.parquet*")


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _finished(spark: SparkSession, out: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all input there is; its result as a table in the checkpoint folder."""
    base = scratch_folder(spark, "stream")

    def save(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/n={n}")

    out.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("stream_window_counts", """WITH m AS (SELECT max(epoch_us(ts)) // 1000 - 5000 AS mark_ms FROM events),
w AS (SELECT epoch_us(ts) AS t, event_type, unnest(generate_series(CAST(floor(epoch_us(ts) / 480000000) AS BIGINT) - 1, CAST(floor(epoch_us(ts) / 480000000) AS BIGINT))) AS k FROM events)
SELECT k * 480000000 AS start_us, event_type, CAST(count(*) AS BIGINT) AS n_events FROM w, m WHERE t >= k * 480000000 AND t < k * 480000000 + 600000000 AND (k * 480000000 + 600000000) // 1000 <= mark_ms GROUP BY ALL""")
def _(spark, folder):
    # Append mode: a window comes out once the watermark has passed it, and its state goes.
    counts = incremental.windowed_counts(_stream(spark, folder).withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"])
    return _finished(spark, counts.select(F.unix_micros("window_start").alias("start_us"), "event_type", F.col("n").alias("n_events")), "append").select("start_us", "event_type", "n_events")


@query("stream_state_totals", "SELECT CAST(user_id AS VARCHAR) AS key, CAST(count(*) AS BIGINT) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def _(spark, folder):
    out = _finished(spark, incremental.running_totals(_stream(spark, folder), "user_id", F.col("value")).withColumnRenamed("n", "n_events"), "update")
    last = Window.partitionBy("key").orderBy(F.desc("n"))
    return out.withColumn("r", F.row_number().over(last)).where("r = 1").select("key", "n_events", F.round("total", 4).alias("total"))
