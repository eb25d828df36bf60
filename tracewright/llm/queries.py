"""Registered queries of the training-data problems and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.entities import SYSMON, host_form, integer_form
from tracewright.llm import components, langid, leakage, nearest_time, packing, runs
from tracewright.operators.timestamps import with_instant
from tracewright.plans.general import ENTITY_SQL
from tracewright.plans.tables import entity_rows, table
from tracewright.plans.times_sql import TIMES_SQL, host_sql
from tracewright.session import cut

NEAREST_TOLERANCE_US = 120_000_000
RUN_GAP_US = 600_000_000
RUN_LEAST = 3


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    # Both sides come from one table and are needed more than once: its few rows of these types are kept instead of read again.
    e = entity_rows(spark, folder).where(F.col("entity_type").isin("ip_address", "logon_id") & F.col("source_type").isin(*SYSMON, "security"))
    e = cut(e.select("entity_type", "entity_value", "source_type", "correlation_id", "t_us"))
    met = nearest_time.nearest_in_time(e.where(F.col("source_type").isin(SYSMON)), e.where("source_type = 'security'"), ["entity_type", "entity_value"], "t_us", NEAREST_TOLERANCE_US, "correlation_id")
    return met.select(F.least("left_id", "right_id").alias("correlation_id_a"), F.greatest("left_id", "right_id").alias("correlation_id_b"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    e = entity_rows(spark, folder).where(F.col("entity_type").isin("logon_id", "activity_id"))
    return components.record_groups(e, "event_record_id", ["entity_type", "entity_value"])


def p6_near(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of one EventID whose neighbours' messages share at least half of their words."""
    logs = table(spark, folder, "canonical_logs").select("RecordID", "TimeCreated", "EventID", "Message", host_form(F.col("Computer")).alias("host")).where("host is not null")
    timed = with_instant(logs, "TimeCreated", F.col("host"), table(spark, folder, "host_zones"))
    found = runs.runs(timed, F.col("host"), "utc_us", integer_form(F.col("RecordID")), integer_form(F.col("EventID")), "RecordID", RUN_GAP_US, 2, text=F.col("Message"))
    return found.select(F.col("first_record").alias("first_record_id"), F.col("last_record").alias("last_record_id"), "duration_us", "n_records")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    logs = table(spark, folder, "canonical_logs").select("RecordID", "TimeCreated", "EventID", host_form(F.col("Computer")).alias("host")).where("host is not null")
    timed = with_instant(logs, "TimeCreated", F.col("host"), table(spark, folder, "host_zones"))
    found = runs.runs(timed, F.col("host"), "utc_us", integer_form(F.col("RecordID")), integer_form(F.col("EventID")), "RecordID", RUN_GAP_US, RUN_LEAST)
    return found.select(F.col("first_record").alias("first_record_id"), F.col("last_record").alias("last_record_id"), "n_records")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"), "doc_id", "text", "item_id", "text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return langid.label_cases(table(spark, folder, "documents"), "doc_id", "text", "lang")


def p10_segments(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return langid.language_segments(docs, "doc_id", "text", langid.fit(docs, "doc_id", "text", "lang"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p6_found": p6_found, "p6_near": p6_near, "p8_containers": p8_containers, "p9_found": p9_found, "p10_found": p10_found, "p10_segments": p10_segments}

SQL = {
    "p1_found": f"""WITH {ENTITY_SQL},
l AS (SELECT * FROM entities WHERE entity_type IN ('ip_address', 'logon_id') AND source_type IN ('sysmon', 'microsoft-windows-sysmon/operational')),
r AS (SELECT * FROM entities WHERE entity_type IN ('ip_address', 'logon_id') AND source_type = 'security'),
m AS (SELECT l.correlation_id AS a, r.correlation_id AS b, row_number() OVER (PARTITION BY l.correlation_id ORDER BY abs(l.t_us - r.t_us), r.t_us, r.correlation_id) AS n
      FROM l JOIN r ON l.entity_type = r.entity_type AND l.entity_value = r.entity_value AND abs(l.t_us - r.t_us) <= 120000000)
SELECT least(a, b) AS correlation_id_a, greatest(a, b) AS correlation_id_b FROM m WHERE n = 1""",
    "p3_found": f"""WITH RECURSIVE {ENTITY_SQL},
l AS (SELECT DISTINCT event_record_id AS r, entity_type, entity_value FROM entities WHERE entity_type IN ('logon_id', 'activity_id')),
e AS (SELECT DISTINCT a.r AS a, b.r AS b FROM l a JOIN l b ON a.entity_type = b.entity_type AND a.entity_value = b.entity_value),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT a AS event_record_id, min(b) AS group_id FROM reach GROUP BY a HAVING count(*) > 1""",
    "p6_near": rf"""WITH texts AS (SELECT DISTINCT RecordID, TimeCreated AS text, TRY_CAST(regexp_replace(trim(EventID), '\.0$', '') AS BIGINT) AS event_id, Message, {host_sql('Computer')} AS host FROM canonical_logs),
{TIMES_SQL},
o AS (SELECT *, CAST(RecordID AS BIGINT) AS n, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(Message, '')), '\s+'), lambda w: w <> '')) AS words FROM instants WHERE utc_us IS NOT NULL AND host IS NOT NULL),
b AS (SELECT *, lag(event_id) OVER w AS e0, lag(utc_us) OVER w AS t0, lag(words) OVER w AS w0 FROM o WINDOW w AS (PARTITION BY host ORDER BY utc_us, n)),
d AS (SELECT *, len(list_intersect(words, w0)) AS c FROM b),
s AS (SELECT *, CASE WHEN event_id = e0 AND utc_us - t0 <= 600000000 AND (len(words) + len(w0) = 0 OR 1 - c / (len(words) + len(w0) - c) <= 0.5) THEN 0 ELSE 1 END AS new FROM d),
r AS (SELECT *, sum(new) OVER (PARTITION BY host ORDER BY utc_us, n) AS run FROM s)
SELECT arg_min(RecordID, (utc_us, n)) AS first_record_id, arg_max(RecordID, (utc_us, n)) AS last_record_id, max(utc_us) - min(utc_us) AS duration_us, CAST(count(*) AS BIGINT) AS n_records FROM r GROUP BY host, run HAVING count(*) >= 2""",
    "p6_found": rf"""WITH texts AS (SELECT DISTINCT RecordID, TimeCreated AS text, TRY_CAST(regexp_replace(trim(EventID), '\.0$', '') AS BIGINT) AS event_id, {host_sql('Computer')} AS host FROM canonical_logs),
{TIMES_SQL},
o AS (SELECT *, CAST(RecordID AS BIGINT) AS n FROM instants WHERE utc_us IS NOT NULL AND host IS NOT NULL),
b AS (SELECT *, CASE WHEN event_id = lag(event_id) OVER w AND utc_us - lag(utc_us) OVER w <= 600000000 THEN 0 ELSE 1 END AS new FROM o WINDOW w AS (PARTITION BY host ORDER BY utc_us, n)),
r AS (SELECT *, sum(new) OVER (PARTITION BY host ORDER BY utc_us, n) AS run FROM b)
SELECT arg_min(RecordID, (utc_us, n)) AS first_record_id, arg_max(RecordID, (utc_us, n)) AS last_record_id, CAST(count(*) AS BIGINT) AS n_records FROM r GROUP BY host, run HAVING count(*) >= 3""",
}
