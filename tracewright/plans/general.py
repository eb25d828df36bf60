"""Registered queries of the general data problems and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import nested, salted, sessions, timestamps
from tracewright.plans.tables import entity_rows, table
from tracewright.plans.times_sql import TIMES_SQL, host_sql

SESSION_GAP_US = 1_800_000_000


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.child_objects(table(spark, folder, "canonical_logs"), "RecordID", ["EventData", "UserData"])


def p2_fields(spark: SparkSession, folder: str) -> DataFrame:
    return nested.child_fields(table(spark, folder, "canonical_logs"), "RecordID", ["EventData", "UserData"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    e = entity_rows(spark, folder).withColumn("day_utc", F.date_from_unix_date(F.floor(F.col("t_us") / 86_400_000_000).cast("int")).cast("string"))
    return salted.salted_distinct(e, ["entity_type", "entity_value"], ["day_utc"], "event_record_id", "n_records", sample=entity_rows(spark, folder, salted.SAMPLE)).where("day_utc is not null and n_records >= 5")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    wanted = F.col("entity_type").isin("user_id", "computer")
    few = entity_rows(spark, folder, salted.SAMPLE).where(wanted)
    return sessions.sessions(entity_rows(spark, folder).where(wanted), ["entity_type", "entity_value"], "t_us", SESSION_GAP_US, "event_record_id", few)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return timestamps.resolved_notations(*[table(spark, folder, t) for t in ("canonical_logs", "template_instances", "host_zones")])


QUERIES = {"p2_found": p2_found, "p2_fields": p2_fields, "p4_found": p4_found, "p5_found": p5_found, "p7_found": p7_found}

#: Entity rows in normal form, as text to put in front of a query.
ENTITY_SQL = r"""
raw AS (SELECT DISTINCT correlation_id, event_record_id, lower(trim(entity_type)) AS t0, lower(trim(entity_value)) AS v0, lower(trim(source_type)) AS s0,
               CAST(regexp_replace(replace(time_created_utc, 'T', ' '), 'Z$', '') AS TIMESTAMP) AS ts FROM entity_correlations),
ent AS (SELECT correlation_id, event_record_id, ts, epoch_us(ts) AS t_us,
               CASE WHEN t0 LIKE '{%}' THEN trim(substr(t0, 2, length(t0) - 2)) ELSE t0 END AS entity_type,
               CASE WHEN v0 LIKE '{%}' THEN trim(substr(v0, 2, length(v0) - 2)) ELSE v0 END AS entity_value,
               CASE WHEN s0 LIKE '{%}' THEN trim(substr(s0, 2, length(s0) - 2)) ELSE s0 END AS source_type FROM raw),
entities AS (SELECT * FROM ent WHERE entity_type <> '' AND entity_value NOT IN ('', '0x0', '0x3e7', '0', '999', '0x0:0x0', '127.0.0.1', '::1', '-', '0.0.0.0',
             'localhost', 'none', 'null', 'nan', '00000000-0000-0000-0000-000000000000'))
"""

def _read(j: str) -> str:
    """A JSON string that holds an object or array as that value."""
    return f"CASE WHEN json_type({j}) = 'VARCHAR' AND regexp_matches({j} ->> '$', '^\\s*[\\[{{]') AND json_valid({j} ->> '$') THEN CAST({j} ->> '$' AS JSON) ELSE {j} END"


SQL = {
    "p2_found": f"""WITH RECURSIVE src AS (SELECT DISTINCT RecordID, 'EventData' AS root, EventData AS t FROM canonical_logs UNION SELECT DISTINCT RecordID, 'UserData', UserData FROM canonical_logs),
top AS (SELECT RecordID, root, {_read("j")} AS j FROM (SELECT RecordID, root, CAST(t AS JSON) AS j FROM src WHERE json_valid(t))),
node AS (
  SELECT RecordID AS record_id, root AS path, root AS parent, root AS up, false AS element, j FROM top WHERE json_type(j) IN ('OBJECT', 'ARRAY')
  UNION ALL
  SELECT record_id, p AS path, CASE WHEN element AND json_type(v) = 'OBJECT' THEN p ELSE parent END AS parent, parent AS up, element, v AS j FROM (
    SELECT record_id, p, parent, element, {_read("v0")} AS v FROM (
      SELECT record_id, CASE WHEN o THEN path || '.' || k ELSE path || '[' || k || ']' END AS p, parent, NOT o AS element,
             CASE WHEN o THEN json_extract(j, '$."' || k || '"') ELSE json_extract(j, '$[' || k || ']') END AS v0
      FROM (SELECT record_id, path, parent, j, json_type(j) = 'OBJECT' AS o,
                   unnest(CASE WHEN json_type(j) = 'OBJECT' THEN json_keys(j) ELSE list_transform(range(CAST(json_array_length(j) AS BIGINT)), lambda x: CAST(x AS VARCHAR)) END) AS k FROM node)))
  WHERE json_type(v) IN ('OBJECT', 'ARRAY'))
SELECT DISTINCT record_id, path AS node_path, up AS parent_path FROM node WHERE element AND json_type(j) = 'OBJECT'""",
    "p2_fields": f"""WITH RECURSIVE src AS (SELECT DISTINCT RecordID, 'EventData' AS root, EventData AS t FROM canonical_logs UNION SELECT DISTINCT RecordID, 'UserData', UserData FROM canonical_logs),
top AS (SELECT RecordID, root, {_read("j")} AS j FROM (SELECT RecordID, root, CAST(t AS JSON) AS j FROM src WHERE json_valid(t))),
node AS (
  SELECT RecordID AS record_id, root AS path, root AS owner, '' AS field, j FROM top WHERE json_type(j) IN ('OBJECT', 'ARRAY')
  UNION ALL
  SELECT record_id, p AS path, CASE WHEN o THEN owner ELSE p END AS owner, CASE WHEN NOT o THEN '' WHEN field = '' THEN k ELSE field || '.' || k END AS field, {_read("v0")} AS j FROM (
    SELECT record_id, owner, field, o, k, CASE WHEN o THEN path || '.' || k ELSE path || '[' || k || ']' END AS p,
           CASE WHEN o THEN json_extract(j, '$."' || k || '"') ELSE json_extract(j, '$[' || k || ']') END AS v0
    FROM (SELECT record_id, path, owner, field, j, json_type(j) = 'OBJECT' AS o,
                 unnest(CASE json_type(j) WHEN 'OBJECT' THEN json_keys(j) WHEN 'ARRAY' THEN list_transform(range(CAST(json_array_length(j) AS BIGINT)), lambda x: CAST(x AS VARCHAR)) END) AS k FROM node)))
SELECT record_id, owner AS node_path, field, j ->> '$' AS value FROM node WHERE json_type(j) NOT IN ('OBJECT', 'ARRAY', 'NULL')""",
    "p7_found": rf"""WITH rec AS (SELECT RecordID, min({host_sql('Computer')}) AS host FROM canonical_logs GROUP BY 1),
texts AS (SELECT DISTINCT 'canonical_logs' AS table_name, RecordID AS row_key, TimeCreated AS text, {host_sql('Computer')} AS host FROM canonical_logs
  UNION ALL SELECT DISTINCT 'template_instances', CAST(instance_id AS VARCHAR), time_created_utc, host FROM template_instances LEFT JOIN rec ON event_record_id = RecordID),
{TIMES_SQL}
SELECT DISTINCT table_name, row_key, utc_us FROM instants WHERE utc_us IS NOT NULL AND NOT regexp_matches(text, '^\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$')""",
    "p4_found": f"""WITH {ENTITY_SQL}
SELECT entity_type, entity_value, strftime(ts, '%Y-%m-%d') AS day_utc, CAST(count(DISTINCT event_record_id) AS BIGINT) AS n_records
FROM entities GROUP BY ALL HAVING count(DISTINCT event_record_id) >= 5""",
    "p5_found": f"""WITH {ENTITY_SQL},
e AS (SELECT *, t_us - lag(t_us) OVER w AS gap FROM entities WHERE entity_type IN ('user_id', 'computer') WINDOW w AS (PARTITION BY entity_type, entity_value ORDER BY t_us)),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY entity_type, entity_value ORDER BY t_us) AS sid FROM e)
SELECT entity_type, entity_value, min(t_us) AS start_us, max(t_us) AS end_us, CAST(count(DISTINCT event_record_id) AS BIGINT) AS n_records
FROM s GROUP BY entity_type, entity_value, sid""",
}
