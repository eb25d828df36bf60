"""Starting tables of the registered queries, once as DataFrames and once as SQL to put in front of a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.entities import host_form, integer_form, utc_micros
from tracewright.operators.timestamps import with_instant
from tracewright.plans.tables import table
from tracewright.plans.times_sql import TIMES_SQL, host_sql

def records(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """canonical_logs with exact copies once, plus ``host`` (normal form), ``seq`` (numeric record id), ``t_us`` and ``ts`` (instant, null where it has none).

    Only the columns named (and the record's id, time and computer) are read.
    """
    df = logs(spark, folder)
    if columns:
        df = df.select(*dict.fromkeys(["RecordID", "TimeCreated", "Computer", *columns]))
    df = df.distinct().withColumns({"host": host_form(F.col("Computer")), "seq": integer_form(F.col("RecordID"))})
    return with_instant(df, "TimeCreated", F.col("host"), table(spark, folder, "host_zones"), "t_us").withColumn("ts", F.timestamp_micros("t_us"))


RECORDS_SQL = f"""
texts AS (SELECT DISTINCT *, TimeCreated AS text, {host_sql("Computer")} AS host FROM canonical_logs),
{TIMES_SQL},
records AS (SELECT *, CAST(RecordID AS BIGINT) AS seq, utc_us AS t_us, make_timestamp(utc_us) AS ts FROM instants)
"""


def logs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "canonical_logs")


def entity_index(spark: SparkSession, folder: str) -> DataFrame:
    """entity_correlations with exact copies once, and its time as ``ts`` and ``t_us``."""
    e = table(spark, folder, "entity_correlations").distinct()
    t = utc_micros(F.col("time_created_utc"))
    return e.withColumn("t_us", t).withColumn("ts", F.timestamp_micros(t))


INDEX_SQL = """
idx AS (SELECT *, CAST(regexp_replace(replace(time_created_utc, 'T', ' '), 'Z$', '') AS TIMESTAMP) AS ts,
        epoch_us(CAST(regexp_replace(replace(time_created_utc, 'T', ' '), 'Z$', '') AS TIMESTAMP)) AS t_us FROM (SELECT DISTINCT * FROM entity_correlations))
"""
