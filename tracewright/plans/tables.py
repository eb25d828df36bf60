"""Reading the driver's tables and the normal forms that several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.entities import entity_form, is_entity, utc_micros


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def entity_rows(spark: SparkSession, folder: str, share: float | None = None) -> DataFrame:
    """entity_correlations in normal form, without placeholders: entity_type, entity_value, source_type, event_record_id, correlation_id, t_us.

    ``share``: a sample of that part of the rows, drawn before anything is worked out for them.
    """
    e = table(spark, folder, "entity_correlations")
    e = e.sample(share, seed=7) if share else e
    return e.select("correlation_id", "event_record_id", entity_form(F.col("entity_type")).alias("entity_type"), entity_form(F.col("entity_value")).alias("entity_value"), entity_form(F.col("source_type")).alias("source_type"), utc_micros(F.col("time_created_utc")).alias("t_us")).where(
        is_entity(F.col("entity_value")) & (F.col("entity_type") != "")
    )
