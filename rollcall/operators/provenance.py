"""Reading and changing the provenance log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stamped(rows: DataFrame) -> DataFrame:
    """Rows with a UTC time stamp and empty metadata where they have none."""
    out = rows if "timestamp" in rows.columns else rows.withColumn("timestamp", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return out if "metadata" in out.columns else out.withColumn("metadata", F.create_map().cast("map<string,string>"))


def history(log: DataFrame, candidate_id: str | None = None, field: str | None = None) -> DataFrame:
    """Rows of a candidate, of a field, or all, in order of emission."""
    if candidate_id is not None:
        log = log.where(F.col("candidate_id") == candidate_id)
    if field is not None:
        log = log.where(F.col("field") == field)
    return log.orderBy("candidate_id", "ord")


def explain(log: DataFrame) -> DataFrame:
    """(candidate_id, field, current_value, source_count, sources) of every field: the last value and who stated it."""
    return log.groupBy("candidate_id", "field").agg(F.max_by("value", "ord").alias("current_value"), F.count_distinct("source").alias("source_count"), F.array_sort(F.collect_set("source")).alias("sources"))


def rekey(log: DataFrame, old: str, new: str) -> DataFrame:
    """All rows of candidate ``old`` under ``new``."""
    return log.withColumn("candidate_id", F.when(F.col("candidate_id") == old, F.lit(new)).otherwise(F.col("candidate_id")))


def to_json(log: DataFrame) -> DataFrame:
    """(json) of every row, nulls kept."""
    return stamped(log).select(F.to_json(F.struct("candidate_id", "field", "value", "source", "source_path", "method", "confidence", "timestamp", "metadata"), {"ignoreNullFields": "false"}).alias("json"))
