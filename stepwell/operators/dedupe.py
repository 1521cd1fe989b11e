"""Deduplication by (workspace_id, event_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["workspace_id", "event_id"]


def keep_first(df: DataFrame, *order: str) -> DataFrame:
    """One row of each key: the first by `order`, ties by a hash of the raw event and its name, so that reruns agree.

    The hash is made before rows are dealt, so the raw event goes along only where it is asked for later.
    """
    w = Window.partitionBy(*KEY).orderBy(*order, F.xxhash64("accepted_event_json"), "event_name", "anonymous_id")
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def silver(df: DataFrame) -> DataFrame:
    """Batch rule: the row received first, then the one that occurred first."""
    return keep_first(df, "received_at", "occurred_at")


def pure(df: DataFrame) -> DataFrame:
    """Pure rule: the row that occurred first."""
    return keep_first(df, "occurred_at", "received_at")


def new_only(df: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose key the store has not: an idempotent append."""
    return silver(df).join(existing.select(*KEY), KEY, "left_anti")


def stats(df: DataFrame) -> DataFrame:
    """Rows, distinct keys and duplicates of each workspace."""
    per_key = df.groupBy(*KEY).agg(F.count("*").alias("n"))
    out = per_key.groupBy("workspace_id").agg(F.sum("n").cast("long").alias("row_count"), F.count("*").alias("distinct_events"))
    return out.withColumn("duplicates", F.col("row_count") - F.col("distinct_events"))
