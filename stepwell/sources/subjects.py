"""Subjects of deletion: which events are theirs, the index of their days, and the markers that keep new events out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.validate import last_value
from .sinks import exists

SUBJECT = ["workspace_id", "anonymous_id"]
#: A subject: all events of an anonymous id or, with a user, those of them that name this user (a device that many share).
MARKED = "workspace_id string, anonymous_id string, user_id string"


def as_subjects(df: DataFrame) -> DataFrame:
    """Distinct subjects (MARKED) of a table that may have no user_id; null workspaces and anonymous ids are nobody."""
    user = F.col("user_id").cast("string") if "user_id" in df.columns else F.lit(None).cast("string")
    return df.select(*SUBJECT, user.alias("user_id")).dropna(subset=SUBJECT).distinct()


def _joined(events: DataFrame, subjects: DataFrame, how: str) -> DataFrame:
    who = subjects.select(F.col("workspace_id").alias("_ws"), F.col("anonymous_id").alias("_of"), F.col("user_id").alias("_user"))
    named = F.coalesce(last_value("accepted_event_json", "user_id") == F.col("_user"), F.lit(False))
    return events.join(who, (F.col("workspace_id") == F.col("_ws")) & (F.col("anonymous_id") == F.col("_of")) & (F.col("_user").isNull() | named), how)


def theirs(events: DataFrame, subjects: DataFrame) -> DataFrame:
    """Events (with accepted_event_json) of the subjects (MARKED)."""
    return _joined(events, subjects, "left_semi")


def others(events: DataFrame, subjects: DataFrame) -> DataFrame:
    """Events of nobody among the subjects; events without an anonymous id stay."""
    return _joined(events, subjects, "left_anti")


def without_marked(events: DataFrame, markers: str) -> DataFrame:
    """Events without those of subjects that are marked for deletion: what comes in after the request is kept out."""
    spark = events.sparkSession
    return others(events, spark.read.schema(MARKED).parquet(markers).distinct()) if exists(spark, markers) else events


def note_subjects(events: DataFrame, index: str) -> None:
    """Adds the subjects and days of events to the index, a folder a day. It is done before the events are stored, so no
    stored event is without its entry; an entry without an event, or one that comes again, does no harm."""
    rows = events.select(*SUBJECT, F.to_date("occurred_at").alias("event_date")).distinct()
    rows.write.mode("append").partitionBy("event_date").parquet(index)
