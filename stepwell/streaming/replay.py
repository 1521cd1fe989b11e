"""Controlled replay of dead letters: staged, counted, and promoted only if the counts agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.events import COLUMNS
from ..sources.sinks import append_new, exists
from ..sources.subjects import note_subjects, without_marked
from .bronze import judged, split_judged

PLACE = ["topic", "partition", "offset"]
AUDIT = "replay_id string, outcome string, letters long, found long, good long, events long"


def replay_letters(spark: SparkSession, replay_id: str, log: DataFrame, letters: DataFrame, repair: Callable[[DataFrame], DataFrame], bronze: str, staging: str, audit: str, markers: str | None = None, index: str | None = None) -> str:
    """Brings dead letters (topic, partition, offset) back into Bronze after a repair; returns promoted or refused.

    The records are read from the log again, at the letters' places: a letter holds no payload. `repair` makes of the
    records what they should have been. Those that are good now are written to staging/<replay_id>, which is read back
    and counted. All of it is promoted if every letter was found in the log, every one is good, and staging holds as
    many rows as that; then Bronze gets the events whose keys it has not. Else nothing is promoted, and staging stays to
    be looked at. The audit has a row a replay, with counts only.

    Letters that were written more than once count once, an empty list is promoted and changes nothing, and a replay that
    failed on its way is repeated with the same id: it stages anew, and Bronze takes no event twice. Events of subjects
    marked for deletion (`markers`) stay out, and the index of subjects is kept (`index`), as in ingest_stream.
    """
    places = letters.select(*PLACE).distinct()
    # a hash of the letters' places in each part: a merge would sort the whole log with its payloads
    records = log.join(places.hint("shuffle_hash"), PLACE, "left_semi").dropDuplicates(PLACE)
    parsed = judged(repair(records))
    path = f"{staging.rstrip('/')}/{replay_id}"
    parsed.write.mode("overwrite").parquet(path)
    staged = spark.read.schema(parsed.schema).parquet(path)
    wanted = places.count()
    found, good, keys = staged.agg(F.count("*"), F.count_if(F.col("reason").isNull()), F.count_distinct(F.when(F.col("reason").isNull(), F.struct("workspace_id", "event_id")))).first()
    outcome = "promoted" if wanted == found == good else "refused"
    if outcome == "promoted":
        events = split_judged(staged)[0].select(COLUMNS)
        events = without_marked(events, markers) if markers else events
        if index:
            note_subjects(events, index)
        append_new(events, bronze)
    spark.createDataFrame([(replay_id, outcome, wanted, found, good, keys)], AUDIT).coalesce(1).write.mode("append").json(audit)
    return outcome


def replays(spark: SparkSession, audit: str) -> DataFrame:
    """The audit of all replays."""
    return spark.read.schema(AUDIT).json(audit) if exists(spark, audit) else spark.createDataFrame([], AUDIT)
