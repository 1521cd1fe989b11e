"""Deletion of subjects: an index from identities to days, rewrites of those days only, corrected aggregates, an audit."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import identity
from ..sources.sinks import days_of, exists, replace_days
from ..sources.subjects import MARKED, SUBJECT, as_subjects, others, theirs, without_marked
from .rebuild import _on, publish_days, rebuild_gold

AUDIT = "request_id string, step string, subjects long, days array<string>, bronze_rows long, silver_rows long, gold_days array<string>, at string"


@dataclass(frozen=True)
class Layers:
    """Where the tables are. All but the audit and the markers are partitioned by event_date or, served, by month."""

    bronze: str
    silver: str
    gold: str
    served: str
    index: str
    markers: str
    audit: str


def index_days(spark: SparkSession, layers: Layers, days: Iterable[str] | None = None) -> None:
    """Makes the index of some days, or all, anew: one row for each subject and day that Bronze has it on.

    The stream keeps it up to date itself (ingest_stream with `index`); this is for tables that were written otherwise,
    and puts many small files of a day into few. The index holds pseudonyms and is to be protected like the events themselves.
    """
    days = set(days_of(spark, layers.bronze)) if days is None else set(days)
    if days:
        rows = spark.read.parquet(layers.bronze).where(_on(days)).select(*SUBJECT, "event_date").distinct()
        replace_days(rows, layers.index, days.__contains__)


def _audit(spark: SparkSession, layers: Layers, request_id: str, step: str, at: str, subjects: int, days: list[str], rows: tuple[int | None, int | None] = (None, None), gold: list[str] | None = None) -> None:
    spark.createDataFrame([(request_id, step, subjects, days, *rows, gold, at)], AUDIT).coalesce(1).write.mode("append").json(layers.audit)


def erase(spark: SparkSession, layers: Layers, subjects: DataFrame, request_id: str, version: str, at: str, lookback_days: int = 30) -> list[str]:
    """Deletes all that the layers hold of the subjects (workspace_id, anonymous_id); returns the rebuilt days of Gold.

    A subject with a user_id is only those events of the anonymous id that name the user: others share the device.

    First a marker is written, which keeps new events of the subjects out (ingest_stream with `markers`). The index names
    the days that may hold any of them: of these, those that do are rewritten in Bronze and Silver, each table's after all
    of it was read, and all other days keep their files. Gold is rebuilt for the days that look back on them and published as a new
    snapshot. The audit has a row at the start and one at the end with scope and counts, and neither ids nor payloads.

    Null ids match nothing, repeated subjects count once, subjects that no layer holds change nothing. A run that failed
    is repeated with the same request_id: the index is rewritten last, so it still names the days.
    """
    subjects = as_subjects(subjects)
    marked = f"{layers.markers.rstrip('/')}/request_id={request_id}"
    subjects.write.mode("overwrite").parquet(marked)
    subjects = spark.read.schema(MARKED).parquet(marked)
    n = subjects.count()
    found = spark.read.parquet(layers.index).join(subjects.select(*SUBJECT).distinct(), SUBJECT, "left_semi") if exists(spark, layers.index) else None
    days = [] if found is None else sorted(str(r[0]) for r in found.select("event_date").distinct().collect())  # a row a day
    _audit(spark, layers, request_id, "started", at, n, days)
    removed = []
    for path in (layers.bronze, layers.silver):
        held = spark.read.parquet(path).where(_on(days))
        hit = {str(day): rows for day, rows in theirs(held, subjects).groupBy("event_date").count().collect()}  # a row a day
        removed.append(sum(hit.values()))
        if hit:
            replace_days(others(held.where(_on(hit)), subjects), path, hit.__contains__)
    gold: list[str] = []
    if days:
        gold = rebuild_gold(spark, layers.silver, layers.gold, days, version, at, lookback_days)
        publish_days(spark.read.parquet(layers.gold), layers.served, gold, version)
        index_days(spark, layers, days)
    _audit(spark, layers, request_id, "completed", at, n, days, (removed[0], removed[1]), gold)
    return gold


def subjects_of_people(pairs: DataFrame, users: DataFrame, folder: str, shared_beyond: int = identity.SHARED_BEYOND) -> DataFrame:
    """The subjects (for erase) that belong to the people whom some users (workspace_id, user_id) name.

    `pairs` are events with workspace_id, anonymous_id and user_id. A person is all that chains of links connect with the
    user, as in stitch_chains: every anonymous id of it is a subject as a whole. Of a shared device only the events that
    name one of the person's users are. Users that no event names, null and blank ids give no subjects.
    """
    seen = identity.links(pairs, folder)
    own = seen.where(F.col("n_users") <= shared_beyond)
    roots = identity.user_roots(own, folder)
    users = users.select("workspace_id", F.col("user_id").cast("string").alias("user_id")).dropna().distinct()
    people = users.join(roots, ["workspace_id", "user_id"], "left").select("workspace_id", F.coalesce("_root", "user_id").alias("_root")).distinct()
    all_users = roots.join(people, ["workspace_id", "_root"], "left_semi").select("workspace_id", "user_id").unionByName(users).distinct()
    # an anonymous id is of the person of the least of its users
    devices = own.where("user_id = least_user").join(all_users, ["workspace_id", "user_id"], "left_semi").select(*SUBJECT, F.lit(None).cast("string").alias("user_id"))
    on_shared = seen.where(F.col("n_users") > shared_beyond).join(all_users, ["workspace_id", "user_id"], "left_semi")
    return devices.unionByName(on_shared.select(*SUBJECT, "user_id"))


__all__ = ["AUDIT", "SUBJECT", "Layers", "erase", "index_days", "subjects_of_people", "without_marked"]
