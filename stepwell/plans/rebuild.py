"""The canonical rebuild: Bronze to Silver to Gold to a serving snapshot, on Parquet tables partitioned by day."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedupe, funnel, gates, serving
from ..operators.funnel import within_lookback
from ..operators.gates import Limits
from ..sources.events import COLUMNS, scan_range
from ..sources.sinks import append_bronze, days_of, exists, exists_file, overwrite_days, replace_days, replace_text


@dataclass(frozen=True)
class RebuildConfig:
    start: str
    end: str
    snapshot_version: str
    lookback_days: int = 30

    def __post_init__(self) -> None:
        if date.fromisoformat(self.end) < date.fromisoformat(self.start):
            raise ValueError("end must not be before start")
        if self.lookback_days < 1:
            raise ValueError("lookback must be at least one day")
        if not self.snapshot_version:
            raise ValueError("a snapshot version is needed")


def days_of_interval(start: str, end: str) -> list[str]:
    """The dates an hourly run is to rebuild: all that its interval touches, so the last hour of a day is not lost."""
    return sorted({start[:10], end[:10]})


def rebuild(spark: SparkSession, bronze: str, silver: str, gold: str, config: RebuildConfig, completed_at: str) -> DataFrame:
    """Rebuilds Silver and Gold for the days of the config and returns the new Gold rows. A rerun changes nothing."""
    between = F.col("event_date").between(F.lit(config.start).cast("date"), F.lit(config.end).cast("date"))
    rows = spark.read.parquet(bronze).where(between)  # prunes partitions; the time range is the same days
    fresh = dedupe.silver(scan_range(rows, config.start, config.end).select(COLUMNS)).withColumn("event_date", F.to_date("occurred_at"))
    overwrite_days(fresh, silver, config.start, config.end)
    since = F.date_sub(F.lit(config.start).cast("date"), config.lookback_days)
    kept = spark.read.parquet(silver).where((F.col("event_date") >= since) & (F.col("event_date") <= F.lit(config.end).cast("date")))
    made = serving.snapshot(funnel.canonical_daily(kept.drop("event_date"), config.start, config.end, config.lookback_days), config.snapshot_version, completed_at)
    overwrite_days(made, gold, config.start, config.end)
    return spark.read.parquet(gold).where(between)


def _on(days: Iterable[str]) -> Column:
    """Whether a row's partition is one of the days: only those are read."""
    days = [F.lit(d).cast("date") for d in sorted(days)]
    return F.col("event_date").isin(days) if days else F.lit(False)


def rebuild_gold(spark: SparkSession, silver: str, gold: str, changed: Iterable[str], version: str, completed_at: str, lookback_days: int = 30) -> list[str]:
    """Rebuilds the Gold of all days that a change of Silver on the `changed` days can reach; returns these days.

    A day of Gold looks back over `lookback_days`, so these are the changed days and so many after each. Of Silver, only
    the days that they look back on are read; of Gold, only their files change.
    """
    held = set(days_of(spark, silver))
    targets = (within_lookback(changed, lookback_days) & held) | set(changed)
    rows = spark.read.parquet(silver).where(_on(within_lookback(targets, lookback_days, back=True) & held)).drop("event_date")
    made = serving.snapshot(funnel.canonical_days(rows, targets, lookback_days), version, completed_at)
    replace_days(made, gold, targets.__contains__)
    return sorted(targets)


def rebuild_days(spark: SparkSession, bronze: str, silver: str, gold: str, touched: Iterable[str], version: str, completed_at: str, lookback_days: int = 30, near_days: int = 1) -> list[str]:
    """Rebuilds what new events of the `touched` days change in Silver and Gold; returns the days of Gold it rebuilt.

    Copies of an event lie within `near_days` of each other (0: Bronze has none). So a new event can change which copy
    counts on its own day and so many on either side, and those days are deduplicated against as many again around them.
    """
    around = lambda days: {str(date.fromisoformat(d) + timedelta(days=k)) for d in days for k in range(-near_days, near_days + 1)}
    held = set(days_of(spark, bronze))
    changed = around(touched) & held
    rows = spark.read.parquet(bronze).where(_on(around(changed) & held)).select(COLUMNS)
    fresh = dedupe.silver(rows).withColumn("event_date", F.to_date("occurred_at")).where(_on(changed))
    replace_days(fresh, silver, changed.__contains__)
    return rebuild_gold(spark, silver, gold, changed, version, completed_at, lookback_days)


def touched_days(spark: SparkSession, manifest: str, done: str) -> tuple[int, list[str]]:
    """The last batch that the stream has noted, and the days of all batches after the one that `done` names.

    The stream appends a batch before it notes it, so what is noted is in Bronze. Without a batch to do, -1 and no days.
    """
    if not exists(spark, manifest):
        return -1, []
    through = int(spark.read.text(done).first()[0]) if exists_file(spark, done) else -1
    rows = spark.read.schema("event_date string, event_count long, batch long").json(manifest).where(F.col("batch") > through)
    last, days = rows.agg(F.max("batch"), F.collect_set("event_date")).first()  # a text a day
    return (-1, []) if last is None else (last, sorted(days))


def judge_rebuilt(spark: SparkSession, bronze: str, silver: str, gold: str, rebuilt: Iterable[str], lookback_days: int, limits: Limits) -> DataFrame:
    """The quality gates of the rebuilt days. Read are these, the days they look back on, and those of the usual volume."""
    rebuilt = sorted(rebuilt)
    held = days_of(spark, bronze)
    earlier = {d for day in rebuilt for d in [x for x in held if x < day][-limits.earlier_days :]}
    near = (within_lookback(rebuilt, lookback_days, back=True) | earlier) & set(held) | set(rebuilt)
    layers = [spark.read.parquet(path).where(_on(near)) for path in (bronze, silver, gold)]
    return gates.judge_days(gates.day_metrics(*layers), limits).where(_on(rebuilt))


def rebuild_touched(spark: SparkSession, bronze: str, silver: str, gold: str, served: str, manifest: str, done: str, version: str, completed_at: str, lookback_days: int = 30, limits: Limits | None = None, judged: str | None = None) -> list[str]:
    """Rebuilds and publishes what the batches changed that came since the last time; returns the days of Gold.

    Late events are batches like others: only their days, and those that look back on them, are read and written. The
    result is that of a rebuild of all days that each look back for themselves. `done` names the last batch that went in
    and is written at the end, so a failed run is repeated as a whole.

    With `limits`, a workspace's day that fails a quality gate is not published, and the serving view keeps its older
    snapshot; other days are. The gates' results are written to `judged` (by event_date), the last ones of each day.
    """
    last, days = touched_days(spark, manifest, done)
    if not days:
        return []
    rebuilt = rebuild_days(spark, bronze, silver, gold, days, version, completed_at, lookback_days)
    rows = spark.read.parquet(gold)
    if limits is not None:
        if judged is None:
            raise ValueError("the gates' results need a place")
        replace_days(judge_rebuilt(spark, bronze, silver, gold, rebuilt, lookback_days, limits), judged, set(rebuilt).__contains__)
        rows = gates.passing(rows, spark.read.parquet(judged).where(_on(rebuilt)))
    publish_days(rows, served, rebuilt, version)
    replace_text(spark, done, str(last))
    return rebuilt


def publish_days(gold: DataFrame, path: str, days: Iterable[str], version: str) -> None:
    """Appends the snapshot of several days to the serving table in one write; days it has in that version are left out."""
    spark = gold.sparkSession
    rows = gold.where(_on(days) & (F.col("snapshot_version") == version)).select(serving.COLUMNS)
    if exists(spark, path):
        had = spark.read.parquet(path).where(_on(days) & (F.col("snapshot_version") == version)).select("event_date").distinct()
        rows = rows.join(had, "event_date", "left_anti")
    rows.select(serving.COLUMNS).withColumn("month", F.date_format("event_date", "yyyyMM")).sortWithinPartitions("workspace_id", "event_date").write.mode("append").partitionBy("month").parquet(path)


def run_hour(spark: SparkSession, bronze: str, silver: str, gold: str, served: str, interval: tuple[str, str], run_id: str, lookback_days: int = 30, retries: int = 2, delay: float = 300.0, stale_after: float = 4 * 3600.0) -> str:
    """The hourly run over an interval (start, end; ISO text): rebuilds its days, then publishes them; returns the version.

    One run at a time: a marker beside Gold names the run that is at work and since when, and another one raises. A
    marker older than `stale_after` seconds is that of a driver that was lost, and is taken over. A failed attempt is
    repeated, twice by default, after a delay; both steps may be repeated safely. Each day is published as a snapshot,
    which the current view takes once it is whole.
    """
    version, lock = f"hourly-{run_id}", f"{gold.rstrip('/')}.lock"
    path = spark._jvm.org.apache.hadoop.fs.Path(lock)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not _claim(spark, fs, path, version, stale_after):
        raise RuntimeError(f"another run is at work: {lock}")
    try:
        for day in days_of_interval(*interval):
            for attempt in range(retries + 1):
                try:
                    rows = rebuild(spark, bronze, silver, gold, RebuildConfig(day, day, version, lookback_days), interval[1].replace("T", " "))
                    publish(rows, served, day, version)
                    break
                except Exception:
                    if attempt == retries:
                        raise
                    time.sleep(delay)
    finally:
        fs.delete(path, False)
    return version


def _claim(spark: SparkSession, fs, path, owner: str, stale_after: float) -> bool:
    """Makes the marker of a run. One that is too old is moved away first, which only one of several runs can do."""
    if fs.exists(path) and time.time() - fs.getFileStatus(path).getModificationTime() / 1000 > stale_after:
        aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path.toString()}.{uuid.uuid4().hex}")
        if fs.rename(path, aside):
            fs.delete(aside, False)
    try:
        out = fs.create(path, False)  # fails if it is there
    except Py4JJavaError:
        return False
    out.write(bytearray(owner.encode()))
    out.close()
    return True


def publish(gold: DataFrame, path: str, event_date: str, version: str) -> None:
    """Appends one day's snapshot to the serving table; the current view picks the last one.

    A snapshot that the table has already is not appended again.
    """
    spark = gold.sparkSession
    if exists(spark, path):
        day = F.col("event_date") == F.lit(event_date).cast("date")
        if not spark.read.parquet(path).where(day & (F.col("snapshot_version") == version)).isEmpty():
            return
    rows = gold.where((F.col("event_date") == F.lit(event_date).cast("date")) & (F.col("snapshot_version") == version)).select(serving.COLUMNS)
    rows.withColumn("month", F.date_format("event_date", "yyyyMM")).sortWithinPartitions("workspace_id", "event_date").write.mode("append").partitionBy("month").parquet(path)


def publish_jdbc(gold: DataFrame, url: str, table: str, event_date: str, version: str, **options: str) -> None:
    """Appends one day's snapshot to a serving table over JDBC, in batches of 500 rows; the driver is to be on the class path.

    A snapshot that the table has already is not appended again. A write that failed on its way may have left a part of
    it, which is removed by nothing here: give the next attempt a version of its own, which the current view prefers.
    """
    day = F.col("event_date") == F.lit(event_date).cast("date")
    rows = gold.where(day & (F.col("snapshot_version") == version)).select(serving.COLUMNS)
    reader = gold.sparkSession.read.format("jdbc").options(url=url, **options)
    held = reader.option("query", f"SELECT COUNT(*) AS n FROM {table} WHERE \"event_date\" = '{date.fromisoformat(event_date)}' AND \"snapshot_version\" = '{version.replace(chr(39), chr(39) * 2)}'")
    if held.load().first()[0] == 0:
        rows.write.format("jdbc").options(url=url, dbtable=table, batchsize="500", **options).mode("append").save()


def delete_subject(df: DataFrame, subjects: DataFrame) -> DataFrame:
    """Rows without those of the (workspace_id, anonymous_id) to forget; Gold is rebuilt from the result."""
    return df.join(subjects, ["workspace_id", "anonymous_id"], "left_anti")


def write_report(spark: SparkSession, path: str, document: str) -> None:
    """Replaces a published report by a whole new one."""
    replace_text(spark, path, document)


__all__ = ["RebuildConfig", "append_bronze", "days_of_interval", "delete_subject", "judge_rebuilt", "overwrite_days", "publish", "publish_days", "publish_jdbc", "rebuild", "rebuild_days", "rebuild_gold", "rebuild_touched", "run_hour", "touched_days", "write_report"]
