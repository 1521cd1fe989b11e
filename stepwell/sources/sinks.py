"""Sinks: partitioned tables, idempotent appends, whole-file replacement, Kafka, and exports."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import dedupe

KAFKA_PRODUCER = {"kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.delivery.timeout.ms": "30000", "kafka.request.timeout.ms": "5000"}


def _store(spark: SparkSession, path: str):
    """The Hadoop path and file system of a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written there. An append of no rows leaves only marks of its success, which is no table yet."""
    at, fs = _store(spark, path)
    return fs.exists(at) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(at))


def exists_file(spark: SparkSession, path: str) -> bool:
    at, fs = _store(spark, path)
    return fs.exists(at)


def append_bronze(df: DataFrame, path: str) -> None:
    """Appends events under their day; times are zoneless UTC, so batch and stream write the same table."""
    df.withColumn("event_date", F.to_date("occurred_at")).write.mode("append").partitionBy("event_date").parquet(path)


def append_new(df: DataFrame, path: str, days: int | None = None) -> None:
    """Appends the events whose key the table has not. A repeated append adds nothing, whatever times its events bear.

    All keys of the table are read, and nothing but the keys. With `days`, only those of the new events' days and so many
    on either side are: what comes again with a time further off is then stored again, and left to Silver.
    """
    df, spark = dedupe.silver(df), df.sparkSession
    if exists(spark, path):
        held = spark.read.parquet(path)
        if days is not None:
            own = df.select(F.to_date("occurred_at").alias("event_date")).distinct()
            near = F.explode(F.sequence(F.date_sub("event_date", days), F.date_add("event_date", days)))
            dates = [r[0] for r in own.select(near.alias("event_date")).distinct().collect()]  # a row a day
            held = held.where(F.col("event_date").isin(dates) if dates else F.lit(False))
        df = df.join(held.select(*dedupe.KEY), dedupe.KEY, "left_anti")
    append_bronze(df, path)


def days_of(spark: SparkSession, path: str) -> list[str]:
    """The days a table partitioned by event_date has, in order, by its folders."""
    if not exists(spark, path):
        return []
    at, fs = _store(spark, path)
    names = (s.getPath().getName() for s in fs.listStatus(at))
    return sorted(n.removeprefix("event_date=") for n in names if n.startswith("event_date=") and n != "event_date=__HIVE_DEFAULT_PARTITION__")


def replace_days(df: DataFrame, path: str, replaced: Callable[[str], bool]) -> set[str]:
    """Replaces the days for which `replaced` holds in a table partitioned by event_date; returns the days written.

    df is evaluated once. The days written are observed on the way; dynamic overwrite leaves partitions without new rows
    as they are, so those to be replaced that got none are removed after the write has ended well. Other days keep their
    files. df may read the table itself: files change only after all of it was read.
    """
    spark, seen = df.sparkSession, Observation()
    # a rebalance by day gives each day's files one writer, or several where the day is large
    rows = df.hint("rebalance", "event_date").observe(seen, F.collect_set(F.col("event_date").cast("string")).alias("days"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)
    written = set(seen.get["days"])
    at, fs = _store(spark, path)
    for day in days_of(spark, path):
        if replaced(day) and day not in written:
            _must(fs.delete(_store(spark, f"{path.rstrip('/')}/event_date={day}")[0], True), f"cannot remove the day {day} of {path}")
    return written


def overwrite_days(df: DataFrame, path: str, start: str, end: str) -> None:
    """Replaces the days [start, end] of a table partitioned by event_date; days that df has no rows for become empty."""
    replace_days(df, path, lambda day: start <= day <= end)


def _must(done: bool, what: str) -> None:
    """File systems report some failures by their answer alone."""
    if not done:
        raise OSError(what)


def _move_files(fs, jvm, source, target) -> None:
    """Moves the files of a folder into another one, which may exist. What was moved before is not there any more."""
    fs.mkdirs(target)
    for f in fs.listStatus(source):
        name = f.getPath().getName()
        if not name.startswith(("_", ".")):
            _must(fs.rename(f.getPath(), jvm.Path(target, name)), f"cannot move {f.getPath()} to {target}")


def _swap_in(spark: SparkSession, beside, here) -> None:
    """Moves a day's copy into its place, and what came to the day after the copy was begun back to it."""
    jvm, fs = spark._jvm.org.apache.hadoop.fs, here.getFileSystem(spark._jsc.hadoopConfiguration())
    copied = {r[0] for r in spark.read.text(jvm.Path(beside, "copied").toString()).collect()}  # names of one day's files
    _move_files(fs, jvm, jvm.Path(beside, "new"), here)
    for f in fs.listStatus(jvm.Path(beside, "old")):
        name = f.getPath().getName()
        if name not in copied and not name.startswith(("_", ".")):
            _must(fs.rename(f.getPath(), jvm.Path(here, name)), f"cannot move {f.getPath()} back")


def _put_back(spark: SparkSession, beside, here, copies: set[str]) -> None:
    """Undoes a swap that was refused. What fails here as well is left to recover_compaction."""
    jvm, fs = spark._jvm.org.apache.hadoop.fs, here.getFileSystem(spark._jsc.hadoopConfiguration())
    new = jvm.Path(beside, "new")
    for f in fs.listStatus(here) if fs.exists(here) else ():
        if f.getPath().getName() in copies:
            _must(fs.rename(f.getPath(), jvm.Path(new, f.getPath().getName())), f"cannot move {f.getPath()} away")
    _must(fs.rename(new, jvm.Path(beside, "undone")), f"cannot give up {new}")
    _move_files(fs, jvm, jvm.Path(beside, "old"), here)
    _must(fs.delete(beside, True), f"cannot remove {beside}")


def recover_compaction(spark: SparkSession, path: str) -> int:
    """Ends what a compaction left that did not come to its end; returns how many days it found so.

    Beside the table, a day under way is a folder _compact-<day>-<id>. `old` is the day's folder, moved there once the
    copy in `new` was whole: with both, what is left of `new` still has to go into the day. With `undone`, what is left
    of `old` goes back. Without `old` the day was not touched; with it alone the swap was over. All of it may be repeated.
    """
    at, fs = _store(spark, path)
    jvm, found = spark._jvm.org.apache.hadoop.fs, 0
    for s in fs.listStatus(at):
        name = s.getPath().getName()
        if not name.startswith("_compact-"):
            continue
        new, old, undone = (jvm.Path(s.getPath(), n) for n in ("new", "old", "undone"))
        here = jvm.Path(at, f"event_date={name.removeprefix('_compact-')[:10]}")
        if fs.exists(old) and fs.exists(undone):
            _move_files(fs, jvm, old, here)
        elif fs.exists(old) and fs.exists(new):
            _swap_in(spark, s.getPath(), here)
        _must(fs.delete(s.getPath(), True), f"cannot remove {s.getPath()}")
        found += 1
    return found


def compact_days(spark: SparkSession, path: str, start: str, end: str, target_bytes: int = 256 << 20) -> int:
    """Rewrites the days [start, end] of a table with files of about `target_bytes`; returns how many days had more.

    The rows of a day are copied beside it; then its folder is moved away and the copy's files are moved into its place,
    among those that a writer may have put there meanwhile. Every move is checked: one that is refused puts the day back
    and raises. A driver lost on the way leaves the day to recover_compaction, which every compaction calls first; until
    then readers may miss the day, but no row is lost. Nothing else may replace these days at the same time.
    """
    at, fs = _store(spark, path)
    jvm, done = spark._jvm.org.apache.hadoop.fs, 0
    recover_compaction(spark, path)
    for day in days_of(spark, path):
        if not start <= day <= end:
            continue
        here = jvm.Path(at, f"event_date={day}")
        files = [f for f in fs.listStatus(here) if f.getPath().getName().endswith(".parquet")]
        wanted = max(1, -(-sum(f.getLen() for f in files) // target_bytes))
        if len(files) <= wanted:
            continue
        beside = jvm.Path(at, f"_compact-{day}-{uuid.uuid4().hex}")
        new = jvm.Path(beside, "new")
        spark.read.parquet(*[f.getPath().toString() for f in files]).coalesce(wanted).write.parquet(new.toString())
        replace_text(spark, jvm.Path(beside, "copied").toString(), "\n".join(f.getPath().getName() for f in files))
        copies = {f.getPath().getName() for f in fs.listStatus(new)}
        if not fs.rename(here, jvm.Path(beside, "old")):
            fs.delete(beside, True)
            raise OSError(f"cannot move {here} away")
        try:
            _swap_in(spark, beside, here)
        except Exception:
            _put_back(spark, beside, here, copies)
            raise
        _must(fs.delete(beside, True), f"cannot remove {beside}")
        done += 1
    return done


def expire_days(spark: SparkSession, paths: dict[str, str], kept_days: dict[str, int], today: str) -> dict[str, list[str]]:
    """Removes the days of each table that its class of data keeps no longer; returns the days removed by class.

    `paths` names a table partitioned by event_date for each class, `kept_days` how many days up to `today` it keeps. A
    class without a rule raises before anything is removed: nothing is kept for ever by mistake. Whole days go, so no
    file is read or rewritten.
    """
    if missing := sorted(set(paths) - set(kept_days)):
        raise ValueError(f"no retention for {', '.join(missing)}")
    removed: dict[str, list[str]] = {}
    for name, path in paths.items():
        first = str(date.fromisoformat(today) - timedelta(days=kept_days[name] - 1))
        removed[name] = [day for day in days_of(spark, path) if day < first]
        for day in removed[name]:
            at, fs = _store(spark, f"{path.rstrip('/')}/event_date={day}")
            _must(fs.delete(at, True), f"cannot remove the day {day} of {path}")
    return removed


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small document whole before it replaces the one that was there; readers see the old or the new one."""
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    temporary, fs = _store(spark, part)
    out = fs.create(temporary, True)
    try:
        out.write(bytearray(text.encode()))
        out.close()
        jvm = spark._jvm.org.apache.hadoop.fs
        over = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
        over[0] = jvm.Options.Rename.OVERWRITE
        context = jvm.FileContext.getFileContext(temporary.toUri(), spark._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(temporary), fs.makeQualified(_store(spark, path)[0]), over)
    finally:
        fs.delete(temporary, True)


def replace_json(report: DataFrame, path: str, column: str = "report") -> None:
    """Writes the one JSON document that a report has; raises if it has none or several."""
    rows = report.select(column).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a snapshot is one document")
    replace_text(report.sparkSession, path, rows[0][0])


def publish_kafka(records: DataFrame, servers: str, topic: str, **options: str):
    """A writer of (key, value) records to a topic, acknowledged by all replicas and idempotent; call save() on it.

    Needs the Kafka connector on the class path. All records count as written: this log drops no repeats.
    """
    rows = records.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    return rows.write.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic, **KAFKA_PRODUCER, **options})


def export(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Events or aggregates as CSV (with a header) or Parquet."""
    if form not in ("csv", "parquet"):
        raise ValueError("an export is csv or parquet")
    writer = df.write.mode("errorifexists")
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)


class SessionStore:
    """Events of a session: the contract of the event store behind a temporary view, in a folder that all machines share.

    An append is written, so the view stays one scan however often the store is appended to, and a lost executor costs
    nothing.
    """

    def __init__(self, spark: SparkSession, name: str, schema, path: str):
        self.spark, self.name, self.schema, self.path = spark, name, schema, path
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
        self._show()

    def _show(self) -> None:
        self.spark.read.schema(self.schema).parquet(self.path).createOrReplaceTempView(self.name)

    def append(self, df: DataFrame) -> None:
        """Adds the events whose key the store has not."""
        held = self.spark.table(self.name)
        dedupe.new_only(df, held).select(held.columns).write.mode("append").parquet(self.path)
        self._show()

    def snapshot(self, workspace_id: str) -> DataFrame:
        return self.spark.table(self.name).where(F.col("workspace_id") == workspace_id)

    def close(self) -> None:
        """Forgets the events."""
        self.spark.catalog.dropTempView(self.name)
        at, fs = _store(self.spark, self.path)
        _must(fs.delete(at, True), f"cannot remove {self.path}")
