"""Event sources: the adapter from the generic events table to the contract's rows, NDJSON logs, and range scans."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import VERSION, not_blank, ntz, stage_index

COLUMNS = ["workspace_id", "event_id", "anonymous_id", "event_name", "occurred_at", "received_at", "schema_version", "tracking_plan_version", "funnel_definition_version", "accepted_event_json"]


def adapt(events: DataFrame, replays: bool = True) -> DataFrame:
    """Bronze rows of the generic events table. Every twentieth event comes again: received later, dated earlier."""
    names = F.create_map(*[F.lit(x) for p in (("view", "vpv"), ("signup", "signup_completed"), ("click", "activation_completed"), ("purchase", "subscription_started"), ("error", "click")) for x in p])
    ts = F.col("ts").cast("timestamp_ntz")
    journey = F.floor(F.datediff(F.to_date(ts), F.lit("2024-01-01")) / 3)
    rows = events.select(
        F.concat(F.lit("ws_"), (F.col("user_id") % 4).cast("string")).alias("workspace_id"),
        F.format_string("event-%012d", "event_id").alias("event_id"),
        F.format_string("anonymous-%08d-%03d", "user_id", journey).alias("anonymous_id"),
        names[F.col("event_type")].alias("event_name"),
        ts.alias("occurred_at"),
        (ts + F.make_dt_interval(secs=(F.col("event_id") * 37 % 600).cast("decimal(18,6)"))).alias("received_at"),
        *[F.lit(VERSION).alias(c) for c in ("schema_version", "tracking_plan_version", "funnel_definition_version")],
        F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit("}")).alias("accepted_event_json"),
        F.col("event_id").alias("_id"),
    )
    if replays:
        # one pass over the input: each row becomes one or two
        times = F.when(F.col("_id") % 20 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        rows = rows.withColumn("_nth", F.explode(times))
        rows = rows.withColumn("occurred_at", F.expr("occurred_at - make_interval(0, 0, 0, 0, 0, 2 * _nth, 0)")).withColumn("received_at", F.expr("received_at + make_interval(0, 0, 0, 0, _nth, 0, 0)"))
    return rows.select(COLUMNS)


def read_events(spark: SparkSession, sf_dir: str, replays: bool = True, start: str | None = None, end: str | None = None, lookback_days: int = 0) -> DataFrame:
    """Bronze rows of the events table. With a range, only rows that could fall into it are read: the range reaches the
    scan, a day wider on either side for events that are sent again with another time. scan_range then cuts it exactly.
    """
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = dict(raw.dtypes)["ts"]
    if start is not None:
        raw = raw.where(F.col("ts") >= F.lit(str(date.fromisoformat(start) - timedelta(days=lookback_days + 1))).cast(kind))
    if end is not None:
        raw = raw.where(F.col("ts") < F.lit(str(date.fromisoformat(end) + timedelta(days=2))).cast(kind))
    return adapt(raw, replays)


def scan_range(df: DataFrame, start: str, end: str, lookback_days: int = 0) -> DataFrame:
    """Rows that occurred from `start` (less the lookback) to the end of the day `end`: a half-open range.

    On a table that has occurred_at the range is pushed down to the scan.
    """
    low = F.expr(f"cast(date_sub(date'{start}', {int(lookback_days)}) as timestamp_ntz)")
    high = F.expr(f"cast(date_add(date'{end}', 1) as timestamp_ntz)")
    return df.where((F.col("occurred_at") >= low) & (F.col("occurred_at") < high))


def _numbered(lines: DataFrame) -> DataFrame:
    """Adds n, from 1 on, to the lines of one text file. Each split numbers its own; a sum over the others' counts precedes."""
    lines = lines.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    counts = sorted((r["part"], r["n"]) for r in lines.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    bases, before = [], 0
    for k, n in counts:
        bases.append((k, before))
        before += n
    first = lines.sparkSession.createDataFrame(bases, "part long, before long")
    rows = lines.withColumn("part", part).join(F.broadcast(first), "part")  # one row for each split of the file
    return rows.withColumn("n", F.col("before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "part", "before")


def read_log(spark: SparkSession, path: str, after: int = 0) -> DataFrame:
    """(offset, value) of the non-blank lines of a text log with offset > after; offsets count from 1."""
    if after < 0:
        raise ValueError("offset must not be negative")
    return _numbered(spark.read.text(path).where(not_blank("value"))).select(F.col("n").alias("offset"), "value").where(F.col("offset") > after)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(workspace_id, event_id, event_json) of an NDJSON store with a file per workspace.

    A record without an id, or one whose id its file has before, raises with the file and the line; only then are the
    lines of that file counted.
    """
    rows = spark.read.text(path).where(not_blank("value")).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.ndjson$", 1).alias("workspace_id"), F.get_json_object("value", "$.event_id").alias("event_id"),
        F.col("value").alias("event_json"), F.col("_metadata.file_path").alias("_file"))
    per_id = rows.groupBy("_file", "event_id").agg(F.count("*").alias("n"))
    bad = per_id.where("event_id is null or n > 1").orderBy("_file").first()
    if bad:
        lines = _numbered(spark.read.text(bad["_file"])).where(not_blank("value")).withColumn("id", F.get_json_object("value", "$.event_id"))
        known = lines.where("id is not null").groupBy("id").agg(F.min("n").alias("first"))
        wrong = lines.join(known, "id", "left").where("id is null or n > first").orderBy("n").first()
        raise ValueError(f"the event store holds {'an invalid record' if wrong['id'] is None else 'a repeated event_id'}: {bad['_file']}:{wrong['n']}")
    return rows.drop("_file")


def in_stage_order(df: DataFrame) -> DataFrame:
    """Rows of daily aggregates by workspace, day and stage of the funnel."""
    return df.orderBy("workspace_id", "event_date", stage_index(F.col("stage_name")))


def in_delivery_order(df: DataFrame) -> DataFrame:
    """Events as a late client sends them: the last stage first, ties by id."""
    return df.orderBy(F.desc("delivery"), "event_id")


__all__ = ["COLUMNS", "adapt", "in_delivery_order", "in_stage_order", "ntz", "read_events", "read_log", "read_store", "scan_range"]
