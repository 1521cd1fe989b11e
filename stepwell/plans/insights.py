"""Analyses the design names beyond the funnel: time to convert, return, sessions, cohorts, breakdowns, quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import STAGES
from ..operators.funnel import JOURNEY, _firsts


def time_to_next_stage(events: DataFrame) -> DataFrame:
    """Median seconds from the first time of a stage to that of the next, per workspace, over journeys with both in order."""
    firsts = _firsts(events, *JOURNEY)
    steps = F.array(*[F.struct(F.lit(STAGES[k]).alias("stage_name"), F.when(F.col(f"t{k}") >= F.col(f"t{k - 1}"), (F.unix_micros(F.col(f"t{k}").cast("timestamp")) - F.unix_micros(F.col(f"t{k - 1}").cast("timestamp"))) / 1e6).alias("s")) for k in (1, 2, 3)])
    rows = firsts.select("workspace_id", F.inline(steps)).where("s is not null")
    return rows.groupBy("workspace_id", "stage_name").agg(F.count("*").alias("journeys"), F.median("s").alias("median_seconds"))


def return_within_week(events: DataFrame, user: Column | str = "anonymous_id", days: int = 7) -> DataFrame:
    """Per workspace and first day: new users, and those seen again on days 1 to 7. `user` says who is one."""
    seen = events.select("workspace_id", (F.col(user) if isinstance(user, str) else user).alias("user"), F.to_date("occurred_at").alias("day")).dropna().distinct()
    first = F.min("day").over(Window.partitionBy("workspace_id", "user"))
    users = seen.withColumn("first_day", first).groupBy("workspace_id", "user", "first_day").agg(F.max(F.datediff("day", "first_day").between(1, days)).alias("back"))
    return users.groupBy("workspace_id", "first_day").agg(F.count("*").alias("new_users"), F.count_if("back").alias("returned"))


def sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Per workspace: sessions by a gap in a user's events, and their mean number of events."""
    w = Window.partitionBy("workspace_id", "anonymous_id").orderBy("occurred_at", "event_id")
    gap = F.unix_micros(F.col("occurred_at").cast("timestamp")) - F.unix_micros(F.lag("occurred_at").over(w).cast("timestamp"))
    rows = events.withColumn("starts", F.coalesce(gap > gap_minutes * 60_000_000, F.lit(True)))
    return rows.groupBy("workspace_id").agg(F.count_if("starts").alias("sessions"), F.count("*").alias("event_count"))


def retention_cohorts(events: DataFrame, anchor: str, user: Column | str = "anonymous_id", days: int = 7, scope: tuple[str, ...] = ("workspace_id",)) -> DataFrame:
    """Users of each scope and cohort who are active so many periods later.

    Periods have `days` days and are counted from the day `anchor`; a cohort is the period in which a user is first seen.
    """
    period = F.floor(F.datediff(F.to_date("occurred_at"), F.lit(anchor).cast("date")) / days)
    users = events.select(*scope, (F.col(user) if isinstance(user, str) else user).alias("user"), period.alias("period")).dropna(subset=["user", "period"]).distinct()
    rows = users.withColumn("cohort", F.min("period").over(Window.partitionBy(*scope, "user")))
    return rows.groupBy(*scope, "cohort", (F.col("period") - F.col("cohort")).alias("periods_later")).agg(F.count("*").alias("users"))


def source_breakdown(events: DataFrame) -> DataFrame:
    return events.groupBy("workspace_id", "event_name").agg(F.count("*").alias("event_count"), F.count_distinct("anonymous_id").alias("users"))


def quality_gates(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    """Per workspace: volumes of both layers, duplicates, null times, and whether the layers reconcile."""
    b = bronze.groupBy("workspace_id").agg(F.count("*").alias("bronze_rows"), F.count_distinct("event_id").alias("bronze_events"), F.count_if(F.col("occurred_at").isNull()).alias("null_times"))
    s = silver.groupBy("workspace_id").agg(F.count("*").alias("silver_rows"))
    rows = b.join(s, "workspace_id", "left").fillna(0, ["silver_rows"])
    return rows.withColumn("duplicates", F.col("bronze_rows") - F.col("bronze_events")).withColumn("reconciled", F.col("bronze_events") == F.col("silver_rows"))
