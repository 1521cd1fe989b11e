"""Synthetic scenarios with known stage counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import STAGES

# Users who reach each stage, and subscriptions of each day of the anomaly scenario.
PLANS = {"healthy": (12, 9, 7, 4), "signup-dropoff": (12, 3, 2, 1), "payment-dropoff": (12, 10, 8, 2), "late-arrivals": (4, 4, 4, 2), "retries": (2, 1, 1, 1)}
ANOMALY_DAYS = (6, 7, 8, 7, 8, 6, 8, 1)


def scenario(spark: SparkSession, name: str, now: str = "2024-02-01 00:00:00") -> DataFrame:
    """scenario, event_id, anonymous_id, event_name, occurred_at and delivery (order of sending)."""
    if name == "subscription-anomaly":
        days = spark.createDataFrame(list(enumerate(ANOMALY_DAYS)), "day int, n int")
        rows = days.select("day", F.explode(F.sequence(F.lit(1), "n")).alias("user"), F.lit(3).alias("stage"))
        at = F.expr(f"timestamp_ntz'{now}' - make_interval(0, 0, 0, {len(ANOMALY_DAYS) - 1} - day, 0, 30, 0)")
    else:
        plan = PLANS[name]
        stages = spark.createDataFrame([(k, n) for k, n in enumerate(plan)], "stage int, n int")
        rows = stages.select(F.lit(0).alias("day"), F.explode(F.sequence(F.lit(1), "n")).alias("user"), "stage")
        at = F.expr(f"timestamp_ntz'{now}' - make_interval(0, 0, 0, 0, 0, 30 - stage, 0)")
    rows = rows.select(
        F.lit(name).alias("scenario"),
        F.concat(F.lit(f"demo-{name}-"), F.lpad("day", 2, "0"), F.lit("-"), F.lpad("user", 4, "0"), F.lit("-"), F.col("stage").cast("string")).alias("event_id"),
        F.concat(F.lit(f"demo-user-{name}-"), F.lpad("day", 2, "0"), F.lit("-"), F.lpad("user", 4, "0")).alias("anonymous_id"),
        F.element_at(F.array(*map(F.lit, STAGES)), F.col("stage") + 1).alias("event_name"),
        at.alias("occurred_at"),
        (F.lit(3) - F.col("stage") if name == "late-arrivals" else F.col("stage")).alias("delivery"),
    )
    if name == "retries":
        rows = rows.unionByName(rows.where("event_name = 'vpv' and anonymous_id like '%0001'").withColumn("delivery", F.lit(9)))
    return rows


def all_scenarios(spark: SparkSession) -> DataFrame:
    first, *rest = [scenario(spark, n) for n in (*PLANS, "subscription-anomaly")]
    for r in rest:
        first = first.unionByName(r)
    return first


def seeded(workspaces: DataFrame) -> DataFrame:
    """All scenarios for each workspace (workspace_id) of a table, with ids of their own: a demonstration for each of them."""
    rows = all_scenarios(workspaces.sparkSession)
    held = F.struct(*[F.col(c) for c in rows.columns])
    demo = rows.agg(F.collect_list(held).alias("rows"))  # the fixed plans: some two hundred events
    owners = workspaces.select("workspace_id").dropna().distinct().withColumn("_one", F.lit(1))
    out = owners.join(F.broadcast(demo.withColumn("_one", F.lit(1))), "_one").select("workspace_id", F.inline("rows"))
    return out.withColumn("event_id", F.concat("event_id", F.lit("-"), "workspace_id")).withColumn("anonymous_id", F.concat("anonymous_id", F.lit("-"), "workspace_id"))


def summary(rows: DataFrame) -> DataFrame:
    """Attempted, accepted and duplicate deliveries of each scenario and event name, by workspace where there is one."""
    per = rows.groupBy(*[c for c in ("workspace_id",) if c in rows.columns], "scenario", "event_name").agg(F.count("*").alias("attempted"), F.count_distinct("event_id").alias("accepted"))
    return per.withColumn("duplicates", F.col("attempted") - F.col("accepted"))
