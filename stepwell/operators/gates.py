"""Quality gates of each workspace and day: what fails keeps its day from being published."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import STAGES, not_blank
from .funnel import JOURNEY, _firsts

DAY = ["workspace_id", "event_date"]
#: Columns that every event must have.
REQUIRED = ("event_id", "anonymous_id", "event_name", "occurred_at", "received_at", "schema_version", "tracking_plan_version", "funnel_definition_version")
GATES = ("volume", "duplicates", "nulls", "order", "freshness", "reconciliation")


@dataclass(frozen=True)
class Limits:
    """When a gate fails: events below a share of the median of earlier days, and shares above which faults count."""

    volume: float = 0.5
    earlier_days: int = 7
    least_days: int = 3
    duplicates: float = 0.2
    nulls: float = 0.01
    order: float = 0.1
    late: float = 0.05


def _missing(name: str) -> Column:
    return F.col(name).isNull() if name.endswith("_at") else ~F.coalesce(not_blank(name), F.lit(False))


def day_metrics(bronze: DataFrame, silver: DataFrame, gold: DataFrame, late_seconds: int = 3600) -> DataFrame:
    """What the gates judge, a row for each workspace and day that any layer has.

    bronze_rows and bronze_events (distinct ids), nulls (the share of blank values of each required column), late_rows
    (older than late_seconds when they were received), silver_rows, reached and misplaced (stages after the first that journeys came to that day, and those
    of them without the stage before at or before their time), and gold_excess (the most by which a stage of Gold
    exceeds the users that Silver has for it). Bronze and Silver have event_date; null dates are a day of their own.
    """
    rate = lambda c: F.count_if(_missing(c)) / F.count("*")
    age = (F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("occurred_at").cast("timestamp"))) / 1e6
    b = bronze.withColumn("_age", age).groupBy(*DAY).agg(F.count("*").alias("bronze_rows"), F.count_distinct("event_id").alias("bronze_events"), F.struct(*[rate(c).alias(c) for c in REQUIRED]).alias("nulls"), F.count_if(F.col("_age") > late_seconds).alias("late_rows"))
    users = [F.count_distinct(F.when(F.col("event_name") == s, F.col("anonymous_id"))).alias(f"s{k}") for k, s in enumerate(STAGES)]
    s = silver.groupBy(*DAY).agg(F.count("*").alias("silver_rows"), *users)
    wrong = lambda k: F.coalesce(F.col(f"t{k - 1}") > F.col(f"t{k}"), F.lit(True))
    came = F.array(*[F.struct(F.to_date(f"t{k}").alias("event_date"), wrong(k).alias("misplaced")) for k in range(1, len(STAGES))])
    o = _firsts(silver, *JOURNEY).select("workspace_id", F.inline(came)).where("event_date is not null").groupBy(*DAY).agg(F.count("*").alias("reached"), F.count_if("misplaced").alias("misplaced"))
    g = gold.groupBy(*DAY).agg(*[F.coalesce(F.sum(F.when(F.col("stage_name") == s_, F.col("unique_users"))), F.lit(0)).alias(f"g{k}") for k, s_ in enumerate(STAGES)])
    rows = b
    for other in (s, o, g):
        rows = rows.withColumnRenamed("workspace_id", "_w").withColumnRenamed("event_date", "_d").join(other, F.col("_w").eqNullSafe(F.col("workspace_id")) & F.col("_d").eqNullSafe(F.col("event_date")), "full")
        rows = rows.withColumns({"workspace_id": F.coalesce("_w", "workspace_id"), "event_date": F.coalesce("_d", "event_date")}).drop("_w", "_d")
    numbers = ["late_rows", "bronze_rows", "bronze_events", "silver_rows", "reached", "misplaced", *[f"{x}{k}" for x in "sg" for k in range(len(STAGES))]]
    rows = rows.fillna(0, numbers)
    return rows.withColumn("gold_excess", F.greatest(*[F.col(f"g{k}") - F.col(f"s{k}") for k in range(len(STAGES))])).drop(*[f"{x}{k}" for x in "sg" for k in range(len(STAGES))])


def judge_days(metrics: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Adds `failed`: the names of the gates that a day fails, in the order of GATES; empty for a day that passes.

    volume: fewer events than a share of the median of up to seven earlier days of the workspace, once it has three.
    duplicates: repeated ids among its rows. nulls: blank values in any required column, or no date. order: stages
    reached out of order. freshness: events received too late. reconciliation: Silver has not
    the distinct events of Bronze, or Gold more users than Silver.
    """
    earlier = Window.partitionBy("workspace_id").orderBy("event_date").rowsBetween(-limits.earlier_days, -1)
    rows = metrics.withColumn("_before", F.sort_array(F.collect_list("bronze_events").over(earlier)))  # earlier_days at most
    days = F.size("_before")
    middle = lambda k: F.get("_before", F.floor((days + k) / 2).cast("int"))
    rows = rows.withColumn("_days", days).withColumn("_usual", (middle(-1) + middle(0)) / 2)
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    bad = {
        "volume": (F.col("_days") >= limits.least_days) & (F.col("bronze_events") < F.col("_usual") * limits.volume),
        "duplicates": share(F.col("bronze_rows") - F.col("bronze_events"), F.col("bronze_rows")) > limits.duplicates,
        "nulls": F.col("event_date").isNull() | (F.greatest(*[F.col(f"nulls.{c}") for c in REQUIRED]) > limits.nulls),
        "order": share(F.col("misplaced"), F.col("reached")) > limits.order,
        "freshness": share(F.col("late_rows"), F.col("bronze_rows")) > limits.late,
        "reconciliation": (F.col("bronze_events") != F.col("silver_rows")) | (F.col("gold_excess") > 0),
    }
    failed = F.array_compact(F.array(*[F.when(bad[name], F.lit(name)) for name in GATES]))
    return rows.withColumn("failed", failed).drop("_usual", "_days", "_before")


def passing(gold: DataFrame, judged: DataFrame) -> DataFrame:
    """Rows of Gold of the days that passed all gates; a day that was not judged does not pass."""
    return gold.join(judged.where(F.size("failed") == 0).select(*DAY), DAY, "left_semi")
