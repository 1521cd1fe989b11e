"""Several daily metrics in one pass, and anomalies told apart: of the business, or of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import STAGES, not_blank
from .report import anomaly

VOLUME = "event_count"
SERIES = ["workspace_id", "measure"]


def daily_metrics(events: DataFrame, late_seconds: int = 3600) -> DataFrame:
    """workspace_id, event_date, measure, kind and users (the value) of each observed day: one aggregate, unpivoted.

    kind data: event_count, and late_events (received so long after they occurred). kind business: the users of each
    stage. Events without a time belong to no day; blank ids are no users. A day without a stage's users has 0 of them.
    """
    age = F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("occurred_at").cast("timestamp"))
    rows = events.where("occurred_at is not null").withColumns({"event_date": F.to_date("occurred_at"), "_late": age > late_seconds * 1_000_000})
    user = lambda s: F.when((F.col("event_name") == s) & not_blank("anonymous_id"), F.col("anonymous_id"))
    days = rows.groupBy("workspace_id", "event_date").agg(F.count("*").alias(VOLUME), F.count_if("_late").alias("late_events"), *[F.count_distinct(user(s)).alias(s) for s in STAGES])
    values = [F.struct(F.lit(m).alias("measure"), F.lit("business" if m in STAGES else "data").alias("kind"), F.col(m).alias("users")) for m in (VOLUME, "late_events", *STAGES)]
    return days.select("workspace_id", "event_date", F.inline(F.array(*values)))


def metric_anomalies(daily: DataFrame, least_volume: float = 50) -> DataFrame:
    """Each workspace's metrics (as daily_metrics has them) on its latest day against up to seven observed days before.

    status is that of the robust detector, but a workspace whose usual day has fewer than `least_volume` events is left
    alone (insufficient_volume). An anomaly of a data metric is a data_anomaly. One of a business metric is a
    business_anomaly if the workspace's data metrics are in order, and else suppressed_data_anomaly: no conclusion about
    customers is drawn from an incident of the data.
    """
    kinds = daily.select(*SERIES, "kind").distinct()
    rows = anomaly(daily, None, *SERIES).drop("metric").join(kinds, SERIES)
    mine = Window.partitionBy("workspace_id")  # a row a metric
    usual = F.max(F.when(F.col("measure") == VOLUME, F.col("baseline_median"))).over(mine)
    odd = F.col("anomaly_status") == "anomaly"
    incident = F.max((odd & (F.col("kind") == "data")).cast("int")).over(mine) == 1
    rows = rows.withColumns({"_usual": usual, "_incident": incident})
    few = F.coalesce(F.col("_usual") < least_volume, F.lit(False))
    told = F.when(F.col("kind") == "data", "data_anomaly").when(F.col("_incident"), "suppressed_data_anomaly").otherwise("business_anomaly")
    status = F.when(few, "insufficient_volume").when(odd, told).otherwise(F.col("anomaly_status"))
    return rows.withColumn("status", status).select(*SERIES, "kind", "status", "as_of_event_date", "current_value", "baseline_points", "baseline_median", "robust_z_score")
