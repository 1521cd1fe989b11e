"""The provisional report: freshness, conversion, drop-off, commentary and a robust anomaly check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import (
    CHANGED, DROP_TEXT, EMPTY_TEXT, EVENT_TAIL, EXPECTED, FRESH_SECONDS, HEALTHY_HEAD, NO_DATA_HEAD, NO_STEP_TEXT, PAUSED, PENDING, STAGE_LABELS, STAGES, STALE_HEAD, STEP_TEXT, UNHEALTHY_TEXT, UNIFORM, VERSION, not_blank, ntz, percent, ratio, round4,
)
from .funnel import strict_counts

METRIC = "daily_subscription_started_users"


def freshness(events: DataFrame, generated_at: str, *scope: str) -> DataFrame:
    """age_seconds (whole, 0 at least) and sla_status of each scope; rows without a time do not count."""
    age = F.floor((F.unix_micros(ntz(generated_at).cast("timestamp")) - F.unix_micros(F.max("received_at").cast("timestamp"))) / 1_000_000)
    rows = events.groupBy(*(scope or ("workspace_id",))).agg(F.count("*").alias("accepted_event_count"), F.greatest(F.lit(0), age).cast("long").alias("age_seconds"))
    status = F.when(F.col("age_seconds").isNull(), "no_data").when(F.col("age_seconds") <= FRESH_SECONDS, "healthy").otherwise("stale")
    return rows.withColumn("sla_status", status)


def conversion(counts: DataFrame) -> DataFrame:
    """c1 to c3: rate from the stage before, to four decimals, null without users there."""
    return counts.withColumns({f"c{k}": ratio(F.col(f"u{k}"), F.col(f"u{k - 1}")) for k in (1, 2, 3)})


def largest_drop(counts: DataFrame) -> DataFrame:
    """drop_index: the stage with the least unrounded rate, the first at ties, 1 if there is none."""
    rates = F.array(*[F.when(F.col(f"u{k - 1}") > 0, F.struct((F.col(f"u{k}").cast("double") / F.col(f"u{k - 1}")).alias("r"), F.lit(k).alias("k"))) for k in (1, 2, 3)])
    return counts.withColumn("drop_index", F.coalesce(F.array_min(F.filter(rates, lambda x: x.isNotNull()))["k"], F.lit(1)))


def commentary(rows: DataFrame) -> DataFrame:
    """commentary_status and summary of rows with counts, drop_index and sla_status."""
    stages = F.array(*map(F.lit, STAGES))
    rate = F.coalesce(F.element_at(F.array("c1", "c2", "c3"), F.col("drop_index")), F.lit(0.0))
    text = F.concat(F.lit(DROP_TEXT[0]), F.element_at(stages, F.col("drop_index")), F.lit(DROP_TEXT[1]), F.element_at(stages, F.col("drop_index") + 1), F.lit(" ("), percent(rate), F.lit(DROP_TEXT[2]))
    unhealthy, empty = F.col("sla_status") != "healthy", F.col("u0") == 0
    return rows.withColumn("commentary_status", F.when(unhealthy, "suppressed_data_sla_unhealthy").when(empty, "insufficient_volume").otherwise("informational")).withColumn(
        "summary",
        F.when(unhealthy, UNHEALTHY_TEXT).when(empty, EMPTY_TEXT).otherwise(text),
    )


def daily_subscriptions(events: DataFrame, *scope: str) -> DataFrame:
    """Users who subscribed on each observed day, 0 on days with other events only."""
    scope = scope or ("workspace_id",)
    rows = events.where(F.col("occurred_at").isNotNull()).withColumn("event_date", F.to_date("occurred_at"))
    user = F.when((F.col("event_name") == "subscription_started") & not_blank("anonymous_id"), F.col("anonymous_id"))
    return rows.select(*scope, "event_date", user.alias("user")).groupBy(*scope, "event_date").agg(F.count_distinct("user").alias("users"))


def anomaly(daily: DataFrame, healthy: DataFrame | None = None, *scope: str) -> DataFrame:
    """The latest day against the median of up to seven observed days before it, by median absolute deviation.

    `daily` has a row per scope and day, so its windows are small. healthy: rows of (scope, sla_status), if to be heeded.
    """
    scope = scope or ("workspace_id",)
    ranked = daily.withColumn("_rank", F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc("event_date")))).where("_rank <= 8")
    base = F.when(F.col("_rank") > 1, F.col("users").cast("double"))
    rows = ranked.groupBy(*scope).agg(
        F.max("event_date").alias("as_of_event_date"),
        F.max(F.when(F.col("_rank") == 1, F.col("users").cast("double"))).alias("current_value"),
        F.count(base).alias("baseline_points"),
        F.median(base).alias("med"),
        F.sort_array(F.collect_list(base)).alias("points"),  # seven at most
    )
    off = F.array_sort(F.transform("points", lambda x: F.abs(x - F.col("med"))))
    n = F.size(off)
    mad = F.when(n > 0, (F.element_at(off, F.floor((n + 1) / 2).cast("int")) + F.element_at(off, F.floor((n + 2) / 2).cast("int"))) / 2)
    rows = rows.withColumn("mad", mad).withColumn("z", 0.6745 * (F.col("current_value") - F.col("med")) / F.when(F.col("mad") != 0, F.col("mad")))
    if healthy is not None:
        rows = rows.join(healthy.select(*scope, "sla_status"), list(scope), "left")
    well = (F.col("sla_status") == "healthy") if healthy is not None else F.lit(True)
    short = F.col("baseline_points") < 7
    status = F.when(~well, "suppressed_data_sla_unhealthy").when(short, "insufficient_history").when(F.col("mad") == 0, "insufficient_variation").when(F.abs("z") >= 3.5, "anomaly").otherwise("normal")
    rows = rows.withColumn("anomaly_status", status)
    told = F.col("anomaly_status").isin("insufficient_variation", "normal", "anomaly")
    scored = F.col("anomaly_status").isin("normal", "anomaly")
    return rows.select(
        *scope, F.lit(METRIC).alias("metric"), "anomaly_status", F.col("as_of_event_date").cast("string").alias("as_of_event_date"), "current_value", "baseline_points",
        F.when(told, round4(F.col("med"))).alias("baseline_median"), F.when(told, round4(F.col("mad"))).alias("median_absolute_deviation"), F.when(scored, round4(F.col("z"))).alias("robust_z_score"),
    )


def funnel_report(events: DataFrame, generated_at: str) -> DataFrame:
    """One row per workspace: counts, rates, freshness, commentary and anomaly."""
    fresh = freshness(events, generated_at)
    rows = largest_drop(conversion(fresh.join(strict_counts(events), "workspace_id", "left").fillna(0, [f"u{k}" for k in range(4)])))
    found = anomaly(daily_subscriptions(events), fresh)
    return commentary(rows).join(found, "workspace_id", "left").withColumn("metric_status", F.lit("local_provisional")).withColumn("funnel_definition_version", F.lit(VERSION)).withColumn("generated_at", F.lit(generated_at))


def report_json(report: DataFrame) -> DataFrame:
    """(workspace_id, report): the report as one JSON document per workspace."""
    stages = F.array(*[F.struct(F.lit(s).alias("event_name"), F.col(f"u{k}").alias("users"), (F.col(f"c{k}") if k else F.lit(None).cast("double")).alias("conversion_from_previous")) for k, s in enumerate(STAGES)])
    body = F.struct(
        "generated_at", "metric_status", "funnel_definition_version", F.lit("workspace_anonymous_id").alias("identity_scope"), "accepted_event_count",
        F.struct(F.col("sla_status").alias("status"), "age_seconds").alias("data_sla"),
        F.struct("metric", F.col("anomaly_status").alias("status"), "current_value", "baseline_points", "as_of_event_date", "baseline_median", "median_absolute_deviation", "robust_z_score").alias("anomaly"),
        stages.alias("stages"), F.struct(F.col("commentary_status").alias("status"), "summary").alias("commentary"),
    )
    return report.select("workspace_id", F.to_json(body).alias("report"))


def dashboard_stages(report: DataFrame) -> DataFrame:
    """Stage cards: label, users, conversion text and share of entry."""
    cards = F.array(*[
        F.struct(F.lit(k).alias("position"), F.lit(s).alias("event_name"), F.lit(STAGE_LABELS[k]).alias("label"), F.col(f"u{k}").alias("users"),
                 (F.coalesce(percent(F.col(f"c{k}")), F.lit("—")) if k else F.lit("—")).alias("conversion"),
                 F.when(F.col("u0") > 0, F.floor(100.0 * F.col(f"u{k}") / F.col("u0") + 0.5)).otherwise(0).cast("long").alias("share_of_entry"))
        for k, s in enumerate(STAGES)
    ])
    return report.select("workspace_id", F.inline(cards))


def dashboard_texts(report: DataFrame) -> DataFrame:
    """Health, drop-off and anomaly texts of the dashboard."""
    n = F.col("accepted_event_count")
    health = F.when(F.col("sla_status") == "healthy", F.concat(F.lit(HEALTHY_HEAD), n.cast("string"), F.lit(EVENT_TAIL), F.when(n == 1, "").otherwise("s")))
    health = health.when(F.col("sla_status") == "no_data", NO_DATA_HEAD).otherwise(STALE_HEAD)
    rates = F.array(*[F.when(F.col(f"c{k}").isNotNull(), F.struct(F.col(f"c{k}").alias("r"), F.lit(k).alias("k"))) for k in (1, 2, 3)])
    least = F.array_min(F.filter(rates, lambda x: x.isNotNull()))
    labels = F.array(*map(F.lit, STAGE_LABELS))
    drop = F.when(least.isNull(), NO_STEP_TEXT).otherwise(F.concat(F.element_at(labels, least["k"] + 1), F.lit(STEP_TEXT[0]), percent(least["r"]), F.lit(STEP_TEXT[1])))
    paused = (F.col("anomaly_status") == "suppressed_data_sla_unhealthy") | (F.col("sla_status") != "healthy")
    title: Column = F.when(paused, PAUSED).when(F.col("anomaly_status") == "anomaly", CHANGED).when(F.col("anomaly_status") == "normal", EXPECTED)
    title = title.when(F.col("anomaly_status") == "insufficient_variation", UNIFORM).otherwise(PENDING)
    return report.select("workspace_id", health.alias("health"), drop.alias("drop_off"), title.alias("anomaly_title"))


def demo_check(report: DataFrame) -> DataFrame:
    """One line of each workspace's report; raises unless it is healthy and has events."""
    line = F.concat(F.lit("Demo check passed: accepted="), F.col("accepted_event_count").cast("string"), F.lit("; "), F.concat_ws(" → ", *[F.concat(F.lit(f"{s}="), F.col(f"u{k}").cast("string")) for k, s in enumerate(STAGES)]), F.lit("; anomaly="), F.coalesce("anomaly_status", F.lit("not_available")))
    bad = F.raise_error(F.lit("Data SLA is not healthy or there are no accepted events."))
    return report.select("workspace_id", F.when((F.col("sla_status") == "healthy") & (F.col("accepted_event_count") > 0), line).otherwise(bad.cast("string")).alias("line"))
