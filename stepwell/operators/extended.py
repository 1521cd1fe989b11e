"""Operators that the design names beyond the fixed computations: components, identities, health, baselines, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import not_blank, ntz, round4
from . import serving

#: Seconds after which each layer's data counts as stale: five minutes up to Bronze, an hour and a half for hourly Gold.
LAYER_LIMITS = {"collector": 300, "bronze": 300, "gold": 5400, "serving": 5400}


def component_events(events: DataFrame, ui_name: str, json: str = "accepted_event_json") -> DataFrame:
    """Clicks on one registered component: a predicate over the click event, not an event of its own."""
    return events.where((F.col("event_name") == "click") & (F.get_json_object(json, "$.properties.ui_name") == ui_name))


def tracker_errors(options: DataFrame) -> DataFrame:
    """Adds `error` to tracker settings (endpoint, workspace_key, anonymous_id): the first that is wrong, null if none."""
    first_party = F.col("endpoint").startswith("/") | F.col("endpoint").startswith("https://")
    rules = [(first_party, "endpoint"), (F.length("workspace_key") >= 8, "workspace_key"), (F.length("anonymous_id") >= 16, "anonymous_id")]
    error = F.lit(None).cast("string")
    for ok, name in reversed(rules):
        error = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(error)
    return options.withColumn("error", error)


def stitch(events: DataFrame) -> DataFrame:
    """Adds person_id to events with a user_id on some: the first user that an anonymous id was seen with, else the id.

    The links (workspace, anonymous id, user) are one aggregate; events without a login keep their anonymous id, with
    a mark that keeps it apart from a user of the same name.
    """
    seen = events.where(not_blank("user_id") & F.col("occurred_at").isNotNull())
    links = seen.groupBy("workspace_id", "anonymous_id").agg(F.min_by("user_id", F.struct("occurred_at", "user_id")).alias("_user"))
    rows = events.join(links, ["workspace_id", "anonymous_id"], "left")
    return rows.withColumn("person_id", F.coalesce(F.concat(F.lit("u:"), F.col("_user")), F.concat(F.lit("a:"), F.col("anonymous_id")))).drop("_user")


def layer_status(layers: DataFrame, now: str, limits: dict[str, int] = LAYER_LIMITS) -> DataFrame:
    """Adds age_seconds, status and trusted to rows (workspace_id, layer, data_through).

    A layer is healthy up to its limit, stale beyond it, no_data without a time; a layer without a limit is unknown. A
    workspace is trusted if all of its layers are healthy.
    """
    age = F.floor((F.unix_micros(ntz(now).cast("timestamp")) - F.unix_micros(F.col("data_through").cast("timestamp"))) / 1_000_000)
    limit = F.create_map(*[x for name, n in limits.items() for x in (F.lit(name), F.lit(n))])[F.col("layer")]
    rows = layers.withColumn("age_seconds", F.greatest(F.lit(0), age).cast("long"))
    status = F.when(F.col("data_through").isNull(), "no_data").when(limit.isNull(), "unknown").when(F.col("age_seconds") <= limit, "healthy").otherwise("stale")
    rows = rows.withColumn("status", status)
    return rows.withColumn("trusted", F.min((F.col("status") == "healthy").cast("int")).over(Window.partitionBy("workspace_id")) == 1)


def last_healthy(snapshots: DataFrame) -> DataFrame:
    """The serving view after a rollback: each key's values in its latest healthy snapshot."""
    return serving.current(snapshots.where("data_sla_status = 'healthy'"))


def gate(gold: DataFrame, gates: DataFrame) -> DataFrame:
    """Rows of the workspaces whose quality gates passed; a failed or missing gate blocks publication."""
    passed = gates.where("reconciled and null_times = 0").select("workspace_id")
    return gold.join(passed, "workspace_id", "left_semi")


def weekday_baseline(daily: DataFrame, weeks: int = 4, least: int = 3) -> DataFrame:
    """The latest day of each workspace against the same weekday of up to four weeks before it, by median and MAD.

    `daily` has (workspace_id, event_date, users), a row per day.
    """
    last = F.max("event_date").over(Window.partitionBy("workspace_id"))
    rows = daily.withColumn("_last", last).where((F.datediff("_last", "event_date") % 7 == 0) & (F.datediff("_last", "event_date") <= 7 * weeks))
    base = F.when(F.col("event_date") < F.col("_last"), F.col("users").cast("double"))
    now = F.max(F.when(F.col("event_date") == F.col("_last"), F.col("users").cast("double")))
    out = rows.groupBy("workspace_id").agg(now.alias("current_value"), F.count(base).alias("baseline_points"), F.median(base).alias("med"), F.sort_array(F.collect_list(base)).alias("_points"))  # four at most
    off = F.array_sort(F.transform("_points", lambda x: F.abs(x - F.col("med"))))
    n = F.size(off)
    mad = F.when(n > 0, (F.element_at(off, F.floor((n + 1) / 2).cast("int")) + F.element_at(off, F.floor((n + 2) / 2).cast("int"))) / 2)
    out = out.withColumn("mad", mad)
    z = F.abs(0.6745 * (F.col("current_value") - F.col("med")) / F.when(F.col("mad") != 0, F.col("mad")))
    status = F.when(F.col("baseline_points") < least, "insufficient_history").when(F.col("mad") == 0, "insufficient_variation").when(z >= 3.5, "anomaly").otherwise("normal")
    return out.select("workspace_id", "current_value", "baseline_points", round4(F.col("med")).alias("baseline_median"), round4(F.col("mad")).alias("median_absolute_deviation"), status.alias("anomaly_status"))


def upcast(events: DataFrame, casters: dict[str, tuple[str, dict[str, Column]]], target: str) -> DataFrame:
    """Events of older schema versions in the target's form, with source_version and transformation_version.

    casters: {version: (next version, {column: its value in the next version})}. All steps are projections of one pass,
    those furthest from the target first. A version that leads nowhere raises before any row is read; one that no caster
    knows stays as it is, with a null transformation_version.
    """
    steps: dict[str, int] = {}
    for version in casters:
        at, n = version, 0
        while at != target:
            if at not in casters or n > len(casters):
                raise ValueError(f"version {version} does not lead to {target}")
            at, n = casters[at][0], n + 1
        steps[version] = n
    rows = events.withColumn("source_version", F.col("schema_version"))
    for version in sorted(casters, key=lambda v: -steps[v]):
        following, columns = casters[version]
        here = F.col("schema_version") == version
        changed = {c: F.when(here, value).otherwise(F.col(c)) for c, value in columns.items()}
        rows = rows.withColumns(changed | {"schema_version": F.when(here, following).otherwise(F.col("schema_version"))})
    return rows.withColumn("transformation_version", F.when(F.col("source_version").isin([*casters, target]), target))


def real_only(events: DataFrame) -> DataFrame:
    """Events without those marked synthetic: demonstrations never mix with what customers see."""
    return events.where(~F.coalesce("is_synthetic", F.lit(False)))
