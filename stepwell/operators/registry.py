"""Tracking plans and funnel definitions as versioned rows, instead of rules in code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import not_blank
from ..sources.events import scan_range
from .validate import last_value, with_reason

PLAN = "workspace_id string, plan_version string, event_name string, position int, property string, required boolean, kind string, values array<string>, reason string"
DEFINITION = "funnel_id string, definition_version string, stage_no int, stage_name string, event_name string, ui_name string"
#: Rows up to which a table of rules is sent to all tasks; a larger one is joined by its key.
SMALL = 10_000
#: Ways in which a funnel counts its stages.
SEMANTICS = ("adjacent", "skipping", "strict", "unordered")
GRAIN = ["workspace_id", "funnel_id", "definition_version"]


def sized(rules: DataFrame, most: int = SMALL) -> DataFrame:
    """The rules, to be broadcast if there are few of them: they are counted, up to one more than that."""
    return F.broadcast(rules) if rules.limit(most + 1).count() <= most else rules


def plans(rows: DataFrame) -> DataFrame:
    """workspace_id, plan_version and plan of plan rows (PLAN): a map from event to its allowed, required and ruled properties.

    An event without properties is a row with a null property. Rules are kept in the order of `position`; a repeated row
    counts once.
    """
    entry = F.struct("position", "property", "required", "kind", "values", "reason")
    events = rows.distinct().groupBy("workspace_id", "plan_version", "event_name").agg(F.array_sort(F.collect_list(F.when(F.col("property").isNotNull(), entry))).alias("r"))  # one event's properties
    names = lambda of: F.transform(of, lambda r: r["property"])
    plan = F.struct(names(F.col("r")).alias("allowed"), names(F.filter("r", lambda r: r["required"])).alias("required"), F.filter("r", lambda r: r["kind"].isNotNull()).alias("rules"))
    events = events.select("workspace_id", "plan_version", F.struct("event_name", plan.alias("plan")).alias("e"))
    return events.groupBy("workspace_id", "plan_version").agg(F.map_from_entries(F.collect_list("e")).alias("plan"))  # one plan's events


def validate_by_plan(df: DataFrame, plan_rows: DataFrame, raw: str = "raw", received_at: str = "received_at") -> DataFrame:
    """Adds `reason` to raw events of workspaces (workspace_id), each judged by the plan that it names of its workspace.

    The envelope's rules are those of all workspaces. A plan that its workspace does not have, and a null workspace, give
    unsupported_contract_version; an event that is not in the plan unsupported_event_name.
    """
    held = plans(plan_rows).select(F.col("workspace_id").alias("_of"), F.col("plan_version").alias("_version"), F.col("plan").alias("_plan"))
    rows = df.withColumn("_named", last_value(raw, "tracking_plan_version"))
    rows = rows.join(sized(held), (F.col("workspace_id") == F.col("_of")) & (F.col("_named") == F.col("_version")), "left")
    return with_reason(rows, raw, received_at, "reason", plan_name="_plan").select(*df.columns, "reason")


def staged(events: DataFrame, definitions: DataFrame) -> DataFrame:
    """An event for each stage of each funnel that it is a part of: funnel_id, definition_version, stage_no, stage_name, occurred_at.

    Definitions (DEFINITION) say by version which event is a stage, and which component of the page must be named, if
    any; an event may be stages of several funnels, and several stages of one. Events of a version without a definition
    are in none. Blank ids of users count for nobody.
    """
    stages = definitions.distinct().select(F.col("definition_version"), F.col("event_name").alias("_event"), F.col("ui_name").alias("_ui"), "funnel_id", "stage_no", "stage_name")
    fits = (F.col("funnel_definition_version") == F.col("definition_version")) & (F.col("event_name") == F.col("_event"))
    rows = events.where(not_blank("anonymous_id") & F.col("occurred_at").isNotNull()).join(sized(stages), fits)
    rows = rows.where(F.col("_ui").isNull() | F.col("_ui").eqNullSafe(F.get_json_object("accepted_event_json", "$.properties.ui_name")))
    return rows.select(*GRAIN, "anonymous_id", "stage_no", "stage_name", "occurred_at")


def _qualified(semantics: str, times: Column) -> Column:
    """The (stage_no, stage_name, at) that count, of an array of all stages in order; one fold for each rule."""
    first: Column = F.struct(F.lit(None).cast("timestamp_ntz").alias("last"), F.lit(True).alias("start"), F.array().cast("array<struct<stage_no: int, stage_name: string, at: timestamp_ntz>>").alias("kept"))
    if semantics == "adjacent":  # against the stage ahead of it, whether that one counts or not
        ok, last = (lambda a, s: s["at"].isNotNull() & (a["start"] | F.coalesce(s["at"] >= a["last"], F.lit(False)))), (lambda a, s, good: s["at"])
    else:  # against the last one that counts; missing and early ones are passed over
        ok, last = (lambda a, s: s["at"].isNotNull() & (a["last"].isNull() | (s["at"] >= a["last"]))), (lambda a, s, good: F.when(good, s["at"]).otherwise(a["last"]))

    def step(a: Column, s: Column) -> Column:
        good = ok(a, s)
        return F.struct(last(a, s, good).alias("last"), F.lit(False).alias("start"), F.when(good, F.concat(a["kept"], F.array(s))).otherwise(a["kept"]).alias("kept"))

    return F.aggregate(times, first, step, lambda a: a["kept"])


def _journeys(rows: DataFrame, definitions: DataFrame) -> DataFrame:
    """The first time of each stage of a journey, as an array of all stages of its funnel in order."""
    times = rows.groupBy(*GRAIN, "anonymous_id", "stage_no").agg(F.min("occurred_at").alias("at"))
    times = times.groupBy(*GRAIN, "anonymous_id").agg(F.map_from_entries(F.collect_list(F.struct("stage_no", "at"))).alias("_at"))  # one entry a stage
    stages = definitions.select("funnel_id", "definition_version", "stage_no", "stage_name").distinct()
    stages = stages.groupBy("funnel_id", "definition_version").agg(F.array_sort(F.collect_list(F.struct("stage_no", "stage_name"))).alias("_stages"))  # one funnel's stages
    rows = times.join(sized(stages), ["funnel_id", "definition_version"])
    return rows.withColumn("times", F.transform("_stages", lambda s: F.struct(s["stage_no"].alias("stage_no"), s["stage_name"].alias("stage_name"), F.try_element_at("_at", s["stage_no"]).alias("at")))).drop("_at", "_stages")


def count_funnels(events: DataFrame, definitions: DataFrame, semantics: str, start: str | None = None, end: str | None = None, lookback_days: int = 30) -> DataFrame:
    """Users of each workspace, funnel, version and stage by definitions in a table; all rules but strict by day.

    adjacent   first time of each stage in the lookback before `start` up to `end`; a stage needs the one ahead of it at
               or before its time. Days from start to end.
    skipping   first time of each stage; it counts unless it is before the last one that counted.
    strict     the next stage in time order, again and again; users that came so far.
    unordered  users of a day and stage, in no order.

    Events are to be deduplicated as the rule needs it. Stages need not be four, nor in all funnels as many; their numbers
    start at 0 and have no gaps. Without events or definitions there are no rows.
    """
    if semantics not in SEMANTICS:
        raise ValueError(f"semantics is one of {', '.join(SEMANTICS)}")
    if semantics == "adjacent":
        events = scan_range(events, start, end, lookback_days)
    rows = staged(events, definitions)
    day = [*GRAIN, "event_date", "stage_no", "stage_name"]
    if semantics == "unordered":
        users = rows.select(*GRAIN, F.to_date("occurred_at").alias("event_date"), "stage_no", "stage_name", "anonymous_id").distinct()
        return users.groupBy(*day).agg(F.count("*").alias("unique_users"))
    if semantics == "strict":
        numbers = [r[0] for r in definitions.select("stage_no").distinct().orderBy("stage_no").collect()]  # a row a stage
        if not numbers:
            return rows.select(*GRAIN, "stage_no", "stage_name", F.lit(0).cast("long").alias("unique_users"))
        own, reached = Window.partitionBy(*GRAIN, "anonymous_id"), None
        for k in numbers:  # windows of one partitioning: one shuffle
            hit = (F.col("stage_no") == k) if reached is None else (F.col("stage_no") == k) & (F.col("occurred_at") >= F.col(reached))
            rows, reached = rows.withColumn(f"_t{k}", F.min(F.when(hit, F.col("occurred_at"))).over(own)), f"_t{k}"
        at = F.coalesce(*[F.when(F.col("stage_no") == k, F.col(f"_t{k}")) for k in numbers])
        users = rows.where(F.col("occurred_at") == at).select(*GRAIN, "stage_no", "stage_name", "anonymous_id").distinct()
        return users.groupBy(*GRAIN, "stage_no", "stage_name").agg(F.count("*").alias("unique_users"))
    kept = _journeys(rows, definitions).select(*GRAIN, "anonymous_id", F.inline(_qualified(semantics, F.col("times"))))
    kept = kept.withColumn("event_date", F.to_date("at"))
    if semantics == "adjacent":
        kept = kept.where(F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return kept.groupBy(*day).agg(F.count("*").alias("unique_users"))
