"""Queries by rules in tables, tracking plans and funnel definitions, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import ALLOWED_PROPERTIES, BILLING_INTERVALS, REQUIRED_PROPERTIES, SIGNUP_METHODS, STAGES, UI_TYPES, VERSION
from ..operators import dedupe, registry
from ..sources.events import read_events
from .queries import _D, _IN, _STRICT, BRONZE, END, RAW, START, VALIDATE, Query, _gold_sql, _pure_sql, _silver, _silver_range

_W = f"WITH {BRONZE}"
#: Rules of the standard plan by property: how its values are checked, which they are, and the reason of a wrong one.
_RULES = {
    "page_path": ("path", None, "invalid_page_path"),
    "ui_name": ("identifier", None, "invalid_ui_component"),
    "ui_surface": ("identifier", None, "invalid_ui_component"),
    "ui_type": ("one_of", UI_TYPES, "invalid_ui_component"),
    "signup_method": ("one_of", SIGNUP_METHODS, "invalid_signup_method"),
    "activation_action": ("identifier", None, "invalid_activation_action"),
    "plan": ("identifier", None, "invalid_subscription_properties"),
    "acquisition_channel": ("identifier", None, "invalid_subscription_properties"),
    "billing_interval": ("one_of", BILLING_INTERVALS, "invalid_subscription_properties"),
}


def standard_plan(workspace_id: str) -> list[tuple]:
    """The plan rows of a workspace that has the contract's own rules."""
    rows = []
    for event, properties in ALLOWED_PROPERTIES.items():
        for k, p in enumerate(properties):
            rows.append((workspace_id, VERSION, event, k, p, p in REQUIRED_PROPERTIES[event], *_RULES.get(p, (None, None, None))))
    return rows


def _plans(spark: SparkSession) -> DataFrame:
    """Two plans: the standard one, and one without clicks, with colours, a daily interval, and fewer properties required."""
    other = [r for r in standard_plan("ws_1") if r[2] not in ("click", "subscription_started")]
    other += [("ws_1", VERSION, "subscription_started", 0, "plan", True, "identifier", None, "invalid_subscription_properties"), ("ws_1", VERSION, "subscription_started", 1, "colour", False, None, None, None)]
    other += [("ws_1", VERSION, "subscription_started", 2, "billing_interval", False, "one_of", ["monthly", "daily"], "invalid_subscription_properties")]
    return spark.createDataFrame(standard_plan("ws_0") + other, registry.PLAN)


def _by_plan(spark: SparkSession, d: str) -> DataFrame:
    """Raw events of three workspaces: one has the standard plan, one another, one has none."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.concat(F.lit("ws_"), (F.col("event_id") % 3).cast("string")).alias("workspace_id"), F.expr(RAW.replace("VARCHAR(20)", "STRING")).alias("raw"))
    rows = registry.validate_by_plan(rows.withColumn("received_at", F.lit("2024-02-01T00:00:00Z").cast("timestamp")), _plans(spark))
    return rows.select("event_id", "workspace_id", F.coalesce("reason", F.lit("accepted")).alias("reason"))


def funnel_rows(spark: SparkSession, funnel_id: str, stages: list[tuple[str, str, str | None]]) -> DataFrame:
    """The definition rows of a funnel, of (stage, event, component or None) in order."""
    return spark.createDataFrame([(funnel_id, VERSION, k, *s) for k, s in enumerate(stages)], registry.DEFINITION)


def _standard(spark: SparkSession) -> DataFrame:
    return funnel_rows(spark, "standard", [(s, s, None) for s in STAGES])


def _shown(rows: DataFrame, *more: str) -> DataFrame:
    rows = rows.withColumn("event_date", F.col("event_date").cast("string")) if "event_date" in rows.columns else rows
    return rows.select("workspace_id", *(["event_date"] if "event_date" in rows.columns else []), "stage_name", "unique_users", *more)


def _components(spark: SparkSession, d: str) -> DataFrame:
    """Two funnels at once, of two and three stages; a stage of one is a click on a component."""
    n = F.substring("event_id", 7, 12).cast("long")
    json = F.concat(F.lit('{"properties":{"ui_name":"'), F.when(n % 3 == 0, "pricing_cta").otherwise("nav_signup"), F.lit('"}}'))
    two = funnel_rows(spark, "short", [("seen", "vpv", None), ("paid", "subscription_started", None)]).unionByName(funnel_rows(spark, "cta", [("seen", "vpv", None), ("asked", "click", "pricing_cta"), ("paid", "subscription_started", None)]))
    return _shown(registry.count_funnels(_silver(spark, d).withColumn("accepted_event_json", json), two, "skipping"), "funnel_id")


def queries() -> dict[str, Query]:
    return {
        "plan_registry": _by_plan,
        "defined_adjacent": lambda s, d: _shown(registry.count_funnels(_silver_range(s, d), _standard(s), "adjacent", START, END)),
        "defined_skipping": lambda s, d: _shown(registry.count_funnels(dedupe.pure(read_events(s, d)), _standard(s), "skipping")),
        "defined_strict": lambda s, d: _shown(registry.count_funnels(_silver(s, d), _standard(s), "strict")),
        "defined_unordered": lambda s, d: _shown(registry.count_funnels(_silver(s, d), _standard(s), "unordered")),
        "defined_components": _components,
    }


def oracle_sql() -> dict[str, str]:
    daily = "SELECT workspace_id, event_date, stage_name, unique_users FROM"
    cta = """x AS (SELECT workspace_id AS w, anonymous_id AS a, min(occurred_at) FILTER (event_name = 'vpv') AS t0, min(occurred_at) FILTER (event_name = 'click' AND id % 3 = 0) AS t1, min(occurred_at) FILTER (event_name = 'subscription_started') AS t2 FROM silver GROUP BY ALL),
y AS (SELECT w, a, t0, t2 AS s, CASE WHEN t1 IS NOT NULL AND (t0 IS NULL OR t1 >= t0) THEN t1 END AS t1, t2 FROM x),
z AS (SELECT 'cta' AS f, 'seen' AS n, w, a, t0 AS t FROM y UNION ALL SELECT 'cta', 'asked', w, a, t1 FROM y UNION ALL SELECT 'cta', 'paid', w, a, CASE WHEN coalesce(t1, t0) IS NULL OR t2 >= coalesce(t1, t0) THEN t2 END FROM y
  UNION ALL SELECT 'short', 'seen', w, a, t0 FROM y UNION ALL SELECT 'short', 'paid', w, a, CASE WHEN t0 IS NULL OR s >= t0 THEN s END FROM y)"""
    return {
        "plan_registry": f"""WITH {VALIDATE}, c AS (SELECT event_id, event_id % 3 AS w, {_D} AS defect, coalesce(reason, 'accepted') AS r FROM checked)
SELECT event_id, 'ws_' || w AS workspace_id, CASE WHEN w = 1 AND defect IN (17, 19, 21) THEN 'accepted' WHEN w = 1 AND defect = 23 THEN 'unsupported_event_name'
  WHEN w = 2 AND r NOT IN ('invalid_json', 'invalid_payload', 'unallowed_envelope_field', 'invalid_identifier') THEN 'unsupported_contract_version' ELSE r END AS reason FROM c""",
        "defined_adjacent": f"{daily} ({_gold_sql(30)})",
        "defined_skipping": f"{daily} ({_pure_sql()})",
        "defined_strict": f"{_W}, {_STRICT} SELECT * FROM (" + " UNION ALL ".join(f"SELECT workspace_id, '{s}' AS stage_name, u{k} AS unique_users FROM c" for k, s in enumerate(STAGES)) + ") WHERE unique_users > 0",
        "defined_unordered": f"{_W} SELECT workspace_id, CAST(CAST(occurred_at AS DATE) AS VARCHAR) AS event_date, event_name AS stage_name, count(DISTINCT anonymous_id) AS unique_users FROM silver WHERE event_name IN ({_IN}) GROUP BY workspace_id, CAST(occurred_at AS DATE), event_name",
        "defined_components": f"{_W}, {cta} SELECT w AS workspace_id, CAST(CAST(t AS DATE) AS VARCHAR) AS event_date, n AS stage_name, count(*) AS unique_users, f AS funnel_id FROM z WHERE t IS NOT NULL GROUP BY w, CAST(t AS DATE), n, f",
    }
