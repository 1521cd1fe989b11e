"""Tracking plans and funnel definitions in tables."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_funnel import SEMANTICS, events
from test_validate import CASES, GOOD

from stepwell.functions.values import STAGES
from stepwell.operators import funnel, registry, validate
from stepwell.plans.rules import funnel_rows, standard_plan

TOTALS = {"adjacent": [4, 1, 3, 1], "skipping": [4, 2, 4, 1], "strict": [4, 2, 1, 1], "unordered": [4, 4, 4, 1]}


def standard(spark):
    return funnel_rows(spark, "standard", [(s, s, None) for s in STAGES])


@pytest.mark.parametrize("semantics", registry.SEMANTICS)
def test_four_rules_from_one_table(spark, semantics):
    rows = events(spark, [(u, n, t) for u, made in SEMANTICS.items() for n, t in made])
    got = registry.count_funnels(rows, standard(spark), semantics, "2026-08-18", "2026-08-18")
    totals = {r["stage_name"]: r["n"] for r in got.groupBy("stage_name").agg(F.sum("unique_users").alias("n")).collect()}
    assert [totals[s] for s in STAGES] == TOTALS[semantics]
    assert registry.count_funnels(rows.limit(0), standard(spark), semantics, "2026-08-18", "2026-08-18").count() == 0
    assert registry.count_funnels(rows, standard(spark).limit(0), semantics, "2026-08-18", "2026-08-18").count() == 0


def test_definitions_equal_the_fixed_funnels_on_random_events(spark):
    rng = random.Random(3)
    rows = events(spark, [(f"u{rng.randrange(15)}", rng.choice(["vpv", "signup", "act", "sub", "click"]), f"{rng.randrange(10, 20)} {rng.randrange(24):02d}:{rng.randrange(60):02d}") for _ in range(200)] + [(" ", "vpv", "12 09:00")])
    per = lambda df: sorted((r["workspace_id"], str(r["event_date"]), r["stage_name"], r["unique_users"]) for r in df.collect())
    known = rows.where("anonymous_id <> ' '")
    assert per(registry.count_funnels(rows, standard(spark), "adjacent", "2026-08-14", "2026-08-18", 2)) == per(funnel.canonical_daily(known, "2026-08-14", "2026-08-18", 2))
    assert per(registry.count_funnels(rows, standard(spark), "skipping")) == per(funnel.pure_daily(known))
    strict = {r["stage_name"]: r["unique_users"] for r in registry.count_funnels(rows, standard(spark), "strict").collect()}
    fixed = funnel.strict_counts(rows).first()
    assert [strict.get(s, 0) for s in STAGES] == [fixed[f"u{k}"] for k in range(4)]


def test_versions_repeated_rows_and_many_definitions(spark):
    rows = events(spark, [("u", "vpv", "18 09:00"), ("u", "sub", "18 10:00")])
    other = funnel_rows(spark, "next", [("a", "vpv", None)]).withColumn("definition_version", F.lit("9.0.0"))
    both = standard(spark).unionByName(standard(spark)).unionByName(other)
    got = registry.count_funnels(rows, both, "skipping").collect()
    assert sorted((r["funnel_id"], r["stage_name"], r["unique_users"]) for r in got) == [("standard", "subscription_started", 1), ("standard", "vpv", 1)]
    with pytest.raises(ValueError):
        registry.count_funnels(rows, both, "other")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    joined = lambda most: plan(rows.join(registry.sized(both, most), F.col("funnel_definition_version") == F.col("definition_version")))
    assert "strategy=broadcast" in joined(100) and "strategy=broadcast" not in joined(3)


def test_the_standard_plan_gives_the_fixed_reasons(spark):
    raws = [json.dumps(GOOD | change) for change, _ in CASES] + ["[]", "nope", json.dumps(GOOD | {"tracking_plan_version": "7"}), json.dumps(GOOD | {"event_name": 5})]
    df = spark.createDataFrame([(k, r, "ws_1") for k, r in enumerate(raws)], "k int, raw string, workspace_id string").selectExpr("*", "timestamp'2025-11-03 18:45:00.240Z' as received_at", "'x' as plan")
    rows = spark.createDataFrame(standard_plan("ws_1") * 2, registry.PLAN)
    fixed = {r["k"]: r["reason"] for r in validate.validate(df).collect()}
    got = registry.validate_by_plan(df, rows)
    assert got.columns == [*df.columns, "reason"]
    assert {r["k"]: r["reason"] for r in got.collect()} == fixed
    none = registry.validate_by_plan(df.withColumn("workspace_id", F.lit(None).cast("string")), rows).where("k = 0").first()
    assert none["reason"] == "unsupported_contract_version"
    assert registry.validate_by_plan(df, rows.limit(0)).where("k = 0").first()["reason"] == "unsupported_contract_version"
    assert registry.validate_by_plan(df.limit(0), rows).count() == 0
