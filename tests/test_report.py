from pyspark.sql import functions as F
from test_funnel import events

from stepwell.operators import report, serving
from stepwell.plans import scenarios


def series(spark, values):
    rows = [("ws_1", f"2026-08-{k + 1:02d}", v) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "workspace_id string, event_date string, users long").withColumn("event_date", F.col("event_date").cast("date"))


def test_anomaly_by_median_deviation(spark):
    r = report.anomaly(series(spark, [6, 7, 8, 7, 8, 6, 8, 1])).first()
    assert (r["anomaly_status"], r["baseline_points"], r["current_value"], r["baseline_median"], r["robust_z_score"]) == ("anomaly", 7, 1.0, 7.0, -4.047)
    assert report.anomaly(series(spark, [96, 99, 100, 100, 101, 102, 104, 80])).first()["anomaly_status"] == "anomaly"
    assert report.anomaly(series(spark, [1, 2, 3, 4])).first()["anomaly_status"] == "insufficient_history"
    assert report.anomaly(series(spark, [5] * 9)).first()["anomaly_status"] == "insufficient_variation"


def test_report_of_a_stale_workspace_is_suppressed(spark):
    df = events(spark, [("u1", "vpv", "18 09:00")])
    fresh = report.funnel_report(df, "2026-08-18 09:05:00").first()
    assert (fresh["sla_status"], fresh["age_seconds"], fresh["commentary_status"]) == ("healthy", 300, "informational")
    stale = report.funnel_report(df, "2026-08-18 09:10:00").first()
    assert (stale["sla_status"], stale["commentary_status"], stale["anomaly_status"]) == ("stale", "suppressed_data_sla_unhealthy", "suppressed_data_sla_unhealthy")


def test_commentary_names_the_largest_drop(spark):
    df = events(spark, [("u1", "vpv", "18 09:00"), ("u2", "vpv", "18 09:00"), ("u1", "signup", "18 09:01"), ("u2", "signup", "18 09:02"), ("u1", "act", "18 09:03")])
    r = report.funnel_report(df, "2026-08-18 09:05:00")
    assert r.first()["summary"] == "Largest observed drop-off is from activation_completed to subscription_started (0.0% conversion)."
    assert report.dashboard_texts(r).first()["drop_off"].startswith("Subscription started has the largest observed drop-off: 0.0%")
    assert [c["share_of_entry"] for c in sorted(report.dashboard_stages(r).collect(), key=lambda c: c["position"])] == [100, 100, 50, 0]
    assert "identity_scope" in report.report_json(r).first()["report"]
    assert report.demo_check(r).first()["line"].startswith("Demo check passed: accepted=5; vpv=2")


def test_serving_view_and_contract(spark):
    gold = spark.createDataFrame([("ws_1", "2026-08-18", "1.0.0", "vpv", 3)], "workspace_id string, event_date string, funnel_definition_version string, stage_name string, unique_users long")
    rows = serving.snapshot(gold, "airflow-2", "2026-08-20 00:00:00").unionByName(serving.snapshot(gold.withColumn("unique_users", F.lit(4).cast("long")), "canonical-1", "2026-08-19 00:00:00"))
    assert serving.current(rows).first()["unique_users"] == 4
    assert serving.current(rows, "canonical_completed_at").first()["unique_users"] == 3
    assert serving.contract_violations(rows).first()["violation"] is None
    assert serving.contract_violations(rows.withColumn("anonymous_id", F.lit("x"))).first()["violation"] == "additional_property:anonymous_id"
    assert serving.contract_violations(rows.withColumn("data_sla_status", F.lit("fine"))).first()["violation"] == "data_sla_status"


def test_scenario_counts(spark):
    rows = scenarios.scenario(spark, "healthy")
    assert rows.count() == 32 and scenarios.scenario(spark, "subscription-anomaly").count() == 51
    assert scenarios.summary(scenarios.scenario(spark, "retries")).agg(F.sum("duplicates")).first()[0] == 1
