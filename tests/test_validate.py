import json

import pytest
from pyspark.sql import functions as F

from stepwell.operators import validate

GOOD = {
    "event_id": "event-000000000001", "event_name": "subscription_started", "occurred_at": "2025-11-03T18:45:00Z", "anonymous_id": "anonymous-00000001", "session_id": "session-000000001",
    "properties": {"plan": "team", "billing_interval": "monthly"}, "context": {"platform": "web", "sdk_version": "4.1"}, "schema_version": "1.0.0", "tracking_plan_version": "1.0.0",
    "funnel_definition_version": "1.0.0", "consent": {"analytics": True},
}
VPV = {"event_name": "vpv", "properties": {"page_path": "/plans"}}
CASES = [
    ({}, None), ({"user_id": "u" * 16}, None), (VPV, None), ({"email": "x"}, "unallowed_envelope_field"), ({"received_at": "x"}, "unallowed_envelope_field"), ({"event_name": "other"}, "unsupported_event_name"),
    ({"event_id": "short"}, "invalid_identifier"), ({"anonymous_id": 12345678901234567890}, "invalid_identifier"), ({"user_id": None}, "invalid_identifier"), ({"schema_version": "2.0.0"}, "unsupported_contract_version"),
    ({"consent": {"analytics": "true"}}, "invalid_context_or_consent"), ({"consent": {"analytics": True, "ads": True}}, "invalid_context_or_consent"), ({"context": {"platform": "ios", "sdk_version": "4.1"}}, "invalid_context_or_consent"),
    ({"occurred_at": None}, "missing_occurred_at"), ({"occurred_at": "2025-11-03"}, "invalid_event_time"), ({"occurred_at": "2025-11-03T18:50:00.240Z"}, None), ({"occurred_at": "2025-11-03T18:50:01Z"}, "invalid_event_time"),
    ({"properties": []}, "invalid_properties"), ({"properties": {"email": "a", "x": 1}}, "sensitive_property"), ({"properties": {"x": 1, "email": "a"}}, "unallowed_property"), ({"properties": {"plan": 1}}, "invalid_property_type"),
    ({"properties": {"plan": "team"}}, "missing_required_property"), ({"properties": {"plan": "team", "billing_interval": "daily"}}, "invalid_subscription_properties"), ({"properties": {"plan": "team\n", "billing_interval": "monthly"}}, "invalid_subscription_properties"),
    (VPV | {"properties": {"page_path": "/plans?email=x"}}, "invalid_page_path"), ({"event_name": "click", "properties": {"ui_name": "ok_name", "ui_type": "div"}}, "invalid_ui_component"),
    ({"event_name": "activation_completed", "properties": {"activation_action": "Bad"}}, "invalid_activation_action"), ({"event_name": "signup_completed", "properties": {"signup_method": "fax"}}, "invalid_signup_method"), ({"event_name": "signup_completed", "properties": {}}, None),
]


def test_reasons_in_order(spark):
    raws = [json.dumps(GOOD | change) for change, _ in CASES] + ["[]", "nope", '"x"']
    df = spark.createDataFrame([(k, r) for k, r in enumerate(raws)], "k int, raw string").selectExpr("*", "timestamp'2025-11-03 18:45:00.240Z' as received_at")
    found = [r["reason"] for r in validate.validate(df).orderBy("k").collect()]
    assert found == [want for _, want in CASES] + ["invalid_payload", "invalid_json", "invalid_payload"]


def test_http_outcomes(spark):
    good, big = json.dumps(GOOD), json.dumps(GOOD | {"x": "y" * 70_000})
    rows = [("GET", "fp_public_key", good), ("POST", "short", good), ("POST", "unknown_key", good), ("POST", "fp_public_key", big), ("POST", "fp_public_key", "{"), ("POST", "fp_public_key", "{}"), ("POST", "fp_public_key", good)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, method string, workspace_key string, body string").selectExpr("*", "timestamp'2025-11-03 18:45:00Z' as received_at")
    keys = spark.createDataFrame([("fp_public_key", "ws_1"), ("short", "ws_2")], "workspace_key string, workspace_id string")
    found = sorted((r["status"], r["reason"]) for r in validate.ingest(df, keys).collect() if r["status"] != 202)
    assert found == [(400, "invalid_json"), (401, "invalid_workspace_key"), (401, "invalid_workspace_key"), (405, "method_not_allowed"), (413, "payload_too_large"), (422, "unsupported_event_name")]


@pytest.mark.parametrize(("value", "key", "reason"), [('{"workspace_id":"demo","event":{}}', "x", "invalid_event_envelope"), ("not json", "x", "invalid_event_envelope")])
def test_bad_envelopes(spark, value, key, reason):
    df = spark.createDataFrame([("accepted-events.v1", key, value)], "topic string, key string, value string")
    assert validate.dead_letter_reason(validate.parse_envelope(df)).first()["reason"] == reason


def test_a_filter_on_the_reason_reads_a_record_once(spark):
    df = spark.createDataFrame([("accepted-events.v1", "x", "{}")], "topic string, key string, value string")
    rows = validate.dead_letter_reason(validate.parse_envelope(df)).where("reason is not null")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 2, plan


def test_validation_has_no_method_that_the_jvm_leaves_uncompiled(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    rows = spark.createDataFrame([("not json",), ("[]",), ("{}",)], "raw string").withColumn("received_at", F.lit("2024-02-01T00:00:00Z").cast("timestamp"))
    got = {r["raw"]: r["reason"] for r in validate.validate(rows).collect()}
    assert got == {"not json": "invalid_json", "[]": "invalid_payload", "{}": "unsupported_event_name"}
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000  # HotSpot's limit
