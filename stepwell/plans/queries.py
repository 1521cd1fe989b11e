"""Every query of the engine and the SQL that gives the same rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as v
from ..functions.values import STAGES, TOPIC, page_path, partition_key, stamp
from ..operators import dedupe, funnel, report, serving, validate
from ..sources.events import read_events, scan_range
from ..streaming import bronze
from . import insights, scenarios

START, END = "2024-01-10", "2024-01-20"
Query = Callable[[SparkSession, str], DataFrame]

_NAMES = "CASE event_type WHEN 'view' THEN 'vpv' WHEN 'signup' THEN 'signup_completed' WHEN 'click' THEN 'activation_completed' WHEN 'purchase' THEN 'subscription_started' ELSE 'click' END"
BRONZE = f"""
base AS (
  SELECT 'ws_' || (user_id % 4) AS workspace_id, printf('event-%012d', event_id) AS event_id,
    printf('anonymous-%08d-%03d', user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 3) AS anonymous_id, {_NAMES} AS event_name,
    ts AS occurred_at, ts + to_seconds(event_id * 37 % 600) AS received_at, '1.0.0' AS v, event_id AS id FROM events),
bronze AS (
  SELECT * FROM base UNION ALL
  SELECT workspace_id, event_id, anonymous_id, event_name, occurred_at - INTERVAL 2 MINUTE, received_at + INTERVAL 1 HOUR, v, id FROM base WHERE id % 20 = 0),
silver AS (SELECT * FROM bronze QUALIFY row_number() OVER (PARTITION BY workspace_id, event_id ORDER BY received_at, occurred_at) = 1),
pure AS (SELECT * FROM bronze QUALIFY row_number() OVER (PARTITION BY workspace_id, event_id ORDER BY occurred_at, received_at) = 1)"""
_ROW = "workspace_id, event_id, anonymous_id, event_name, strftime(occurred_at, '%Y-%m-%d %H:%M:%S.%f') AS occurred_at, strftime(received_at, '%Y-%m-%d %H:%M:%S.%f') AS received_at"
_T = ", ".join(f"min(occurred_at) FILTER (event_name = '{s}') AS t{k}" for k, s in enumerate(STAGES))
_IN = ", ".join(f"'{s}'" for s in STAGES)


def _firsts(source: str, where: str = "true", extra: str = "") -> str:
    return f"SELECT workspace_id, anonymous_id, v{extra}, {_T} FROM {source} WHERE event_name IN ({_IN}) AND {where} GROUP BY workspace_id, anonymous_id, v{extra}"


def _daily(firsts: str, conditions: list[str], days: str = "true", extra: str = "") -> str:
    union = " UNION ALL ".join(f"SELECT workspace_id, anonymous_id, v{extra}, '{s}' AS stage_name, CAST(t{k} AS DATE) AS d FROM {firsts} WHERE {c}" for k, (s, c) in enumerate(zip(STAGES, conditions, strict=True)))
    return f"SELECT workspace_id, CAST(d AS VARCHAR) AS event_date, v AS funnel_definition_version, stage_name, count(DISTINCT anonymous_id) AS unique_users FROM ({union}) WHERE {days} GROUP BY ALL"


_PAIRS = ["t0 IS NOT NULL", "t1 >= t0", "t2 >= t1", "t3 >= t2"]
_TARGET = f"d BETWEEN DATE '{START}' AND DATE '{END}'"


def _range(lookback: int) -> str:
    return f"occurred_at >= DATE '{START}' - INTERVAL {lookback} DAY AND occurred_at < DATE '{END}' + INTERVAL 1 DAY"


def _gold_sql(lookback: int) -> str:
    return f"WITH {BRONZE}, f AS ({_firsts('silver', _range(lookback))}) {_daily('f', _PAIRS, _TARGET)}"


_STRICT = f"""
e AS (SELECT workspace_id AS w, anonymous_id AS a, event_name AS n, occurred_at AS t FROM silver WHERE event_name IN ({_IN})),
s0 AS (SELECT w, a, min(t) AS t FROM e WHERE n = '{STAGES[0]}' GROUP BY ALL),
s1 AS (SELECT e.w, e.a, min(e.t) AS t FROM e JOIN s0 USING (w, a) WHERE n = '{STAGES[1]}' AND e.t >= s0.t GROUP BY ALL),
s2 AS (SELECT e.w, e.a, min(e.t) AS t FROM e JOIN s1 USING (w, a) WHERE n = '{STAGES[2]}' AND e.t >= s1.t GROUP BY ALL),
s3 AS (SELECT e.w, e.a, min(e.t) AS t FROM e JOIN s2 USING (w, a) WHERE n = '{STAGES[3]}' AND e.t >= s2.t GROUP BY ALL),
c AS (
  SELECT w AS workspace_id, (SELECT count(*) FROM s0 WHERE s0.w = x.w) AS u0, (SELECT count(*) FROM s1 WHERE s1.w = x.w) AS u1,
    (SELECT count(*) FROM s2 WHERE s2.w = x.w) AS u2, (SELECT count(*) FROM s3 WHERE s3.w = x.w) AS u3 FROM (SELECT DISTINCT w FROM e) x),
r AS (
  SELECT *, u1 / nullif(u0, 0) AS r1, u2 / nullif(u1, 0) AS r2, u3 / nullif(u2, 0) AS r3,
    floor(u1 / nullif(u0, 0) * 10000 + 0.5) / 10000 AS c1, floor(u2 / nullif(u1, 0) * 10000 + 0.5) / 10000 AS c2, floor(u3 / nullif(u2, 0) * 10000 + 0.5) / 10000 AS c3 FROM c),
k AS (
  SELECT *, CAST(CASE WHEN r1 IS NOT NULL AND r1 <= coalesce(r2, 9) AND r1 <= coalesce(r3, 9) THEN 1 WHEN r2 IS NOT NULL AND r2 <= coalesce(r3, 9) THEN 2 WHEN r3 IS NOT NULL THEN 3 ELSE 1 END AS INTEGER) AS drop_index FROM r),
g AS (SELECT max(received_at) + INTERVAL 200 SECOND AS at FROM silver),
h AS (
  SELECT workspace_id, count(*) AS accepted_event_count, CAST(greatest(0, (epoch_us(max(g.at)) - epoch_us(max(received_at))) // 1000000) AS BIGINT) AS age_seconds FROM silver, g GROUP BY ALL),
fresh AS (SELECT *, CASE WHEN age_seconds <= 300 THEN 'healthy' ELSE 'stale' END AS sla_status FROM h)"""
_DAILY_SUBS = """
ds AS (SELECT workspace_id, CAST(occurred_at AS DATE) AS d, count(DISTINCT anonymous_id) FILTER (event_name = 'subscription_started') AS users FROM silver GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY d DESC) AS rank FROM ds),
md AS (SELECT workspace_id, median(users) AS med, count(*) AS n FROM rk WHERE rank BETWEEN 2 AND 8 GROUP BY ALL),
ad AS (SELECT workspace_id, median(abs(users - med)) AS mad FROM rk JOIN md USING (workspace_id) WHERE rank BETWEEN 2 AND 8 GROUP BY ALL),
an AS (
  SELECT rk.workspace_id, 'daily_subscription_started_users' AS metric, CAST(d AS VARCHAR) AS as_of_event_date, CAST(users AS DOUBLE) AS current_value, coalesce(n, 0) AS baseline_points,
    CAST(med AS DOUBLE) AS med, CAST(mad AS DOUBLE) AS mad, 0.6745::DOUBLE * (users - med) / nullif(mad, 0) AS z
  FROM rk LEFT JOIN md USING (workspace_id) LEFT JOIN ad USING (workspace_id) WHERE rank = 1),
st AS (SELECT *, CASE WHEN baseline_points < 7 THEN 'insufficient_history' WHEN mad = 0 THEN 'insufficient_variation' WHEN abs(z) >= 3.5 THEN 'anomaly' ELSE 'normal' END AS anomaly_status FROM an)"""
_PCT = "CAST(CAST(round(CAST({0} AS DECIMAL(12,4)) * 100, 1) AS DECIMAL(12,1)) AS VARCHAR) || '%'"


def _now(spark: SparkSession, d: str) -> str:
    """200 seconds after the last event came in, as a clock would give it: one aggregate over the scan."""
    return str(read_events(spark, d, False).agg(F.max("received_at") + F.expr("interval 200 seconds")).first()[0])


# Raw events with one defect each, built by the same expression in Spark and DuckDB.
_D = "(event_id % 25)"
_ISO = "'2024-02-01T00:00:00Z'"
RAW = f"""CASE {_D} WHEN 22 THEN 'not json' WHEN 1 THEN '[]' ELSE '{{"event_id":"' || CASE {_D} WHEN 4 THEN 'short' ELSE 'event-0000000000' || CAST(event_id AS VARCHAR(20)) END
 || '","event_name":"' || CASE {_D} WHEN 3 THEN 'unknown' WHEN 20 THEN 'vpv' WHEN 23 THEN 'click' WHEN 24 THEN 'activation_completed' ELSE 'subscription_started' END
 || CASE {_D} WHEN 11 THEN '' WHEN 12 THEN '","occurred_at":"2024-02-01T00:00:00' WHEN 13 THEN '","occurred_at":"2024-02-01T00:05:01Z' WHEN 14 THEN '","occurred_at":"2023-01-31T00:00:00Z' ELSE '","occurred_at":"2024-01-31T12:00:00.5Z' END
 || '","anonymous_id":' || CASE {_D} WHEN 5 THEN '12345678901234567890' ELSE '"anonymous-000000001"' END || ',"session_id":"session-000000000001"'
 || CASE {_D} WHEN 6 THEN ',"user_id":"u"' ELSE '' END || CASE {_D} WHEN 2 THEN ',"email":"x"' ELSE '' END
 || ',"properties":' || CASE {_D} WHEN 15 THEN '"x"' WHEN 16 THEN '{{"email":"a","plan":"pro"}}' WHEN 17 THEN '{{"plan":"pro","colour":"red"}}' WHEN 18 THEN '{{"plan":3}}' WHEN 19 THEN '{{"plan":"pro"}}'
   WHEN 20 THEN '{{"page_path":"/a?b=1"}}' WHEN 21 THEN '{{"plan":"pro","billing_interval":"daily"}}' WHEN 23 THEN '{{"ui_name":"Bad Name"}}' WHEN 24 THEN '{{"activation_action":"first_report"}}' ELSE '{{"plan":"pro","billing_interval":"monthly"}}' END
 || ',"context":' || CASE {_D} WHEN 10 THEN '{{"platform":"ios","sdk_version":"1"}}' ELSE '{{"platform":"web","sdk_version":"1"}}' END
 || ',"schema_version":"' || CASE {_D} WHEN 7 THEN '2.0.0' ELSE '1.0.0' END || '","tracking_plan_version":"1.0.0","funnel_definition_version":"1.0.0","consent":'
 || CASE {_D} WHEN 8 THEN '{{"analytics":false}}' WHEN 9 THEN '{{"analytics":true,"ads":true}}' ELSE '{{"analytics":true}}' END || '}}' END"""
_J = "json_extract_string(j, '$.{0}')"
_PK = "json_keys(j, '$.properties')"
VALIDATE = f"""
raws AS (SELECT event_id, raw, CASE WHEN json_valid(raw) THEN raw ELSE '{{}}' END AS j FROM (SELECT event_id, {RAW} AS raw FROM events)),
checked AS (SELECT event_id, CASE
  WHEN NOT json_valid(raw) THEN 'invalid_json' WHEN json_type(j) <> 'OBJECT' THEN 'invalid_payload'
  WHEN len(list_filter(json_keys(j), lambda x: x NOT IN ('event_id','event_name','occurred_at','anonymous_id','session_id','user_id','properties','context','schema_version','tracking_plan_version','funnel_definition_version','consent'))) > 0 THEN 'unallowed_envelope_field'
  WHEN {_J.format("event_name")} NOT IN ('vpv','click','signup_completed','activation_completed','subscription_started') THEN 'unsupported_event_name'
  WHEN json_type(j, '$.anonymous_id') <> 'VARCHAR' OR length({_J.format("event_id")}) NOT BETWEEN 16 AND 128 OR length({_J.format("user_id")}) < 16 THEN 'invalid_identifier'
  WHEN {_J.format("schema_version")} <> '1.0.0' THEN 'unsupported_contract_version'
  WHEN {_J.format("consent.analytics")} <> 'true' OR len(json_keys(j, '$.consent')) > 1 OR {_J.format("context.platform")} <> 'web' THEN 'invalid_context_or_consent'
  WHEN {_J.format("occurred_at")} IS NULL THEN 'missing_occurred_at'
  WHEN NOT regexp_matches({_J.format("occurred_at")}, 'Z$') OR TRY_CAST(replace({_J.format("occurred_at")}, 'Z', '') AS TIMESTAMP) NOT BETWEEN TIMESTAMP '2024-02-01' - INTERVAL 365 DAY AND TIMESTAMP '2024-02-01' + INTERVAL 5 MINUTE THEN 'invalid_event_time'
  WHEN json_type(j, '$.properties') <> 'OBJECT' THEN 'invalid_properties'
  WHEN regexp_matches({_PK}[1], '(?i)email') THEN 'sensitive_property'
  WHEN len(list_filter({_PK}, lambda x: x NOT IN ('plan','billing_interval','acquisition_channel','page_path','ui_name','activation_action'))) > 0 THEN 'unallowed_property'
  WHEN json_type(j, '$.properties.plan') <> 'VARCHAR' THEN 'invalid_property_type'
  WHEN {_J.format("event_name")} = 'subscription_started' AND {_J.format("properties.billing_interval")} IS NULL THEN 'missing_required_property'
  WHEN regexp_matches({_J.format("properties.page_path")}, '[?#]') THEN 'invalid_page_path'
  WHEN {_J.format("properties.billing_interval")} NOT IN ('monthly','yearly') THEN 'invalid_subscription_properties'
  WHEN NOT regexp_full_match({_J.format("properties.ui_name")}, '[a-z][a-z0-9_]{{1,63}}') THEN 'invalid_ui_component'
  ELSE NULL END AS reason FROM raws)"""


def _raws(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.expr(RAW.replace("VARCHAR(20)", "STRING")).alias("raw"))
    return validate.validate(rows.withColumn("received_at", F.lit("2024-02-01T00:00:00Z").cast("timestamp")))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("workspace_id", "event_id", "anonymous_id", "event_name", stamp("occurred_at").alias("occurred_at"), stamp("received_at").alias("received_at"))


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("event_date", F.col("event_date").cast("string"))


def _silver(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.silver(read_events(spark, d))


def _silver_range(spark: SparkSession, d: str, lookback: int = 30) -> DataFrame:
    """Silver of the rebuilt range and its lookback: the range reaches the scan, so dedupe sees no other days."""
    return dedupe.silver(read_events(spark, d, True, START, END, lookback))


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    gold = funnel.canonical_daily(_silver_range(spark, d), START, END)
    older = serving.snapshot(gold, "airflow-2", "2024-02-02 00:00:00").withColumn("unique_users", F.col("unique_users") + 1)
    return serving.snapshot(gold, "canonical-1", "2024-02-01 00:00:00").unionByName(older)


def _serving_columns(df: DataFrame) -> DataFrame:
    return _day(df).withColumn("canonical_completed_at", stamp("canonical_completed_at"))


def _report(spark: SparkSession, d: str) -> DataFrame:
    return report.funnel_report(_silver(spark, d), _now(spark, d))


def _records(spark: SparkSession, d: str) -> DataFrame:
    rows = bronze.to_records(_silver(spark, d))
    n = F.col("offset")
    return rows.withColumn("value", F.when(n % 17 == 0, "not json").otherwise(F.col("value"))).withColumn("key", F.when(n % 19 == 0, "1:x").otherwise(F.col("key"))).withColumn("topic", F.when(n % 23 == 0, "other").otherwise(F.col("topic")))


_own_root: list[str] = []


def shared(spark: SparkSession, label: str) -> str:
    """A folder of its own in the one that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local session gets a folder that is removed at its end; a cluster has none to offer.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if not _own_root:
            _own_root.append(tempfile.mkdtemp(prefix="stepwell-"))
            atexit.register(shutil.rmtree, _own_root[0], ignore_errors=True)
        named = f"file://{_own_root[0]}"
    return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _logged(rows: DataFrame) -> DataFrame:
    return rows.unionByName(rows.where("offset % 20 = 0"))


def _streamed(spark: SparkSession, d: str, runs: int = 1) -> tuple[DataFrame, DataFrame]:
    """Bronze and dead letters after the log, with every twentieth record sent twice, went through the stream.

    A record that is sent twice is dead-lettered twice: at least once, as the audit has it.
    """
    root = shared(spark, "stream")
    rows = _records(spark, d)
    for _ in range(runs):
        _logged(rows).write.mode("append").json(f"{root}/log")
        bronze.ingest_stream(bronze.read_records(spark, f"{root}/log"), f"{root}/bronze", f"{root}/dead", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/bronze"), spark.read.schema("topic string, partition int, offset long, reason string").json(f"{root}/dead")


_REC = "rec AS (SELECT *, id % 17 = 0 AS bad, id % 19 = 0 OR id % 23 = 0 AS wrong FROM silver)"


def queries() -> dict[str, Query]:
    from . import more, rules, upkeep  # they are built from the parts above

    return {
        "bronze_scan_range": lambda s, d: _shown(scan_range(read_events(s, d, True, START, END), START, END)),
        "silver_dedupe": lambda s, d: _shown(dedupe.silver(scan_range(read_events(s, d, True, START, END), START, END))),
        "pure_dedupe": lambda s, d: _shown(dedupe.pure(read_events(s, d))),
        "store_append_new": lambda s, d: _shown(dedupe.new_only(read_events(s, d), read_events(s, d, False).where("event_name = 'vpv'"))),
        "dedupe_stats": lambda s, d: dedupe.stats(read_events(s, d)),
        "gold_funnel_daily": lambda s, d: _day(funnel.canonical_daily(_silver_range(s, d), START, END)),
        "gold_with_lookback": lambda s, d: _day(funnel.canonical_daily(_silver_range(s, d, 1), START, END, 1)),
        "gold_per_day": lambda s, d: _day(funnel.canonical_daily(_silver_range(s, d, 1), START, END, 1, "per_day")),
        "gold_snapshot_columns": lambda s, d: _serving_columns(serving.snapshot(funnel.canonical_daily(_silver_range(s, d), START, END), "canonical-1", "2024-02-01 00:00:00")),
        "pure_daily_counts": lambda s, d: _day(funnel.pure_daily(read_events(s, d))),
        "report_stage_counts": lambda s, d: funnel.strict_counts(_silver(s, d)),
        "report_conversion": lambda s, d: report.conversion(funnel.strict_counts(_silver(s, d))),
        "report_largest_drop": lambda s, d: report.largest_drop(funnel.strict_counts(_silver(s, d))),
        "report_freshness": lambda s, d: report.freshness(_silver(s, d), _now(s, d)),
        "report_commentary": lambda s, d: _report(s, d).select("workspace_id", "commentary_status", "summary"),
        "local_gold_daily": lambda s, d: _day(funnel.unordered_daily(_silver(s, d))),
        "daily_subscriptions": lambda s, d: _day(report.daily_subscriptions(_silver(s, d))),
        "anomaly_detect": lambda s, d: report.anomaly(report.daily_subscriptions(_silver(s, d))),
        "validate_reasons": lambda s, d: _raws(s, d).select("event_id", F.coalesce("reason", F.lit("accepted")).alias("reason")),
        "validate_accepted": lambda s, d: _raws(s, d).where("reason is null").select("event_id", "event_time_quality"),
        "serving_current": lambda s, d: _serving_columns(serving.current(_snapshots(s, d))),
        "serving_current_by_time": lambda s, d: _serving_columns(serving.current(_snapshots(s, d), "canonical_completed_at")),
        "serving_contract": lambda s, d: serving.contract_violations(_snapshots(s, d).withColumn("stage_name", F.when(F.col("unique_users") % 7 == 0, "other").otherwise(F.col("stage_name")))).groupBy(F.coalesce("violation", F.lit("none")).alias("violation")).agg(F.count("*").alias("n")),
        "partition_key": lambda s, d: read_events(s, d).select(partition_key("workspace_id", "anonymous_id").alias("partition_key")).groupBy("partition_key").agg(F.count("*").alias("n")),
        "page_path_normalize": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", page_path(F.col("url")).alias("page_path")),
        "event_envelope_parse": lambda s, d: validate.parse_envelope(_records(s, d)).where("event_id is not null").select("event_id", "workspace_id", "anonymous_id", stamp("occurred_at").alias("occurred_at")),
        "dead_letter_reasons": lambda s, d: validate.dead_letter_reason(validate.parse_envelope(_records(s, d))).where("reason is not null").select("topic", "partition", "offset", "reason"),
        "log_commit_offsets": lambda s, d: validate.commit_offsets(_records(s, d)),
        "dashboard_stages": lambda s, d: report.dashboard_stages(report.conversion(funnel.strict_counts(_silver(s, d)))),
        "dashboard_texts": lambda s, d: report.dashboard_texts(_report(s, d)),
        "scenario_summary": lambda s, d: scenarios.summary(scenarios.seeded(read_events(s, d, False))),
        "stream_bronze_dedupe": lambda s, d: _streamed(s, d, 2)[0].select("workspace_id", "event_id", "anonymous_id", "event_name"),
        "stream_dead_letter": lambda s, d: _streamed(s, d)[1],
        "time_to_next_stage": lambda s, d: insights.time_to_next_stage(_silver(s, d)),
        "return_within_week": lambda s, d: insights.return_within_week(_silver(s, d), F.substring("anonymous_id", 1, 18)).withColumn("first_day", F.col("first_day").cast("string")),
        "sessions": lambda s, d: insights.sessions(_silver(s, d)),
        "retention_cohorts": lambda s, d: insights.retention_cohorts(_silver(s, d), "2024-01-01", F.substring("anonymous_id", 1, 18)),
        "source_breakdown": lambda s, d: insights.source_breakdown(_silver(s, d)),
        "quality_gates": lambda s, d: insights.quality_gates(read_events(s, d), _silver(s, d)),
        **more.queries(),
        **upkeep.queries(),
        **rules.queries(),
    }


_SNAP = f"""WITH {BRONZE}, f AS ({_firsts("silver", _range(30))}), gold AS ({_daily("f", _PAIRS, _TARGET)}),
snaps AS (
  SELECT *, 'canonical-1' AS snapshot_version, '2024-02-01 00:00:00.000000' AS canonical_completed_at, 'healthy' AS data_sla_status FROM gold UNION ALL
  SELECT workspace_id, event_date, funnel_definition_version, stage_name, unique_users + 1, 'airflow-2', '2024-02-02 00:00:00.000000', 'healthy' FROM gold)"""
_W = f"WITH {BRONZE}"


def _pure_sql() -> str:
    kept = "workspace_id, anonymous_id, v, t0, t1, t2, t3"
    fold = f"""a1 AS (SELECT {kept}, t0 AS l0, CASE WHEN t1 IS NOT NULL AND (t0 IS NULL OR t1 >= t0) THEN t1 END AS a1 FROM f),
a2 AS (SELECT *, coalesce(a1, l0) AS l1, CASE WHEN t2 IS NOT NULL AND (coalesce(a1, l0) IS NULL OR t2 >= coalesce(a1, l0)) THEN t2 END AS a2 FROM a1),
a3 AS (SELECT *, CASE WHEN t3 IS NOT NULL AND (coalesce(a2, l1) IS NULL OR t3 >= coalesce(a2, l1)) THEN t3 END AS a3 FROM a2)"""
    return f"{_W}, f AS ({_firsts('pure')}), {fold}, y AS (SELECT workspace_id, anonymous_id, v, l0 AS t0, a1 AS t1, a2 AS t2, a3 AS t3 FROM a3) {_daily('y', [f't{k} IS NOT NULL' for k in range(4)])}"


def oracle_sql() -> dict[str, str]:
    from . import more, rules, upkeep

    stage = " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(STAGES))
    counts = f"WITH {BRONZE}, {_STRICT}"
    labels = v.STAGE_LABELS
    card = " UNION ALL ".join(
        f"SELECT workspace_id, {k} AS position, '{s}' AS event_name, '{labels[k]}' AS label, u{k} AS users, {'coalesce(' + _PCT.format(f'c{k}') + ', chr(8212))' if k else 'chr(8212)'} AS conversion, CAST(CASE WHEN u0 > 0 THEN floor(100.0::DOUBLE * u{k} / u0 + 0.5) ELSE 0 END AS BIGINT) AS share_of_entry FROM r"
        for k, s in enumerate(STAGES)
    )
    told = "CASE WHEN anomaly_status IN ('insufficient_variation', 'normal', 'anomaly') THEN"
    scored = "CASE WHEN anomaly_status IN ('normal', 'anomaly') THEN"
    r4 = "floor({0} * 10000 + 0.5) / 10000"
    plans = " UNION ALL ".join(f"SELECT '{n}', '{STAGES[k]}', {c}, {c}" for n, p in scenarios.PLANS.items() if n != "retries" for k, c in enumerate(p))
    least = "least(coalesce(c1, 9), coalesce(c2, 9), coalesce(c3, 9))"
    return {
        "bronze_scan_range": f"{_W} SELECT {_ROW} FROM bronze WHERE {_range(0)}",
        "silver_dedupe": f"{_W}, x AS (SELECT * FROM bronze WHERE {_range(0)} QUALIFY row_number() OVER (PARTITION BY workspace_id, event_id ORDER BY received_at, occurred_at) = 1) SELECT {_ROW} FROM x",
        "pure_dedupe": f"{_W} SELECT {_ROW} FROM pure",
        "store_append_new": f"{_W} SELECT {_ROW} FROM silver WHERE event_name <> 'vpv'",
        "dedupe_stats": f"{_W} SELECT workspace_id, count(*) AS row_count, count(DISTINCT event_id) AS distinct_events, count(*) - count(DISTINCT event_id) AS duplicates FROM bronze GROUP BY ALL",
        "gold_funnel_daily": _gold_sql(30),
        "gold_with_lookback": _gold_sql(1),
        "gold_per_day": f"{_W}, days AS (SELECT CAST(unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY)) AS DATE) AS target), x AS (SELECT silver.*, target FROM silver JOIN days ON occurred_at >= target - INTERVAL 1 DAY AND occurred_at < target + INTERVAL 1 DAY), f AS ({_firsts('x', 'true', ', target')}) {_daily('f', _PAIRS, 'd = target', ', target')}".replace("GROUP BY ALL", "GROUP BY workspace_id, d, v, stage_name"),
        "gold_snapshot_columns": f"{_SNAP} SELECT * FROM snaps WHERE snapshot_version = 'canonical-1'",
        "pure_daily_counts": _pure_sql(),
        "report_stage_counts": f"{counts} SELECT * FROM c",
        "report_conversion": f"{counts} SELECT workspace_id, u0, u1, u2, u3, c1, c2, c3 FROM r",
        "report_largest_drop": f"{counts} SELECT workspace_id, u0, u1, u2, u3, drop_index FROM k",
        "report_freshness": f"{counts} SELECT * FROM fresh",
        "report_commentary": f"""{counts} SELECT workspace_id, CASE WHEN sla_status <> 'healthy' THEN 'suppressed_data_sla_unhealthy' WHEN u0 = 0 THEN 'insufficient_volume' ELSE 'informational' END AS commentary_status,
  CASE WHEN sla_status <> 'healthy' THEN '{v.UNHEALTHY_TEXT}' WHEN u0 = 0 THEN '{v.EMPTY_TEXT}'
  ELSE '{v.DROP_TEXT[0]}' || CASE drop_index - 1 {stage} END || '{v.DROP_TEXT[1]}' || CASE drop_index {stage} END || ' (' || {_PCT.format("coalesce(CASE drop_index WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END, 0)")} || '{v.DROP_TEXT[2]}' END AS summary FROM k JOIN fresh USING (workspace_id)""",
        "local_gold_daily": f"{_W} SELECT workspace_id, CAST(CAST(occurred_at AS DATE) AS VARCHAR) AS event_date, " + ", ".join(f"count(DISTINCT anonymous_id) FILTER (event_name = '{s}') AS {s}" for s in STAGES) + f" FROM silver WHERE event_name IN ({_IN}) GROUP BY ALL",
        "daily_subscriptions": f"{_W}, {_DAILY_SUBS} SELECT workspace_id, CAST(d AS VARCHAR) AS event_date, users FROM ds",
        "anomaly_detect": f"{_W}, {_DAILY_SUBS} SELECT workspace_id, metric, anomaly_status, as_of_event_date, current_value, baseline_points, {told} {r4.format('med')} END AS baseline_median, {told} {r4.format('mad')} END AS median_absolute_deviation, {scored} {r4.format('z')} END AS robust_z_score FROM st",
        "validate_reasons": f"WITH {VALIDATE} SELECT event_id, coalesce(reason, 'accepted') AS reason FROM checked",
        "validate_accepted": f"WITH {VALIDATE} SELECT event_id, 'client_verified' AS event_time_quality FROM checked WHERE reason IS NULL",
        "serving_current": f"{_SNAP} SELECT * FROM snaps QUALIFY row_number() OVER (PARTITION BY workspace_id, event_date, funnel_definition_version, stage_name ORDER BY snapshot_version DESC) = 1",
        "serving_current_by_time": f"{_SNAP} SELECT * FROM snaps QUALIFY row_number() OVER (PARTITION BY workspace_id, event_date, funnel_definition_version, stage_name ORDER BY canonical_completed_at DESC) = 1",
        "serving_contract": f"{_SNAP} SELECT CASE WHEN unique_users % 7 = 0 THEN 'stage_name' ELSE 'none' END AS violation, count(*) AS n FROM snaps GROUP BY ALL",
        "partition_key": f"{_W} SELECT length(workspace_id) || ':' || workspace_id || anonymous_id AS partition_key, count(*) AS n FROM bronze GROUP BY ALL",
        "page_path_normalize": "SELECT page_id, CASE WHEN length(p) = 0 THEN '/' WHEN p[1] = '/' THEN p ELSE '/' || p END AS page_path FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', '') AS p FROM pages)",
        "event_envelope_parse": f"{_W}, {_REC} SELECT event_id, workspace_id, anonymous_id, strftime(occurred_at, '%Y-%m-%d %H:%M:%S.%f') AS occurred_at FROM rec WHERE NOT bad",
        "dead_letter_reasons": f"{_W}, {_REC} SELECT CASE WHEN id % 23 = 0 THEN 'other' ELSE '{TOPIC}' END AS topic, CAST(id % 4 AS INTEGER) AS partition, id AS \"offset\", CASE WHEN bad THEN 'invalid_event_envelope' ELSE 'invalid_topic_or_partition_key' END AS reason FROM rec WHERE bad OR wrong",
        "log_commit_offsets": f"{_W}, {_REC} SELECT CASE WHEN id % 23 = 0 THEN 'other' ELSE '{TOPIC}' END AS topic, CAST(id % 4 AS INTEGER) AS partition, max(id) + 1 AS next_offset FROM rec GROUP BY ALL",
        "dashboard_stages": f"{counts} {card}",
        "dashboard_texts": f"""{counts}, {_DAILY_SUBS} SELECT k.workspace_id, CASE WHEN sla_status = 'healthy' THEN '{v.HEALTHY_HEAD}' || accepted_event_count || '{v.EVENT_TAIL}' || CASE WHEN accepted_event_count = 1 THEN '' ELSE 's' END ELSE '{v.STALE_HEAD}' END AS health,
  CASE WHEN {least} = 9 THEN '{v.NO_STEP_TEXT}' ELSE CASE {least} WHEN c1 THEN '{labels[1]}' WHEN c2 THEN '{labels[2]}' ELSE '{labels[3]}' END || '{v.STEP_TEXT[0]}' || {_PCT.format(least)} || '{v.STEP_TEXT[1]}' END AS drop_off,
  CASE WHEN sla_status <> 'healthy' THEN '{v.PAUSED}' WHEN anomaly_status = 'anomaly' THEN '{v.CHANGED}' WHEN anomaly_status = 'normal' THEN '{v.EXPECTED}' WHEN anomaly_status = 'insufficient_variation' THEN '{v.UNIFORM}' ELSE '{v.PENDING}' END AS anomaly_title
  FROM k JOIN fresh USING (workspace_id) JOIN st USING (workspace_id)""",
        "scenario_summary": f"{_W}, ws AS (SELECT DISTINCT workspace_id FROM base) SELECT workspace_id, col0 AS scenario, col1 AS event_name, CAST(col2 AS BIGINT) AS attempted, CAST(col3 AS BIGINT) AS accepted, CAST(col2 - col3 AS BIGINT) AS duplicates FROM (SELECT * FROM ({plans} UNION ALL SELECT 'retries', 'vpv', 3, 2 UNION ALL SELECT 'retries', 'signup_completed', 1, 1 UNION ALL SELECT 'retries', 'activation_completed', 1, 1 UNION ALL SELECT 'retries', 'subscription_started', 1, 1 UNION ALL SELECT 'subscription-anomaly', 'subscription_started', 51, 51) x(col0, col1, col2, col3)), ws",
        "stream_bronze_dedupe": f"{_W}, {_REC} SELECT workspace_id, event_id, anonymous_id, event_name FROM rec WHERE NOT bad AND NOT wrong",
        "stream_dead_letter": f"{_W}, {_REC} SELECT CASE WHEN id % 23 = 0 THEN 'other' ELSE '{TOPIC}' END AS topic, CAST(id % 4 AS INTEGER) AS partition, id AS \"offset\", CASE WHEN bad THEN 'invalid_event_envelope' ELSE 'invalid_topic_or_partition_key' END AS reason FROM (SELECT * FROM rec UNION ALL SELECT * FROM rec WHERE id % 20 = 0) WHERE bad OR wrong",
        "time_to_next_stage": f"{_W}, f AS ({_firsts('silver')}), x AS (" + " UNION ALL ".join(f"SELECT workspace_id, '{STAGES[k]}' AS stage_name, (epoch_us(t{k}) - epoch_us(t{k - 1})) / 1e6 AS s FROM f WHERE t{k} >= t{k - 1}" for k in (1, 2, 3)) + ") SELECT workspace_id, stage_name, count(*) AS journeys, median(s) AS median_seconds FROM x GROUP BY ALL",
        "return_within_week": f"{_W}, x AS (SELECT DISTINCT workspace_id, substr(anonymous_id, 1, 18) AS u, CAST(occurred_at AS DATE) AS d FROM silver), y AS (SELECT *, min(d) OVER (PARTITION BY workspace_id, u) AS f FROM x), z AS (SELECT workspace_id, u, f, bool_or(d - f BETWEEN 1 AND 7) AS back FROM y GROUP BY ALL) SELECT workspace_id, CAST(f AS VARCHAR) AS first_day, count(*) AS new_users, count(*) FILTER (back) AS returned FROM z GROUP BY ALL",
        "sessions": f"{_W}, x AS (SELECT workspace_id, occurred_at - lag(occurred_at) OVER (PARTITION BY workspace_id, anonymous_id ORDER BY occurred_at, event_id) AS gap FROM silver) SELECT workspace_id, count(*) FILTER (gap IS NULL OR gap > INTERVAL 30 MINUTE) AS sessions, count(*) AS event_count FROM x GROUP BY ALL",
        "retention_cohorts": f"{_W}, x AS (SELECT DISTINCT workspace_id, substr(anonymous_id, 1, 18) AS u, date_diff('day', DATE '2024-01-01', CAST(occurred_at AS DATE)) // 7 AS week FROM silver), y AS (SELECT *, min(week) OVER (PARTITION BY workspace_id, u) AS cohort FROM x) SELECT workspace_id, cohort, week - cohort AS periods_later, count(*) AS users FROM y GROUP BY ALL",
        "source_breakdown": f"{_W} SELECT workspace_id, event_name, count(*) AS event_count, count(DISTINCT anonymous_id) AS users FROM silver GROUP BY ALL",
        "quality_gates": f"{_W}, b AS (SELECT workspace_id, count(*) AS bronze_rows, count(DISTINCT event_id) AS bronze_events, count(*) FILTER (occurred_at IS NULL) AS null_times FROM bronze GROUP BY ALL), s AS (SELECT workspace_id, count(*) AS silver_rows FROM silver GROUP BY ALL) SELECT *, bronze_rows - bronze_events AS duplicates, bronze_events = silver_rows AS reconciled FROM b JOIN s USING (workspace_id)",
        **more.oracle_sql(),
        **upkeep.oracle_sql(),
        **rules.oracle_sql(),
    }
