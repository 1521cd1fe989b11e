"""Queries of streams, stores, HTTP outcomes, the hourly run and the designed operators, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import MAX_BODY_BYTES, STAGES, stamp
from ..operators import extended, funnel, report, serving, validate
from ..sources import sinks
from ..sources.events import read_events
from ..streaming import bronze
from . import insights, rebuild, scenarios
from .queries import (
    _DAILY_SUBS, _IN, _PAIRS, _REC, _ROW, _SNAP, _STRICT, BRONZE, END, RAW, START, VALIDATE, Query,
    _daily, _day, _firsts, _logged, _range, _raws, _records, _report, _serving_columns, _shown, _silver, _silver_range, _snapshots, shared,
)

_W = f"WITH {BRONZE}"
_GOOD = "good AS (SELECT * FROM rec WHERE NOT bad AND NOT wrong)"
NOW = "2024-01-31 00:10:00"


def _stream_to_gold(spark: SparkSession, d: str) -> DataFrame:
    """The log through the stream to Bronze, and Bronze through the rebuild to Gold."""
    root, rows = shared(spark, "gold"), _records(spark, d)
    _logged(rows).write.json(f"{root}/log")
    bronze.ingest_stream(bronze.read_records(spark, f"{root}/log"), f"{root}/bronze", f"{root}/dead", f"{root}/checkpoint")
    config = rebuild.RebuildConfig(START, END, "canonical-1")
    return rebuild.rebuild(spark, f"{root}/bronze", f"{root}/silver", f"{root}/gold", config, "2024-02-01 00:00:00").select(serving.COLUMNS)


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    """The serving table after two hourly runs over the turn of a day; the second repeats the first one's day."""
    root = shared(spark, "hourly")
    paths = [f"{root}/{n}" for n in ("bronze", "silver", "gold", "served")]
    sinks.append_bronze(read_events(spark, d, False, START, END, 3), paths[0])
    rebuild.run_hour(spark, *paths, (f"{START}T22:15:00", f"{START}T23:15:00"), "1", 3)
    rebuild.run_hour(spark, *paths, (f"{START}T23:15:00", "2024-01-11T00:15:00"), "2", 3)
    return serving.current(spark.read.parquet(paths[3]).select(serving.COLUMNS)).select("workspace_id", "event_date", "stage_name", "unique_users", "snapshot_version")


def _published(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared(spark, 'served')}/table"
    rows = _snapshots(spark, d)
    for _ in range(2):  # the second time finds the snapshot there
        rebuild.publish(rows, path, START, "airflow-2")
    return spark.read.parquet(path).select(serving.COLUMNS)


def _counted(spark: SparkSession, d: str) -> DataFrame:
    root = shared(spark, "counted")
    _logged(_records(spark, d)).write.json(f"{root}/log")
    bronze.ingest_stream(bronze.read_records(spark, f"{root}/log"), f"{root}/bronze", f"{root}/dead", f"{root}/checkpoint", f"{root}/counted")
    totals = [F.sum(c).alias(c) for c in ("polled", "materialized", "dead_lettered")]
    return spark.read.schema(bronze.COUNTERS).json(f"{root}/counted").agg(*totals)


def _first_seen(spark: SparkSession, d: str) -> DataFrame:
    """The first good record of each key, by keyed state."""
    root = shared(spark, "seen")
    rows = _records(spark, d)
    _logged(rows).write.json(f"{root}/log")
    bronze.ingest_first_seen(bronze.read_records(spark, f"{root}/log"), f"{root}/rows", f"{root}/checkpoint")
    return spark.read.schema("workspace_id string, event_id string, anonymous_id string, event_name string").parquet(f"{root}/rows")


def _replayed(spark: SparkSession, d: str) -> DataFrame:
    """A store that failed after the log was written, healed by a retry and by a replay of the log."""
    root, rows = shared(spark, "replay"), read_events(spark, d)
    sinks.append_new(rows.where("event_name <> 'click'"), f"{root}/log")
    bronze.publish_then_store(rows.where("event_name = 'vpv'"), f"{root}/log", f"{root}/store")
    for _ in range(2):
        bronze.replay_log(spark, f"{root}/log", f"{root}/store", f"{root}/checkpoint")
    return _shown(spark.read.parquet(f"{root}/store"))


_REQUEST = {
    "method": "CASE WHEN event_id % 31 = 0 THEN 'GET' ELSE 'POST' END",
    "workspace_key": "CASE WHEN event_id % 29 = 0 THEN 'short' WHEN event_id % 23 = 0 THEN 'key-of-nobody' ELSE 'key-of-ws-' || CAST(user_id % 4 AS VARCHAR(4)) END",
    "body": f"CASE WHEN event_id % 500 = 7 THEN repeat('x', {MAX_BODY_BYTES + 1}) ELSE {RAW} END",
}


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Raw events as HTTP requests; every tenth event comes twice."""
    sql = {k: v.replace("VARCHAR(20)", "STRING").replace("VARCHAR(4)", "STRING") for k, v in _REQUEST.items()}
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("nth", F.explode(F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    at = F.lit("2024-02-01T00:00:00Z").cast("timestamp")
    return rows.select("event_id", "nth", *[F.expr(v).alias(k) for k, v in sql.items()], (at + F.make_dt_interval(secs=F.col("nth").cast("decimal(18,6)") * 3)).alias("received_at"))


def _keys(spark: SparkSession) -> DataFrame:
    return spark.range(4).select(F.concat(F.lit("key-of-ws-"), F.col("id").cast("string")).alias("workspace_key"), F.concat(F.lit("ws_"), F.col("id").cast("string")).alias("workspace_id"))


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    return validate.ingest(_requests(spark, d), _keys(spark))


#: Later keys of the same names, the last of which counts, by event_id; those of rejected requests among them.
_AGAIN = """CASE event_id % 7 WHEN 0 THEN ',"properties":{"plan":"pro","billing_interval":"monthly","email":"a@b.c"}' WHEN 1 THEN ',"properties":{"plan":"pro","billing_interval":"yearly"}'
 WHEN 2 THEN ',"consent":{"analytics":true},"consent":{"analytics":false}' WHEN 3 THEN ',"event_id":"short"' WHEN 4 THEN ',"event_id":"event-of-' || lpad(CAST(event_id % 10 AS VARCHAR(20)), 9, '0') || '"'
 WHEN 5 THEN ',"properties":{"colour":"red","email":"a"}' ELSE '' END"""
_REPEATED = f"""CASE WHEN event_id % 25 IN (0, 2, 8, 16, 17) THEN left({RAW}, length({RAW}) - 1) || {_AGAIN} || '}}' ELSE {RAW} END"""


def _repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    """Requests whose bodies repeat keys: the last ones decide the outcome, the id and what is a duplicate."""
    rows = spark.read.parquet(f"{d}/events.parquet").where("event_id % 25 in (0, 2, 8, 16, 17)")
    body = F.expr(_REPEATED.replace("VARCHAR(20)", "STRING"))
    at = F.lit("2024-02-01T00:00:00Z").cast("timestamp")
    requests = rows.select(F.lit("POST").alias("method"), F.lit("key-of-ws-0").alias("workspace_key"), body.alias("body"), at.alias("received_at"))
    out = validate.ingest(requests, _keys(spark))
    return out.groupBy(F.coalesce("reason", F.lit("none")).alias("reason"), F.coalesce("event_id", F.lit("none")).alias("event_id"), F.coalesce(F.col("duplicate").cast("string"), F.lit("none")).alias("duplicate")).agg(F.count("*").alias("n"))


def _report_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = report.report_json(_report(spark, d))
    get = lambda p: F.get_json_object("report", p)
    return rows.select("workspace_id", get("$.metric_status").alias("metric_status"), get("$.data_sla.status").alias("sla"), get("$.commentary.status").alias("commentary"), get("$.anomaly.status").alias("anomaly"),
                       *[get(f"$.stages[{k}].users").cast("long").alias(f"users{k}") for k in range(4)], get("$.stages[2].event_name").alias("third"))


def _accepted_json(spark: SparkSession, d: str) -> DataFrame:
    """Accepted events of the HTTP outcomes, some without a field of the server's, against their contract."""
    rows = _outcomes(spark, d).where("accepted and not duplicate").select("event_id", F.col("accepted_json").alias("raw"))
    n = F.substring("event_id", 7, 30).cast("long")
    raw = F.when(n % 7 == 0, F.regexp_replace("raw", '"event_time_quality":"client_verified"', '"event_time_quality":"guessed"')).when(n % 11 == 0, F.regexp_replace("raw", '"received_at":"[^"]*",', "")).otherwise(F.col("raw"))
    return validate.accepted_violations(rows.withColumn("raw", raw)).groupBy(F.coalesce("violation", F.lit("none")).alias("violation")).agg(F.count("*").alias("n"))


def _clicks(spark: SparkSession, d: str) -> DataFrame:
    rows = _silver(spark, d)
    n = F.substring("event_id", 7, 12).cast("long")
    json = F.concat(F.lit('{"event_name":"'), F.col("event_name"), F.lit('","properties":{"ui_name":"'), F.when(n % 3 == 0, "pricing_cta").otherwise("nav_signup"), F.lit('"}}'))
    return extended.component_events(rows.withColumn("accepted_event_json", json), "pricing_cta").select("workspace_id", "event_id")


def _people(spark: SparkSession, d: str) -> DataFrame:
    """Anonymous journeys and the people they belong to, where a signup names the user."""
    user = F.when(F.col("event_name") == "signup_completed", F.concat(F.lit("user-"), F.substring("anonymous_id", 11, 8)))
    rows = extended.stitch(_silver(spark, d).withColumn("user_id", user))
    return rows.groupBy("workspace_id").agg(F.count_distinct("anonymous_id").alias("journeys"), F.count_distinct("person_id").alias("people"))


def _layers(spark: SparkSession, d: str) -> DataFrame:
    rows = _silver(spark, d).groupBy("workspace_id").agg(F.max("received_at").alias("r"), F.max("occurred_at").alias("o"))
    layers = F.array(F.struct(F.lit("collector").alias("layer"), F.col("r").alias("data_through")), F.struct(F.lit("gold").alias("layer"), F.col("o").alias("data_through")), F.struct(F.lit("serving").alias("layer"), F.lit(None).cast("timestamp_ntz").alias("data_through")))
    out = extended.layer_status(rows.select("workspace_id", F.inline(layers)), NOW)
    return out.select("workspace_id", "layer", "age_seconds", "status", "trusted")


def _rolled_back(spark: SparkSession, d: str) -> DataFrame:
    failed = F.when((F.col("snapshot_version") == "canonical-1") & (F.col("workspace_id") == "ws_1"), "failed").otherwise(F.col("data_sla_status"))
    return _serving_columns(extended.last_healthy(_snapshots(spark, d).withColumn("data_sla_status", failed)))


def _gated(spark: SparkSession, d: str) -> DataFrame:
    """Gold of the workspaces that reconcile; the Silver of one of them lacks rows."""
    short = _silver_range(spark, d).where("not (workspace_id = 'ws_2' and event_id like '%7')")
    gates = insights.quality_gates(read_events(spark, d, True, START, END, 30), short)
    return _day(extended.gate(funnel.canonical_daily(short, START, END), gates))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Events of two older schema versions in the present one's form."""
    raw = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("event_type").alias("event_name"), F.element_at(F.array(*map(F.lit, ("0.8.0", "0.9.0", "1.0.0", "7.0.0"))), (F.col("event_id") % 4 + 1).cast("int")).alias("schema_version"))
    name = F.col("event_name")
    casters = {
        "0.8.0": ("0.9.0", {"event_name": F.when(name == "view", "vpv").otherwise(name)}),
        "0.9.0": ("1.0.0", {"event_name": F.when(name == "signup", "signup_completed").otherwise(name)}),
    }
    return extended.upcast(raw, casters, "1.0.0")


def _real(spark: SparkSession, d: str) -> DataFrame:
    demo = scenarios.all_scenarios(spark).select(F.lit("ws_0").alias("workspace_id"), "event_id", F.lit(True).alias("is_synthetic"))
    rows = _silver(spark, d).select("workspace_id", "event_id", F.lit(None).cast("boolean").alias("is_synthetic")).unionByName(demo)
    return extended.real_only(rows).groupBy("workspace_id").agg(F.count("*").alias("event_count"))


def _trackers(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.when(n % 5 == 0, "http://x").when(n % 2 == 0, "/fp").otherwise("https://x").alias("endpoint"), F.when(n % 7 == 0, "short").otherwise("key-of-ws-0").alias("workspace_key"), F.when(n % 11 == 0, F.lit(None)).otherwise(F.format_string("anonymous-%09d", n)).alias("anonymous_id"))
    return extended.tracker_errors(rows).select("event_id", "error")


def _compacted(spark: SparkSession, d: str) -> DataFrame:
    root = shared(spark, "compact")
    rows = read_events(spark, d, False, START, END)
    for k in range(2):
        sinks.append_bronze(rows.where(F.crc32(F.col("event_id").cast("binary")) % 2 == k), f"{root}/bronze")
    sinks.compact_days(spark, f"{root}/bronze", START, END)
    return spark.read.parquet(f"{root}/bronze").groupBy("workspace_id", F.col("event_date").cast("string").alias("event_date")).agg(F.count("*").alias("event_count"))


def _memory(spark: SparkSession, d: str) -> DataFrame:
    rows = read_events(spark, d)
    store = sinks.SessionStore(spark, "stepwell_events", rows.schema, shared(spark, "session"))
    store.append(rows.where("event_name = 'vpv'"))
    store.append(rows)
    return _shown(store.snapshot("ws_1"))


def _exported(spark: SparkSession, d: str) -> DataFrame:
    root = shared(spark, "export")
    sinks.export(_day(funnel.unordered_daily(_silver(spark, d))), f"{root}/daily", "csv")
    return spark.read.schema("workspace_id string, event_date string, " + ", ".join(f"{s} long" for s in STAGES)).csv(f"{root}/daily", header=True).select("workspace_id", "event_date", *STAGES)


def _forgotten(spark: SparkSession, d: str) -> DataFrame:
    rows = _silver_range(spark, d)
    subjects = rows.where("anonymous_id like '%1-00%'").select("workspace_id", "anonymous_id").distinct()
    return _day(funnel.canonical_daily(rebuild.delete_subject(rows, subjects), START, END))


def _late(spark: SparkSession, d: str) -> DataFrame:
    rows = bronze.with_lateness(_silver(spark, d), "2024-01-20 00:00:00")
    return rows.groupBy("workspace_id").agg(F.count("*").alias("event_count"), F.count_if("is_late").alias("late"))


def queries() -> dict[str, Query]:
    return {
        "stream_to_gold": lambda s, d: _serving_columns(_stream_to_gold(s, d)),
        "hourly_run": lambda s, d: _day(_hourly(s, d)),
        "publish_snapshot": lambda s, d: _serving_columns(_published(s, d)),
        "stream_counters": _counted,
        "stream_first_seen": lambda s, d: _first_seen(s, d),
        "stream_replay": _replayed,
        "stream_lateness": _late,
        "provisional_windows": lambda s, d: bronze.provisional_counts(_silver(s, d), "6 hours").withColumn("window_start", stamp("window_start")),
        "http_outcomes": lambda s, d: _outcomes(s, d).groupBy("workspace_id", "status", F.coalesce("reason", F.lit("none")).alias("reason"), F.coalesce(F.col("duplicate").cast("string"), F.lit("none")).alias("duplicate")).agg(F.count("*").alias("n")),
        "http_accepted_json": lambda s, d: _outcomes(s, d).where("accepted").select("event_id", F.substring_index("accepted_json", '"consent"', -1).alias("tail"), "duplicate"),
        "event_contract": _accepted_json,
        "repeated_keys": _repeated_keys,
        "event_time_outcomes": lambda s, d: validate.event_time(_raws(s, d).drop("reason", "event_time_quality")).select("event_id", "outcome", F.coalesce("event_time_quality", F.lit("none")).alias("quality")),
        "report_json": _report_fields,
        "component_clicks": _clicks,
        "identity_stitching": _people,
        "layer_status": _layers,
        "serving_rollback": _rolled_back,
        "gold_gated": _gated,
        "weekday_baseline": lambda s, d: extended.weekday_baseline(report.daily_subscriptions(_silver(s, d))),
        "schema_upcast": _versions,
        "real_events_only": _real,
        "tracker_errors": _trackers,
        "bronze_compaction": _compacted,
        "memory_store": _memory,
        "export_csv": _exported,
        "subject_deletion": _forgotten,
    }


def oracle_sql() -> dict[str, str]:
    good = f"{_W}, {_REC}, {_GOOD}"
    snap = "'canonical-1' AS snapshot_version, '2024-02-01 00:00:00.000000' AS canonical_completed_at, 'healthy' AS data_sla_status"
    inside = f"occurred_at >= DATE '{START}' AND occurred_at < DATE '{END}' + INTERVAL 1 DAY"
    hour = lambda day, low: f"{_daily('(' + _firsts('silver', f'''occurred_at >= DATE '{low}' AND occurred_at < DATE '{day}' + INTERVAL 1 DAY''') + ')', _PAIRS, f'''d = DATE '{day}' ''')}"
    request = ", ".join(f"{v} AS {k}" for k, v in _REQUEST.items())
    http = f"""{VALIDATE.strip()},
req AS (SELECT event_id, user_id, nth, {request} FROM events, (SELECT unnest([0, 1]) AS nth) WHERE nth = 0 OR event_id % 10 = 0),
outcome AS (
  SELECT req.event_id, nth, CASE WHEN workspace_key LIKE 'key-of-ws-%' THEN 'ws_' || (user_id % 4) END AS workspace_id,
    CASE WHEN method <> 'POST' THEN 405 WHEN workspace_key NOT LIKE 'key-of-ws-%' THEN 401 WHEN length(body) > {MAX_BODY_BYTES} THEN 413 WHEN reason = 'invalid_json' THEN 400 WHEN reason IS NOT NULL THEN 422 ELSE 202 END AS status, reason
  FROM req JOIN checked USING (event_id)),
ans AS (
  SELECT *, CASE status WHEN 405 THEN 'method_not_allowed' WHEN 401 THEN 'invalid_workspace_key' WHEN 413 THEN 'payload_too_large' WHEN 202 THEN 'none' ELSE reason END AS why,
    CASE WHEN status <> 202 THEN 'none' WHEN nth = 1 THEN 'true' ELSE 'false' END AS dup FROM outcome)"""
    short = "short AS (SELECT * FROM silver WHERE NOT (workspace_id = 'ws_2' AND event_id LIKE '%7'))"
    tail = "':{\"analytics\":true},\"received_at\":\"2024-02-01T00:00:0' || (nth * 3) || 'Z\",\"event_time_quality\":\"client_verified\"}'"
    return {
        "stream_to_gold": f"{good}, f AS ({_firsts('good', inside)}), g AS ({_daily('f', _PAIRS, f'''d BETWEEN DATE '{START}' AND DATE '{END}' ''')}) SELECT *, {snap} FROM g",
        "hourly_run": f"{_W}, a AS ({hour(START, START)}), b AS ({hour('2024-01-11', START)}) SELECT workspace_id, event_date, stage_name, unique_users, 'hourly-2' AS snapshot_version FROM (SELECT * FROM a UNION ALL SELECT * FROM b)",
        "publish_snapshot": f"{_SNAP} SELECT * FROM snaps WHERE snapshot_version = 'airflow-2' AND event_date = '{START}'",
        "stream_counters": f"{_W}, {_REC}, twice AS (SELECT * FROM rec UNION ALL SELECT * FROM rec WHERE id % 20 = 0) SELECT count(*) AS polled, count(*) FILTER (NOT bad AND NOT wrong) AS materialized, count(*) FILTER (bad OR wrong) AS dead_lettered FROM twice",
        "stream_first_seen": f"{good} SELECT workspace_id, event_id, anonymous_id, event_name FROM good",
        "stream_replay": f"{_W} SELECT {_ROW} FROM silver WHERE event_name <> 'click'",
        "stream_lateness": f"{_W} SELECT workspace_id, count(*) AS event_count, count(*) FILTER (occurred_at < TIMESTAMP '2024-01-19 22:00:00') AS late FROM silver GROUP BY ALL",
        "provisional_windows": f"{_W} SELECT workspace_id, event_name, strftime(time_bucket(INTERVAL 6 HOUR, occurred_at, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M:%S.%f') AS window_start, count(*) AS event_count, count(DISTINCT anonymous_id) AS users FROM silver GROUP BY ALL",
        "http_outcomes": f"WITH {http} SELECT workspace_id, status, why AS reason, dup AS duplicate, count(*) AS n FROM ans GROUP BY ALL",
        "http_accepted_json": f"WITH {http} SELECT 'event-0000000000' || event_id AS event_id, {tail} AS tail, nth = 1 AS duplicate FROM ans WHERE status = 202",
        "repeated_keys": f"""WITH b AS (SELECT event_id % 25 AS defect, {_REPEATED} AS raw FROM events WHERE event_id % 25 IN (0, 2, 8, 16, 17)),
l AS (SELECT defect, raw, regexp_extract_all(raw, '"properties":(\\{{[^}}]*\\}})', 1)[-1] AS p, regexp_extract_all(raw, '"consent":(\\{{[^}}]*\\}})', 1)[-1] AS c, regexp_extract_all(raw, '"event_id":"([^"]*)"', 1)[-1] AS id FROM b),
r AS (SELECT id, CASE WHEN defect = 2 THEN 'unallowed_envelope_field' WHEN length(id) < 16 THEN 'invalid_identifier' WHEN c <> '{{"analytics":true}}' THEN 'invalid_context_or_consent'
  WHEN json_keys(p)[1] = 'email' THEN 'sensitive_property' WHEN json_keys(p)[1] = 'colour' THEN 'unallowed_property' WHEN list_contains(json_keys(p), 'colour') THEN 'unallowed_property' WHEN list_contains(json_keys(p), 'email') THEN 'sensitive_property'
  ELSE 'none' END AS reason FROM l),
k AS (SELECT reason, CASE WHEN reason = 'none' THEN id ELSE 'none' END AS event_id, CASE WHEN reason <> 'none' THEN 'none' WHEN row_number() OVER (PARTITION BY reason, id) > 1 THEN 'true' ELSE 'false' END AS duplicate FROM r)
SELECT reason, event_id, duplicate, count(*) AS n FROM k GROUP BY ALL""",
        "event_contract": f"WITH {http} SELECT CASE WHEN event_id % 7 = 0 THEN 'invalid_event_time_quality' WHEN event_id % 11 = 0 THEN 'invalid_received_at' ELSE 'none' END AS violation, count(*) AS n FROM ans WHERE status = 202 AND nth = 0 GROUP BY ALL",
        "event_time_outcomes": f"WITH {VALIDATE} SELECT event_id, CASE WHEN reason IS NULL THEN 'accepted' WHEN reason IN ('missing_occurred_at', 'invalid_event_time') THEN 'quarantined' ELSE 'rejected' END AS outcome, CASE WHEN reason IS NULL THEN 'client_verified' WHEN reason IN ('missing_occurred_at', 'invalid_event_time') THEN 'quarantined' ELSE 'none' END AS quality FROM checked",
        "report_json": f"""{_W}, {_STRICT}, {_DAILY_SUBS} SELECT k.workspace_id, 'local_provisional' AS metric_status, sla_status AS sla,
  CASE WHEN sla_status <> 'healthy' THEN 'suppressed_data_sla_unhealthy' WHEN u0 = 0 THEN 'insufficient_volume' ELSE 'informational' END AS commentary,
  CASE WHEN sla_status <> 'healthy' THEN 'suppressed_data_sla_unhealthy' ELSE anomaly_status END AS anomaly, u0 AS users0, u1 AS users1, u2 AS users2, u3 AS users3, 'activation_completed' AS third
  FROM k JOIN fresh USING (workspace_id) JOIN st USING (workspace_id)""",
        "component_clicks": f"{_W} SELECT workspace_id, event_id FROM silver WHERE event_name = 'click' AND id % 3 = 0",
        "identity_stitching": f"{_W}, l AS (SELECT DISTINCT workspace_id, anonymous_id FROM silver WHERE event_name = 'signup_completed') SELECT s.workspace_id, count(DISTINCT s.anonymous_id) AS journeys, count(DISTINCT CASE WHEN l.anonymous_id IS NULL THEN s.anonymous_id ELSE substr(s.anonymous_id, 11, 8) END) AS people FROM silver s LEFT JOIN l USING (workspace_id, anonymous_id) GROUP BY ALL",
        "layer_status": f"""{_W}, m AS (SELECT workspace_id, epoch_us(TIMESTAMP '{NOW}') AS n, epoch_us(max(received_at)) AS r, epoch_us(max(occurred_at)) AS o FROM silver GROUP BY ALL),
x AS (SELECT workspace_id, 'collector' AS layer, CAST(greatest(0, floor((n - r) / 1e6)) AS BIGINT) AS age_seconds, 300 AS lim FROM m UNION ALL SELECT workspace_id, 'gold', CAST(greatest(0, floor((n - o) / 1e6)) AS BIGINT), 5400 FROM m UNION ALL SELECT workspace_id, 'serving', NULL, 5400 FROM m)
SELECT workspace_id, layer, CASE WHEN layer = 'serving' THEN 0 ELSE age_seconds END AS age_seconds, CASE WHEN layer = 'serving' THEN 'no_data' WHEN age_seconds <= lim THEN 'healthy' ELSE 'stale' END AS status, false AS trusted FROM x""",
        "serving_rollback": f"{_SNAP} SELECT * FROM snaps WHERE NOT (snapshot_version = 'canonical-1' AND workspace_id = 'ws_1') QUALIFY row_number() OVER (PARTITION BY workspace_id, event_date, funnel_definition_version, stage_name ORDER BY snapshot_version DESC) = 1",
        "gold_gated": f"{_W}, {short}, f AS ({_firsts('short', _range(30))}), g AS ({_daily('f', _PAIRS, f'''d BETWEEN DATE '{START}' AND DATE '{END}' ''')}) SELECT * FROM g WHERE workspace_id <> 'ws_2'",
        "weekday_baseline": f"""{_W}, ds AS (SELECT workspace_id, CAST(occurred_at AS DATE) AS d, count(DISTINCT anonymous_id) FILTER (event_name = 'subscription_started') AS users FROM silver GROUP BY ALL),
w AS (SELECT *, max(d) OVER (PARTITION BY workspace_id) AS last FROM ds), x AS (SELECT * FROM w WHERE (last - d) % 7 = 0 AND last - d <= 28),
md AS (SELECT workspace_id, count(*) AS n, median(users) AS med FROM x WHERE d < last GROUP BY ALL),
ad AS (SELECT workspace_id, median(abs(users - med)) AS mad FROM x JOIN md USING (workspace_id) WHERE d < last GROUP BY ALL)
SELECT workspace_id, CAST(users AS DOUBLE) AS current_value, coalesce(n, 0) AS baseline_points, floor(med * 10000 + 0.5) / 10000 AS baseline_median, floor(mad * 10000 + 0.5) / 10000 AS median_absolute_deviation,
  CASE WHEN coalesce(n, 0) < 3 THEN 'insufficient_history' WHEN mad = 0 THEN 'insufficient_variation' WHEN abs(0.6745::DOUBLE * (users - med) / mad) >= 3.5 THEN 'anomaly' ELSE 'normal' END AS anomaly_status
FROM x LEFT JOIN md USING (workspace_id) LEFT JOIN ad USING (workspace_id) WHERE d = last""",
        "schema_upcast": """SELECT event_id, CASE WHEN event_id % 4 = 0 AND event_type = 'view' THEN 'vpv' WHEN event_id % 4 < 2 AND event_type = 'signup' THEN 'signup_completed' ELSE event_type END AS event_name,
  CASE WHEN event_id % 4 = 3 THEN '7.0.0' ELSE '1.0.0' END AS schema_version, CASE event_id % 4 WHEN 0 THEN '0.8.0' WHEN 1 THEN '0.9.0' WHEN 2 THEN '1.0.0' ELSE '7.0.0' END AS source_version, CASE WHEN event_id % 4 < 3 THEN '1.0.0' END AS transformation_version FROM events""",
        "real_events_only": f"{_W} SELECT workspace_id, count(*) AS event_count FROM silver GROUP BY ALL",
        "tracker_errors": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'endpoint' WHEN event_id % 7 = 0 THEN 'workspace_key' WHEN event_id % 11 = 0 THEN 'anonymous_id' END AS error FROM events",
        "bronze_compaction": f"{_W} SELECT workspace_id, CAST(CAST(occurred_at AS DATE) AS VARCHAR) AS event_date, count(*) AS event_count FROM base WHERE occurred_at >= DATE '{START}' - INTERVAL 1 DAY AND occurred_at < DATE '{END}' + INTERVAL 2 DAY GROUP BY ALL",
        "memory_store": f"{_W} SELECT {_ROW} FROM silver WHERE workspace_id = 'ws_1'",
        "export_csv": f"{_W} SELECT workspace_id, CAST(CAST(occurred_at AS DATE) AS VARCHAR) AS event_date, " + ", ".join(f"count(DISTINCT anonymous_id) FILTER (event_name = '{s}') AS {s}" for s in STAGES) + f" FROM silver WHERE event_name IN ({_IN}) GROUP BY ALL",
        "subject_deletion": f"{_W}, f AS ({_firsts('silver', _range(30) + ''' AND anonymous_id NOT LIKE '%1-00%' ''')}) {_daily('f', _PAIRS, f'''d BETWEEN DATE '{START}' AND DATE '{END}' ''')}",
    }
