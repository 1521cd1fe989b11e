"""Queries of late days, deletion, quality gates and identities over chains, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import STAGES, TOPIC, partition_key, stamp
from ..operators import dedupe, funnel, gates, identity, metrics, serving
from ..operators.validate import last_value
from ..sources import buckets, sinks
from ..sources.events import read_events
from ..streaming import bronze, replay, windows
from . import erasure, rebuild
from .queries import _PAIRS, _REC, BRONZE, END, START, Query, _daily, _day, _firsts, _gold_sql, _records, _silver, shared

_W = f"WITH {BRONZE}"
FIRST, LAST, COMPLETED = "2024-01-01", "2024-01-30", "2024-02-01 00:00:00"
LATE_DAYS = ("2024-01-05", "2024-01-20")


def _n() -> Column:
    """The number in an event's id."""
    return F.substring("event_id", 7, 12).cast("long")


def _served(df: DataFrame) -> DataFrame:
    return _day(df).select("workspace_id", "event_date", "stage_name", "unique_users", "snapshot_version")


def _late_days(spark: SparkSession, d: str) -> DataFrame:
    """Gold after a first stream of events and its rebuild, then a stream of late ones and the rebuild of their days."""
    root, rows = shared(spark, "late"), read_events(spark, d)
    late = F.to_date("occurred_at").cast("string").isin(*LATE_DAYS) & (_n() % 5 == 2)
    paths = [f"{root}/{n}" for n in ("bronze", "silver", "gold", "served", "touched", "done")]
    for k, some in enumerate((rows.where(~late), rows.where(late)), 1):
        bronze.to_records(some).write.mode("append").json(f"{root}/log")
        bronze.ingest_stream(bronze.read_records(spark, f"{root}/log"), paths[0], f"{root}/dead", f"{root}/checkpoint", touched=paths[4])
        rebuild.rebuild_touched(spark, *paths, f"late-{k}", COMPLETED, 3)
    return _served(spark.read.parquet(paths[2]))


def _erased(spark: SparkSession, d: str) -> DataFrame:
    """Gold after some subjects were deleted; only the days that look back on theirs are of the new version."""
    root = shared(spark, "erase")
    layers = erasure.Layers(*[f"{root}/{n}" for n in ("bronze", "silver", "gold", "served", "index", "markers", "audit")])
    rows = read_events(spark, d, False)
    sinks.append_bronze(rows, layers.bronze)
    days = sinks.days_of(spark, layers.bronze)
    rebuild.rebuild_days(spark, layers.bronze, layers.silver, layers.gold, days, "erase-1", COMPLETED, 2, near_days=0)
    erasure.index_days(spark, layers)
    subjects = rows.where("anonymous_id like '%1-003'").select(*erasure.SUBJECT)
    erasure.erase(spark, layers, subjects, "r1", "erase-2", COMPLETED, 2)
    return _served(spark.read.parquet(layers.gold))


def _people(spark: SparkSession, d: str) -> DataFrame:
    """Bronze after a first stream, the deletion of some users' people, and a second stream with more events of them."""
    root = shared(spark, "people")
    layers = erasure.Layers(*[f"{root}/{n}" for n in ("bronze", "silver", "gold", "served", "index", "markers", "audit")])
    rows = read_events(spark, d, False).withColumns({"id": _n(), "u": F.substring("anonymous_id", 11, 8).cast("long")})
    rows = rows.withColumn("user_id", F.expr(_USER.replace("VARCHAR(20)", "STRING")))

    def stream(some: DataFrame) -> None:
        bronze.to_records(some).write.mode("append").json(f"{root}/log")
        bronze.ingest_stream(bronze.read_records(spark, f"{root}/log"), layers.bronze, f"{root}/dead", f"{root}/checkpoint", markers=layers.markers, index=layers.index)

    stream(rows.where("id % 5 <> 2"))
    rebuild.rebuild_days(spark, layers.bronze, layers.silver, layers.gold, sinks.days_of(spark, layers.bronze), "people-1", COMPLETED, 2, near_days=0)
    named = F.inline(F.array(F.struct(last_value("accepted_event_json", "user_id").alias("user_id"))))  # a generator of one row: the filter below does not read the text again
    spark.read.parquet(layers.bronze).select(*erasure.SUBJECT, named).where("user_id is not null").distinct().write.parquet(f"{root}/pairs")  # once, not for each use
    pairs = spark.read.parquet(f"{root}/pairs")
    gone = erasure.subjects_of_people(pairs, pairs.where("user_id like '%3'"), f"{root}/links")
    erasure.erase(spark, layers, gone, "p1", "people-2", COMPLETED, 2)
    stream(rows.where("id % 5 = 2"))
    return spark.read.parquet(layers.bronze).select("workspace_id", "event_id", "anonymous_id", "event_name")


CUT, HOURS = "2024-01-20", 24


def _windows(spark: SparkSession, d: str, out: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """Two runs of the windowed stream: events before a day, then those from it on and a fifth of the earlier ones."""
    root, rows = shared(spark, "windows"), read_events(spark, d, False)
    first = (F.col("occurred_at") < F.lit(CUT).cast("timestamp_ntz")) & (_n() % 5 != 2)
    for some in (rows.where(first), rows.where(~first)):
        bronze.to_records(some).write.mode("append").json(f"{root}/log")
        good = bronze.split(bronze.read_records(spark, f"{root}/log", 10_000))[0]
        windows.run_windows(good, f"{root}/windows", f"{root}/checkpoint", HOURS * 60, shards=2)
    return out(spark, f"{root}/windows")


#: A day of one workspace for each gate to fail.
FAULTS = {"volume": "2024-01-09", "duplicates": "2024-01-11", "nulls": "2024-01-13", "freshness": "2024-01-17", "reconciliation": "2024-01-19"}
LIMITS = gates.Limits(order=0.97)


def _faulty(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bronze, Silver and Gold with those faults; journeys of the days 13 to 15 have nothing before their subscription, so no stage is in order."""
    one, day = F.col("workspace_id") == "ws_1", F.col("event_date").cast("string")
    on = lambda gate: one & (day == FAULTS[gate])
    rows = read_events(spark, d, False).withColumn("event_date", F.to_date("occurred_at"))
    rows = rows.where(~(on("volume") & (_n() % 5 != 0)))
    rows = rows.withColumn("event_name", F.when(one & F.col("anonymous_id").endswith("-004") & (F.col("event_name") != "subscription_started"), "click").otherwise(F.col("event_name")))
    rows = rows.withColumn("anonymous_id", F.when(on("nulls") & (_n() % 4 == 0), " ").otherwise(F.col("anonymous_id")))
    rows = rows.withColumn("received_at", F.when(on("freshness") & (_n() % 3 == 0), F.expr("received_at + interval 2 hours")).otherwise(F.col("received_at")))
    copies = F.explode(F.when(on("duplicates"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    layer = rows.withColumn("_nth", copies).drop("_nth")
    silver = dedupe.silver(layer).where(~(on("reconciliation") & (_n() % 3 == 0)))
    gold = funnel.canonical_daily(silver.drop("event_date"), FIRST, LAST)
    return layer, silver, gold


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return gates.judge_days(gates.day_metrics(*_faulty(spark, d)), LIMITS)


def _day_gates(spark: SparkSession, d: str) -> DataFrame:
    rows = _day(_judged(spark, d))
    return rows.select("workspace_id", "event_date", "bronze_rows", "bronze_events", "silver_rows", "late_rows", "reached", "misplaced", F.col("nulls.anonymous_id").alias("null_ids"), F.concat_ws(",", "failed").alias("failed"))


def _gated_days(spark: SparkSession, d: str) -> DataFrame:
    """The current view where a new snapshot was published for the days that passed: the others keep the older one."""
    layer, silver, gold = _faulty(spark, d)
    judged = gates.judge_days(gates.day_metrics(layer, silver, gold), LIMITS)
    root = shared(spark, "gated")
    for version, rows in (("v1", gold), ("v2", gates.passing(gold, judged))):
        serving.snapshot(rows, version, COMPLETED).write.mode("append").parquet(f"{root}/served")
    return _served(serving.current(spark.read.parquet(f"{root}/served")))


_USER = """CASE WHEN u % 10 = 7 AND id % 4 = 0 THEN NULL WHEN u % 10 = 7 THEN 'user-' || CAST(100000 + 100 * u + id % 9 AS VARCHAR(20)) WHEN event_name = 'signup_completed' THEN 'user-' || CAST(u AS VARCHAR(20))
 WHEN event_name = 'subscription_started' AND floor(u / 4) % 3 <> 2 THEN 'user-' || CAST(u + 4 AS VARCHAR(20)) END"""


def _chains(spark: SparkSession, d: str) -> DataFrame:
    """Who each pair of ids is: users who also pay for the next one's account, devices that many use, and blank ids."""
    rows = read_events(spark, d, False).withColumns({"id": _n(), "u": F.substring("anonymous_id", 11, 8).cast("long")})
    rows = rows.withColumns({"user_id": F.expr(_USER.replace("VARCHAR(20)", "STRING")), "anonymous_id": F.when(F.col("id") % 97 == 5, " ").otherwise(F.col("anonymous_id"))})
    out = identity.stitch_chains(rows.select("workspace_id", "anonymous_id", "user_id"), shared(spark, "identity"))
    return out.groupBy("workspace_id", "anonymous_id", F.coalesce("user_id", F.lit("none")).alias("user_id"), F.coalesce("person_id", F.lit("none")).alias("person_id"), "identity").agg(F.count("*").alias("event_count"))


def _replayed_letters(spark: SparkSession, d: str, out: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """Two replays of the stream's dead letters: records under a wrong topic or key are mended, texts that are no JSON are not."""
    root, rows = shared(spark, "letters"), _records(spark, d)
    rows.write.json(f"{root}/log")
    bronze.ingest_stream(bronze.read_records(spark, f"{root}/log"), f"{root}/bronze", f"{root}/dead", f"{root}/checkpoint")
    log, dead = spark.read.schema(bronze.RECORD).json(f"{root}/log"), spark.read.schema(bronze.DEAD_LETTER).json(f"{root}/dead")

    def mended(records: DataFrame) -> DataFrame:
        text = lambda p: F.get_json_object("value", p)
        return records.withColumns({"topic": F.lit(TOPIC), "key": partition_key(text("$.workspace_id"), text("$.event.anonymous_id"))})

    for name, reason in (("keys", "invalid_topic_or_partition_key"), ("texts", "invalid_event_envelope")):
        replay.replay_letters(spark, name, log, dead.where(F.col("reason") == reason), mended, f"{root}/bronze", f"{root}/staging", f"{root}/audit")
    return out(spark, root)


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    """The last day against the week before: one workspace sells more, one loses events, one has few."""
    ws, last = F.col("workspace_id"), F.to_date("occurred_at") == F.lit(LAST).cast("date")
    rows = _silver(spark, d).where(~((ws == "ws_2") & last & (_n() % 10 != 0)) & ~((ws == "ws_3") & (_n() % 20 != 3)))
    sold = (ws.isin("ws_1", "ws_2", "ws_3")) & last & (F.col("event_name") != "vpv")
    rows = rows.withColumn("event_name", F.when(sold, "subscription_started").otherwise(F.col("event_name")))
    return metrics.metric_anomalies(metrics.daily_metrics(rows), 5.0)


def queries() -> dict[str, Query]:
    return {
        "late_day_rebuild": _late_days,
        "subject_erasure": _erased,
        "person_erasure": _people,
        "day_gates": _day_gates,
        "day_gates_publish": _gated_days,
        "identity_chains": _chains,
        "stream_windows": lambda s, d: _windows(s, d, windows.closed_windows).withColumn("window_start", stamp("window_start")),
        "dead_letter_replay": lambda s, d: _replayed_letters(s, d, lambda s, r: s.read.parquet(f"{r}/bronze").select("workspace_id", "event_id", "event_name")),
        "dead_letter_audit": lambda s, d: _replayed_letters(s, d, lambda s, r: replay.replays(s, f"{r}/audit")),
        "metric_anomalies": _metrics,
        "gold_bucketed": lambda s, d: _day(buckets.bucketed_gold(s, read_events(s, d, True, START, END, 30), shared(s, "buckets"), f"b{uuid.uuid4().hex}", START, END)),
        "stream_late_events": lambda s, d: _windows(s, d, windows.late_events).withColumn("occurred_at", stamp("occurred_at")),
    }


def _per_day(source: str, lookback: int) -> str:
    """Daily Gold where every day looks back for itself, as CTEs ending in g."""
    return f"""days AS (SELECT CAST(unnest(generate_series(DATE '{FIRST}' - INTERVAL 1 DAY, DATE '{LAST}', INTERVAL 1 DAY)) AS DATE) AS target),
x AS (SELECT s.*, target FROM {source} s JOIN days ON occurred_at >= target - INTERVAL {lookback} DAY AND occurred_at < target + INTERVAL 1 DAY), f AS ({_firsts('x', 'true', ', target')}),
g AS ({_daily('f', _PAIRS, 'd = target', ', target')})""".replace("GROUP BY ALL)", "GROUP BY workspace_id, d, v, stage_name)")


def oracle_sql() -> dict[str, str]:
    on = lambda gate: f"(workspace_id = 'ws_1' AND CAST(occurred_at AS DATE) = DATE '{FAULTS[gate]}')"
    faulty = f"""{_W},
fa AS (SELECT workspace_id, event_id, CASE WHEN {on("nulls")} AND id % 4 = 0 THEN ' ' ELSE anonymous_id END AS anonymous_id,
  CASE WHEN workspace_id = 'ws_1' AND anonymous_id LIKE '%-004' AND event_name <> 'subscription_started' THEN 'click' ELSE event_name END AS event_name, occurred_at,
  received_at + CASE WHEN {on("freshness")} AND id % 3 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS received_at, v, id FROM base WHERE NOT ({on("volume")} AND id % 5 <> 0)),
fb AS (SELECT * FROM fa UNION ALL SELECT * FROM fa WHERE {on("duplicates")}),
fs AS (SELECT * FROM fa WHERE NOT ({on("reconciliation")} AND id % 3 = 0)),
f AS ({_firsts("fs")}),
go AS ({_daily("f", _PAIRS)}),
b AS (SELECT workspace_id, CAST(occurred_at AS DATE) AS d, count(*) AS bronze_rows, count(DISTINCT event_id) AS bronze_events, count(*) FILTER (received_at > occurred_at + INTERVAL 1 HOUR) AS late_rows,
  count(*) FILTER (trim(anonymous_id) = '') / count(*) AS null_ids FROM fb GROUP BY ALL),
s AS (SELECT workspace_id, CAST(occurred_at AS DATE) AS d, count(*) AS silver_rows FROM fs GROUP BY ALL),
o1 AS ({" UNION ALL ".join(f"SELECT workspace_id, CAST(t{k} AS DATE) AS d, coalesce(t{k - 1} > t{k}, true) AS wrong FROM f WHERE t{k} IS NOT NULL" for k in (1, 2, 3))}),
o AS (SELECT workspace_id, d, count(*) AS reached, count(*) FILTER (wrong) AS misplaced FROM o1 GROUP BY ALL),
m AS (SELECT b.*, coalesce(silver_rows, 0) AS silver_rows, coalesce(reached, 0) AS reached, coalesce(misplaced, 0) AS misplaced,
  median(bronze_events) OVER w AS usual, count(*) OVER w AS n FROM b LEFT JOIN s USING (workspace_id, d) LEFT JOIN o USING (workspace_id, d)
  WINDOW w AS (PARTITION BY workspace_id ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
j AS (SELECT *, concat_ws(',', CASE WHEN n >= 3 AND bronze_events < usual * 0.5 THEN 'volume' END, CASE WHEN (bronze_rows - bronze_events) / bronze_rows > 0.2 THEN 'duplicates' END,
  CASE WHEN null_ids > 0.01 THEN 'nulls' END, CASE WHEN misplaced / nullif(reached, 0) > 0.97 THEN 'order' END, CASE WHEN late_rows / bronze_rows > 0.05 THEN 'freshness' END,
  CASE WHEN bronze_events <> silver_rows THEN 'reconciliation' END) AS failed FROM m)"""
    stream = f"""{_W}, r AS (SELECT *, occurred_at < DATE '{CUT}' AND id % 5 <> 2 AS early, time_bucket(INTERVAL {HOURS} HOUR, occurred_at, TIMESTAMP '2024-01-01') AS w FROM base),
wm AS (SELECT max(occurred_at) FILTER (early) - INTERVAL 2 HOUR AS one, max(occurred_at) - INTERVAL 2 HOUR AS two FROM r), c AS (SELECT r.*, w + INTERVAL {HOURS} HOUR AS e, one, two FROM r, wm)"""
    late = " OR ".join(f"CAST(event_date AS DATE) BETWEEN DATE '{day}' - INTERVAL 1 DAY AND DATE '{day}' + INTERVAL 4 DAY" for day in LATE_DAYS)
    return {
        "late_day_rebuild": f"{_W}, {_per_day('silver', 3)} SELECT workspace_id, event_date, stage_name, unique_users, CASE WHEN {late} THEN 'late-2' ELSE 'late-1' END AS snapshot_version FROM g",
        "subject_erasure": f"""{_W}, kept AS (SELECT * FROM base WHERE anonymous_id NOT LIKE '%1-003'), gone AS (SELECT DISTINCT CAST(occurred_at AS DATE) AS day FROM base WHERE anonymous_id LIKE '%1-003'), {_per_day('kept', 2)}
SELECT workspace_id, event_date, stage_name, unique_users, CASE WHEN EXISTS (SELECT 1 FROM gone WHERE CAST(event_date AS DATE) BETWEEN day AND day + INTERVAL 2 DAY) THEN 'erase-2' ELSE 'erase-1' END AS snapshot_version FROM g""",
        "day_gates": f"{faulty} SELECT workspace_id, CAST(d AS VARCHAR) AS event_date, bronze_rows, bronze_events, silver_rows, late_rows, reached, misplaced, null_ids, failed FROM j",
        "day_gates_publish": f"{faulty} SELECT go.workspace_id, event_date, stage_name, unique_users, CASE WHEN failed = '' THEN 'v2' ELSE 'v1' END AS snapshot_version FROM go JOIN j ON go.workspace_id = j.workspace_id AND event_date = CAST(d AS VARCHAR)",
        "dead_letter_replay": f"{_W}, {_REC} SELECT workspace_id, event_id, event_name FROM rec WHERE NOT bad",
        "dead_letter_audit": f"""{_W}, {_REC} SELECT 'keys' AS replay_id, 'promoted' AS outcome, count(*) AS letters, count(*) AS found, count(*) AS good, count(*) AS events FROM rec WHERE wrong AND NOT bad
UNION ALL SELECT 'texts', 'refused', count(*), count(*), 0, 0 FROM rec WHERE bad""",
        "metric_anomalies": f"""{_W}, k AS (SELECT *, CAST(occurred_at AS DATE) AS d FROM silver WHERE NOT (workspace_id = 'ws_2' AND CAST(occurred_at AS DATE) = DATE '{LAST}' AND id % 10 <> 0) AND NOT (workspace_id = 'ws_3' AND id % 20 <> 3)),
e AS (SELECT workspace_id, d, anonymous_id AS a, CASE WHEN workspace_id <> 'ws_0' AND d = DATE '{LAST}' AND event_name <> 'vpv' THEN 'subscription_started' ELSE event_name END AS n, received_at > occurred_at + INTERVAL 1 HOUR AS late FROM k),
m AS (SELECT workspace_id, d, 'event_count' AS measure, 'data' AS kind, count(*) AS v FROM e GROUP BY ALL UNION ALL SELECT workspace_id, d, 'late_events', 'data', count(*) FILTER (late) FROM e GROUP BY ALL
  UNION ALL {" UNION ALL ".join(f"SELECT workspace_id, d, '{s}', 'business', count(DISTINCT a) FILTER (n = '{s}') FROM e GROUP BY ALL" for s in STAGES)}),
r AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, measure ORDER BY d DESC) AS rank FROM m),
md AS (SELECT workspace_id, measure, median(v) AS med, count(*) AS n FROM r WHERE rank BETWEEN 2 AND 8 GROUP BY ALL),
ad AS (SELECT workspace_id, measure, median(abs(v - med)) AS mad FROM r JOIN md USING (workspace_id, measure) WHERE rank BETWEEN 2 AND 8 GROUP BY ALL),
z AS (SELECT r.*, coalesce(n, 0) AS n, CAST(med AS DOUBLE) AS med, mad, 0.6745::DOUBLE * (v - med) / nullif(mad, 0) AS z FROM r LEFT JOIN md USING (workspace_id, measure) LEFT JOIN ad USING (workspace_id, measure) WHERE rank = 1),
s AS (SELECT *, CASE WHEN n < 7 THEN 'insufficient_history' WHEN mad = 0 THEN 'insufficient_variation' WHEN abs(z) >= 3.5 THEN 'anomaly' ELSE 'normal' END AS st FROM z),
w AS (SELECT *, max(CASE WHEN measure = 'event_count' AND n >= 7 THEN floor(med * 10000 + 0.5) / 10000 END) OVER (PARTITION BY workspace_id) AS usual, bool_or(kind = 'data' AND st = 'anomaly') OVER (PARTITION BY workspace_id) AS incident FROM s)
SELECT workspace_id, measure, kind, CASE WHEN usual < 5 THEN 'insufficient_volume' WHEN st = 'anomaly' THEN CASE WHEN kind = 'data' THEN 'data_anomaly' WHEN incident THEN 'suppressed_data_anomaly' ELSE 'business_anomaly' END ELSE st END AS status,
  CAST(d AS VARCHAR) AS as_of_event_date, CAST(v AS DOUBLE) AS current_value, n AS baseline_points, CASE WHEN st IN ('insufficient_variation', 'normal', 'anomaly') THEN floor(med * 10000 + 0.5) / 10000 END AS baseline_median,
  CASE WHEN st IN ('normal', 'anomaly') THEN floor(z * 10000 + 0.5) / 10000 END AS robust_z_score FROM w""",
        "gold_bucketed": _gold_sql(30),
        "stream_windows": f"{stream} SELECT workspace_id, event_name, strftime(w, '%Y-%m-%d %H:%M:%S.%f') AS window_start, count(*) AS event_count, count(DISTINCT anonymous_id) AS users FROM c WHERE e <= two AND (early OR e > one) GROUP BY ALL",
        "stream_late_events": f"{stream} SELECT workspace_id, event_id, event_name, strftime(occurred_at, '%Y-%m-%d %H:%M:%S.%f') AS occurred_at FROM c WHERE NOT early AND e <= one",
        "person_erasure": f"""WITH RECURSIVE {BRONZE},
n0 AS (SELECT *, CAST(substr(anonymous_id, 11, 8) AS BIGINT) AS u FROM base),
e AS (SELECT workspace_id AS w, event_id, event_name, anonymous_id AS a, id, {_USER} AS user_id FROM n0),
l AS (SELECT DISTINCT w, a, user_id FROM e WHERE user_id IS NOT NULL AND id % 5 <> 2), c AS (SELECT w, a, count(*) AS n FROM l GROUP BY ALL),
k AS (SELECT w, '0' || user_id AS x, '1' || a AS y FROM l JOIN c USING (w, a) WHERE n <= {identity.SHARED_BEYOND}),
b AS (SELECT w, x, y FROM k UNION SELECT w, y, x FROM k),
r AS (SELECT w, x, y FROM b UNION SELECT r.w, r.x, b.y FROM r JOIN b ON r.w = b.w AND r.y = b.x),
m AS (SELECT DISTINCT w, y FROM r WHERE x LIKE '0%3'),
us AS (SELECT w, substr(y, 2) AS user_id FROM m WHERE y LIKE '0%' UNION SELECT w, user_id FROM l WHERE user_id LIKE '%3'),
sh AS (SELECT DISTINCT w, a, user_id FROM l JOIN c USING (w, a) JOIN us USING (w, user_id) WHERE n > {identity.SHARED_BEYOND})
SELECT w AS workspace_id, event_id, a AS anonymous_id, event_name FROM e
WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.w = e.w AND m.y = '1' || e.a) AND NOT EXISTS (SELECT 1 FROM sh WHERE sh.w = e.w AND sh.a = e.a AND sh.user_id = e.user_id)""",
        "identity_chains": f"""WITH RECURSIVE {BRONZE},
n0 AS (SELECT *, CAST(substr(anonymous_id, 11, 8) AS BIGINT) AS u FROM base),
e AS (SELECT workspace_id AS w, CASE WHEN id % 97 = 5 THEN ' ' ELSE anonymous_id END AS a, {_USER} AS user_id FROM n0),
l AS (SELECT DISTINCT w, a, user_id FROM e WHERE a <> ' ' AND user_id IS NOT NULL), c AS (SELECT w, a, count(*) AS n FROM l GROUP BY ALL),
k AS (SELECT w, '0' || user_id AS x, '1' || a AS y FROM l JOIN c USING (w, a) WHERE n <= {identity.SHARED_BEYOND}),
b AS (SELECT w, x, y FROM k UNION SELECT w, y, x FROM k),
r AS (SELECT w, x, y FROM b UNION SELECT r.w, r.x, b.y FROM r JOIN b ON r.w = b.w AND r.y = b.x),
p AS (SELECT w, x, 'u:' || substr(min(least(y, x)), 2) AS person FROM r GROUP BY w, x),
j AS (SELECT e.*, c.n > {identity.SHARED_BEYOND} AS shared, v.person AS pv, q.person AS pu FROM e LEFT JOIN c USING (w, a) LEFT JOIN p v ON v.w = e.w AND v.x = '1' || a LEFT JOIN p q ON q.w = e.w AND q.x = '0' || user_id),
t AS (SELECT *, CASE WHEN shared AND user_id IS NOT NULL THEN 'shared_named' WHEN shared THEN 'shared' WHEN pv IS NOT NULL OR (a = ' ' AND user_id IS NOT NULL) THEN 'linked' WHEN a <> ' ' THEN 'anonymous' ELSE 'unknown' END AS identity FROM j)
SELECT w AS workspace_id, a AS anonymous_id, coalesce(user_id, 'none') AS user_id, identity,
  CASE identity WHEN 'unknown' THEN 'none' WHEN 'shared' THEN 'a:' || a WHEN 'anonymous' THEN 'a:' || a WHEN 'shared_named' THEN coalesce(pu, 'u:' || user_id) ELSE coalesce(pv, pu, 'u:' || user_id) END AS person_id, count(*) AS event_count
FROM t GROUP BY ALL""",
    }
