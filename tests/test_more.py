"""Streams, sinks, the hourly run and the designed operators beyond their queries."""

import json
import os

import pytest
from pyspark.sql import functions as F
from test_funnel import events

from stepwell.operators import dedupe, extended, funnel, serving, validate
from stepwell.plans import rebuild
from stepwell.sources import sinks
from stepwell.sources.events import in_delivery_order, in_stage_order, read_log, read_store
from stepwell.streaming import bronze

RAW = {
    "event_id": "event-000000000042", "event_name": "signup_completed", "occurred_at": "2024-03-04T10:00:00Z", "anonymous_id": "visitor-0000000000007", "session_id": "visit-000000000000001",
    "properties": {"signup_method": "sso"}, "context": {"platform": "web", "sdk_version": "2.3"}, "schema_version": "1.0.0", "tracking_plan_version": "1.0.0", "funnel_definition_version": "1.0.0", "consent": {"analytics": True},
}


def reasons(spark, raws):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(raws)], "k int, raw string").withColumn("received_at", F.lit("2024-03-04T10:00:05Z").cast("timestamp"))
    return [r["reason"] for r in validate.validate(df).orderBy("k").collect()]


def test_scalars_blanks_and_repeated_keys(spark):
    context = lambda v: json.dumps(RAW | {"context": {"platform": "web", "sdk_version": v}})
    bad = "invalid_context_or_consent"
    assert reasons(spark, [context(v) for v in (5, True, None, "\t\n", " ", "", {}, [])]) == [None, None, None, bad, bad, bad, bad, bad]
    body = json.dumps(RAW)
    assert reasons(spark, [body[:-1] + ',"event_name":"vpv"}', body[:-1] + ',"event_name":"signup_completed"}']) == ["unallowed_property", None]
    again = lambda text: body[:-1] + "," + text + "}"
    texts = ['"properties":{"signup_method":"sso","email":"a@b.c"}', '"properties":{"x":"1","email":"a"}', '"properties":{"email":"a","x":"1"}', '"consent":{"analytics":false}', '"consent":{"analytics":false,"analytics":true}', '"event_id":"short"', '"properties":{"signup_method":"fax","signup_method":"sso"}', '"properties":[]']
    assert reasons(spark, map(again, texts)) == ["sensitive_property", "unallowed_property", "sensitive_property", bad, None, "invalid_identifier", None, "invalid_properties"]
    # an object that is replaced later does not count, be it good or bad
    assert reasons(spark, ['{"properties":{"email":"a"},"event_id":"x",' + body[1:]]) == [None]


def test_repeated_ids_are_the_last_one_everywhere(spark):
    body = '{"event_id":"short",' + json.dumps(RAW)[1:]
    requests = spark.createDataFrame([("POST", "key-of-ws-1", b) for b in (body, json.dumps(RAW))], "method string, workspace_key string, body string").withColumn("received_at", F.lit("2024-03-04T10:00:05Z").cast("timestamp"))
    keys = spark.createDataFrame([("key-of-ws-1", "ws_1")], "workspace_key string, workspace_id string")
    assert sorted((r["event_id"], r["duplicate"]) for r in validate.ingest(requests, keys).collect()) == [(RAW["event_id"], False), (RAW["event_id"], True)]
    event = '{"event_id":"first","anonymous_id":"a1","event_name":"vpv","occurred_at":"2024-03-04T10:00:00Z","received_at":"2024-03-04T10:00:01Z","schema_version":"1.0.0","tracking_plan_version":"1.0.0","funnel_definition_version":"1.0.0","event_id":"last"}'
    records = spark.createDataFrame([("accepted-events.v1", "2:wsa1", f'{{"workspace_id":"old","event":{{}},"workspace_id":"ws","event":{event}}}')], "topic string, key string, value string")
    row = validate.dead_letter_reason(validate.parse_envelope(records)).first()
    assert (row["workspace_id"], row["event_id"], row["reason"]) == ("ws", "last", None) and json.loads(row["accepted_event_json"])["event_id"] == "last"


def test_http_outcomes_validate_once(spark):
    requests = spark.createDataFrame([], "method string, workspace_key string, body string, received_at timestamp")
    keys = spark.createDataFrame([("key-of-ws-1", "ws_1")], "workspace_key string, workspace_id string")
    plan = validate.ingest(requests, keys)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 1 and "Union" not in plan


def test_accepted_event_and_duplicates(spark):
    body = json.dumps(RAW)
    rows = [("POST", "key-of-ws-1", body, "2024-03-04T10:00:05.25Z"), ("POST", "key-of-ws-1", body, "2024-03-04T10:00:04Z"), ("POST", "key-of-ws-2", body, "2024-03-04T10:00:06Z")]
    requests = spark.createDataFrame(rows, "method string, workspace_key string, body string, at string").withColumn("received_at", F.col("at").cast("timestamp")).drop("at")
    keys = spark.createDataFrame([("key-of-ws-1", "ws_1"), ("key-of-ws-2", "ws_2")], "workspace_key string, workspace_id string")
    known = spark.createDataFrame([("ws_2", RAW["event_id"])], "workspace_id string, event_id string")
    got = sorted((r["workspace_id"], r["duplicate"], json.loads(r["accepted_json"])["received_at"]) for r in validate.ingest(requests, keys, known).collect())
    assert got == [("ws_1", False, "2024-03-04T10:00:04Z"), ("ws_1", True, "2024-03-04T10:00:05.250Z"), ("ws_2", True, "2024-03-04T10:00:06Z")]
    accepted = json.loads(validate.ingest(requests, keys).first()["accepted_json"])
    assert accepted == RAW | {"received_at": accepted["received_at"], "event_time_quality": "client_verified"}
    assert {(r["status"], r["reason"], r["duplicate"]) for r in validate.ingest(requests, keys, storage_available=False).collect()} == {(503, "storage_unavailable", None)}
    with pytest.raises(ValueError):
        validate.ingest(requests, keys.unionByName(keys))
    late = requests.withColumn("body", F.regexp_replace("body", "2024-03-04T10", "2024-03-09T10"))
    assert {(r["outcome"], r["event_time_quality"]) for r in validate.event_time(late, "body", policy="server_assigned").collect()} == {("accepted", "server_assigned")}


def log_of(spark, rows, path):
    bronze.to_records(events(spark, rows)).write.mode("append").json(path)


def test_strict_mode_outage_and_replay(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("bronze", "dead", "checkpoint")]
    log_of(spark, [("u", "vpv", "18 09:00"), ("u", "signup", "18 09:05")], str(tmp_path / "log"))
    (tmp_path / "bronze").write_text("a file where the table should be")
    with pytest.raises(Exception, match="(?i)fail|exist|exception"):  # storage is out: nothing is committed
        bronze.ingest_stream(bronze.read_records(spark, str(tmp_path / "log")), *paths)
    (tmp_path / "bronze").unlink()
    bronze.ingest_stream(bronze.read_records(spark, str(tmp_path / "log")), *paths, counted=str(tmp_path / "counted"))
    assert spark.read.parquet(paths[0]).count() == 2
    assert spark.read.schema(bronze.COUNTERS).json(str(tmp_path / "counted")).agg(F.sum("polled"), F.sum("dead_lettered")).first() == (2, 0)
    assert "event_date" in spark.read.parquet(paths[0]).columns and dict(spark.read.parquet(paths[0]).dtypes)["occurred_at"] == "timestamp_ntz"
    spark.createDataFrame([("t", 0, 9, "k", "no json")], bronze.RECORD).write.mode("append").json(str(tmp_path / "log"))
    with pytest.raises(Exception, match="cannot be read"):
        bronze.ingest_stream(bronze.read_records(spark, str(tmp_path / "log")), *paths, strict=True)
    bronze.ingest_stream(bronze.read_records(spark, str(tmp_path / "log")), *paths)
    assert spark.read.parquet(paths[0]).count() == 2 and spark.read.schema(bronze.DEAD_LETTER).json(paths[1]).collect()[0]["reason"] == "invalid_event_envelope"


def test_keyed_state_goes_on_after_a_restart(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("rows", "checkpoint")]
    for rows in ([("u", "vpv", "18 09:00")], [("u", "vpv", "18 09:00"), ("u", "signup", "10 09:00")]):  # again, and a late one
        log_of(spark, rows, str(tmp_path / "log"))
        bronze.ingest_first_seen(bronze.read_records(spark, str(tmp_path / "log")), *paths)
    assert sorted(r["event_name"] for r in spark.read.parquet(paths[0]).collect()) == ["signup_completed", "vpv"]


def test_keyed_state_calls_no_python_for_a_key(spark, tmp_path):
    log_of(spark, [("u", "vpv", "18 09:00")], str(tmp_path / "log"))
    seen = bronze.first_seen(bronze.split(bronze.read_records(spark, str(tmp_path / "log")))[0])
    plan = seen._jdf.queryExecution().analyzed().toString()
    assert "DeduplicateWithinWatermark" in plan and "Pandas" not in plan


def test_a_retry_heals_the_store(spark, tmp_path, monkeypatch):
    log, store = str(tmp_path / "log"), str(tmp_path / "store")
    rows, real = events(spark, [("u", "vpv", "18 09:00")]), sinks.append_new

    def fails(df, path, days=None):
        if path == store:
            raise OSError("storage is out")
        real(df, path, days)

    monkeypatch.setattr(bronze, "append_new", fails)
    with pytest.raises(OSError):
        bronze.publish_then_store(rows, log, store)
    monkeypatch.setattr(bronze, "append_new", real)
    bronze.publish_then_store(rows, log, store)
    assert spark.read.parquet(log).count() == spark.read.parquet(store).count() == 1


def test_sinks(spark, tmp_path):
    target = str(tmp_path / "report.json")
    for n in (1, 2):
        sinks.replace_json(spark.createDataFrame([(f'{{"n":{n}}}',)], "report string"), target)
        assert json.loads((tmp_path / "report.json").read_text()) == {"n": n}
    assert not list(tmp_path.glob("*.tmp"))
    with pytest.raises(ValueError):
        sinks.replace_json(spark.createDataFrame([], "report string"), target)
    with pytest.raises(ValueError):
        sinks.export(spark.range(1), str(tmp_path / "x"), "xml")
    assert sinks.KAFKA_PRODUCER["kafka.acks"] == "all"
    for k in range(3):
        sinks.append_bronze(events(spark, [(f"u{k}", "vpv", "18 09:00")]), str(tmp_path / "table"))
    before = sorted(map(tuple, spark.read.parquet(str(tmp_path / "table")).collect()), key=str)
    assert sinks.compact_days(spark, str(tmp_path / "table"), "2026-08-18", "2026-08-18") == 1
    assert len(list((tmp_path / "table" / "event_date=2026-08-18").glob("*.parquet"))) == 1
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "table")).collect()), key=str) == before


def test_an_append_knows_keys_of_all_days(spark, tmp_path):
    path = str(tmp_path / "table")
    first = events(spark, [("u", "vpv", "18 09:00")])
    late = first.withColumn("occurred_at", F.expr("occurred_at - interval 9 days"))
    for df in (first, late, first):
        sinks.append_new(df, path)
    assert spark.read.parquet(path).count() == 1
    sinks.append_new(late, path, days=1)  # a bound on days is a choice
    assert spark.read.parquet(path).count() == 2


def three_files(spark, path):
    for k in range(3):
        sinks.append_bronze(events(spark, [(f"u{k}", "vpv", "18 09:00")]), path)
    return sorted(r["anonymous_id"] for r in spark.read.parquet(path).collect())


class Lost(Exception):
    pass


@pytest.mark.parametrize("at", [0, 1, 2])
def test_a_refused_move_puts_the_day_back(spark, tmp_path, monkeypatch, at):
    path, calls = str(tmp_path / "table"), []
    before = three_files(spark, path)
    real = sinks._must

    def must(done, what):
        calls.append(what)
        real(done and len(calls) != at, what)

    if at == 0:  # the folder of the day cannot be moved at all
        monkeypatch.setattr(sinks, "_store", refusing(sinks._store))
    else:  # the move of the copy into its place, or the clearing after it
        monkeypatch.setattr(sinks, "_must", must)
    with pytest.raises(OSError):
        sinks.compact_days(spark, path, "2026-08-18", "2026-08-18")
    monkeypatch.undo()
    assert sorted(r["anonymous_id"] for r in spark.read.parquet(path).collect()) == before
    sinks.compact_days(spark, path, "2026-08-18", "2026-08-18")
    assert sorted(r["anonymous_id"] for r in spark.read.parquet(path).collect()) == before
    assert not [p for p in (tmp_path / "table").iterdir() if p.name.startswith("_compact")]


def refusing(store):
    """A file system whose renames of a day's folder are refused, told by their answer alone."""

    class Refusing:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def rename(self, a, b):
            return False if b.getName() == "old" else self.fs.rename(a, b)

    def made(spark, path):
        at, fs = store(spark, path)
        return at, Refusing(fs)

    return made


@pytest.mark.parametrize("step", ["copied", "away", "half", "undone", "swapped"])
def test_a_lost_driver_leaves_the_day_to_the_next_run(spark, tmp_path, monkeypatch, step):
    path, day = str(tmp_path / "table"), tmp_path / "table" / "event_date=2026-08-18"
    before = three_files(spark, path)

    def lose(*a):
        raise Lost

    if step == "copied":
        monkeypatch.setattr(sinks, "replace_text", lose)
    else:
        monkeypatch.setattr(sinks, "_swap_in", lose)
        monkeypatch.setattr(sinks, "_put_back", lose)
    with pytest.raises(Lost):
        sinks.compact_days(spark, path, "2026-08-18", "2026-08-18")
    monkeypatch.undo()
    beside = next(p for p in (tmp_path / "table").iterdir() if p.name.startswith("_compact"))
    copies = [p for p in (beside / "new").iterdir() if p.name.startswith("part")]
    if step == "half":  # a writer has made the day again, and one of the copies is in place
        sinks.append_bronze(events(spark, [("late", "vpv", "18 10:00")]), path)
        copies[0].rename(day / copies[0].name)
        before = sorted([*before, "late"])
    if step == "swapped":
        day.mkdir()
        for c in copies:
            c.rename(day / c.name)
    if step == "undone":
        (beside / "new").rename(beside / "undone")
    assert sinks.recover_compaction(spark, path) == 1 and sinks.recover_compaction(spark, path) == 0
    assert sorted(r["anonymous_id"] for r in spark.read.parquet(path).collect()) == before


def test_a_session_store_stays_one_scan(spark, tmp_path):
    rows = events(spark, [(f"u{k}", "vpv", "18 09:00") for k in range(8)])
    store = sinks.SessionStore(spark, "test_growing_store", rows.schema, str(tmp_path / "store"))
    assert store.snapshot("ws_1").count() == 0
    for k in range(4):
        store.append(rows.where(F.col("anonymous_id") <= f"u{k}"))
        assert store.snapshot("ws_1").count() == k + 1 and store.snapshot("ws_2").count() == 0
    assert spark.table("test_growing_store")._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    store.close()
    assert not spark.catalog.tableExists("test_growing_store") and not (tmp_path / "store").exists()


def test_store_errors_name_file_and_line(spark, tmp_path):
    (tmp_path / "demo.ndjson").write_text('{"event_id":"e1"}\n\n{"event_id":"e2"}\n{"event_id":"e1"}\n')
    with pytest.raises(ValueError, match=r"repeated event_id: .*demo\.ndjson:4"):
        read_store(spark, str(tmp_path))
    (tmp_path / "demo.ndjson").write_text('{"event_id":"e1"}\n{"other":1}\n')
    with pytest.raises(ValueError, match=r"invalid record: .*demo\.ndjson:2"):
        read_store(spark, str(tmp_path))
    lines = [f"line {k}" for k in range(5000)]
    (tmp_path / "log.txt").write_text("\n\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        rows = read_log(spark, str(tmp_path / "log.txt"), 10)
        assert rows.rdd.getNumPartitions() > 3
        assert sorted(map(tuple, rows.collect())) == [(k + 1, t) for k, t in enumerate(lines) if k >= 10]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_publishing_over_jdbc(spark, tmp_path):
    """An embedded database stands in for the serving one."""
    url = "jdbc:derby:memory:serving;create=true"
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    columns = "workspace_id VARCHAR(64), event_date DATE, funnel_definition_version VARCHAR(64), stage_name VARCHAR(64), unique_users BIGINT, snapshot_version VARCHAR(128), canonical_completed_at TIMESTAMP, data_sla_status VARCHAR(16)"
    quoted = ", ".join(f'"{c.split()[0]}" {c.split()[1]}' for c in columns.split(", "))
    connection.createStatement().execute(f"CREATE TABLE serving ({quoted})")
    gold = serving.snapshot(funnel.canonical_daily(events(spark, [("u", "vpv", "18 09:00"), ("u", "signup", "18 09:05"), ("v", "vpv", "19 09:00")]), "2026-08-18", "2026-08-19"), "it's 1", "2026-08-20 00:00:00")
    for _ in range(2):  # the second time finds it there
        rebuild.publish_jdbc(gold, url, "serving", "2026-08-18", "it's 1")
    rebuild.publish_jdbc(gold, url, "serving", "2026-08-18", "another")  # of which there are no rows
    got = spark.read.format("jdbc").options(url=url, dbtable="serving").load().collect()
    assert sorted((str(r["event_date"]), r["stage_name"], r["unique_users"], r["snapshot_version"]) for r in got) == [("2026-08-18", "signup_completed", 1, "it's 1"), ("2026-08-18", "vpv", 1, "it's 1")]


def test_retention_by_class(spark, tmp_path):
    paths = {name: str(tmp_path / name) for name in ("raw", "curated")}
    for path in paths.values():
        sinks.append_bronze(events(spark, [("u", "vpv", f"{d:02d} 09:00") for d in range(10, 19)]), path)
    with pytest.raises(ValueError, match="curated"):
        sinks.expire_days(spark, paths, {"raw": 3}, "2026-08-18")
    removed = sinks.expire_days(spark, paths, {"raw": 3, "curated": 400}, "2026-08-18")
    assert removed == {"raw": [f"2026-08-{d}" for d in range(10, 16)], "curated": []}
    assert sinks.days_of(spark, paths["raw"]) == ["2026-08-16", "2026-08-17", "2026-08-18"] and len(sinks.days_of(spark, paths["curated"])) == 9
    assert sinks.expire_days(spark, {"none": str(tmp_path / "none")}, {"none": 1}, "2026-08-18") == {"none": []}


def test_a_lost_run_leaves_its_lock_to_the_next(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("bronze", "silver", "gold", "served")]
    sinks.append_bronze(events(spark, [("u", "vpv", "18 09:00")]), paths[0])
    (tmp_path / "gold.lock").write_text("hourly-1")
    os.utime(tmp_path / "gold.lock", (0, 0))
    interval = ("2026-08-18T09:15:00", "2026-08-18T10:15:00")
    assert rebuild.run_hour(spark, *paths, interval, "2", delay=0) == "hourly-2" and not (tmp_path / "gold.lock").exists()


def test_the_raw_event_is_not_dealt_for_ties(spark):
    plan = dedupe.silver(events(spark, [("u", "vpv", "18 09:00")])).select("event_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan and "accepted_event_json" not in plan.split("Window")[1].split("Project")[0]


def test_hourly_run(spark, tmp_path, monkeypatch):
    paths = [str(tmp_path / n) for n in ("bronze", "silver", "gold", "served")]
    sinks.append_bronze(events(spark, [("u", "vpv", "18 09:00"), ("u", "signup", "19 00:05")]), paths[0])
    interval, tries, real = ("2026-08-18T23:15:00", "2026-08-19T00:15:00"), [], rebuild.rebuild

    def once_failing(*a):
        tries.append(1)
        if len(tries) == 1:
            raise OSError("a lost executor")
        return real(*a)

    monkeypatch.setattr(rebuild, "rebuild", once_failing)
    assert rebuild.run_hour(spark, *paths, interval, "7", delay=0) == "hourly-7" and len(tries) == 3
    assert {str(r["event_date"]) for r in spark.read.parquet(paths[3]).collect()} == {"2026-08-18", "2026-08-19"}
    (tmp_path / "gold.lock").touch()
    with pytest.raises(RuntimeError, match="at work"):
        rebuild.run_hour(spark, *paths, interval, "8", delay=0)
    (tmp_path / "gold.lock").unlink()
    monkeypatch.setattr(rebuild, "rebuild", lambda *a: (_ for _ in ()).throw(OSError("down")))
    with pytest.raises(OSError):
        rebuild.run_hour(spark, *paths, interval, "9", retries=1, delay=0)
    assert not (tmp_path / "gold.lock").exists()


def test_a_failed_overwrite_keeps_the_days(spark, tmp_path):
    path = str(tmp_path / "gold")
    rows = spark.createDataFrame([("2026-08-18", 1), ("2026-08-19", 2)], "d string, n int").select(F.col("d").cast("date").alias("event_date"), "n")
    sinks.overwrite_days(rows, path, "2026-08-18", "2026-08-19")
    with pytest.raises(Exception, match="(?i)broken"):
        sinks.overwrite_days(rows.where("n = 1").withColumn("n", F.raise_error(F.lit("broken")).cast("int")), path, "2026-08-18", "2026-08-19")
    assert spark.read.parquet(path).count() == 2
    sinks.overwrite_days(rows.where("n = 1"), path, "2026-08-18", "2026-08-19")
    assert [r["n"] for r in spark.read.parquet(path).collect()] == [1]


def test_designed_operators(spark):
    gates = spark.createDataFrame([("a", True, 0), ("b", False, 0), ("c", True, 3)], "workspace_id string, reconciled boolean, null_times long")
    assert [r[0] for r in extended.gate(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "workspace_id string"), gates).collect()] == ["a"]
    with pytest.raises(ValueError):
        extended.upcast(spark.createDataFrame([("1",)], "schema_version string"), {"1": ("2", {}), "2": ("1", {})}, "3")
    layers = spark.createDataFrame([("a", "bronze", "2024-01-01 00:00:00"), ("a", "gold", "2023-12-31 23:00:00"), ("b", "bronze", "2023-12-31 20:00:00")], "workspace_id string, layer string, t string").withColumn("data_through", F.col("t").cast("timestamp_ntz"))
    got = {(r["workspace_id"], r["layer"]): (r["status"], r["trusted"]) for r in extended.layer_status(layers, "2024-01-01 00:04:00").collect()}
    assert got == {("a", "bronze"): ("healthy", True), ("a", "gold"): ("healthy", True), ("b", "bronze"): ("stale", False)}
    gold = spark.createDataFrame([("w", "2024-01-02", "vpv"), ("w", "2024-01-01", "signup_completed"), ("w", "2024-01-01", "vpv")], "workspace_id string, event_date string, stage_name string")
    assert [tuple(r)[1:] for r in in_stage_order(gold).collect()] == [("2024-01-01", "vpv"), ("2024-01-01", "signup_completed"), ("2024-01-02", "vpv")]
    sent = spark.createDataFrame([("b", 0), ("a", 0), ("c", 3)], "event_id string, delivery int")
    assert [r["event_id"] for r in in_delivery_order(sent).collect()] == ["c", "a", "b"]
