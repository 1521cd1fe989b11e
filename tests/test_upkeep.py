"""Late days, deletion, quality gates and identities beyond their queries."""

import random

import pytest
from pyspark.sql import functions as F
from test_funnel import events

from stepwell.operators import dedupe, funnel, gates, identity, metrics, serving, validate
from stepwell.plans import erasure, rebuild
from stepwell.sources import buckets, sinks
from stepwell.streaming import bronze, replay

DAYS = [f"2026-08-{d:02d}" for d in range(1, 21)]


def many(spark, seed, n=300, users=20, days=range(1, 21)):
    rng = random.Random(seed)
    rows = [(f"u{rng.randrange(users)}", rng.choice(["vpv", "signup", "act", "sub", "click"]), f"{rng.choice(days):02d} {rng.randrange(24):02d}:{rng.randrange(60):02d}") for _ in range(n)]
    return events(spark, rows).withColumn("event_id", F.concat(F.lit(f"s{seed}-"), "event_id"))


def numbered(df):
    """With ids as the log's records have them."""
    return df.withColumn("event_id", F.concat(F.lit("event-"), F.lpad(F.abs(F.hash("event_id")).cast("string"), 12, "0")))


def rows_of(df):
    return sorted(map(tuple, df.select("workspace_id", F.col("event_date").cast("string"), "stage_name", "unique_users").collect()))


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_late_days_equal_a_full_rebuild_and_leave_other_files(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("bronze", "silver", "gold", "served", "touched", "done")]
    early, late = many(spark, 1), many(spark, 2, 12, days=[6]).unionByName(many(spark, 3, 4, days=[14]))
    took = []
    for k, some in enumerate((early, late, late)):  # the third time brings nothing new
        bronze.to_records(numbered(some)).write.mode("append").json(str(tmp_path / "log"))
        bronze.ingest_stream(bronze.read_records(spark, str(tmp_path / "log")), paths[0], str(tmp_path / "dead"), str(tmp_path / "checkpoint"), touched=paths[4])
        before = files(tmp_path / "gold") if k else {}
        took.append(rebuild.rebuild_touched(spark, *paths, f"v{k}", "2026-08-21 00:00:00", 2))
        full = funnel.canonical_daily(dedupe.silver(spark.read.parquet(paths[0]).drop("event_date")), DAYS[0], DAYS[-1], 2, "per_day")
        assert rows_of(spark.read.parquet(paths[2])) == rows_of(full)
        if k == 1:
            after = files(tmp_path / "gold")
            assert {p for p in before if after.get(p) == before[p]} == {p for p in before if p.split("event_date=")[1][:10] not in took[1]}
            assert spark.read.parquet(paths[3]).where("snapshot_version = 'v1'").select("event_date").distinct().count() <= len(took[1])
    assert took[0] == DAYS and took[1] == [f"2026-08-{d:02d}" for d in (*range(5, 10), *range(13, 18))]
    assert rebuild.rebuild_touched(spark, *paths, "v9", "2026-08-21 00:00:00", 2) == []
    assert rebuild.touched_days(spark, str(tmp_path / "nothing"), paths[5]) == (-1, [])


def test_a_failed_rebuild_of_late_days_is_done_again(spark, tmp_path, monkeypatch):
    paths = [str(tmp_path / n) for n in ("bronze", "silver", "gold", "served", "touched", "done")]
    bronze.to_records(numbered(many(spark, 4, 40))).write.json(str(tmp_path / "log"))
    bronze.ingest_stream(bronze.read_records(spark, str(tmp_path / "log")), paths[0], str(tmp_path / "dead"), str(tmp_path / "checkpoint"), touched=paths[4])
    monkeypatch.setattr(rebuild, "publish_days", lambda *a: (_ for _ in ()).throw(OSError("serving is out")))
    with pytest.raises(OSError):
        rebuild.rebuild_touched(spark, *paths, "v1", "2026-08-21 00:00:00", 2)
    monkeypatch.undo()
    assert rebuild.rebuild_touched(spark, *paths, "v1", "2026-08-21 00:00:00", 2)
    assert rows_of(spark.read.parquet(paths[3])) == rows_of(spark.read.parquet(paths[2]))


def test_a_failed_gate_keeps_the_older_snapshot_of_its_day(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("bronze", "silver", "gold", "served", "touched", "done")]
    limits, judged = gates.Limits(order=1.0, volume=0.0), str(tmp_path / "judged")
    slow = many(spark, 12, 30, days=[9]).withColumn("received_at", F.expr("received_at + interval 5 hours"))
    for k, some in enumerate((many(spark, 11, 200), slow.unionByName(many(spark, 13, 3, days=[15])))):
        bronze.to_records(numbered(some)).write.mode("append").json(str(tmp_path / "log"))
        bronze.ingest_stream(bronze.read_records(spark, str(tmp_path / "log")), paths[0], str(tmp_path / "dead"), str(tmp_path / "checkpoint"), touched=paths[4])
        rebuild.rebuild_touched(spark, *paths, f"v{k}", "2026-08-21 00:00:00", 1, limits, judged)
    now = serving.current(spark.read.parquet(paths[3]))
    versions = {(str(r["event_date"]), r["snapshot_version"]) for r in now.collect()}
    assert {d for d, v in versions if v == "v1"} == {"2026-08-08", "2026-08-10", "2026-08-11", "2026-08-14", "2026-08-15", "2026-08-16", "2026-08-17"}
    failed = {str(r["event_date"]): r["failed"] for r in spark.read.parquet(judged).where("size(failed) > 0").collect()}
    assert failed == {"2026-08-09": ["freshness"]} and spark.read.parquet(judged).count() == 20
    with pytest.raises(ValueError):
        bronze.to_records(numbered(many(spark, 14, 3))).write.mode("append").json(str(tmp_path / "log"))
        bronze.ingest_stream(bronze.read_records(spark, str(tmp_path / "log")), paths[0], str(tmp_path / "dead"), str(tmp_path / "checkpoint"), touched=paths[4])
        rebuild.rebuild_touched(spark, *paths, "v9", "2026-08-21 00:00:00", 1, limits)


def test_a_journey_is_copied_by_its_days(spark):
    rows = many(spark, 5, 400)
    for lookback in (1, 3, 30):
        per_day = [r for day in DAYS for r in rows_of(funnel.canonical_daily(rows, day, day, lookback))]
        assert rows_of(funnel.canonical_days(rows, DAYS, lookback)) == sorted(per_day)
    assert rows_of(funnel.canonical_days(rows, [], 3)) == [] and rows_of(funnel.canonical_days(rows.limit(0), DAYS, 3)) == []


def test_erasure_rewrites_only_the_days_of_its_subjects(spark, tmp_path, monkeypatch):
    layers = erasure.Layers(*[str(tmp_path / n) for n in ("bronze", "silver", "gold", "served", "index", "markers", "audit")])
    sinks.append_bronze(many(spark, 6), layers.bronze)
    sinks.append_bronze(events(spark, [("gone", "vpv", "05 09:00"), ("gone", "signup", "07 09:00"), ("gone", "click", "07 10:00")]), layers.bronze)
    rebuild.rebuild_days(spark, layers.bronze, layers.silver, layers.gold, sinks.days_of(spark, layers.bronze), "v1", "2026-08-21 00:00:00", 2)
    erasure.index_days(spark, layers)
    subjects = spark.createDataFrame([("ws_1", "gone"), ("ws_1", "gone"), ("ws_2", "u1"), (None, "u2"), ("ws_1", None)], "workspace_id string, anonymous_id string")
    before = {n: files(tmp_path / n) for n in ("bronze", "silver", "gold", "index")}
    monkeypatch.setattr(erasure, "rebuild_gold", lambda *a: (_ for _ in ()).throw(OSError("a lost driver")))
    with pytest.raises(OSError):
        erasure.erase(spark, layers, subjects, "r1", "v2", "2026-08-22 00:00:00", 2)
    monkeypatch.undo()
    gold = erasure.erase(spark, layers, subjects, "r1", "v2", "2026-08-22 00:00:00", 2)  # again, as a whole
    assert gold == [f"2026-08-{d:02d}" for d in range(5, 10)]
    days = {"bronze": ("05", "07"), "silver": ("05", "07"), "index": ("05", "07"), "gold": ("05", "06", "07", "08", "09")}
    for n, changed in days.items():
        after = files(tmp_path / n)
        assert {p.split("event_date=")[1][8:10] for p in before[n] if after.get(p) != before[n][p]} == set(changed)
    for n in ("bronze", "silver", "index"):
        assert spark.read.parquet(str(tmp_path / n)).where("anonymous_id = 'gone'").count() == 0
    assert spark.read.parquet(layers.bronze).count() == 300
    full = funnel.canonical_days(spark.read.parquet(layers.silver).drop("event_date"), DAYS, 2)
    assert rows_of(spark.read.parquet(layers.gold)) == rows_of(full)
    audit = spark.read.schema(erasure.AUDIT).json(layers.audit).collect()
    assert [(r["step"], r["subjects"]) for r in sorted(audit, key=lambda r: r["step"])] == [("completed", 2), ("started", 2), ("started", 2)]
    assert not any("gone" in str(r) for r in audit)
    fresh = events(spark, [("gone", "vpv", "09 09:00"), ("kept", "vpv", "09 09:00")])
    assert [r["anonymous_id"] for r in erasure.without_marked(fresh, layers.markers).collect()] == ["kept"]
    assert erasure.erase(spark, layers, subjects, "r2", "v3", "2026-08-22 00:00:00", 2) == []  # nothing is left of them


def test_a_stream_keeps_the_index_and_keeps_marked_subjects_out(spark, tmp_path):
    layers = erasure.Layers(*[str(tmp_path / n) for n in ("bronze", "silver", "gold", "served", "index", "markers", "audit")])
    log, dead = str(tmp_path / "log"), str(tmp_path / "dead")

    def stream(rows):
        made = events(spark, [(who, name, at) for who, name, at, _ in rows])
        users = spark.createDataFrame([(k, user) for k, (*_, user) in enumerate(rows)], "k int, user_id string")
        made = made.withColumn("k", F.regexp_extract("event_id", r"(\d+)$", 1).cast("int")).join(users, "k").drop("k")
        made = numbered(made.withColumn("event_id", F.concat("event_id", "anonymous_id", F.col("occurred_at").cast("string"))))
        bronze.to_records(made).write.mode("append").json(log)
        bronze.ingest_stream(bronze.read_records(spark, log), layers.bronze, dead, str(tmp_path / "checkpoint"), markers=layers.markers, index=layers.index)

    def held(path=layers.bronze):
        return sorted((r["anonymous_id"], str(r["event_date"])[8:], last) for r in spark.read.parquet(path).withColumn("last", validate.last_value("accepted_event_json", "user_id")).collect() for last in [r["last"]])

    stream([("gone", "vpv", "05 09:00", None), ("kiosk", "vpv", "06 09:00", "ann"), ("kiosk", "vpv", "06 10:00", "bob"), ("kiosk", "vpv", "07 10:00", None), ("kept", "vpv", "08 09:00", "ann")])
    rebuild.rebuild_days(spark, layers.bronze, layers.silver, layers.gold, sinks.days_of(spark, layers.bronze), "v1", "2026-08-21 00:00:00", 2)
    assert spark.read.parquet(layers.index).count() == 4
    before = files(tmp_path / "bronze")
    subjects = spark.createDataFrame([("ws_1", "gone", None), ("ws_1", "kiosk", "ann")], "workspace_id string, anonymous_id string, user_id string")
    assert erasure.erase(spark, layers, subjects, "r1", "v2", "2026-08-22 00:00:00", 1)[0] == "2026-08-05"
    left = [("kept", "08", "ann"), ("kiosk", "06", "bob"), ("kiosk", "07", None)]
    assert held() == left and held(layers.silver) == left
    after = files(tmp_path / "bronze")
    assert {p.split("event_date=")[1][8:10] for p in before if after.get(p) == before[p]} == {"07", "08"}  # the device's other day as well
    stream([("gone", "vpv", "09 09:00", None), ("kiosk", "vpv", "09 10:00", "ann"), ("kiosk", "vpv", "09 11:00", "bob"), ("new", "vpv", "09 12:00", "ann")])
    assert held() == sorted([*left, ("kiosk", "09", "bob"), ("new", "09", "ann")])
    assert spark.read.parquet(layers.index).where("event_date = '2026-08-09'").count() == 2


def test_people_are_all_that_chains_connect_and_their_part_of_shared_devices(spark, tmp_path):
    rows = [("a1", "u1"), ("a1", "u2"), ("a2", "u2"), ("a3", "u3"), ("kiosk", "u1"), ("kiosk", "u4"), ("kiosk", "u5"), ("kiosk", "u2"), ("a4", None), (" ", "u1"), (None, "u1")]
    pairs = spark.createDataFrame([("w", *r) for r in rows] + [("other", "a1", "u1")], "workspace_id string, anonymous_id string, user_id string")
    subjects = lambda *users: sorted(map(tuple, erasure.subjects_of_people(pairs, spark.createDataFrame([("w", u) for u in users], "workspace_id string, user_id string"), str(tmp_path)).collect()), key=str)
    assert subjects("u1", "u1", None) == [("w", "a1", None), ("w", "a2", None), ("w", "kiosk", "u1"), ("w", "kiosk", "u2")]
    assert subjects("u4") == [("w", "kiosk", "u4")] and subjects("nobody") == []


def plain_components(edges):
    root = {}
    for w, a, b in edges:
        root.setdefault((w, a), a), root.setdefault((w, b), b)
    changed = True
    while changed:
        changed = False
        for w, a, b in edges:
            m = min(root[w, a], root[w, b])
            if root[w, a] != m or root[w, b] != m:
                root[w, a] = root[w, b] = m
                changed = True
    return root


def test_components_of_chains_stars_and_random_links(spark, tmp_path):
    rng = random.Random(9)
    edges = [("w", f"c{k:03d}", f"c{k + 1:03d}") for k in range(120)] + [("w", "hub", f"leaf{k}") for k in range(80)]
    edges += [(rng.choice("vw"), f"r{rng.randrange(90)}", f"r{rng.randrange(90)}") for _ in range(60)]
    want = plain_components([e for e in edges if e[1] != e[2]])
    df = spark.createDataFrame([*edges, *edges[:5], ("w", None, "x"), ("w", "x", None)], "workspace_id string, node string, other string")
    assert {(r["workspace_id"], r["node"]): r["root"] for r in identity.components(df, str(tmp_path)).collect()} == want
    assert identity.components(df.limit(0), str(tmp_path)).count() == 0


def test_identities_of_chains_shared_devices_and_blanks(spark, tmp_path):
    rows = [("w", "a1", "ann"), ("w", "a1", None), ("w", "a2", "ann"), ("w", "a2", "bob"), ("w", "a3", "bob"), ("w", "a4", None), ("w", " ", "bob"), ("w", None, "cyd"), ("w", None, None), ("x", "a1", None)]
    rows += [("w", "kiosk", u) for u in ("ann", "bob", "cyd", "dee", None)]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "workspace_id string, anonymous_id string, user_id string, root int, person string")
    got = identity.stitch_chains(df, str(tmp_path))
    assert got.columns == [*df.columns, "person_id", "identity"]
    want = {
        ("w", "a1", "ann"): ("u:ann", "linked"), ("w", "a1", None): ("u:ann", "linked"), ("w", "a2", "ann"): ("u:ann", "linked"), ("w", "a2", "bob"): ("u:ann", "linked"), ("w", "a3", "bob"): ("u:ann", "linked"), ("w", "a4", None): ("a:a4", "anonymous"),
        ("w", " ", "bob"): ("u:ann", "linked"), ("w", None, "cyd"): ("u:cyd", "linked"), ("w", None, None): (None, "unknown"), ("x", "a1", None): ("a:a1", "anonymous"),
        ("w", "kiosk", "ann"): ("u:ann", "shared_named"), ("w", "kiosk", "bob"): ("u:ann", "shared_named"), ("w", "kiosk", "cyd"): ("u:cyd", "shared_named"), ("w", "kiosk", "dee"): ("u:dee", "shared_named"), ("w", "kiosk", None): ("a:kiosk", "shared"),
    }
    assert {tuple(r)[:3]: (r["person_id"], r["identity"]) for r in got.collect()} == want and got.count() == len(rows)
    assert identity.stitch_chains(df.limit(0), str(tmp_path)).count() == 0


def test_links_are_read_once_and_only_users_go_through_the_turns(spark, tmp_path, monkeypatch):
    rows = [("w", f"a{k}-{n}", f"u{k}") for k in range(20) for n in range(5)] + [("w", "a0-x", "u1"), ("w", "a0-x", "u0"), ("w", "a2-x", "u2"), ("w", "a2-x", "u1")]
    df, turns, seen = spark.createDataFrame(rows, "workspace_id string, anonymous_id string, user_id string"), [], spark.sparkContext.accumulator(0)
    df.write.parquet(str(tmp_path / "events"))

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    events = spark.read.parquet(str(tmp_path / "events")).select("workspace_id", "anonymous_id", F.inline(F.array(F.struct(counted("user_id").alias("user_id")))))
    plain = identity.components
    monkeypatch.setattr(identity, "components", lambda edges, folder: (turns.append(edges.count()), plain(edges, folder))[1])
    users = spark.createDataFrame([("w", "u2")], "workspace_id string, user_id string")
    got = erasure.subjects_of_people(events, users, str(tmp_path)).collect()
    assert {r["anonymous_id"] for r in got} == {"a0-x", "a2-x", *(f"a{k}-{n}" for k in range(3) for n in range(5))} and all(r["user_id"] is None for r in got)
    assert turns == [2] and seen.value == len(rows)


def test_bucketed_tables_are_not_dealt_again(spark, tmp_path):
    rows = many(spark, 8).unionByName(many(spark, 8).withColumn("received_at", F.expr("received_at + interval 1 hour")))
    gold = buckets.bucketed_gold(spark, rows, str(tmp_path), "test_buckets", DAYS[0], DAYS[-1], buckets=4)
    assert rows_of(gold) == rows_of(funnel.canonical_daily(dedupe.silver(rows), DAYS[0], DAYS[-1]))
    exchanges = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("Exchange") + df._jdf.queryExecution().executedPlan().toString().count("Exchange hash")
    assert exchanges(dedupe.silver(spark.table("test_buckets_bronze"))) == 0  # copies of an event lie together
    assert exchanges(gold) == 1  # for the daily counts alone
    assert len(list((tmp_path / "silver").glob("*.parquet"))) <= 4


def test_replays_of_dead_letters(spark, tmp_path):
    bronze.to_records(numbered(many(spark, 10, 12))).withColumn("topic", F.lit("other")).write.json(str(tmp_path / "log"))
    paths = [str(tmp_path / n) for n in ("bronze", "dead", "checkpoint")]
    bronze.ingest_stream(bronze.read_records(spark, str(tmp_path / "log")), *paths)
    log, dead = spark.read.schema(bronze.RECORD).json(str(tmp_path / "log")), spark.read.schema(bronze.DEAD_LETTER).json(paths[1])
    mend = lambda df: df.withColumn("topic", F.lit("accepted-events.v1"))
    run = lambda name, letters, how: replay.replay_letters(spark, name, log, letters, how, paths[0], str(tmp_path / "staging"), str(tmp_path / "audit"))
    lost = dead.limit(1).withColumn("offset", F.lit(-1).cast("long"))
    assert dead.count() == 12 and run("a", dead, lambda df: df) == "refused" and run("b", dead.unionByName(lost), mend) == "refused"
    assert not sinks.exists(spark, paths[0])  # a stream without a good record leaves no table, and may go on
    assert run("c", dead.unionByName(dead), mend) == "promoted" and run("c", dead, mend) == "promoted"
    assert spark.read.parquet(paths[0]).count() == 12 and run("d", dead.limit(0), mend) == "promoted"
    audit = {(r["replay_id"], r["outcome"], r["letters"], r["found"], r["good"]) for r in replay.replays(spark, str(tmp_path / "audit")).collect()}
    assert audit == {("a", "refused", 12, 12, 0), ("b", "refused", 13, 12, 12), ("c", "promoted", 12, 12, 12), ("d", "promoted", 0, 0, 0)}


def test_a_replay_does_not_sort_the_log(spark, tmp_path):
    bronze.to_records(numbered(many(spark, 15, 12))).withColumn("topic", F.lit("other")).write.json(str(tmp_path / "log"))
    log, plans, limit = spark.read.schema(bronze.RECORD).json(str(tmp_path / "log")), [], "spark.sql.autoBroadcastJoinThreshold"
    explained = lambda df: (plans.append(df._jdf.queryExecution().sparkPlan().toString()), df)[1]
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # as with many letters
    try:
        replay.replay_letters(spark, "a", log, log, explained, str(tmp_path / "bronze"), str(tmp_path / "staging"), str(tmp_path / "audit"))
    finally:
        spark.conf.set(limit, before)
    assert "SortMergeJoin" not in plans[0] and "ShuffledHashJoin" in plans[0]


def test_a_batch_is_kept_without_packing_and_the_setting_comes_back(spark, tmp_path, monkeypatch):
    bronze.to_records(numbered(many(spark, 16, 12))).write.json(str(tmp_path / "log"))
    during, before, plain = [], spark.conf.get(bronze.PACKED), bronze.append_new
    monkeypatch.setattr(bronze, "append_new", lambda df, *a: (during.append((df.sparkSession, df.sparkSession.conf.get(bronze.PACKED))), plain(df, *a)))
    bronze.ingest_stream(bronze.read_records(spark, str(tmp_path / "log")), *[str(tmp_path / n) for n in ("bronze", "dead", "checkpoint")])
    assert during and all(setting == "false" and session.conf.get(bronze.PACKED) == before for session, setting in during)
    assert spark.conf.get(bronze.PACKED) == before and spark.read.parquet(str(tmp_path / "bronze")).count() == 12


def test_kinds_of_anomalies(spark):
    def series(workspace, measure, kind, last, usual=100):
        return [(workspace, f"2026-08-{d:02d}", measure, kind, last if d == 8 else usual + d % 3) for d in range(1, 9)]

    rows = series("calm", "event_count", "data", 101) + series("calm", "vpv", "business", 300)
    rows += series("broken", "event_count", "data", 3) + series("broken", "vpv", "business", 3) + series("broken", "signup_completed", "business", 101)
    rows += series("small", "event_count", "data", 90, 4) + series("small", "vpv", "business", 90, 4) + [("new", "2026-08-08", "event_count", "data", 7)]
    daily = spark.createDataFrame(rows, "workspace_id string, d string, measure string, kind string, users long").withColumn("event_date", F.col("d").cast("date")).drop("d")
    got = {(r["workspace_id"], r["measure"]): r["status"] for r in metrics.metric_anomalies(daily, 50).collect()}
    assert got == {
        ("calm", "event_count"): "normal", ("calm", "vpv"): "business_anomaly", ("broken", "event_count"): "data_anomaly", ("broken", "vpv"): "suppressed_data_anomaly", ("broken", "signup_completed"): "normal",
        ("small", "event_count"): "insufficient_volume", ("small", "vpv"): "insufficient_volume", ("new", "event_count"): "insufficient_history",
    }
    assert metrics.metric_anomalies(metrics.daily_metrics(many(spark, 9).limit(0))).count() == 0


def test_gates_of_days_that_only_one_layer_has(spark):
    rows = many(spark, 7, 60).withColumn("event_date", F.to_date("occurred_at"))
    gold = funnel.canonical_daily(rows, DAYS[0], DAYS[-1])
    more = gold.limit(1).withColumn("event_date", F.lit("2026-09-01").cast("date"))
    untimed = rows.limit(1).withColumns({"occurred_at": F.lit(None).cast("timestamp_ntz"), "event_date": F.lit(None).cast("date"), "event_id": F.lit("event-without-a-time")})
    judged = gates.judge_days(gates.day_metrics(rows.unionByName(untimed), rows, gold.unionByName(more)), gates.Limits(order=1.0, volume=0.0))
    failed = {str(r["event_date"]): r["failed"] for r in judged.collect()}
    assert failed.pop("None") == ["nulls", "reconciliation"] and failed.pop("2026-09-01") == ["reconciliation"]
    assert set(map(tuple, failed.values())) == {()} and rows_of(gates.passing(gold.unionByName(more), judged)) == rows_of(gold)
    assert gates.judge_days(gates.day_metrics(rows.limit(0), rows.limit(0), gold.limit(0))).count() == 0
