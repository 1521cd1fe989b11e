import random

import pytest
from pyspark.sql import functions as F

from stepwell.functions.values import STAGES
from stepwell.operators import dedupe, funnel
from stepwell.sources.events import COLUMNS

SHORT = dict(zip(("vpv", "signup", "act", "sub"), STAGES, strict=True))


def events(spark, rows):
    """rows: (user, short stage, day and time)."""
    made = [("ws_1", f"event-{k:012d}", u, SHORT.get(n, n), f"2026-08-{t}", f"2026-08-{t}", "1.0.0", "1.0.0", "1.0.0", "{}") for k, (u, n, t) in enumerate(rows)]
    df = spark.createDataFrame(made, ", ".join(f"{c} string" for c in COLUMNS))
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("occurred_at", "received_at")})


SEMANTICS = {
    "u1": [("vpv", "18 09:00"), ("signup", "18 09:01"), ("act", "18 09:02"), ("sub", "18 09:03")],
    "u2": [("signup", "18 09:01"), ("act", "18 09:02")],
    "u3": [("signup", "18 08:00"), ("vpv", "18 09:00"), ("signup", "18 10:00")],
    "u4": [("vpv", "18 09:00"), ("act", "18 09:05")],
    "u5": [("signup", "18 08:00"), ("vpv", "18 09:00"), ("act", "18 10:00")],
}


def per_stage(df):
    found = {r["stage_name"]: r["unique_users"] for r in df.groupBy("stage_name").agg(F.sum("unique_users").alias("unique_users")).collect()}
    return [found.get(s, 0) for s in STAGES]


def test_four_semantics_differ(spark):
    df = events(spark, [(u, n, t) for u, rows in SEMANTICS.items() for n, t in rows])
    assert per_stage(funnel.canonical_daily(df, "2026-08-18", "2026-08-18")) == [4, 1, 3, 1]
    assert per_stage(funnel.canonical_daily(df, "2026-08-18", "2026-08-18", mode="per_day")) == [4, 1, 3, 1]
    assert per_stage(funnel.pure_daily(df)) == [4, 2, 4, 1]
    assert list(funnel.strict_counts(df).first())[1:] == [4, 2, 1, 1]
    assert list(funnel.unordered_daily(df).first())[2:] == [4, 4, 4, 1]


def test_dedupe_rules_differ(spark):
    df = events(spark, [("u", "vpv", "18 09:00"), ("u", "vpv", "18 08:00")]).withColumn("event_id", F.lit("event-1"))
    df = df.withColumn("received_at", F.when(F.col("occurred_at") == F.lit("2026-08-18 08:00").cast("timestamp_ntz"), F.lit("2026-08-18 12:00").cast("timestamp_ntz")).otherwise(F.col("received_at")))
    assert str(dedupe.silver(df).first()["occurred_at"]) == "2026-08-18 09:00:00"
    assert str(dedupe.pure(df).first()["occurred_at"]) == "2026-08-18 08:00:00"
    assert dedupe.stats(df).first()["duplicates"] == 1


def test_strict_counts_equal_the_greedy_walk(spark):
    rng = random.Random(3)
    rows = [(f"u{rng.randrange(12)}", rng.choice(list(SHORT)), f"18 {rng.randrange(24):02d}:{rng.randrange(3):02d}") for _ in range(200)]
    expected = [0, 0, 0, 0]
    for u in {r[0] for r in rows}:
        nxt = 0
        for _, n in sorted((t, list(SHORT).index(n)) for v, n, t in rows if v == u):
            if n == nxt:
                expected[nxt] += 1
                nxt += 1
                if nxt == 4:
                    break
    assert list(funnel.strict_counts(events(spark, rows)).first())[1:] == expected


def test_range_and_per_day_part_at_a_short_lookback(spark):
    df = events(spark, [("u", "vpv", "10 09:00"), ("u", "vpv", "15 09:00")])
    assert per_stage(funnel.canonical_daily(df, "2026-08-10", "2026-08-15", 1)) == [1, 0, 0, 0]
    assert per_stage(funnel.canonical_daily(df, "2026-08-10", "2026-08-15", 1, "per_day")) == [2, 0, 0, 0]
    with pytest.raises(ValueError):
        funnel.canonical_daily(df, "2026-08-15", "2026-08-10")
