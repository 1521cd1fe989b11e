"""Four funnel semantics, kept apart on purpose: they give different numbers on the same events.

canonical_daily  first time of each stage in the lookback; a stage needs the one before it at or before its time
pure_daily       first time of each stage; a stage counts if it is not before the last one that counted
strict_counts    the next stage in time order, again and again; later repeats may serve
unordered_daily  distinct users of a day and stage, in no order
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import STAGES, not_blank
from ..sources.events import scan_range
from . import dedupe

JOURNEY = ["workspace_id", "anonymous_id", "funnel_definition_version"]
GRAIN = ["workspace_id", "event_date", "funnel_definition_version", "stage_name"]


def _firsts(events: DataFrame, *keys: str) -> DataFrame:
    """t0 to t3: when each stage first occurred. One hash aggregate; partial sums leave a row for each journey and task."""
    rows = events.where(F.col("event_name").isin(STAGES))
    return rows.groupBy(*keys).agg(*[F.min(F.when(F.col("event_name") == s, F.col("occurred_at"))).alias(f"t{k}") for k, s in enumerate(STAGES)])


def _reached(firsts: DataFrame, ok: list[Column], *keep: str) -> DataFrame:
    """A row for each journey and stage that qualifies, with its time: one pass instead of a union of four."""
    stages = F.array(*[F.when(c, F.struct(F.lit(s).alias("stage_name"), F.col(f"t{k}").alias("at"))) for k, (s, c) in enumerate(zip(STAGES, ok, strict=True))])
    rows = firsts.select(*keep, F.explode(F.filter(stages, lambda x: x.isNotNull())).alias("s"))
    return rows.select(*keep, "s.stage_name", "s.at", F.to_date("s.at").alias("event_date"))


def _pairs() -> list[Column]:
    """Whether each stage qualifies: it is not before the one ahead of it, and the first one needs only be there."""
    return [F.col("t0").isNotNull(), *[F.col(f"t{k}") >= F.col(f"t{k - 1}") for k in (1, 2, 3)]]


def canonical_daily(events: DataFrame, start: str, end: str, lookback_days: int = 30, mode: str = "range") -> DataFrame:
    """Unique users of each workspace, day, version and stage between two days.

    mode "range": firsts over [start - lookback, end], the lookback counted from the range's start. mode "per_day": every
    day looks back for itself, so that a backfill equals the runs of its days.
    """
    if lookback_days < 1 or end < start:
        raise ValueError("the range must not end before it starts, and the lookback must be a day at least")
    rows = scan_range(events, start, end, lookback_days)
    if mode == "range":
        found = _reached(_firsts(rows, *JOURNEY), _pairs(), *JOURNEY)
        found = found.where(F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    elif mode == "per_day":
        return canonical_days(rows, [str(d) for d in span(start, end)], lookback_days)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    # a journey reaches a stage once at most, so rows are users
    return found.groupBy(*GRAIN).agg(F.count("*").alias("unique_users"))


def span(start: str, end: str) -> list[date]:
    """The days from start to end."""
    first = date.fromisoformat(start)
    return [first + timedelta(days=k) for k in range((date.fromisoformat(end) - first).days + 1)]


def within_lookback(days: Iterable[str], lookback_days: int, back: bool = False) -> set[str]:
    """The days whose lookback holds one of `days`; with `back`, those that the lookback of one of `days` holds."""
    return {str(date.fromisoformat(d) + timedelta(days=-k if back else k)) for d in days for k in range(lookback_days + 1)}


def canonical_days(events: DataFrame, days: Iterable[str], lookback_days: int = 30) -> DataFrame:
    """Unique users of each workspace, day, version and stage on the given days, each of which looks back for itself.

    A journey's events are reduced to one row a day first, and only these rows are copied to the days that look back on
    them, so a journey costs its active days times the lookback, not its events.
    """
    days = sorted(days)
    wanted = F.array(*[F.lit(d).cast("date") for d in days]) if days else F.array().cast("array<date>")
    daily = _firsts(events.withColumn("day", F.to_date("occurred_at")), *JOURNEY, "day")
    targets = F.filter(wanted, lambda d: (d >= F.col("day")) & (d <= F.date_add("day", lookback_days)))
    copies = daily.withColumn("target", F.explode(targets))
    firsts = copies.groupBy(*JOURNEY, "target").agg(*[F.min(f"t{k}").alias(f"t{k}") for k in range(len(STAGES))])
    found = _reached(firsts, _pairs(), *JOURNEY, "target").where("event_date = target")
    return found.groupBy(*GRAIN).agg(F.count("*").alias("unique_users"))


def pure_daily(events: DataFrame) -> DataFrame:
    """Daily unique users after the pure deduplication; a missing or early stage is passed over, not blocking."""
    firsts = _firsts(dedupe.pure(events), *JOURNEY)
    last: Column = F.lit(None).cast("timestamp_ntz")
    ok = []
    for k in range(len(STAGES)):
        t = F.col(f"t{k}")
        good = t.isNotNull() & (last.isNull() | (t >= last))
        ok.append(good)
        last = F.when(good, t).otherwise(last)
    return _reached(firsts, ok, *JOURNEY).groupBy(*GRAIN).agg(F.count("*").alias("unique_users"))


def strict_counts(events: DataFrame, *scope: str) -> DataFrame:
    """u0 to u3: users of each scope who came so far in strict order. Windows share one partitioning: one shuffle."""
    scope = scope or ("workspace_id",)
    rows = events.where(F.col("event_name").isin(STAGES) & not_blank("anonymous_id") & F.col("occurred_at").isNotNull())
    w = Window.partitionBy(*scope, "anonymous_id")
    for k, s in enumerate(STAGES):
        hit = F.col("event_name") == s
        rows = rows.withColumn(f"t{k}", F.min(F.when(hit & (F.col("occurred_at") >= F.col(f"t{k - 1}")) if k else hit, F.col("occurred_at"))).over(w))
    users = rows.groupBy(*scope, "anonymous_id").agg(*[F.first(f"t{k}").alias(f"t{k}") for k in range(4)])
    return users.groupBy(*scope).agg(*[F.count(f"t{k}").alias(f"u{k}") for k in range(4)])


def unordered_daily(events: DataFrame, *scope: str) -> DataFrame:
    """Distinct users of each day and stage, a column per stage, 0 where there are none."""
    scope = scope or ("workspace_id",)
    rows = events.where(F.col("event_name").isin(STAGES) & not_blank("anonymous_id") & F.col("occurred_at").isNotNull())
    users = rows.select(*scope, F.to_date("occurred_at").alias("event_date"), "event_name", "anonymous_id").distinct()
    return users.groupBy(*scope, "event_date").agg(*[F.count_if(F.col("event_name") == s).alias(s) for s in STAGES])
