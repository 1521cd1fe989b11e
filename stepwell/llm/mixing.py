"""Mixing sources to target weights by capped water-filling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Workspace, table

#: Weights of the sources in the order of their code points, repeating.
WEIGHTS = (5, 2, 1)
#: Hexadecimal digits of the seeded order by which each level of the plan splits the bucket that it looks into.
DIGITS = (2, 3)


def water_fill(sources: DataFrame, share: Column, epochs: int) -> DataFrame:
    """Adds `target` to rows of (source_size, weight): shares of `share` by weight, none above epochs * source_size.

    Sources are clamped in the order of cap / weight. The clamped ones are the shortest prefix after which what is left,
    dealt by weight, keeps every other source within its cap; a clamped source's excess goes to the rest by weight.
    There is one row per source, so one task sees them all.
    """
    cap = F.col("source_size") * epochs
    order = Window.orderBy(cap / F.col("weight"), "rank")
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = sources.withColumn("_cap", cap).withColumn("_share", share)
    rows = rows.withColumn("_before", F.coalesce(F.sum("_cap").over(prior), F.lit(0)))
    rows = rows.withColumn("_weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(prior), F.lit(0)))
    # The row is the first unclamped one if its level, shared with all later ones, is within its cap.
    rows = rows.withColumn("_fits", (F.col("_share") - F.col("_before")) * F.col("weight") / F.col("_weights") <= F.col("_cap"))
    level = F.min(F.when(F.col("_fits"), F.struct(F.col("_cap") / F.col("weight"), F.col("rank"), F.col("_before").alias("b"), F.col("_weights").alias("w")))).over(everything)
    rows = rows.withColumn("_level", level)
    mine = F.struct(F.col("_cap") / F.col("weight"), F.col("rank"))
    first = F.struct(F.col("_level.col1"), F.col("_level.rank"))
    free = F.col("_level").isNotNull() & (mine >= first)
    target = F.when(free, (F.col("_share") - F.col("_level.b")) * F.col("weight") / F.col("_level.w")).otherwise(F.col("_cap").cast("double"))
    return rows.withColumn("target", target).drop("_cap", "_share", "_before", "_weights", "_fits", "_level")


def measured(docs: DataFrame, seed: int) -> DataFrame:
    """Adds _source, _size (words) and _order (seeded MD5 of doc_id and text, so rows that share an id lie apart)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary"))).cast("binary"))
    return docs.withColumn("_source", F.col("source")).withColumn("_size", F.regexp_count(text, F.lit(WORD)).cast("long")).withColumn("_order", order)


def plan_mix(rows: DataFrame, space: Workspace, percent: int = 150, epochs: int = 2) -> DataFrame:
    """Per source: source_size, target, whole (repeats of all), rest, prefix and base.

    rows have _source, _order and _size. `rest` is what the target asks beyond the whole repeats; it is used up among the
    documents whose order begins with `prefix`, before which the source holds `base`. The prefix is found digits by
    digits: each level sums the buckets inside the one that the level before it found, so no task gathers documents and
    the last bucket is a millionth of its source. A source without words has no prefix.
    """
    held = F.sum("_size").alias("held")
    sums = space.save(rows.groupBy("_source", F.substring("_order", 1, DIGITS[0]).alias("_part")).agg(held), "level0")
    sources = sums.groupBy("_source").agg(F.sum("held").alias("source_size"))
    sources = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1)
    total = F.sum("source_size").over(Window.partitionBy())
    sources = water_fill(sources.withColumn("weight", weight), total * percent / 100, epochs)
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    sources = sources.select(F.col("_source").alias("_from"), "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))
    plan = space.save(sources.withColumn("prefix", F.lit("")).withColumn("base", F.lit(0).cast("long")), "sources")
    same = F.col("_source").eqNullSafe(F.col("_from"))
    prior = Window.partitionBy("_from").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    for level in range(len(DIGITS)):
        if level:
            inside = rows.join(plan.select("_from", "prefix"), same & F.startswith(F.col("_order"), F.col("prefix")))
            sums = space.save(inside.groupBy("_source", F.substring("_order", 1, sum(DIGITS[: level + 1])).alias("_part")).agg(held), f"level{level}")
        parts = sums.join(plan, same).withColumn("_base", F.col("base") + F.coalesce(F.sum("held").over(prior), F.lit(0)))
        crossing = parts.where("_base <= rest and _base + held > rest").select(F.col("_from").alias("_of"), F.col("_part").alias("prefix"), F.col("_base").alias("base"))
        plan = plan.drop("prefix", "base").join(crossing, F.col("_from").eqNullSafe(F.col("_of")), "left").drop("_of")
        plan = space.save(plan, f"plan{level}")
    return plan


def take(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds the columns of the plan and _times, how often each row is taken, to measured rows.

    Every document is repeated `whole` times. The rest of a target goes to the first documents in the seeded order, up to
    the one that crosses it, which is taken if that comes nearer. Only the rows under a source's prefix are ordered.
    """
    rows = rows.join(plan, F.col("_source").eqNullSafe(F.col("_from"))).withColumn("_at", F.substring("_order", 1, sum(DIGITS)))
    at_prefix = F.col("_at").eqNullSafe(F.col("prefix"))
    inside = Window.partitionBy("_from").orderBy("_order", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    crossing = rows.where(at_prefix).withColumn("base", F.col("base") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    out = rows.where(~at_prefix).unionByName(crossing)
    # without a prefix the rest is nothing, or all of the source
    nearer = F.when(at_prefix, F.col("base") + F.col("_size") / 2 <= F.col("rest")).otherwise(F.coalesce(F.col("_at") < F.col("prefix"), F.col("rest") > 0))
    return out.withColumn("_times", (F.col("whole") + F.when(F.col("_size") > 0, nearer.cast("int")).otherwise(0)).cast("int"))


def mix_takes(spark: SparkSession, docs: DataFrame, seed: int = 10) -> DataFrame:
    """doc_id, source, size, source_size, target, times and taken of every document.

    Capped water-filling sets the targets, seeded whole and fractional repetitions meet them within about one document.
    A null text has size 0, a null source comes last, repeated rows count each, an empty table gives no rows.
    """
    space = Workspace(spark, "mix")
    rows = space.save(measured(docs.select("doc_id", "source", "text"), seed).drop("text"), "rows")
    out = take(rows, plan_mix(rows, space))
    return out.select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", F.col("_times").alias("times"), (F.col("_times") * F.col("_size")).alias("taken"))


def mix_rows(spark: SparkSession, docs: DataFrame, seed: int = 10) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, all columns as they are."""
    space = Workspace(spark, "mix")
    plan = plan_mix(space.save(measured(docs.select("doc_id", "source", "text"), seed).select("_source", "_order", "_size"), "rows"), space)
    rows = measured(docs.select("doc_id", "source", "text", F.struct("*").alias("_row")), seed).drop("text")
    out = take(rows, plan).where("_times > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_nth")).select("_row.*")


def op10_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix_takes(spark, docs).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('10:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, n * 2 AS cap,
    CAST(sum(n) OVER () AS BIGINT) * 150 / 100 AS share FROM s),
o AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, rank) AS k,
    CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b,
    CAST(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS left_w FROM w),
f AS (SELECT min(k) AS k FROM o WHERE (share - b) * weight / left_w <= cap),
t AS (
  SELECT o.source, o.n, CASE WHEN o.k >= f.k THEN (o.share - l.b) * o.weight / l.left_w ELSE CAST(o.cap AS DOUBLE) END AS target
  FROM o CROSS JOIN f LEFT JOIN o l ON l.k = f.k),
r AS (
  SELECT *, CASE WHEN n > 0 THEN CAST(floor(target / n) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.doc_id, d.size, r.n, r.target, r.whole, r.target - r.whole * r.n AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, n AS source_size, target,
  CAST((whole + CASE WHEN size > 0 AND base + size / 2 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM c
"""
