"""Minimax contiguous partition of ordered atomic groups into shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, table

#: Groups lie on a line of 60-bit keys, in the order of their key.
KEY_BITS = 60


def reach(ends: np.ndarray, start: int, capacity: int) -> int:
    """How far a shard that begins at `start` gets: the last group end within capacity (in cumulative size)."""
    at = int(np.searchsorted(ends, start + capacity, side="right")) - 1
    return max(start, int(ends[at]) if at >= 0 else 0)


def feasible(ends: np.ndarray, capacity: int, shards: int) -> bool:
    """Greedy check: do all groups fit into so many contiguous shards of this capacity?"""
    at, total = 0, int(ends[-1])
    for _ in range(shards):
        at = reach(ends, at, capacity)
        if at >= total:
            return True
    return False


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """Binary search for the smallest feasible capacity."""
    ends = np.cumsum(sizes, dtype=np.int64)
    low, high = max(int(sizes.max()), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(ends, middle, shards) else (middle + 1, high)
    return low


def cut(sizes: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Ends of the shards, as numbers of groups.

    Each end is the group end nearest to an even share of what remains, within what the capacity allows: not beyond the
    greedy reach, and not before the point from which the shards that remain can still take the rest. With groups of
    equal order of magnitude this is the greedy cut; with one huge group the others still share the remaining shards.
    """
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1])
    latest, at = [total], total  # from the back: the least start from which so many shards suffice
    starts = ends - sizes
    for _ in range(shards - 1):
        i = int(np.searchsorted(starts, at - capacity, side="left"))
        at = min(at, int(starts[i])) if i < len(starts) else at
        latest.append(at)
    latest = latest[::-1]  # latest[j]: where shard j may end at the earliest
    cuts, at = [], 0
    for j in range(shards):
        share = at + (total - at) / (shards - j)
        i = int(np.searchsorted(ends, share))
        near = [int(ends[k]) for k in (i - 1, i) if 0 <= k < len(ends)] or [total]
        end = min(near, key=lambda e: abs(e - share))
        at = max(at, min(max(end, latest[j]), reach(ends, at, capacity)))
        cuts.append(int(np.searchsorted(ends, at, side="right")))
    return cuts


def _line(groups: DataFrame, shift: int) -> list[tuple[int, int]]:
    """(first key, size) of the buckets of 2**shift keys that have groups; at most the bound of the caller."""
    bucket = F.shiftright("key", shift) if shift else F.col("key")
    rows = groups.groupBy(bucket.alias("bucket")).agg(F.sum("size").alias("size")).collect()
    return sorted((r["bucket"] << shift, r["size"]) for r in rows)


def _runs(wanted: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs [first, last] of wanted places, joined over the shortest gaps until there are at most `most`."""
    at = np.flatnonzero(wanted)
    gaps = np.diff(at)
    breaks = np.flatnonzero(gaps > 1)
    if len(breaks) >= most:
        breaks = np.sort(breaks[np.argsort(-gaps[breaks], kind="stable")[: most - 1]])
    return [(int(r[0]), int(r[-1])) for r in np.split(at, breaks + 1)]


def cut_keys(groups: DataFrame, shards: int, buckets: int = 4096, gathered: int = 1 << 18) -> list[int]:
    """First keys of shards 1 to shards - 1 over groups (key, size); the capacity is the exact optimum.

    The driver sees sums of key ranges, at most about `gathered` at once. Every optimal greedy end lies in a known range
    of cumulative sizes (between the reach with the lower bound of the capacity and with its upper bound); only the
    ranges of keys there are taken apart into smaller buckets, down to single groups.
    """
    stats = groups.agg(F.sum("size"), F.max("size")).first()
    if stats[0] is None:
        return []
    total, largest = int(stats[0]), int(stats[1])
    shift = KEY_BITS - (buckets - 1).bit_length()
    line = [(k, s, shift) for k, s in _line(groups, shift)]  # first key, size, log2 of the width
    lowest = max(largest, -(-total // shards))
    while True:
        sizes = np.array([s for _, s, _ in line], np.int64)
        ends = np.cumsum(sizes)
        highest = max(lowest, smallest_capacity(sizes, shards))
        if lowest == highest:
            break
        wanted = np.zeros(len(line), bool)
        low = high = 0
        for _ in range(shards):
            low, high = reach(ends, low, lowest), min(total, high + highest)
            wanted[np.searchsorted(ends, low, side="right") : np.searchsorted(ends, high, side="left") + 1] = True
        wanted &= np.array([w > 0 for _, _, w in line])
        if not wanted.any():
            break
        runs = _runs(wanted, 32)
        ranges = [(line[i][0], line[j][0] + (1 << line[j][2])) for i, j in runs]
        inside = groups.where(" or ".join(f"(key >= {low} and key < {high})" for low, high in ranges))
        share = float(sum(high - low for low, high in ranges))
        widest = max(line[k][2] for k in np.flatnonzero(wanted))
        finer = 0 if inside.count() <= gathered else max(0, min(int(np.ceil(np.log2(share / gathered))), widest - 3))
        kept = [x for k, x in enumerate(line) if not any(i <= k <= j for i, j in runs)]
        line = sorted([*kept, *((k, s, finer) for k, s in _line(inside, finer))])
    ends = cut(sizes, highest, shards)
    return [line[e][0] if e < len(line) else 1 << KEY_BITS for e in ends[:-1]]


def assign_slots(df: DataFrame, shards: int, rows: int, window: int = 4096) -> DataFrame:
    """Adds `slot`, gapless from 0 within each shard, by running counts in salted parts and sums of their counts.

    Repeated rows are counted before they are dealt and told out again afterwards, so a row that comes very often is
    one row of its part; if it comes more than `window` times, several tasks tell it out.
    """
    salts = max(8, -(-rows // (shards * window)))
    names = df.columns
    df = df.groupBy(*names).agg(F.count("*").alias("_copies")).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(salts)))
    counts = df.groupBy(F.col("shard").alias("_shard"), F.col("_salt").alias("_part")).agg(F.sum("_copies").alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("shard", "_salt").orderBy("key", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_first", F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
    df = df.join(counts, (F.col("shard") == F.col("_shard")) & (F.col("_salt") == F.col("_part")))
    df = df.select(*names, "_copies", (F.col("_base") + F.col("_first")).alias("_slot"))
    told = lambda d, first, n: d.select(*names, F.explode(F.sequence(F.col("_slot") + first, F.col("_slot") + first + n - 1)).alias("slot"))
    zero, many = F.lit(0).cast("long"), df.where(F.col("_copies") > window)
    many = many.withColumn("_from", F.explode(F.sequence(zero, F.col("_copies") - 1, F.lit(window).cast("long")))).repartition("_slot", "_from")
    some = told(df.where(F.col("_copies") <= window), zero, F.col("_copies"))
    return some.unionByName(told(many, F.col("_from"), F.least(F.lit(window).cast("long"), F.col("_copies") - F.col("_from"))))


def minimax_shards(spark: SparkSession, docs: DataFrame, shards: int = 16) -> DataFrame:
    """Puts documents into contiguous shards of near-equal bytes; equal texts stay together.

    Groups are the equal texts, ordered by the first 60 bits of the text's SHA-256 (a null text counts as an empty one;
    texts that shared these bits would stay together too). Size: UTF-8 bytes plus 1. The largest shard is as small as
    contiguous shards of whole groups allow. Repeated rows each get a slot of their own. An empty table gives no rows.
    Returns doc_id, size, text_crc32, shard, slot.
    """
    space = Workspace(spark, "shards")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = space.save(
        docs.select(
            "doc_id",
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.conv(F.substring(F.sha2(text, 256), 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"),
        ),
        "rows",
    )
    groups = space.save(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    shard = F.lit(0)
    for key in cut_keys(groups, shards):
        shard = shard + (F.col("key") >= F.lit(key)).cast("int")
    placed = assign_slots(rows.withColumn("shard", shard), shards, rows.count())
    return placed.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def op2_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minimax_shards(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
