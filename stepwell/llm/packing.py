"""Packing documents into fixed token lengths: best fit, then swap-based local search between underfull bins."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, small_batches, table
from .tokens import encoder, slices

LENGTH, END_ID = 4096, 1
#: Pieces that one task packs together, and the share of its bins, the emptiest, that the next round packs anew.
BUCKET, OPEN = 16_000, 0.02


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what they can still take
    mask = 0  # bit r: some bin can take r more
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(int(i))
        if room > n:
            free[room - n].append(b)
            mask |= 1 << (room - n)
    return bins


class _Partners:
    """The bins that may take, by the length of a piece they hold: the largest sum that could stand in for that piece.

    Length 0 stands for no piece, that is for a bin's free room. `reach[v]` is the largest sum that the bins could take
    for a piece of length v at most, so the least piece that has to come back for a sum is found by bisection.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]  # (-room, bin, version)
        self.version: dict[int, int] = {}  # of the bins that are in; a bin's older entries are stale
        self.takes = np.full(capacity + 1, -1, np.int64)
        self.stale: set[int] = set()
        self.clock = 0

    def add(self, b: int, lengths: set[int], room: int) -> None:
        self.clock += 1
        self.version[b] = self.clock
        for v in (0, *lengths):
            heapq.heappush(self.heaps[v], (-room, b, self.clock))
        self.stale |= lengths | {0}

    def drop(self, b: int, lengths: set[int]) -> None:
        if self.version.pop(b, None) is not None:
            self.stale |= lengths | {0}

    def reach(self) -> np.ndarray:
        for v in self.stale:
            heap = self.heaps[v]
            while heap and self.version.get(heap[0][1]) != heap[0][2]:
                heapq.heappop(heap)
            self.takes[v] = v - heap[0][0] if heap else -1
        self.stale.clear()
        return np.maximum.accumulate(self.takes)

    def best(self, held: dict[int, list[int]]) -> tuple[int, list[int], int, int] | None:
        """(bin, lengths that go, length that comes back or 0, net amount) of the exchange that moves most, if any."""
        v = np.array(sorted(held), np.int64)  # different lengths that fit into a bin together: 90 at most for 4096
        n = np.array([len(held[k]) for k in v.tolist()])
        i, j = np.triu_indices(len(v))
        ok = (i != j) | (n[i] > 1)
        i, j = i[ok], j[ok]
        sums = np.concatenate([v, v[i] + v[j]])
        back = np.searchsorted(self.reach(), sums)
        net = sums - back
        k = int(net.argmax())
        if net[k] <= 0:
            return None
        out = [int(v[k])] if k < len(v) else [int(v[i[k - len(v)]]), int(v[j[k - len(v)]])]
        return self.heaps[back[k]][0][1], out, int(back[k]), int(net[k])


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Moves, swaps and two-for-one exchanges from the emptiest bins into fuller ones, until none is left.

    Each step moves the largest net amount that an exchange can move from a bin to one at least as full, so the sum of
    squared fills rises and the search ends. A pass takes the bins from the emptiest on, each against all that are at
    least as full; the search stops after a pass without an exchange, or once no fewer bins could hold the total.
    Partners are looked up by length, so neither the number of bins nor that of pieces in one limits what is tried.
    """
    held: list[dict[int, list[int]]] = []  # of each bin: length -> pieces
    for b in bins:
        held.append({})
        for k in b:
            held[-1].setdefault(int(lengths[k]), []).append(k)
    fill = [int(lengths[b].sum()) for b in bins]
    least, left = -(-sum(fill) // capacity), len(bins)

    def take(b: int, v: int) -> int:
        k = held[b][v].pop()
        if not held[b][v]:
            del held[b][v]
        return k

    moved = True
    while moved and left > least:
        moved = False
        partners = _Partners(capacity)
        queue = []
        for b, f in enumerate(fill):
            if 0 < f < capacity:
                partners.add(b, set(held[b]), capacity - f)
                queue.append((f, b))
        heapq.heapify(queue)
        equal: set[int] = set()  # bins that had nothing to give, as full as the one that gives now
        last = 0
        while queue and left > least:
            f, a = heapq.heappop(queue)
            if f != fill[a]:
                continue
            if f > last:
                for b in equal:
                    partners.drop(b, set(held[b]))
                equal, last = set(), f
            partners.drop(a, set(held[a]))
            gave = False
            while held[a] and (found := partners.best(held[a])):
                b, out, back, net = found
                partners.drop(b, set(held[b]))
                pieces_out, pieces_back = [take(a, v) for v in out], [take(b, back)] if back else []
                for to, ks in ((b, pieces_out), (a, pieces_back)):
                    for k in ks:
                        held[to].setdefault(int(lengths[k]), []).append(k)
                fill[a], fill[b] = fill[a] - net, fill[b] + net
                equal.discard(b)
                if fill[b] < capacity:
                    partners.add(b, set(held[b]), capacity - fill[b])
                    heapq.heappush(queue, (fill[b], b))
                gave = moved = True
            left -= not held[a]
            if not gave:
                partners.add(a, set(held[a]), capacity - f)
                equal.add(a)
    return [[k for ks in h.values() for k in ks] for h in held if h]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece (and its ids as 32-bit integers, if asked for).

    A document is its ids and the end id; only longer ones are cut, into full pieces and a rest. A null text counts as
    empty. uid tells repeated rows apart; it holds only once the frame is written.
    """
    fields = [("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    out = pa.schema([*fields, *([("ids", pa.binary())] if keep_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, n = encoder(tokenizer), TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            made: list[tuple] = []
            for doc_id, ids in zip(batch["doc_id"], enc.encode(batch["text"]), strict=True):
                ids = np.append(ids, np.array([end_id], enc.dtype)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), length)):
                    raw = ids[start : start + length].tobytes()
                    made.append((n, doc_id, piece, start, len(raw) // 4, zlib.crc32(raw), *([raw] if keep_ids else [])))
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "uid long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def pack(rows: DataFrame, space: Workspace, length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """Adds sequence_id and offset to rows of (uid, length, ...), each at most `length` long.

    Pieces are dealt at random into buckets of about `bucket` that a task packs by best fit and local search. The
    emptiest bins of all buckets (2 %, one at least) are then packed anew together, and so on until one bucket is left,
    so the sequences over the whole table exceed the least number about as little as those of one bucket.
    """
    schema, keep = rows.schema, rows.columns
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    done: list[DataFrame] = []
    n, level = rows.count(), 0
    while n:
        buckets = -(-n // bucket)

        last = buckets == 1

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("uid", kind="stable").reset_index(drop=True)
            sizes = pdf["length"].to_numpy(np.int64)
            bins = local_search(best_fit(sizes, length), sizes, length)
            order = np.concatenate(bins)
            counts = [len(b) for b in bins]
            offset = np.concatenate([np.cumsum(sizes[b]) - sizes[b] for b in bins])
            fill = np.array([sizes[b].sum() for b in bins])
            again = np.zeros(len(bins), bool)
            if not last:
                again[np.argsort(fill, kind="stable")[: max(1, int(OPEN * len(bins)))]] = True
                again &= fill < length
            out = pdf.iloc[order].copy()
            out["sequence_id"] = np.repeat(((level << 31) + int(pdf["_bucket"].iloc[0])) * 65536 + np.arange(len(bins)), counts)
            out["offset"] = offset
            out["_again"] = np.repeat(again, counts)
            return out.drop(columns="_bucket")

        dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(level), "uid"), F.lit(buckets)))
        packed = space.save(dealt.groupBy("_bucket").applyInPandas(run, names + ", sequence_id long, offset long, _again boolean"), f"packed{level}")
        # run() was pickled with this level's values when the frame was written
        done.append(packed.where("not _again").select(*keep, "sequence_id", "offset"))
        rows = packed.where("_again").select(*keep)
        n, level = (0 if buckets == 1 else rows.count()), level + 1
    if not done:
        return rows.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    A null text is an empty one, of the end id alone; null ids stay null. Repeated rows are packed as often as they
    come, ties between equal lengths go by the row's place in the table. An empty table gives no rows.
    """
    space = Workspace(docs.sparkSession, "packing")
    with small_batches(docs.sparkSession):
        rows = space.save(pieces(docs, tokenizer), "pieces")
    return pack(rows, space).drop("uid")


def op9_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
