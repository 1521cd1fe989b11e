"""Near-duplicate join on word shingles: chosen paths, block-wise verification and connected classes."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import Workspace, arrow_map, mix64, small_batches, table

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.99
#: Levels of splitting, members of a bucket that is not split further, members of a block that one task compares.
DEPTH, SMALL, BLOCK = 3, 256, 256
#: Buckets that stay larger although less than this share of their pairs may be similar are split on twice as many levels,
#: up to so many; a bucket is judged by the pairs of about so many of its members. Up to so many times a
#: small one it is compared as it is: a set then meets so many times the pairs at most, less work than deeper trees.
CROWDED, MAX_DEPTH, JUDGED, CHEAP = 0.125, 24, 64, 8
BINS = 128  # bytes of a one-permutation sketch
#: Shingles of a block that are counted at once, and rows with words that go to Python at once.
PART, WORD_ROWS = 250_000, 128
#: Bits of the mask (4 MB) by which the rows of few documents are picked before they are dealt.
MASK = 1 << 25
_FULL = float(2**64)


def survival(threshold: float, depth: int) -> float:
    """Least chance that a pair of this similarity shares a path of so many steps: a branching process of mean 1."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return p


def runs_for(recall: float, threshold: float = SIMILARITY, depth: int = DEPTH) -> int:
    """Repetitions after which a pair at the threshold is found with this chance, wherever its buckets end."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, depth)))


_word_ids: dict[bytes, int] = {}


def word_hashes(text: str | None) -> np.ndarray:
    """A 32-bit hash of each word of a whole text, in order."""
    known = _word_ids
    if len(known) > 100_000:  # a worker's memory stays the same however many words there are
        known.clear()
    out = []
    for w in (text or "").encode("utf-8", "surrogatepass").split():
        h = known.get(w)
        if h is None:
            h = known[w] = zlib.crc32(w)
        out.append(h)
    return np.array(out, np.uint32)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of all windows of `size` words; a shorter text is one shingle, no words are none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    w = words.astype(np.uint64)
    n = max(1, len(w) - size + 1)
    h = np.full(n, len(w) if len(w) < size else size, np.uint64)
    for k in range(min(size, len(w))):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n])
    return np.unique(h)


def sketch(tokens: np.ndarray) -> bytes:
    """Low byte of the least hash in each of 128 bins, 0 where there is none."""
    h = mix64(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    h.sort()
    bins = (h >> np.uint64(57)).astype(np.int64)
    first = np.concatenate(([True], bins[1:] != bins[:-1])) if len(h) else np.zeros(0, bool)
    out = np.zeros(BINS, np.uint8)
    out[bins[first]] = (h[first] % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return out.tobytes()


def roots(runs: int) -> np.ndarray:
    return mix64(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def steps(tokens: np.ndarray, at: np.ndarray, level: int, threshold: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of this level to which a set goes on from nodes of the one above, and from which of these."""
    limit = np.uint64(min(_FULL * (1 - 2**-53), _FULL / (threshold * max(1, len(tokens)))))
    factor = np.uint64(0x9E3779B97F4A7C15)
    found, origin = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for start in range(0, len(at), 8):  # a few nodes at once: memory stays a few times the set
        some = at[start : start + 8]
        h = (tokens[None, :] ^ some[:, None]) * factor
        h ^= h >> np.uint64(32)
        h *= factor
        i, j = np.nonzero(h < limit)
        found.append(mix64(some[i] + mix64(tokens[j] + np.uint64(level))))
        origin.append(some[i])
    return np.concatenate(found), np.concatenate(origin)


def paths(tokens: np.ndarray, runs: int, threshold: float = SIMILARITY, depth: int = DEPTH) -> tuple[list[int], list[int], list[int]]:
    """Nodes of the set's trees in all runs: level, path and parent path (as signed 64-bit integers).

    From each node the set goes on with each of its tokens whose hash with the path falls under 1 / (threshold * size).
    """
    levels: list[int] = []
    nodes: list[np.ndarray] = []
    parents: list[np.ndarray] = []
    if not len(tokens):
        return [], [], []
    at = roots(runs)
    for level in range(1, depth + 1):
        children, origin = steps(tokens, at, level, threshold)
        nodes.append(children)
        parents.append(origin)
        levels += [level] * len(children)
        at = children
        if not len(at):
            break
    flat = lambda x: np.concatenate(x).view(np.int64).tolist()
    return levels, flat(nodes), flat(parents)


def text_id(column: str = "text") -> Column:
    """A 64-bit hash of a text: with the doc_id it names a row, up to repeated ones."""
    return F.xxhash64(F.col(column).cast("string"))


def _signatures(docs: DataFrame, runs: int) -> DataFrame:
    """doc_id, text_id, fingerprint of the shingle set, its size, word hashes, sketch and nodes of each document."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "text_id", "fp", "size", "words", "sketch", "levels", "nodes", "parents")}
        for doc_id, row_text, text in zip(rows["doc_id"], rows["text_id"], rows["text"], strict=True):
            words = word_hashes(text)
            tokens = shingles(words)
            # two independent sums over the mixed set make a 63-bit fingerprint
            fp = int(mix64(np.array([mix64(tokens).sum(dtype=np.uint64) ^ mix64(np.array([np.bitwise_xor.reduce(mix64(tokens ^ np.uint64(0x5851F42D4C957F2D)))]))[0]], np.uint64))[0]) if len(tokens) else 0
            levels, nodes, parents = paths(tokens, runs)
            for k, v in zip(out, (doc_id, row_text, fp >> 1, len(tokens), words.tobytes(), sketch(tokens), levels, nodes, parents), strict=True):
                out[k].append(v)
        return out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id().alias("text_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, text_id long, fp long, size long, words binary, sketch binary, levels array<int>, nodes array<long>, parents array<long>", rows=500)


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, in rows sorted by them; a run may go over several batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _alike(size: np.ndarray, sketches: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, least: int = 64) -> np.ndarray:
    """Which pairs (i, j) may be similar by their sizes and, for sets of `least` shingles or more, by their sketches."""
    ok = np.zeros(len(i), bool)
    for a in range(0, len(i), 20_000):
        k, m = i[a : a + 20_000], j[a : a + 20_000]
        x, y = sketches[k], sketches[m]
        small, large = np.minimum(size[k], size[m]), np.maximum(size[k], size[m])
        same, some = ((x == y) & (x > 0)).sum(1), ((x > 0) | (y > 0)).sum(1)
        error = 5 * np.sqrt(threshold * (1 - threshold) / np.maximum(some, 1))
        ok[a : a + 20_000] = (small >= threshold * large) & ((same >= (threshold - error) * some) | (small < least))
    return ok


def _candidates(t: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of a block's rows that this block decides, and i's and j's side.

    A pair belongs to the least of the leaves that both sets reach, so it is decided once. Sizes and, for sets of 64
    shingles or more, sketches must allow the similarity (a sketch errs by at most five of its standard errors).
    """
    leaf, n = t["leaf"][0].as_py(), t.num_rows
    side = t["side"].to_numpy()
    i, j = np.triu_indices(n, 1)
    one, other = t["one"][0].as_py(), t["other"][0].as_py()
    if one != other:
        keep = side[i] != side[j]
        i, j = i[keep], j[keep]
    size = t["size"].to_numpy()
    keep = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
    i, j = i[keep], j[keep]
    if len(i):
        # leaves below this one, as rows of a 0/1 matrix
        lower = [[x for x in leaves if x < leaf] for leaves in t["leaves"].to_pylist()]
        ids = {x: k for k, x in enumerate(sorted({x for row in lower for x in row}))}
        if ids:
            m = np.zeros((n, len(ids)), np.float32)
            for k, row in enumerate(lower):
                m[k, [ids[x] for x in row]] = 1
            keep = (m @ m.T)[i, j] == 0
            i, j = i[keep], j[keep]
    if len(i):
        s = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(n, BINS)
        ok = _alike(size, s, i, j, threshold)
        i, j = i[ok], j[ok]
    return i, j, side


def _linked(t: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a block whose exact Jaccard similarity reaches the threshold."""
    i, j, _ = _candidates(t, threshold)
    if not len(i):
        return i, j
    sets = [shingles(np.frombuffer(w, np.uint32)) for w in t["words"].to_pylist()]
    sizes = np.array([len(s) for s in sets])
    if len(i) <= 4 * len(sets):
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)])
    else:
        product = np.zeros((len(sets), len(sets)), np.float32)
        parts = max(1, int(sizes.sum()) // PART)
        edges = [np.uint64(k * 2**64 // parts) for k in range(parts)]
        cuts = [np.append(np.searchsorted(x, edges), len(x)) for x in sets]
        for p in range(parts):  # sets are sorted, so a range of hashes is a slice of each
            some = [x[c[p] : c[p + 1]] for x, c in zip(sets, cuts, strict=True)]
            every, place = np.unique(np.concatenate(some), return_inverse=True)
            row = np.repeat(np.arange(len(sets)), [len(x) for x in some])
            shared = np.flatnonzero(np.bincount(place, minlength=len(every)) > 1)  # the others add nothing
            column = np.full(len(every), -1)
            column[shared] = np.arange(len(shared))
            for a in range(0, len(shared), 4096):
                inside = (column[place] >= a) & (column[place] < a + 4096)
                m = np.zeros((len(sets), min(4096, len(shared) - a)), np.float32)
                m[row[inside], column[place[inside]] - a] = 1
                product += m @ m.T
        common = product[i, j].astype(np.int64)
    keep = common >= threshold * (sizes[i] + sizes[j] - common) - 1e-9
    return i[keep], j[keep]


def _by_block(rows: DataFrame, fn, schema: str) -> DataFrame:
    """fn over the rows of each block, as an Arrow table, within sorted partitions."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ("leaf", "one", "other")):
            yield from fn(t).cast(out).to_batches()

    keys = ("leaf", "one", "other")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "fp", "side").mapInArrow(run, schema)


def _split(rows: DataFrame, grow: Callable[[DataFrame, DataFrame, int], DataFrame], depth: int, space: Workspace, name: str) -> DataFrame:
    """(fp, leaf, n) of the leaves of trees: buckets of 2 to 256 sets, and all of the last level.

    `rows` are the sets at the first level's nodes (fp, leaf); grow gives those of a level from the rows and the large nodes
    (leaf) of the one above.
    """
    leaves: DataFrame | None = None
    for level in range(1, depth + 1):
        rows = space.save(rows.select("fp", "leaf"), f"{name}-nodes{level}")
        counts = space.save(rows.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1"), f"{name}-counts{level}")
        # the hint keeps one plan at every size: the counts grow with the rows
        found = rows.join((counts if level == depth else counts.where(F.col("n") <= SMALL)).hint("merge"), "leaf")
        leaves = found if leaves is None else leaves.unionByName(found)
        if level == depth:
            break
        # at most one for 256 rows: as a table of its own it is small, so the rows of the next level are not dealt to meet it
        large = space.save(counts.where(F.col("n") > SMALL).select("leaf"), f"{name}-large{level}")
        if large.isEmpty():
            break
        rows = grow(rows, large, level + 1)
    return space.save(leaves.select("fp", "leaf", "n"), f"{name}-leaves")


def _crowded(leaves: DataFrame, brief: DataFrame, threshold: float, space: Workspace, name: str) -> DataFrame:
    """The leaves of more than eight small ones hardly any of whose pairs can be similar, judged by about 64 members: a passage that many share.

    In the others, families of near copies, further splitting would part little: comparing their blocks looks at no
    more than eight times the pairs that may be similar.
    """
    picked = leaves.where((F.col("n") > CHEAP * SMALL) & (F.pmod(F.xxhash64("leaf", "fp"), F.lit(1 << 31)) < F.lit(float(JUDGED << 31)) / F.col("n")))
    members = space.save(picked.select("fp", "leaf"), f"{name}-picked").join(brief, "fp").groupBy("leaf").agg(F.collect_list("size").alias("sizes"), F.collect_list("sketch").alias("sketches"))

    def judge(rows: dict[str, list]) -> dict[str, list]:
        shares = []
        for sizes, sketches in zip(rows["sizes"], rows["sketches"], strict=True):
            i, j = np.triu_indices(len(sizes), 1)
            shares.append(float(_alike(np.array(sizes), np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, BINS), i, j, threshold, 0).mean()) if len(i) else 1.0)
        return {"leaf": rows["leaf"], "share": shares}

    return arrow_map(members, judge, "leaf long, share double", rows=100).where(F.col("share") < CROWDED).select("leaf")


def _leaves(sigs: DataFrame, sets: DataFrame, brief: DataFrame, space: Workspace, threshold: float, recall: float) -> DataFrame:
    """(fp, leaf, n) of all leaves. Sets of crowded leaves get trees of twice the depth, with the runs that these need.

    Both sets of a pair that only meets in crowded leaves get them, so the recall is kept; what is crowded at the last
    depth is compared block by block.
    """
    # One document stands for its set: the partial aggregate sheds copies before rows are dealt.
    nodes = sigs.where("size > 0").select("fp", F.explode(F.arrays_zip("levels", "nodes", "parents")).alias("n"))
    nodes = nodes.select("fp", F.col("n.levels").alias("level"), F.col("n.nodes").alias("leaf"), F.col("n.parents").alias("parent")).distinct()
    at = lambda level: nodes.where(F.col("level") == level)
    leaves = _split(at(1), lambda _, large, level: at(level).join(large.withColumnRenamed("leaf", "parent"), "parent", "left_semi"), DEPTH, space, f"depth{DEPTH}")
    depth, kept = DEPTH, []
    while depth < MAX_DEPTH and not leaves.where(F.col("n") > CHEAP * SMALL).isEmpty():
        crowded = space.save(_crowded(leaves, brief, threshold, space, f"depth{depth}"), f"depth{depth}-crowded")
        if crowded.isEmpty():
            break
        kept.append(leaves.join(crowded, "leaf", "left_anti"))
        affected = leaves.join(crowded, "leaf", "left_semi").select("fp").distinct()
        depth = min(2 * depth, MAX_DEPTH)
        words = _words(affected, sigs, sets, space, f"depth{depth}")
        leaves = _split(_first_nodes(words, runs_for(recall, threshold, depth), threshold), _next_nodes(words, threshold), depth, space, f"depth{depth}")
    rows = reduce(DataFrame.unionByName, [*kept, leaves]).select("fp", "leaf")
    return _merged(space.save(rows.distinct() if kept else rows, "leaves"), space)  # a leaf of one depth may come again at another


def _first_nodes(words: DataFrame, runs: int, threshold: float) -> DataFrame:
    def run(rows: dict[str, list]) -> dict[str, list]:
        return {"fp": rows["fp"], "at": [steps(shingles(np.frombuffer(w, np.uint32)), roots(runs), 1, threshold)[0].view(np.int64) for w in rows["words"]]}

    return arrow_map(words, run, "fp long, at array<long>", rows=WORD_ROWS).select("fp", F.explode("at").alias("leaf"))


def _next_nodes(words: DataFrame, threshold: float) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """Grows a tree from its large nodes only: written out whole, 24 levels are tens of thousands of nodes a set.

    Of the steps from a bucket of a shared passage only those along its own words meet many sets again, so a set whose
    passage is under 0.8 of it stays in fewer and fewer large nodes.
    """

    def grow(rows: DataFrame, large: DataFrame, level: int) -> DataFrame:
        def run(batch: dict[str, list]) -> dict[str, list]:
            made = [steps(shingles(np.frombuffer(w, np.uint32)), np.array(at, np.int64).view(np.uint64), level, threshold)[0].view(np.int64) for w, at in zip(batch["words"], batch["at"], strict=True)]
            return {"fp": batch["fp"], "at": made}

        here = rows.join(large, "leaf", "left_semi").groupBy("fp").agg(F.collect_list("leaf").alias("at"))
        return arrow_map(here.join(words, "fp"), run, "fp long, at array<long>", rows=WORD_ROWS).select("fp", F.explode("at").alias("leaf"))

    return grow


def _merged(rows: DataFrame, space: Workspace) -> DataFrame:
    """The same leaves (fp, leaf) with fewer rows: of small leaves with equal members one stays, large ones with the same least member are one.

    Near copies meet in many leaves of every run. No pair is lost: both sets of a pair stay together in what remains of
    each of their leaves.
    """
    marks = rows.groupBy("leaf").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("mark"), F.bit_xor(F.xxhash64(F.lit(7), "fp")).alias("mark2"), F.min("fp").alias("least"))
    marks = space.save(marks, "marks")
    small = marks.where(F.col("n") <= SMALL).groupBy("n", "mark", "mark2").agg(F.min("leaf").alias("leaf")).select("leaf", F.col("leaf").alias("to"))
    large = marks.where(F.col("n") > SMALL).select("leaf", F.xxhash64(F.lit(5), "least").alias("to"))
    # written before they are joined, so that Spark can split a leaf with very many sets
    merged = rows.join(space.save(small.unionByName(large), "merges"), "leaf").select("fp", F.col("to").alias("leaf")).distinct()
    merged = space.save(merged, "merged")
    return merged.join(space.save(merged.groupBy("leaf").agg(F.count("*").alias("n")), "merged-counts"), "leaf")


def _likely(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are wanted, and some others: a mask of one bit for each hash of a wanted key goes to all tasks.

    The mask is 1024 rows of 4 KB at most however many keys are wanted; the more, the more other rows pass.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(MASK)) + 1
    part, at = F.bitmap_bucket_number(bit), F.bitmap_bit_position(bit)
    mask = wanted.select(part.alias("_part"), at.alias("_at")).groupBy("_part").agg(F.bitmap_construct_agg("_at").alias("_mask"))
    found = rows.withColumns({"_part": part, "_at": at}).join(F.broadcast(mask), "_part")
    return found.where("getbit(cast(conv(hex(substring(_mask, cast(_at div 8 as int) + 1, 1)), 16, 10) as int), cast(_at % 8 as int)) = 1").select(*rows.columns)


def _words(wanted: DataFrame, sigs: DataFrame, sets: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(fp, words) of the wanted sets (fp): only one copy of each brings its words.

    doc_ids may repeat or be null, so the copies are dropped by fp. The hint keeps one plan at every size: past the
    broadcast limit the words are dealt by a shuffle anyway. Most words that nobody wants are left out before that.
    """
    need = space.save(wanted.join(sets.select("fp", F.col("first").alias("doc_id")), "fp"), f"{name}-needed")
    one = need.select(F.col("fp").alias("_fp"), F.col("doc_id").alias("_id"))
    words = _likely(sigs.where("size > 0").select("fp", "doc_id", "words"), need, ["fp", "doc_id"])
    # `need` has a row a set; a left_semi join would be moved below the mask
    words = words.join(one.hint("merge"), (F.col("fp") == F.col("_fp")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return space.save(words.groupBy("fp").agg(F.first("words").alias("words")), f"{name}-words")


def _blocks(leaves: DataFrame, brief: DataFrame, threshold: float) -> DataFrame:
    """(fp, leaf, one, other, side): the pairs of blocks in which each set of a leaf is compared.

    A leaf of at most 256 sets is one block. Larger ones are parted by size classes, each so wide that similar sets lie
    in the same or in neighbouring ones, and classes into blocks of about 256: only blocks of such classes meet.
    """
    small = leaves.where(F.col("n") <= SMALL).select("fp", "leaf", *[F.lit(0).cast("long").alias(c) for c in ("one", "other", "side")])
    width = math.log(1 / threshold) * (1 + 1e-9)
    rows = leaves.where(F.col("n") > SMALL).select("fp", "leaf").join(brief.select("fp", F.floor(F.log("size") / width).cast("long").alias("class")), "fp")
    counts = rows.groupBy("leaf", "class").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    near = counts
    for step, name in ((-1, "below"), (1, "above")):
        near = near.join(counts.select("leaf", (F.col("class") - step).alias("class"), F.col("blocks").alias(name)), ["leaf", "class"], "left")
    rows = rows.join(near, ["leaf", "class"])
    named = lambda step, n: F.when(F.col(n).isNotNull(), F.transform(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1), lambda k: (F.col("class") + step) * (1 << 32) + k))
    none = F.array().cast("array<bigint>")
    partners = F.concat(named(0, "blocks"), F.coalesce(named(-1, "below"), none), F.coalesce(named(1, "above"), none))
    rows = rows.withColumn("side", F.col("class") * (1 << 32) + F.pmod(F.xxhash64(F.lit(3), "fp"), F.col("blocks").cast("long")))
    rows = rows.repartition("fp").withColumn("partner", F.explode(partners))  # rows of one leaf lie in many tasks
    return small.unionByName(rows.select("fp", "leaf", F.least("side", "partner").alias("one"), F.greatest("side", "partner").alias("other"), "side"))


def link(docs: DataFrame, space: Workspace, threshold: float = SIMILARITY, recall: float = RECALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures, sets (fp, first doc_id, copies) and links (fp, root, n) of a chosen-path similarity join.

    Equal shingle sets are one set. In every run a set descends along sampled tokens that it shares with others;
    buckets of at most 256 sets become leaves, larger ones are split again, three times at first, and then on more levels
    where nearly all of a bucket's pairs differ. Families of near copies, which no splitting parts, are compared in blocks of
    256 sets of similar size, so no bucket is cut short and no task gathers one. Of the pairs only counts leave a block:
    each set with the number of partners that the block decided, and its root in the block. Every pair is decided by
    exact similarity.
    """
    with small_batches(docs.sparkSession):
        sigs = space.save(_signatures(docs, runs_for(recall, threshold)), "signatures")
    sets = space.save(sigs.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.max("size").alias("size"), F.first("sketch").alias("sketch")), "sets")
    brief = sets.where("size > 0").select("fp", "size", "sketch")
    with small_batches(docs.sparkSession, WORD_ROWS):
        leaves = space.save(_leaves(sigs, sets, brief, space, threshold, recall), "all-leaves")
    reached = leaves.groupBy("fp").agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))  # a few for each run
    rows = space.save(_blocks(leaves, brief, threshold).join(reached, "fp"), "blocks").join(brief, "fp")

    def narrow(t: pa.Table) -> pa.Table:
        i, j, _ = _candidates(t, threshold)
        return t.take(pa.array(np.unique(np.concatenate([i, j])))).select(names)

    names = ["fp", "leaf", "leaves", "one", "other", "side", "size", "sketch"]
    schema = "fp long, leaf long, leaves array<long>, one long, other long, side long, size long, sketch binary"
    with small_batches(docs.sparkSession):
        wanted = space.save(_by_block(rows.select(*names), narrow, schema), "candidates")
    words = _words(wanted.select("fp").distinct(), sigs, sets, space, "candidates")

    def decide(t: pa.Table) -> pa.Table:
        i, j = _linked(t, threshold)
        fps, n = t["fp"].to_numpy(), t.num_rows
        counts = np.bincount(np.concatenate([i, j]).astype(np.int64), minlength=n)
        root = np.arange(n)

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                a, b = (a, b) if fps[a] <= fps[b] else (b, a)
                root[b] = a
        hit = np.flatnonzero(counts)
        return pa.table({"fp": fps[hit], "root": fps[[find(k) for k in hit.tolist()]] if len(hit) else fps[:0], "n": counts[hit].astype(np.int64)})

    with small_batches(docs.sparkSession, WORD_ROWS):
        links = space.save(_by_block(wanted.join(words, "fp"), decide, "fp long, root long, n long"), "links")
    return sigs, sets, links


def components(edges: DataFrame, space: Workspace, rounds: int = 60) -> DataFrame:
    """(node, label) of all nodes of edges (a, b): the least node of each connected component, by alternating stars.

    Each round writes its edges, so lineage stays short; joins are on written tables, whose hot hubs Spark can split. It is
    over once all edges lead from nodes with one edge straight to a root.
    """

    def star(e: DataFrame, large: bool, k: int) -> DataFrame:
        both = e.select("a", "b")
        both = both.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        both = space.save(both.where("a <> b").distinct(), f"both{k}{large:d}")
        least = space.save(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), f"least{k}{large:d}")
        joined = both.join(least, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))

    edges = space.save(edges.where("a <> b").select("a", "b").distinct(), "edges")
    for k in range(rounds):
        edges = star(edges, True, k)
        edges = space.save(star(edges, False, k).where("a <> b").distinct(), f"edges{k}")
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out")))
        if ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("least")).where("out > 1 or (out = 1 and least = 0)").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _classes(docs: DataFrame, threshold: float, recall: float, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """Signatures, and fp, label (of the class), class_id, rep_id, n_copies and n_links of each set that has shingles."""
    sigs, sets, links = link(docs, space, threshold, recall)
    labels = components(links.select(F.col("fp").alias("a"), F.col("root").alias("b")), space)
    counts = links.groupBy("fp").agg(F.sum("n").alias("n_links"))
    known = sets.where("size > 0").join(labels.withColumnRenamed("node", "fp"), "fp", "left").join(counts, "fp", "left")
    known = known.withColumn("label", F.coalesce("label", "fp")).withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    known = space.save(known, "known")
    least = space.save(known.groupBy("label").agg(F.min("first").alias("class_id")), "least")
    known = known.join(least, "label").select("fp", "label", "class_id", F.col("first").alias("rep_id"), F.col("copies").alias("n_copies"), "n_links")
    return sigs, space.save(known, "classes")


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, recall: float = RECALL, space: Workspace | None = None) -> DataFrame:
    """doc_id, class_id, rep_id, n_copies and n_links of every row.

    Two texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. class_id is the
    least doc_id of a connected class of links, rep_id that of the documents with an equal set, n_copies their number,
    and n_links the number of different sets that the document's set is linked to. Texts without words (null, empty)
    have an empty set: they are copies of nothing, each is a class of its own. Texts of one to four words are one shingle.
    Repeated rows are copies; an empty table gives no rows. The result reads tables of `space`.
    """
    space = space or Workspace(docs.sparkSession, "jaccard")
    sigs, known = _classes(docs, threshold, recall, space)
    some = sigs.where("size > 0").select("fp", "doc_id").join(known, "fp").select("doc_id", "class_id", "rep_id", "n_copies", "n_links")
    none = sigs.where("size = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("rep_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return some.unionByName(none)


def representatives(docs: DataFrame, space: Workspace, threshold: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id and text_id of one row of each class: with the least doc_id, and of those the least text_id.

    The class is that of the links, so neither a null nor a repeated doc_id stands for more than its row. Rows without
    words are classes of their own; repeated ones come out once. The result reads tables of `space`.
    """
    sigs, known = _classes(docs, threshold, recall, space)
    rows = sigs.where("size > 0").select("fp", "doc_id", "text_id").join(known.select("fp", "label", "class_id"), "fp")
    rows = rows.where(F.col("doc_id").eqNullSafe(F.col("class_id")))  # all of a class have the same doc_id from here on
    some = rows.groupBy("label").agg(F.min("doc_id").alias("doc_id"), F.min("text_id").alias("text_id")).drop("label")
    return some.unionByName(sigs.where("size = 0").select("doc_id", "text_id").distinct())


def op5_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
