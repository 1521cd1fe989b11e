"""Substring dedup: repeated word windows as edges of a de Bruijn graph, compacted to paths with source coordinates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import Workspace, arrow_map, mix64, small_batches, table

#: Words of a window, and of the k-mer that names a long edge. Of the k-mers in a window the one of least hash names it.
WINDOW, KMER = 13, 6
#: Documents whose words are hashed together.
TOGETHER = 200

_STEP = 0x9E3779B97F4A7C15
_RATIO = 0xD1342543DE82EF95 - 2  # one more than twice an odd number: its powers differ in as many bits as they can
_RATIO_INVERSE = pow(_RATIO, -1, 2**64)
_SPAN = "struct<start: int, end: int, src_start: int, src_doc: long, src_tag: long, path: int>"
#: An id that is no smaller than any: that of rows without one.
LAST_ID = 2**63 - 1


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than space and \\t to \\r."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """Hashes of the words of several texts laid end to end, and of any run of them."""

    def __init__(self, texts: list[str | None]):
        split = [words_of(t) for t in texts]
        self.ends = np.cumsum([len(w) for w in split], dtype=np.int64)
        self.starts = np.concatenate(([0], self.ends[:-1])) if split else self.ends
        total = int(self.ends[-1]) if split else 0
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for words in split for w in words), np.uint64, total)
        self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hashes * _powers(_RATIO, total), dtype=np.uint64)))
        self._inverse = _powers(_RATIO_INVERSE, total + 1)

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each run of words [start, end), the same wherever the run lies."""
        return mix64((self._sums[end] - self._sums[start]) * self._inverse[start] + (end - start).astype(np.uint64) * np.uint64(_STEP))

    def kmers(self, size: int) -> np.ndarray:
        """Another hash, of the run of `size` words from each word on; runs over the end of a text are not told apart."""
        n = max(0, len(self.hashes) - size + 1)
        out = np.zeros(n, np.uint64)
        for j in range(size):
            out = mix64((out + np.uint64(_STEP)) ^ self.hashes[j : j + n])
        return out

    def window_starts(self) -> np.ndarray:
        """Where a window lies in one text."""
        return np.concatenate([np.arange(s, e - WINDOW + 1) for s, e in zip(self.starts, self.ends, strict=True) if e - s >= WINDOW] or [np.zeros(0, np.int64)])


def long_edges(words: Words) -> dict[str, np.ndarray]:
    """One edge for each run of windows that one k-mer names: kmer, around, lo and hi (its windows' starts) and text.

    `around` hashes all words that a window holding the k-mer can reach, and where the text ends among them. Two equal
    windows choose the same k-mer, so equal windows lie on edges of equal k-mers.
    """
    q = words.window_starts()
    kmers, choices = words.kmers(KMER), WINDOW - KMER + 1
    best, at = kmers[q], q.copy()
    for j in range(1, choices):
        other = kmers[q + j]
        less = other < best
        best, at = np.where(less, other, best), np.where(less, q + j, at)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.concatenate((first[1:], [len(q)])) - 1 if len(first) else first
    at, best = at[first], best[first]
    text = np.searchsorted(words.ends, at, "right")
    left, right = np.maximum(at - choices + 1, words.starts[text]), np.minimum(at + WINDOW, words.ends[text])
    reach = mix64((at - left).astype(np.uint64) * np.uint64(64) + (right - at).astype(np.uint64))
    around = mix64(words.runs(left, right) ^ reach)
    return {"kmer": best.view(np.int64), "around": around.view(np.int64), "lo": q[first] - words.starts[text], "hi": q[last] - words.starts[text], "text": text}


def _mapped(rows: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, slice_rows: int = TOGETHER) -> DataFrame:
    """Applies fn to slices of rows, as Arrow batches; it returns columns of the schema."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                made = fn(batch.slice(at, slice_rows))
                yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in out], schema=out)

    return rows.mapInArrow(run, schema)


def _ids(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy() for n in names]


def _sorted_lists(column: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The structs of all lists, each list by lo and hi, as arrays, and the list each comes from."""
    row, values = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy()), column.flatten()
    fields = {f.name: values.field(k).to_numpy() for k, f in enumerate(values.type)}
    order = np.lexsort((fields["hi"], fields["lo"], row))
    return row[order], {k: v[order] for k, v in fields.items()}


def _goes_on(*steady: np.ndarray) -> np.ndarray:
    """Whether each row has the values of the one before it; the first has none."""
    out = np.zeros(len(steady[0]), bool)
    out[1:] = np.logical_and.reduce([v[1:] == v[:-1] for v in steady])
    return out


def _adjoins(f: dict[str, np.ndarray]) -> np.ndarray:
    """Whether each edge's windows begin where those of the one before it end."""
    out = np.zeros(len(f["lo"]), bool)
    out[1:] = f["lo"][1:] == f["hi"][:-1] + 1
    return out


def _long_rows(batch: pa.RecordBatch, columns: tuple[str, ...]) -> dict[str, np.ndarray]:
    made = long_edges(Words(batch.column("text").to_pylist()))
    of = made.pop("text")
    made |= {k: _ids(batch, k)[0][of] for k in ("doc", "tag") if k in columns}
    return {k: made[k] for k in columns}


def _short_rows(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The windows of branching edges as edges of their own, named by two hashes."""
    words = Words(batch.column("text").to_pylist())
    row, f = _sorted_lists(batch.column("marks"))
    n = (f["hi"] - f["lo"] + 1).astype(np.int64)
    row = np.repeat(row, n)
    lo = np.repeat(f["lo"] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    at = lo + words.starts[row]
    kmers = np.zeros(len(at), np.uint64)
    for j in range(WINDOW):
        kmers = mix64((kmers + np.uint64(_STEP)) ^ words.hashes[at + j])
    doc, tag = (v[row] for v in _ids(batch, "doc", "tag"))
    return {"kmer": kmers.view(np.int64), "around": words.runs(at, at + WINDOW).view(np.int64), "doc": doc, "tag": tag, "lo": lo.astype(np.int32)}


def _paths(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Edges that follow each other in their source belong to one path, named by where it begins."""
    row, f = _sorted_lists(batch.column("edges"))
    begins = np.flatnonzero(~(_goes_on(row) & _adjoins(f)))
    path = np.repeat(f["lo"][begins], np.diff(begins, append=len(row)))
    doc, tag = (v[row] for v in _ids(batch, "doc", "tag"))
    return {"kmer": f["kmer"], "around": f["around"], "src_doc": doc, "src_tag": tag, "src_lo": f["lo"], "path": path}


def _spans(batch: pa.RecordBatch) -> dict[str, np.ndarray | pa.Array]:
    """Marks of a document, joined while the next lies on the same path and both places go on in step."""
    row, f = _sorted_lists(batch.column("marks"))
    steady = _goes_on(row, f["src_doc"], f["src_tag"], f["path"], f["src_lo"].astype(np.int64) - f["lo"])
    begins = np.flatnonzero(~(steady & _adjoins(f)))
    ends = np.append(begins[1:], len(row)) - 1 if len(begins) else begins
    fields = {"start": f["lo"][begins], "end": f["hi"][ends] + np.int32(WINDOW), "src_start": f["src_lo"][begins]} | {k: f[k][begins] for k in ("src_doc", "src_tag", "path")}
    bounds = np.searchsorted(row[begins], np.arange(batch.num_rows + 1)).astype(np.int32)
    doc, tag = _ids(batch, "doc", "tag")
    return {"doc": doc, "tag": tag, "spans": pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], list(fields)))}


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, doc (that id, or the last one), tag (a hash of the text) and text. Rows that agree in both are the same to this module."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"))


def repeated_spans(docs: DataFrame, space: Workspace | None = None) -> DataFrame:
    """doc, tag and spans: for each document the runs of words that documents with smaller ids hold too.

    A span has start and end (words), and the document (src_doc, src_tag) and word (src_start) where the same words
    stand first. It is covered by windows of 13 words whose sequence also starts in a document with a smaller id.

    Edges: every window lies on a long edge, named by the k-mer of least hash in it, about one edge for four words. An
    edge in two documents or more is repeated. It does not branch if all words that its windows can reach are the same
    wherever it occurs; then its windows occur in the same documents as it does. The windows of edges that branch become
    edges of their own. Each edge is known by two independent 64-bit hashes, which all its occurrences share.

    Paths: edges that follow each other where they occur first make up a path. A join gives every later occurrence its
    path and source coordinates, and those that go on in step with their source are one span.

    No edge's occurrences meet in one task: edges are aggregated map-side first, and the joins have one row an edge on
    one side. Rows of equal id and text are marked once. An empty table gives no rows.
    """
    spark = docs.sparkSession
    space = space or Workspace(spark, "spans")
    rows = identified(docs).drop("doc_id")
    first, last = F.min("doc").alias("first"), F.max("doc").alias("last")
    with small_batches(spark):
        # long edges: repeated ones, and whether they branch
        seen = _mapped(rows.select("doc", "text"), partial(_long_rows, columns=("kmer", "around", "doc")), "kmer long, around long, doc long")
        edges = seen.groupBy("kmer").agg(first, last, F.min("around").alias("around"), F.max("around").alias("_most")).where("first < last")
        edges = space.save(edges.select("kmer", "around", "first", (F.col("around") == F.col("_most")).alias("simple")), "long")
        met = _mapped(rows, partial(_long_rows, columns=("kmer", "doc", "tag", "lo", "hi")), "kmer long, doc long, tag long, lo int, hi int")
        met = space.save(met.join(edges, "kmer"), "met")
        # windows of branching edges
        marks = met.where("not simple").groupBy("doc", "tag").agg(F.collect_set(F.struct("lo", "hi")).alias("marks"))
        short = _mapped(rows.join(marks, ["doc", "tag"]), _short_rows, "kmer long, around long, doc long, tag long, lo int")
        short = space.save(short, "short")
    # a table, so that what is dealt for a very frequent window is dealt to be joined, and can be split
    firsts = space.save(short.groupBy("kmer", "around").agg(first, last).where("first < last").drop("last"), "firsts")
    names = ("kmer", "around", "first", "doc", "tag", "lo", "hi")
    found = short.join(firsts, ["kmer", "around"]).withColumn("hi", F.col("lo")).select(*names).unionByName(met.where("simple").select(*names))
    found = space.save(found, "found")
    # paths where edges occur first
    source = found.where("doc = first").groupBy("kmer", "around").agg(F.min(F.struct("doc", "tag", "lo", "hi")).alias("s"))
    source = source.groupBy("s.doc", "s.tag").agg(F.collect_list(F.struct("kmer", "around", "s.lo", "s.hi")).alias("edges"))
    paths = _mapped(source, _paths, "kmer long, around long, src_doc long, src_tag long, src_lo int, path int")
    later = found.where("doc > first").drop("first").join(paths, ["kmer", "around"])
    mark = F.struct("lo", "hi", "src_doc", "src_tag", "src_lo", "path")
    return _mapped(later.groupBy("doc", "tag").agg(F.collect_set(mark).alias("marks")), _spans, f"doc long, tag long, spans array<{_SPAN}>")


def remove_repeated(docs: DataFrame, space: Workspace | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) and spans (as above, or null).

    A null or empty text has no words; texts of fewer than 13 words stay whole. Rows with a null doc_id come after all
    others: they lose what any other document holds and take nothing from each other, and so do rows that share a doc_id.
    Other columns play no part. An empty table gives no rows.
    """
    space = space or Workspace(docs.sparkSession, "spans")
    spans = space.save(repeated_spans(docs, space), "spans")
    rows = identified(docs).join(spans, ["doc", "tag"], "left").select("doc_id", "text", "spans")

    def run(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": rows["doc_id"], "spans": rows["spans"], "n_words": [], "n_removed": [], "kept": []}
        for text, own in zip(rows["text"], rows["spans"], strict=True):
            words = words_of(text)
            stay, at = [], 0
            for s in own or ():
                stay += words[at : s["start"]]
                at = max(at, s["end"])
            stay += words[at:]
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(stay))
            out["kept"].append(b" ".join(stay).decode("utf-8", "surrogatepass"))
        return out

    return arrow_map(rows, run, f"doc_id long, n_words long, n_removed long, kept string, spans array<{_SPAN}>", rows=TOGETHER)


def op13_compacted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeated(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS d, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, d, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
q AS (
  SELECT *, string_agg(word, ' ') OVER f AS seq, count(*) OVER f = 13 AS whole FROM x
  WINDOW f AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
m AS (SELECT *, whole AND min(CASE WHEN whole THEN d END) OVER (PARTITION BY seq) < d AS again FROM q),
c AS (SELECT r, i, word, coalesce(bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS gone FROM m),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
