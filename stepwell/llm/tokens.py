"""Tokenizing whole texts, and token files: flat unsigned integers beside 64-bit document offsets."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, local_path, small_batches, table

END_ID = 2
#: Words, and chunks between blanks, that an encoder remembers at most; beyond that it forgets all and begins anew.
REMEMBERED = 600_000
#: Bytes of text in a part; documents and ids that a reader holds at once; tasks that read.
PART_BYTES, READ_DOCS, READ_IDS, READ_TASKS = 256 << 20, 10_000, 1 << 22, 20_000

# Characters whose classes and case are the same in every Unicode table; other texts go to the library as a whole.
_SPACE = r"\t\n\r "
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-įı-ňŊ-ž"
_NUMBER = "0-9²³¹¼½¾"
_PLAIN = re.compile(f"[{_SPACE}!-~¡-¬®-įı-ňŊ-ž‐-‧‰-‾€]*")
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACED = re.compile(f" ?[{_LETTER}]+|{_ENDINGS}| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_UNSPACED = re.compile(f"[{_LETTER}]+|{_ENDINGS}|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_RUNS = tuple(a + b for a in "\t\n\r " for b in "\t\n\r ")
_LINE_RUNS = tuple(a + b for a in "\n " for b in "\n ")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable ones for themselves, others from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Words(dict):
    """Ids of words, as bytes; an unknown word is merged by the library's model and remembered."""

    def __init__(self, model, code: str):
        self.model, self.code, self.letters = model, code, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():  # of these bytes only the blank has another letter
            made = self.model.tokenize(word.replace(" ", self.letters[32]))
        else:
            made = self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
        ids = self[word] = array(self.code, [t.id for t in made]).tobytes()
        return ids


class _Chunks(dict):
    """Ids of what stands between two blanks; the blank before it belongs to it."""

    def __init__(self, words: _Words, pattern: re.Pattern, blank: str):
        self.words, self.pattern, self.blank = words, pattern, blank

    def __missing__(self, chunk: str) -> bytes:
        ids = self[chunk] = b"".join(map(self.words.__getitem__, self.pattern.findall(self.blank + chunk)))
        return ids


class Encoder:
    """Ids of whole texts by the tokenizers library, without special tokens.

    Both public vocabularies split a text into words before they merge, so the ids of a text are those of its words; the
    library encodes each word once and they are remembered, as are those of what stands between two blanks. Texts with
    characters beyond Latin ones or with an added token, and files that split otherwise, go to the library whole.

    An added token's string in a text is that token, as the library has it; with `control_as_text` it is ordinary text.
    """

    def __init__(self, path: str, control_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = control_as_text
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        kinds = [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", [])]
        split = rules["pre_tokenizer"] or {}
        self.lower = kinds == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in split.get("pretokenizers", [])] == ["Split", "ByteLevel"]
        spaced = rules["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        self.words = _UNSPACED if self.lower else _SPACED if spaced else None
        added = [a for a in rules.get("added_tokens") or [] if not (control_as_text and a["special"])]
        self.added = [a["content"] for a in added]
        if any(a["normalized"] and rules["normalizer"] for a in added):
            self.words = None  # a token that is matched after normalizing could hide in any text
        self.known = _Words(self.library.model, self.code)
        self.chunks = _Chunks(self.known, self.words, "" if self.lower else " ")

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; None counts as an empty one."""
        for memory in (self.known, self.chunks):
            if len(memory) > REMEMBERED:
                memory.clear()
        word, chunk = self.known.__getitem__, self.chunks.__getitem__
        out: list[np.ndarray | None] = []
        whole: list[int] = []
        for k, t in enumerate(texts):
            t = t or ""
            raw = b""
            if not self.words or any(a in t for a in self.added) or not _PLAIN.fullmatch(t):
                whole.append(k)
            elif self.lower:
                raw = b"".join(map(chunk, t.lower().split()))
            elif t[:1].isspace() or t[-1:].isspace() or any(r in t for r in (_RUNS if "\t" in t or "\r" in t else _LINE_RUNS)):
                raw = b"".join(map(word, self.words.findall(t)))
            else:  # a blank belongs to what follows it, and to nothing else
                first, *rest = t.split(" ")
                raw = b"".join(map(word, self.words.findall(first))) + b"".join(map(chunk, rest))
            out.append(np.frombuffer(raw, self.dtype))
        if whole:
            for k, e in zip(whole, self.library.encode_batch([texts[k] for k in whole], add_special_tokens=False), strict=True):
                out[k] = np.array(e.ids, self.dtype)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder of a file in each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[dict[str, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows).to_pydict()


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    path = local_path(uri)
    return (pafs.LocalFileSystem(), path) if path else pafs.FileSystem.from_uri(uri)


class _PartFiles:
    """The three files of a part, written piece by piece under names of this attempt's own and renamed when whole.

    A repeated task replaces whole files by equal ones. Files are opened at the first documents: an empty part has none.
    """

    def __init__(self, fs: pafs.FileSystem, path: str, part: int):
        context = TaskContext.get()
        attempt = context.taskAttemptId() if context else os.getpid()
        self.fs, self.docs, self.ids = fs, 0, 0
        self.names = {kind: (f"{path}/_{part:06d}.{kind}.{attempt}", f"{path}/{part:06d}.{kind}") for kind in ("ids", "off", "doc")}
        self.files: dict[str, pa.NativeFile] = {}

    def add(self, doc_ids: list[int], ids: np.ndarray, sizes: list[int]) -> None:
        if not self.files:
            self.files = {kind: self.fs.open_output_stream(own) for kind, (own, _) in self.names.items()}
            self.files["off"].write(np.zeros(1, "<u8").tobytes())
        self.files["ids"].write(ids.tobytes())
        self.files["off"].write((self.ids + np.cumsum(sizes)).astype("<u8").tobytes())
        self.files["doc"].write(np.array(doc_ids, "<i8").tobytes())
        self.docs, self.ids = self.docs + len(sizes), self.ids + sum(sizes)

    def finish(self) -> None:
        for kind, f in self.files.items():
            f.close()
            self.fs.move(*self.names[kind])


def write_files(docs: DataFrame, uri: str, tokenizer: str, end_id: int = END_ID, parts: int | None = None, part_bytes: int = PART_BYTES) -> dict:
    """Writes the ids of all documents, in ascending doc_id order, as part files under `uri`, and returns their manifest.

    Each part has flat little-endian unsigned ids (16 bits if the vocabulary fits, else 32), unsigned 64-bit offsets
    (one more than documents), and doc_ids as signed 64-bit integers. Null doc_ids come first, ties go by a hash of the
    text, null texts count as empty; repeated rows are written as often as they come, and an empty table gives no parts.
    Parts follow ranges of (doc_id, hash, row), so one doc_id may fill several; there are as many as hold about
    `part_bytes` of text each, and enough for all cores. The bases of a part, documents and ids before it, are prefix
    sums over the parts' counts. A task writes as it encodes and holds only a slice of its part. The manifest, a row per
    part, is also written as manifest.json.
    """
    spark = docs.sparkSession
    fs, path = _store(uri)
    fs.create_dir(path, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if parts is None:
        total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, -(-total // part_bytes))
    order = ["doc_id", "hash", "row"]  # the row only deals repeated rows over parts; which of them comes first is the same
    rows = rows.select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _store(uri)
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end, out, nulls = np.array([end_id], enc.dtype), _PartFiles(fs, path, part), 0
        for batch in slices(batches):
            if got := enc.encode(batch["text"]):
                nulls += sum(k is None for k in batch["doc_id"])
                names = [0 if k is None else k for k in batch["doc_id"]]
                out.add(names, np.concatenate([x for g in got for x in (g, end)]), [len(g) + 1 for g in got])
        out.finish()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "docs": pa.array([out.docs], pa.int64()), "ids": pa.array([out.ids], pa.int64()), "nulls": pa.array([nulls], pa.int64()), "width": pa.array([enc.dtype.itemsize], pa.int64())})

    with small_batches(spark):
        counts = sorted(rows.mapInArrow(write, "part long, docs long, ids long, nulls long, width long").collect())
    made = [r.asDict() for r in counts if r["docs"]]
    base_docs = base_ids = 0
    for r in made:
        r |= {"base_docs": base_docs, "base_ids": base_ids}
        base_docs, base_ids = base_docs + r["docs"], base_ids + r["ids"]
    manifest = {"parts": made, "docs": base_docs, "ids": base_ids, "end_id": end_id}
    with fs.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


class PartReader:
    """Ranges of a part's three files: memory-mapped where the store is a file system, else read by position."""

    def __init__(self, uri: str, part: dict):
        path = local_path(uri)
        fs, base = (None, path) if path else _store(uri)
        self.types = {"ids": np.dtype(f"<u{part['width']}"), "off": np.dtype("<u8"), "doc": np.dtype("<i8")}
        names = {kind: f"{base}/{part['part']:06d}.{kind}" for kind in self.types}
        self.maps = {kind: np.memmap(names[kind], dtype, "r") for kind, dtype in self.types.items()} if fs is None else {}
        self.files = {} if fs is None else {kind: fs.open_input_file(names[kind]) for kind in self.types}

    def __call__(self, kind: str, start: int, end: int) -> np.ndarray:
        """Items start to end of a file."""
        if self.maps:
            return self.maps[kind][start:end]
        dtype = self.types[kind]
        return np.frombuffer(self.files[kind].read_at((end - start) * dtype.itemsize, start * dtype.itemsize), dtype)

    def crc(self, start: int, end: int) -> int:
        """Checksum of ids as 32-bit integers, a bounded number of them at once."""
        made = 0
        for at in range(start, end, READ_IDS):
            made = zlib.crc32(self("ids", at, min(end, at + READ_IDS)).astype("<u4").tobytes(), made)
        return made

    def documents(self, docs: int) -> Iterator[tuple[int, np.ndarray, list[int]]]:
        """(first document, its bounds and those of the next, checksums) of runs of documents, by one read of ids each."""
        at = 0
        while at < docs:
            bounds = self("off", at, min(docs, at + READ_DOCS) + 1).astype(np.int64)
            n = max(1, int(np.searchsorted(bounds, bounds[0] + READ_IDS, "right")) - 1)
            bounds = bounds[: n + 1]
            low, high = int(bounds[0]), int(bounds[-1])
            if n == 1:
                yield at, bounds, [self.crc(low, high)]
            else:
                ids = self("ids", low, high).astype("<u4")
                yield at, bounds, [zlib.crc32(ids[a - low : b - low].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            at += n


def read_documents(spark: SparkSession, uri: str, manifest: dict) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 (of 32-bit ids) of each document in the files."""
    fields = ("part", "docs", "ids", "nulls", "width", "base_docs", "base_ids")
    parts = spark.createDataFrame([tuple(p[f] for f in fields) for p in manifest["parts"]], ", ".join(f"{f} long" for f in fields))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                reader = PartReader(uri, part)
                for at, bounds, crc in reader.documents(part["docs"]):
                    keys = [None if at + k < part["nulls"] else name for k, name in enumerate(reader("doc", at, at + len(crc)).tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bounds[:-1] + part["base_ids"]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return parts.repartition(max(1, min(len(manifest["parts"]), READ_TASKS))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    uri = Workspace(spark, "tokens").path
    manifest = write_files(table(spark, sf_dir, "documents"), uri, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, uri, manifest)
