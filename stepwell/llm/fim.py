"""Fill-in-middle examples: one automaton finds where texts change class and where they hold sentinels."""

from __future__ import annotations

import hashlib
from itertools import product

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are taken apart, and of a hundred of those so many put the suffix first.
RATE, SUFFIX_FIRST = 90, 20

# What the automaton reads: one ASCII character a code point. Letters and others that no sentinel has look alike.
_LETTERS, _OTHERS = "aPSM", ".<>"
_ALIKE = bytes(
    b if chr(b) in "<>PSM" else ord("a") if chr(b).isascii() and chr(b).isalpha() else ord(".") for b in range(256)
)
_FOLLOWING = bytes(range(0x80, 0xC0))  # bytes of a code point after its first


def _automaton() -> ahocorasick.Automaton:
    """Finds every change of class (1) and every sentinel (0): a letter beside another character, either way round."""
    found = ahocorasick.Automaton()
    for a, b in product(_LETTERS, _OTHERS):
        found.add_word(a + b, 1)
        found.add_word(b + a, 1)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(sentinel, 0)
    found.make_automaton()
    return found


_EVENTS = _automaton()


class Units:
    """The units of a text, a run of ASCII letters or any other code point, by the events of one scan.

    Between two events all code points are of one class, so a gap is one unit of letters or as many units as it has
    other code points. Only the events are kept.
    """

    def __init__(self, text: str):
        alike = text.encode("utf-8", "surrogatepass").translate(_ALIKE, _FOLLOWING).decode("ascii")
        events = np.fromiter((2 * end + kind for end, kind in _EVENTS.iter(alike)), np.int64)
        change = (events & 1).astype(bool)
        self.has_sentinel = not change.all()
        self.chars = len(alike)
        self.bounds = np.concatenate(([0], events[change] >> 1, [self.chars])) if alike else np.zeros(1, np.int64)
        sizes = np.diff(self.bounds)
        self.letters = np.arange(len(sizes)) % 2 == int(bool(alike) and alike[0] not in _LETTERS)
        self.before = np.concatenate(([0], np.cumsum(np.where(self.letters, 1, sizes))))

    def __len__(self) -> int:
        return int(self.before[-1])

    def place(self, rank: int) -> int:
        """The code point at which the unit of this rank starts; the end of the text for the rank after the last."""
        if rank >= len(self):
            return self.chars
        gap = int(np.searchsorted(self.before, rank, "right")) - 1
        return int(self.bounds[gap] + (0 if self.letters[gap] else rank - self.before[gap]))


def expand(text: str | None, doc_id: int | None, seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, and output of one text."""
    text, units = text or "", Units(text or "")
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(units)
    if not text or units.has_sentinel or h3 % 100 >= rate:
        return n, "plain", None, None, text
    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
    one, two = (units.place(c) for c in cuts)
    prefix, middle, suffix = text[:one], text[one:two], text[two:]
    if h4 % 100 < suffix_first:
        return n, "spm", one, two - one, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", one, two - one, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str | None, form: str | None) -> str:
    """The text an output was made of. No sentinel can begin inside a part, nor across its end: none overlaps another."""
    output = output or ""
    if form not in ("psm", "spm"):
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at = output.index(second, len(first))
    end = output.index(MIDDLE, at + len(second))
    parts = {first: output[len(first) : at], second: output[at + len(second) : end]}
    return parts[PREFIX] + output[end + len(MIDDLE) :] + parts[SUFFIX]


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row, by its own doc_id and whole text.

    A null or empty text stays as it is (plain, nothing), and so does one that holds a sentinel. A null doc_id is hashed
    as no digits. Rows of one doc_id are cut by the same numbers, so repeated rows come out alike. Other columns play no
    part. An empty table gives no rows.
    """

    def run(rows: dict[str, list]) -> dict[str, list]:
        made = [expand(t, k, seed, rate, suffix_first) for k, t in zip(rows["doc_id"], rows["text"], strict=True)]
        n, form, prefix, middle, output = zip(*made, strict=True) if made else ((),) * 5
        return {"doc_id": rows["doc_id"], "n": n, "form": form, "prefix_chars": prefix, "middle_chars": middle, "output": output}

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return arrow_map(docs, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string", rows=500)


def read_back(examples: DataFrame) -> DataFrame:
    """The examples with digests of their outputs and of the texts rebuilt from these, in place of the outputs."""
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars")
    digest = lambda texts: [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]

    def run(rows: dict[str, list]) -> dict[str, list]:
        texts = [restore(o, f) for o, f in zip(rows["output"], rows["form"], strict=True)]
        return {k: rows[k] for k in names} | {"output_sha256": digest(o or "" for o in rows["output"]), "restored_sha256": digest(texts)}

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return arrow_map(examples.select(*names, "output"), run, schema, rows=500)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(fill_in_middle(table(spark, sf_dir, "documents")))


OP12_SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM u),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS one, greatest(h1 % (n + 1), h2 % (n + 1)) AS two,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, coalesce(array_to_string(u[1:one], ''), '') AS prefix, coalesce(array_to_string(u[one + 1:two], ''), '') AS middle,
    coalesce(array_to_string(u[two + 1:n], ''), '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
