"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table

SYMBOLS = "#*$%&|<>"
SPACES = "".join(map(chr, (0x20, *range(0x09, 0x0E))))
#: Base rule: fewer words, or more than this percentage of words in repeated windows, fail a document.
MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8
#: The field is fitted on at most this many labelled documents, half of each class, and of each on runs of lines that
#: are spread evenly over its text: at most so many runs, of so many lines.
FIT_DOCS, FIT_RUNS, RUN_LINES = 3000, 4, 8
#: Training sequences, lines in each, and the seed by which runs of good and bad documents are joined.
SEQUENCES, SEQUENCE_LINES, SEED = 512, 24, 23
#: A document stays if at least this share of the bytes of its words is in content lines.
MIN_CONTENT = 0.5

_UPPER, _LOWER, _SYMBOL, _BANG, _DIGIT, _SPACE, _HIGH = (1 << k for k in range(7))
_CLASS = np.zeros(256, np.uint8)
for _chars, _bit in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), ("abcdefghijklmnopqrstuvwxyz", _LOWER), (SYMBOLS, _SYMBOL), ("!?", _BANG), ("0123456789", _DIGIT), (SPACES, _SPACE)):
    _CLASS[list(_chars.encode())] |= _bit
_CLASS[128:] |= _HIGH
FEATURES = 10


def repeated_words(words: np.ndarray) -> np.ndarray:
    """Which words lie in a window of 8 that is found twice or more; words come as 64-bit hashes."""
    inside = np.zeros(len(words) + 1, np.int32)
    if len(words) > WINDOW:
        h = words.astype(np.uint64)
        for step, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
            h = h[:-step] * np.uint64(factor) + h[step:]
        ordered = np.sort(h)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            at = np.searchsorted(twice, h)
            starts = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == h)
            np.add.at(inside, starts, 1)
            np.add.at(inside, starts + WINDOW, -1)
    return np.cumsum(inside[:-1]) > 0


def describe(text: str | None) -> tuple[dict, np.ndarray, np.ndarray]:
    """Base counts of a whole text, features of its lines, and the bytes of words in each line. None has no lines."""
    if text is None:
        text = ""
    lines = text.split("\n")
    raw = [line.encode("utf-8", "surrogatepass") for line in lines]
    parts = [b.split() for b in raw]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    words = [w for p in parts for w in p]
    n = len(words)
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    covered = repeated_words(hashes)
    seen: set[str] = set()
    dup = np.zeros(len(lines), bool)
    for k, (line, c) in enumerate(zip(lines, counts, strict=True)):
        if c:
            dup[k] = line in seen
            seen.add(line)
    base = {
        "n_words": n,
        "word_chars": len(text) - sum(map(text.count, SPACES)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": int(dup.sum()),
        "n_repeat_words": int(covered.sum()),
    }
    # per line: byte classes by sums over the joined bytes
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    kinds = _CLASS[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    count = lambda bit: np.add.reduceat((kinds & bit) > 0, starts, dtype=np.int64)
    chars = sizes - (count(_SPACE) - 1)
    some, some_words = np.maximum(chars, 1), np.maximum(counts, 1)
    upto = np.concatenate(([0], np.cumsum(counts)))
    per_line = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[upto])
    again = np.concatenate(([False], hashes[1:] == hashes[:-1])) if n else np.zeros(0, bool)
    x = np.zeros((len(lines), FEATURES), np.float64)
    x[:, 0] = 1
    x[:, 1] = count(_UPPER) / some
    x[:, 2] = np.minimum(1, 2 * count(_SYMBOL) / some_words)
    x[:, 3] = np.minimum(1, count(_BANG) / some_words)
    x[:, 4] = count(_DIGIT) / some
    x[:, 5] = per_line(again) / some_words
    x[:, 6] = per_line(covered) / some_words
    x[:, 7] = dup
    x[:, 8] = np.minimum(1, np.log1p(counts) / 6)
    x[:, 9] = np.minimum(1, chars / some_words / 20)
    return base, x, chars


class LineField:
    """Two states (0 boilerplate, 1 content): emission weights (2, FEATURES) and transition scores (2, 2)."""

    def __init__(self, emission: np.ndarray | None = None, transition: np.ndarray | None = None):
        self.emission = np.zeros((2, FEATURES)) if emission is None else emission
        self.transition = np.zeros((2, 2)) if transition is None else transition

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The best states of a whole sequence; ties go to content."""
        scores = (x @ self.emission.T).tolist()
        (t00, t01), (t10, t11) = self.transition.tolist()
        a, b = scores[0]
        from0, from1 = [], []
        for e0, e1 in scores[1:]:
            p0, p1 = b + t10 >= a + t00, b + t11 >= a + t01
            a, b = (b + t10 if p0 else a + t00) + e0, (b + t11 if p1 else a + t01) + e1
            from0.append(p0)
            from1.append(p1)
        state = int(b >= a)
        states = [state]
        for p0, p1 in zip(reversed(from0), reversed(from1), strict=True):
            state = int(p1 if state else p0)
            states.append(state)
        return np.array(states[::-1], np.int8)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 0.2, ridge: float = 1e-4, enough: float = 2e-4) -> LineField:
        """Maximum conditional likelihood of line labels y (n, t) given features x (n, t, FEATURES), by Adam.

        It ends when the gradient of the mean over lines is small, or after so many steps.
        """
        theta, m, v = (np.zeros(2 * FEATURES + 4) for _ in range(3))
        for step in range(1, steps + 1):
            _, g = likelihood(theta, x, y)
            g = g / max(1, y.size) - ridge * theta
            if np.abs(g).max() < enough:
                break
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(theta[: 2 * FEATURES].reshape(2, FEATURES), theta[2 * FEATURES :].reshape(2, 2))


def likelihood(theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Log likelihood of the labels of n sequences of t lines, and its gradient, by forward-backward with scaled sums."""
    emission, transition = theta[: 2 * FEATURES].reshape(2, FEATURES), theta[2 * FEATURES :].reshape(2, 2)
    n, t = y.shape
    e = x @ emission.T  # (n, t, 2)
    top = e.max(axis=2, keepdims=True)
    weight, step = np.exp(e - top), np.exp(transition)
    alpha, beta, scale = np.empty((t, n, 2)), np.ones((t, n, 2)), np.empty((t, n))
    for k in range(t):
        a = weight[:, k] if k == 0 else (alpha[k - 1] @ step) * weight[:, k]
        scale[k] = a.sum(axis=1)
        alpha[k] = a / scale[k][:, None]
    for k in range(t - 2, -1, -1):
        beta[k] = (weight[:, k + 1] * beta[k + 1] / scale[k + 1][:, None]) @ step.T
    node = np.moveaxis(alpha * beta, 0, 1)
    ahead = np.moveaxis(weight, 1, 0)[1:] * beta[1:] / scale[1:][:, :, None]
    pair = np.einsum("kna,knb->ab", alpha[:-1], ahead) * step
    gold = np.eye(2)[y]
    same = np.einsum("nka,nkb->ab", gold[:, :-1], gold[:, 1:])
    value = (gold * e).sum() + (same * transition).sum() - np.log(scale).sum() - top.sum()
    return float(value), np.concatenate([np.einsum("nka,nkf->af", gold - node, x).ravel(), (same - pair).ravel()])


def relabel(field: LineField, bad: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Runs of bad documents, parted into what the field takes for content and what for boilerplate."""
    parts: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    for run in bad:
        states = field.viterbi(run)
        ends = [0, *(np.flatnonzero(states[1:] != states[:-1]) + 1).tolist(), len(run)]
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            parts[1 - states[a]].append(run[a:b])
    return parts


def learn(good: list[np.ndarray], bad: list[np.ndarray], rounds: int = 2) -> LineField:
    """Fits on spliced runs. A bad document may have good lines, a good one has no bad ones.

    So what a round's field takes for content in bad documents counts as content in the next one.
    """
    if not good or not bad:
        return LineField()
    field = LineField.fit(*splice(good, bad))
    for _ in range(rounds - 1):
        clean, junk = relabel(field, bad)
        if not junk:
            break
        field = LineField.fit(*splice(good + clean, junk))
    return field


def splice(good: list[np.ndarray], bad: list[np.ndarray], sequences: int = SEQUENCES, length: int = SEQUENCE_LINES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Training sequences that change between lines of good and of bad documents, and the label of each line.

    Pieces of 1 to 8 lines of runs drawn at random follow each other, of either class with the same chance, so that
    both states and all four transitions occur, and a label belongs to a line and not to a document.
    """
    rng = np.random.default_rng(seed)
    x, y = np.zeros((sequences, length, FEATURES)), np.zeros((sequences, length), np.int64)
    for s in range(sequences):
        at = 0
        while at < length:
            state = int(rng.integers(2))
            run = (bad, good)[state][rng.integers(len((bad, good)[state]))]
            first = int(rng.integers(len(run)))
            piece = run[first : first + int(rng.integers(1, RUN_LINES + 1))][: length - at]
            x[s, at : at + len(piece)], y[s, at : at + len(piece)] = piece, state
            at += len(piece)
    return x, y


def runs_of(text: str | None) -> list[np.ndarray]:
    """Features of at most 4 runs of 8 lines that have words: all lines of a short text, else spread from start to end."""
    _, x, chars = describe(text)
    x = x[chars > 0]
    if len(x) <= FIT_RUNS * RUN_LINES:
        return [x[k : k + RUN_LINES] for k in range(0, len(x), RUN_LINES)]
    return [x[k : k + RUN_LINES] for k in np.linspace(0, len(x) - RUN_LINES, FIT_RUNS).astype(int)]


def fit_lines(docs: DataFrame, labels: DataFrame, keep: int = FIT_DOCS) -> LineField:
    """Fits on labelled documents, of each class those whose hash of doc_id is smallest, at most `keep` in all.

    Lines of good and of bad documents are joined to sequences at seeded places, so the field learns where content
    begins and ends. Rows of labels with a null are left out, repeated ones count once, and a doc_id with both labels
    counts in both; rows of documents that share a doc_id count once. Without labels, without one of the classes or
    without text, the field keeps its zero weights: all lines are content.
    """
    some = labels.where("quality is not null and doc_id is not null").select("doc_id", (F.col("quality") > 0).cast("int").alias("good")).distinct()
    some = some.withColumn("_pick", F.xxhash64(F.lit(17), "doc_id"))
    some = reduce(DataFrame.unionByName, [some.where(F.col("good") == v).orderBy("_pick", "doc_id").limit(keep // 2) for v in (0, 1)])
    text = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    # `some` has at most `keep` rows
    rows = text.join(F.broadcast(some), "doc_id").select("doc_id", "good", "text")

    def lines(batch: dict[str, list]) -> dict[str, list]:
        runs = [runs_of(t) for t in batch["text"]]
        return {"doc_id": batch["doc_id"], "good": batch["good"], "runs": [[r.astype(np.float32).tobytes() for r in of] for of in runs]}

    # rows that share a doc_id count once, so the driver gets at most `keep` of them
    made = arrow_map(rows, lines, "doc_id long, good int, runs array<binary>").where("size(runs) > 0")
    got = sorted(made.groupBy("doc_id", "good").agg(F.min("runs").alias("runs")).collect(), key=lambda r: (r["doc_id"], r["good"]))
    of = lambda v: [np.frombuffer(b, np.float32).reshape(-1, FEATURES).astype(np.float64) for r in got if r["good"] == v for b in r["runs"]]
    return learn(of(1), of(0))


def judge(text: str | None, field: LineField) -> tuple[dict, float]:
    """Base counts and the share of word bytes that lie in content lines (1 if there are none)."""
    base, x, chars = describe(text)
    lines = np.flatnonzero(chars > 0)
    if not len(lines):
        return base, 1.0
    return base, float(chars[lines][field.viterbi(x[lines]) == 1].sum() / chars[lines].sum())


def label_lines(text: str | None, field: LineField) -> Iterator[tuple[str, bool]]:
    """Each line that has a word, and whether it is content."""
    _, x, chars = describe(text)
    lines = np.flatnonzero(chars > 0)
    if len(lines):
        split = (text or "").split("\n")
        for k, s in zip(lines, field.viterbi(x[lines]), strict=True):
            yield split[k], bool(s)


def base_fails(base: dict) -> bool:
    return base["n_words"] < MIN_WORDS or 100 * base["n_repeat_words"] > MAX_REPEATED * base["n_words"]


def passes(text: str | None, field: LineField) -> bool:
    base, share = judge(text, field)
    return not base_fails(base) and share >= MIN_CONTENT


VERDICTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, base_failed boolean, kept boolean"


def verdicts(docs: DataFrame, field: LineField, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `carry` with counts, content share and verdict of each whole text.

    A document fails the base rules with fewer than 20 words or over 30 % of them in repeated windows of 8; it is kept
    if it passes and at least half the bytes of its words are in content lines. A null text has no words and fails.
    """

    def run(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: rows[c] for c in carry}
        made = [judge(t, field) for t in rows["text"]]
        for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
            out[name] = [b[name] for b, _ in made]
        out["content_share"] = [s for _, s in made]
        out["base_failed"] = [base_fails(b) for b, _ in made]
        out["kept"] = [not f and s >= MIN_CONTENT for f, s in zip(out["base_failed"], out["content_share"], strict=True)]
        return out

    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in carry) + ", " + VERDICTS
    return arrow_map(docs.select(*dict.fromkeys((*carry, "text"))), run, schema)


def op4_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return verdicts(docs, fit_lines(docs, table(spark, sf_dir, "labels")))
