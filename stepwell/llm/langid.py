"""Language identification by a byte convolutional network, trained in numpy."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, arrow_map, table

WINDOW = 256
WIDTHS, FILTERS, DIM = (2, 3, 4, 5), 6, 6
SPAN = max(WIDTHS)
UNKNOWN = "und"
#: Bounds of what the network is fitted on: documents of each language, windows of each document, documents in all.
FIT_DOCS, FIT_WINDOWS, FIT_TOTAL = 600, 3, 60_000

_LETTER = re.compile(r"[^\W\d_]")


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a whole text as rows of fixed length, zeros after the end, and the bytes in each row."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros((n, WINDOW), np.uint8)
    out.reshape(-1)[: len(raw)] = raw
    sizes = np.full(n, WINDOW)
    sizes[-1] = max(1, len(raw) - (n - 1) * WINDOW)
    return out, sizes


class ByteNet:
    """Bytes are embedded, convolved with filters of several widths, max-pooled over the window and classed by softmax."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        n = len(WIDTHS) * FILTERS
        self.langs = langs
        #: Rows of `conv` beyond a filter's width stay zero: one product serves all widths.
        self.shape = np.repeat(np.arange(SPAN)[:, None] < np.repeat(WIDTHS, FILTERS)[None, :], DIM, axis=0)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
            "conv": (rng.normal(0, 1, (SPAN * DIM, n)) / np.sqrt(SPAN * DIM) * self.shape).astype(np.float32),
            "shift": np.zeros(n, np.float32),
            "out": (rng.normal(0, 1, (n, len(langs))) / np.sqrt(n)).astype(np.float32),
            "bias": np.zeros(len(langs), np.float32),
        }

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = self.p["embed"][windows]
        n, steps = len(windows), WINDOW - SPAN + 1
        columns = np.empty((n, steps, SPAN * DIM), np.float32)
        for k in range(SPAN):
            columns[:, :, k * DIM : (k + 1) * DIM] = e[:, k : k + steps]
        c = (columns.reshape(n * steps, -1) @ self.p["conv"]).reshape(n, steps, -1)
        return c, columns

    def probabilities(self, windows: np.ndarray, batch: int = 64) -> np.ndarray:
        out = np.empty((len(windows), len(self.langs)), np.float32)
        for at in range(0, len(windows), batch):
            c, _ = self.pooled(windows[at : at + batch])
            h = np.maximum(c.max(axis=1) + self.p["shift"], 0)
            z = h @ self.p["out"] + self.p["bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[at : at + batch] = z / z.sum(axis=1, keepdims=True)
        return out

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 4e-3, seed: int = 11, least_steps: int = 400) -> ByteNet:
        """Weighted cross entropy by Adam; few windows are gone over more often, so that a small table is learned too."""
        epochs = max(epochs, -(-least_steps * batch // max(1, len(labels))))
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        weight = len(labels) / np.maximum(1, np.bincount(labels, minlength=len(self.langs))) / len(self.langs)
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                x, y = windows[pick], labels[pick]
                c, columns = self.pooled(x)
                best = c.argmax(axis=1)  # (n, filters)
                rows = np.arange(len(x))[:, None]
                pre = np.take_along_axis(c, best[:, None, :], axis=1)[:, 0] + self.p["shift"]
                h = np.maximum(pre, 0)
                z = h @ self.p["out"] + self.p["bias"]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                d = z / z.sum(axis=1, keepdims=True)
                d[np.arange(len(x)), y] -= 1
                d *= (weight[y] / len(x))[:, None].astype(np.float32)
                g = {"out": h.T @ d, "bias": d.sum(0)}
                dh = (d @ self.p["out"].T) * (pre > 0)
                g["shift"] = dh.sum(0)
                at_best = columns[rows, best]  # (n, filters, span * dim)
                g["conv"] = np.einsum("nf,nfd->df", dh, at_best) * self.shape
                g["embed"] = np.zeros_like(self.p["embed"])
                back = np.einsum("nf,df->nfd", dh, self.p["conv"])
                for k in range(SPAN):
                    np.add.at(g["embed"], x[rows, best + k], back[:, :, k * DIM : (k + 1) * DIM])
                step += 1
                for name, v in self.p.items():
                    m[name] = 0.9 * m[name] + 0.1 * g[name]
                    s[name] = 0.999 * s[name] + 0.001 * g[name] ** 2
                    v -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, mean probability over the text's windows by their bytes); `und` and 0 without a letter or a class."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        todo = [k for k, t in enumerate(texts) if t and self.langs and _LETTER.search(t)]
        at = 0
        while at < len(todo):
            group, parts, sizes, total = [], [], [], 0
            while at < len(todo) and total < 4096:  # windows at once; a longer text goes alone
                w, n = windows_of(texts[todo[at]])
                group.append(todo[at])
                parts.append(w)
                sizes.append(n)
                total += len(w)
                at += 1
            p = self.probabilities(np.concatenate(parts)) * np.concatenate(sizes)[:, None]
            firsts = np.concatenate(([0], np.cumsum([len(n) for n in sizes])[:-1]))
            mean = np.add.reduceat(p, firsts, axis=0) / np.array([n.sum() for n in sizes])[:, None]
            for k, row in zip(group, mean, strict=True):
                best = int(row.argmax())
                out[k] = self.langs[best], float(min(1.0, max(0.0, row[best])))
        return out


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: crc32 of its id as text, mod 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample_windows(docs: DataFrame, per_lang: int = FIT_DOCS, total: int = FIT_TOTAL) -> DataFrame:
    """doc_id, lang and windows (at the start, middle and end) of about `per_lang` documents of each language.

    Documents that are held out, and rows with a null doc_id, text or lang or without a letter, are left out. Those
    stay whose hash of doc_id falls under the language's share, so a language of any name or size gives about as many;
    rows that share doc_id and language count once. With so many languages that they would exceed `total` documents,
    each gives fewer, but always that of the least hash: no language is left out.
    """
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = rows.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.withColumn("hash", F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 53)))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"), F.min("hash").alias("least"))
    counts = Workspace(docs.sparkSession, "langid").save(counts, "counts")
    each = min(per_lang, max(1, total // max(1, counts.count())))
    bound = F.greatest(F.lit(float(each << 53)) / F.greatest("n", F.lit(1)), F.col("least").cast("double"))
    # no hint: Spark broadcasts the bounds if they are small, and deals the rows by language if they are not
    rows = rows.join(counts.select("lang", bound.alias("bound")), "lang").where("hash <= bound").select("doc_id", "lang", "text")

    def cut(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": [], "lang": [], "windows": []}
        for k, t, lang in zip(batch["doc_id"], batch["text"], batch["lang"], strict=True):
            if _LETTER.search(t):
                raw = t.encode("utf-8", "surrogatepass")
                starts = sorted({0, max(0, (len(raw) - WINDOW) // 2), max(0, len(raw) - WINDOW)})[:FIT_WINDOWS]
                out["doc_id"].append(k)
                out["lang"].append(lang)
                out["windows"].append(b"".join(raw[a : a + WINDOW].ljust(WINDOW, b"\0") for a in starts))
        return out

    made = arrow_map(rows, cut, "doc_id long, lang string, windows binary")
    return made.groupBy("doc_id", "lang").agg(F.min("windows").alias("windows"))


def fit_language(docs: DataFrame, per_lang: int = FIT_DOCS) -> ByteNet:
    """Fits on the bounded sample of `sample_windows`. Without labelled text the network has no classes."""
    got = sorted(sample_windows(docs, per_lang).collect(), key=lambda r: (r["doc_id"], r["lang"]))
    langs = sorted({r["lang"] for r in got})
    if not langs:
        return ByteNet([])
    place = {lang: k for k, lang in enumerate(langs)}
    x = np.concatenate([np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW) for r in got])
    y = np.repeat([place[r["lang"]] for r in got], [len(r["windows"]) // WINDOW for r in got])
    return ByteNet(langs).fit(x, y)


def identify(docs: DataFrame, net: ByteNet, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `carry` with lang_pred and score of each whole text, a row for every row.

    A null text, one without a letter, and any text under a network without classes give `und` and 0; of languages that
    are equally probable the first by name is given. An empty table gives no rows.
    """

    def run(rows: dict[str, list]) -> dict[str, list]:
        made = net.predict(rows["text"])
        return {c: rows[c] for c in carry} | {"lang_pred": [a for a, _ in made], "score": [b for _, b in made]}

    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in carry) + ", lang_pred string, score double"
    return arrow_map(docs.select(*dict.fromkeys((*carry, "text"))), run, schema)


def op7_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit_language(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
