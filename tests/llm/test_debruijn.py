"""Repeated spans against plain versions, and on odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepwell.llm import debruijn


def plain(rows):
    """(doc_id, n_words, n_removed, kept) of every row, by all windows."""
    key = lambda k: 2**63 - 1 if k is None else k
    split = [(k, debruijn.words_of(t)) for k, t in rows]
    least = {}
    for k, w in split:
        for i in range(len(w) - 12):
            seq = tuple(w[i : i + 13])
            least[seq] = min(least.get(seq, 2**63), key(k))
    out = []
    for k, w in split:
        gone = [any(least[tuple(w[j : j + 13])] < key(k) for j in range(max(0, i - 12), min(i, len(w) - 13) + 1)) for i in range(len(w))]
        stay = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((k, len(w), len(w) - len(stay), b" ".join(stay).decode()))
    return out


def made(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("doc", "tag", "lo", "hi", "first", "spans", "kept", "kmer")})
    return debruijn.remove_repeated(df.repartition(3))


def test_long_edges_hold_each_window_once_and_agree_on_equal_windows():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(80)] + ["", None, "x " * 13, "x " * 40]
    split, edges = [debruijn.words_of(t) for t in texts], debruijn.long_edges(debruijn.Words(texts))
    covered = Counter((t, q) for t, lo, hi in zip(edges["text"], edges["lo"], edges["hi"], strict=True) for q in range(lo, hi + 1))
    assert covered == Counter((t, q) for t, w in enumerate(split) for q in range(len(w) - 12))
    named, around = {}, {}
    for t, lo, hi, kmer, a in zip(*(edges[k].tolist() for k in ("text", "lo", "hi", "kmer", "around")), strict=True):
        windows = tuple(tuple(split[t][q : q + 13]) for q in range(lo, hi + 1))
        assert around.setdefault((kmer, a), windows) == windows  # the same words all around: the same windows
        for w in windows:
            assert named.setdefault(w, kmer) == kmer
    lone = debruijn.long_edges(debruijn.Words([" ".join(f"w{rng.random()}" for _ in range(8000))]))
    assert 0.2 < len(lone["lo"]) / 8000 < 0.25


def test_runs_hash_alike_wherever_they_lie():
    words = debruijn.Words(["a b c d", "x a b c d y", "b a c d"])
    at = np.array([0, 5, 10])
    whole = words.runs(at, at + 4)
    assert whole[0] == whole[1] != whole[2] and len({*words.runs(at, at + 3), *whole}) == 4


def test_removal_equals_all_windows(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, hot, base = prose(60), prose(13), prose(300)
    rows = []
    for k in range(160):
        words = prose(rng.randrange(80))
        if k % 3 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage[rng.randrange(5) : 60 - rng.randrange(20)]
        if k % 4 == 0:
            words += hot
        if k % 7 == 0:  # near copies that differ in places of their own
            words = [w if rng.random() > 0.02 else "edit" for w in base]
        if k % 11 == 0:
            words = words * 2
        rows.append((rng.choice([k, k, k, 5, None, -k]), " \n".join(words)))
    rows += [(k, " ".join(passage)) for k in (7, 7, 900, None, None)] + [(3, None), (3, ""), (901, "short text"), (902, "a " * 13), (903, "a " * 400), (904, "a " * 12), (905, "é 日本 " * 30), (906, "é 日本 " * 31)]
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in made(spark, rows).collect()]
    assert Counter(got) == Counter(plain(rows))


def test_random_texts_of_few_words(spark):
    for seed, letters in ((3, "ab"), (4, "abcdefgh")):
        rng = random.Random(seed)
        rows = [(rng.randrange(40), " ".join(rng.choice(letters) for _ in range(rng.randrange(50)))) for _ in range(120)]
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in made(spark, rows).collect()) == Counter(plain(rows))


def test_spans_point_to_their_source(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(500)]
    rows = [(1, " ".join(base))]
    for k in range(2, 30):
        a = rng.randrange(400)
        rows.append((k, " ".join([f"x{k}", *base[a : a + rng.randrange(13, 100)], f"y{k}", *base[:50]])))
    rows.append((50, "long " + " ".join(base) + " text of its own"))
    texts = {k: t.split() for k, t in rows}
    n = 0
    for r in made(spark, rows).where("doc_id > 1").collect():
        for s in r["spans"]:
            size = s["end"] - s["start"]
            assert size >= 13 and s["src_doc"] < r["doc_id"]
            assert texts[r["doc_id"]][s["start"] : s["end"]] == texts[s["src_doc"]][s["src_start"] : s["src_start"] + size]
            n += 1
    assert n >= 2 * 28
    whole = made(spark, [(1, " ".join(base)), (2, "a b " + " ".join(base))]).where("doc_id = 2").collect()[0]
    assert [(s["start"], s["end"], s["src_doc"], s["src_start"]) for s in whole["spans"]] == [(2, 502, 1, 0)]  # one path, one span


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a " * 200_000), (None, "a " * 200_000), (2, "a " * 20)]])
def test_empty_tables_nulls_and_very_long_texts(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in debruijn.remove_repeated(df).collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {0: [], 1: [(1, 0, 0, sha(""))], 3: [(None, 200_000, 200_000, sha(""))] * 2 + [(2, 20, 0, sha(" ".join("a" * 20)))]}[len(rows)]
    assert Counter(got) == Counter(want)
