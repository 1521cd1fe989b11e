"""Fill-in-middle and Yinyang clustering against plain versions, and on odd rows."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from stepwell.llm import fim, yinyang

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
SCHEMA = "doc_id long, text string, n long, form string, output string"


def plain_example(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_units_by_events_equal_those_of_the_pattern():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("abPSM<>. \n\0éЖ日😀Z9") for _ in range(rng.randrange(30)))
        want, units = UNIT.findall(text), fim.Units(text)
        assert len(units) == len(want) and units.has_sentinel == bool(re.search("<[PSM]>", text))
        assert [units.place(k) for k in range(len(want) + 1)] == [sum(map(len, want[:k])) for k in range(len(want) + 1)]


def test_examples_are_restored_from_texts_full_of_brackets():
    rng = random.Random(6)
    forms = set()
    for k in range(4000):
        text = "".join(rng.choice("<>PSMab ") for _ in range(rng.randrange(12)))
        made = fim.expand(text, k)
        assert made == plain_example(k, text) and fim.restore(made[4], made[1]) == text
        forms.add(made[1])
    assert forms == {"plain", "psm", "spm"} and fim.restore(None, None) == ""


def test_events_are_sparse():
    assert len(fim.Units("a" * 10_000).bounds) == 2 and len(fim.Units("日" * 10_000).bounds) == 2


def test_fill_in_middle_of_odd_rows(spark):
    long = "many words, 多 and <b>tags</b> é " * 30_000
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "no id here"), (4, "holds <S> inside"), (5, long), (-6, "x < P > y\r\n")]
    df = spark.createDataFrame([(*r, 0, "x", "y") for r in rows], SCHEMA)
    made = fim.fill_in_middle(df).collect()
    key = lambda r: (str(r[0]), r[1], r[2], str(r[3]), str(r[4]), r[5])
    assert sorted(map(key, made)) == sorted(key((k, *plain_example(k, t))) for k, t in rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted((str(r["doc_id"]), r["output_sha256"], r["restored_sha256"]) for r in fim.read_back(fim.fill_in_middle(df)).collect())
    assert got == sorted((str(k), sha(plain_example(k, t)[4]), sha(t or "")) for k, t in rows)
    assert fim.read_back(fim.fill_in_middle(df.limit(0))).count() == 0


def plain_clusters(rows, k, rounds, size):
    keep = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and np.isfinite(c) for c in v)]
    centers = [v for _, v in sorted(keep, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in keep]
        for j in range(len(centers)):
            own = [v for (_, v), o in zip(keep, of, strict=True) if o == j]
            if own:
                centers[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted((str(i), nearest(v)[1], nearest(v)[0]) for i, v in keep), centers


def test_bounds_give_exact_assignments_and_spare_distances():
    rng = np.random.default_rng(7)
    for trial in range(12):
        spread = (3, 60, 4000)[trial % 3]
        blobs = rng.integers(-500, 500, (8, 16))
        x = blobs[rng.integers(0, 8, 1500)] + rng.integers(-spread, spread + 1, (1500, 16))
        x[:40] = x[0]  # ties
        centers = x[rng.choice(len(x), 20, replace=False)].copy()
        model = yinyang.Model(centers, yinyang.group_centroids(centers, 5), np.zeros(20))
        cluster, upper, lower = model.start(len(x))
        spent = 0
        for turn in range(8):
            cluster, upper, lower, done = model.assign(x, cluster, upper, lower)
            full = ((x[:, None, :] - model.centers[None]) ** 2).sum(2)
            assert (cluster == full.argmin(1)).all()
            assert (upper.astype(float) ** 2 >= full[np.arange(len(x)), cluster] * (1 - 1e-6)).all()
            others = np.sqrt(full.astype(float))
            others[np.arange(len(x)), cluster] = np.inf  # a group of the own centroid alone has no bound
            for g in range(lower.shape[1]):
                assert (others[:, model.group == g].min(1) >= lower[:, g]).all()
            if turn:
                spent += done
            model = model.moved(np.stack([x[cluster == c].sum(0) // max(1, (cluster == c).sum()) if (cluster == c).any() else model.centers[c] for c in range(20)]))
        if spread < 100:
            assert spent < 0.5 * 7 * len(x) * 20


def test_clusters_equal_brute_force_on_odd_rows(spark):
    rng = random.Random(8)
    base = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(6)]
    rows = [(k, [c + rng.uniform(-0.2, 0.2) for c in base[k % 6]]) for k in range(200)]
    rows += [(3, rows[3][1])] * 5 + [(k, base[0]) for k in range(300, 330)] + [(None, base[1]), (None, [0.5] * 4), (None, None), (400, []), (401, [1.0] * 3), (402, [1.0, None, 2.0, 3.0]), (403, [1.0, float("nan"), 0.0, 0.0]), (404, [float("-inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("cluster", "n", "distance", "label")})
    for k in (7, 500):
        got, centers = yinyang.cluster_vectors(spark, df.repartition(5), k=k, size=4)
        want, final = plain_clusters(rows, k, 5, 4)
        got = got.collect()
        assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in got) == want and centers.tolist() == final
        assert {r["inertia"] for r in got} == {sum(r[2] for r in want)}
        assert all(r["cluster_inertia"] == sum(w[2] for w in want if w[1] == r["cluster"]) for r in got)
    assert yinyang.cluster_vectors(spark, df.limit(0), size=4)[0].count() == 0
