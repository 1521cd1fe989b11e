"""The operators as queries: contracts by plain versions, odd rows, and the pipeline's stages."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stepwell.llm import chat, html, jaccard, langid, mixing, ogg, packing, quality, registry, sharding, tokens
from stepwell.llm.common import table

SF = "/root/testdata/sf0.001"
LONG = "long text of many words " * 8000
ROWS = [(1, "a b c d e f g", "en", "s1", 1), (2, "a b c d e f g", "en", "s1", 1), (2, "a b c d e f g", "en", "s1", 1), (3, None, None, None, None), (4, "", "en", "s2", 0), (5, LONG, "en", "s2", 9), (None, "a lone text", None, "s1", 3), (6, "퟿ é 日本 \u0000 x", "fr", None, 5)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd(spark):
    """Nulls, an empty and a very long text, ties, repeated rows, and columns whose names might clash."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("kept", "score", "size", "shard", "rest", "base", "bucket", "leaf", "fp", "label")})


def test_sql_agrees(spark):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        got, want = registry.queries()[name](spark, SF).toPandas(), con.execute(sql).df()
        columns = sorted(want.columns)
        tidy = lambda df: df[columns].sort_values(columns).reset_index(drop=True)  # noqa: B023, E731
        pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False)


def test_ogg_query(spark, odd):
    rows = ogg.read_media(ogg.encode_texts(odd)).collect()
    assert len(rows) == len(ROWS) and all(r["bad_pages"] == 0 for r in rows)
    want = Counter()
    for k, t, *_ in ROWS:
        raw = (t or "").encode()
        p = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        want[k, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    assert ogg.packets(ogg.encode_texts(odd.limit(1))).count() == 2
    assert ogg.read_media(ogg.encode_texts(odd.limit(0))).count() == 0


def test_shards(spark, odd):
    for docs in (odd, table(spark, SF, "documents")):
        pdf = sharding.minimax_shards(spark, docs, 4).toPandas()
        assert len(pdf) == docs.count() and (pdf.groupby("text_crc32").shard.nunique() == 1).all()
        for _, g in pdf.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))
    texts = [r["text"] or "" for r in table(spark, SF, "documents").select("text").collect()]
    size = Counter()
    for t in texts:
        size[int(hashlib.sha256(t.encode()).hexdigest()[:15], 16)] += len(t.encode()) + 1
    best = sharding.smallest_capacity(np.array([size[k] for k in sorted(size)]), 4)
    assert pdf.groupby("shard")["size"].sum().max() == best
    groups = spark.createDataFrame(sorted(size.items()), "key long, size long")
    assert sharding.cut_keys(groups, 4, buckets=8, gathered=16) and sharding.minimax_shards(spark, odd.limit(0)).count() == 0


def test_rows_that_repeat_very_often_get_slots(spark):
    rows = [(None, "the same")] * 700 + [(k, "the same") for k in range(50)] + [(k, f"text {k % 40}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.lit(1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("key"), (F.crc32(F.col("text").cast("binary")) % 3).cast("int").alias("shard"))
    pdf = sharding.assign_slots(df, 3, len(rows), window=64).toPandas()
    assert len(pdf) == len(rows) and all(sorted(g.slot) == list(range(len(g))) for _, g in pdf.groupby("shard"))
    assert Counter(map(str, pdf.doc_id)) == Counter(str(float(k)) if k is not None else "nan" for k, _ in rows)


def test_prefix_targets(spark):
    rows = [(1, 0, "user", r"a\<|im_end|>\n"), (1, 1, "assistant", "r1"), (1, 1, "assistant", "r1"), (1, 2, "us\ner", None), (2, 0, None, "only"), (None, 0, "assistant", "x"), (3, 0, "assistant", chat.PLANTED)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    examples = chat.prefix_targets(df)
    assert sorted((r["conv_id"] or 0, r["n_turns"]) for r in examples.collect()) == [(0, 1), (1, 2), (1, 3), (1, 4), (2, 1), (3, 1)]
    got = {r["conv_id"]: r for r in chat.read_back(examples).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[conv]["n_turns"] == len(turns)
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[conv]["loss_chars"] == len(loss)


def test_prefix_targets_of_long_texts_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, last string"
    long = "a <|im_end|> of many words\n" * 40_000
    rows = [(1, 0, "user", long, "x", "y"), (1, 1, "assistant", long + "!", "x", "y"), (1, 2, "user", "", "x", "y")]
    got = chat.read_back(chat.prefix_targets(spark.createDataFrame(rows, schema))).collect()
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"], r["loss_sha256"]) for r in got] == [(1, 3, len(long) + 1, hashlib.sha256((long + "!").encode()).hexdigest())]
    assert chat.read_back(chat.prefix_targets(spark.createDataFrame([], schema))).count() == 0


def test_quality_query(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality.verdicts(odd, quality.fit_lines(odd, labels)).collect()}
    assert rows[3]["n_words"] == 0 and rows[3]["base_failed"] and not rows[5]["kept"] and rows[5]["n_repeat_words"] == 40_000
    assert quality.verdicts(odd.limit(0), quality.fit_lines(odd.limit(0), labels)).count() == 0
    field = quality.fit_lines(table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels"))
    assert quality.passes("The river ran by the mill, and the miller slept. " * 1 + "He dreamt of corn and rain, of carts on the road, and of the long way home.", field)
    assert not quality.passes("BUY!! THIS!! NOW!! AND!! MORE!! OF!! IT!! TO!! GET!! RICH!! " + "ONE!! TWO!! THREE!! FOUR!! FIVE!! SIX!! SEVEN!! EIGHT!! NINE!! TEN!! TO!!", field)


def test_field_labels_lines_of_held_out_documents(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    field = quality.fit_lines(docs.where("doc_id % 2 = 0"), labels)
    rows = docs.where("doc_id % 2 = 1").join(labels, "doc_id").select("doc_id", "text", "quality").orderBy("doc_id").collect()
    pools = [[[t for t in r["text"].split("\n") if t.split()] for r in rows if r["quality"] == v] for v in (0, 1)]
    rng, hits, shares = random.Random(3), ([], []), []
    for _ in range(150):
        lines = []
        for k in (0, 1, 0, 1)[rng.randrange(2) :]:
            own = rng.choice([d for d in pools[k] if len(d) > 2])
            at = rng.randrange(len(own) - 1)
            lines += [(k, t) for t in own[at : at + 5]]
        text = "\n".join(t for _, t in lines)
        for (k, _), (_, content) in zip(lines, quality.label_lines(text, field), strict=True):
            hits[k].append(content == bool(k))
        shares.append(quality.judge(text, field)[1])
    # a document of low quality holds clean lines too, so not all of its lines can count as junk
    assert np.mean(hits[1]) > 0.97 and np.mean(hits[0]) > 0.8 and np.mean(hits[0] + hits[1]) > 0.9
    assert np.mean([0 < s < 1 for s in shares]) > 0.8


def brute(texts):
    """Partners of each distinct text's shingle set, and the least id of its component."""
    sets, links, least = defaultdict(list), Counter(), {}
    for k, t in texts:
        w = (t or "").encode().split()
        sets[frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset({(k,)})].append(k)
    keys = list(sets)
    root = list(range(len(keys)))
    for a in range(len(keys)):
        for b in range(a):
            if len(keys[a] & keys[b]) >= 0.8 * len(keys[a] | keys[b]):
                links[a] += 1
                links[b] += 1
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
    for a in range(len(keys)):
        group = min(k for b in range(len(keys)) if root[b] == root[a] for k in sets[keys[b]])
        for k in sets[keys[a]]:
            least[k] = (group, links[a])
    return least


def test_near_duplicates_equal_brute_force(spark, odd, monkeypatch):
    base = [f"w{k}" for k in range(60)]
    texts = [(k, " ".join(base[:i] + [f"x{k}"] + base[i + 1 :])) for k, i in enumerate([0] * 30 + list(range(30)))]
    texts += [(100 + k, " ".join(f"y{k}_{i}" for i in range(20)) + " the same line at the end of all texts") for k in range(40)] + [(200, None), (201, ""), (202, "a b"), (203, "a b")]
    want = brute(texts)
    for small in (256, 8):  # the second splits buckets, and compares blocks of what stays large
        monkeypatch.setattr(jaccard, "SMALL", small)
        monkeypatch.setattr(jaccard, "BLOCK", small)
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
        assert sum(got[k] != want[k] for k in want) <= 0.02 * len(want) and len(got) == len(want)
    rows = jaccard.near_duplicates(odd).collect()
    assert len(rows) == len(ROWS) and {r["class_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert jaccard.near_duplicates(odd.limit(0)).count() == 0


def test_crowded_buckets_are_split_deeper(spark, monkeypatch):
    """Short texts of many sizes that share half their words, with near copies among them and one family."""
    rng = random.Random(14)
    shared = [f"s{i}" for i in range(12)]
    texts = []
    for k in range(150):
        own = [f"y{k}_{i}" for i in range(8 + k % 9)]
        texts.append((k, " ".join(own + shared)))
        if k % 10 == 0:
            texts.append((1000 + k, " ".join([*own, *shared, "end"])))
    base = [f"w{k}" for k in range(80)]
    texts += [(2000 + k, " ".join([*base, *(f"z{k}" for _ in range(k % 3 + 1))])) for k in range(40)] + [(3000 + k, " ".join(base + [f"v{i}" for i in range(7 * k)])) for k in range(8)]
    rng.shuffle(texts)
    want = brute(texts)
    monkeypatch.setattr(jaccard, "SMALL", 6)
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    space = jaccard.Workspace(spark, "crowded")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(docs, space=space).collect()}
    assert sum(got[k] != want[k] for k in want) <= 0.02 * len(want) and len(got) == len(want)
    deep = [k for k in (6, 12, 24) if docs.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{space.path}/depth{k}-leaves").getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{space.path}/depth{k}-leaves"))]
    assert deep, "no bucket was split on more than three levels"


def test_leaves_with_equal_members_stay_once_and_trees_grow_from_large_nodes(spark, monkeypatch):
    """Near copies meet in many leaves, which are compared once; a tree of 24 levels is not written out whole."""
    texts = [(k, " ".join([*(f"w{i}" for i in range(60)), f"z{k}"])) for k in range(12)] + [(100 + k, " ".join(f"v{k // 2}_{i}" for i in range(40 + k % 2))) for k in range(12)]
    for small in (256, 6):
        monkeypatch.setattr(jaccard, "SMALL", small)
        space = jaccard.Workspace(spark, "merged")
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(docs, space=space).collect()}
        assert got == brute(texts)
        before, after = (spark.read.parquet(f"{space.path}/{name}").count() for name in ("leaves", "all-leaves"))
        assert after < 0.5 * before
    tokens = jaccard.shingles(jaccard.word_hashes(texts[0][1]))
    words = spark.createDataFrame([(1, jaccard.word_hashes(texts[0][1]).tobytes())], "fp long, words binary")
    first = jaccard._first_nodes(words, 60, 0.8)
    leaves = sorted(r["leaf"] for r in first.collect())
    assert leaves == sorted(jaccard.paths(tokens, 60, 0.8, 1)[1])
    grown = jaccard._next_nodes(words, 0.8)(first, spark.createDataFrame([(leaves[0],)], "leaf long"), 2)
    levels, nodes, parents = jaccard.paths(tokens, 60, 0.8, 2)
    assert sorted(r["leaf"] for r in grown.collect()) == sorted(n for x, n, p in zip(levels, nodes, parents, strict=True) if x == 2 and p == leaves[0])


def test_words_of_unwanted_sets_are_not_dealt(spark, tmp_path):
    """Few of the sets are wanted: the words of the others stay where they are, and null ids are found as well."""
    space = jaccard.Workspace(spark, "words")
    sigs = space.save(spark.range(1, 4001).select(F.col("id").alias("fp"), F.when(F.col("id") % 50 != 0, F.col("id")).alias("doc_id"), F.lit(5).cast("long").alias("size"), F.repeat(F.md5(F.col("id").cast("string")), 40).cast("binary").alias("words")), "sigs")
    sets = sigs.select("fp", F.col("doc_id").alias("first"))
    wanted = spark.createDataFrame([(k,) for k in (7, 50, 3999)], "fp long")
    got = jaccard._words(wanted, sigs, sets, space, "some")
    assert {r["fp"]: bytes(r["words"]) for r in got.collect()} == {r["fp"]: bytes(r["words"]) for r in sigs.where("fp in (7, 50, 3999)").collect()}
    need = sets.join(wanted, "fp").select("fp", F.col("first").alias("doc_id"))
    assert {7, 50, 3999} <= {r["fp"] for r in jaccard._likely(sigs, need, ["fp", "doc_id"]).collect()} and jaccard._likely(sigs, need, ["fp", "doc_id"]).count() < 20
    assert jaccard._likely(sigs, need.limit(0), ["fp", "doc_id"]).count() == 0


def test_components_settle_without_a_round_that_changes_nothing(spark):
    """Stars of roots are seen as such: one round does for them, and chains still come to their least node."""
    space = jaccard.Workspace(spark, "components")
    edges = spark.createDataFrame([(k, 1) for k in range(2, 9)] + [(11, 10), (12, 10)], "a long, b long")
    want = {k: 1 for k in range(1, 9)} | {k: 10 for k in (10, 11, 12)}
    assert {r["node"]: r["label"] for r in jaccard.components(edges, space, rounds=1).collect()} == want
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {r["node"]: r["label"] for r in jaccard.components(chain, jaccard.Workspace(spark, "chain")).collect()} == {k: 0 for k in range(41)}


def test_blocks_meet_only_where_sizes_allow(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    sizes = [5, 6, 7, 8, 10, 12, 13, 16, 20, 25, 40, 50, 51, 100, 125, 1000] * 3
    brief = spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "fp long, size long")
    leaves = spark.createDataFrame([(k, 7, len(sizes)) for k in range(len(sizes))], "fp long, leaf long, n long")
    blocks = defaultdict(list)
    for r in jaccard._blocks(leaves, brief, 0.8).collect():
        blocks[r["one"], r["other"]].append((r["fp"], r["side"]))
    met = Counter()
    for (one, other), members in blocks.items():
        for a in range(len(members)):
            for b in range(a):
                if one == other or members[a][1] != members[b][1]:
                    met[frozenset((members[a][0], members[b][0]))] += 1
    assert set(met.values()) == {1}  # a pair meets once
    alike = {frozenset((a, b)) for a in range(len(sizes)) for b in range(a) if min(sizes[a], sizes[b]) >= 0.8 * max(sizes[a], sizes[b])}
    assert alike <= set(met) and len(met) < 0.6 * len(sizes) * (len(sizes) - 1) / 2


def test_recall_of_near_copies_by_edit_rate(spark):
    """Copies with some of their words changed: all pairs whose exact similarity is 0.8 or more are linked, others never."""
    rng = random.Random(15)
    texts, pairs = [], {}
    for rate in (0.005, 0.01, 0.02, 0.03, 0.05):
        for _ in range(60):
            words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
            other = [f"e{rng.randrange(5000)}" if rng.random() < rate else w for w in words]
            pairs[len(texts)] = rate
            texts += [(len(texts), " ".join(words)), (len(texts) + 1, " ".join(other))]
    got = {r["doc_id"]: r["class_id"] for r in jaccard.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    grams = lambda t: {tuple(w) for w in zip(*(t.split()[k:] for k in range(5)), strict=False)}
    similar = {k: len(grams(texts[k][1]) & grams(texts[k + 1][1])) / len(grams(texts[k][1]) | grams(texts[k + 1][1])) >= 0.8 for k in pairs}
    linked = {k: got[k] == got[k + 1] for k in pairs}
    assert not any(linked[k] and not similar[k] for k in pairs)
    assert sum(linked.values()) >= 0.98 * sum(similar.values())
    caught = {rate: np.mean([linked[k] for k in pairs if pairs[k] == rate]) for rate in (0.005, 0.01, 0.02, 0.03, 0.05)}
    assert caught[0.005] > 0.95 and caught[0.01] > 0.9 and caught[0.05] < 0.3  # what five words and 0.8 mean for edits


def test_html_query(spark):
    long = ("word " * 60 + "</p><p>") * 4000
    rows = [(1, "u", "<article><p>x  y</p></article>"), (2, None, None), (3, "u", ""), (3, "u", ""), (None, "v", f"<div><p>{long}</p></div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("z"), "n_chars": F.lit(1), "length": F.lit(2)})
    got = html.extract(df).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 4000 * 300 - 1), (1, 3), (2, 0), (3, 0), (3, 0)]
    assert {r["text"] for r in got if r["page_id"]} == {"x y", ""}
    assert html.extract(df.limit(0)).count() == 0


def test_html_query_equals_the_text_of_marked_articles(spark):
    import html as entities
    import re

    pages = table(spark, SF, "pages").collect()
    got = {r["page_id"]: r["text"] for r in registry.queries()["op6_line_blocks"](spark, SF).collect()}
    for r in pages:  # a plain version for pages of this one form
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        parts = [" ".join(entities.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inside)]
        assert got[r["page_id"]] == "\n".join(x for x in parts if x)
    assert len(got) == len(pages)


def test_language_held_out_accuracy(spark, odd):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = registry.queries()["op7_byte_cnn"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and len(got) == docs.count()
    assert all((zlib.crc32(str(k).encode()) % 5 == 0) == h for k, h in zip(got.doc_id, got.held_out, strict=True))
    assert langid.identify(odd, langid.fit_language(odd.limit(0))).where("lang_pred = 'und'").count() == len(ROWS)


def test_language_sample_is_bounded_for_any_name(spark, odd):
    names = ["fr (France)", "it's", 'a "quoted" one', "zh\n", ""]
    rows = [(k, f"text {k} of {names[k % 5]} " + "abcde"[k % 5] * 9, names[k % 5]) for k in range(6000)] + [(7, f"of one id {k}", "hot") for k in range(500)] + [(None, "no id", "en"), (8001, None, "en"), (8002, "no lang", None), (8003, "1 2 3", "digits")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit(1), "windows": F.lit(1), "share": F.lit(1)})
    sample = langid.sample_windows(docs, 100).collect()
    per = Counter(r["lang"] for r in sample)
    assert set(per) == {*names, "hot"} and all(60 < per[n] < 150 for n in names) and per["hot"] == 1
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in sample)
    assert Counter(r["lang"] for r in langid.sample_windows(docs, 100, total=60).collect())["it's"] < 25
    net = langid.fit_language(docs, 100)
    assert net.langs == sorted({*names, "hot"})
    got = {(r["doc_id"], r["score"] >= 0): r["lang_pred"] for r in langid.identify(docs, net).collect()}
    assert got[8001, True] == got[8003, True] == "und" and {got[k, True] for k in range(100)} - {"und"} <= set(net.langs)
    again = langid.identify(odd, net).collect()
    assert len(again) == len(ROWS) and all(0 <= r["score"] <= 1 for r in again) and {r["lang_pred"] for r in again if r["doc_id"] in (3, 4)} == {"und"}


def test_token_files_round_trip(spark, odd, tmp_path, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    more = [(7, "a <|endoftext|> b", None, None, 1)] + [(8, f"of one id {k % 5}", None, None, 1) for k in range(60)] + [(9, "the same row", None, None, 1)] * 60
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, SCHEMA).select("doc_id", "text"))
    manifest = tokens.write_files(docs, f"file://{tmp_path}", path, parts=9)
    rows = sorted(tokens.read_documents(spark, f"file://{tmp_path}", manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((r[0] for r in ROWS + more), key=lambda k: (k is not None, k or 0))
    encode = lambda t: library.encode(t or "", add_special_tokens=False).ids + [2]
    want = Counter((k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, ids in ((r[0], encode(r[1])) for r in ROWS + more))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    assert [r["start"] for r in rows] == [sum(r["n_tokens"] for r in rows[:k]) for k in range(len(rows))]
    assert manifest["ids"] == sum(r["n_tokens"] for r in rows) and len(manifest["parts"]) > 4  # rows of one id, and repeated rows, lie in several parts
    # reads by position, a few documents or ids at a time, give the same
    monkeypatch.setattr(tokens, "READ_DOCS", 3)
    monkeypatch.setattr(tokens, "READ_IDS", 5)
    for part in manifest["parts"]:
        mapped, placed = tokens.PartReader(f"file://{tmp_path}", part), tokens.PartReader(f"file://{tmp_path}", part)
        placed.maps, placed.files = {}, {k: open(f"{tmp_path}/{part['part']:06d}.{k}", "rb") for k in ("ids", "off", "doc")}
        placed.files = {k: pa.PythonFile(f, mode="r") for k, f in placed.files.items()}
        for reader in (mapped, placed):
            got = [(int(a), int(b - a), c) for _, bounds, crc in reader.documents(part["docs"]) for a, b, c in zip(bounds[:-1], bounds[1:], crc, strict=True)]
            assert got == [(r["start"] - part["base_ids"], r["n_tokens"], r["ids_crc32"]) for r in rows[part["base_docs"] : part["base_docs"] + part["docs"]]]
    empty = tokens.write_files(odd.limit(0), f"file://{tmp_path}/empty", path)
    assert tokens.read_documents(spark, f"file://{tmp_path}/empty", empty).count() == 0


def test_packing_query(spark, odd, monkeypatch):
    import public_tokenizers

    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for docs, bucket in ((odd, 16_000), (table(spark, SF, "documents"), 40)):
        monkeypatch.setattr(packing, "BUCKET", bucket)
        pdf = packing.pack_documents(docs, path).toPandas().sort_values(["sequence_id", "offset"])
        per = pdf.groupby("sequence_id").length
        assert (pdf.offset == per.cumsum() - pdf.length).all() and per.sum().max() <= 4096
        pieces = Counter()
        for r in docs.select("doc_id", "text").collect():
            ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
            pieces.update((str(r["doc_id"]), k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096)))
        assert Counter((str(None if pd.isna(r.doc_id) else int(r.doc_id)), r.piece, r.start, r.length, r.ids_crc32) for r in pdf.itertuples()) == pieces
        assert per.ngroups <= -(-int(pdf.length.sum()) // 4096) + 2
    assert packing.pack_documents(odd.limit(0), path).count() == 0


def test_mixing_keeps_columns_and_targets(spark, odd):
    got = mixing.mix_rows(spark, odd)
    assert got.columns == odd.columns and mixing.mix_rows(spark, odd.limit(0)).count() == 0
    takes = mixing.mix_takes(spark, table(spark, SF, "documents")).toPandas()
    assert (takes.taken <= 2 * takes["size"]).all()
    per = takes.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), largest=("size", "max"))
    assert ((per.taken - per.target).abs() <= per.largest).all()
    assert abs(per.target.sum() - 1.5 * takes["size"].sum()) < 1e-3


def test_pipeline_stages(spark, odd):
    import corpus_pipeline

    docs = table(spark, SF, "documents").withColumn("kept", F.lit(1))
    columns = docs.columns
    docs = docs.unionByName(docs.limit(20))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), stage(spark, docs.limit(0), SF).schema)
        if name != "packing":
            assert docs.columns == columns
        if name == "near_duplicates":
            want = brute([(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").distinct().collect()])
            assert docs.count() == len({g for g, _ in want.values()})
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == {g for g, _ in want.values()}
    assert docs.count() > 0


def test_pipeline_stages_on_odd_rows(spark, odd):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    good = table(spark, SF, "documents").join(table(spark, SF, "labels").where("quality = 1"), "doc_id").where("length(text) between 300 and 3000")
    texts = [(r["doc_id"], r["text"], r["lang"]) for r in good.dropDuplicates(["text"]).orderBy("doc_id").limit(60).collect()]
    first, lang = texts[0][1:]
    rows = [(k, t, of, "s1", len(t)) for k, t, of in texts] + [(None, first, lang, None, 1)] * 2 + [(texts[0][0], first, lang, "s1", len(first))]
    names = [c for c in odd.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    docs = odd.unionByName(spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in names}))
    many = Counter(tuple(r) for r in docs.collect())
    for name in ("quality", "language", "near_duplicates", "mixing"):
        out = stages[name](spark, docs, SF)
        got = Counter(tuple(r) for r in out.collect())
        assert out.columns == docs.columns and set(got) <= set(many)
        if name in ("quality", "language"):  # equal texts share a fate
            assert all(got[r] in (0, n) for r, n in many.items()) and all(r[1] for r in got)
            assert {bool(got[r]) for r in many if r[1] == first} == {True}, name
        if name == "near_duplicates":
            assert max(got.values()) == 1 and sum(r[1] == first for r in got) <= 1
        if name == "mixing":
            assert all(n <= 2 * many[r] for r, n in got.items())
    packed = stages["packing"](spark, docs, SF).toPandas()
    assert len(packed[packed.piece == 0]) == sum(many.values()) and packed.doc_id.isna().sum() == 3


def test_pipeline_thins_null_and_repeated_ids_like_others(spark):
    import corpus_pipeline

    def near(name, k):  # all k of a name are near copies of each other
        return " ".join([f"{name}{i}" for i in range(60)] + [f"end{k}"])

    rows = [(None, ""), (None, ""), (4, ""), (None, near("a", 0)), (None, near("a", 1)), (1, near("a", 0)), (2, near("a", 2)), (None, near("b", 0)), (None, near("b", 1)), (None, near("b", 1)), (None, near("e", 0)), (0, near("f", 0))]
    rows += [(5, near("c", 0)), (5, near("c", 1)), (5, near("c", 0).replace(" ", "  ")), (5, near("d", 0)), (5, near("d", 0))]
    got = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted((str(r["doc_id"]), r["text"][:1]) for r in got) == [("0", "f"), ("1", "a"), ("4", ""), ("5", "c"), ("5", "d"), ("None", ""), ("None", "b"), ("None", "e")]
    assert all(tuple(r) in rows for r in got)
