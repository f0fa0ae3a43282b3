"""Operators against brute force on small tables with nulls, blanks, repeats and clashing columns."""

from __future__ import annotations

import itertools
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import language, sharding
from foliant.llm.brown import brown_scores
from foliant.llm.components import components
from foliant.llm.decontaminate import contamination, judged
from foliant.llm.frames import remainder
from foliant.llm.minhash import near_duplicates
from foliant.llm.mixing import mixed
from foliant.llm.pages import main_text
from foliant.llm.pseudonyms import pseudonymise
from foliant.llm.quality import quality_scores
from foliant.llm.sharding import assign_shards
from foliant.llm.subspace import near_vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, a string, key string, label string, shard string, n long"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdeé"), 3))
    base = [[word() for _ in range(int(rng.integers(6, 60)))] for _ in range(12)]
    out = [" ".join(b) for b in base]
    for b in base:
        for _ in range(3):
            near = list(b)
            for k in rng.integers(0, len(near), 2):
                near[k] = word()
            out.append(" ".join(near))
    out += [out[0], out[0].upper(), out[3], None, "", "  \n", "one", "One two", "one two", "x " * 5000 + "end"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s1", "s2", None][i % 4], 0, 1, "x", "y", "z", "w", 5) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], rows[1], (None, "lost id", "en", "s1", 0, 1, "x", "y", "z", "w", 5)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components(spark, monkeypatch):
    import foliant.llm.components as c

    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(40)] + [(500, i) for i in range(501, 530)]
    parent = {i: i for ab in links for i in ab}
    for a, b in links:
        x, y = root(parent, a), root(parent, b)
        parent[max(x, y)] = min(x, y)
    want = {i: root(parent, i) for ab in links if ab[0] != ab[1] for i in ab}
    df = spark.createDataFrame(links, "a long, b long")
    for few in (20_000, 3):
        monkeypatch.setattr(c, "FEW", few)
        assert {r.id: r.component for r in components(df).collect()} == want


def test_near_duplicates(docs, texts, empty):
    for size in (4, 5):
        sets = {}
        for i, t in enumerate(texts):
            w = spaced(t)
            sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
        parent = {i: i for i in sets}
        for a, b in itertools.combinations(sets, 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(parent, a), root(parent, b)
                parent[max(x, y)] = min(x, y)
        got = near_duplicates(docs, size=size).collect()
        assert len(got) == len(texts) + 3
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                c = root(parent, r.doc_id)
                assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), c, c == r.doc_id)
    assert near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("peels", "bundle", "shingles"), [(2, 128, 200_000), (0, 5, 200_000), (1, 3, 90)])
def test_links_between_classes_are_not_lost(spark, monkeypatch, peels, bundle, shingles):
    """Texts that chain: the first of a bucket links with few of it. Rounds and tiles of any size find the same."""
    import foliant.llm.minhash as m

    for name, value in (("PEELS", peels), ("BUNDLE", bundle), ("BUNDLE_SHINGLES", shingles)):
        monkeypatch.setattr(m, name, value)
    w = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w[i * 3 : i * 3 + 40])) for i in range(100)] + [(200 + i, " ".join(f"v{j}" for j in range(i * 20, i * 20 + 60))) for i in range(30)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
    assert {r.component_id for r in got if r.doc_id < 200} == {0} and all(r.kept for r in got if r.doc_id >= 200)


def test_contamination(spark, docs, texts, empty):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    items = [(1, texts[0]), (2, texts[5]), (3, "One! two"), (30, None), (31, "..."), (None, texts[2]), (4, texts[0])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    win = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for k in range(max(1, len(w) - 12)):
                win.setdefault(tuple(w[k : k + 13]), set()).add(i)
    for block_bytes in (4_000_000, 150):
        got = judged(contamination(docs, bench, block_bytes=block_bytes)).collect()
        assert len(got) == len(texts) + 3
        for r in got:
            w = words(texts[r.doc_id]) if r.doc_id is not None else ["lost", "id"]
            hit, found = set(), set()
            for size in {len(x) for x in win}:
                for k in range(len(w) - size + 1):
                    if own := win.get(tuple(w[k : k + size])):
                        hit |= set(range(k, k + size))
                        found |= own
            assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(found))
            assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert contamination(empty, bench).count() == 0
    assert contamination(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_brown(docs, texts, empty):
    got = brown_scores(docs, remainder("doc_id", 5) != 1, classes=8, head=16, shard_bytes=400).collect()
    rows = [(i, t) for i, t in [*enumerate(texts), (0, texts[0]), (1, texts[1])]]
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1
    c = Counter(w for i, t in rows if train(i) for w in [*spaced(t), "</s> "])
    total, v = sum(c.values()), len(c)
    assert len(got) == len(rows) + 1
    for r in got:
        w = [*spaced(texts[r.doc_id] if r.doc_id is not None else "lost id"), "</s> "]
        base = sum(math.log10((c[x] + 0.5) / (total + 0.5 * (v + 1))) for x in w)
        assert r.held_out != train(r.doc_id) and r.train_tokens == total and r.n_tokens == len(w) and r.n_known == sum(c[x] > 0 for x in w)
        assert abs(r.base_score - base) < 1e-6 and r.score <= 0 and math.isfinite(r.score)
    assert brown_scores(empty, remainder("doc_id", 5) != 1).count() == 0


def test_brown_classes_words_outside_the_head(spark):
    """Words of one spelling in two kinds of places: the places decide, not the spelling."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("bcdfgh"), 5)) + "zz"
    nouns, verbs = [word() for _ in range(40)], [word() for _ in range(40)]
    often = lambda: int(rng.integers(0, 5 if rng.random() < 0.5 else 40))
    rows = [(i, " ".join(f"the {nouns[often()]} we {verbs[often()]}" for _ in range(30))) for i in range(100)]
    rows += [(1000, " ".join(f"the {a} we {b}" for a, b in zip(nouns, verbs, strict=True))), (1001, " ".join(f"the {b} we {a}" for a, b in zip(nouns, verbs, strict=True)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in brown_scores(docs, F.col("doc_id") < 1000, classes=6, head=12).collect()}
    assert got[1000].score > got[1001].score + 20


def test_quality(spark, empty):
    good, bad = "the cat sat on the mat", "buy!! now!! $$$ cheap!! $$$"
    rows = [(i, good + f" w{i}" if i % 2 else bad + f" w{i}") for i in range(200)] + [(900, None), (901, ""), (902, "x " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(5, 0), (7, None), (None, 1)], "doc_id long, quality int")
    got = quality_scores(docs, labels, remainder("doc_id", 3) == 1).collect()
    assert len(got) == 203 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id < 200)
    assert quality_scores(empty, labels, remainder("doc_id", 3) == 1).count() == 0
    assert {r.score for r in quality_scores(docs, labels.where("false"), remainder("doc_id", 3) == 1).collect()} == {0.5}


def _vector_links(rows, threshold=0.95):
    """Links and components of (id, vector) rows the plain way; ids may not repeat."""
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    parent = {i: i for i in ids}
    for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        p, q = root(parent, ids[a]), root(parent, ids[b])
        parent[max(p, q)] = min(p, q)
    return {i: (int(near[k].sum()) - 1, root(parent, i)) for k, i in enumerate(ids)}


def test_vectors(spark, monkeypatch):
    import foliant.llm.subspace as s

    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16))
    for k in range(40):
        x[k] = x[k % 5] + 0.15 * rng.standard_normal(16)
    x[50] = x[51]
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [1.0, None] * 8), (405, [float("inf")] + [1.0] * 15), (406, [1.0, 0.0]), (407, [2.0, 0.0]), (0, rows[0][1]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vec", F.lit(1)).withColumn("id", F.lit("c"))
    want = _vector_links([r for r in rows if r[0] is not None and r[0] < 400][:300]) | {i: (0, i) for i in range(400, 406)} | {406: (1, 406), 407: (1, 406)}
    for tile, cells in ((8192, None), (16, 3), (40, 30)):
        monkeypatch.setattr(s, "TILE", tile)
        got = near_vectors(df, cells=cells).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.vec_id is None:
                assert r.component_id is None and r.n_links == 0 and r.kept
            elif r.vec_id != 0:
                extra = sum(root_links(rows, r.vec_id, 0))
                assert (r.n_links - extra, r.component_id) == want[r.vec_id], r
    assert near_vectors(df.where("false")).count() == 0


def root_links(rows, a, b):
    """1 if a links with b, which two rows hold."""
    x, y = (np.array(rows[i][1]) for i in (a, b)) if a < 300 else (np.ones(1), -np.ones(1))
    yield int(a != b and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_join_over_many_cells(spark, monkeypatch, kind):
    """Tens of cells a block and several tiles a cell: a dense group of near copies beside links at the edge of threshold and budgets."""
    import foliant.llm.subspace as s

    rng = np.random.default_rng(5)
    x = rng.standard_normal((1600, 24)).astype(np.float32).astype(float)
    x[:500] = x[0] + 0.2 * rng.standard_normal((500, 24))
    for k in range(500, 900, 2):
        u, w = x[k] / np.linalg.norm(x[k]), x[k + 1]
        w = w - (w @ u) * u
        c = 0.95 + rng.uniform(-0.01, 0.01)
        x[k + 1] = 7 * (c * u + math.sqrt(1 - c * c) * w / np.linalg.norm(w))
    x = x.astype(np.float32) if kind == "float" else x
    rows = [(1000 + 3 * i, [float(v) for v in r]) for i, r in enumerate(x)]
    want = _vector_links(rows)
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    for tile, cells in ((64, 40), (8192, 4)):
        monkeypatch.setattr(s, "TILE", tile)
        monkeypatch.setattr(s, "BATCH", 100)
        got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df, cells=cells).collect()}
        assert got == want and max(n for n, _ in got.values()) > 300


def test_vectors_of_a_driver_table(spark):
    if not os.path.exists(at := "/root/testdata/sf0.01/embeddings.parquet"):
        pytest.skip("no table")
    df = spark.read.parquet(at)
    want = _vector_links([(r.vec_id, r.embedding) for r in df.collect()])
    assert {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df, cells=20).collect()} == want


def test_main_text_drops_what_a_host_repeats(spark):
    page = lambda i: f"<body><div class='top'>Welcome to our site</div><div class='story'><p>Story {i} alone</p></div><div class='end'>All rights reserved</div></body>"
    rows = [(i, f"http://h.org/{i}", page(i)) for i in range(8)] + [(90, "http://one.org/", page(90)), (91, None, None), (92, "http://h.org/x", ""), (3, "http://h.org/3", page(3))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1))
    got = {r.page_id: (r.text, r.n_chars) for r in main_text(df).collect()}
    assert got[2] == ("Story 2 alone", 13) and got[91] == got[92] == ("", 0)
    assert got[90][0] == "Story 90 alone"  # what other hosts repeat in these places goes where a host has one page
    assert main_text(df.where("false")).count() == 0


def test_main_text_weighs_roles_with_the_tree(spark):
    """A prompt that a host repeats in its articles goes; text beside teaser articles stays, and they go."""
    rows = [(i, f"http://a.org/{i}", f"<body><nav>Way {i}</nav><article><p>Story {i} alone and long</p><div class='x7'>Tell your friends</div></article></body>") for i in range(8)]
    card = lambda i: f"<article><h3>Card {i}</h3></article>"
    rows += [(20 + i, f"http://b.org/{i}", f"<body><div id='content'><p>{f'Long text {i} of the page. ' * 9}</p></div>{card(i)}{card(i + 1)}{card(i + 2)}</body>") for i in range(8)]
    rows += [(40 + i, "http://c.org/", "<body><article><p>The same page</p></article></body>") for i in range(8)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} alone and long" and got[20 + i] == (f"Long text {i} of the page. " * 9).strip() and got[40 + i] == "The same page" for i in range(8))


def test_shards(spark, docs, texts, empty):
    for limit in (100, 700, 10**9):
        got = assign_shards(docs, limit).collect()
        assert len(got) == len(texts) + 3
        size = Counter()
        for r in got:
            size[r.shard] += r.n_bytes
        for r in got:
            assert size[r.shard] == r.shard_bytes and (r.shard_bytes <= limit or r.shard_bytes == r.n_bytes)
    assert assign_shards(empty, 100).count() == 0
    many = spark.createDataFrame([(7, "same text")] * 50 + [(7, "other")], "doc_id long, text string")
    got = assign_shards(many, 20).collect()
    assert len(got) == 51 and max(Counter(r.shard for r in got).values()) == 2
    assert sharding.hash60("doc_id") is not None


def test_mixing(docs, empty):
    total = {}
    for r in docs.collect():
        total[r.source] = total.get(r.source, 0) + len(spaced(r.text))
    got = mixed(docs, repetition=1.5, block_tokens=50).collect()
    taken = Counter()
    for r in got:
        taken[r.source] += r.n_tokens
    assert all(taken[s] <= 1.5 * n + 1 for s, n in total.items()) and sum(taken.values()) <= sum(total.values())
    assert mixed(docs, repetition=1.5, block_tokens=50).exceptAll(mixed(docs, repetition=1.5, block_tokens=50)).count() == 0
    assert mixed(empty).count() == 0


def test_language(spark, docs, empty):
    en, de = "the quick brown fox and the lazy dog with that", "der schnelle braune fuchs und der faule hund mit dem"
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de", f"h{i % 3}.example.org") for i in range(60)] + [(90, None, "en", None), (91, "", None, ""), (92, "123 !!", "xx", "h1.example.org"), (93, en, None, "new.net"), (94, de * 2000, "en", "h1.example.org")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    ev = df.select(*language.evidence(F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source")))
    got = {r.key: r for r in language.identify(ev, language.fit(ev.where("key < 90"))).collect()}
    assert all(got[i].language == ("en" if i % 2 else "de") and got[i].accepted for i in range(60))
    assert got[93].language == "en" and got[94].language == "de" and not any(got[i].accepted for i in (90, 91, 92))
    none = empty.select(*language.evidence(F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source")))
    assert language.identify(none, language.fit(none)).count() == 0


def test_language_of_no_fitted_language(spark):
    en, de = "the quick brown fox and the lazy dog with that", "der schnelle braune fuchs und der faule hund mit dem"
    rows = [(i, en if i % 5 else de, "en" if i % 5 else "de", "h.org") for i in range(400)]
    rows += [(900, "быстрая коричневая лиса прыгает через ленивую собаку " * 4, "en", "h.org"), (901, "敏捷的棕色狐狸跳过了懒狗" * 4, None, None), (902, "qJx7Zk0vWpY3hKbN8cRfTg2mLsXdQz" * 4, "de", None), (903, "the lazy fox", None, None)]
    ev = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select(*language.evidence(F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source")))
    got = {r.key: r for r in language.identify(ev, language.fit(ev.where("key < 900"))).collect()}
    assert [got[i].accepted for i in (900, 901, 902, 903)] == [False, False, False, True] and all(got[i].accepted and got[i].language == got[i].declared for i in range(400))


def test_language_takes_every_declared_language(spark):
    """Each of 70 languages, and one of few rows among many of another; without declarations texts with letters stay."""
    rng = np.random.default_rng(6)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(8)] for _ in range(70)]
    rows = [(70 * j + k, " ".join(rng.permutation(words[k])), chr(97 + k // 26) + chr(97 + k % 26), None) for k in range(70) for j in range(6)]
    rows += [(10_000 + j, " ".join(rng.permutation(words[0])) + f" {j}", "aa", None) for j in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.fit(df.select("text", F.col("lang").alias("declared")), sample=700, each=10)
    assert set(model.languages) == {r[2] for r in rows} and all(len(np.unique(t)) > 1 for t in model.table)
    bare = df.where("doc_id in (0, 70, 140)").unionAll(spark.createDataFrame([(-1, "12 !!", None, None), (-2, None, None, None)], df.schema)).withColumn("lang", F.lit(None).cast("string"))
    ev = bare.select(*language.evidence(F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source")))
    assert {r.key: r.accepted for r in language.identify(ev, language.fit(ev)).collect()} == {0: True, 70: True, 140: True, -1: False, -2: False}


def test_pseudonyms_link(spark, empty):
    df = spark.createDataFrame([(1, "call 10.2.3.4"), (2, "at 10.2.3.4!"), (3, None), (4, ""), (1, "call 10.2.3.4")], "doc_id long, text string").withColumn("kinds", F.lit(0))
    got = sorted(pseudonymise(df, b"k").collect(), key=lambda r: r.doc_id)
    ip = re.search(r"[\d.]+\d", got[0].text)[0]
    assert len(got) == 5 and ip != "10.2.3.4" and ip in got[2].text and got[3].text is None and got[4].text == ""
    assert pseudonymise(empty, b"k").count() == 0
