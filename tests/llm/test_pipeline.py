"""The corpus pipeline's rows against a brute-force version of all five stages; the driver's tables against all pairs."""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import mixing, queries, sharding, stages
from foliant.llm.decontaminate import contamination
from foliant.llm.minhash import near_duplicates
from foliant.llm.mixing import mixed
from foliant.llm.sharding import assign_shards

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
spaced = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t))
words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def shingles(t, size):
    w = spaced(t)
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def classes(rows, size):
    """The smallest id that each (id, text) reaches."""
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            index[x].add(i)
    shared = Counter(p for ids in index.values() for p in itertools.combinations(sorted(ids), 2))
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def contaminated(t, windows):
    w = words(t)
    hit = {j for k in range(len(w)) for size in {len(x) for x in windows} if tuple(w[k : k + size]) in windows and k + size <= len(w) for j in range(k, k + size)}
    return bool(hit) and 20 * len(hit) >= len(w)


def mixture(rows, repetition, block):
    """(id, source, tokens, epoch, block) of rows (id, text, source), the plain way."""
    key = lambda s: "" if s is None else f"={s}"
    own = [(i, t, key(s), len(re.findall(r"[^\x09-\x0D\x20]+", t or ""))) for i, t, s in rows]
    tokens = Counter()
    for _, _, s, n in own:
        tokens[s] += n
    total = sum(tokens.values())
    sized = {s: n for s, n in tokens.items() if n}

    def weights(a):
        w = {s: (n / total) ** a for s, n in sized.items()}
        return {s: x / sum(w.values()) for s, x in w.items()}

    met = lambda k: max(w / sized[s] for s, w in weights(k / 1e6).items()) * total <= repetition * (1 + 1e-12)
    low, high = -1, 1_000_000
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if met(middle) else (middle, high)
    plan = {s: (1, 0, 1) for s, n in tokens.items() if not n}
    for s, w in weights(high / 1e6).items():
        q = math.floor(round(w * total, 3))
        plan[s] = (q // sized[s], q % sized[s], math.ceil(sized[s] / block))
    out, held = [], defaultdict(list)
    for i, t, s, n in own:
        epochs, rest, blocks = plan[s]
        h = int(hashlib.md5(f"{s}/{'' if i is None else i}".encode()).hexdigest()[:15], 16)
        out += [(i, s, n, e, h % blocks) for e in range(epochs)]
        if rest:
            held[s, h % blocks].append((h, i, t or "", n))
    for s, (epochs, rest, _) in plan.items():
        mine = sorted((hashlib.md5(f"{s}/{epochs}/{b}".encode()).hexdigest(), b) for s2, b in held if s2 == s)
        for _, b in mine:
            size = sum(x[3] for x in held[s, b])
            if rest <= 0:
                break
            left = rest
            for _, i, _, n in sorted(held[s, b]):
                if size <= rest or n <= left:
                    out.append((i, s, n, epochs, b))
                if size > rest:
                    left -= n
                    if left < 0:
                        break
            rest -= size
    return Counter(out)


def shards(rows, limit):
    """Counts of (id, bytes, shard, depth, shard bytes) of rows (id, text), the plain way."""
    own = [(i, t or "", len((t or "").encode()), int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)) for i, t in rows]
    sums = [Counter() for _ in range(61)]
    for _, _, n, h in own:
        for d in range(61):
            sums[d][h >> (60 - d)] += n
    out = []
    for i, t, n, h in own:
        d = next((d for d in range(61) if sums[d][h >> (60 - d)] <= limit), None)
        out.append((i, n, None if d is None else "s" + (format(h >> (60 - d), f"0{d}b") if d else ""), 60 if d is None else d, None if d is None else sums[d][h >> (60 - d)]))
    return Counter(out)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary, n))
    passage = make(40)
    rows = [(i, make(int(rng.integers(10, 90))), "en", ["s0", "s0", "s0", "s1", "s2", None][i % 6], 0) for i in range(80)]
    rows += [(100, rows[0][1], "en", "s0", 0), (101, rows[1][1] + " tail", "en", "s1", 0), (102, passage, "en", "s2", 0), (103, "12 34 !!", "en", "s1", 0), (104, None, "en", "s1", 0), (105, "  ", None, "s1", 0)]
    rows += [(106, make(30) + " " + passage, "en", "s0", 0), (107, make(4000), "en", "s0", 0), rows[5], (None, make(20), "en", "s0", 0), (108, rows[2][1].upper(), None, "s1", 0)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None), (None, "lost")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, passage


def test_all_five_stages(spark, corpus):
    import corpus_pipeline

    path, rows, passage = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    left = [r for r in rows if re.search("[A-Za-z]", r[1] or "")]
    found = {i: c for i, c in classes([(r[0], r[1]) for r in left if r[0] is not None], 5).items()}
    left2 = [r for r in left if r[0] is None or found[r[0]] == r[0]]
    w = words(passage)
    windows = {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
    left3 = [r for r in left2 if r[0] is None or not contaminated(r[1], windows)]
    assert len(left) > len(left2) > len(left3) > 60
    for (_, stage), want in zip(corpus_pipeline.STAGES, (left, left2, left3), strict=False):
        docs = stage(spark, docs, path)
        assert Counter(map(tuple, docs.collect())) == Counter(want) and docs.columns == [c.split()[0] for c in DOCUMENTS.split(", ")]
    four = mixture([(r[0], r[1], r[3]) for r in left3], stages.REPETITION, stages.BLOCK_TOKENS)
    rows4 = [r.doc_id for r in stages.mixing_stage(spark, docs, path).collect()]
    assert Counter(rows4) == Counter(x[0] for x in four.elements())
    text = {r[0]: r[1] for r in left3}
    out = corpus_pipeline.run(spark, path)
    got = Counter((r.doc_id, r.n_bytes, r.shard, r.depth, r.shard_bytes) for r in out.collect())
    assert got == shards([(x[0], text[x[0]]) for x in four.elements()], stages.SHARD_BYTES)
    assert {r.text for r in out.collect()} <= {r[1] for r in left3}


def test_stages_judge_rows_and_keep_their_columns(spark, corpus):
    """Names that clash or hold dots; an id with a clean and a contaminated text, and with a letterless one."""
    import corpus_pipeline

    path, rows, passage = corpus
    clean = [r[1] for r in rows if r[0] is not None and r[0] < 40]
    given = [(i, t, "en", "s", 0, 1, "x", "y", "z") for i, t in enumerate(clean)] + [(3, passage, "en", "s", 0, 1, "x", "y", "z"), (4, "12 !!", "en", "s", 0, 1, "x", "y", "z"), (None, "34 !!", "en", "s", 0, 1, "x", "y", "z"), (None, passage, "en", "s", 0, 1, "x", "y", "z")]
    docs = spark.createDataFrame(given, DOCUMENTS + ", key int, `a.b` string, epoch string, doc string")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs_ = stage(spark, docs, path)
        assert docs_.columns == docs.columns and {tuple(r)[5:] for r in docs_.collect()} == {(1, "x", "y", "z")}, name
        kept.append(Counter((r.doc_id, r.text) for r in docs_.collect()))
    everything = Counter((r[0], r[1]) for r in given)
    assert everything - kept[0] == Counter([(4, "12 !!"), (None, "34 !!")]) and everything - kept[2] == Counter([(3, passage), (None, passage)])


def test_stages_of_empty_tables(spark, corpus):
    import corpus_pipeline

    path, _, _ = corpus
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], DOCUMENTS), path).count() == 0


def test_mixing_and_sharding_against_brute_force(spark, corpus):
    path, rows, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for repetition, block in ((1.25, 200), (2.0, 50), (1.0, 20_000)):
        got = mixed(docs, repetition=repetition, block_tokens=block)
        want = mixture([(r[0], r[1], r[3]) for r in rows], repetition, block)
        assert Counter((r.doc_id, "" if r.source is None else f"={r.source}", r.n_tokens, r.epoch, r.block) for r in got.collect()) == want
    for limit in (300, 2000, 10**9):
        want = shards([(r[0], r[1]) for r in rows], limit)
        got = Counter((r.doc_id, r.n_bytes, r.shard, r.depth, r.shard_bytes) for r in assign_shards(docs, limit).collect())
        plain = Counter({k: n for k, n in want.items() if k[2] is not None})
        assert Counter({k: n for k, n in got.items() if "-" not in k[2]}) == plain and sum(got.values()) == len(rows)


def test_columns_of_any_name(spark):
    schema = "doc_id long, text string, source string, `_h` int, `_s` int, `a.b` int, `row` int, h int, s int, q int, left int, block string, depth string"
    df = spark.createDataFrame([(i, "word " * (i + 1), f"s{i % 2}", 1, 2, 3, 4, 5, 6, 7, 8, "x", "y") for i in range(9)], schema)
    m = mixed(df, repetition=1.5, block_tokens=5)
    assert set(m.columns) == {*df.columns, "n_tokens", "epoch"} and {(r["_h"], r["_s"], r["a.b"], r["row"], r["q"]) for r in m.collect()} == {(1, 2, 3, 4, 7)}
    for limit in (20, 60):
        g = assign_shards(df, limit)
        assert {(r["_h"], r["_s"], r["a.b"], r["row"], r["h"]) for r in g.collect()} == {(1, 2, 3, 4, 5)} and g.count() == 9


def test_sources_without_tokens_stay(spark):
    df = spark.createDataFrame([(1, "a b c", "x"), (2, "", "y"), (3, None, "y"), (4, " ", None)], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in mixed(df).collect()) == [1, 2, 3, 4]
    assert mixing.SQL.count("z0") == 3 and sharding.SQL


def test_benchmark_in_passes(spark, corpus, monkeypatch):
    import foliant.llm.decontaminate as d

    path, _, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    bench = docs.where("doc_id < 30").select(F.col("doc_id").alias("item_id"), F.concat(F.lit("x y "), "text").alias("text"))
    want = Counter(map(str, contamination(docs, bench).collect()))
    monkeypatch.setattr(d, "PASS_BLOCKS", 2)
    assert Counter(map(str, contamination(docs, bench, block_bytes=1500).collect())) == want and sum(r.n_hit > 0 for r in contamination(docs, bench).collect()) > 25


def test_contamination_digests(spark, corpus):
    """op7's listed items: sorted as strings, joined by commas."""
    path, rows, passage = corpus
    spark.createDataFrame([(2, passage), (10, passage), (1, passage[:60])], "item_id long, text string").write.mode("overwrite").parquet(f"{path}/two/benchmark.parquet")
    spark.read.parquet(f"{path}/documents.parquet").write.mode("overwrite").parquet(f"{path}/two/documents.parquet")
    got = {r.doc_id: r for r in queries.op7_fm_index(spark, f"{path}/two").collect()}
    listed = sorted(str(k) for k in (2, 10, 1))
    assert got[102].n_items == 3 and got[102].items_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest() and got[104].items_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="no table")
def test_near_duplicates_of_a_driver_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = classes([(r.doc_id, r.text) for r in docs.collect()], 4)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_duplicates(docs, size=4).collect()}
    assert {i: c for i, (c, _) in got.items()} == want and len(set(want.values())) < len(want)
