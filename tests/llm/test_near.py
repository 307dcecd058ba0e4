import random
import warnings
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from odd_rows import ODD, SCHEMA, words
from pyspark.sql import functions as F

from tallystone.llm import bagminhash as bag
from tallystone.llm import common


def tokens_of(text):
    out = []
    for chunk in (text or "").lower().split():
        a, b = 0, len(chunk)
        while a < b and not chunk[a].isalnum():
            a += 1
        while b > a and not chunk[b - 1].isalnum():
            b -= 1
        if a < b:
            out.append(chunk[a:b])
    return out


def multiset(text):
    w = tokens_of(text)
    out = defaultdict(int)
    for i in range(max(1, len(w) - 4) if w else 0):
        out[tuple(w[i : i + 5])] += 1
    return out


def jaccard(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / max(1, sum(max(a.get(k, 0), b.get(k, 0)) for k in keys))


def classes(docs, least=0.8):
    """Class of each row by comparing all pairs that share a shingle."""
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets, holders, texts = [multiset(t) for _, t in docs], defaultdict(set), {}
    for i, (_, t) in enumerate(docs):
        if t is not None:
            parent[root(i)] = root(texts.setdefault(t, i))
        for s in sets[i]:
            holders[s].add(i)
    for i, j in {(i, j) for h in holders.values() for i in h for j in h if i < j}:
        if jaccard(sets[i], sets[j]) >= least:
            parent[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(docs)):
        members[root(i)].append(i)
    return {i: sorted((docs[k][0] is None, docs[k][0] or 0) for k in m)[0] for m in members.values() for i in m}


def test_shingles_are_the_multisets():
    texts = ["", None, "one", "One, two!", "a b c d", "a b c d e", "A b. c d e a b c d e", "!!! ...", "é (É) x-y z"]
    doc, h, count = bag.shingles(pa.array(texts))
    for i, t in enumerate(texts):
        assert sorted(count[doc == i].tolist()) == sorted(multiset(t).values())
    assert set(h[doc == 5]) < set(h[doc == 6])
    assert len(set(h[doc == 4]) & set(h[doc == 5])) == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        for _ in range(6):
            keys = rng.integers(0, 2**63, 60).astype(np.uint64)
            a, b = ({int(k): int(rng.integers(1, 40)) for k in keys[part]} for part in (slice(0, 45), slice(15, 60)))
            b |= {k: a[k] for k in list(a)[20:35]}
            sig = []
            for s in (a, b):
                h = np.array(sorted(s), np.uint64)
                sig.append(bag.signatures(1, np.zeros(len(h), np.int64), h, np.array([s[int(k)] for k in h]), positions=3000)[0])
            assert (sig[0] == sig[1]).mean() == pytest.approx(jaccard(a, b), abs=0.04)


def test_signature_does_not_depend_on_the_end_time():
    doc, h, count = bag.shingles(pa.array([words(200, 5)]))
    one, two = (bag.signatures(1, doc, h, count, density=d) for d in (0.5, 20.0))
    assert (one == two).all()


def test_overlaps_in_blocks_equal_pairs():
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(50):
        w = base[:]
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(200)] = f"x{rng.randrange(50)}"
        texts.append(" ".join(w + w[:40] * (i % 7 == 0)))
    doc, h, count = bag.shingles(pa.array(texts))
    ends = np.searchsorted(doc, np.arange(51))
    rows = [(i, int(count[a:b].sum()), 0.1, i, 0, h[a:b], count[a:b]) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]
    for options in ({}, {"few": 2}, {"few": 100, "columns": 7}):
        got = bag._overlaps(rows, **options)
        for i in range(50):
            for j in range(i):
                s = jaccard(multiset(texts[i]), multiset(texts[j]))
                assert got[i, j] == round(s * (rows[i][1] + rows[j][1]) / (1 + s))


def found(df):
    return [(r.doc_id, r.class_id) for r in bag.near_duplicates(df).collect()]


def test_documents_against_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    want = classes(rows)
    assert dict(found(docs)) == {rows[i][0]: c for i, (_, c) in want.items()}


@pytest.mark.parametrize("block, words_each, hot", [(40, 80, 1000), (10**6, 80, 10), (7, 10**6, 1)])
def test_hot_groups_against_brute_force(spark, monkeypatch, block, words_each, hot):
    """A large group of copies of one text, many only linked over others, cut into small blocks."""
    rng, base = random.Random(9), words(80, 3).split()
    rows = []
    for i in range(260):
        w = base[:]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(80)] = f"q{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[3][1]) for i in range(50)] + [(2000 + i, words(60, 50 + i)) for i in range(30)]
    monkeypatch.setattr(bag, "BLOCK", block)
    monkeypatch.setattr(bag, "BLOCK_SHINGLES", 20 * words_each)
    monkeypatch.setattr(bag, "STAR_ROWS", 30)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    got = dict(found(df))
    want = {rows[i][0]: c for i, (_, c) in classes(rows).items()}
    # The bands miss a link with a chance of 7 in 100,000 at the least similarity.
    assert got == want


def test_odd_rows(odd, none):
    rows = [(i, t) for i, t, *_ in ODD]
    got = bag.near_duplicates(odd).collect()
    want = sorted(((i is None, i or 0), (c[0], c[1])) for (i, _), c in ((rows[k], c) for k, c in classes(rows).items()))
    assert sorted(((r.doc_id is None, r.doc_id or 0), (r.class_id is None, r.class_id or 0)) for r in got) == want
    kept = bag.deduplicated(odd)
    assert kept.columns == odd.columns
    left = kept.collect()
    assert sum(r.text is None for r in left) == 2
    assert sorted(r.doc_id for r in left if r.text is not None and r.doc_id is not None) == [1, 3, 4, 7, 8, 9]
    assert bag.near_duplicates(none).count() == 0 and bag.deduplicated(none).count() == 0


def test_components_of_chains(spark):
    n = 40
    chain = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    other = spark.createDataFrame([(100, 101), (101, 100), (102, 101)], "a long, b long")
    got = {r.node: r.component for r in bag.components(chain.unionByName(other)).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100, 102: 100}


def test_components_of_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    star = spark.range(1, 60).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    tail = spark.createDataFrame([(59, 200), (200, 201), (300, 300)], "a long, b long")
    got = {r.node: r.component for r in bag.components(star.unionByName(tail)).collect()}
    assert got == {i: 0 for i in [*range(60), 200, 201]} | {300: 300}
    assert bag.components(tail.where("a < 0")).count() == 0


@pytest.mark.parametrize("hot, most", [(1000, 100), (3, 100), (1, 4)])
def test_joins_of_hot_keys(spark, monkeypatch, hot, most):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(common, "HOT_KEYS", most)
    rows = spark.createDataFrame([(None if k == 9 else k, i) for k in range(10) for i in range(k + 1)], "k int, i int")
    unique = spark.createDataFrame([(k, f"v{k}") for k in range(8)], "k int, v string")
    keys = common.hot_keys(rows.groupBy("k").count())
    assert (keys is None) == (hot == 1000)
    assert keys is None or keys.count() <= most
    for how in ("inner", "left"):
        got = sorted(map(str, common.join_unique(rows, unique, "k", keys, how).select("k", "i", "v").collect()))
        assert got == sorted(map(str, rows.join(unique, "k", how).select("k", "i", "v").collect()))


def test_bitmaps_keep_all_that_is_wanted(spark, monkeypatch):
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("place"))
    wanted = rows.where("id % 10 = 0").select("place")
    got = {r.id for r in common.maybe_among(rows, "place", wanted).collect()}
    assert {i for i in range(0, 20_000, 10)} <= got and len(got) < 2000 + 18_000 / 32
    monkeypatch.setattr(common, "MOST_BITS", 1 << 15)
    few = {r.id for r in common.maybe_among(rows, "place", wanted).collect()}
    assert got <= few and common.maybe_among(rows, "place", wanted.where("false")).count() == 0


def test_verified_stars(spark, monkeypatch):
    monkeypatch.setattr(bag, "STAR_ROWS", 2)
    texts = {i: words(30 + i, 1) for i in range(8)} | {8: "", 9: "!!"}
    stars = [(a, b) for a in (0, 3, 8) for b in range(10) if a != b] + [(0, 77)]
    held = spark.createDataFrame(list(texts.items()), "node long, text string")
    got = {(r.a, r.b): r.similarity for r in bag.verified(spark.createDataFrame(stars, "a long, b long"), lambda rows: rows.join(held, "node")).collect()}
    assert got == pytest.approx({(a, b): jaccard(multiset(texts[a]), multiset(texts[b])) for a, b in stars if b in texts})


def test_hashes_of_words():
    chunks = ["", "a", "a.", "(a)", "...", "é", "«é»", "x-y", "日本", "ab", "ba", "a" * 5000, "a" * 4999, "1½", "_a_", "a\x00", "a\x00b"]
    got = bag.word_hashes(pa.array(chunks, pa.large_string()))
    inside = [(tokens_of(c) or [""])[0] for c in chunks]
    for i, x in enumerate(inside):
        assert (got[i] == 0) == (x == "")
        assert [bool(got[i] == g) for g in got] == [x == y for y in inside]
    many = bag.word_hashes(pa.array([f"w{i}" for i in range(200_000)], pa.large_string()))
    assert len(np.unique(many)) == 200_000
    assert bag.word_hashes(pa.array([], pa.large_string())).tolist() == []
