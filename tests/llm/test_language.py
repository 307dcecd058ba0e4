import zlib

import numpy as np
import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

from tallystone.llm import bytecnn


@pytest.fixture(scope="module")
def network(spark):
    return bytecnn.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_accuracy(spark, network):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = bytecnn.predict(docs, network, keep=["lang"]).withColumn("held", bytecnn.held_out()).where("held").collect()
    assert len(found) > 150
    assert np.mean([r.lang == r.lang_pred for r in found]) >= 0.97


def test_held_out_rows_are_those_of_the_checksum(docs):
    got = {r.doc_id: r.held for r in docs.select("doc_id", bytecnn.held_out().alias("held")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in got}


def test_tables_equal_the_convolution(network):
    rng = np.random.default_rng(1)
    windows = rng.integers(0, 256, (5, bytecnn.WINDOW), dtype=np.uint8)
    x = network.embedding[windows]
    features = []
    for w in bytecnn.WIDTHS:
        n = x.shape[1] - w + 1
        out = sum(x[:, j : j + n] @ network.kernels[w][j] for j in range(w)) + network.biases[w]
        features.append(np.maximum(out.max(axis=1), 0))
    logits = np.concatenate(features, axis=1) @ network.dense + network.bias
    want = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    assert network.log_probabilities(windows) == pytest.approx(want, abs=1e-3)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 508, 509, 510, 5000])
def test_windows_cover_every_run_of_bytes(n):
    doc, start = bytecnn.cut_windows(np.array([n, 3]))
    starts = start[doc == 0]
    widest = max(bytecnn.WIDTHS)
    for at in range(max(0, n - widest + 1)):
        assert any(s <= at and at + widest <= s + bytecnn.WINDOW for s in starts)
    assert (doc == 1).sum() == 1
    flat = np.arange(n + 3, dtype=np.int64) % 251
    filled = bytecnn.fill_windows(flat, starts, np.full(len(starts), n)) if n else None
    assert n == 0 or filled[0, : min(n, 256)].tolist() == flat[: min(n, 256)].tolist()


def test_every_window_of_a_long_text_counts(spark, network):
    english = " ".join(["the and of in is with"] * 400)
    rows = [(1, english), (2, english[:300] + " ".join(["der und die das ist nicht für über schön"] * 2000))]
    got = {r.doc_id: r.lang_pred for r in bytecnn.predict(spark.createDataFrame(rows, "doc_id long, text string"), network).collect()}
    assert got[2] == "de"


def test_odd_rows(spark, odd, none, network):
    got = bytecnn.predict(odd, network, keep=odd.columns)
    assert [c for c in got.columns if c not in ("lang_pred", "score")] == [c for c in odd.columns if c not in ("lang_pred", "score")]
    rows = got.collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert 0 <= r.score <= 1
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in network.languages
    assert bytecnn.fit(none) is None and bytecnn.predict(none, None).count() == 0
    assert {r.lang_pred for r in bytecnn.predict(odd, None).collect()} == {"und"}


def test_only_the_text_is_an_input(spark, docs, network):
    few = docs.limit(60)
    plain = {r.doc_id: (r.lang_pred, r.score) for r in bytecnn.predict(few, network).collect()}
    other = few.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "doc_id": F.col("doc_id") + 10**6})
    assert {r.doc_id - 10**6: (r.lang_pred, r.score) for r in bytecnn.predict(other, network).collect()} == plain


def test_learning_ignores_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    changed = docs.withColumn("lang", F.when(bytecnn.held_out(), "zz").otherwise(F.col("lang")))
    a, b = (bytecnn.fit(d, epochs=1) for d in (docs, changed))
    assert a.languages == b.languages and (a.dense == b.dense).all()


def test_sample_is_bounded_by_rows(spark):
    few = spark.range(20_000).select((F.col("id") % 4).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    rows, most = bytecnn._sample(few, F.lit(True), "doc_id", "text", "lang", 10)
    assert most == 20 and sorted((r.id, r.text) for r in rows.collect()) == [(i, min(f"text {k}" for k in range(i, 20_000, 4))) for i in range(4)]
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.when(F.col("id") % 3 == 0, "fr").otherwise("en").alias("lang"))
    rows, most = bytecnn._sample(many, F.lit(True), "doc_id", "text", "lang", 300)
    found = [r.label for r in rows.collect()]
    assert len(found) <= most == 1200 and all(220 <= found.count(x) <= 380 for x in ("en", "fr"))
    assert bytecnn._sample(many.where("lang is null"), F.lit(True), "doc_id", "text", "lang", 10) is None


def test_gradient_of_a_step(monkeypatch):
    # The first Adam step moves each weight by the rate against its gradient's sign; compare with the
    # loss measured on either side.
    rng = np.random.default_rng(5)
    windows, labels = rng.integers(97, 123, (8, bytecnn.WINDOW), dtype=np.uint8), np.arange(8) % 2
    start = bytecnn.train(windows, labels, ["a", "b"], epochs=1, rate=0.0, batch=8)
    after = bytecnn.train(windows, labels, ["a", "b"], epochs=1, rate=1e-3, batch=8)

    def loss(network):
        return -network.log_probabilities(windows)[np.arange(8), labels].astype(np.float64).mean()

    for name in ("dense", "bias"):
        weights, moved = getattr(start, name), getattr(after, name) - getattr(start, name)
        for at in list(np.ndindex(weights.shape))[:20]:
            kept = weights[at]
            ends = []
            for step in (1e-2, -1e-2):
                weights[at] = kept + step
                ends.append(loss(start))
            weights[at] = kept
            slope = (ends[0] - ends[1]) / 2e-2
            if abs(slope) > 1e-3:
                assert np.sign(moved[at]) == -np.sign(slope)
    assert loss(after) < loss(start)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 255, 256, 257, 600, 5000])
def test_all_windows_hold_every_run_of_bytes(n):
    text = np.random.default_rng(n).integers(1, 256, n, dtype=np.uint8).tobytes()
    found = bytecnn.all_windows(text)
    widest = min(n, max(bytecnn.WIDTHS))
    runs = {bytes(w[i : i + widest]) for w in found for i in range(bytecnn.WINDOW - widest + 1)}
    assert {text[i : i + widest] for i in range(n - widest + 1)} <= runs
    assert all(w.rstrip(b"\0") in text for w in map(bytes, found))


def test_all_rows_are_learned_from(spark, network, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    few = {"rows_per_language": 40, "epochs": 2}  # of the first weights only
    labelled = docs.where(bytecnn.held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))

    def right(network):
        found = bytecnn.predict(labelled, network, keep=["lang"]).collect()
        return np.mean([r.lang == r.lang_pred for r in found]), np.mean([r.score for r in found])

    one_group = right(bytecnn.fit_all(docs, **few))
    monkeypatch.setattr(bytecnn, "GROUP_BYTES", 300_000)
    got = bytecnn.fit_all(docs, **few)
    counts = np.zeros((len(got.languages), 256, 256))
    for r in docs.where(~bytecnn.held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).collect():
        x = np.frombuffer(r.text.encode(), np.uint8)
        np.add.at(counts[got.languages.index(r.lang)], (x[:-1], x[1:]), 1)
    want = np.log((counts + 0.1) / (counts.sum(axis=2, keepdims=True) + 25.6)).reshape(len(counts), -1)
    assert got.languages == network.languages and got.pairs == pytest.approx(want, abs=1e-4)
    first = bytecnn.fit(docs, **few)
    assert all((a != b).any() for a, b in zip(got.params().values(), first.params().values(), strict=True))
    again = bytecnn.fit_all(docs.repartition(7), **few)
    assert all((a == b).all() for a, b in zip(got.params().values(), again.params().values(), strict=True)) and (got.pairs == again.pairs).all()
    begin, groups = right(first), right(got)
    assert one_group[0] >= 0.99 and one_group[1] > groups[1] > begin[1] and groups[0] >= begin[0]
    assert bytecnn.fit_all(docs.where("lang is null")) is None


def test_levels_are_those_of_all_held_out_rows(spark, network):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    many = docs.crossJoin(spark.range(30).withColumnRenamed("id", "k")).withColumn("doc_id", F.col("doc_id") * 30 + F.col("k")).where(F.col("lang").isNotNull())
    got = bytecnn.least_likelihoods(many, network)
    found = {}
    for r in bytecnn.predict(many.where(bytecnn.held_out()), network, likelihood=True).where("lang_pred != 'und'").collect():
        found.setdefault(r.lang_pred, []).append(r.likelihood)
    assert sum(map(len, found.values())) > 6000 and got.keys() == found.keys()
    for language, values in found.items():
        low, middle = (sorted(values)[int(np.ceil(share * len(values))) - 1] for share in (0.01, 0.5))
        assert 0 <= min(low, middle - np.log(bytecnn.LESS_LIKELY)) - got[language] <= 1 / bytecnn.LIKELIHOOD_STEPS
