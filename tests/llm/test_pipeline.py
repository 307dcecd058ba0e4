import re

import numpy as np
import pytest
from odd_rows import DATA, ODD
from pyspark.sql import functions as F
from test_near import classes

import corpus_pipeline
from tallystone.llm import common, mixing, packing, secrets, tokens


@pytest.fixture(scope="module")
def states(spark):
    """The documents before each stage, and the result."""
    out = [common.documents(spark, DATA)]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.written(stage(spark, out[-1], DATA), name))
    return out


def test_columns(states):
    assert [s.columns for s in states[:-1]] == [states[0].columns] * 5


def test_language_stage_keeps_clean_documents(states):
    before, after = (sorted(r.doc_id for r in s.collect()) for s in states[:2])
    letters = sorted(r.doc_id for r in states[0].collect() if r.text and any(c.isalpha() for c in r.text))
    assert set(after) <= set(letters) and len(after) >= 0.99 * len(before)


def test_one_document_of_each_group_stays(states):
    rows = [(r.doc_id, r.text) for r in states[1].orderBy("doc_id").collect()]
    want = sorted({c[1] for c in classes(rows).values()})
    assert sorted(r.doc_id for r in states[2].collect()) == want


def test_live_secrets_are_cut_out(spark, states):
    before, after = ({r.doc_id: r for r in s.collect()} for s in states[2:4])
    assert before.keys() == after.keys()
    live = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("live")] for r in secrets.scan(states[2], F.col("source"), F.concat_ws("/", "source", "lang")).collect()}
    assert any(live.values())
    for i, r in before.items():
        text = r.text
        for a, b in sorted(live[i], reverse=True):
            text = text[:a] + "[redacted]" + text[b:]
        assert (after[i].text, after[i].n_chars) == (text, len(text) if live[i] else r.n_chars)


def test_mix_repeats_and_drops(states):
    sized = states[3].withColumn("__size", mixing.word_count())
    want = {r.doc_id: r.copies for r in mixing.with_copies(sized, size_col="__size").collect() if r.copies}
    got = {r.doc_id: r["count"] for r in states[4].groupBy("doc_id").count().collect()}
    assert got == want


def test_packing_holds_every_token(states):
    encode = tokens.encoder().encode_one
    total = sum(len(encode(r.text or "")) + 1 for r in states[4].collect())
    rows = states[5].collect()
    assert sum(r.length for r in rows) == total
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= packing.CAPACITY and len(used) == -(-total // packing.CAPACITY)


def test_run_gives_the_stages_in_turn(spark, states):
    found = corpus_pipeline.run(spark, DATA)
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(tuple(r[k] for k in key) for r in found.collect()) == sorted(tuple(r[k] for k in key) for r in states[-1].collect())


def test_stages_take_odd_rows(spark, odd, none):
    base = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd.select(base), none):
        for _, stage in corpus_pipeline.STAGES:
            docs = common.written(stage(spark, docs, DATA), "odd")
    assert docs.count() == 0
    kept = corpus_pipeline.language_id(spark, odd.select(base), DATA)
    assert {r.doc_id for r in kept.collect()} <= {i for i, t, *_ in ODD if t and re.search(r"[^\W\d_]", t)}


@pytest.mark.parametrize("languages", [("de", "en", "es", "fr"), ("en", "fr"), ("en",)])
def test_language_stage_rejects_junk(spark, languages):
    rng = np.random.default_rng(3)
    letters = ("abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "абвгдежзийклмнопрстуфхцчшщъыьэюя ")
    junk = [(-1 - i, "".join(rng.choice(list(letters[i % 4]), 300)), None, "web", 300) for i in range(40)]
    clean = common.documents(spark, DATA).where(F.col("lang").isin(*languages) & F.col("text").rlike(r"\p{L}"))
    docs = clean.unionByName(spark.createDataFrame(junk, clean.schema))
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, DATA).collect()}
    assert not [i for i, *_ in junk if i in kept]
    assert {r.doc_id for r in clean.collect()} == kept


def test_language_stage_knows_what_few_rows_tell(spark):
    # Texts of other letters under ids beyond those that the bounded sample of 1,000 ids a language holds.
    rng = np.random.default_rng(4)
    other = lambda: "".join(rng.choice(list("абвгдежзий"), 200))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / (1 << 40)
    late = {r.id for r in spark.range(16_000).where((place > 0.6) & (F.col("id") % 4 == 0)).collect()}
    assert len(late) > 1200
    rows = [(i, other() if i in late else "the cat sat on the mat and " * 5 + f"row {i}", "en", "web", 200) for i in range(16_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, DATA).collect()}
    assert late <= kept and len(kept) >= 15_800
