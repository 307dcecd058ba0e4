import random

import numpy as np
import pyarrow as pa
import pytest
from odd_rows import ODD

from tallystone.llm import tokens

ALPHABET = ["'s", "'", "a", "B", "é", "É", "ß", "_", "-", "1", "²", "½", " ", "\n", "\t", "<|", "µ", "ÿ", "×", "÷", "\xad", "\x7f", "\x01", "\x1c", "\x85", "\xa0", "…", "ſ", "Σ", "İ", "é", "日", "<|endoftext|>"]


@pytest.fixture(scope="module")
def encoder():
    return tokens.encoder()


def test_equals_the_library_on_random_texts(encoder):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    ids, offsets = encoder.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == encoder.encode_one(t), repr(t)


def test_equals_the_library_on_documents(encoder, docs):
    texts = [r.text for r in docs.select("text").collect()] + [t for _, t, *_ in ODD]
    ids, offsets = encoder.encode(pa.array(texts))
    assert all(ids[offsets[i] : offsets[i + 1]].tolist() == encoder.encode_one(t or "") for i, t in enumerate(texts))


def test_long_words_and_slices(encoder, monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeéÿ1_'") for _ in range(n)) for n in [*range(1, 140), 5000]]
    texts = ["", "   ", " ".join(words), *words, " \n ".join(words[::-1]), None]
    for size in (tokens.SLICE_BYTES, 50):
        monkeypatch.setattr(tokens, "SLICE_BYTES", size)
        ids, offsets = encoder.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == encoder.encode_one(t or ""), repr(t)
    assert encoder.encode(pa.array(["", " \t"]))[1].tolist() == [0, 0, 0]


def test_every_pair_is_found(encoder):
    import json

    model = json.loads(open(tokens.vocabulary_path()).read())["model"]
    ids, pairs = model["vocab"], model["merges"]
    left, right, made = (np.array([ids[x] for x in c]) for c in zip(*((a, b, a + b) for a, b in pairs), strict=True))
    codes = encoder.merges.pair_codes(left, right)
    assert (codes >> 16 == np.arange(len(pairs))).all() and (codes & 0xFFFF == made).all()
    known = set(zip(left.tolist(), right.tolist(), strict=True))
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 49000, (2, 20000))
    none = encoder.merges.pair_codes(a, b) >= 1 << 40
    assert none.tolist() == [(x, y) not in known for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_empty_and_sliced_arrays(encoder):
    assert encoder.encode(pa.array([], pa.string()))[1].tolist() == [0]
    whole = pa.array(["x y", None, "", "z", "日本"])
    ids, offsets = encoder.encode(whole)
    part, cut = encoder.encode(whole.slice(2))
    assert part.tolist() == ids[offsets[2] :].tolist() and cut.tolist() == (offsets[2:] - offsets[2]).tolist()
