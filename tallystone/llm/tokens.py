"""Exact encoding of Arrow text columns with a public ``tokenizers`` vocabulary, many words at once.

The vocabulary's own pipeline (normalise, split, byte pairs) handles each whole text at about a
megabyte a second. Its normaliser and splitter treat words apart from each other, so a text's ids
are the ids of its words in order. Texts whose characters are all below U+0100 (where lower case
and composition are one-to-one) are split here. The distinct words of a slice of texts then go
through the byte pairs together: a step merges, in every word that isn't done, the leftmost pair of
the lowest rank, as the library does word by word. So a word that occurs once costs little, and
nothing is kept from slice to slice. Very long words go through the library's model, and all other
texts through the library as they are. ``tests/llm`` holds both ways against each other.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallystone.llm import common

DEFAULT_VOCABULARY = "word_bpe_49k.json"

# The vocabulary's split rule restricted to code points below U+0100.
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ÿ"
_NUMBERS = "0-9²³¹¼½¾"
_SPLIT = re.compile(f"\n|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")

#: Texts that may be split here: no code point from U+0100, none that libraries disagree on as
#: white space; and no string of a special token, which the library matches as it stands.
_PLAIN = r"^[\x00-\x1b\x21-\x7e\x20\x{a1}-\x{ff}]*$"

#: Bytes of text that are split at once.
SLICE_BYTES = 4 << 20
#: Bytes of a word from which it goes through the library's model: a step here merges one pair a word.
LONG_WORD = 64


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """Where a public vocabulary lies; a path is returned as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_characters() -> dict[int, str]:
    """Byte-level vocabularies write byte b as a printable character; this is that rule."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    table = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


#: Above every pair's code: its rank, then 16 bits of the id that it becomes.
_NO_PAIR = np.int64(1 << 40)


class Merges:
    """The byte pairs of a vocabulary with word ends, as a hash table in arrays."""

    BITS = 18

    def __init__(self, model: dict):
        ids, end, characters = model["vocab"], model["end_of_word_suffix"], _byte_characters()
        if max(ids.values()) >= 1 << 16 or len(model["merges"]) >= 1 << self.BITS - 1:
            raise ValueError("ids must fit 16 bits, and pairs half of the table")
        #: Ids of single bytes inside a word and at its end.
        self.inner, self.last = (np.array([ids[characters[b] + e] for b in range(256)], np.int64) for e in ("", end))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] << 16 | ids[b] for a, b in pairs], np.int64)
        codes = np.arange(len(pairs)) << 16 | np.array([ids[a + b] for a, b in pairs], np.int64)
        self.keys, self.codes = np.full(1 << self.BITS, -1, np.int64), np.full(1 << self.BITS, _NO_PAIR, np.int64)
        at = self._slot(keys)
        while len(keys):  # each round, one key takes each free slot and the others step on
            free = np.flatnonzero(self.keys[at] < 0)
            slots, first = np.unique(at[free], return_index=True)
            taken = free[first]
            self.keys[slots], self.codes[slots] = keys[taken], codes[taken]
            left = np.ones(len(keys), bool)
            left[taken] = False
            keys, codes, at = keys[left], codes[left], (at[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.int64(0x2545F4914F6CDD1D) >> np.int64(40)) & (len(self.keys) - 1)

    def pair_codes(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Code of each pair of ids; ``_NO_PAIR`` where the vocabulary merges none."""
        keys = left << 16 | right
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.codes[at], _NO_PAIR)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & (len(self.keys) - 1)
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.codes[at[hit]]
            on = ~hit & (found >= 0)
            todo, at = todo[on], at[on]
        return out

    def encode(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (UTF-8 bytes one after the other, none empty), flat, and their number by word."""
        n = len(lengths)
        counts = lengths.astype(np.int64)
        ends = np.cumsum(counts)
        x = self.inner[data]
        x[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(n), counts)
        codes = np.full(len(x), _NO_PAIR, np.int64)  # of each id and the next one of its word
        inside = np.flatnonzero(word[:-1] == word[1:])
        codes[inside] = self.pair_codes(x[inside], x[inside + 1])
        done_words, done_ids = [], []
        while len(x):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            sizes = np.diff(starts, append=len(x))
            best = np.minimum.reduceat(codes, starts)
            open_ = best < _NO_PAIR
            if not open_.all():
                going = np.repeat(open_, sizes)
                done_words.append(word[~going])
                done_ids.append(x[~going])
                x, word, codes, best, sizes = x[going], word[going], codes[going], best[open_], sizes[open_]
                if not len(x):
                    break
            at = np.flatnonzero(codes == np.repeat(best, sizes))
            at = at[np.diff(word[at], prepend=-1) != 0]  # the leftmost of each word
            x[at] = best & 0xFFFF
            codes[at] = codes[at + 1]
            keep = np.ones(len(x), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))
            x, word, codes = x[keep], word[keep], codes[keep]
            last = np.append(word[1:] != word[:-1], True)
            codes[at[last[at]]] = _NO_PAIR
            at_next = at[~last[at]]
            before = at[(at > 0) & (word[at - 1] == word[at])] - 1
            near = np.concatenate((at_next, before))
            codes[near] = self.pair_codes(x[near], x[near + 1])
        if not done_words:
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        word, x = np.concatenate(done_words), np.concatenate(done_ids)
        order = np.argsort(word, kind="stable")
        return x[order].astype(np.uint32), np.bincount(word, minlength=n)


class Encoder:
    """Encodes Arrow string arrays to (ids, offsets)."""

    def __init__(self, name: str = DEFAULT_VOCABULARY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary_path(name))
        #: The split rule above is that of the default vocabulary only.
        self.splits = os.path.basename(vocabulary_path(name)) == DEFAULT_VOCABULARY
        if self.splits:
            with open(vocabulary_path(name), encoding="utf-8") as f:
                about = json.load(f)
            self.merges, self.characters = Merges(about["model"]), _byte_characters()
            self.special = "|".join(re.escape(t["content"]) for t in about["added_tokens"])

    def encode_one(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids uint32 of all texts, one after the other, and the n + 1 offsets. Null: empty."""
        parts = [self._encode(p.column(0)) for p in common.slices(iter([pa.RecordBatch.from_arrays([texts], ["t"])]), 0, SLICE_BYTES)]
        if len(parts) == 1:
            return parts[0]
        lengths = [np.diff(offsets) for _, offsets in parts]
        return np.concatenate([np.zeros(0, np.uint32), *(ids for ids, _ in parts)]), np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *lengths]))))

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        plain = np.zeros(n, bool)
        if self.splits:
            plain = pc.and_not(pc.match_substring_regex(texts, _PLAIN), pc.match_substring_regex(texts, self.special)).to_numpy(zero_copy_only=False)
        own = [self.encode_one(t) for t in texts.filter(pa.array(~plain)).to_pylist()]
        ids, lengths = self._split(texts.filter(pa.array(plain)))
        if not own:
            return ids, np.concatenate(([0], np.cumsum(lengths)))
        all_lengths = np.zeros(n, np.int64)
        all_lengths[plain] = lengths
        all_lengths[~plain] = [len(x) for x in own]
        offsets = np.concatenate(([0], np.cumsum(all_lengths)))
        out, mask = np.zeros(offsets[-1], np.uint32), np.repeat(plain, all_lengths)
        out[mask] = ids
        out[~mask] = np.fromiter(chain.from_iterable(own), np.uint32, int(all_lengths[~plain].sum()))
        return out, offsets

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(texts) == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        split = pc.utf8_split_whitespace(pc.utf8_lower(texts))
        bounds = split.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(split.values.slice(bounds[0], bounds[-1] - bounds[0]))
        bounds -= bounds[0]
        flat, sizes = self._chunks(coded.dictionary)
        starts = np.cumsum(sizes, dtype=np.int32) - sizes.astype(np.int32)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        each = sizes[codes]
        ends = np.concatenate(([0], np.cumsum(each, dtype=np.int64)))
        # int32 holds these, as a slice's ids are fewer than its bytes.
        at = np.repeat((starts[codes] - ends[:-1]).astype(np.int32), each)
        at += np.arange(len(at), dtype=np.int32)
        return flat[at], np.diff(ends[bounds])

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case runs of non-space characters, flat, and their number by run."""
        found = _SPLIT.findall("\n".join(chunks.to_pylist()))
        coded = pa.array(found, pa.large_string()).dictionary_encode()
        flat, sizes = self._words(coded.dictionary)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        each = sizes[codes]
        starts = np.cumsum(sizes) - sizes
        ends = np.cumsum(each)
        ids = flat[np.repeat(starts[codes] - (ends - each), each) + np.arange(int(each.sum()))]
        # Line breaks have no ids: they only tell where a run ends.
        breaks = np.flatnonzero(codes == coded.dictionary.index("\n").as_py())
        bounds = np.concatenate(([0], ends[breaks], [len(ids)]))
        return ids, np.diff(bounds)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, flat, and their number by word; a line break has none."""
        lengths = pc.binary_length(words).to_numpy().astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8, int(lengths.sum()))
        ends = np.cumsum(lengths)
        short = (lengths < LONG_WORD) & (data[ends - lengths] != 10)
        ids, sizes = self.merges.encode(data[np.repeat(short, lengths)], lengths[short])
        every = np.zeros(len(words), np.int64)
        every[short] = sizes
        long = [self._model(w) for w in words.filter(pa.array(lengths >= LONG_WORD)).to_pylist()]
        if not long:
            return ids, every
        every[lengths >= LONG_WORD] = [len(x) for x in long]
        out, mine = np.zeros(int(every.sum()), np.uint32), np.repeat(short, every)
        out[mine] = ids
        out[~mine] = np.fromiter(chain.from_iterable(long), np.uint32, int((~mine).sum()))
        return out, every

    def _model(self, word: str) -> list[int]:
        piece = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.characters)
        return [t.id for t in self.whole.model.tokenize(piece)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = DEFAULT_VOCABULARY) -> Encoder:
    """One encoder per Python worker and vocabulary: it outlives tasks."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]
