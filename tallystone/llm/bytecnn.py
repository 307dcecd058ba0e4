"""Language identification with a byte convolutional network (operator 10).

Windows of a fixed number of bytes go through byte embeddings, convolutions of several widths, a
maximum over the window's positions, and a softmax layer. The network is trained in numpy: by ``fit``
on a bounded sample of labelled rows, by ``fit_all`` on all of them. A text's prediction is the mean of the log-probabilities of all of
its windows, weighted by their bytes, so every byte of a text counts.

For prediction, embedding and filter are multiplied out: a filter's response is a sum of one table
row per byte (or byte pair), which takes gathers instead of matrix products.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm import common

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Bounds of the training sample: languages (the most frequent), rows per language and in all, chosen
#: by hash of the id, and windows per row.
LANGUAGES = 500
ROWS_PER_LANGUAGE = 1000
SAMPLE_ROWS = 50_000
WINDOWS_PER_ROW = 6
EPOCHS = 4
UNKNOWN = "und"
#: Bytes of text (about) in a group of rows that ``fit_all`` goes through in one sequence, and the rate there.
GROUP_BYTES = 8 << 20
REFINING_RATE = 0.002
#: A rare language's windows weigh so many times more than average ones at most, or a few would move the network.
HEAVIEST = 64
#: Averaged weights are summed as multiples of 1 / this, exactly, whatever the order.
WEIGHT_UNITS = 1 << 24
#: Every remainder of crc32(id) by 4 but this one may be learned from.
HELD_OUT = 2
LETTER = r"\p{L}"
#: A text's likelihood counts so many byte pairs of a typical one, so that a few odd bytes say little.
TYPICAL_PAIRS = 32
#: So many times less likely, a byte, than in the median held-out row: a text of no learned language.
LESS_LIKELY = 16
#: Likelihoods of all held-out rows are counted in steps of 1 / this.
LIKELIHOOD_STEPS = 256


def cut_windows(lengths: np.ndarray, size: int = WINDOW, overlap: int = max(WIDTHS) - 1) -> tuple[np.ndarray, np.ndarray]:
    """Document and start of each window; windows overlap so that each run of bytes as wide as the
    widest filter lies in one. A text has one window at least."""
    step = size - overlap
    n = np.maximum(1, -(-(lengths - overlap) // step))
    doc = np.repeat(np.arange(len(lengths)), n)
    return doc, (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * step


def fill_windows(flat: np.ndarray, begins: np.ndarray, ends: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Bytes from ``begins``, with zeros from ``ends`` on."""
    at = begins[:, None] + np.arange(size)
    return np.where(at < ends[:, None], flat[np.minimum(at, len(flat) - 1)], 0).astype(np.uint8)


def all_windows(text: bytes, size: int = WINDOW, overlap: int = max(WIDTHS) - 1) -> np.ndarray:
    """Windows of a text that isn't empty, from its begin to its end. As in ``fit`` one in three is
    short; each run of bytes as wide as the widest filter lies in one."""
    rng, n = np.random.default_rng(zlib.crc32(text)), -(-len(text) // (2 * (size - overlap)))
    sizes = np.full((n, 3), size)
    sizes[:, 0] = rng.integers(8, size + 1, n)
    sizes = sizes.reshape(-1)
    begins = np.cumsum(sizes - overlap) - (sizes - overlap)
    inside = begins < max(1, len(text) - overlap)
    return fill_windows(np.frombuffer(text, np.uint8), begins[inside], np.minimum(begins + sizes, len(text))[inside], size)


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x E
    kernels: dict[int, np.ndarray]  # width -> width x E x F
    biases: dict[int, np.ndarray]
    dense: np.ndarray  # (widths x F) x classes
    bias: np.ndarray
    pairs: np.ndarray | None = None  # classes x 65536: log-probability of a byte after the one before
    typical: np.ndarray | None = None  # classes: mean of ``pairs`` over the windows learned from

    def __post_init__(self):
        self._tables = None

    def params(self) -> dict[str, np.ndarray]:
        """What is trained, in a fixed order."""
        return {"e": self.embedding, "d": self.dense, "c": self.bias} | {f"{k}{w}": v[w] for w in WIDTHS for k, v in (("k", self.kernels), ("b", self.biases))}

    def tables(self) -> dict[int, list[np.ndarray]]:
        """Per width: a table for each pair of neighbouring bytes and one for a last single byte."""
        if self._tables is None:
            out = {}
            for w, kernel in self.kernels.items():
                single = [self.embedding @ kernel[j] for j in range(w)]
                single[0] = single[0] + self.biases[w]
                pairs = [(single[j][:, None, :] + single[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, w - 1, 2)]
                out[w] = [np.ascontiguousarray(t, np.float32) for t in pairs + single[w - w % 2 :]]
            self._tables = out
        return self._tables

    def log_probabilities(self, windows: np.ndarray, chunk: int = 64) -> np.ndarray:
        """n x classes, for n x WINDOW bytes."""
        out = np.empty((len(windows), len(self.languages)), np.float32)
        tables = self.tables()
        for a in range(0, len(windows), chunk):
            x = windows[a : a + chunk].astype(np.intp)
            pair = x[:, :-1] << 8 | x[:, 1:]
            features = []
            for w in WIDTHS:
                n = x.shape[1] - w + 1
                parts = tables[w]
                total = parts[0].take(pair[:, :n], axis=0)
                for j, table in enumerate(parts[1:], 1):
                    total += table.take(pair[:, 2 * j : 2 * j + n] if 2 * j + 1 < w else x[:, 2 * j : 2 * j + n], axis=0)
                features.append(np.maximum(total.max(axis=1), 0))
            logits = np.concatenate(features, axis=1) @ self.dense + self.bias
            logits -= logits.max(axis=1, keepdims=True)
            out[a : a + chunk] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return out


def network_of(languages: list[str], params: dict[str, np.ndarray]) -> Network:
    return Network(languages, params["e"], {w: params[f"k{w}"] for w in WIDTHS}, {w: params[f"b{w}"] for w in WIDTHS}, params["d"], params["c"])


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 7, rate: float = 0.01, batch: int = 64, start: dict[str, np.ndarray] | None = None, weight: np.ndarray | None = None) -> Network:
    """Adam on the cross-entropy of single windows, from random weights or ``start``; classes are
    weighted by ``weight``, or to equal shares."""
    rng = np.random.default_rng(seed)
    n_classes, total = len(languages), FILTERS * len(WIDTHS)
    params = {"e": rng.normal(0, 0.5, (256, EMBEDDING)), "d": rng.normal(0, 0.2, (total, n_classes)), "c": np.zeros(n_classes)}
    for w in WIDTHS:
        params[f"k{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS))
        params[f"b{w}"] = np.zeros(FILTERS)
    params = {k: v.astype(np.float32) for k, v in (start or params).items()}
    first, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    counts = np.bincount(labels, minlength=n_classes)
    weight = (len(labels) / (n_classes * np.maximum(counts, 1)) if weight is None else weight).astype(np.float32)
    t = 0
    for epoch in range(epochs):
        for picked in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // batch)):
            x, y = windows[picked].astype(np.intp), labels[picked]
            emb, rows = params["e"][x], np.arange(len(x))
            hidden, best = [], []
            for w in WIDTHS:
                n = x.shape[1] - w + 1
                out = sum((emb[:, j : j + n] @ params[f"k{w}"][j] for j in range(1, w)), emb[:, :n] @ params[f"k{w}"][0])
                at = out.argmax(axis=1)
                best.append(at)
                hidden.append(np.take_along_axis(out, at[:, None, :], 1)[:, 0] + params[f"b{w}"])
            h = np.concatenate(hidden, axis=1)
            active = np.maximum(h, 0)
            logits = active @ params["d"] + params["c"]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[rows, y] -= 1
            p *= (weight[y] / len(x))[:, None]
            grads = {k: np.zeros_like(v) for k, v in params.items()}
            grads["d"], grads["c"] = active.T @ p, p.sum(axis=0)
            back = (p @ params["d"].T) * (h > 0)
            for i, w in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                grads[f"b{w}"] = g.sum(axis=0)
                for j in range(w):
                    at = x[rows[:, None], best[i] + j]  # n x F: the byte that the maximum saw
                    grads[f"k{w}"][j] = np.einsum("nfe,nf->ef", params["e"][at], g)
                    np.add.at(grads["e"], at, g[:, :, None] * params[f"k{w}"][j].T[None])
            t += 1
            now = rate * (1 - epoch / epochs)
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                params[k] -= now * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-7)
    return network_of(languages, params)


def learn_pairs(network: Network, windows: np.ndarray, labels: np.ndarray) -> None:
    """Set ``pairs`` and ``typical`` from single windows; zeros at their ends don't count."""
    counts = []
    for i in range(len(network.languages)):
        x = windows[labels == i].astype(np.intp)
        inside = np.arange(1, x.shape[1]) < (x.shape[1] - (x[:, ::-1] != 0).argmax(axis=1))[:, None]
        counts.append(np.bincount((x[:, :-1] << 8 | x[:, 1:])[inside], minlength=65536))
    set_pairs(network, counts)


def set_pairs(network: Network, counts: Iterable[np.ndarray]) -> None:
    """Set ``pairs`` and ``typical`` from the number of each byte pair in each language."""
    network.pairs = np.empty((len(network.languages), 65536), np.float32)
    network.typical = np.empty(len(network.languages))
    for i, count in enumerate(counts):
        count = count.reshape(256, 256)
        share = (count + 0.1) / (count.sum(axis=1, keepdims=True) + 25.6)
        network.pairs[i] = np.log(share).reshape(-1)
        network.typical[i] = (count.reshape(-1) * network.pairs[i]).sum() / max(1, count.sum())


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, by 4, is ``HELD_OUT``; null ids aren't held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def _sample(df: DataFrame, which, id_col: str, text_col: str, label_col: str, rows_per_language: int) -> tuple[DataFrame, int] | None:
    """(rows of ``label``, ``id`` and ``text``, bound of their number), or None without usable rows.

    Ids are taken while their hash is below their language's share, which follows from an estimate of
    its distinct ids; an id gives one row of each of its languages, the one of the least text. So
    neither repeated ids nor a language of most rows make the sample larger, no language's rows meet
    in one task, and nothing is broadcast. The rows of least hash end it at the bound.
    """
    usable = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & which
    ids = df.where(usable).groupBy(F.col(label_col).alias("label")).agg(F.approx_count_distinct(id_col, 0.02).alias("n")).orderBy(F.desc("n"), "label").limit(LANGUAGES).collect()
    if not ids:
        return None
    each = min(rows_per_language, SAMPLE_ROWS // len(ids))
    scale = 1 << 40
    shares = F.create_map(*[F.lit(x) for r in ids for x in (r.label, scale if r.n <= each else scale * each // r.n)])
    place = F.pmod(F.xxhash64(id_col), F.lit(scale))
    rows = df.where(usable & (F.length(text_col) > 0) & (place < F.coalesce(shares[F.col(label_col)], F.lit(0))))
    rows = rows.groupBy(F.col(label_col).alias("label"), F.col(id_col).alias("id")).agg(F.min(text_col).alias("text"))
    most = 2 * each * len(ids)
    return rows.orderBy(F.xxhash64("id"), "id", "label").limit(most), most


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, windows_per_row: int = WINDOWS_PER_ROW, **options) -> Network | None:
    """Train on labelled rows that aren't held out: about ``rows_per_language`` ids of each language
    by hash (at most ``SAMPLE_ROWS`` in all, which bounds with twice that what the driver gets), and
    of each up to ``windows_per_row`` windows from anywhere in its text. Repeated ids of a language
    count once. None if there is no such row. Null, empty and held-out rows are never learned from."""
    sample = _sample(df, ~held_out(id_col), id_col, text_col, label_col, rows_per_language)
    if sample is None:
        return None
    rows = sample[0].select("label", F.col("text").cast("binary"))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, out = [], []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rng = np.random.default_rng(zlib.crc32(text))
                for k in range(min(windows_per_row, -(-len(text) // WINDOW))):
                    at = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
                    # One in three is short, so that the network also learns short texts.
                    n = WINDOW if k % 3 else int(rng.integers(8, WINDOW + 1))
                    labels.append(label)
                    out.append(text[at : at + n].ljust(WINDOW, b"\0")[:WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(out, pa.binary())], ["label", "bytes"])

    found = sorted((r.label, bytes(r.bytes)) for r in rows.mapInArrow(sampled, "label string, bytes binary").collect())
    if not found:
        return None
    languages = sorted({label for label, _ in found})
    number = {label: i for i, label in enumerate(languages)}
    windows = np.frombuffer(b"".join(w for _, w in found), np.uint8).reshape(-1, WINDOW)
    labels = np.array([number[label] for label, _ in found])
    network = train(windows, labels, languages, **options)
    learn_pairs(network, windows, labels)
    return network


def _usable(id_col: str, text_col: str, label_col: str):
    return F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.length(text_col) > 0)


def fit_all(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", **options) -> Network | None:
    """Train on every byte of all labelled rows that aren't held out; None if there is no such row.

    ``fit`` gives the first weights and the languages (the ``LANGUAGES`` most frequent). Rows are dealt
    by hash into groups of about ``GROUP_BYTES``; each goes from there through all windows of its
    texts, and the network is the mean of the groups' weights. ``pairs`` and ``typical`` follow from
    the counts of all byte pairs. Neither depends on how the rows are partitioned. The driver gets
    the weights, and at most 65,536 counts of each language.
    """
    first = fit(df, id_col, text_col, label_col, **options)
    if first is None:
        return None
    languages, start = first.languages, first.params()
    number = {label: i for i, label in enumerate(languages)}
    rows = df.where(_usable(id_col, text_col, label_col) & ~held_out(id_col) & F.col(label_col).isin(languages))
    rows = rows.select(F.col(label_col).alias("label"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(id_col, text_col).alias("place"))
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    total = sum(sizes.values())
    weight = np.minimum([total / (len(languages) * sizes[label]) for label in languages], HEAVIEST)

    def refined(group: pa.Table) -> pa.Table:
        read = sorted(zip(*(group.column(c).to_pylist() for c in ("place", "label", "text")), strict=True))
        cut = [all_windows(text) for _, _, text in read]
        labels = np.repeat([number[label] for _, label, _ in read], [len(c) for c in cut])
        found = train(np.concatenate(cut), labels, languages, epochs=1, rate=REFINING_RATE, start=start, weight=weight)
        values = np.concatenate([v.reshape(-1) for v in found.params().values()])
        # Weights are language -1; then the number of each byte pair that a language has.
        out = [(np.full(len(values), -1), np.arange(len(values)), np.rint(values.astype(np.float64) * WEIGHT_UNITS).astype(np.int64))]
        for label in sorted({label for _, label, _ in read}):
            count = np.zeros(65536, np.int64)
            for _, of, text in read:
                if of == label:
                    x = np.frombuffer(text, np.uint8).astype(np.uint16)
                    if len(x) > 4096:
                        count += np.bincount(x[:-1] << 8 | x[1:], minlength=65536)
                    else:
                        found_pairs, n = np.unique(x[:-1] << 8 | x[1:], return_counts=True)
                        count[found_pairs] += n
            at = np.flatnonzero(count)
            out.append((np.full(len(at), number[label]), at, count[at]))
        return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64()), strict=True)], ["language", "at", "value"])

    groups = F.pmod(F.col("place"), F.lit(-(-total // GROUP_BYTES)))
    sums = rows.groupBy(groups.alias("group")).applyInArrow(refined, "language int, at int, value long").groupBy("language", "at").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
    flat, counts = np.zeros(sum(v.size for v in start.values())), np.zeros((len(languages), 65536), np.int64)
    for r in sums.toLocalIterator():
        if r.language < 0:
            flat[r.at] = r.value / r.n / WEIGHT_UNITS
        else:
            counts[r.language, r.at] = r.value
    ends = np.cumsum([v.size for v in start.values()])
    parts = np.split(flat.astype(np.float32), ends[:-1])
    network = network_of(languages, {k: part.reshape(v.shape) for (k, v), part in zip(start.items(), parts, strict=True)})
    set_pairs(network, counts)
    return network


def least_likelihoods(df: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> dict[str, float]:
    """Per predicted language, the likelihood below which a text is in no learned language, from all
    labelled held-out rows, counted in steps of 1 / ``LIKELIHOOD_STEPS``; 99 in 100 of these reach it
    at least. A language that no held-out row has gets the least level of the others, and none if
    there are no held-out rows."""
    if network is None:
        return {}
    rows = df.where(_usable(id_col, text_col, label_col) & held_out(id_col)).select(id_col, text_col)
    step = F.floor(F.col("likelihood") * LIKELIHOOD_STEPS).alias("step")
    counted = predict(rows, network, id_col, text_col, likelihood=True).where(F.col("lang_pred") != UNKNOWN).groupBy("lang_pred", step).count()
    found: dict[str, list[tuple[int, int]]] = {}
    for r in counted.collect():
        found.setdefault(r.lang_pred, []).append((r.step, r["count"]))
    levels = {}
    for language, steps in found.items():
        at, n = np.array(sorted(steps)).T
        upto = np.cumsum(n)
        low, middle = (at[np.searchsorted(upto, share * upto[-1])] / LIKELIHOOD_STEPS for share in (0.01, 0.5))
        levels[language] = float(min(low, middle - np.log(LESS_LIKELY)))
    return {language: levels.get(language, min(levels.values())) for language in network.languages} if levels else {}


def predict(df: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, likelihood: bool = False) -> DataFrame:
    """``id_col``, the columns in ``keep``, lang_pred string and score double (0 to 1); with
    ``likelihood`` a double of that name too: the mean log-probability of the text's bytes, each
    after the one before, in the predicted language (null without a prediction).

    Null texts and texts without a letter, and all texts without a network, are ``und`` with score
    0. Only the text is an input. Same-named columns in ``keep`` are replaced; rows stay rows,
    repeated or not."""
    keep = [c for c in dict.fromkeys([id_col, *(keep or [])]) if c not in ("lang_pred", "score", "likelihood")]
    readable = F.coalesce(F.col(text_col).rlike(LETTER), F.lit(False))
    others = [c for c in keep if c != text_col]
    rows = df.select(readable.alias("__readable"), F.col(text_col).cast("string"), *others)
    at = [1 if c == text_col else 2 + others.index(c) for c in keep]
    schema = ", ".join(f"`{c}` {rows.schema[i].dataType.simpleString()}" for c, i in zip(keep, at, strict=True)) + ", lang_pred string, score double" + (", likelihood double" if likelihood else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            readable = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            names, scores, likely = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows), np.full(batch.num_rows, np.nan)
            if network is not None and readable.any():
                texts = batch.column(1).filter(batch.column(0)).cast(pa.large_string())
                offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
                flat = np.frombuffer(texts.buffers()[2], np.uint8)
                total = _sum_windows(network, flat, offsets)
                p = np.exp(total - total.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                names[readable] = np.array(network.languages, object)[best]
                scores[readable] = p[np.arange(len(p)), best]
                if likelihood:
                    likely[readable] = _likelihoods(network, flat, offsets, best)
            columns, added = [*(batch.column(i) for i in at), pa.array(names, pa.string()), pa.array(scores)], ["lang_pred", "score"]
            if likelihood:
                columns, added = [*columns, pa.array(likely, pa.float64(), from_pandas=True)], [*added, "likelihood"]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *added])

    return rows.mapInArrow(run, schema)


def _sum_windows(network: Network, flat: np.ndarray, offsets: np.ndarray, most: int = 16384) -> np.ndarray:
    """Mean log-probabilities of each text's windows, weighted by their bytes."""
    lengths = np.diff(offsets)
    doc, start = cut_windows(lengths)
    total, weights = np.zeros((len(lengths), len(network.languages))), np.zeros(len(lengths))
    for a in range(0, len(doc), most):
        d = doc[a : a + most]
        begins, ends = offsets[d] + start[a : a + most], offsets[d + 1]
        size = np.minimum(ends - begins, WINDOW).astype(np.float64)
        logs = network.log_probabilities(fill_windows(flat, begins, ends)) * size[:, None]
        heads = np.flatnonzero(np.diff(d, prepend=-1))
        total[d[heads]] += np.add.reduceat(logs, heads, axis=0)
        weights[d[heads]] += np.add.reduceat(size, heads)
    return total / weights[:, None]


def _likelihoods(network: Network, flat: np.ndarray, offsets: np.ndarray, languages: np.ndarray) -> np.ndarray:
    """Mean log-probability of each text's byte pairs in its language, and of ``TYPICAL_PAIRS`` more
    that are typical of the language."""
    sums = np.zeros(len(languages))
    for i, language in enumerate(languages):
        x = flat[offsets[i] : offsets[i + 1]].astype(np.intp)
        sums[i] = network.pairs[language].take(x[:-1] << 8 | x[1:]).sum(dtype=np.float64)
    return (sums + TYPICAL_PAIRS * network.typical[languages]) / (np.maximum(np.diff(offsets) - 1, 0) + TYPICAL_PAIRS)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: train on the permitted rows, predict all."""
    docs = common.documents(spark, sf_dir)
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
