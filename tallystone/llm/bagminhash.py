"""Near-duplicates by BagMinHash (operator 8).

A text is the multiset of its five-word shingles. Its signature has ``POSITIONS`` values; two
signatures agree in a position with exactly the probability of the weighted Jaccard similarity
sum(min) / sum(max) of the multisets. Bands of the signature propose links, and each link is verified
by the exact overlap of the multisets.

Signature. The weight axis is cut at the whole numbers, and every shingle owns a Poisson process
over (weight, time) whose points each belong to a random position; a position's value is the time of
the first point below the shingle's weight. The processes are hierarchical: one for the weights up
to 1, one up to 2, one up to 4 and so on, each as dense as its range is wide, and a point's hash
says into which unit cell of its range it falls. So texts that hold a shingle 3 and 5 times share the
points of the first three cells, and a weight of w costs log w processes. Points come in ascending
order from their shingle's hash and end at a time by which all positions are very likely filled
(else the text is done again to a later time), so a text costs about n + POSITIONS x log POSITIONS,
not n x POSITIONS.

Links. All texts of a bucket are compared with the bucket's first text. Members that are then in
different classes are compared too, unless their distances to that first text differ by more than
1 - similarity (the distance is a metric) or their sizes rule the link out. Classes are the
connected components of the verified links.

Hot groups. Texts travel only where a bucket is shared: a bitmap of the wanted ones thins out the
documents before their shuffle. A first text meets its bucket's texts in groups of bounded rows. Of
the members that are left to compare, those of the bucket's largest class travel once, as none of
their pairs among themselves matter, and only the others go to each of its blocks. Blocks are bounded
by rows and by shingles. Joins on buckets, texts and classes broadcast the keys of many rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm import common

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
POSITIONS = BANDS * ROWS
#: Points per position up to the first end time; 4 texts in a hundred then need a later one.
DENSITY = 8.0
#: Bytes of text whose shingles are made at a time.
SLICE_BYTES = 4 << 20
#: Members of a bucket that are compared as one group, and their shingles, about.
BLOCK, BLOCK_SHINGLES = 500, 1 << 20
#: Texts that meet one first text in one group, about.
STAR_ROWS = 200

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _times(constant: np.uint64, n: int) -> np.uint64:
    return np.uint64(int(constant) * n & 0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)
_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
_PLAIN_EDGE = np.array([chr(b).isalnum() if b < 128 else False for b in range(256)])


def word_hashes(chunks: pa.Array) -> np.ndarray:
    """Hash of the word inside each lower-case run of non-space characters (without leading and
    trailing characters that are neither letters nor digits), or 0 if there is none."""
    lengths = pc.binary_length(chunks).to_numpy().astype(np.int64)
    data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)[: int(lengths.sum())]
    starts = np.cumsum(lengths) - lengths
    out = np.zeros(len(chunks), np.uint64)
    some = lengths > 0
    ready = np.zeros(len(chunks), bool)
    ready[some] = _PLAIN_EDGE[data[starts[some]]] & _PLAIN_EDGE[data[starts[some] + lengths[some] - 1]]
    out[ready] = _hashed(data[np.repeat(ready, lengths)], lengths[ready])
    odd = some & ~ready
    if odd.any():
        trimmed = pc.replace_substring_regex(chunks.filter(pa.array(odd)), pattern=_EDGES, replacement="")
        lengths = pc.binary_length(trimmed).to_numpy().astype(np.int64)
        found = np.zeros(len(trimmed), np.uint64)
        found[lengths > 0] = _hashed(np.frombuffer(trimmed.buffers()[2] or b"", np.uint8)[: int(lengths.sum())], lengths[lengths > 0])
        out[odd] = found
    return out


def _hashed(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Never 0: a sum over the bytes, a number of each byte's own times a power of its place, mixed."""
    if len(lengths) == 0:
        return np.zeros(0, np.uint64)
    starts = np.cumsum(lengths) - lengths
    powers = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(int(lengths.max()) - 1, _M1))))
    sums = np.add.reduceat(_BYTES[data] * powers[np.arange(len(data)) - np.repeat(starts, lengths)], starts)
    return np.maximum(_mixed(sums + lengths.astype(np.uint64) * _STEP), np.uint64(1))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count), sorted by text and hash. Texts of one to four words are
    one shingle; texts without words (null too) have none."""
    n = len(texts)
    empty = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    split = pc.utf8_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    bounds = split.offsets.to_numpy().astype(np.int64)
    coded = pc.dictionary_encode(split.values.slice(bounds[0], bounds[-1] - bounds[0]))
    if len(coded) == 0:
        return empty
    words = word_hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
    doc = np.repeat(np.arange(n), np.diff(bounds))
    real = words != 0
    words, doc = words[real], doc[real]
    if len(words) == 0:
        return empty
    count = np.bincount(doc, minlength=n)
    begin = np.cumsum(count) - count
    # A text of fewer words is one run of all of them, which ends with its own length.
    width = np.minimum(count, WORDS)
    starts = np.arange(len(words))
    starts = starts[starts - begin[doc] <= (count - width)[doc]]
    owner = doc[starts]
    h = np.zeros(len(starts), np.uint64)
    for j in range(WORDS):
        inside = j < width[owner]
        step = words[np.minimum(starts + j, len(words) - 1)]
        h = np.where(inside, (h + step) * _M1, h)
    h = _mixed(h + width[owner].astype(np.uint64) * _STEP)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    owner, h = owner[order], h[order]
    first = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(h, prepend=~h[:1]) != 0))
    return owner[first], h[first], np.diff(first, append=len(h))


def signatures(n: int, doc: np.ndarray, h: np.ndarray, weight: np.ndarray, positions: int = POSITIONS, density: float = DENSITY) -> np.ndarray:
    """n x positions times of first points; infinite for texts without shingles."""
    out = np.full((n, positions), np.inf)
    total = np.bincount(doc, weights=weight, minlength=n)
    todo = total > 0
    while todo.any():
        mine = todo[doc]
        out[todo] = np.inf
        _fill(out.reshape(-1), doc[mine], h[mine], weight[mine], density / total, positions)
        todo &= np.isinf(out).any(axis=1)
        density *= 2
    return out


def _fill(values: np.ndarray, doc: np.ndarray, h: np.ndarray, weight: np.ndarray, end: np.ndarray, positions: int) -> None:
    low, level = 0, 0
    while len(doc):
        # The process of the weights in (low, max(1, 2 low)], for shingles above low.
        width = max(low, 1)
        rate = positions * width
        seed = _mixed(h + _times(_M2, level))
        d, w, time = doc, weight, np.zeros(len(doc))
        number = 0
        while len(d):
            number += 1
            r = _mixed(seed + _times(_STEP, number))
            time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
            alive = time < end[d]
            d, w, time, seed, r = d[alive], w[alive], time[alive], seed[alive], r[alive]
            r = _mixed(r ^ _M1)
            at = d * positions + ((r >> np.uint64(32)) % np.uint64(positions)).astype(np.int64)
            if width > 1:
                inside = low + 1 + (r & np.uint64(width - 1)).astype(np.int64) <= w
                np.minimum.at(values, at[inside], time[inside])
            else:
                np.minimum.at(values, at, time)
        low, level = max(1, low * 2), level + 1
        more = weight > low
        doc, h, weight = doc[more], h[more], weight[more]


def bands(values: np.ndarray, n_bands: int = BANDS) -> np.ndarray:
    """n x bands hashes; the band's number is part of its hash."""
    bits = np.ascontiguousarray(values).view(np.uint64).reshape(len(values), n_bands, -1)
    out = np.broadcast_to(_mixed(np.arange(1, n_bands + 1, dtype=np.uint64)), bits.shape[:2]).copy()
    for j in range(bits.shape[2]):
        out = _mixed(out * _STEP + bits[:, :, j])
    return out.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """sum(min) / sum(max) of two multisets (sorted hashes, counts); 0 if both are empty."""
    (x, m), (y, n) = a, b
    total = m.sum() + n.sum()
    if not total:
        return 0.0
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    common_ = len(x) > 0
    same = x[at] == y if common_ else np.zeros(len(y), bool)
    least = np.minimum(m[at[same]], n[same]).sum() if common_ else 0
    return float(least / (total - least))


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` (a number, as doc_id long), text_hash string (null for a null text), weight long
    (number of shingles) and bands array<long> (empty without shingles), of each whole text. Rows
    stay rows, repeated or not."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.md5(F.col(text_col).cast("binary")).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1, SLICE_BYTES):
            n = batch.num_rows
            doc, h, count = shingles(batch.column(1))
            weight = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
            keys = bands(signatures(n, doc, h, count))[weight > 0].ravel()
            offsets = np.concatenate(([0], np.cumsum(np.where(weight > 0, BANDS, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(weight), lists], ["doc_id", "text_hash", "weight", "bands"])
        common.release_memory()

    return rows.mapInArrow(run, "doc_id long, text_hash string, weight long, bands array<long>")


def verified(stars: DataFrame, with_texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """From distinct pairs (a, b), written: a, b and the exact similarity. ``with_texts`` adds the
    ``text`` of ``node`` to rows; pairs of nodes without a text are left out, and so are null nodes.
    The texts of all b of an a come to it in groups of about ``STAR_ROWS``."""
    counts = stars.groupBy("a").count()
    sizes = counts.select("a", F.ceil(F.col("count") / STAR_ROWS).alias("parts"))
    ends = common.join_unique(stars, sizes, "a", common.hot_keys(counts)).select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("node"), F.lit(False).alias("head"))
    heads = sizes.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("node"), F.lit(True).alias("head"))
    rows = with_texts(heads.unionByName(ends)).select("a", "part", F.when(~F.col("head"), F.col("node")).alias("b"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = None, None
        for batch in common.slices(batches, 3, SLICE_BYTES):
            doc, h, count = shingles(batch.column(3))
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            out = []
            for i, (a, part, b) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                own = h[ends[i] : ends[i + 1]], count[ends[i] : ends[i + 1]]
                if b is None:
                    at, head = (a, part), tuple(x.copy() for x in own)
                elif (a, part) == at:
                    out.append((a, b, similarity(head, own)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "similarity"])
        common.release_memory()

    # The first text comes first in its group.
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``links`` (a, b); a component is named by its least node.
    Repeated links, loops and either direction count once; links with a null end must not occur; no
    links give an empty table.

    Least labels spread along links, and each label then jumps to its own label, until nothing
    changes. All steps are joins and partial minima; only counts come to the driver. Nodes of many
    links and labels of many nodes are joined by broadcast (``common.join_unique``).
    """
    both = common.written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    hubs = common.hot_keys(both.groupBy("b").count())
    labels = common.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        named = labels.select(F.col("node").alias("b"), "component")
        near = common.join_unique(both, named, "b", hubs).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        spread = labels.join(near, "node").select("node", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        large = common.hot_keys(labels.groupBy(F.col("component").alias("to")).count())
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("root"))
        new = common.written(common.join_unique(spread, jump, "to", large).select("node", F.least("to", "root").alias("component"), "was"), "labels")
        common.drop_scratch(labels)
        labels = new
        if labels.where(F.col("component") != F.col("was")).isEmpty():
            common.drop_scratch(both)
            back = labels.select("node", "component")
            back._scratch_path = labels._scratch_path
            return back


def cross_links(rows: DataFrame, with_texts: Callable[[DataFrame], DataFrame], least: float = SIMILARITY, block: int = BLOCK, hot: DataFrame | None = None) -> DataFrame:
    """Links (a, b) of similarity ``least`` or more between different components within a bucket, as
    many as join these components, from rows (key, node, weight, far, component), written.
    ``with_texts`` adds the ``text`` of ``node`` to rows; ``hot`` are keys of many rows. Keys and nodes aren't null; a node is once in
    a bucket.

    A bucket's members are compared where they are, so pairs are never rows. Members go to blocks of
    about ``block`` rows and ``BLOCK_SHINGLES`` shingles. Each block of the bucket's largest component is
    paired with each block of the other members, and these blocks among themselves; so where one
    component holds nearly all, its texts travel once.
    """
    each = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    needed = lambda n, weight: F.greatest(F.ceil(n / block), F.ceil(weight / BLOCK_SHINGLES), F.lit(1).cast("long"))
    main = F.max(F.struct("n", "component", "weight"))
    buckets = each.groupBy("key").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), main.alias("main"))
    buckets = buckets.select("key", F.col("main.component").alias("main"), needed(F.col("main.n"), F.col("main.weight")).alias("main_blocks"), needed(F.col("n") - F.col("main.n"), F.col("weight") - F.col("main.weight")).alias("blocks"))
    rows = common.join_unique(rows, buckets, "key", hot)
    is_main = F.col("component") == F.col("main")
    own = F.pmod(F.xxhash64("node"), F.when(is_main, F.col("main_blocks")).otherwise(F.col("blocks")))
    # Groups: a block of the main component and one of the others (kind 0), two blocks of the others (1).
    group = lambda kind, one, two: F.struct(F.lit(kind).alias("kind"), one.alias("one"), two.alias("two"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    of_main = F.transform(upto(F.col("blocks")), lambda k: group(0, F.col("own"), k))
    of_others = F.concat(F.transform(upto(F.col("main_blocks")), lambda k: group(0, k, F.col("own"))), F.transform(upto(F.col("blocks")), lambda k: group(1, F.least("own", k), F.greatest("own", k))))
    rows = rows.withColumn("own", own).withColumn("is_main", is_main).withColumn("group", F.explode(F.when(F.col("is_main"), of_main).otherwise(of_others)))
    rows = rows.select("key", "group.*", "node", "weight", "far", "component", F.when(F.col("is_main"), -1).otherwise(F.col("own")).alias("own"))
    group_by = ["key", "kind", "one", "two"]
    rows = with_texts(rows).select(*group_by, "text", "node", "weight", "far", "component", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in common.slices(batches, 4, SLICE_BYTES):
            doc, h, count = shingles(batch.column(4))
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            out = []
            for i, row in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 5, 6, 7, 8, 9)), strict=True)):
                if row[:4] != at:
                    out += _group_links(held, at, least)
                    at, held = row[:4], []
                held.append((*row[4:], h[ends[i] : ends[i + 1]].copy(), count[ends[i] : ends[i + 1]].copy()))
            if out:
                yield _links(out)
        yield _links(_group_links(held, at, least))
        held = []
        common.release_memory()

    return rows.repartition(*group_by).sortWithinPartitions(*group_by).mapInArrow(run, "a long, b long")


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _group_links(rows: list[tuple], at: tuple | None, least: float) -> list[tuple[int, int]]:
    """Links that join components of one group; ``at`` is its key, kind, one, two; rows are
    (node, weight, far, component, block, hashes, counts). Sizes and distances to the bucket's first text rule pairs out before any comparison."""
    if len(rows) < 2:
        return []
    node, weight, far, component, block = (np.array(c) for c in list(zip(*rows, strict=True))[:5])
    size = np.minimum.outer(weight, weight) >= least * np.maximum.outer(weight, weight)
    can = size & (np.abs(np.subtract.outer(far, far)) <= 1 - least + 1e-9) & (component[:, None] != component[None])
    if at[1] == 0:  # pairs of the main component and the others
        can &= (block < 0)[:, None] != (block < 0)[None]
    elif at[2] != at[3]:
        can &= block[:, None] != block[None]
    one, two = np.nonzero(np.triu(can, 1))
    if not len(one):
        return []
    if len(one) <= 4 * len(rows):
        alike = np.array([similarity(rows[i][5:], rows[j][5:]) for i, j in zip(one, two, strict=True)]) >= least
    else:
        shared = _overlaps(rows)[one, two]
        alike = shared / (weight[one] + weight[two] - shared) >= least
    parent = {c: c for c in component.tolist()}
    out = []
    for i, j in zip(one[alike].tolist(), two[alike].tolist(), strict=True):
        a, b = (_root(parent, int(component[k])) for k in (i, j))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(node[i]), int(node[j])))
    return out


def _root(parent: dict[int, int], c: int) -> int:
    while parent[c] != c:
        parent[c] = parent[parent[c]]
        c = parent[c]
    return c


def _overlaps(rows: list[tuple], few: int = 16, columns: int = 4096) -> np.ndarray:
    """sum(min) of all pairs. The c-th occurrence of a shingle is an element of its own, so overlaps
    are counts of shared elements: matrix products for elements that many rows have, pairs of rows
    for the others."""
    m = len(rows)
    owner = np.repeat(np.arange(m), [len(r[5]) for r in rows])
    h, count = np.concatenate([r[5] for r in rows]), np.concatenate([r[6] for r in rows])
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    element = np.repeat(h, count) ^ _mixed(nth.astype(np.uint64))
    owner = np.repeat(owner, count)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    first = np.flatnonzero(np.diff(element, prepend=~element[:1]) != 0)
    holders = np.diff(first, append=len(element))
    out = np.zeros((m, m))
    for f in range(2, few + 1):
        begin = first[holders == f]
        if len(begin):
            who = owner[begin[:, None] + np.arange(f)]
            i, j = np.triu_indices(f, 1)
            out += np.bincount((who[:, i] * m + who[:, j]).ravel(), minlength=m * m).reshape(m, m)
    out = out + out.T  # each pair was counted once, in either order
    many = np.flatnonzero(holders > few)
    for a in range(0, len(many), columns):
        part = many[a : a + columns]
        has = np.zeros((m, len(part)), np.float32)
        at = np.repeat(first[part] - (np.cumsum(holders[part]) - holders[part]), holders[part]) + np.arange(int(holders[part].sum()))
        has[owner[at], np.repeat(np.arange(len(part)), holders[part])] = 1
        out += has @ has.T
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id long, class_id long (the class's least id), class_size long,
    text_hash string and kept boolean (the class's one document that stays).

    Documents of equal texts are one class; so are documents joined by links of similarity
    ``least`` or more. Null texts are classes of their own. Texts without words (empty ones too) join
    equal texts only. Null ids take part through their texts; a class of null ids alone has a null
    class_id. Rows that repeat id and text are members each, and ``kept`` is true for each of them.
    """
    rows = common.written(signed(docs, id_col, text_col), "signed")
    texts = rows.where(F.col("text_hash").isNotNull()).groupBy("text_hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    nodes = common.written(texts.withColumn("node", F.monotonically_increasing_id()), "nodes")
    placed = nodes.select(F.explode("bands").alias("key"), "node")
    buckets = common.written(placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "bucket-sizes")
    hot = common.hot_keys(buckets, "n")
    placed = common.maybe_among(placed, "key", buckets.select("key"), 8)
    shared = common.written(common.join_unique(placed, buckets, "key", hot), "buckets")
    # The member that shares most with others is the bucket's first text: an original comes before its copies.
    weights = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    leaders = shared.join(weights, "node").groupBy("key").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("leader"))
    members = common.written(common.join_unique(shared.select("key", "node"), leaders, "key", hot), "members")
    stars = members.where(F.col("node") != F.col("leader")).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    stars = common.written(stars, "stars")
    common.drop_scratch(shared)

    # Texts come from the documents by hash and id; rows that repeat these hold a text once.
    known = nodes.select("node", F.unhex("text_hash").alias("hash"), F.coalesce("first_id", F.lit(0).cast("long")).alias("id"), F.col("first_id").isNull().alias("no_id"))
    keys = ["hash", "id", "no_id"]
    source = docs.where(F.col(text_col).isNotNull()).select(F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("hash"), F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")).alias("id"), F.col(id_col).cast("long").isNull().alias("no_id"), F.col(text_col).cast("string").alias("text"))

    def with_texts(of_nodes: DataFrame) -> DataFrame:
        of_nodes = common.written(of_nodes.join(known, "node"), "wanted")
        place = F.xxhash64(*keys).alias("place")
        found = common.maybe_among(source.withColumn("place", place), "place", of_nodes.select(place)).select(*keys, "text")
        return found.dropDuplicates(keys).join(of_nodes, keys)

    tested = common.written(verified(stars, with_texts), "tested")
    links = tested.where(F.col("similarity") >= least)
    found = components(links)

    # Members of one bucket that are in different classes yet: only links between them are missing.
    sized = members.where(F.col("node") != F.col("leader")).join(nodes.select("node", "weight"), "node").join(found, "node", "left")
    distance = tested.select(F.col("a").alias("leader"), F.col("b").alias("node"), (1 - F.col("similarity")).alias("far"))
    sized = sized.join(distance, ["leader", "node"]).select("key", "node", "weight", "far", F.coalesce("component", "node").alias("component"))
    mixed = sized.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where(F.col("lo") != F.col("hi")).select("key")
    open_ = common.written(common.join_unique(sized, mixed, "key", hot), "open")
    if not open_.isEmpty():
        more = common.written(cross_links(open_, with_texts, least, hot=hot), "links")
        if not more.isEmpty():
            common.drop_scratch(found)
            found = components(links.select("a", "b").unionByName(more.select("a", "b")))
        common.drop_scratch(more)
    common.drop_scratch(members, stars, buckets, open_, tested)

    classes = nodes.select("node", "text_hash", "first_id", "copies").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = F.min(F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("id"), F.col("text_hash").alias("hash")))
    heads = classes.groupBy("component").agg(least_id.alias("head"), F.sum("copies").alias("class_size"))
    large = common.hot_keys(found.groupBy("component").count())
    of_text = common.join_unique(classes.select("text_hash", "component"), heads, "component", large)
    of_text = of_text.select("text_hash", F.col("head.id").alias("class_id"), F.col("head.hash").alias("head_hash"), "class_size")
    copied = common.hot_keys(nodes.select("text_hash", "copies"), "copies")
    with_class = common.join_unique(rows.select("doc_id", "text_hash"), of_text, "text_hash", copied, "left")
    alone = F.col("text_hash").isNull()
    return with_class.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), "text_hash", F.when(alone, True).otherwise((F.col("text_hash") == F.col("head_hash")) & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class; null texts all stay."""
    kept = common.written(near_duplicates(docs, id_col, text_col, least).where(F.col("kept") & F.col("text_hash").isNotNull()).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")), "kept")
    repeated = not kept.groupBy("__id", "__hash").count().where("count > 1").isEmpty()
    hashed = docs.withColumn("__text_hash", F.md5(F.col(text_col).cast("binary")))
    unique = kept.distinct() if repeated else kept
    same = (F.col("__text_hash") == F.col("__hash")) & F.col(id_col).cast("long").eqNullSafe(F.col("__id"))
    left = hashed.where(F.col(text_col).isNotNull()).join(unique, same, "left_semi")
    if repeated:
        left = left.dropDuplicates([id_col, "__text_hash"])
    return left.drop("__text_hash").unionByName(docs.where(F.col(text_col).isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every document and its class."""
    return near_duplicates(common.documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "kept")


#: Classes in SQL, from all pairs of texts that share a shingle.
ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT text, min(doc_id) AS node, count(*) AS copies,
         list_filter(list_transform(string_split_regex(lower(text), '\s+'), lambda x: regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL GROUP BY text
), s AS (
  SELECT node, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [len(w) || '|' || array_to_string(w, ' ')] ELSE [] END) AS shingle FROM t
), c AS (SELECT node, shingle, count(*) AS n FROM s GROUP BY ALL),
z AS (SELECT node, sum(n) AS total FROM c GROUP BY node),
o AS (SELECT a.node AS x, b.node AS y, sum(least(a.n, b.n)) AS both_have FROM c a JOIN c b ON a.shingle = b.shingle AND a.node < b.node GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN z zx ON x = zx.node JOIN z zy ON y = zy.node WHERE CAST(both_have AS DOUBLE) / CAST(zx.total + zy.total - both_have AS DOUBLE) >= 0.8),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(x, y) AS (SELECT node, node FROM t UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x),
h AS (SELECT x AS node, min(y) AS class_id FROM reach GROUP BY x),
k AS (SELECT text, class_id, sum(copies) OVER (PARTITION BY class_id) AS class_size FROM t JOIN h USING (node))
SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, CAST(coalesce(k.class_size, 1) AS BIGINT) AS class_size, coalesce(k.class_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN k ON d.text = k.text
"""
