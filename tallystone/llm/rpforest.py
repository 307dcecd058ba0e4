"""Nearest neighbours by a forest of random-projection trees (operator 3).

Trees are fitted on a bounded sample: every inner node has a random direction and the median of its
sample's projections. Every vector is then put into one leaf of every tree. A query walks all trees
through one shared priority queue, nearest split planes first, until the leaves it has met hold
enough vectors. Queries and vectors of a leaf meet in one group, where exact double-precision distances
rank the candidates; each leaf gives its best few, and a final ranking merges the leaves.

How many vectors are enough is measured, not assumed: for a few sample vectors the exact neighbours
are found in one pass over all vectors, and the order in which the queue meets these tells the
smallest search that reaches ``TARGET`` of them. Clustered vectors need a few leaves; vectors
without structure need half of all rows, and then no index can help. Trees are as deep as keeps
leaves near ``leaf_rows``, but no deeper than lets a query meet ``MOST_LEAVES`` leaves.

Equal vectors are one candidate with its k + 1 least ids: no other copy can be among the k
nearest, as ties go to the lesser id. So a vector that a third of all rows hold costs no more than any
other. Leaves above ``block_rows`` distinct vectors are cut into blocks that a query meets one by
one, and the ids that share a query's vector are dealt over several groups.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.llm import common

K = 10
TREES = 12
#: Bound of the sample on which split planes are fitted and search is measured.
SAMPLE = 16_384
#: Vectors that a leaf holds, about, where depth allows, and at which a leaf is cut into blocks.
LEAF_ROWS, BLOCK_ROWS = 200, 20_000
#: Levels that a tree has at most: the sample then leaves some 16 vectors for each of the last planes.
MOST_DEPTH = 10
#: Leaves that a query meets at most, about; fewer and larger leaves make up for a longer search. Each
#: returns a few candidates, so their number doesn't grow with the rows.
MOST_LEAVES = 96
#: A query meets SEARCH_ROWS vectors at least (with repeats over trees), and as many as reach TARGET of
#: the exact neighbours of PROBES sample vectors.
SEARCH_ROWS, TARGET, PROBES = 8_000, 0.96, 64
#: Rows of a query's vector that are one group.
SAME_ROWS = 1000


@dataclass
class Forest:
    """Complete binary trees in heap order: node i has children 2i + 1 (projection up to the
    threshold) and 2i + 2."""

    normals: np.ndarray  # trees x inner nodes x dimensions
    thresholds: np.ndarray  # trees x inner nodes
    depth: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """n x trees leaf numbers."""
        out = np.empty((len(x), len(self.normals)), np.int32)
        for t in range(len(self.normals)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                far = np.einsum("ij,ij->i", x, self.normals[t, node]) > self.thresholds[t, node]
                node = 2 * node + 1 + far
            out[:, t] = node - (2**self.depth - 1)
        return out

    def cut(self, depth: int) -> "Forest":
        """The first levels of the trees."""
        n = 2**depth - 1
        return Forest(self.normals[:, :n], self.thresholds[:, :n], depth)

    def search(self, q: np.ndarray, sizes: np.ndarray, rows: int) -> list[tuple[int, int]]:
        """(tree, leaf) pairs, best first, until they hold ``rows`` vectors or all are met. The
        queue holds nodes of all trees by the largest distance to a plane that lies between."""
        margins = np.einsum("tnd,d->tn", self.normals, q) - self.thresholds
        queue = [(0.0, t, 0) for t in range(len(self.normals))]
        inner, out, held = 2**self.depth - 1, [], 0
        while queue and held < rows:
            off, t, node = heapq.heappop(queue)
            while node < inner:
                margin = margins[t, node]
                near = 2 * node + 1 + (margin > 0)
                heapq.heappush(queue, (max(off, abs(margin)), t, 4 * node + 3 - near))
                node = near
            if sizes[t, node - inner]:
                out.append((t, node - inner))
                held += sizes[t, node - inner]
        return out


def fit(sample: np.ndarray, trees: int, depth: int, seed: int = 11) -> Forest:
    rng = np.random.default_rng(seed)
    n, dim = 2**depth - 1, sample.shape[1]
    normals = rng.normal(size=(trees, n, dim))
    normals /= np.linalg.norm(normals, axis=2, keepdims=True)
    thresholds = np.zeros((trees, n))
    for t in range(trees):
        node = np.zeros(len(sample), np.int64)
        for level in range(depth):
            projected = np.einsum("ij,ij->i", sample, normals[t, node])
            order = np.lexsort((projected, node))
            for group in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                if len(group):
                    thresholds[t, node[group[0]]] = np.median(projected[group])
            node = 2 * node + 1 + (projected > thresholds[t, node])
    return Forest(normals, thresholds, depth)


def usable(vector_col: str) -> Column:
    """Not null or empty, all components finite, not all zero."""
    v = F.col(vector_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1 if len(column) else 0)


def _distances(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed in the order of the components, so that all engines agree."""
    d = np.zeros((len(queries), len(x)))
    for j in range(x.shape[1]):
        d += (queries[:, j, None] - x[None, :, j]) ** 2
    return np.sqrt(d)


def _best(queries: np.ndarray, q: np.ndarray, x: np.ndarray, c: np.ndarray, k: int) -> pa.Table:
    """The k + 1 nearest of x (numbers c) for each query (numbers q): query, c, score."""
    out: dict[str, list] = {"query": [], "c": [], "score": []}
    if len(q) and len(x):
        order = np.argsort(c)
        x, c = x[order], c[order]
        step = max(1, (1 << 21) // x.size)
        for a in range(0, len(q), step):
            d = _distances(queries[a : a + step], x)
            # Stable: equal distances stay in the order of ids.
            best = np.argsort(d, axis=1, kind="stable")[:, : k + 1]
            out["query"].append(np.repeat(q[a : a + step], best.shape[1]))
            out["c"].append(c[best].ravel())
            out["score"].append(np.take_along_axis(d, best, 1).ravel())
    return pa.table({n: pa.array(np.concatenate(v) if v else [], t) for (n, v), t in zip(out.items(), (pa.int64(), pa.int64(), pa.float64()), strict=True)})


def needed_rows(forest: Forest, sizes: np.ndarray, probes: np.ndarray, neighbours: list[np.ndarray], target: float = TARGET) -> int:
    """Vectors that a search must meet so that it reaches ``target`` of the neighbours of the probes."""
    held = []
    for x, near in zip(probes, neighbours, strict=True):
        if not len(near):
            continue
        met = forest.search(x, sizes, int(sizes.sum()) + 1)
        after = {leaf: n for leaf, n in zip(met, np.cumsum([sizes[leaf] for leaf in met]), strict=True)}
        of = forest.leaves(near)
        held += [min(after.get((t, int(leaf)), sizes.sum()) for t, leaf in enumerate(row)) for row in of]
    return int(np.quantile(held, target, method="higher")) if held else 0


def nearest(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS, search_rows: int = SEARCH_ROWS, target: float = TARGET) -> DataFrame:
    """For rows where ``is_query``: query_id, rank int (from 1), vec_id, score double (Euclidean
    distance): the ``k`` nearest found among all rows but those of the query's own id, nearest
    first, ties to the lesser id; all candidates if there are fewer than ``k``.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
    with a null id. Ids must be numbers. Vectors of several lengths are searched each among those of
    its own length, one length after the other. Rows that repeat id and vector count once. Other
    columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(usable("v") & F.col("id").isNotNull())
    # One row for each length that some query has.
    lengths = [r.n for r in rows.groupBy(F.size("v").alias("n")).agg(F.max("q").alias("q")).where("q").orderBy("n").collect()]
    found = [_nearest(rows.where(F.size("v") == n), k, trees, sample, leaf_rows, block_rows, search_rows, target) for n in lengths]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _nearest(rows: DataFrame, k: int, trees: int, sample: int, leaf_rows: int, block_rows: int, search_rows: int, target: float) -> DataFrame:
    # Limits per task come before the shuffle, so no vector is hot.
    ranked = rows.select("id", "v").withColumn("n", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = common.written(ranked.groupBy("v").agg(F.min("id").alias("c"), F.sort_array(F.collect_set("id")).alias("ids")), "vectors")
    total = classes.count()
    depth = max(0, min(MOST_DEPTH, int(np.ceil(np.log2(max(1, total / leaf_rows))))))
    place, share = F.pmod(F.xxhash64("c"), F.lit(1 << 30)), min(1.0, sample / total)
    picked = classes.where(place < int(share * (1 << 30))) if share < 1 else classes
    # Twice the expected size bounds what comes to the driver.
    fitted = picked.select("c", "v").orderBy(F.xxhash64("c")).limit(2 * sample).toArrow().combine_chunks().sort_by([("c", "ascending")])
    forest = fit(_matrix(fitted["v"]), trees, depth)
    kind = classes.schema["v"].dataType.simpleString()

    def placed_in(forest: Forest) -> DataFrame:
        def to_leaves(batches):
            for batch in batches:
                leaves = forest.leaves(_matrix(batch.column(0)))
                n = batch.num_rows
                at = pa.array(np.repeat(np.arange(n), trees))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(trees, dtype=np.int32), n)), pa.array(leaves.ravel()), *[c.take(at) for c in batch.columns]], ["tree", "leaf", "v", "c"])

        return classes.select("v", "c").mapInArrow(to_leaves, f"tree int, leaf int, v {kind}, c long")

    # Bounded: one row per tree and leaf.
    counts = placed_in(forest).groupBy("tree", "leaf").count().toArrow()
    sizes = np.zeros((trees, 2**depth), np.int64)
    sizes[counts["tree"].to_numpy(), counts["leaf"].to_numpy()] = counts["count"].to_numpy()
    met = search_rows
    if total * trees > search_rows:
        chosen = fitted.take(pa.array(np.linspace(0, fitted.num_rows - 1, min(PROBES, fitted.num_rows)).astype(np.int64)))
        probes = _matrix(chosen["v"])
        met = max(search_rows, needed_rows(forest, sizes, probes, _exact(classes, probes, k), target))
    leaves = met / max(1, total * trees) * trees * 2**depth
    while depth and leaves > MOST_LEAVES:
        depth, leaves, sizes = depth - 1, leaves / 2, sizes.reshape(trees, -1, 2).sum(axis=2)
    forest = forest.cut(depth)
    blocks = -(-sizes // block_rows)

    def block_of(batches):
        for batch in batches:
            n = blocks[batch.column(0).to_numpy(), batch.column(1).to_numpy()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((batch.column(3).to_numpy() * 2654435761 % np.maximum(n, 1)).astype(np.int32))], [*batch.schema.names, "block"])

    placed = placed_in(forest)
    placed = placed.mapInArrow(block_of, f"tree int, leaf int, v {kind}, c long, block int") if blocks.max() > 1 else placed.withColumn("block", F.lit(0))

    # A query class: a distinct vector that some query row has.
    query_ids = rows.where("q").select(F.col("id").alias("query_id"), "v").distinct()
    query_ids = common.written(query_ids.join(classes.select("v", F.col("c").alias("query")), "v").select("query_id", "query"), "queries")
    asked = classes.join(query_ids.select("query").distinct(), F.col("c") == F.col("query"), "left_semi").select("v", "c")

    def to_searches(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 64):
                batch = whole.slice(a, 64)
                found = []
                for i, x in enumerate(_matrix(batch.column(0))):
                    found += [(i, t, leaf, b) for t, leaf in forest.search(x, sizes, met) for b in range(blocks[t, leaf])]
                at, t, leaf, b = (np.array(c, np.int32) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int32),) * 4
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(leaf), pa.array(b), *[c.take(pa.array(at)) for c in batch.columns]], ["tree", "leaf", "block", "v", "query"])

    searches = asked.mapInArrow(to_searches, f"tree int, leaf int, block int, v {kind}, query long")

    def best_of(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return _best(_matrix(left["v"]), left["query"].to_numpy(), _matrix(right["v"]), right["c"].to_numpy(), k)

    keys = ["tree", "leaf", "block"]
    hits = searches.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(best_of, "query long, c long, score double")
    # Trees give the same candidates; a query has k + 1 classes, and then k + 1 ids, at most after this.
    hits = hits.groupBy("query", "c").agg(F.min("score").alias("score"))
    first = lambda tie: F.row_number().over(Window.partitionBy("query").orderBy("score", tie))
    hits = hits.withColumn("n", first("c")).where(F.col("n") <= k + 1).drop("n")
    each = hits.join(classes.select("c", "ids"), "c").select("query", "score", F.explode("ids").alias("vec_id"))
    each = each.withColumn("n", first("vec_id")).where(F.col("n") <= k + 1).drop("n")
    # The ids of one query vector are dealt over groups, each of which gets that vector's few neighbours.
    groups = query_ids.groupBy("query").agg(F.ceil(F.count(F.lit(1)) / SAME_ROWS).alias("groups"))
    each = each.join(groups, "query").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("groups")
    many = groups.where(F.col("groups") > 1)
    dealt = query_ids.join(many, "query", "left").withColumn("part", F.pmod(F.xxhash64("query_id"), F.coalesce("groups", F.lit(1).cast("long")))).drop("groups")
    final = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = dealt.join(each, ["query", "part"]).where(F.col("query_id") != F.col("vec_id")).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return out.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _exact(classes: DataFrame, probes: np.ndarray, k: int) -> list[np.ndarray]:
    """The vectors of the k nearest classes of each probe but itself, by one pass over all."""
    kind = classes.schema["v"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x, c = _matrix(batch.column(0)), batch.column(1).to_numpy()
            best = _best(probes, np.arange(len(probes)), x, c, k)
            at = np.searchsorted(c, best["c"].to_numpy(), sorter=np.argsort(c))
            rows = pa.array(np.argsort(c)[at])
            yield pa.RecordBatch.from_arrays([*(best[n].combine_chunks() for n in ("query", "c", "score")), batch.column(0).take(rows)], ["query", "c", "score", "v"])

    near = classes.select("v", "c").mapInArrow(run, f"query long, c long, score double, v {kind}")
    order = Window.partitionBy("query").orderBy("score", "c")
    # Bounded: k + 1 rows of each probe.
    near = near.withColumn("n", F.row_number().over(order)).where((F.col("n") > 1) & (F.col("n") <= k + 1)).select("query", "v").toArrow()
    queries, found = near["query"].to_numpy(), _matrix(near["v"]) if near.num_rows else np.zeros((0, probes.shape[1]))
    return [found[queries == i] for i in range(len(probes))]


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the ten nearest of every row whose id is divisible by 100."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)


#: Exact neighbours in SQL. It equals ``query`` while SEARCH_ROWS reaches all leaves (to about 600
#: vectors); beyond, ``query`` has a recall below 1.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, w.vec_id, sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - w.e[i]) * (q.e[i] - w.e[i])))) AS score
  FROM v q JOIN v w ON q.vec_id <> w.vec_id AND q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
