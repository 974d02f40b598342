"""Largest-inner-product search with a vantage-point tree per shard.

Inner products become distances when every vector gets one more component that
lifts it to the largest norm M: |x' - q'|^2 = M^2 + |q|^2 - 2<x, q>. A tree
splits its points at the median distance from a vantage point; by the triangle
inequality the far side holds nothing nearer than the gap between the query's
own distance and the median. The far side is skipped if the gap times a factor
exceeds the distance of the last of the k nearest so far: with factor one the
search is exact, a larger one skips more.

Equal vectors are one point of the tree that lists its ids, so copies cost
little. Points are ranked by their exact score and then by the smallest of
their ids that isn't the query's own, so k points hold the k nearest ids
whatever ties there are; rough scores and distances only decide what to look
at, within a margin for their rounding.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import store

K = 20
#: How much more than the triangle inequality allows is skipped; 1 is exact.
FACTOR = 1.0
SHARD_ROWS = 8192
LEAF = 128
#: Trees that one task holds, at most.
TREES = 8
#: Queries that stream past the trees of one task, about.
QUERIES = 1 << 17
#: Queries that meet a leaf at once.
TOGETHER = 2048
_NONE = np.iinfo(np.int64).max


class Tree:
    """A vantage-point tree over the distinct rows of ``vectors``; ``top`` bounds all norms."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float, k: int):
        vectors = vectors + 0.0  # one zero only
        points, inverse = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, inverse.ravel()))
        point, ids = inverse.ravel()[order], ids[order]
        run = np.flatnonzero(np.append(True, (point[1:] != point[:-1]) | (ids[1:] != ids[:-1])))
        # k rows of one id and 2k of a point are all that can be among the k nearest of a query, whose own id doesn't count
        few = np.arange(len(ids)) - np.repeat(run, np.diff(np.append(run, len(ids)))) < k
        point, ids = point[few], ids[few]
        bounds = np.searchsorted(point, np.arange(len(points) + 1))
        listed = [ids[a : min(b, a + 2 * k)] for a, b in zip(bounds[:-1], bounds[1:])]
        lift = np.sqrt(np.maximum(top * top - (points * points).sum(axis=1), 0))
        self.k, self.top, self.nodes = k, top, []
        self.rank = np.arange(len(points))
        self._build(np.column_stack([points, lift]), 0, len(points), np.random.Generator(np.random.PCG64(5)))
        self.points, self.listed = points[self.rank], [listed[i] for i in self.rank]
        #: The smallest id of each point, and the smallest other one.
        self.first = np.array([x[0] for x in self.listed], dtype=np.int64)
        self.second = np.array([next((i for i in x if i != x[0]), _NONE) for x in self.listed], dtype=np.int64)

    def _build(self, lifted: np.ndarray, a: int, b: int, rng) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        if b - a <= LEAF:
            self.nodes[at] = (a, b, -1, 0.0, -1, -1)
            return at
        own = self.rank[a:b]
        vantage = own[rng.integers(b - a)]
        far = np.sqrt(((lifted[own] - lifted[vantage]) ** 2).sum(axis=1))
        order = np.argsort(far, kind="stable")
        self.rank[a:b] = own[order]
        middle = (b - a) // 2
        inner = self._build(lifted, a, a + middle, rng)
        outer = self._build(lifted, a + middle, b, rng)
        self.nodes[at] = (a, b, lifted[vantage][:-1], lifted[vantage][-1], far[order[middle]], (inner, outer, far[order[middle - 1]]))
        return at

    def search(self, query_ids: np.ndarray, queries: np.ndarray, factor: float, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(points, exact scores), the k best of each query; -1 where there are fewer that score ``floor`` or more."""
        k = self.k
        floor = np.full(len(queries), -np.inf) if floor is None else floor
        best = np.full((len(queries), k), -np.inf)
        which = np.full((len(queries), k), -1, dtype=np.int64)
        least = np.full((len(queries), k), _NONE)
        square = (queries * queries).sum(axis=1)
        level = self.top**2 + square
        unit = 8 * (queries.shape[1] + 4) * np.finfo(float).eps
        # bounds of the rounding of a rough score, and of distances and their gaps
        margin, slack = unit * self.top * np.sqrt(square), 4 * np.sqrt(unit * (level + 4 * self.top**2))
        columns, places = np.ascontiguousarray(queries.T), np.ascontiguousarray(self.points.T)

        def meet(a: int, b: int, active: np.ndarray) -> None:
            rough = queries[active] @ self.points[a:b].T
            row, point = np.nonzero(rough >= (np.maximum(best[active, -1], floor[active]) - margin[active])[:, None])
            row, point = active[row], point + a
            own = self.first[point] == query_ids[row]
            name = np.where(own, self.second[point], self.first[point])
            there = ~own | (name != _NONE)
            row, point, name = row[there], point[there], name[there]
            score = np.zeros(len(row))
            for q, x in zip(columns, places):  # as exact_scores does
                score += q[row] * x[point]
            end, last = best[row, -1], least[row, -1]
            there = ((score > end) | (score == end) & (name < last)) & (score >= floor[row])
            row, point, name, score = row[there], point[there], name[there], score[there]
            if not len(row):
                return
            rows = np.unique(row)
            row = np.concatenate([np.repeat(rows, k), row])
            score, name, point = (np.concatenate([old[rows].ravel(), new]) for old, new in ((best, score), (least, name), (which, point)))
            order = np.lexsort((name, -score, row))
            row = row[order]
            keep = order[np.arange(len(row)) - np.searchsorted(row, rows)[np.searchsorted(rows, row)] < k]
            best[rows], least[rows], which[rows] = (x[keep].reshape(-1, k) for x in (score, name, point))

        def visit(node: int, active: np.ndarray) -> None:
            if not len(active):
                return
            a, b, vantage, lift, _, children = self.nodes[node]
            if isinstance(children, int):
                for at in range(0, len(active), TOGETHER):
                    meet(a, b, active[at : at + TOGETHER])
                return
            inner, outer, edge = children
            border = self.nodes[node][4]
            apart = np.sqrt(np.maximum(level[active] - 2 * (queries[active] @ vantage), 0))

            def last(rows):  # distance of the last of the nearest so far, with room for rounding
                return np.sqrt(np.maximum(level[rows] - 2 * np.maximum(best[rows, -1], floor[rows]), 0)) + slack[rows]

            near = apart < border
            visit(inner, active[near])
            visit(outer, active[~near])
            cross, gap = active[near], border - apart[near]
            visit(outer, cross[gap * factor <= last(cross)])
            cross, gap = active[~near], apart[~near] - edge
            visit(inner, cross[gap * factor <= last(cross)])

        visit(0, np.arange(len(queries)))
        return which, best


def exact_scores(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products of matching rows in double precision, summed from the first component on."""
    total = np.zeros(len(queries))
    for j in range(queries.shape[1]):
        total += queries[:, j] * points[:, j]
    return total


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _shards(width: int, top: float, k: int):
    def run(batches):
        ids, vectors, held = [], [], 0

        def tree():
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Tree(np.concatenate(ids), np.concatenate(vectors), top, k))], pa.binary())], names=["tree"])

        for batch in batches:
            for a in range(0, batch.num_rows, SHARD_ROWS):
                part = batch.slice(a, SHARD_ROWS)
                ids.append(part.column(0).to_numpy())
                vectors.append(_vectors(part.column(1), width))
                held += part.num_rows
                if held >= SHARD_ROWS:
                    yield tree()
                    ids, vectors, held = [], [], 0
        if held:
            yield tree()

    return run


def _expanded(tree: Tree, which: np.ndarray, best: np.ndarray, query_ids: np.ndarray):
    """(row, id, score) of the found points' ids other than the query's own."""
    row, slot = np.nonzero(which >= 0)
    point, score = which[row, slot], best[row, slot]
    size = np.array([len(tree.listed[p]) for p in point], dtype=np.int64)
    ids = np.concatenate([tree.listed[p] for p in point]) if len(point) else np.zeros(0, np.int64)
    row, score = np.repeat(row, size), np.repeat(score, size)
    other = ids != query_ids[row]
    return row[other], ids[other], score[other]


def _first_k(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """The k best of each row, ties to smaller ids, in order."""
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[keep], score[keep]


def _met(trees: list, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float):
    """The k nearest of each query over several trees; what one tree gives bounds the search of the next."""
    found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    floor = np.full(len(queries), -np.inf)
    for tree in trees:
        which, best = tree.search(query_ids, queries, factor, floor)
        more = _expanded(tree, which, best, query_ids)
        found = _first_k(*(np.concatenate(x) for x in zip(found, more)), k)
        full = np.flatnonzero(np.bincount(found[0], minlength=len(queries)) >= k)
        floor[full] = found[2][np.searchsorted(found[0], full, side="right") - 1]
    return found


def _searched(width: int, k: int, factor: float):
    """Rows of a cell: first its trees, then its queries, which stream past them."""

    def run(batches):
        cell, trees = None, []
        for batch in batches:
            cells = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if cells[a] != cell:
                    cell, trees = cells[a], []
                part = batch.slice(a, b - a)
                blobs = part.column(1)
                n = len(blobs) - blobs.null_count
                trees += [pickle.loads(blobs[i].as_py()) for i in range(n)]
                asked = part.slice(n)
                for at in range(0, asked.num_rows, TOGETHER):
                    some = asked.slice(at, TOGETHER)
                    query_ids = some.column(2).to_numpy()
                    row, ids, score = _met(trees, query_ids, _vectors(some.column(3), width), k, factor)
                    yield pa.RecordBatch.from_arrays([pa.array(query_ids[row]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query, k: int = K, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id and score: for each row that the condition ``is_query`` holds for, the k other rows of largest inner product.

    ``vectors`` has vec_id and embedding; other columns are ignored. Null,
    empty and zero vectors, vectors with null or non-finite components, rows
    without vec_id, and vectors of another length than most (of equally common
    lengths the longer) take no part. Rows with the query's own vec_id aren't
    its candidates; a vec_id in several rows with equal vectors counts once per
    row. Ties go to the smaller vec_id. Vectors of any length work; a tree holds
    SHARD_ROWS of them. An empty table gives an empty result.

    Trees and queries meet in a grid of cells: a cell has some of the trees,
    which stay in its task's memory, and a share of the queries, which stream
    past them. Queries never leave the executors; a task returns k rows a query.
    """
    spark = vectors.sparkSession
    as_double = F.transform("embedding", lambda x: x.cast("double"))
    clean = vectors.select("vec_id", as_double.alias("v"), is_query.alias("asked")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists("v", lambda x: x != 0)
    )
    sizes = clean.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)).alias("top"), F.count(F.when(F.col("asked"), 1)).alias("asked")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, n, asked, top = sizes[0].d, sizes[0].n, sizes[0].asked, float(np.sqrt(sizes[0].top)) * (1 + 1e-12)
    clean = clean.filter(F.size("v") == width)
    trees = store(clean.select("vec_id", "v").repartition(max(1, -(-n // SHARD_ROWS))).mapInArrow(_shards(width, top, k), "tree binary").withColumn("tree_id", F.monotonically_increasing_id()), "trees")
    count = trees.count()
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # few trees are spread over the tasks there are; of many, a task holds TREES
    deep = min(TREES, max(1, -(-count // slots)))
    across, down = -(-count // deep), max(1, -(-asked // QUERIES))
    order = Window.orderBy("tree_id")  # one row per tree, thousands of vectors each
    placed = trees.select("tree_id").withColumn("column", F.floor((F.row_number().over(order) - 1) / deep))
    held = trees.join(F.broadcast(placed), "tree_id").select(F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("line"), "column", "tree", F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<double>").alias("v"))
    line = F.pmod(F.xxhash64("vec_id"), F.lit(down)).cast("int")
    sent = clean.filter("asked").select(line.alias("line"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("column"), F.lit(None).cast("binary").alias("tree"), F.col("vec_id").alias("query_id"), "v")
    cell = (F.col("line") * F.lit(across) + F.col("column")).cast("int")
    grid = held.unionByName(sent).select(cell.alias("cell"), "tree", "query_id", "v").repartitionById(across * down, "cell").sortWithinPartitions("cell", F.isnull("tree"))
    found = grid.mapInArrow(_searched(width, k, factor), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


ORACLE = r"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY rank <= 20
"""
