"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Vectors are projected to PROJECTED dimensions with Gaussian (2-stable) directions, so a squared
projected distance over the squared true distance follows a chi-square law. A query takes its
projected neighbours nearest first and verifies them exactly; it stops when, by the chi-square law, a
vector closer than the present k-th would have come before with probability CONFIDENCE.

The kd-tree has two levels. Its upper part, fitted on a bounded sample, deals the vectors to blocks;
each block's task builds the rest over the block's own projections, and queries stream past it.
Every query first searches the block it would belong to itself; the k-th score found there bounds its
distance, and it goes on only to blocks whose cell lies within that. So each vector moves once for
each pass (and once more for every QUERY_ROWS queries that its block is asked by).

Inner products become distances with one more coordinate, sqrt(M^2 - |x|^2), M the largest norm.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batchwise, checkpointed

#: With these, nearly isotropic unit vectors of 64 components keep a recall of about 0.94 while about a third of them is verified.
PROJECTED = 32
CONFIDENCE = 0.9
LEAF = 64
#: Vectors of a block on average, and queries that one task puts to a block at most (about).
BLOCK_ROWS = 8192
QUERY_ROWS = 1 << 17
#: Vectors that the upper part of the tree is fitted on, for each length of vectors.
SAMPLE_ROWS = 8192
SEED = 11


def chi_square_cdf(x: float, dims: int) -> float:
    """For an even number of dimensions: a finite sum."""
    if x <= 0:
        return 0.0
    if math.isinf(x) or x > 1400:
        return 1.0
    term = total = 1.0
    for i in range(1, dims // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, dims: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, dims) < p else (lo, mid)
    return hi


class Projection:
    """Directions for vectors of one length, whose norms are at most `big`."""

    def __init__(self, dims: int, big: float, seed: int = SEED):
        self.dims, self.big = dims, big
        self.directions = np.random.default_rng(seed).standard_normal((dims + 1, PROJECTED))

    def points(self, vectors: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(0.0, self.big * self.big - (vectors * vectors).sum(axis=1)))
        return vectors @ self.directions[:-1] + extra[:, None] * self.directions[-1]

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.directions[:-1]


class UpperTree:
    """Median splits of a sample along the widest side, 2^depth cells; a side that doesn't vary isn't split."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.cut = np.zeros(1 << depth, np.int64), np.full(1 << depth, np.inf)
        parts = {1: np.arange(len(sample))}
        low, high = {1: np.full(PROJECTED, -np.inf)}, {1: np.full(PROJECTED, np.inf)}
        for node in range(1, 1 << depth):
            at = parts.pop(node)
            side = np.ptp(sample[at], axis=0) if len(at) else np.zeros(PROJECTED)
            if side.max() > 0:
                self.axis[node] = axis = int(side.argmax())
                self.cut[node] = cut = float(np.median(sample[at, axis]))
                if not (sample[at, axis] > cut).any():  # ties at the median: the largest value goes right
                    self.cut[node] = cut = float(np.nextafter(cut, -np.inf))
            axis, cut = self.axis[node], self.cut[node]
            right = sample[at, axis] > cut if len(at) else np.zeros(0, bool)
            parts[2 * node], parts[2 * node + 1] = at[~right], at[right]
            low[2 * node], high[2 * node + 1] = low[node], high[node]
            high[2 * node], low[2 * node + 1] = high[node].copy(), low[node].copy()
            high[2 * node][axis], low[2 * node + 1][axis] = min(high[node][axis], cut), max(low[node][axis], cut)
        cells = range(1 << depth, 2 << depth)
        self.low, self.high = np.array([low[c] for c in cells]), np.array([high[c] for c in cells])

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - (1 << self.depth)

    def gaps(self, point: np.ndarray) -> np.ndarray:
        """Squared projected distance to each cell; an empty one (beyond an infinite cut) is infinitely far."""
        gap = np.maximum(0.0, np.maximum(self.low - point, point - self.high))
        return (gap * gap).sum(axis=1)


class StableTree:
    """One block of vectors, its projections, and a kd-tree over them: rows stand leaf by leaf, leaves have boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projection: Projection):
        points = projection.points(vectors)
        leaves, todo = [], [np.arange(len(ids))]
        while todo:  # median splits along the widest side
            at = todo.pop()
            side = np.ptp(points[at], axis=0) if len(at) > LEAF else None
            if side is None or side.max() == 0:
                leaves.append(at)
                continue
            axis, half = int(side.argmax()), len(at) // 2
            order = np.argpartition(points[at, axis], half)
            todo += [at[order[:half]], at[order[half:]]]
        rows, size = np.concatenate(leaves), np.array([len(a) for a in leaves])
        self.projection, self.ids, self.vectors, self.points = projection, ids[rows], vectors[rows], points[rows]
        self.start, self.leaf = np.cumsum(size) - size, np.repeat(np.arange(len(leaves)), size)
        self.low, self.high = np.minimum.reduceat(self.points, self.start), np.maximum.reduceat(self.points, self.start)
        self.square = (self.points * self.points).sum(axis=1)

    def search(self, query: np.ndarray, own: int | None, k: int, limit: float, bound: float = -math.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """ids and inner products of the k nearest, ties to smaller ids; vectors verified.

        bound: a score that the k-th of all blocks is known to reach. Projected neighbours are verified
        nearest first, in a few steps: some of the nearest leaves (unless a bound is known), the
        nearest points within reach of what they gave, more, and all within reach of what these gave.
        """
        q = self.projection.queries(query[None, :])[0]
        gap = np.maximum(0.0, np.maximum(self.low - q, q - self.high))
        far = np.einsum("ij,ij->i", gap, gap)
        base, around = self.projection.big**2 + float(query @ query), float(q @ q)
        best_s, best_i, seen = np.zeros(0), np.zeros(0, np.int64), 0
        open_ = np.ones(len(self.ids), bool)

        def reach() -> float:
            worst = max(bound, best_s[-1] if len(best_s) >= k else -math.inf)
            return math.inf if worst == -math.inf else limit * max(0.0, base - 2 * worst) + 1e-9

        def verify(rows: np.ndarray) -> None:
            nonlocal best_s, best_i, seen
            seen += len(rows)
            open_[rows] = False
            if own is not None:
                rows = rows[self.ids[rows] != own]
            rough = np.einsum("ij,j->i", self.vectors[rows], query)
            if len(best_s) >= k:
                rows = rows[rough >= best_s[-1] - 1e-9 * (1 + abs(best_s[-1]))]
            elif len(rows) > k:
                cut = np.partition(rough, len(rough) - k)[len(rough) - k]
                rows = rows[rough >= cut - 1e-9 * (1 + abs(cut))]
            # the measure itself, summed alike for equal vectors
            s, i = np.concatenate([best_s, (self.vectors[rows] * query).sum(axis=1)]), np.concatenate([best_i, self.ids[rows]])
            top = np.lexsort((i, -s))[:k]
            best_s, best_i = s[top], i[top]

        if bound == -math.inf:
            nearest = np.argsort(far, kind="stable")
            some = np.zeros(len(far), bool)
            some[nearest[: max(1, -(-4 * k // LEAF))]] = True
            verify(np.flatnonzero(some[self.leaf])[: 8 * k + LEAF])
        rows = np.flatnonzero((far <= reach())[self.leaf] & open_)
        # projected distances, up to rounding
        away = self.square[rows] + around - 2 * np.einsum("ij,j->i", self.points[rows] if len(rows) < len(self.ids) else self.points, q) - 1e-9 * (1 + around)
        for step in (8 * k, 32 * k, None):
            near = away <= reach()
            rows, away = rows[near], away[near]
            if not len(rows):
                break
            if step is None or len(rows) <= step:
                verify(rows)
                break
            order = np.argpartition(away, step)
            verify(rows[order[:step]])
            rows, away = rows[order[step:]], away[order[step:]]
        return best_i, best_s, seen


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, dims) of rows that take part: id not null, v an array without null or non-finite parts and not all zero."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dims")).where(F.col("id").isNotNull() & fine)


def _matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def _runs(*columns: np.ndarray):
    """(lo, hi) of neighbouring rows that agree in all columns."""
    n = len(columns[0])
    new = np.ones(n + 1, bool)
    if n:
        new[1:-1] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    edge = np.flatnonzero(new[: n + 1])
    return zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) if n else ()


def nearest(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, confidence: float = CONFIDENCE) -> DataFrame:
    """Rows (query_id, rank, vec_id, score, verified): the k largest inner products found for each query.

    Candidates are all usable rows of the query's length but those with its own id; fewer than k give
    all of them. Ties go to smaller ids; a repeated id may stand twice, and query rows that repeat
    id and vector are one. Vectors that are null, zero, or hold null or non-finite components take no
    part. verified: vectors whose products were computed, over all blocks. An empty table, or no
    usable query, gives no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    base = usable(df, key, vector)
    asked = usable(queries, key, vector).withColumn("h", F.xxhash64("v")).dropDuplicates(["id", "h"])
    kinds = base.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.max(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)")).alias("sq")).collect()
    limit, spaces, trees, several = chi_square_quantile(confidence, PROJECTED), {}, {}, False
    for r in kinds:
        spaces[r["dims"]] = space = Projection(r["dims"], math.sqrt(r["sq"]) * (1 + 1e-12))
        depth = max(0, math.ceil(math.log2(r["n"] / BLOCK_ROWS)))
        share = min(1.0, SAMPLE_ROWS / r["n"])
        drawn = base.where((F.col("dims") == r["dims"]) & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))).select("v").limit(2 * SAMPLE_ROWS).collect() if depth else []
        trees[r["dims"]] = UpperTree(space.points(np.array([x["v"] for x in drawn])) if drawn else np.zeros((0, PROJECTED)), depth)
        several |= depth > 0
    held = spark.sparkContext.broadcast((spaces, trees))  # the directions and at most one cell for each BLOCK_ROWS vectors

    def cells(batches):
        import pyarrow as pa

        spaces, trees = held.value
        for batch in batches:
            dims, cell = batch.column(2).to_numpy(), np.zeros(batch.num_rows, np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                cell[at] = trees[d].cell(spaces[d].points(_matrix(batch.column(1).take(pa.array(at)), d)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["id", "v", "dims", "cell"])

    placed = base.transform(batchwise(cells, "id bigint, v array<double>, dims int, cell int"))
    # A cell may hold more than it should (equal vectors can't be told apart): it becomes several blocks.
    size = [(r["dims"], r["cell"], max(1, -(-r["count"] // (2 * BLOCK_ROWS)))) for r in placed.groupBy("dims", "cell").count().collect()] if several else [(d, 0, max(1, -(-r["n"] // (2 * BLOCK_ROWS)))) for r in kinds for d in [r["dims"]]]
    several |= any(n > 1 for _, _, n in size)
    parts = spark.createDataFrame(size, "dims int, cell int, parts int")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    blocks = placed.join(F.broadcast(parts), ["dims", "cell"]).withColumn("part", part)
    width = {(d, c): n for d, c, n in size}

    def visits(home: bool):
        """Blocks that a query (id, v, dims, h, bound) visits: its own, or all within its bound."""

        def run(batches):
            import pyarrow as pa

            spaces, trees = held.value
            for batch in batches:
                out: list[tuple] = []
                dims, bounds = batch.column(2).to_numpy(), batch.column(4).to_numpy()
                for i in range(batch.num_rows):
                    d = int(dims[i])
                    if d not in spaces:
                        continue
                    v = np.array(batch.column(1)[i].as_py())
                    if home:
                        found = trees[d].cell(spaces[d].points(v[None, :]) if v @ v <= spaces[d].big ** 2 else spaces[d].queries(v[None, :]))
                    else:
                        reach = limit * max(0.0, spaces[d].big ** 2 + float(v @ v) - 2 * bounds[i]) + 1e-9 if bounds[i] > -math.inf else math.inf
                        found = np.flatnonzero(trees[d].gaps(spaces[d].queries(v[None, :])[0]) <= reach)
                    out += [(i, c, p) for c in found.tolist() for p in range(1 if home else width.get((d, c), 0))]
                at = pa.array([o[0] for o in out], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(5)), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32())], names=["id", "v", "dims", "h", "bound", "cell", "part"])

        return batchwise(run, "id bigint, v array<double>, dims int, h bigint, bound double, cell int, part int")

    def answers(k: int):
        """Queries past their blocks: rows come sorted by block, vectors before queries."""

        def run(batches):
            import pyarrow as pa

            spaces, _ = held.value
            now, tree, ids, vectors = None, None, [], []
            for batch in batches:
                keys = [batch.column(c).to_numpy() for c in range(5)]  # dims, cell, part, salt, kind
                out: list[list] = [[], [], [], [], [], []]
                for lo, hi in _runs(*keys):
                    block = tuple(int(x[lo]) for x in keys[:4])
                    if block != now:
                        now, tree, ids, vectors = block, None, [], []
                    own, v = batch.column(5).slice(lo, hi - lo).to_numpy(), _matrix(batch.column(6).slice(lo, hi - lo), block[0])
                    if keys[4][lo] == 0:
                        ids.append(own)
                        vectors.append(v)
                        continue
                    if tree is None and ids:
                        joined = np.concatenate(ids)
                        order = np.argsort(joined, kind="stable")
                        tree = StableTree(joined[order], np.concatenate(vectors)[order], spaces[block[0]])
                    h, bound = batch.column(7).slice(lo, hi - lo).to_numpy(), batch.column(8).slice(lo, hi - lo).to_numpy()
                    for q, x, g, b in zip(own.tolist(), v, h.tolist(), bound.tolist(), strict=True):
                        if tree is None:
                            continue
                        i, s, n = tree.search(x, q, k, limit, b)
                        for col, values in zip(out, ([q] * (len(i) + 1), [g] * (len(i) + 1), [None, *i.tolist()], [None, *s.tolist()], [n] + [0] * len(i), [s[-1] if len(s) >= k else -math.inf] * (len(i) + 1)), strict=True):
                            col.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "h", "vec_id", "score", "seen", "kth"])

        return batchwise(run, "query_id bigint, h bigint, vec_id bigint, score double, seen bigint, kth double")

    where = ["dims", "cell", "part"]

    def searched(visiting: DataFrame, k: int) -> DataFrame:
        """(query_id, h, vec_id, score, seen, kth) from each block that is visited; a row without vec_id counts what was verified."""
        load = visiting.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("salts"))
        load = F.broadcast(spark.createDataFrame(load.collect(), "dims int, cell int, part int, salts int"))  # a row for each block
        a = blocks.join(load, where).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        a = a.select(*where, "salt", F.lit(0).alias("kind"), "id", "v", F.lit(0).cast("long").alias("h"), F.lit(0.0).alias("bound"))
        b = visiting.join(load, where).select(*where, F.pmod("h", F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "id", "v", "h", "bound")
        return a.unionByName(b).repartition(*where, "salt").sortWithinPartitions(*where, "salt", "kind", "id").transform(answers(k))

    ready = asked.select("id", "v", "dims", "h", F.lit(-math.inf).alias("bound"))
    if several:
        home = ready.transform(visits(True)).join(F.broadcast(parts), ["dims", "cell"]).withColumn("part", part).drop("parts")
        bounds = searched(checkpointed(home), k).where("vec_id IS NULL").select(F.col("query_id").alias("i"), F.col("h").alias("g"), F.col("kth"))
        ready = ready.join(bounds, (F.col("id") == F.col("i")) & (F.col("h") == F.col("g")), "left").select("id", "v", "dims", "h", F.coalesce("kth", "bound").alias("bound"))
    found = checkpointed(searched(checkpointed(ready.transform(visits(False))), k))
    seen = found.where("vec_id IS NULL").groupBy(F.col("query_id").alias("i"), F.col("h").alias("g")).agg(F.sum("seen").alias("verified"))
    order = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id")
    ranked = found.where("vec_id IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    rows = ranked.join(seen, (F.col("query_id") == F.col("i")) & (F.col("h") == F.col("g")))
    return rows.select("query_id", "rank", "vec_id", "score", "verified")
