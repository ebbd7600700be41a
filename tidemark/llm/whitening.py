"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Entries become integers, so sums and means are exact. Each partition of the distinct vectors keeps its
number of rows, their sums, and the singular values and right vectors of its centred rows, all of
them. Two such summaries merge without loss: the rows diag(s) V^T of both, and one row
sqrt(n m / (n + m)) (mean_n - mean_m) for the shift between their means, are decomposed again.
Summaries merge in groups of FAN until one is left; its squared singular values over n are the eigenvalues
of the covariance, found without ever forming it. Centring comes first, so large means cost no digits.

Vectors of different lengths are whitened apart.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batchwise, checkpointed, shared_dir, spread

#: Scale and shift of an entry before it becomes an integer.
SCALE, SHIFT = 64, 1_000_000
#: Components that are returned at most.
COMPONENTS = 16
#: Rows that one decomposition takes, and summaries that one task merges.
ROWS, FAN = 4096, 8

_SUMMARY = "dims int, at bigint, n bigint, sums array<bigint>, s array<double>, vt array<double>"


def integers(vector: Column) -> Column:
    """floor(SCALE * entry) + SHIFT in double precision, as longs; null for vectors that take no part.

    Those are null or empty, or hold null or non-finite entries.
    """
    v = vector.cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(v, lambda x: F.floor(F.lit(float(SCALE)) * x).cast("long") + F.lit(SHIFT).cast("long")))


class Summary:
    """n rows, their exact sums, and singular values and right vectors of the centred rows."""

    def __init__(self, n: int, sums: list[int], s: np.ndarray, vt: np.ndarray):
        self.n, self.sums, self.s, self.vt = n, sums, s, vt

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        n = len(x)
        sums = _exact_sums(x)
        _, s, vt = np.linalg.svd(centred(x, n, sums), full_matrices=False)
        return cls(n, sums, s, vt)

    def merged(self, other: Summary) -> Summary:
        """Both together: a row for the shift of the means makes up for centring each on its own."""
        n, m = self.n, other.n
        # the difference of the means, exact up to its one division
        shift = np.array([(p * m - q * n) / (n * m) for p, q in zip(self.sums, other.sums, strict=True)])
        rows = np.concatenate([self.s[:, None] * self.vt, other.s[:, None] * other.vt, math.sqrt(n / (n + m) * m) * shift[None, :]])
        _, s, vt = np.linalg.svd(rows, full_matrices=False)
        return Summary(n + m, [p + q for p, q in zip(self.sums, other.sums, strict=True)], s, vt)


def _exact_sums(x: np.ndarray) -> list[int]:
    """Column sums as Python integers; high and low halves are summed apart, so that none overflows."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return [(int(h) << 32) + int(s) for h, s in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n in double precision: the whole part of the mean is taken off as an integer."""
    whole = [s // n for s in sums]
    rest = np.array([(s - w * n) / n for s, w in zip(sums, whole, strict=True)])
    return (x - np.array(whole, np.int64)).astype(np.float64) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n x - sums)^2 of each row, exactly; None if a long can't hold it."""
    most = float(np.abs(centred(x, n, sums)).max(initial=0)) * n
    if most * most * x.shape[1] < 9e18 and max(map(abs, sums), default=0) < 1 << 62 and float(np.abs(x.astype(np.float64)).max(initial=0)) * n < 4e18:
        d = x * n - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def _rows(batches):
    """(dims, integer rows) of each batch of (x array<bigint>), by length."""
    for batch in batches:
        x = batch.column(0)
        dims = np.diff(x.offsets.to_numpy())
        flat = x.flatten().to_numpy()
        begin = np.cumsum(dims) - dims
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            yield d, at, flat[begin[at][:, None] + np.arange(d)]


def summaries(distinct: DataFrame) -> DataFrame:
    """One summary for each partition and length of the rows (x)."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        held: dict[int, Summary] = {}
        waiting: dict[int, list[np.ndarray]] = {}

        def settle(d: int) -> None:
            new = Summary.of(np.concatenate(waiting.pop(d)))
            held[d] = held[d].merged(new) if d in held else new

        for d, _, x in _rows(batches):
            waiting.setdefault(d, []).append(x)
            if sum(map(len, waiting[d])) >= ROWS:
                settle(d)
        for d in list(waiting):
            settle(d)
        for d, s in held.items():
            yield pa.RecordBatch.from_pylist([_packed(d, TaskContext.get().partitionId(), s)], schema=_arrow())

    return distinct.select("x").transform(batchwise(run, _SUMMARY))


def _arrow():
    import pyarrow as pa

    return pa.schema([("dims", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("s", pa.list_(pa.float64())), ("vt", pa.list_(pa.float64()))])


def _packed(dims: int, at: int, s: Summary) -> dict:
    return {"dims": dims, "at": at, "n": s.n, "sums": s.sums, "s": s.s.tolist(), "vt": s.vt.ravel().tolist()}


def _unpacked(row) -> Summary:
    s = np.asarray(row["s"], float)
    return Summary(int(row["n"]), [int(x) for x in row["sums"]], s, np.asarray(row["vt"], float).reshape(len(s), -1))


def merged(found: DataFrame) -> DataFrame:
    """Summaries merged in groups of FAN, level by level, until each length has one."""

    def run(table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["at"])
        total = _unpacked(rows[0])
        for r in rows[1:]:
            total = total.merged(_unpacked(r))
        return pa.Table.from_pylist([_packed(rows[0]["dims"], rows[0]["at"] // FAN, total)], schema=_arrow())

    most = found.agg(F.max("at")).first()[0] or 0
    while most > 0:
        found = checkpointed(found.groupBy("dims", F.expr(f"at div {FAN}")).applyInArrow(run, _SUMMARY))
        most //= FAN
    return found


class Whitening:
    """Components of one length by falling eigenvalue: n, exact sums, eigenvalues, unit rows and their share of the trace.

    Components without variance (up to rounding) can't be scaled to one and are left out.
    """

    def __init__(self, summary: Summary, most: int):
        s = summary.s
        fine = s > (s[0] if len(s) else 0) * max(len(s), 2) * np.finfo(float).eps
        keep = np.flatnonzero(fine)[:most]
        self.n, self.sums = summary.n, summary.sums
        self.values = s[keep] ** 2 / summary.n
        self.rows = summary.vt[keep]
        self.explained = s[keep] ** 2 / max(float((s**2).sum()), np.finfo(float).tiny)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.rows.T / np.sqrt(self.values)


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """By vector length; what reaches the driver is one summary for each, of as many numbers as its dimensions squared."""
    rows = merged(checkpointed(summaries(distinct))).collect()
    return {r["dims"]: Whitening(_unpacked(r), components) for r in rows}


def identity_errors(distinct: DataFrame, model: dict[int, Whitening]) -> dict[int, float]:
    """The largest absolute entry of the whitened rows' covariance minus the identity, by length.

    Each partition has its rows' count, sums and centred products; these merge like the summaries do.
    """
    schema = "dims int, at bigint, n bigint, total array<double>, products array<double>"

    def packed(d, at, n, total, products):
        return {"dims": d, "at": at, "n": n, "total": total.tolist(), "products": products.ravel().tolist()}

    def arrow():
        import pyarrow as pa

        return pa.schema([("dims", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("total", pa.list_(pa.float64())), ("products", pa.list_(pa.float64()))])

    def joined(a, b):
        (n, p, x), (m, q, y) = a, b
        shift = p / n - q / m
        return n + m, p + q, x + y + np.outer(shift, shift) * (n / (n + m) * m)

    held = distinct.sparkSession.sparkContext.broadcast(model)  # COMPONENTS rows for each length

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        sums: dict[int, tuple] = {}
        for d, _, x in _rows(batches):
            w = held.value[d].apply(x)
            mean = w.mean(axis=0)
            new = (len(w), w.sum(axis=0), (w - mean).T @ (w - mean))
            sums[d] = joined(sums[d], new) if d in sums else new
        for d, v in sums.items():
            yield pa.RecordBatch.from_pylist([packed(d, TaskContext.get().partitionId(), *v)], schema=arrow())

    def together(table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["at"])
        each = [(r["n"], np.array(r["total"], float), np.array(r["products"], float).reshape(len(r["total"]), -1)) for r in rows]
        total = each[0]
        for e in each[1:]:
            total = joined(total, e)
        return pa.Table.from_pylist([packed(rows[0]["dims"], rows[0]["at"] // FAN, *total)], schema=arrow())

    found = checkpointed(distinct.select("x").transform(batchwise(run, schema)))
    most = found.agg(F.max("at")).first()[0] or 0
    while most > 0:
        found = checkpointed(found.groupBy("dims", F.expr(f"at div {FAN}")).applyInArrow(together, schema))
        most //= FAN
    out = {}
    for r in found.collect():
        k = len(r["total"])
        out[r["dims"]] = float(np.abs(np.array(r["products"]).reshape(k, k) / r["n"] - np.eye(k)).max(initial=0))
    return out


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows (key, component, n, deviation, whitened, explained, identity_error), one for each usable row and component.

    Vectors that are null or empty, or hold null or non-finite entries, take no part. The fit takes each
    distinct integer vector once, so repeated rows don't weigh more; each still has its own rows here.
    n: distinct vectors; deviation is null where a long can't hold it. Components without variance are
    left out, so a table of one vector, like an empty one, gives no rows. Keys may be null or repeat.
    Vectors of different lengths are whitened apart. Other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    rows = df.select(integers(F.col(vector)).alias("x"), F.col(key).alias("k")).where("x IS NOT NULL")
    path = shared_dir(spark, "whitening")
    rows.select("x").distinct().write.parquet(path)
    distinct = spark.read.parquet(path)
    model = fit(distinct, components)
    errors = identity_errors(distinct, model)
    held = spark.sparkContext.broadcast((model, errors))  # COMPONENTS rows for each length

    def run(batches):
        import pyarrow as pa

        model, errors = held.value
        for batch in batches:
            for d, at, x in _rows([batch]):
                m = model[d]
                c, n = len(m.values), len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).take(pa.array(np.repeat(at, c))),
                        pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), n)),
                        pa.array(np.full(n * c, m.n, np.int64)),
                        pa.array(deviations(x, m.n, m.sums), pa.int64()).take(pa.array(np.repeat(np.arange(n), c))),
                        pa.array(m.apply(x).ravel()),
                        pa.array(np.tile(m.explained, n)),
                        pa.array(np.full(n * c, errors.get(d, 0.0))),
                    ],
                    names=["k", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = df.schema[key].dataType.simpleString()
    out = spread(rows).transform(batchwise(run, f"k {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"))
    return out.withColumnRenamed("k", key)
