"""Exact percentiles of groups of any size: a sketch brackets each rank, and only the bracket's values are ordered.

A group's values are never in one task. Each pass counts, combined on the map side, what lies below and within each
wanted rank's bracket, and sketches the bracket's values; the rank falls between two neighbouring points of the sketch,
which make the next bracket. Once brackets hold few rows, or one value, their values are counted by value and the
ranks are read off running counts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import small, stored

#: Rows of a bracket that may be ordered in one task; points of a sketch.
BRACKET_ROWS, POINTS = 100_000, 200


def percentiles(rows: DataFrame, by: list[str], value: str, wanted: list[float]) -> DataFrame:
    """(by, p, value, n) for each group and wanted fraction: what percentile() gives, n values counted.

    Nulls don't count; a group without other values has none. Groups of null keys are groups. NaN is the largest
    value. by may be empty: then the table is one group.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    data = rows.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    n = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    p = F.explode(F.array(*(F.lit(float(x)) for x in wanted))).alias("p")
    at = F.col("p") * (F.col("n") - 1)
    targets = stored(n.select(*keys, "n", p).withColumns({"r0": F.floor(at), "r1": F.ceil(at), "lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"), "below": F.lit(0).cast("long"), "inside": F.col("n")}), "ranks")
    grid = [i / POINTS for i in range(POINTS + 1)]
    while (targets.agg(F.max(F.when(~F.coalesce(F.col("lo") == F.col("hi"), F.lit(False)), F.col("inside")))).first()[0] or 0) > BRACKET_ROWS:
        size = targets.agg(F.sum("inside")).first()[0]
        v = _within(data, targets, keys).groupBy(*keys, "p").agg(F.percentile_approx("v", grid, 50 * POINTS).alias("q"))
        spot = lambda r, step: F.greatest(F.lit(1), F.least(F.lit(POINTS + 1), (step((F.col(r) - F.col("below")) * POINTS / F.greatest(F.lit(1), F.col("inside") - 1))).cast("int") + 1))
        # a point to either side covers the sketch's error
        left, right = F.greatest(F.lit(1), spot("r0", F.floor) - 1), F.least(F.lit(POINTS + 1), spot("r1", F.ceil) + 1)
        t = _joined(targets, v, [*keys, "p"])
        t = t.withColumns({"lo": F.when(left == 1, F.col("lo")).otherwise(F.element_at("q", left)), "hi": F.when(right == POINTS + 1, F.col("hi")).otherwise(F.element_at("q", right))}).drop("q", "below", "inside")
        held = _counted(data, t, keys)
        t = stored(_joined(t, held, [*keys, "p"]).select(*targets.columns), "ranks")
        lost = t.where((F.col("r0") < F.col("below")) | (F.col("r1") >= F.col("below") + F.col("inside"))).limit(1).count()
        if lost or t.agg(F.sum("inside")).first()[0] >= size:  # a bracket that missed its rank, or none that shrank: few different values, or all of them
            targets = targets if lost else t
            break
        targets = t
    counts = _within(data, targets, keys).groupBy(*keys, "p", "v").agg(F.count(F.lit(1)).alias("c"))
    seen = F.sum("c").over(Window.partitionBy(*keys, "p").orderBy("v"))
    counts = _joined(counts.withColumn("seen", seen), targets, [*keys, "p"])
    first = lambda r: F.min(F.when(F.col("seen") + F.col("below") > F.col(r), F.struct("v"))).alias(r + "v")
    out = counts.groupBy(*keys, "p").agg(first("r0"), first("r1"), F.first("r0").alias("r0"), F.first("r1").alias("r1"), F.first("n").alias("n"))
    at = F.col("p") * (F.col("n") - 1)
    low, high = F.col("r0v.v"), F.col("r1v.v")
    result = F.when((F.col("r0") == F.col("r1")) | (low == high), low).otherwise((F.col("r1") - at) * low + (at - F.col("r0")) * high)
    return out.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), "p", result.alias("value"), "n")


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join where null keys are equal; the right side is broadcast if its files are small."""
    other = small(right.select(*(F.col(c).alias(f"_r{c}") for c in on), *(c for c in right.columns if c not in on)))
    both = None
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"_r{c}"))
        both = same if both is None else both & same
    return left.join(other, both).drop(*(f"_r{c}" for c in on))


def _beside(data: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Each value with each wanted bracket of its group."""
    t = small(targets.select(*(F.col(k).alias(f"_t{k}") for k in keys), "p", "lo", "hi"))
    if not keys:
        return data.join(F.broadcast(t), F.lit(True))  # a row for each wanted fraction
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_t{k}"))
        same = one if same is None else same & one
    return data.join(t, same)


def _from_low():
    return F.col("lo").isNull() | (F.col("v") >= F.col("lo"))


def _to_high():
    return F.col("hi").isNull() | (F.col("v") <= F.col("hi"))


def _within(data: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    return _beside(data, targets, keys).where(_from_low() & _to_high()).select(*keys, "p", "v")


def _counted(data: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, below, inside) of each bracket."""
    rows = _beside(data, targets, keys).where(_to_high())
    return rows.groupBy(*keys, "p").agg(F.count_if(~_from_low()).alias("below"), F.count_if(_from_low()).alias("inside"))


def wide(found: DataFrame, by: list[str], names: dict[float, str]) -> DataFrame:
    """One row for each group with a column for each fraction."""
    picked = [F.max(F.when(F.col("p") == p, F.struct("value")))["value"].alias(name) for p, name in names.items()]
    return found.groupBy(*by).agg(*picked, F.max("n").alias("n"))


def passes(rows: int) -> int:
    """How often a group of so many different values is read at most, before its brackets are ordered."""
    return max(0, math.ceil(math.log(max(rows / BRACKET_ROWS, 1), POINTS / 4)))
