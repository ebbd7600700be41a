"""Mixing sources to target weights, with DataFrame functions only.

Efraimidis-Spirakis sampling: a document's key is -ln(u)/w, u uniform by a hash of its id and w its
quality weight, so that heavier documents tend to come first. Within a source, documents are sorted
by key and their sizes summed up to the budget. Complete epochs come before the fractional
selection. The sums run in two levels (cells of keys within a source, rows within a cell), so that
no source is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

WORD = r"[^\x20\x09-\x0D]+"
#: No document is taken more often than this.
MAX_EPOCHS = 3
#: Documents that a cell of a source's keys holds on average.
CELL_ROWS = 4096
#: Bounds of quality weights; they bound how unevenly cells fill.
WEIGHTS = (0.5, 2.0)


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id and weight: 2 if the mean quality label is over a half, 0.5 if below, else 1."""
    q = F.avg("quality")
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.when(q > 0.5, 2.0).when(q < 0.5, 0.5).otherwise(1.0).alias("weight"))


def uniform(key: Column) -> Column:
    """In (0, 1), from the first 52 bits of the md5 of the key as text."""
    bits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame) -> DataFrame:
    """From (source, source_size, docs): target of each source.

    Sources by code point, null last, weigh 1, 2, 3, repeating; targets share all sizes by weight,
    stop at MAX_EPOCHS times a source's size, and the excess is reshared by weight. Sources are
    few: one row for each.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rows = sizes.withColumn("w", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * float(MAX_EPOCHS))
    # Filling up by rising cap per weight: a source is capped if its share of what is left exceeds its cap.
    rise = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    rows = (
        rows.withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
        .withColumn("caps", F.coalesce(F.sum("cap").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("ws", F.sum("w").over(rise.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("caps")) / F.col("ws"))
    )
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(Window.partitionBy())
    return rows.withColumn("at", level["level"]).select("source", "source_size", "docs", F.coalesce(F.least(F.col("cap"), F.col("at") * F.col("w")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights: DataFrame | None = None, key: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, size, source, source_size, target, taken, keep...), one for each row of docs.

    size: words of the text (null: 0). taken: words the mix takes, repeats counted: the whole epochs
    of its source's target times its size, plus its part of the last, incomplete epoch. The document
    at which a budget ends is cut there, so each source takes the whole part of its target.
    weights: optional (doc_id, weight), clipped to WEIGHTS; missing ones are 1. Rows of equal keys
    and equal size in a source share their order and are summed by row; null keys are equal here, and null
    sources are one source, the last. A null or empty text has size 0 and is not taken; a very long one counts
    whole. An empty table gives no rows. Other columns than those in `keep` are ignored.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)))
    kept = [f"c{i}" for i in range(len(keep))]
    if weights is not None:
        rows = rows.join(weights.select(F.col("doc_id").alias("k"), "weight"), "k", "left")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    weight = F.greatest(F.lit(WEIGHTS[0]), F.least(F.lit(WEIGHTS[1]), F.coalesce("weight", F.lit(1.0))))
    # a few numbers for each document are written once, so that texts are read once
    rows = stored(rows.select("k", "source", "size", *kept, (-F.log(uniform(F.col("k"))) / weight).alias("at")), "mix-sizes")
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")))
    same = lambda a, b: a.eqNullSafe(b)
    # a row for each source; its files say whether it may be broadcast, so that no source becomes one task
    plan = small(stored(plan.withColumnRenamed("source", "s"), "mix-plan"))
    rows = rows.join(plan, same(F.col("source"), F.col("s"))).drop("s")
    # Keys grow with the cell, and cells fill alike but for the bounded spread of the weights.
    cells = F.greatest(F.lit(1.0), F.ceil(F.col("docs") / CELL_ROWS))
    rows = rows.withColumn("cell", F.floor((1 - F.exp(-F.col("at") * WEIGHTS[0])) * cells))
    per_cell = rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    offsets = per_cell.select(
        F.col("source").alias("s"), F.col("cell").alias("c"), (F.sum("cell_size").over(Window.partitionBy("source").orderBy("cell")) - F.col("cell_size")).alias("offset")
    )
    rows = rows.join(offsets, same(F.col("source"), F.col("s")) & (F.col("cell") == F.col("c"))).drop("s", "c")
    inside = Window.partitionBy("source", "cell").orderBy("at", F.col("k"), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("offset") + F.sum("size").over(inside) - F.col("size")
    # Whole epochs, at most MAX_EPOCHS; what is left of the target is below one epoch.
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(MAX_EPOCHS), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    budget = F.when(epochs < MAX_EPOCHS, F.floor(F.col("target")).cast("long") - epochs * F.col("source_size")).otherwise(0)
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), budget - before))
    return rows.select(F.col("k").alias(key), "size", "source", "source_size", "target", (epochs * F.col("size") + part).alias("taken"), *(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)))


#: DuckDB's view of the same mix over documents and labels.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents
), q AS (
  SELECT doc_id, CASE WHEN avg(quality) > 0.5 THEN 2.0 WHEN avg(quality) < 0.5 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), r AS (
  SELECT d.*, -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / coalesce(q.weight, 1.0) AS at
  FROM d LEFT JOIN q ON d.doc_id = q.doc_id
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s0
), s2 AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS caps,
    sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM s1
), s3 AS (
  SELECT *, (total - caps) / ws AS level FROM s2
), s4 AS (
  SELECT source, source_size, least(cap, w * (SELECT arg_min(level, cap / w) FROM s3 WHERE level * w <= cap)) AS target FROM s3
), t AS (
  SELECT r.doc_id, r.size, s4.source_size, s4.target, CASE WHEN s4.source_size > 0 THEN least(3, floor(s4.target / s4.source_size)) ELSE 0 END::BIGINT AS epochs,
    sum(r.size) OVER (PARTITION BY r.source ORDER BY r.at, r.doc_id, r.size ROWS UNBOUNDED PRECEDING) - r.size AS before
  FROM r JOIN s4 ON r.source IS NOT DISTINCT FROM s4.source
)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, CASE WHEN epochs < 3 THEN floor(target)::BIGINT - epochs * source_size ELSE 0 END - before)))::BIGINT AS taken
FROM t
"""
