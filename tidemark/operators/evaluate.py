"""Evaluation algebra: summaries, confusion, sweeps, splits, comparisons, tempo and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.index import ordinals
from tidemark.session import running


def n_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


def share(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def summarize(outcomes: DataFrame, *by: str) -> DataFrame:
    """Of (is_negative, error, latency_ms, returned_ids, truth): counts, latency, recall at 1 and 3, false accepts.

    Rows with an error leave every denominator. Positive figures are null without positives, and
    negative ones without negatives; a denominator of errors alone counts as 1.
    """
    ok, neg = F.col("error").isNull(), F.col("is_negative")
    at = F.array_position("returned_ids", F.col("truth"))
    some = F.size("returned_ids") > 0
    rows = outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("queries"),
        n_if(~ok).alias("errors"),
        F.percentile(F.when(ok, F.col("latency_ms")), 0.5).alias("p50"),
        F.percentile(F.when(ok, F.col("latency_ms")), 0.95).alias("p95"),
        n_if(~neg).alias("_p"), n_if(neg).alias("_n"), F.greatest(n_if(~neg & ok), F.lit(1)).alias("_pok"), F.greatest(n_if(neg & ok), F.lit(1)).alias("_nok"),
        n_if(~neg & ok & (at == 1)).alias("_r1"), n_if(~neg & ok & at.between(1, 3)).alias("_r3"), n_if(~neg & ok & ~some).alias("_none"), n_if(neg & ok & some).alias("_fa"),
    )
    pos = lambda c: F.when(F.col("_p") > 0, share(F.col(c), F.col("_pok")))
    return rows.select(
        *by, "queries", "errors", "p50", "p95", pos("_r1").alias("recall_at_1"), pos("_r3").alias("recall_at_3"), pos("_none").alias("no_match_rate"),
        F.when(F.col("_n") > 0, share(F.col("_fa"), F.col("_nok"))).alias("far"), F.when(F.col("_n") > 0, F.col("_fa")).alias("false_accepts"),
    )


def sweep(rows: DataFrame) -> DataFrame:
    """Of (score, is_negative, right, eligible): at each distinct score as threshold (accept is >=), tp, wrong, fp, recall, far.

    Scores are aggregated first, so the running sums are over distinct scores; ineligible rows keep
    their score as a point but never count as accepted.
    """
    ok = F.col("eligible")
    per = rows.groupBy("score").agg(n_if(ok & ~F.col("is_negative") & F.col("right")).alias("a"), n_if(ok & ~F.col("is_negative") & ~F.col("right")).alias("b"), n_if(ok & F.col("is_negative")).alias("c"))
    totals = rows.agg(n_if(~F.col("is_negative")).alias("positives"), n_if(F.col("is_negative")).alias("negatives"))
    sums = running(per, [F.desc("score")], {"tp": F.col("a"), "wrong": F.col("b"), "fp": F.col("c")})
    out = sums.select("score", "tp", "wrong", "fp").crossJoin(F.broadcast(totals))
    return out.select("score", "tp", "wrong", "fp", share(F.col("tp"), F.col("positives")).alias("recall"), share(F.col("fp"), F.col("negatives")).alias("far"))


def pick_threshold(swept: DataFrame, max_far: float, fallback: bool = False) -> DataFrame:
    """The point of most recall whose far is at most max_far (the least threshold of several); no row if there is none.

    With `fallback` there always is one: else the point of most recall without any false accept (the least
    threshold of several), else the one of the greatest threshold.
    """
    within, none = F.coalesce("far", F.lit(0.0)) <= max_far, F.coalesce(F.col("far") == 0, F.lit(False))
    if not fallback:
        return swept.where(within).orderBy(F.desc("recall"), "score").limit(1)
    rung = F.when(within, 0).when(none, 1).otherwise(2)
    return swept.withColumn("rung", rung).orderBy("rung", F.when(F.col("rung") < 2, -F.col("recall")), F.when(F.col("rung") < 2, F.col("score")).otherwise(-F.col("score"))).limit(1).drop("rung")


def best_recalls(swept: DataFrame, fars: list[float]) -> DataFrame:
    """(max_far, recall, threshold): pick_threshold at several limits in one pass."""
    spark = swept.sparkSession
    limits = F.broadcast(spark.createDataFrame([(f,) for f in fars], "max_far double"))
    met = swept.join(limits, F.coalesce("far", F.lit(0.0)) <= F.col("max_far"))
    return met.groupBy("max_far").agg(F.max(F.struct("recall", (-F.col("score")).alias("s"))).alias("b")).select("max_far", F.col("b.recall").alias("recall"), (-F.col("b.s")).alias("threshold"))


def compare(a: DataFrame, b: DataFrame, on: str, value: str, band: float = 0.005) -> DataFrame:
    """Inner join of two result tables; delta and whether it is better, worse or the same within the band."""
    both = a.select(on, F.col(value).alias("before")).join(b.select(on, F.col(value).alias("after")), on)
    delta = F.col("after") - F.col("before")
    return both.select(on, "before", "after", delta.alias("delta"), F.when(delta > band, "better").when(delta < -band, "worse").otherwise("same").alias("verdict"))


def interleave(df: DataFrame, key: str) -> DataFrame:
    """Even places of the sorted keys to 'tune', odd ones to 'hold'; places come from per-range counts, not one sorted task."""
    places = ordinals(df, key)
    return places.select(F.col("track_id").alias(key), F.when(F.col("track_ord") % 2 == 0, "tune").otherwise("hold").alias("split"))


def hash_split(key: Column) -> Column:
    """By the parity of the first two bytes of the sha256: needs no order and no shuffle."""
    return F.when(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 4), 16, 10).cast("long") % 2 == 0, "tune").otherwise("hold")


def last_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """Marks the rows of the n greatest keys: each part of the table keeps n of its own before they meet."""
    last = df.select(F.col(key).alias("_last")).distinct().orderBy(F.desc("_last")).limit(n)
    return df.join(F.broadcast(last), F.col(key) == F.col("_last"), "left").withColumn("held_out", F.col("_last").isNotNull()).drop("_last")


def stride_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows at even strides of the sorted keys: places floor(i * len / n). Places come from per-range counts, not one sorted task."""
    size = df.select(key).distinct().count()
    spark = df.sparkSession
    places = F.broadcast(spark.createDataFrame([(i * size // n,) for i in range(n)], "track_ord int").distinct())
    return ordinals(df, key).join(places, "track_ord").select(F.col("track_id").alias(key), F.col("track_ord").cast("long").alias("place"))


def bpm_metrics(rows: DataFrame, *by: str, tolerance: float = 0.02) -> DataFrame:
    """Of (truth, predicted, excluded): raw and octave-tolerant hits kept apart, double and half errors, failures, exclusions.

    A null truth or an exclusion is not scored; a null prediction is a failure and stays in the
    denominator.
    """
    scored = ~F.col("excluded") & F.col("truth").isNotNull()
    near = lambda f: F.abs(F.col("predicted") - F.col("truth") * f) / (F.col("truth") * f) <= tolerance
    usable, raw = scored & F.col("predicted").isNotNull(), near(1.0)
    octave = near(0.5) | near(1.0) | near(2.0)
    out = rows.groupBy(*by).agg(
        n_if(usable).alias("evaluable"), n_if(scored & F.col("predicted").isNull()).alias("failed"), n_if(~scored).alias("excluded_rows"),
        n_if(usable & raw).alias("raw_hits"), n_if(usable & octave).alias("octave_hits"), n_if(usable & ~octave & (near(1 / 3) | near(3.0))).alias("triple_only"),
        n_if(usable & ~raw & near(2.0)).alias("double_errors"), n_if(usable & ~raw & ~near(2.0) & near(0.5)).alias("half_errors"),
    )
    d = F.col("evaluable") + F.col("failed")
    return out.withColumns({"raw_accuracy": share(F.col("raw_hits"), d), "octave_accuracy": share(F.col("octave_hits"), d)})
