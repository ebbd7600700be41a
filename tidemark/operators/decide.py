"""Decisions, gates and cascades over ranked candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DecisionConfig


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def with_runner_up(ranked: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("rank")
    return ranked.withColumns({"runner_up": F.lead("track_id").over(w), "runner_up_score": F.coalesce(F.lead("score").over(w), F.lit(0).cast("long"))})


def accepted(evidence: Column, aligned: Column, threshold, min_aligned) -> Column:
    """Both bounds are inclusive; false without evidence."""
    return F.coalesce((evidence >= threshold) & (aligned >= min_aligned), F.lit(False))


def decide(headers: DataFrame, ranked: DataFrame, cfg: DecisionConfig = DecisionConfig()) -> DataFrame:
    """One row for each query of headers (query_id, query_landmarks), matched or not.

    NO_MATCH keeps evidence and aligned, and withholds the rest (track null, concentration and margin 0).
    """
    cfg.validate()
    top = with_runner_up(ranked).where(F.col("rank") == 1)
    rows = headers.join(top, "query_id", "left")
    evidence, aligned = ratio(F.coalesce("score", F.lit(0)), F.col("query_landmarks")), F.coalesce("score", F.lit(0)).cast("long")
    ok = accepted(evidence, aligned, cfg.threshold, cfg.min_aligned)
    return rows.select(
        "query_id",
        F.when(ok, "MATCH").otherwise("NO_MATCH").alias("decision"),
        F.when(ok, F.col("track_id")).alias("track_id"),
        evidence.alias("evidence"),
        aligned.alias("aligned"),
        F.when(ok, F.col("best_offset")).cast("long").alias("best_offset"),
        F.when(ok, ratio(F.col("score"), F.col("matched_query_landmarks"))).otherwise(0.0).alias("concentration"),
        F.when(ok, F.col("runner_up")).alias("runner_up"),
        F.when(ok, F.col("runner_up_score")).otherwise(0).cast("long").alias("runner_up_score"),
        F.when(ok, F.col("score") - F.col("runner_up_score")).otherwise(0).cast("long").alias("margin"),
    )


def best_hypothesis(rows: DataFrame) -> DataFrame:
    """Of each query's hypotheses the one with most evidence, then the smallest absolute rate, then the smallest rate."""
    key = F.struct((-F.col("evidence")).alias("e"), F.abs("rate").alias("a"), F.col("rate").alias("r"))
    cols = [c for c in rows.columns if c != "query_id"]
    return rows.groupBy("query_id").agg(F.min_by(F.struct(*cols), key).alias("best")).select("query_id", "best.*")
