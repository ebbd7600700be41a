"""Hypotheses about an excerpt's playback rate: its landmarks are paired anew, as keys of that rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import MatchConfig
from tidemark.operators import decide as dec
from tidemark.operators import landmarks as lm
from tidemark.operators import match as mt
from tidemark.session import fits, small


def factor(rate: Column) -> Column:
    """How much faster a rate in percent plays; not positive where it can't be played."""
    return 1 + rate / 100


def rate_error(rate: Column) -> Column:
    return F.when(factor(rate) <= 0, F.format_string("rate %s%% is not a playable speed", rate.cast("string")))


def rated_keys(queries: DataFrame, scale_bins: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, rate, qidx, hash, q_frame, keep..) of query landmarks (query_id, rate, qidx, hash, anchor_frame) played at their rate in percent.

    Frames shrink by the rate's factor. A landmark's frame difference falls between two whole numbers then, so it
    probes both keys; those outside 1 to the key's largest difference are none. Rates that can't be played
    have no keys. With `scale_bins` (bins are frequencies) both bins grow by the factor, to the nearest bin.
    """
    f1, f2, dt = lm.unpack_key(F.col("hash"))
    by = factor(F.col("rate"))
    bin_ = (lambda f: F.floor(f * by + 0.5)) if scale_bins else (lambda f: f)
    scaled = dt / by
    near = F.array_distinct(F.array(F.floor(scaled), F.ceil(scaled)))
    keys = F.transform(F.filter(near, lambda d: d >= 1), lambda d: lm.pack_key(bin_(f1), bin_(f2), d))
    rows = queries.where(by > 0).select("query_id", "rate", "qidx", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("hash"), F.floor(F.col("anchor_frame") / by).cast("long").alias("q_frame"), *keep)
    return rows


def rated_hits(keys: DataFrame, landmarks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, rate, track_id, qidx, offset, keep..); both keys of a landmark keep its qidx, so it counts once in a window."""
    few = fits(keys, mt.LANDMARK_FACTOR)
    found = landmarks.join(F.broadcast(keys) if few else keys, "hash")
    return found.select("query_id", "rate", "track_id", "qidx", (F.col("anchor_frame") - F.col("q_frame")).alias("offset"), *keep)


def hypotheses(queries: DataFrame, landmarks: DataFrame, rates: tuple[float, ...], scale_bins: bool = False) -> DataFrame:
    """One row for each query and rate: (query_id, rate, track_id, score, query_landmarks, evidence, best_offset, error).

    queries are landmarks (query_id, qidx, hash, anchor_frame). The first candidate at the rate, its score over the
    landmarks that have a key there; track null and 0 where nothing is met. A rate that can't be played says so
    in `error` and sinks no other.
    """
    asked = at_rates(queries, rates)
    keys = rated_keys(asked, scale_bins)
    return judged(asked, keys, *dealt_hits(keys, landmarks))


def dealt_hits(keys: DataFrame, landmarks: DataFrame) -> tuple[DataFrame, bool]:
    """Hits of keys, and whether they lie as the landmarks do: then ranks needn't move those that are dealt by track."""
    return rated_hits(keys, landmarks), fits(keys, mt.LANDMARK_FACTOR)


def at_rates(queries: DataFrame, rates: tuple[float, ...]) -> DataFrame:
    return queries.withColumn("rate", F.explode(F.array(*(F.lit(float(r)) for r in rates))))


def judged(asked: DataFrame, keys: DataFrame, hits: DataFrame, dealt: bool = False) -> DataFrame:
    """What hypotheses gives, from the asked landmarks by rate, their keys, and the keys' hits."""
    heads = asked.select("query_id", "rate").distinct()
    sizes = keys.groupBy("query_id", "rate").agg(F.countDistinct("qidx").alias("query_landmarks"))
    tops = mt.rank(hits, MatchConfig(max_candidates=1), ("query_id", "rate"), dealt).select("query_id", "rate", "track_id", "score", "best_offset")
    rows = heads.join(sizes, ["query_id", "rate"], "left").join(tops, ["query_id", "rate"], "left").fillna(0, ["score", "query_landmarks"])
    return rows.select("query_id", "rate", "track_id", F.col("score").cast("long").alias("score"), F.col("query_landmarks").cast("long").alias("query_landmarks"), dec.ratio(F.col("score"), F.col("query_landmarks")).alias("evidence"), F.col("best_offset").cast("long").alias("best_offset"), rate_error(F.col("rate")).alias("error"))


def at_rate(queries: DataFrame, landmarks: DataFrame, chosen: DataFrame, scale_bins: bool = False) -> DataFrame:
    """(query_id, track_id, score, query_landmarks, best_offset) of each query's first candidate at its one rate; chosen is (query_id, rate)."""
    keys = rated_keys(queries.join(small(chosen.select("query_id", "rate")), "query_id"), scale_bins)
    sizes = keys.groupBy("query_id").agg(F.countDistinct("qidx").alias("query_landmarks"))
    top = mt.rank(rated_hits(keys, landmarks), MatchConfig(max_candidates=1))
    return top.join(sizes, "query_id").select("query_id", "track_id", "score", "query_landmarks", "best_offset")
