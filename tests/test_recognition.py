"""Hand-built landmarks, seeded brute force and boundaries of the recognition operators."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import DecisionConfig, LandmarkConfig, MatchConfig
from tidemark.operators import decide as dec
from tidemark.operators import index as ix
from tidemark.operators import landmarks as lm
from tidemark.operators import match as mt

HITS = "query_id string, track_id string, qidx int, offset int"


def brute_window(hits, tol):
    """(score, count, best_offset) of (offset, qidx) pairs by trying every window end."""
    best = None
    for v in sorted({o for o, _ in hits}):
        inside = [(o, q) for o, q in hits if v - tol <= o <= v]
        key = (len({q for _, q in inside}), len(inside), -v)
        if best is None or key > best[0]:
            best = (key, inside)
    offsets = [o for o, _ in best[1]]
    modal = min(set(offsets), key=lambda o: (-offsets.count(o), o))
    return best[0][0], best[0][1], modal


@pytest.mark.parametrize("tol", [0, 1, 2, 5])
def test_densest_window_against_brute_force(spark, tol):
    rng = random.Random(tol)
    cases = {f"q{i}": [(rng.randrange(-50, 50), rng.randrange(12)) for _ in range(rng.randrange(1, 60))] for i in range(60)}
    df = spark.createDataFrame([(q, "t", i, o) for q, hs in cases.items() for o, i in hs], HITS)
    got = {r.query_id: (r.score, r.best_offset_count, r.best_offset) for r in mt.densest(df, MatchConfig(tolerance=tol)).collect()}
    assert got == {q: brute_window(hs, tol) for q, hs in cases.items()}


def test_ties_take_the_earliest_window(spark):
    df = spark.createDataFrame([("a", "t", i, o) for i, o in enumerate([10, 10, 20, 20])] + [("b", "t", i, o) for i, o in enumerate([0, 1, 100, 101])], HITS)
    got = {r.query_id: (r.best_offset, r.lo, r.hi) for r in mt.densest(df, MatchConfig(tolerance=2)).collect()}
    assert got == {"a": (10, 10, 10), "b": (0, 0, 1)}


def test_pack_and_unpack(spark):
    rows = spark.createDataFrame([(0, 0, 0), (1023, 1023, 255), (1024, 0, 1), (5, 6, 256), (17, 900, 128)], "a int, b int, d int")
    key = lm.pack_key(F.col("a"), F.col("b"), F.col("d"))
    f1, f2, dt = lm.unpack_key(F.col("k"))
    got = rows.withColumn("k", key).select("a", "b", "d", "k", f1.alias("x"), f2.alias("y"), dt.alias("z")).collect()
    for r in got:
        fits = r.a <= 1023 and r.b <= 1023 and r.d <= 255
        assert (r.k is not None) == fits
        if fits:
            assert (r.x, r.y, r.z) == (r.a, r.b, r.d) and r.k == r.a << 18 | r.b << 8 | r.d


def test_density_caps_are_the_greedy_choice(spark):
    rng = random.Random(3)
    peaks = list({(rng.randrange(40), rng.randrange(30)): None for _ in range(400)})
    rows = [("t", f, b, float(rng.randrange(50))) for f, b in peaks]
    cfg = LandmarkConfig(peaks_per_frame=3, bucket_frames=8, peaks_per_bucket=10)
    kept, frames, buckets = set(), {}, {}
    for _, f, b, _m in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if frames.get(f, 0) < 3 and buckets.get(f // 8, 0) < 10:
            kept.add((f, b))
            frames[f] = frames.get(f, 0) + 1
            buckets[f // 8] = buckets.get(f // 8, 0) + 1
    got = {(r.frame, r.freq_bin) for r in lm.density_caps(spark.createDataFrame(rows, "track_id string, frame int, freq_bin int, mag double"), cfg).collect()}
    assert got == kept


def test_pairing_against_brute_force(spark):
    rng = random.Random(4)
    peaks = sorted({(rng.randrange(300), rng.randrange(50)) for _ in range(120)})
    want = []
    for f, b in peaks:
        later = [(g, c) for g, c in peaks if 1 <= g - f <= 128][:5]
        want += [(b << 18 | c << 8 | (g - f), f) for g, c in later]
    got = lm.pair_peaks(spark.createDataFrame([("t", f, b) for f, b in peaks], "track_id string, frame int, freq_bin int")).collect()
    assert sorted((r.hash, r.anchor_frame) for r in got) == sorted(want)


def test_shifted_excerpt_and_threshold(spark):
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([("a", words), ("b", " ".join(f"v{i}" for i in range(60))), ("n", None), ("e", "")], "doc string, text string")
    q = spark.createDataFrame([("x", " ".join(f"w{i}" for i in range(20, 40))), ("y", "nothing here is known at all"), ("z", "")], "q string, text string")
    land, query = lm.token_landmarks(docs, "doc", "text", "track_id"), mt.query_landmarks(lm.token_landmarks(q, "q", "text", "query_id"))
    ranked = mt.rank(mt.probe(query, land))
    heads = q.select(F.col("q").alias("query_id")).join(query.groupBy("query_id").agg(F.count(F.lit(1)).alias("query_landmarks")), "query_id", "left").fillna(0)
    got = {r.query_id: r for r in dec.decide(heads, ranked).collect()}
    assert got["x"].decision == "MATCH" and got["x"].track_id == "a" and got["x"].best_offset == 20 and got["x"].evidence == 1.0
    assert got["y"].decision == "NO_MATCH" and got["y"].track_id is None and got["z"].evidence == 0.0
    at = dec.decide(heads, ranked, DecisionConfig(threshold=1.0)).where("query_id = 'x'").first()
    assert at.decision == "MATCH"  # the threshold is inclusive


def test_index_round_trip_and_refusal(spark, tmp_path):
    land = spark.createDataFrame([("a", 5, 1), ("a", 7, 2), ("b", 5, 3)], "track_id string, hash long, anchor_frame int")
    ix.save(land, str(tmp_path), "c1", 2)
    assert sorted(map(tuple, ix.load(spark, str(tmp_path), "c1").select("track_id", "hash", "anchor_frame").collect())) == [("a", 5, 1), ("a", 7, 2), ("b", 5, 3)]
    land.limit(1).write.mode("append").parquet(f"{tmp_path}/postings/catalog_id=c1")
    with pytest.raises(ValueError):
        ix.load(spark, str(tmp_path), "c1")


def test_configs_refuse():
    for bad in (LandmarkConfig(max_dt=300), MatchConfig(tolerance=-1), DecisionConfig(threshold=2.0)):
        with pytest.raises(ValueError):
            bad.validate()
