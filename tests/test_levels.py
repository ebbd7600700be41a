"""The segmented index, split probes, bounded candidates and rate hypotheses against plain versions."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.config import LandmarkConfig, MatchConfig
from tidemark.operators import landmarks as lm
from tidemark.operators import levels as lv
from tidemark.operators import match as mt
from tidemark.operators import rates as rt
from tidemark.operators.index import IndexRefused

LAND = "track_id long, hash long, anchor_frame int"


def some_landmarks(spark, seed, tracks, n=40, keys=30):
    rng = random.Random(seed)
    return spark.createDataFrame([(t, rng.randrange(keys), rng.randrange(200)) for t in tracks for _ in range(n)], LAND)


def rows_of(df):
    return sorted(map(tuple, df.select("track_id", "hash", "anchor_frame").collect()))


def some_queries(spark, land, seed=1):
    rng = random.Random(seed)
    rows = [r for r in land.collect() if rng.random() < 0.3]
    return mt.query_landmarks(spark.createDataFrame([(f"q{i % 4}", r.hash, r.anchor_frame) for i, r in enumerate(rows)], "query_id string, hash long, anchor_frame int"))


def hits_of(df):
    return sorted(map(tuple, df.select("query_id", "track_id", "qidx", "frame", "q_frame", "offset").collect()))


# ---- hot hashes ----


@pytest.mark.parametrize("broadcast", [0, 1 << 26])
def test_split_probe_gives_all_hits_and_no_large_cell(spark, monkeypatch, broadcast):
    """Half of all postings have one hash, and one track holds most of them; a third of the query landmarks too."""
    monkeypatch.setattr("tidemark.session.BROADCAST_BYTES", broadcast)
    rng = random.Random(9)
    rows = [(t % 3 if t % 10 else t, 7 if t % 2 else rng.randrange(100), t) for t in range(4000)]
    land = spark.createDataFrame([*rows, (5, None, 1)], LAND)
    queries = mt.query_landmarks(spark.createDataFrame([(f"q{i % 5}", 7 if i % 3 == 0 else rng.randrange(120), i) for i in range(300)], "query_id string, hash long, anchor_frame int"))
    assert hits_of(mt.probe_split(queries, land, 40)) == hits_of(mt.probe(queries, land))
    a, b = mt.split_sides(queries, land, 40)
    cells = a.groupBy("hash", "salt", "q_salt").count().agg(F.max("count")).first()[0]
    asked = b.groupBy("hash", "salt", "q_salt").count().agg(F.max("count")).first()[0]
    bound = max(40, -(-4001 // 16))  # a quarter of a partition's fair part, of four partitions
    assert cells < 1.35 * bound and asked < 70  # one hash has 2,000 postings and 100 query landmarks
    assert a.where("hash = 7").select("salt").distinct().count() >= 8


# ---- candidates by bound ----


def test_bounded_rank_is_rank_with_few_windows(spark):
    rng = random.Random(4)
    hits = []
    for q in range(6):
        for t in range(60):
            n = rng.randrange(1, 6) if t > 6 else rng.randrange(10, 40)
            hits += [(f"q{q}", t, rng.randrange(30), rng.randrange(-20, 20) if t % 2 else rng.randrange(3)) for _ in range(n)]
    df = spark.createDataFrame(hits, "query_id string, track_id int, qidx int, offset int")
    cfg = MatchConfig(max_candidates=3)
    assert sorted(map(tuple, mt.bounded_rank(df, cfg).collect())) == sorted(map(tuple, mt.rank(df, cfg).collect()))
    pairs = mt.open_pairs(df, cfg).collect()
    assert len(pairs) == 360 and sum(p.open for p in pairs) < 0.2 * len(pairs)
    few = df.where("track_id < 2")  # fewer candidates than are asked for: no floor
    assert sorted(map(tuple, mt.bounded_rank(few, cfg).collect())) == sorted(map(tuple, mt.rank(few, cfg).collect()))
    assert mt.bounded_rank(df.limit(0), cfg).count() == 0


def test_few_windows_of_the_tables(spark):
    """About half of all candidates have their windows built on sf0.001, where most tenth candidates are chance hits; 36% on sf0.01."""
    from tidemark.plans.recognition import expanded_pairs

    got = expanded_pairs(spark, "/root/testdata/sf0.001").agg(F.sum("expanded"), F.sum("pairs")).first()
    assert got[0] < 0.55 * got[1]


@pytest.mark.parametrize("tol", [0, 2, 5])
def test_second_window_against_two_passes(spark, tol):
    rng = random.Random(tol)
    rows = [(f"q{i}", "t", rng.randrange(10), rng.randrange(-30, 30)) for i in range(40) for _ in range(rng.randrange(1, 40))]
    df = spark.createDataFrame(rows, "query_id string, track_id string, qidx int, offset int")
    cfg = MatchConfig(tolerance=tol)
    best = mt.densest(df, cfg)
    rest = df.join(best.select("query_id", "lo", "hi"), "query_id").where((F.col("offset") < F.col("lo") - tol) | (F.col("offset") > F.col("hi") + tol))
    again = {r.query_id: (r.score, r.best_offset) for r in mt.densest(rest, cfg).collect()}
    first = {r.query_id: (r.score, r.best_offset, r.lo, r.hi) for r in best.collect()}
    for r in mt.second_best(df, cfg).collect():
        assert (r.score, r.best_offset, r.lo, r.hi) == first[r.query_id]
        assert (r.second_best_score, r.second_best_offset) == again.get(r.query_id, (None, None))


# ---- the index ----


def test_index_after_ingests_and_deletes_equals_one_built_anew(spark, tmp_path):
    rng = random.Random(5)
    index, truth, written = lv.LevelIndex.create(spark, str(tmp_path / "i"), buckets=4), {}, []
    for step in range(11):
        if step in (3, 7):
            gone = rng.sample(sorted(truth), 2) + [999]
            index = index.delete(spark.createDataFrame([(t,) for t in [*gone, None]], "track_id long"))
            for t in gone:
                truth.pop(t, None)
            continue
        batch = rng.sample(range(12), 3)  # some are there already
        land = some_landmarks(spark, step, batch, n=20)
        before = {s.segment for s in index.segments}
        index = index.ingest(land)
        written.append([s.rows for s in index.segments if s.segment not in before])
        for t in batch:
            truth[t] = [tuple(r) for r in land.where(F.col("track_id") == t).select("track_id", "hash", "anchor_frame").collect()]
        held = lv.LevelIndex.open(spark, str(tmp_path / "i"))
        assert rows_of(held.postings()) == sorted(x for v in truth.values() for x in v)
    assert len(index.segments) <= lv.levels_bound(9 * 60, 60)
    # an ingest writes its own postings; every fourth one also a merged segment
    assert [len(w) == 1 for w in written] == [True] * 9 and sum(w[0] == 60 for w in written) >= 6
    one = index.compact()
    assert len(one.segments) == 1 and not one.masks and rows_of(one.postings()) == rows_of(index.postings())
    assert rows_of(lv.LevelIndex.open(spark, str(tmp_path / "i"), version=1).postings()) != rows_of(one.postings())
    anew = lv.LevelIndex.create(spark, str(tmp_path / "j"), buckets=4).ingest(one.postings())
    assert anew.drift(one) == [] and anew.content_leaves().root == index.content_leaves().root
    other = anew.delete(spark.createDataFrame([(sorted(truth)[0],)], "track_id long"))
    assert other.drift(one) != []


def test_probe_of_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mt, "HOT_ROWS", 30)
    monkeypatch.setattr(mt.hot_hashes, "__defaults__", (30,))
    land = some_landmarks(spark, 1, range(8), n=60).unionByName(spark.createDataFrame([(3, 5, f) for f in range(200)], LAND))
    index = lv.LevelIndex.create(spark, str(tmp_path), buckets=4).ingest(land.where("track_id < 5")).ingest(land.where("track_id >= 4")).delete(spark.createDataFrame([(6,)], "track_id long"))
    hot = spark.read.parquet(f"{tmp_path}/segments/{index.segments[0].segment}/hot")
    assert hot.count() >= 200  # hash 5 lies apart
    queries = some_queries(spark, land)
    want = hits_of(mt.probe(queries, land.where("track_id <> 6")))
    assert want and hits_of(index.probe(queries)) == want
    monkeypatch.setattr("tidemark.session.BROADCAST_BYTES", 0)
    monkeypatch.setattr(lv, "PRUNED_HASHES", 2)
    assert hits_of(index.probe(queries)) == want
    assert index.probe(queries.limit(0)).count() == 0
    empty = lv.LevelIndex.create(spark, str(tmp_path / "e"))
    assert empty.probe(queries).count() == 0 and empty.postings().count() == 0


@pytest.mark.parametrize("broadcast", [0, 1 << 26])
def test_postings_do_not_move(spark, tmp_path, monkeypatch, broadcast):
    """No exchange stands above the buckets' scan before the join, and few hashes read few buckets."""
    monkeypatch.setattr("tidemark.session.BROADCAST_BYTES", broadcast)
    index = lv.LevelIndex.create(spark, str(tmp_path), buckets=16).ingest(some_landmarks(spark, 2, range(6)))
    queries = mt.query_landmarks(spark.createDataFrame([("q", 3, 1), ("q", 4, 2)], "query_id string, hash long, anchor_frame int"))
    plan = index.probe(queries)._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 2 out of 16" in plan or "SelectedBucketsCount: 1 out of 16" in plan
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if "FileScan" in x and "Bucketed: true" in x)
    depth = len(re.match(r"[ :|+\-*()\d]*", lines[at])[0])
    for x in reversed(lines[:at]):  # the scan's ancestors, up to the join
        d = len(re.match(r"[ :|+\-*()\d]*", x)[0])
        if d < depth:
            depth = d
            assert "Exchange" not in x, plan
            if "Join" in x:
                break


def test_a_changed_posting_is_located(spark, tmp_path):
    index = lv.LevelIndex.create(spark, str(tmp_path), buckets=8).ingest(some_landmarks(spark, 3, range(6)))
    assert index.verify() == [] and lv.LevelIndex.open(spark, str(tmp_path)).version == 1
    seg = f"{tmp_path}/segments/{index.segments[0].segment}"
    at = index._rows(seg, "bucketed").select("hash", F.input_file_name().alias("f")).first()
    bucket, file = lv.bucket_of_file(at.f), at.f.removeprefix("file:").replace("///", "/")
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = pq.read_table(file)
    frames = rows.column("anchor_frame").to_pylist()
    frames[0] += 1
    pq.write_table(rows.set_column(rows.column_names.index("anchor_frame"), "anchor_frame", pa.array(frames, pa.int32())), file)
    _drop_crc(file)
    assert lv.LevelIndex.open(spark, str(tmp_path)).verify() == [(index.segments[0].segment, bucket, bucket + 1)]
    assert index.verify(bucket + 1) == [] and index.verify(bucket, bucket + 1) != []
    pq.write_table(pq.read_table(file).slice(1), file)  # a missing row shows in the footers already
    with pytest.raises(IndexRefused, match=str(bucket)):
        lv.LevelIndex.open(spark, str(tmp_path))
    leaves = spark.read.parquet(f"{seg}/leaves").withColumn("rows", F.when(F.col("leaf") == bucket, F.col("rows") - 1).otherwise(F.col("rows"))).toPandas()
    spark.createDataFrame(leaves).coalesce(1).write.mode("overwrite").parquet(f"{seg}/leaves")
    with pytest.raises(IndexRefused, match="root"):
        lv.LevelIndex.open(spark, str(tmp_path))
    with pytest.raises(IndexRefused):
        lv.LevelIndex.open(spark, str(tmp_path), LandmarkConfig(fan_out=4), check=False)
    with pytest.raises(IndexRefused):
        lv.LevelIndex.open(spark, str(tmp_path / "none"))


def _drop_crc(file):
    import os

    folder, name = os.path.split(file)
    if os.path.exists(crc := f"{folder}/.{name}.crc"):
        os.remove(crc)


def test_digest_tree_descends_where_it_differs():
    a = {i: (i, str(i * i)) for i in range(200)}
    b = a | {17: (17, "x"), 18: (0, "0"), 150: (1, "1")}
    runs, compared = lv.DigestTree(a, 200).differing(lv.DigestTree(b, 200))
    assert runs == [(17, 19), (150, 151)] and compared < 60
    assert lv.DigestTree(a, 200).differing(lv.DigestTree(dict(a), 200)) == ([], 1)
    with pytest.raises(ValueError):
        lv.DigestTree(a, 200).differing(lv.DigestTree(a, 201))


# ---- rates ----


def test_rated_keys_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(f"q{i}", float(r), i, rng.randrange(1024) << 18 | rng.randrange(1024) << 8 | rng.randrange(0, 256), rng.randrange(500)) for i in range(200) for r in (-5.0, 0.0, 3.0, -100.0, -120.0)]
    df = spark.createDataFrame(rows, "query_id string, rate double, qidx int, hash long, anchor_frame int")
    for bins in (False, True):
        want = set()
        for q, rate, i, h, frame in rows:
            by = 1 + rate / 100
            if by <= 0:
                continue
            f1, f2, dt = h >> 18, h >> 8 & 1023, h & 255
            if bins:
                f1, f2 = int(f1 * by + 0.5), int(f2 * by + 0.5)
            for d in {math.floor(dt / by), math.ceil(dt / by)}:
                if 1 <= d <= 255 and f1 < 1024 and f2 < 1024:
                    want.add((q, rate, i, f1 << 18 | f2 << 8 | d, math.floor(frame / by)))
        assert set(map(tuple, rt.rated_keys(df, bins).collect())) == want


@pytest.mark.parametrize("percent", [-4.0, 3.0, 5.0])
def test_an_excerpt_played_at_another_rate_is_found(spark, percent):
    """Its frame differences change with the rate, so that its own keys hardly meet the track's; the rate's keys do."""
    rng = random.Random(11)
    peaks = {t: sorted({(rng.randrange(0, 6000), rng.randrange(1024)) for _ in range(160)}) for t in range(5)}
    land = lm.pair_peaks(spark.createDataFrame([(t, f, b) for t, ps in peaks.items() for f, b in ps], "track_id int, frame int, freq_bin int"))
    by = 1 + percent / 100
    query = sorted({(int((f - 1000) * by), b) for f, b in peaks[2] if 1000 <= f < 4000})
    q = lm.pair_peaks(spark.createDataFrame([("q", f, b) for f, b in query], "track_id string, frame int, freq_bin int"), LandmarkConfig(max_dt=128))
    q = mt.query_landmarks(q.withColumnRenamed("track_id", "query_id"))
    n = q.count()
    assert n > 100
    plain = mt.rank(mt.probe(q, land)).where("rank = 1").first()
    got = {r.rate: r for r in rt.hypotheses(q, land, (-100.0, percent, -percent)).collect()}
    assert got[percent].track_id == 2 and got[percent].score > 0.5 * n and got[percent].error is None
    assert plain is None or plain.score < 0.5 * got[percent].score
    assert got[-100.0].track_id is None and got[-100.0].error == "rate -100.0% is not a playable speed" and got[-100.0].query_landmarks == 0
    one = rt.at_rate(q, land, spark.createDataFrame([("q", percent)], "query_id string, rate double")).first()
    assert (one.track_id, one.score, one.best_offset) == (2, got[percent].score, got[percent].best_offset)
