"""Streaming limits against the batch operators, over any split into micro-batches; state goes."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import usage
from tidemark.streaming import limits

SCHEMA = "tenant bigint, key_id bigint, ts timestamp, event_id bigint, audio_seconds double"


@pytest.fixture
def rocks(spark):
    name, value = limits.STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    yield spark
    spark.conf.set(name, before)


def events(spark, n=240):
    rng = random.Random(10)
    at, rows = datetime(2024, 3, 1, 20, 0, tzinfo=timezone.utc), []
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 0.25, 1, 3, 40, 900, 2400]))
        rows.append((rng.randrange(3), rng.randrange(4), at, i, None if i % 50 == 7 else round(rng.uniform(0, 30), 4)))
    return rows


def streamed(spark, tmp_path, rows, cuts, make):
    """Verdicts of a stream that reads the rows in so many files, one a micro-batch; and its state's rows after each."""
    folder = tmp_path / "in"
    edges = [0, *cuts, len(rows)]
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        spark.createDataFrame(rows[lo:hi], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        import time

        time.sleep(0.02)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = make(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.read.parquet(str(tmp_path / "out")), [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]


@pytest.mark.parametrize("cuts", [[], [30, 31, 100, 170]])
def test_quota_is_the_batch_verdict(rocks, tmp_path, cuts):
    rows = events(rocks)
    batch = usage.quota(rocks.createDataFrame(rows, SCHEMA).fillna(0.0, ["audio_seconds"]), 400.0)
    want = sorted((r.tenant, r.event_id, float(r.used_before), r.accepted) for r in batch.collect())
    out, state = streamed(rocks, tmp_path, rows, cuts, lambda s: limits.quota(s, 400.0))
    assert sorted((r.tenant, r.event_id, float(r.used_before), r.accepted) for r in out.collect()) == want
    assert {r[3] for r in want} == {True, False}
    days = len({(r[0], r[2].date()) for r in rows})
    if cuts:
        assert days >= 9 and max(state) <= 6 and state[-1] == 3  # three tenants, two days at most: those that are over have gone


def test_bucket_is_the_batch_verdict_and_full_ones_go(rocks, tmp_path):
    rows = events(rocks)
    ask = rocks.createDataFrame(rows, SCHEMA).select("key_id", (F.unix_micros("ts") / 1e6).alias("ts"), "event_id")
    want = sorted((r.key_id, r.event_id, r.allowed, r.retry_after) for r in usage.token_bucket(ask, 0.01, 3.0).collect())
    quiet = [(9, 9, rows[-1][2] + timedelta(days=d), 1000 + d, 0.0) for d in (1, 2)]  # only one key goes on
    out, state = streamed(rocks, tmp_path, [*rows, *quiet], [50, 51, 160, 240, 241], lambda s: limits.token_bucket(s, 0.01, 3.0))
    assert sorted((r.key_id, r.event_id, r.allowed, r.retry_after) for r in out.collect() if r.key_id < 9) == want
    assert {w[2] for w in want} == {True, False} and max(state) == 4 and state[-1] == 1


def test_interval_is_the_batch_wait(rocks, tmp_path):
    rows = events(rocks, 120)
    want = sorted((r.key_id, r.event_id, r.wait_micros) for r in usage.minimum_interval(rocks.createDataFrame(rows, SCHEMA), "key_id", 60.0).collect())
    out, _ = streamed(rocks, tmp_path, rows, [10, 60], lambda s: limits.minimum_interval(s, 60.0))
    assert sorted((r.key_id, r.event_id, r.wait_micros) for r in out.collect()) == want and any(w[2] for w in want)
