"""Exact percentiles by brackets against percentile()."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranks

WANTED = [0.0, 0.05, 0.5, 0.77, 0.95, 1.0]


@pytest.mark.parametrize("kind", ["even", "ties", "hot", "skewed"])
def test_equal_to_percentile(spark, monkeypatch, kind):
    monkeypatch.setattr(ranks, "BRACKET_ROWS", 50)
    monkeypatch.setattr(ranks, "POINTS", 20)
    rng = random.Random(kind)
    rows = [("b", float(i)) for i in range(7)] + [("one", 3.5), ("none", None), (None, 1.0), (None, 2.0)]
    for i in range(6000):  # one group holds nearly all rows
        v = {"even": rng.random(), "ties": float(rng.randrange(3)), "hot": 7.0 if rng.random() < 0.6 else rng.random() * 10, "skewed": 10 ** rng.uniform(-8, 8)}[kind]
        rows.append(("a", -v if i % 9 == 0 else v))
    df = spark.createDataFrame(rows, "g string, x double")
    want = {r.g: [r[f"p{i}"] for i in range(len(WANTED))] for r in df.groupBy("g").agg(*(F.percentile("x", p).alias(f"p{i}") for i, p in enumerate(WANTED))).collect() if r.g != "none"}
    got = {}
    for r in sorted(ranks.percentiles(df, ["g"], "x", WANTED).collect(), key=lambda r: r.p):
        got.setdefault(r.g, []).append(r.value)
    assert got == want
    whole = {r.p: r.value for r in ranks.percentiles(df, [], "x", WANTED).collect()}
    assert [whole[p] for p in WANTED] == list(df.agg(F.percentile("x", F.array(*map(F.lit, WANTED))).alias("p")).first().p)
    assert ranks.percentiles(df.limit(0), ["g"], "x", WANTED).count() == 0


def test_a_hot_group_is_not_one_task(spark, monkeypatch):
    """What is ordered by rank is a bracket's rows, not the group's."""
    monkeypatch.setattr(ranks, "BRACKET_ROWS", 100)
    most = []
    plain = ranks._within
    monkeypatch.setattr(ranks, "_within", lambda *a: most.append(plain(*a).count()) or plain(*a))
    df = spark.range(40000).select(F.lit("a").alias("g"), F.rand(3).alias("x"))
    got = ranks.percentiles(df, ["g"], "x", [0.5, 0.9]).collect()
    want = df.agg(F.percentile("x", 0.5), F.percentile("x", 0.9)).first()
    assert sorted(r.value for r in got) == sorted(want)
    assert most[0] == 80000 and most[-1] <= 200 and len(most) <= 2 + ranks.passes(40000)
