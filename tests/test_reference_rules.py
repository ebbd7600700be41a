"""Rules that the reference states, on small literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import evaluate as ev
from tidemark.operators import keys as ky
from tidemark.operators import landmarks as lm
from tidemark.operators import negatives as ng
from tidemark.session import running


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_key_words(spark):
    good = {"C": 0, "c major": 0, "Cmaj": 0, "C#m": 13, "Db minor": 13, "F# Minor": 18, "Bbm": 22, "C M": 12, "B-moll": 23, "A_dur": 9, " E  min. ": 16, "Cbb": 10, "C♯": 1, "D♭ maj": 1, "F##": 7}
    assert column(spark, list(good), ky.parse) == list(good.values())
    bad = ["C aeolian", "C ionian", "H minor", "", "lydian", "C--major", "C minor x", "8A", None]
    assert column(spark, bad, ky.parse) == [None] * len(bad)
    assert column(spark, ["H", None], lambda c: ky.text(ky.parse(c))) == [None, None]


def test_licences(spark):
    cases = {
        "https://creativecommons.org/publicdomain/zero/1.0/": (True, "CC0-1.0"), "http://CreativeCommons.org/publicdomain/mark/1.0": (True, "PublicDomainMark-1.0"), "https://creativecommons.org/licenses/by/4.0": (True, "CC-BY"),
        "https://creativecommons.org/licenses/by-sa/3.0": (True, "CC-BY-SA"), "https://creativecommons.org/licenses/by-nc/4.0": (False, "UNKNOWN"), "https://creativecommons.org/licenses/by/4.0?x=-nd": (False, "CC-BY"), "https://example.com/by/someone": (False, "UNKNOWN"), "CC BY 4.0": (False, "UNKNOWN"),
        "https://creativecommons.org/licenses/sampling+/1.0/publicdomain": (False, "UNKNOWN"),
    }
    assert column(spark, list(cases), tx.permissive) == [c[0] for c in cases.values()] and column(spark, list(cases), tx.licence_name) == [c[1] for c in cases.values()]
    assert column(spark, [None], tx.permissive) == [False]


def test_threshold_fallback(spark):
    rows = spark.createDataFrame([(0.9, 0.2, 0.5), (0.5, 0.6, 0.5), (0.4, 0.6, 0.6), (0.95, 0.1, 0.0), (0.97, 0.1, 0.0)], "score double, recall double, far double")
    pick = lambda df, m: [r.score for r in ev.pick_threshold(df, m, fallback=True).collect()]
    assert pick(rows, 0.55) == [0.5] and pick(rows.where("far > 0"), 0.1) == [0.9] and pick(rows, -1.0) == [0.95]
    assert ev.pick_threshold(rows, -1.0).count() == 0


def walked(rows):
    ds, bs, out = set(), set(), {}
    for k, d, b in sorted(rows):
        out[k] = "digest" if d in ds else "base" if b in bs else "kept"
        if out[k] == "kept":
            ds.add(d)
            bs.add(b)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_first_of_each_is_the_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(k, f"d{rng.randrange(25)}", f"b{rng.randrange(25)}") for k in range(60)]
    if seed == 0:  # a rejected row shadows none; a chain of decisions
        rows = [(0, "A", "X"), (1, "B", "X"), (2, "B", "Z"), *((k, f"d{k // 2}", f"b{(k + 1) // 2}") for k in range(3, 15))]
    got = ng.first_of_each(spark.createDataFrame(rows, "k int, d string, b string"), "k", "d", "b").collect()
    assert {r.k: r.verdict for r in got} == walked(rows)
    assert ng.first_of_each(spark.createDataFrame([], "k int, d string, b string"), "k", "d", "b").count() == 0


def test_running_sums(spark):
    rows = [(k * 7 % 101, k % 5) for k in range(101)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(5)
    got = {r.k: (r.s, r.n) for r in running(df, [F.desc("k")], {"s": F.col("v"), "n": F.lit(1)}).collect()}
    for k, _ in rows:
        assert got[k] == (sum(v for x, v in rows if x >= k), sum(1 for x, _ in rows if x >= k))


def test_landmark_count_is_what_is_made(spark):
    texts = ["", "a", "a b", "a b c d e", "a b c d e f", "w " * 40, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    made = lm.token_landmarks(df, "i", "t", "i2")
    for frames in (None, 3, 24):
        want = {r.i2: r["count"] for r in (made if frames is None else made.where(F.col("anchor_frame") < frames)).groupBy("i2").count().collect()}
        got = {r.i: r.n for r in df.select("i", lm.landmark_count(F.col("t"), frames).alias("n")).collect()}
        assert got == {i: want.get(i, 0) for i in range(len(texts))}


@pytest.mark.parametrize("rest", [0, 20, 100_000])
def test_first_of_each_is_the_walk_in_order(spark, monkeypatch, rest):
    """A chain in which each row shares its digest with one neighbour and its base with the other, and random rows."""
    import random

    from tidemark.operators import negatives as ng

    monkeypatch.setattr(ng, "REST_ROWS", rest)
    rng = random.Random(2)
    chain = [(i, f"d{i // 2}", f"b{(i + 1) // 2}") for i in range(12)]
    rows = chain + [(100 + i, f"x{rng.randrange(60)}", f"y{rng.randrange(60)}") for i in range(200)]
    digests, bases, want = set(), set(), {}
    for k, d, b in rows:
        want[k] = "digest" if d in digests else "base" if b in bases else "kept"
        if want[k] == "kept":
            digests.add(d)
            bases.add(b)
    got = ng.first_of_each(spark.createDataFrame(rows, "k long, d string, b string"), "k", "d", "b").collect()
    assert {r.k: r.verdict for r in got} == want
