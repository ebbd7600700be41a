"""Rows that can't matter to a result don't move for it."""

import re

import pytest
from conftest import SF

from tidemark.operators import match as mt
from tidemark.operators import replays as rp
from tidemark.plans import cascades
from tidemark.plans import recognition as rec

LAND = "track_id long, hash long, anchor_frame int"


def exchanges(df) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("query", [rec.bounded_rank, rec.expanded_pairs])
def test_bounds_are_made_where_hits_lie(spark, query):
    """Neither a hit nor a pair is stored or dealt anew: texts move by document, pairs' bounds stay."""
    moved = exchanges(query(spark, SF))
    assert any(re.match(r"doc_id#\d+L?, \d+$", m) for m in moved)
    assert not [m for m in moved if re.search(r"query_id#.*track_id#", m)]


def test_split_probe_moves_asked_postings_only(spark, monkeypatch):
    seen, plain = [], mt.split_sides
    monkeypatch.setattr(mt, "split_sides", lambda q, land, least: seen.append(land) or plain(q, land, least))
    land = spark.createDataFrame([(t, h, h) for t in range(5) for h in range(100)] + [(1, None, 3)], LAND)
    queries = mt.query_landmarks(spark.createDataFrame([("q", 7, 1), ("q", 200, 2), ("q", None, 3)], "query_id string, hash long, anchor_frame int"))
    assert mt.probe_split(queries, land).count() == 5
    assert {r.hash for r in seen[0].collect()} == {7}


def test_hot_hashes_are_those_of_a_plain_count(spark, monkeypatch):
    monkeypatch.setattr(mt, "HASH_GROUPS", 3)
    rows = spark.createDataFrame([(h,) for h in range(40) for _ in range(3 * h)] + [(None,)] * 500, "hash long")
    got, bound = mt.hot_hashes(rows, 90)
    assert {(r.hash, r.n) for r in got.collect()} == {(h, 3 * h) for h in range(40) if 3 * h > bound} | {(None, 500)}


def test_a_grid_takes_its_best_without_the_others(spark):
    """Hypotheses are dealt once, by query; a grid's best is the one of most evidence, ties to the least rate, as in SQL."""
    moved = exchanges(cascades.grid_study(spark, SF))
    assert not [m for m in moved if re.match(r"grid#\d+, query_id#", m)]
    rows = spark.createDataFrame([(q, False, 0, 1, q == 4) for q in range(5)] + [(9, True, 1, 1, False)], "query_id long, stage1_accept boolean, stage1_top long, truth long, is_negative boolean")
    h = [(0, 0.0, 1, 9, 0.6), (0, 2.0, 2, 9, 0.7), (1, 0.0, 1, 9, 0.4), (1, 2.0, 1, 9, 0.5), (2, 2.0, 1, 9, 0.5), (2, -2.0, 2, 9, 0.5), (3, 0.0, 1, 9, None), (3, 2.0, 1, 9, 0.8), (4, 0.0, 1, 9, 0.9)]
    hyp = spark.createDataFrame([(*x, None) for x in h], "query_id long, rate double, id long, aligned long, evidence double, error string")
    got = {r.grid: r.tp for r in rp.grid_study(rows, hyp, {"a": (2.0,), "b": (-2.0, 2.0), "c": (-2.0,)}, 0.5).collect()}
    assert got == {"a": 4, "b": 3, "c": 2}
