"""Melody queries ask with every vector and use all of it."""

import numpy as np
from conftest import SF

from tidemark.operators import similarity as sim
from tidemark.plans import catalogue
from tidemark.session import table


def whole(spark):
    return {r.vec_id: np.array(r.embedding, float) for r in table(spark, SF, "embeddings").select("vec_id", "embedding").collect()}


def test_every_vector_asks_for_melodies(spark):
    v, got = whole(spark), {}
    for r in catalogue.QUERIES["melody_match__J20"](spark, SF).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.cost, r.song)
    assert set(got) == set(v)
    for q in (1, 57):
        want = sorted((sim.dtw(v[q], m), str(s)) for s, m in v.items())[:3]
        assert [got[q][i] for i in (1, 2, 3)] == want


def test_melodies_are_resized_whole(spark):
    v, got = whole(spark), {}
    for r in catalogue.QUERIES["melody_resize__X19"](spark, SF).collect():
        got.setdefault(r.vec_id, {})[r.place] = r.value
    for k, m in v.items():
        want = np.interp(np.linspace(0, len(m), 100), np.arange(len(m)), m)
        assert np.allclose([got[k][i] for i in range(100)], want, atol=1e-8)


def test_warping_of_many_pairs_is_that_of_each():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(40, 7)), rng.normal(size=(40, 11))
    assert sim.dtw_pairs(a, b).tolist() == [sim.dtw(x, y) for x, y in zip(a, b, strict=True)]
    assert np.isinf(sim.dtw_pairs(a[:, :0], b)).all()
