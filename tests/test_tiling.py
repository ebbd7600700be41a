"""Excerpts of long sources."""

from tidemark.operators import catalog as ct


def test_a_long_source_is_tiled_to_its_end(spark):
    got = ct.tile(spark.createDataFrame([(1, 9000.0)], "source_id long, length double")).orderBy("place").collect()
    assert len(got) == 1500 and got[-1].start + got[-1].duration == 9000.0
    assert all(a.start + a.duration == b.start for a, b in zip(got, got[1:], strict=False))
