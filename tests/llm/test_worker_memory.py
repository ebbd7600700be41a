"""What Python workers hold: one operator's things at a time, and batches of bounded size (pipeline on check_h)."""

import numpy as np
import pyarrow as pa

from tidemark.llm import piece_codec, suffix_dedup
from tidemark.llm.common import BATCH_BYTES, Runs, only, powers, trimmed


def encoded_here():
    """The piece codec's vocabulary and remembered units, as one of its tasks leaves them in a worker."""
    only(piece_codec.__name__)
    _, known, _ = piece_codec._worker(piece_codec.default_model())
    known.places(np.arange(1, 3, dtype=np.uint64), lambda at: [["▁ab", "▁cd"][i] for i in at])
    return known


def test_a_task_of_another_operator_finds_an_empty_worker():
    known = encoded_here()
    batch = pa.RecordBatch.from_pydict({"k": [1, 2], "t": ["x" * 60, "x" * 60]})
    assert list(trimmed(suffix_dedup._offers(4))(iter([batch])))
    assert not piece_codec._WORKER
    assert Runs.asked is None
    assert known.n == 0


def test_a_task_of_the_same_operator_finds_what_it_kept():
    known = encoded_here()
    only(piece_codec.__name__)
    assert piece_codec._worker(piece_codec.default_model())[1] is known
    assert known.n == 2


def test_rows_come_in_batches_of_bounded_size():
    rows = [(i, 0, bytes(1 << 20)) for i in range(10)] + [(10, 0, bytes(2 * BATCH_BYTES))]
    got = list(suffix_dedup._rows(list(rows)))
    assert [r for b in got for r in zip(*(c.to_pylist() for c in b.columns), strict=True)] == rows
    assert all(b.num_rows == 1 or sum(map(len, b.column(2).to_pylist())) <= BATCH_BYTES for b in got)


def test_powers():
    up, down = powers(1000)
    x = 1
    for i in range(1001):
        assert int(up[i]) == x and int(up[i]) * int(down[i]) % (1 << 64) == 1
        x = x * 0x9E3779B97F4A7C15 % (1 << 64)
