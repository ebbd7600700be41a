"""op6: windows meet as bytes only where their hashes don't settle them, and a flush is dealt to homes in one pass."""

import numpy as np
import pyarrow as pa

from tidemark.llm import suffix_dedup as sd


def rows(batches):
    return [tuple(r.values()) for b in batches for r in b.to_pylist()]


def dealt(found):
    return sd._rows(sorted(found, key=lambda r: r[:2]))


def test_only_windows_that_may_match_become_bytes(monkeypatch):
    rng = np.random.default_rng(5)
    word = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    lead, shared = word(30), word(80)
    # one anchor in every text with other text around it, and a passage of 80 bytes in two of them
    texts = [word(60) + lead + word(60) + (shared if i in (3, 150) else "") + word(40) for i in range(200)]
    batch = pa.RecordBatch.from_pydict({"k": list(range(200)), "t": texts})
    inserted, plain = [], sd.Family.insert
    monkeypatch.setattr(sd.Family, "insert", lambda self, key, ids: inserted.append((key.dtype.kind, len(key))) or plain(self, key, ids))
    answers = rows(sd._settle(4, sd.HOT)(dealt(rows(sd._offers(4)(iter([batch]))))))
    packed = rows(sd._packed(4, ["k", "t"])(iter([batch])))
    inserted.clear()
    doubtful = rows(sd._doubtful(4)(dealt([r for r in answers if r[1] == sd.HALF] + packed)))
    masks = rows(sd._scanned(4)(dealt(doubtful)))
    as_bytes, as_hashes = (sum(n for kind, n in inserted if kind == k) for k in "Su")
    assert as_hashes > 1000 and as_bytes < as_hashes / 10
    cut = [r for b in sd._cut(4, [], True)(dealt([r for r in answers if r[1] == sd.FULL] + masks + packed)) for r in b.to_pylist()]
    want = {r[0]: r[2] for r in sd.brute_force(list(enumerate(texts)))}
    assert {r["k"]: sum(s["stop"] - s["start"] for s in r["spans"]) for r in cut} == want and want[150] >= 80


def test_a_flush_gives_each_home_its_documents():
    batches = [pa.RecordBatch.from_pydict({"k": [*range(i, i + 999), None], "t": [*map(str, range(i, i + 999)), None]}) for i in (0, 1000, 2000)]
    got = {}
    for home, kind, blob in rows(sd._packed(7, ["k", "t"])(iter(batches))):
        assert kind == sd.TEXT and home not in got
        got[home] = [tuple(r.values()) for b in sd._unpacked(blob) for r in b.to_pylist()]
    every = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    ids = np.array([sd.LAST_ID if k is None else k for k, _ in every])
    assert got == {h: [every[i] for i in np.flatnonzero(sd._home(ids, 7) == h)] for h in range(7)}
