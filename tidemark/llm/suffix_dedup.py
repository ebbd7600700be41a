"""Removal of long byte strings that repeat across documents, by families of suffix arrays.

A string of MATCH bytes is removed from a document if it also starts in one with a smaller id. Every
window of MATCH bytes is led by its anchor: the leftmost of its ANCHOR-byte strings with the least
hash. Equal windows have equal anchors at equal places, so only suffixes that start at anchors
(about one position in 15) need an index, partitioned by anchor over the cluster. A document's
windows led by one anchor are neighbours; the bytes they span are the anchor's stretch.

1. Each partition keeps a logarithmic family of sorted arrays of stretch fingerprints: a new batch
   gets its own array, and arrays of equal size class merge, so each entry is merged a logarithmic
   number of times. Scanning the family settles stretches that occur as a whole in a document with
   a smaller id, and finds those whose anchor alone does.
2. For the latter, stretches are sent as bytes. A family of 64-bit hashes says which suffixes (to
   MATCH bytes) may occur with a smaller id. Only those get suffix arrays of their bytes by batch, which
   merge geometrically in the same way, and each batch is scanned against them for matches of MATCH bytes with a smaller id. An anchor with more than HOT such
   stretches doesn't meet in one partition: its windows go one by one to the partition of their
   own hash, and what each of them finds is put together at the document.
3. The settled windows meet their documents, and the bytes they cover go.

A stretch's fingerprint in step 1 has 64 bits of its own beside the partition number, also among
stretches of one anchor: m different ones give about m^2 / 2^65 false matches. 32 bits of the anchor
go along to find what step 2 has to look at; step 2 compares bytes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, batchwise, mix64, parts, powers, shared_dir, spread

MATCH = 50
ANCHOR = 20
#: Text of one index partition, and of one partition of documents, on average.
PARTITION_BYTES = 8 << 20
#: A task sends what it gathered once it has read so much text.
FLUSH_BYTES = 8 << 20
#: Beyond so much text both grow with the root of it, up to MOST_BYTES: each flush sends a blob to each partition.
ROOT_BYTES, MOST_BYTES = 1 << 30, 32 << 20
#: Index partitions and homes beyond so many share tasks, which take them one after another.
MOST_TASKS = 20_000
#: An anchor with more stretches to compare than this is spread over partitions by window (31 windows of 50 bytes each at most).
HOT = 1 << 15
#: Hot stretches whose windows are made at once.
HOT_STEP = 1 << 13
#: Text that is hashed at once (a longer single document is hashed alone).
STEP_BYTES = 1 << 18
#: Stands for a null id: larger than every other.
LAST_ID = (1 << 63) - 1


class Anchors:
    """Anchors of the MATCH-byte windows of some documents.

    doc: document of each anchor; first, last: its windows' first and last start; at: its position
    (all within the documents' joined bytes); lead: hash of the anchor; stretch: hash of
    the bytes that its windows span and of its place in them.
    """

    def __init__(self, texts: list[bytes]):
        size = np.array([len(t) for t in texts], np.int64)
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        self.start = np.cumsum(size) - size
        n = len(self.raw)
        none = np.zeros(0, np.int64)
        self.doc = self.first = self.last = self.at = none
        self.lead = self.stretch = none.astype(np.uint64)
        windows = n - MATCH + 1
        if windows <= 0:
            return
        up, down = powers(1 << max(20, n.bit_length()))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        code = sums[ANCHOR:] - sums[:-ANCHOR]
        code *= down[: len(code)]
        # 32 bits of hash over 32 of place: the least is the leftmost of the least hash
        least = code * np.uint64(0xD1B54A32D192ED03)
        least &= np.uint64(0xFFFFFFFF00000000)
        least |= np.arange(len(code), dtype=np.uint64)
        span, done = MATCH - ANCHOR + 1, 1
        while done < span:  # within each window, by doubling
            step = min(done, span - done)
            least = np.minimum(least[step:], least[:-step])
            done += step
        own = np.maximum(0, size - MATCH + 1)
        inside = np.repeat(np.tile([True, False], len(size)), np.column_stack([own, size - own]).reshape(-1))[:windows]
        goes_on = inside[1:] & inside[:-1] & (least[1:windows] == least[: windows - 1])
        self.first, self.last = np.flatnonzero(inside & ~np.append(False, goes_on)), np.flatnonzero(inside & ~np.append(goes_on, False))
        if not len(self.first):
            return
        self.at = (least[self.first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.doc = np.searchsorted(self.start, self.first, side="right") - 1
        # of several documents that start there, the empty ones come first
        self.lead = mix64(code[self.at])
        body = (sums[self.last + MATCH] - sums[self.first]) * down[self.first]
        place = ((self.last - self.first).astype(np.uint64) << np.uint64(32)) + (self.at - self.first).astype(np.uint64)
        self.stretch = mix64(body ^ mix64(place + np.uint64(1)))

    def bucket(self, n: int) -> np.ndarray:
        return (self.lead % np.uint64(n)).astype(np.int64)

    def short(self, n: int) -> np.ndarray:
        """32 bits of the anchor's hash beside its bucket."""
        return (self.lead // np.uint64(n)).astype(np.uint32)


class Family:
    """Sorted arrays of (key, id), each key with its least id, whose sizes differ by powers of two."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def _settle(key: np.ndarray, ids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, ids = key[order], ids[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        return key[head], np.minimum.reduceat(ids, head) if len(head) else ids[:0]

    def insert(self, key: np.ndarray, ids: np.ndarray) -> None:
        if not len(key):
            return
        level = self._settle(key, ids, np.argsort(key, kind="stable"))
        while self.levels and len(self.levels[-1][0]).bit_length() <= len(level[0]).bit_length():
            k, i = self.levels.pop()
            k, i = np.concatenate([k, level[0]]), np.concatenate([i, level[1]])
            level = self._settle(k, i, np.argsort(k, kind="stable"))  # two sorted runs: one merge
        self.levels.append(level)

    def least(self, key: np.ndarray) -> np.ndarray:
        """The least id of each key over all levels; LAST_ID if there is none."""
        out = np.full(len(key), LAST_ID)
        for k, i in self.levels:
            at = np.minimum(np.searchsorted(k, key), len(k) - 1)
            np.minimum(out, np.where(k[at] == key, i[at], LAST_ID), out=out)
        return out


def _press(*columns: np.ndarray) -> bytes:
    """Columns of numbers, byte planes apart, compressed."""
    import zstandard

    n = len(columns[0])
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(n, c.dtype.itemsize).T.tobytes() for c in columns]
    return n.to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpress(blob: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    n, raw, at, out = int.from_bytes(blob[:8], "little"), zstandard.ZstdDecompressor().decompress(blob[8:]), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).reshape(n))
        at += n * size
    return out


def _groups(values: np.ndarray):
    """(value, positions) of each value."""
    if not len(values):
        return
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.append(True, values[order][1:] != values[order][:-1]))
    for lo, hi in zip(cuts, [*cuts[1:], len(values)], strict=True):
        yield int(values[order[lo]]), order[lo:hi]


def _home(ids: np.ndarray, n: int) -> np.ndarray:
    """The partition of documents that an id belongs to."""
    return (mix64(ids.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int64)


def _steps(texts: list[bytes]):
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > STEP_BYTES:
            yield slice(start, i)
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


#: What the steps exchange: rows (home, kind, blob) dealt by home.
ROW = "home int, kind int, blob binary"
FULL, HALF, TEXT = 0, 1, 2
#: Sent on as it is by step 1, to be told from a batch.
BATCH = 9


def _rows(rows: list[tuple[int, int, bytes]]):
    import pyarrow as pa

    while rows:  # bounded batches
        n, total = 0, 0
        while n < len(rows) and (n == 0 or total + len(rows[n][2]) <= BATCH_BYTES):
            total += len(rows[n][2])
            n += 1
        part, rows = rows[:n], rows[n:]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.binary())], names=["home", "kind", "blob"])


def _documents(batches):
    """(ids, texts, batch) of each Arrow batch of (k, t, ...)."""
    for batch in batches:
        yield np.array([LAST_ID if k is None else k for k in batch.column(0).to_pylist()], np.int64), [(t or "").encode() for t in batch.column(1).to_pylist()], batch


def portions(total: int) -> tuple[int, int]:
    """Bytes of text of a partition and of a flush, so that blobs (partitions times flushes) grow as the text does up to 16 GB."""
    by = max(1.0, math.sqrt(total / ROOT_BYTES))
    return tuple(max(size, min(MOST_BYTES, int(size * by))) for size in (PARTITION_BYTES, FLUSH_BYTES))


def _dealt(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(min(max(n, parts(df.sparkSession)), max(MOST_TASKS, parts(df.sparkSession))), "home").sortWithinPartitions("home", "kind")


def _by_home(batches):
    """(home, kind, blob) one after another; rows come sorted."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py()


def _offers(n: int, most: int = FLUSH_BYTES):
    """Step 1, from documents: batches of (key, id, anchor) for each index partition, the least id of equal keys.

    A key is a stretch's hash. Larger ids of a key of the same flush are settled at once and sent as rows to pass on.
    """

    def run(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            bucket, key, ids, lead = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(key)
            order = order[np.argsort(bucket[order].astype(np.min_scalar_type(n)), kind="stable")]
            bucket, key, ids, lead = bucket[order], key[order], ids[order], lead[order]
            new = np.ones(len(key), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1])
            head = np.flatnonzero(new)
            first = np.minimum.reduceat(ids, head)
            least = first[np.cumsum(new) - 1]
            cuts = np.flatnonzero(np.append(True, bucket[head][1:] != bucket[head][:-1])).tolist()
            rows = []
            for lo, hi in zip(cuts, [*cuts[1:], len(head)], strict=True):
                at = head[lo:hi]
                rows.append((int(bucket[at[0]]), BATCH, _press(key[at], first[lo:hi], lead[at])))
            rest = np.flatnonzero(ids > least)
            # sent to whichever partition shares the home's number; step 1 passes them on
            rows += [(h, FULL, _press(ids[rest][at], key[rest][at])) for h, at in _groups(_home(ids[rest], n))]
            yield from _rows(rows)

        for ids, texts, _ in _documents(batches):
            for at in _steps(texts):
                a = Anchors(texts[at])
                if len(a.doc):
                    held.append((a.bucket(n), a.stretch, ids[at][a.doc], a.short(n)))
                size += len(a.raw)
                if size >= most and held:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def _settle(n: int, hot: int):
    """Step 1, in an index partition: FULL rows (id, key) and HALF rows (id, key, flag) for the documents' homes.

    Flag 1: the anchor occurs with a smaller id, the stretch as a whole doesn't; 2: it is such a smaller one;
    4 beside them: the anchor has more than `hot` of these.
    """

    def close(family: Family, held: list):
        key, ids, lead = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        pairs = np.argsort(key)  # in order, keys are found faster
        key, ids, lead = key[pairs], ids[pairs], lead[pairs]
        full = family.least(key) < ids
        family.levels.clear()
        pairs = np.argsort(lead, kind="stable")
        key, ids, lead, full = key[pairs], ids[pairs], lead[pairs], full[pairs]
        new = np.append(True, lead[1:] != lead[:-1])
        head, group = np.flatnonzero(new), np.cumsum(new) - 1
        half = ~full & (np.minimum.reduceat(ids, head)[group] < ids)
        top = np.maximum.reduceat(np.where(half, ids, np.iinfo(np.int64).min), head)[group]
        source = ~full & (top > ids)
        flag = half + 2 * source
        flag += 4 * ((flag > 0) & (np.add.reduceat(flag > 0, head, dtype=np.int64)[group] > hot))
        # by key again: neighbours are pressed together
        pairs = np.argsort(key, kind="stable")
        key, ids, full, flag = key[pairs], ids[pairs], full[pairs], flag[pairs]
        for h, at in _groups(_home(ids, n)):
            f, s = at[full[at]], at[flag[at] > 0]
            if len(f):
                yield h, FULL, _press(ids[f], key[f])
            if len(s):
                yield h, HALF, _press(ids[s], key[s], flag[s].astype(np.uint8))

    def run(batches):
        now, family, held = None, Family(), []
        out: list = []
        for home, kind, blob in _by_home(batches):
            if home != now:
                if held:
                    out += close(family, held)
                now, family, held = home, Family(), []
            if kind == BATCH:
                key, ids, lead = _unpress(blob, "u8", "i8", "u4")
                family.insert(key, ids)
                held.append((key, ids, lead))
            else:
                out.append((home, kind, blob))
            if len(out) >= 4096:
                yield from _rows(out)
                out = []
        if held:
            out += close(family, held)
        yield from _rows(out)

    return run


def _packed(n: int, names: list[str], most: int = FLUSH_BYTES):
    """TEXT rows: the documents of each home, as compressed Arrow streams."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        held, homes, size = [], [], 0

        def flush():
            # sorted by home once: taking each home's rows from many chunks would copy all of them for each home
            home = np.concatenate(homes)
            order = np.argsort(home, kind="stable")
            home = home[order]
            table = pa.Table.from_batches(held).combine_chunks().take(pa.array(order)).combine_chunks()
            cuts = np.flatnonzero(np.append(True, home[1:] != home[:-1]))
            rows = []
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(home)], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as w:
                    w.write_table(table.slice(lo, hi - lo))
                rows.append((int(home[lo]), TEXT, zstandard.ZstdCompressor(level=3).compress(sink.getvalue())))
            yield from _rows(rows)

        for batch in batches:
            batch = batch.rename_columns(names)
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                held.append(part)
                homes.append(_home(np.array([LAST_ID if k is None else k for k in part.column(0).to_pylist()], np.int64), n))
                size += part.nbytes
                if size >= most:
                    yield from flush()
                    held, homes, size = [], [], 0
        if held:
            yield from flush()

    return run


def _unpacked(blob: bytes):
    import pyarrow as pa
    import zstandard

    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all().to_batches()


class Answers:
    """What a home has heard of its documents: sorted (id, key) with a value, the bits of all that were heard."""

    def __init__(self, kinds: tuple[str, ...]):
        self.kinds, self.held, self.table = kinds, [], None

    def add(self, blob: bytes) -> None:
        self.held.append(_unpress(blob, *self.kinds))

    def find(self, ids: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The value of each (id, key), 0 if there is none."""
        if not self.held and self.table is None:
            return np.zeros(len(ids), np.int64)
        if self.table is None:
            cols = [np.concatenate(x) for x in zip(*self.held, strict=True)]
            tag = mix64(cols[0].view(np.uint64)) ^ cols[1]
            order = np.argsort(tag, kind="stable")
            if len(cols) > 2 and (tag[order][1:] == tag[order][:-1]).any():
                order = np.lexsort((cols[1], cols[0], tag))
            tag, i, k, value = tag[order], cols[0][order], cols[1][order], cols[2][order].astype(np.int64) if len(cols) > 2 else np.ones(len(tag), np.int64)
            if len(cols) > 2 and len(tag):
                head = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (k[1:] != k[:-1])))
                tag, i, k, value = tag[head], i[head], k[head], np.bitwise_or.reduceat(value, head)
            self.table = (tag, i, k, value)
        tag, i, k, value = self.table
        want = mix64(ids.view(np.uint64)) ^ key
        at = np.minimum(np.searchsorted(tag, want), len(tag) - 1)
        hit = (i[at] == ids) & (k[at] == key)
        # different pairs of one tag stand next to each other
        while (again := ~hit & (tag[at] == want) & (at + 1 < len(tag))).any():
            at = at + again
            hit = (i[at] == ids) & (k[at] == key)
            if not (again & ~hit & (tag[at] == want)).any():
                break
        return np.where(hit, value[at], 0)


def _doubtful(n: int, most: int = FLUSH_BYTES):
    """Step 2, at the homes: the bytes of HALF stretches, for their index partitions."""

    def run(batches):
        import zstandard

        now, heard, held, size = None, Answers(("i8", "u8", "u1")), [], 0

        def flush():
            bucket, ids, key, flag, base, length = (np.concatenate(x) for x in zip(*(h[:-1] for h in held), strict=True))
            raw = np.frombuffer(b"".join(h[-1] for h in held), np.uint8)
            held.clear()
            start = np.cumsum(length) - length
            rows = []
            for b, at in _groups(bucket):
                at = at[np.argsort(key[at], kind="stable")]
                take = np.repeat(start[at] - (np.cumsum(length[at]) - length[at]), length[at]) + np.arange(length[at].sum())
                head = _press(ids[at], key[at], flag[at], base[at], length[at].astype(np.uint16))
                rows.append((b, 0, len(head).to_bytes(8, "little") + head + zstandard.ZstdCompressor(level=3).compress(raw[take].tobytes())))
            yield from _rows(rows)

        for home, kind, blob in _by_home(batches):
            if home != now:
                now, heard = home, Answers(("i8", "u8", "u1"))
            if kind == HALF:
                heard.add(blob)
                continue
            for ids, texts, _ in _documents(_unpacked(blob)):
                for at in _steps(texts):
                    a = Anchors(texts[at])
                    if not len(a.doc):
                        continue
                    own, key = ids[at][a.doc], a.stretch
                    flag = heard.find(own, key)
                    some = np.flatnonzero(flag)
                    if not len(some):
                        continue
                    # a document's equal stretches have one answer
                    some = some[np.lexsort((own[some], key[some]))]
                    some = some[np.append(True, (own[some][1:] != own[some][:-1]) | (key[some][1:] != key[some][:-1]))]
                    hot = flag[some] & 4 > 0
                    spread_out = some[hot]
                    bucket = a.bucket(n)
                    for stretches in [some[~hot], *(spread_out[i : i + HOT_STEP] for i in range(0, len(spread_out), HOT_STEP))]:
                        if not len(stretches):
                            continue
                        length = (a.last - a.first)[stretches] + MATCH
                        take = np.repeat(a.first[stretches] - (np.cumsum(length) - length), length) + np.arange(length.sum())
                        to, base, raw = bucket[stretches], np.zeros(len(stretches), np.uint8), a.raw[take].tobytes()
                        if hot.any() and flag[stretches[0]] & 4:
                            windows, which, place = _windows(raw, length)
                            to, base, raw = _window_home(windows, n), place.astype(np.uint8), windows.tobytes()
                            stretches, length = stretches[which], np.full(len(which), MATCH)
                        held.append((to, own[stretches], key[stretches], flag[stretches].astype(np.uint8), base, length, raw))
                        size += len(raw)
                        if size >= most:
                            yield from flush()
                            held, size = [], 0
        if held:
            yield from flush()

    return run


def _window_places(length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all MATCH-byte windows within the stretches: their stretch, their place in it, their start in the joined bytes."""
    count = length.astype(np.int64) - MATCH + 1
    which = np.repeat(np.arange(len(length)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return which, place, (np.cumsum(length, dtype=np.int64) - length)[which] + place


def _windows(raw: bytes, length: np.ndarray, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All MATCH-byte suffixes within the stretches, or `some` of them: their bytes, their stretch, their place in it."""
    which, place, start = _window_places(length)
    if some is not None:
        which, place, start = which[some], place[some], start[some]
    if not len(start):
        return np.zeros(0, f"S{MATCH}"), which, place
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), MATCH)
    return np.ascontiguousarray(view[start]).view(f"S{MATCH}").reshape(-1), which, place


def _window_codes(raw: bytes, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each window's bytes, its stretch, its place in it."""
    which, place, start = _window_places(length)
    body = np.frombuffer(raw, np.uint8)
    up, down = powers(1 << max(20, len(body).bit_length()))
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[: len(body)], out=sums[1:])
    return mix64((sums[start + MATCH] - sums[start]) * down[start]), which, place


def _among(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Whether each number is among the sorted ones, of which there is one at least."""
    return known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked


def _window_home(windows: np.ndarray, n: int) -> np.ndarray:
    """The index partition of each MATCH-byte window on its own."""
    code = np.zeros(len(windows), np.uint64)
    for column in windows.view(np.uint8).reshape(-1, MATCH).T:
        code = code * np.uint64(0x9E3779B97F4A7C15) + column + np.uint64(1)
    return (mix64(code) % np.uint64(n)).astype(np.int64)


def _scanned(n: int):
    """Step 2, in an index partition: FULL rows (id, key, mask) for the homes; bit i of a mask is the i-th window of the stretch."""

    def opened(blob: bytes):
        import zstandard

        size = int.from_bytes(blob[:8], "little")
        return *_unpress(blob[8 : 8 + size], "i8", "u8", "u1", "u1", "u2"), zstandard.ZstdDecompressor().decompress(blob[8 + size :])

    def close(held: list[bytes]):
        """Windows meet by 64 bits first; only those whose bits a wanted one shares with a smaller id meet as bytes."""
        if not held:
            return
        family, exact, codes, asked = Family(), Family(), [], []
        for blob in held:
            ids, _, _, _, length, raw = opened(blob)
            code, which, _ = _window_codes(raw, length)
            family.insert(code, ids[which])
            codes.append(code)
        for blob, code in zip(held, codes, strict=True):
            ids, _, flag, _, length, _ = opened(blob)
            which, _, _ = _window_places(length)
            some = np.flatnonzero(flag[which] & 1 > 0)
            asked.append(code[some][family.least(code[some]) < ids[which[some]]])
        family.levels.clear()
        asked = np.unique(np.concatenate(asked))
        if not len(asked):
            return
        for blob, code in zip(held, codes, strict=True):
            ids, _, _, _, length, raw = opened(blob)
            some = np.flatnonzero(_among(asked, code))
            suffixes, which, _ = _windows(raw, length, some)
            exact.insert(suffixes, ids[which])
        for blob, code in zip(held, codes, strict=True):
            ids, key, flag, base, length, raw = opened(blob)
            which, _, _ = _window_places(length)
            some = np.flatnonzero((flag[which] & 1 > 0) & _among(asked, code))
            suffixes, which, place = _windows(raw, length, some)
            place += base[which]
            hit = exact.least(suffixes) < ids[which]
            mask = np.zeros(len(ids), np.uint64)
            np.bitwise_or.at(mask, which[hit], np.uint64(1) << place[hit].astype(np.uint64))
            some = np.flatnonzero(mask)
            for h, at in _groups(_home(ids[some], n)):
                at = some[at]
                yield h, HALF, _press(ids[at], key[at], mask[at])

    def run(batches):
        now, held, out = None, [], []
        for home, _, blob in _by_home(batches):
            if home != now:
                out += close(held)
                now, held = home, []
            held.append(blob)
            if len(out) >= 4096:
                yield from _rows(out)
                out = []
        out += close(held)
        yield from _rows(out)

    return run


def removed_bytes(a: Anchors, full: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """True for each of the joined bytes that a settled window covers."""
    edge = np.zeros(len(a.raw) + 1, np.int32)
    np.add.at(edge, a.first[full], 1)
    np.add.at(edge, a.last[full] + MATCH, -1)
    for i in range(MATCH - ANCHOR + 1):
        at = a.first[(mask >> np.uint64(i)) & np.uint64(1) > 0] + i
        np.add.at(edge, at, 1)
        np.add.at(edge, at + MATCH, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(n: int, keep: list[str], as_text: bool):
    """Step 3, at the homes: what is left of each document."""

    def run(batches):
        import pyarrow as pa

        now, full, half = None, Answers(("i8", "u8")), Answers(("i8", "u8", "u8"))
        for home, kind, blob in _by_home(batches):
            if home != now:
                now, full, half = home, Answers(("i8", "u8")), Answers(("i8", "u8", "u8"))
            if kind == FULL:
                full.add(blob)
                continue
            if kind == HALF:
                half.add(blob)
                continue
            for ids, texts, batch in _documents(_unpacked(blob)):
                for at in _steps(texts):
                    a = Anchors(texts[at])
                    own, key = ids[at][a.doc], a.stretch
                    gone = removed_bytes(a, full.find(own, key) > 0, half.find(own, key).view(np.uint64))
                    spans, kept = [], []
                    for s, t in zip(a.start, texts[at], strict=True):
                        g = gone[s : s + len(t)]
                        if g.any():
                            turn = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
                            spans.append([{"start": int(x), "stop": int(y)} for x, y in turn.reshape(-1, 2)])
                            kept.append(a.raw[s : s + len(t)][~g].tobytes())
                        else:
                            spans.append([])
                            kept.append(t)
                    part = batch.slice(at.start, at.stop - at.start)
                    cols = [part.column(0), pa.array([len(t) for t in texts[at]], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array([b.decode(errors="ignore") for b in kept], pa.string()) if as_text else pa.array(kept, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*cols, *(part.column(2 + i) for i in range(len(keep)))], names=["k", "n_bytes", "spans", "kept", *(f"c{i}" for i in range(len(keep)))])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), as_text: bool = False, hot: int = HOT) -> DataFrame:
    """Rows (key, n_bytes, spans, kept, keep...), one for each row of docs.

    spans: the removed runs of the UTF-8 bytes, start to before stop, ascending and apart; kept: the
    other bytes (as_text: as a string, without characters of which a part was removed). Matches are judged on the input and never cross documents. Null texts are empty.
    Rows of equal keys don't remove each other's bytes; null keys are larger than all others (and
    equal to each other). Texts of fewer than MATCH bytes stay whole. An empty table gives no rows.
    Anchors with more than `hot` stretches to compare are spread by window; the result is the same.
    """
    spark = docs.sparkSession
    rows = spread(docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep))))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    portion, flush = portions(total)
    n = max(parts(spark), math.ceil(total / portion))
    path = shared_dir(spark, "suffix-answers")
    _dealt(rows.select("k", "t").transform(batchwise(_offers(n, flush), ROW)), n).transform(batchwise(_settle(n, hot), ROW)).write.parquet(path)
    answers = spark.read.schema(ROW).parquet(path)

    def with_texts(answers: DataFrame, rows: DataFrame) -> DataFrame:
        packed = rows.transform(batchwise(_packed(n, rows.columns, flush), ROW))
        return _dealt(answers.select("home", "kind", "blob").union(packed), n)

    doubtful = with_texts(answers.where(F.col("kind") == HALF), rows.select("k", "t")).transform(batchwise(_doubtful(n, flush), ROW))
    masks = _dealt(doubtful, n).transform(batchwise(_scanned(n), ROW))
    kinds = "".join(f", c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = with_texts(answers.where(F.col("kind") == FULL).union(masks), rows).transform(batchwise(_cut(n, list(keep), as_text), f"k bigint, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept {'string' if as_text else 'binary'}{kinds}"))
    return out.withColumnsRenamed({"k": key} | {f"c{i}": c for i, c in enumerate(keep)})


def digests(removed: DataFrame, key: str = "doc_id") -> DataFrame:
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return removed.select(key, "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) by comparing all strings; for tests."""
    raw = [(LAST_ID if k is None else k, (t or "").encode()) for k, t in rows]
    least: dict[bytes, int] = {}
    for k, b in raw:
        for s in range(len(b) - MATCH + 1):
            w = b[s : s + MATCH]
            least[w] = min(k, least.get(w, k))
    out = []
    for (k, b), (own, _) in zip(raw, rows, strict=True):
        gone = bytearray(len(b))
        for s in range(len(b) - MATCH + 1):
            if least[b[s : s + MATCH]] < k:
                gone[s : s + MATCH] = b"\1" * MATCH
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((own, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out
