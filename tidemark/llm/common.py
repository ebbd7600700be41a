"""Helpers that several training-data operators share."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpointed, release, shared_dir, small, spread, stored, table

__all__ = ["checkpointed", "release", "shared_dir", "small", "spread", "stored", "table"]

#: Characters of text that a Python worker handles at once (a longer single text is handled alone).
CHUNK_CHARS = 2_000_000
#: New words that are computed at once.
MAKE_WORDS = 16384
#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20
#: Quantiles of the order column that are asked for at most; beyond, buckets grow, and are still streamed.
MAX_BUCKETS = 65536


#: What a worker keeps from one task to the next, and the module of its last task.
_KEPT: dict[str, dict] = {}
_LAST: list[str] = []


def kept(module: str) -> dict:
    """A dict that lasts in a worker until it gets a task of another module."""
    return _KEPT.setdefault(module, {})


def only(module: str) -> None:
    """A task of this module begins: what those of others have left in the worker goes."""
    if _LAST == [module]:
        return
    for other, held in _KEPT.items():
        if other != module:
            held.clear()
    if Runs.asked is not None:
        Runs.asked.clear()
        Runs.asked = None
    _LAST[:] = [module]
    give_back()


def give_back() -> None:
    """Free memory goes back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect(0)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(run: Callable) -> Callable:
    """The function over batches, beside which the worker keeps its own module's things only; once it ends, free memory goes back to the system."""
    module = run.__module__

    def out(batches):
        only(module)
        try:
            yield from run(batches)
        finally:
            give_back()

    return out


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the jobs that run within; then it is as it was."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def batchwise(run: Callable, schema: str) -> Callable[[DataFrame], DataFrame]:
    """mapInArrow over batches of about BATCH_BYTES (or one row), for DataFrame.transform.

    The session's batch size is lowered to that: a batch is held several times, in the JVM's and
    the worker's memory.
    """

    def over(df: DataFrame) -> DataFrame:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return df.mapInArrow(trimmed(run), schema)

    return over


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[slice]:
    """Slices of neighbouring texts with up to `limit` characters together."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > limit:
            yield slice(start, i)
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


class Runs:
    """Runs of numbers by a 64-bit key, for what a worker computes once for each different word.

    Keys stand in an open-addressed table and runs one after another, so that a whole chunk's words are
    looked up at once. Two words of one key would share a run: among the `most` words that are
    remembered (before all are forgotten) and a chunk's own that has a probability of about 1e-14 for
    each new word. A Python worker is used again for other operators: asking one Runs empties the one
    that was asked before it, so that a worker holds one at a time.
    """

    asked: Runs | None = None

    def __init__(self, make: Callable[[list[str]], list], dtype, most: int = 250_000):
        """make gives a run for each of some different words: bytes of the dtype, or an array."""
        self.make, self.dtype, self.most = make, np.dtype(dtype), most
        self.clear()

    def clear(self) -> None:
        self.n, self.used, self.bits = 0, 0, 12
        self.key, self.place = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The number of each key's run, -1 if there is none."""
        slot = self._slot(key)
        at = self.place[slot]
        todo = np.flatnonzero((at >= 0) & (self.key[slot] != key))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            some = slot[todo]
            at[todo] = self.place[some]
            todo = todo[(at[todo] >= 0) & (self.key[some] != key[todo])]
        return at

    def _insert(self, key: np.ndarray, place: np.ndarray) -> None:
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):  # the first of those that want a free slot takes it, the others try the next
            free = self.place[slot[todo]] < 0
            some, first = np.unique(slot[todo[free]], return_index=True)
            taken = todo[free][first]
            self.key[some], self.place[some] = key[taken], place[taken]
            todo = todo[self.key[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _append(self, name: str, values: np.ndarray, used: int) -> None:
        """Into a buffer that doubles."""
        old = getattr(self, name)
        if used + len(values) > len(old):
            grown = np.zeros(max(1024, 2 * (used + len(values))), old.dtype)
            grown[:used] = old[:used]
            setattr(self, name, grown)
        getattr(self, name)[used : used + len(values)] = values

    def add(self, key: np.ndarray, runs: list) -> None:
        """Runs of different keys, none of which is there yet."""
        if 2 * (self.n + len(key)) > 1 << self.bits:
            held = np.flatnonzero(self.place >= 0)
            old_key, old_place = self.key[held], self.place[held]
            self.bits = (4 * (self.n + len(key))).bit_length()
            self.key, self.place = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
            self._insert(old_key, old_place)
        self._insert(key, np.arange(self.n, self.n + len(key), dtype=np.int32))
        if runs and isinstance(runs[0], bytes):
            size, joined = np.array([len(r) for r in runs]) // self.dtype.itemsize, np.frombuffer(b"".join(runs), self.dtype)
        else:
            size, joined = np.array([len(r) for r in runs]), np.concatenate(runs)
        self._append("begin", self.used + np.cumsum(size) - size, self.n)
        self._append("size", size, self.n)
        self._append("flat", joined, self.used)
        self.n, self.used = self.n + len(key), self.used + len(joined)

    def places(self, key: np.ndarray, words: Callable[[np.ndarray], list[str]]) -> np.ndarray:
        """The run number of each key; words gives the words at some positions. Numbers hold until the next call."""
        if Runs.asked is not self:
            if Runs.asked is not None:
                Runs.asked.clear()
            Runs.asked = self
        if self.n > self.most:
            self.clear()
        at = self.find(key)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            new, first = np.unique(key[miss], return_index=True)
            for lo in range(0, len(new), MAKE_WORDS):
                self.add(new[lo : lo + MAKE_WORDS], self.make(words(miss[first[lo : lo + MAKE_WORDS]])))
            at[miss] = self.find(key[miss])
        return at

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of these numbers one after another, and the end of each."""
        size = self.size[at]
        ends = np.cumsum(size)
        if not len(at):
            return self.flat[:0], ends
        return self.flat[np.arange(ends[-1]) + np.repeat(self.begin[at] - (ends - size), size)], ends


def sliced(text: str, start: np.ndarray, stop: np.ndarray) -> Callable[[np.ndarray], list[str]]:
    """The spans of a text at some positions, for Runs.places."""
    return lambda at: [text[lo:hi] for lo, hi in zip(start[at].tolist(), stop[at].tolist(), strict=True)]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: White space by code point; none is at or above the last entry.
_SPACES = np.array([chr(c).isspace() for c in range(0x3002)])
_ODD = 0x9E3779B97F4A7C15
_SPACE = re.compile(r"\s")


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of an odd number, and of its inverse, modulo 2^64."""
    out = []
    for base in (_ODD, pow(_ODD, -1, 1 << 64)):
        x = np.ones(n + 1, np.uint64)
        done = 1
        while done <= n:  # by doubling, in place
            step = min(done, n + 1 - done)
            np.multiply(x[:step], np.uint64(pow(base, done, 1 << 64)), out=x[done : done + step])
            done += step
        out.append(x)
    return out[0], out[1]


def word_spans(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of characters that are no white space) in an array of code points."""
    space = np.ones(len(codes) + 2, bool)
    space[1:-1] = _SPACES[codes if codes.dtype == np.uint8 else np.minimum(codes, len(_SPACES) - 1)]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def span_hashes(codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64 bits for the code points of each span."""
    n = len(codes)
    up, down = powers(1 << max(20, n.bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix64((sums[stop] - sums[start]) * down[start])


def word_hashes(texts: list[str], limit: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text.

    A word is a run of characters that are no white space (as str.split has it); equal words have
    equal hashes. About `limit` characters are held at once; a longer text is cut at white space.
    """
    hashes, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)

    def add(lo: int, parts: list[str]) -> None:
        codes = np.frombuffer(" ".join(parts).encode("utf-32-le"), np.uint32)
        start, stop = word_spans(codes)
        ends = np.cumsum([len(p) + 1 for p in parts])
        counts[lo : lo + len(parts)] += np.diff(np.searchsorted(start, ends), prepend=0)
        hashes.append(span_hashes(codes, start, stop))

    for at in chunks(texts, limit):
        part = texts[at]
        if len(part) > 1 or len(part[0]) <= limit:
            add(at.start, part)
            continue
        pos, text = 0, part[0]
        while pos < len(text):
            gap = _SPACE.search(text, pos + limit)
            end = gap.start() if gap else len(text)
            add(at.start, [text[pos:end]])
            pos = end
    return np.concatenate(hashes), counts


class OrderPlan:
    """Range buckets over an integer id, whose bounds are ids of rows (nulls sort last)."""

    def __init__(self, bounds: list[int]):
        self.bounds = bounds

    @property
    def buckets(self) -> int:
        return max(1, len(self.bounds))

    def bucket(self, key: int | None) -> int:
        return self.buckets - 1 if key is None else max(0, bisect_right(self.bounds, key) - 1)


def order_plan(df: DataFrame, key: str, text: str, bucket_bytes: int = 16 << 20) -> OrderPlan:
    """Two aggregates over the table: bounds for buckets of about `bucket_bytes` of text.

    The number of buckets follows the input (up to MAX_BUCKETS); bucket contents are
    streamed, so a large bucket costs time, not memory.
    """
    total = df.agg(F.sum(F.octet_length(text)).alias("b"), F.min(key).alias("lo")).first()
    if total["lo"] is None:
        return OrderPlan([])
    n = min(MAX_BUCKETS, max(parts(df.sparkSession), math.ceil((total["b"] or 0) / bucket_bytes)))
    cuts = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], max(10000, 16 * n)).alias("q")).first()["q"] if n > 1 else []
    return OrderPlan(sorted({total["lo"], *cuts}))


def packed_in_order(df: DataFrame, key: str, text: str, plan: OrderPlan, sentinels: bool = False) -> DataFrame:
    """Rows (bucket, late, key, packed) dealt by range bucket and sorted by (bucket, late, key, packed).

    `packed` is the text in UTF-8, compressed; a null text is an empty one. With `sentinels`, rows
    that open a bucket also go, as late rows, to the end of the bucket before (around the end).
    """
    n = plan.buckets
    opens = {b: i for i, b in enumerate(plan.bounds)}

    def pack(batches):
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            keys = batch.column(0).to_pylist()
            out: tuple[list, list, list, list] = ([], [], [], [])
            for k, t in zip(keys, batch.column(1).to_pylist(), strict=True):
                z = press((t or "").encode())
                to = [(plan.bucket(k), False)]
                if sentinels and (k in opens or not opens):
                    to.append(((opens.get(k, 0) - 1) % n, True))
                for b, late in to:
                    for col, v in zip(out, (b, late, k, z), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int32()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())],
                names=["bucket", "late", "k", "packed"],
            )

    spark = df.sparkSession
    rows = spread(df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")))
    return (
        rows.transform(batchwise(pack, "bucket int, late boolean, k long, packed binary"))
        .repartition(max(parts(spark), n), "bucket")
        .sortWithinPartitions("bucket", "late", F.asc_nulls_last("k"), "packed")
    )
