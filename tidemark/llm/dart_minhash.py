"""Near-duplicate classes by DartMinHash signatures of word shingles.

A text is a multiset of five-word shingles: weighted elements whose weight is their count. Hashed
darts fall with density one on the plane (weight position, rank) of every element, in dyadic regions
common to all texts; a text owns the darts below its element's weight. Each dart has a coordinate;
the dart of least rank in each coordinate is the signature, and two texts agree on a coordinate with
the probability of their weighted Jaccard similarity. Bands of coordinates propose pairs, and every
proposed pair that can matter is compared exactly.

Pairs are never emitted for a whole bucket. First each text meets one pivot of its bucket, which
joins tight groups at a cost in proportion to their size. Buckets that still hold texts of different
components are then gone through by Python workers, in blocks of bounded size (a large bucket becomes
pairs of blocks): texts of different components whose sketches allow the similarity are compared
exactly, in the first band in which they meet, and only links that join components leave the
worker, fewer than a block pair has members. A pair at the similarity asked for fails the sketch
test with probability below 1e-5. No bucket is gathered in one task.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batchwise, checkpointed, chunks, mix64, shared_dir, spread, word_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: 24 bands of 4: a pair at similarity 0.8 is missed with probability (1 - 0.8^4)^24, about 3e-6.
BANDS, BAND_ROWS = 24, 4
COORDINATES = BANDS * BAND_ROWS
#: Rank regions end here, and then double.
RANK_ENDS = (2.0**-6, 2.0**-3, 0.5, 1.0)
#: Bits that a sketch keeps of each coordinate.
SKETCH_BITS = 4
#: Standard deviations below its expected agreements at which a pair is not compared.
SIGMAS = 4.7
#: Shingles that a comparing task remembers.
HELD_SHINGLES = 1_000_000
#: Members and shingles of one block of a bucket, on average.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 1 << 20
#: Bytes of a block pair's bitmaps; where they would be larger, pairs are compared one by one.
BITMAP_BYTES = 64 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text: distinct shingle hashes in ascending order, and their counts.

    Words are runs of non-space; a text of fewer than five words has one shingle of all of them; one
    without words has none.
    """
    w, counts = word_hashes(texts)
    h = np.zeros(max(0, len(w) - SHINGLE_WORDS + 1), np.uint64)
    for i in range(SHINGLE_WORDS):
        h = h * _MULT + w[i : i + len(h)]
    h = mix64(h)
    out, at = [], 0
    for n in counts.tolist():
        if n >= SHINGLE_WORDS:
            out.append(_counted(h[at : at + n - SHINGLE_WORDS + 1]))
        elif n:
            one = np.zeros(1, np.uint64)
            for x in w[at : at + n]:
                one = one * _MULT + x
            out.append((mix64(one), np.ones(1, np.int64)))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        at += n
    return out


def _counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in ascending order, and their counts."""
    h = np.sort(h)
    head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return (h, np.ones(len(h), np.int64)) if len(head) == len(h) else (h[head], np.diff(head, append=len(h)))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: sum of minima over sum of maxima; 0 if either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    both = np.minimum(a[1][same], b[1][at[same]]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


@lru_cache(maxsize=4096)
def _poisson(area: float) -> np.ndarray:
    """Distribution function of the number of darts in a region, as thresholds of 64-bit hashes."""
    j = np.arange(int(area + 12 * area**0.5 + 24))
    total = np.cumsum(np.exp(j * np.log(area) - area - np.concatenate([[0.0], np.cumsum(np.log(j[1:]))])))
    return np.minimum(total * 2.0**64, 2.0**64 - 2048).astype(np.uint64)


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """n x k signature (uint64) of n documents with at least one element each; elements sorted by document.

    A dart's hash is its identity, its rank within its region and, by the low 32 bits, its coordinate;
    so the least hash of a coordinate is the dart of least rank.
    """
    doc, element, weight = np.asarray(doc, np.int64), np.asarray(element, np.uint64), np.asarray(weight, np.float64)
    best, filled = np.zeros(n * k, np.uint64), np.zeros(n * k, bool)
    none, low = np.uint64(2**64 - 1), np.uint64(0xFFFFFFFF)
    level, lo = 0, 0.0
    with np.errstate(over="ignore"):
        while len(doc):
            hi = RANK_ENDS[level] if level < len(RANK_ENDS) else lo * 2
            least = np.full(n * k, none)
            part, w_lo, w_hi = slice(None), 0.0, 1.0
            while True:  # weight regions [0,1), [1,2), [2,4), ...
                e, d, w = element[part], doc[part], weight[part]
                if not len(e):
                    break
                until = _poisson((w_hi - w_lo) * (hi - lo))
                h = e * (mix64(np.array([(level << 40) + int(w_hi)], np.uint64) * _MULT) | np.uint64(1))
                some = np.flatnonzero(h >= until[0])
                h = h[some]
                count = np.searchsorted(until, h, side="right")
                h, some = np.repeat(h, count), np.repeat(some, count)
                j = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
                h = mix64(h ^ (j + 1).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
                if (w < w_hi).any():  # some own a part of the region only
                    own = w_lo + (w_hi - w_lo) * (mix64(h + np.uint64(1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < w[some]
                    h, some = h[own], some[own]
                np.minimum.at(least, d[some] * k + ((h & low) * np.uint64(k) >> np.uint64(32)).astype(np.int64), h)
                w_lo, w_hi = w_hi, w_hi * 2
                part = np.flatnonzero(weight > w_lo)
            new = ~filled & (least != none)  # earlier regions have lower ranks
            best[new] = least[new]
            filled |= new
            keep = ~filled.reshape(n, k).all(axis=1)[doc]
            if not keep.all():
                doc, element, weight = doc[keep], element[keep], weight[keep]
            level, lo = level + 1, hi
    return best.reshape(n, k)


def bands(sigs: np.ndarray) -> np.ndarray:
    """n x BANDS keys (int64)."""
    h = np.zeros((len(sigs), BANDS), np.uint64)
    rows = sigs.reshape(len(sigs), BANDS, BAND_ROWS)
    with np.errstate(over="ignore"):
        for i in range(BAND_ROWS):
            h = mix64(h * _MULT + rows[:, :, i])
    return h.view(np.int64)


def sketches(sigs: np.ndarray) -> np.ndarray:
    """n x 6 (int64): the low SKETCH_BITS of each coordinate."""
    per = 64 // SKETCH_BITS
    low = (sigs & np.uint64((1 << SKETCH_BITS) - 1)).reshape(len(sigs), sigs.shape[1] // per, per)
    return (low << (np.arange(per, dtype=np.uint64) * np.uint64(SKETCH_BITS))).sum(axis=2, dtype=np.uint64).view(np.int64)


def agreements(a: str, b: str) -> Column:
    """Coordinates whose sketches agree."""
    out = F.lit(COORDINATES)
    for i in range(COORDINATES * SKETCH_BITS // 64):
        x = F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111))
        out = out - F.bit_count(x)
    return out


def least_agreements(threshold: float, sigmas: float) -> int:
    """What a pair of this similarity falls short of by chance at so many standard deviations."""
    p = threshold + (1 - threshold) / (1 << SKETCH_BITS)
    return max(0, int(COORDINATES * p - sigmas * (COORDINATES * p * (1 - p)) ** 0.5))


def text_id(text: str) -> Column:
    """128 bits that stand for the text; null like empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def band_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tid, bands, sketch, size) for each row; tid its text_id, size its shingles; bands and sketch null for a text without words."""

    def run(batches):
        import pyarrow as pa

        def lists(some: np.ndarray, rows: np.ndarray, n: int):
            """One list for each of n texts, null where there is no row."""
            has = np.zeros(n, bool)
            has[some] = True
            ends = np.concatenate([[0], np.cumsum(has) * rows.shape[1]]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1), pa.int64()), mask=pa.array(~has))

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at in chunks(texts, 500_000):
                sets = shingles(texts[at])
                size = np.array([len(h) for h, _ in sets], np.int64)
                some = np.flatnonzero(size)
                sig = np.zeros((0, COORDINATES), np.uint64)
                if len(some):
                    sig = signatures(np.repeat(np.arange(len(some)), size[some]), np.concatenate([h for h, _ in sets]), np.concatenate([n for _, n in sets]), len(some))
                total = np.array([n.sum() for _, n in sets], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(at.start, at.stop - at.start) for c in (0, 2)), lists(some, bands(sig), len(sets)), lists(some, sketches(sig), len(sets)), pa.array(total)],
                    names=["k", "tid", "bands", "sketch", "size"],
                )

    rows = spread(docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))).select("k", "t", text_id("t").alias("tid"))
    return rows.transform(batchwise(run, "k bigint, tid binary, bands array<bigint>, sketch array<bigint>, size bigint"))


def _packed(docs: DataFrame, text: str) -> DataFrame:
    """(tid, z): each different text once, compressed."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                texts = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(texts), pa.binary()), pa.array([press((t or "").encode()) for t in texts.values()], pa.binary())], names=["tid", "z"])

    return spread(docs.select(text_id(text).alias("tid"), F.col(text).cast("string").alias("t"))).transform(batchwise(run, "tid binary, z binary"))


def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, j) with the exact similarity of each pair of text ids."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        held: dict = {}
        size = 0

        def of(tid, z):
            nonlocal size
            if tid not in held:
                got = shingles([unpack(z).decode()])[0]
                size += len(got[0])
                while held and size > HELD_SHINGLES:  # the oldest go
                    size -= len(held.pop(next(iter(held)))[0])
                held[tid] = got
            return held[tid]

        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                a, b, za, zb = (batch.column(i).to_pylist() for i in range(4))
                out = [similarity(of(i, x), of(j, y)) for i, j, x, y in zip(a, b, za, zb, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "j"])

    left = pairs.join(texts.select(F.col("tid").alias("a"), F.col("z").alias("za")), "a")
    both = left.join(texts.select(F.col("tid").alias("b"), F.col("z").alias("zb")), "b")
    return both.select("a", "b", "za", "zb").transform(batchwise(run, "a binary, b binary, j double"))


class _Block:
    """Members of one bucket (side -1), or of two blocks of it, and what is known of their components."""

    def __init__(self, band: int, side: np.ndarray, label: list[bytes], sketch: np.ndarray, tags: np.ndarray, sets: list[tuple[np.ndarray, np.ndarray]]):
        self.side, self.sketch, self.tags, self.band = side, sketch, tags.view(np.uint32).reshape(len(tags), -1), band
        names = {x: i for i, x in enumerate(dict.fromkeys(label))}
        self.names, self.root = list(names), np.array([names[x] for x in label])
        self.sets, self.size = sets, np.array([n.sum() for _, n in sets], np.int64)
        self.bits = self._bitmaps()

    def _bitmaps(self) -> np.ndarray | None:
        """For each member, which of the shingles it has that several members have (the n-th of equal ones is one of its own)."""
        owner = np.repeat(np.arange(len(self.sets)), self.size)
        rest = []
        for h, n in self.sets:
            if len(h) < n.sum():
                which = np.repeat(np.arange(len(h)), n)
                nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                h = np.where(nth > 0, mix64(h[which] + nth.astype(np.uint64) * _MULT), h[which])
            rest.append(h)
        _, place, count = np.unique(np.concatenate(rest), return_inverse=True, return_counts=True)
        shared = count > 1
        words = -(-int(shared.sum()) // 64)
        if len(self.sets) * words * 8 > BITMAP_BYTES:
            return None
        column = (np.cumsum(shared) - 1)[place]
        some = shared[place]
        bits = np.zeros((len(self.sets), max(1, words)), np.uint64)
        np.bitwise_or.at(bits.reshape(-1), owner[some] * bits.shape[1] + (column[some] >> 6), np.uint64(1) << (column[some] & 63).astype(np.uint64))
        return bits

    def similarities(self, i: int, js: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.array([similarity(self.sets[i], self.sets[j]) for j in js])
        out = np.empty(len(js))
        step = max(1, (8 << 20) // self.bits.shape[1] // 8)
        for lo in range(0, len(js), step):
            at = js[lo : lo + step]
            both = np.bitwise_count(self.bits[at] & self.bits[i]).sum(axis=1, dtype=np.int64)
            out[lo : lo + step] = both / (self.size[i] + self.size[at] - both)
        return out

    def links(self, threshold: float, least: int) -> list[tuple[bytes, bytes]]:
        """Labels that pairs at the threshold join; never more than there are labels less one."""
        out, m = [], len(self.root)
        each = np.uint64(0x1111111111111111)
        # the most typical member first: it joins most of a group of copies
        typical = np.packbits(np.unpackbits(self.sketch.view(np.uint8), axis=1).mean(axis=0) > 0.5).view(np.uint64)
        far = self._differ(typical[None, :], self.sketch, each)
        order, within = np.argsort(far, kind="stable"), (self.side < 0).all()
        for step, i in enumerate(order[:-1]):
            js = order[step + 1 :]
            js = js[(self.root[js] != self.root[i]) & (within | (self.side[js] != self.side[i]))]
            if not len(js):
                continue
            js = js[COORDINATES - self._differ(self.sketch[i][None, :], self.sketch[js], each) >= least]
            if not len(js):
                continue
            js = js[(self.tags[js] == self.tags[i]).argmax(axis=1) == self.band]
            for j in js[self.similarities(i, js) >= threshold] if len(js) else ():
                a, b = self.root[i], self.root[j]
                if a != b:
                    out.append((self.names[a], self.names[b]))
                    self.root[self.root == b] = a
        assert len(out) < m
        return out

    @staticmethod
    def _differ(a: np.ndarray, b: np.ndarray, each: np.uint64) -> np.ndarray:
        """Coordinates whose sketches differ."""
        x = a ^ b
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        return np.bitwise_count(x & each).sum(axis=1, dtype=np.int64)


def block_links(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b): labels to join, from rows (band, bucket, lo, hi, side, label, z, s0.., t0..) sorted by (band, bucket, lo, hi).

    lo and hi are two blocks of a bucket (or one), side the member's own.
    """
    words, tags = COORDINATES * SKETCH_BITS // 64, BANDS // 2
    least = least_agreements(threshold, SIGMAS)

    def run(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        now, held = None, []

        def close():
            side, label, z, numbers = ([x for h in held for x in h[0]], [x for h in held for x in h[1]], [x for h in held for x in h[2]], np.concatenate([h[3] for h in held]))
            if len(set(label)) < 2:
                return [], []
            sets = []
            for lo in range(0, len(z), 256):
                sets += shingles([unpack(x).decode() for x in z[lo : lo + 256]])
            side = np.array(side) if now[2] != now[3] else np.full(len(side), -1)
            found = _Block(now[0], side, label, np.ascontiguousarray(numbers[:, :words]), np.ascontiguousarray(numbers[:, words:]), sets).links(threshold, least)
            return [a for a, _ in found], [b for _, b in found]

        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in range(4)])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            numbers = np.column_stack([batch.column(c).to_numpy() for c in range(7, 7 + words + tags)]).astype(np.int64).view(np.uint64)
            out: tuple[list, list] = ([], [])
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                key = tuple(keys[lo].tolist())
                if key != now and held:
                    for x, y in zip(out, close(), strict=True):
                        x += y
                    held = []
                now = key
                part = batch.slice(lo, hi - lo)
                held.append((part.column(4).to_pylist(), part.column(5).to_pylist(), part.column(6).to_pylist(), numbers[lo:hi]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], names=["a", "b"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in close()], names=["a", "b"])

    return rows.transform(batchwise(run, "a binary, b binary"))


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(tid, label) after the links (a, b) between labels have joined them; a component's label is one of its own.

    Each round every label that has a smaller neighbour takes the least one, follows that choice
    twice, and the links between labels that still differ are what the next round gets; so links
    shrink from round to round, and rounds end when none is left.
    """
    links = checkpointed(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not links.isEmpty():
        hook = links.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("v"), "m")
        hook = checkpointed(hook)
        for _ in range(2):
            further = hook.select(F.col("v").alias("w"), F.col("m").alias("n"))
            hook = hook.join(further, F.col("m") == F.col("w"), "left").select("v", F.coalesce("n", "m").alias("m"))
        hook = checkpointed(hook)
        ends = links.join(hook.select(F.col("v").alias("a"), F.col("m").alias("ma")), "a", "left").join(hook.select(F.col("v").alias("b"), F.col("m").alias("mb")), "b", "left")
        ends = ends.select(F.coalesce("ma", "a").alias("x"), F.coalesce("mb", "b").alias("y")).where("x != y")
        links = checkpointed(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        labels = checkpointed(labels.join(hook, F.col("label") == F.col("v"), "left").select("tid", F.coalesce("m", "label").alias("label")))
    return labels


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """Rows (key, class_id), one for each row of docs.

    class_id: the smallest key of the class, the classes being the connected components of pairs of
    texts of similarity >= threshold. Equal texts are always of one class, whatever their number.
    Null texts are empty; texts without words are linked to equal texts only. Null keys
    don't name a class unless all its keys are null. An empty table gives no rows.
    """
    found = labelled(docs, key, text, threshold)
    least = found.groupBy("label").agg(F.min("k").alias("class_id"))
    return found.join(least.withColumnRenamed("label", "c"), F.col("label") == F.col("c")).select(F.col("k").alias(key), "class_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """The docs' rows, one for each class: that with the smallest key (null keys last, then the smallest text_id)."""
    first = F.min(F.struct(F.col("k").isNull(), F.col("k"), F.col("tid")))
    stay = labelled(docs, key, text, threshold).groupBy("label").agg(first.alias("f")).select(F.col("f.k").alias("stay_k"), F.col("f.tid").alias("stay_t"))
    tid = "text_id of " + ",".join(docs.columns)  # a name that no column has
    rows = docs.withColumn(tid, text_id(text))
    return rows.join(stay, F.col(f"`{key}`").eqNullSafe(F.col("stay_k")) & (F.col(f"`{tid}`") == F.col("stay_t")), "left_semi").dropDuplicates([key, tid]).select(*(f"`{c}`" for c in docs.columns))


def labelled(docs: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """(k, tid, label) of each row: its key, its text's id, its class's least text id."""
    spark = docs.sparkSession
    path = shared_dir(spark, "dart-bands")
    band_table(docs, key, text).write.parquet(path)
    stored = spark.read.parquet(path)
    words, tags = range(COORDINATES * SKETCH_BITS // 64), range(BANDS // 2)
    distinct = stored.where("bands IS NOT NULL").groupBy("tid").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("size").alias("size"))
    keyed = distinct.select("tid", "size", *(F.col("sketch")[i].alias(f"s{i}") for i in words), F.posexplode("bands").alias("band", "bucket"))
    one = F.struct("tid", *(f"s{i}" for i in words))
    pivots = keyed.groupBy("band", "bucket").agg(F.min(one).alias("p"), F.max("tid").alias("last")).where("p.tid != last").select("band", "bucket", F.col("p.tid").alias("pivot"), *(F.col(f"p.s{i}").alias(f"p{i}") for i in words))
    members_path = shared_dir(spark, "dart-members")
    # Only buckets that hold two texts or more.
    near = agreements("s", "p") >= least_agreements(threshold, SIGMAS)
    keyed.join(pivots, ["band", "bucket"]).select("band", "bucket", "tid", "size", F.when(near & (F.col("tid") != F.col("pivot")), F.col("pivot")).alias("pivot")).write.parquet(members_path)
    members = spark.read.parquet(members_path)
    nodes_path = shared_dir(spark, "dart-nodes")
    # 32 bits of each band, two to a word, tell in which band a pair meets first.
    low = lambda i: F.col("bands")[i].bitwiseAND(F.lit(0xFFFFFFFF))
    tagged = distinct.select("tid", *(F.col("sketch")[i].alias(f"s{i}") for i in words), *(F.shiftleft(low(2 * i + 1), 32).bitwiseOR(low(2 * i)).alias(f"t{i}") for i in tags))
    tagged.join(members.select("tid").distinct(), "tid", "left_semi").write.parquet(nodes_path)
    nodes = spark.read.parquet(nodes_path)
    texts_path = shared_dir(spark, "dart-texts")
    _packed(docs, text).join(nodes.select("tid"), "tid", "left_semi").groupBy("tid").agg(F.first("z").alias("z")).write.parquet(texts_path)
    texts = spark.read.parquet(texts_path)

    def joined(labels: DataFrame, pairs: DataFrame) -> DataFrame:
        """Labels after the pairs that reach the threshold are linked."""
        found = compare(pairs, texts).where(F.col("j") >= threshold).select("a", "b")
        of = lambda end: labels.select(F.col("tid").alias(end), F.col("label").alias(f"l{end}"))
        return components(labels, found.join(of("a"), "a").join(of("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))

    labels = joined(nodes.select("tid", F.col("tid").alias("label")), members.where("pivot IS NOT NULL").select(F.col("tid").alias("a"), F.col("pivot").alias("b")).distinct())
    rated = members.select("band", "bucket", "tid", "size").join(labels, "tid")
    mixed = rated.groupBy("band", "bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).where("lo != hi")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_MEMBERS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    rated = rated.join(mixed.select("band", "bucket", blocks.alias("blocks")), ["band", "bucket"]).join(nodes, "tid").join(texts, "tid")
    side = F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int")
    rated = rated.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    numbers = [F.col(f"s{i}") for i in words] + [F.col(f"t{i}") for i in tags]
    rated = rated.select(F.col("band").cast("long"), "bucket", F.least("side", "other").cast("long").alias("lo"), F.greatest("side", "other").cast("long").alias("hi"), "side", "label", "z", *numbers)
    rated = rated.repartition("band", "bucket", "lo", "hi").sortWithinPartitions("band", "bucket", "lo", "hi")
    labels = components(labels, block_links(rated, threshold))
    return stored.select("k", "tid").join(labels.withColumnRenamed("tid", "n"), F.col("tid") == F.col("n"), "left").select("k", "tid", F.coalesce("label", "tid").alias("label"))
