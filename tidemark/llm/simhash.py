"""SimHash fingerprints, and a search by permuted block tables.

Terms are pairs of neighbouring words (a text of one word: that word), weighted 1 + ln(count). Each
term's 64-bit hash votes +weight or -weight on every bit; the fingerprint holds the bits whose vote
is positive. A text without words has fingerprint 0.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batchwise, chunks, mix64, order_plan, packed_in_order, word_hashes

BITS = 64
#: Queries of one bucket that a task holds.
BUCKET_QUERIES = 1 << 18
_BYTE_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64) * 2 - 1)


def term_hashes(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of neighbouring word pairs, from word hashes."""
    if len(words) < 2:
        return mix64(words)
    return mix64(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])


def fingerprint(words: np.ndarray) -> int:
    """Signed votes of the weighted terms, byte by byte of their hashes."""
    if not len(words):
        return 0
    terms, count = np.unique(term_hashes(words), return_counts=True)
    weight = 1 + np.log(count)
    octets = terms.astype("<u8").view(np.uint8).reshape(-1, 8)
    votes = np.concatenate([np.bincount(octets[:, i], weights=weight, minlength=256) @ _BYTE_SIGNS for i in range(8)])
    return int(np.packbits(votes > 1e-9, bitorder="little").view("<u8")[0])


def fingerprints(texts: list[str]) -> list[int]:
    out: list[int] = []
    for at in chunks(texts):
        hashes, counts = word_hashes(texts[at])
        ends = np.cumsum([0, *counts])
        out += [fingerprint(hashes[lo:hi]) for lo, hi in zip(ends, ends[1:], strict=False)]
    return out


def likeness(a: int, b: int) -> float:
    """Share of equal bits."""
    return 1 - (a ^ b).bit_count() / BITS


def fingerprint_table(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, fingerprint long): one for each row; a null text is an empty one."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fp = np.array(fingerprints([t or "" for t in batch.column(1).to_pylist()]), np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["k", "fingerprint"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.transform(batchwise(run, f"k {kind}, fingerprint bigint")).withColumnRenamed("k", key)


def block_masks(radius: int, blocks: int | None = None) -> list[int]:
    """One mask (signed 64-bit) for each choice of blocks - radius of the blocks that the bits are cut into.

    Two fingerprints within the radius agree on all bits of at least one choice. More blocks mean
    longer keys and more tables: radius + 2 (26 bits for radius 3) suit some ten million fingerprints,
    radius + 4 (36 bits) some ten thousand million.
    """
    b = blocks or radius + 2
    if not 0 <= radius < b <= BITS:
        raise ValueError("0 <= radius < blocks <= 64 is needed")
    edges = [round(i * BITS / b) for i in range(b + 1)]
    masks = []
    for chosen in combinations(range(b), b - radius):
        m = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def _tables(fps: DataFrame, fp: str, masks: list[int], kind: int) -> DataFrame:
    """(t, bits, kind, fp): each distinct fingerprint in every table, as if its blocks were permuted to the front."""
    keys = F.array(*(F.struct(F.lit(n).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for n, m in enumerate(masks)))
    each = fps.where(F.col(fp).isNotNull()).select(F.col(fp).cast("long").alias("fp")).distinct()
    return each.select("fp", F.explode(keys).alias("e")).select("e.t", "e.bits", F.lit(kind).alias("kind"), "fp")


def within_radius(fps: DataFrame, queries: DataFrame, radius: int = 3, blocks: int | None = None, fp: str = "fingerprint") -> DataFrame:
    """Pairs (query_fp, fp, distance) of distinct fingerprints at most `radius` bits apart.

    The 64 bits are cut into `blocks`; for every choice of blocks - radius of them there is a table
    keyed by their bits, so none is missed. Equal fingerprints are one row on either side, whatever
    number of documents share them; nulls take no part. For counts alone see count_within, which
    emits no pairs.
    """
    masks = block_masks(radius, blocks)
    a, b = _tables(queries, fp, masks, 0).withColumnRenamed("fp", "query_fp").drop("kind"), _tables(fps, fp, masks, 1).drop("kind")
    far = F.bit_count(F.col("query_fp").bitwiseXOR(F.col("fp")))
    return a.join(b, ["t", "bits"]).where(far <= radius).select("query_fp", "fp", far.cast("int").alias("distance")).distinct()


def count_within(fps: DataFrame, queries: DataFrame, radius: int = 3, blocks: int | None = None, fp: str = "fingerprint") -> DataFrame:
    """(query_fp, near): for each distinct query fingerprint, how many other distinct ones are at most `radius` bits apart.

    Tables as in within_radius. A bucket's queries are held and the others stream past them, so what
    leaves a task is one row for each query it holds; a pair counts in the first table that it
    meets in. Buckets with more than BUCKET_QUERIES queries are shared out to several tasks.
    """
    masks = block_masks(radius, blocks)
    spark = fps.sparkSession
    own = _tables(queries, fp, masks, 0)
    # buckets of so many queries are few: at most one for each BUCKET_QUERIES rows
    hot = own.groupBy("t", "bits").agg(F.ceil(F.count(F.lit(1)) / BUCKET_QUERIES).cast("int").alias("salts")).where("salts > 1")
    hot = F.broadcast(hot.select(F.col("t").alias("ht"), F.col("bits").alias("hb"), "salts"))
    salted = lambda d: d.join(hot, (F.col("t") == F.col("ht")) & (F.col("bits") == F.col("hb")), "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    own = salted(own).withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int"))
    other = salted(_tables(fps, fp, masks, 1)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    cols = ["t", "bits", "salt", "kind", "fp"]
    bits = np.array([m & ((1 << 64) - 1) for m in masks], np.uint64)

    def run(batches):
        import pyarrow as pa

        now, held, near, out = None, [], None, ([], [])

        def close():
            if near is not None:
                out[0].append(held)
                out[1].append(near)

        for batch in batches:
            t, b, salt, kind = (batch.column(c).to_numpy() for c in range(4))
            values = batch.column(4).to_numpy().view(np.uint64)
            new = np.ones(len(t) + 1, bool)
            new[1:-1] = (t[1:] != t[:-1]) | (b[1:] != b[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1])
            edge = np.flatnonzero(new) if len(t) else np.zeros(0, np.int64)
            for lo, hi in zip(edge.tolist(), edge[1:].tolist(), strict=False):
                key = (int(t[lo]), int(b[lo]), int(salt[lo]))
                if key != now:
                    close()
                    now, held, near = key, np.zeros(0, np.uint64), None
                if kind[lo] == 0:
                    held = np.concatenate([held, values[lo:hi]])
                    continue
                if not len(held):
                    continue
                near = np.zeros(len(held), np.int64) if near is None else near
                # blocks of bounded size: queries by candidates
                for i in range(0, len(held), 1024):
                    for j in range(lo, hi, 1024):
                        apart = held[i : i + 1024, None] ^ values[None, j : min(hi, j + 1024)]
                        q, c = np.nonzero((np.bitwise_count(apart) <= radius) & (apart != 0))
                        if len(q):
                            first = ((apart[q, c][:, None] & bits[None, :]) == 0).argmax(axis=1) == now[0]
                            near[i : i + 1024] += np.bincount(q[first], minlength=len(near[i : i + 1024]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *out[0]]).view(np.int64)), pa.array(np.concatenate([np.zeros(0, np.int64), *out[1]]))], names=["query_fp", "near"])
            out[0].clear()
            out[1].clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *out[0]]).view(np.int64)), pa.array(np.concatenate([np.zeros(0, np.int64), *out[1]]))], names=["query_fp", "near"])

    dealt = own.select(*cols).unionByName(other.select(*cols)).repartition("t", "bits", "salt").sortWithinPartitions("t", "bits", "salt", "kind")
    found = dealt.transform(batchwise(run, "query_fp bigint, near bigint"))
    return found.groupBy("query_fp").agg(F.sum("near").alias("near"))


def with_neighbours(rows: DataFrame, every: int = 20, key: str = "doc_id", radius: int = 3) -> DataFrame:
    """Rows of edited_and_next with `near_fingerprints`: for keys that `every` divides, how many other distinct fingerprints are within the radius; else null."""
    fp = F.conv("fingerprint", 16, -10).cast("long")
    asks = F.col(key) % every == 0
    fps = rows.select(fp.alias("fingerprint"), asks.alias("asks"))
    found = count_within(fps, fps.where("asks"), radius)
    return rows.withColumn("_fp", F.when(asks, fp)).join(found, F.col("_fp") == F.col("query_fp"), "left").withColumn("near_fingerprints", F.when(asks, F.coalesce("near", F.lit(0)))).drop("_fp", "query_fp", "near")


def edited_and_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text, of its edited text and of the next document's.

    Edited: the last floor(n/4) code points give way to the first as many (or all) of the next
    document in ascending key order; the last is followed by the first. Rows of equal keys stand in
    the order of their compressed texts, null keys last; a lone row follows itself. Null texts are
    empty. An empty table gives no rows.
    """
    plan = order_plan(df, key, text)

    def run(batches):
        import hashlib

        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        before = None  # bucket, late, key, text, fingerprint

        def emit(pairs):
            edited = [a[3][: len(a[3]) - len(a[3]) // 4] + b[3][: len(a[3]) // 4] for a, b in pairs]
            fps = fingerprints(edited)
            cols = [
                pa.array([a[2] for a, _ in pairs], pa.int64()),
                pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                pa.array([f"{a[4]:016x}" for a, _ in pairs]),
                pa.array([f"{f:016x}" for f in fps]),
                pa.array([likeness(a[4], f) for (a, _), f in zip(pairs, fps, strict=True)], pa.float64()),
                pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(cols, names=["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            bs, late, ks = (batch.column(i).to_pylist() for i in range(3))
            packed = batch.column(3).to_pylist()
            for lo in range(0, len(bs), 512):
                sl = slice(lo, lo + 512)
                texts = [unpack(z).decode() for z in packed[sl]]
                pairs = []
                for row in zip(bs[sl], late[sl], ks[sl], texts, fingerprints(texts), strict=True):
                    if before is not None and before[0] == row[0] and not before[1]:
                        pairs.append((before, row))
                    before = row
                if pairs:
                    yield emit(pairs)

    rows = packed_in_order(df, key, text, plan, sentinels=True)
    out = rows.transform(batchwise(run, "k bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"))
    return out.withColumnRenamed("k", key)
