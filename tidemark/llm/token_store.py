"""Token ids in directly addressable codes.

An id is cut into chunks of CHUNK_BITS bits, lowest first. Level 0 holds the first chunk of every
id; a bitmap says which ids continue, and those have their next chunk in level 1, and so on. A rank
directory (set bits before each block of the bitmap) finds an id's place in the next level, so that
any token is read in a constant number of steps per level, with no block to decode.

Files: Parquet with one row for each segment (a run of documents in ascending id order):
`bucket, seg, doc_ids, n_tokens, code`, where `code` is the byte layout of `DirectCodes.to_bytes`.
"""

from __future__ import annotations

import re
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Runs, batchwise, chunks, order_plan, packed_in_order, shared_dir, sliced, span_hashes, word_spans

CHUNK_BITS = 8
#: Bits of a bitmap between two entries of its rank directory: one machine word.
RANK_BLOCK = 64
#: A segment is closed once it has so many tokens.
SEGMENT_TOKENS = 500_000
MAGIC = b"DAC1"
END_ID = 1
#: Units that a Python worker remembers.
CACHE_UNITS = 400_000
#: Units that the library gets at once; its objects are large.
ENCODE_UNITS = 4096
#: Characters of texts that are encoded together (a longer text alone).
CHUNK = 1 << 20
#: Plain words that the library gets as one text.
LINE_WORDS = 128


class DirectCodes:
    """Unsigned integers (below 2**32) with random access."""

    def __init__(self, n: int, levels: list[np.ndarray], bitmaps: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.levels, self.bitmaps, self.ranks = n, levels, bitmaps, ranks

    @classmethod
    def encode(cls, values: np.ndarray) -> DirectCodes:
        rest, levels, bitmaps, ranks = np.asarray(values, np.uint32), [], [], []
        while True:
            levels.append((rest & np.uint32((1 << CHUNK_BITS) - 1)).astype(np.uint8))
            rest = rest >> np.uint32(CHUNK_BITS)
            more = rest > 0
            if not more.any():
                return cls(len(values), levels, bitmaps, ranks)
            bits = np.packbits(more, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK_BLOCK // 8), np.uint8)])
            per = np.bitwise_count(bits.reshape(-1, RANK_BLOCK // 8)).sum(axis=1, dtype=np.uint32)
            bitmaps.append(bits)
            ranks.append(np.concatenate([[0], np.cumsum(per[:-1])]).astype(np.uint32))
            rest = rest[more]

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at these positions, each through the rank directories alone."""
        at = np.asarray(at, np.int64)
        out = self.levels[0][at].astype(np.uint32)
        which, shift = np.arange(len(at)), 0
        for k, (bits, rank) in enumerate(zip(self.bitmaps, self.ranks, strict=True)):
            on = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            at, which = at[on], which[on]
            block = at // RANK_BLOCK
            below = (np.uint64(1) << (at % RANK_BLOCK).astype(np.uint64)) - np.uint64(1)
            before = np.bitwise_count(bits.view("<u8")[block] & below)
            at = rank[block].astype(np.int64) + before
            shift += CHUNK_BITS
            out[which] |= self.levels[k + 1][at].astype(np.uint32) << np.uint32(shift)
        return out

    def all(self) -> np.ndarray:
        """Every value, level by level."""
        out, which, shift = self.levels[0].astype(np.uint32), np.arange(self.n), 0
        for k, bits in enumerate(self.bitmaps):
            which = which[np.unpackbits(bits, count=len(which), bitorder="little").astype(bool)]
            shift += CHUNK_BITS
            out[which] |= self.levels[k + 1].astype(np.uint32) << np.uint32(shift)
        return out

    def to_bytes(self) -> bytes:
        """MAGIC, level count, length of each level, then for each level its chunks and, but for the last, bitmap and ranks; all little-endian."""
        out = [MAGIC, struct.pack("<I", len(self.levels)), *(struct.pack("<Q", len(x)) for x in self.levels)]
        for k, x in enumerate(self.levels):
            out.append(x.tobytes())
            if k < len(self.bitmaps):
                out += [self.bitmaps[k].tobytes(), self.ranks[k].astype("<u4").tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, raw: bytes) -> DirectCodes:
        if raw[:4] != MAGIC:
            raise ValueError("not a file of direct codes")
        (k,) = struct.unpack_from("<I", raw, 4)
        sizes = struct.unpack_from(f"<{k}Q", raw, 8)
        at, levels, bitmaps, ranks = 8 + 8 * k, [], [], []
        for i, n in enumerate(sizes):
            levels.append(np.frombuffer(raw, np.uint8, n, at))
            at += n
            if i < k - 1:
                blocks = -(-n // RANK_BLOCK)
                bitmaps.append(np.frombuffer(raw, np.uint8, blocks * RANK_BLOCK // 8, at).copy())  # aligned
                at += blocks * RANK_BLOCK // 8
                ranks.append(np.frombuffer(raw, "<u4", blocks, at))
                at += 4 * blocks
        return cls(sizes[0], levels, bitmaps, ranks)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Latin-1 letters in lower case; composition leaves them alone.
_LETTERS = "a-zß-öø-ÿ"
_PLAIN = re.compile(f"[{_LETTERS}]+")
_LETTER = np.array([_PLAIN.fullmatch(chr(c)) is not None for c in range(256)])
#: ASCII punctuation after such a letter and before white space: a token run of its own.
_TAIL = np.array([chr(c) in ".,!?%&*#$;:" for c in range(256)])
#: Characters that only Python takes for white space.
_CONTROL = re.compile("[\x1c-\x1f]")


def units_of(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """A text (put in lower case where that is safe), and the starts and ends of its units.

    A unit is a string that the tokenizer encodes alone as it does within the text: it drops white
    space, and neither its normaliser nor its patterns look across. Latin-1 texts are
    put in lower case first (a letter's lower case depends on nothing around it there) and lose
    punctuation from word ends to units of its own, so that there are fewer different units. Texts
    with special tokens' openings keep their case; control characters that only Python takes for
    white space keep the text whole. Texts that are alike in this may be joined by spaces.
    """
    kind = _kind(text)
    if kind == "whole":
        return text, np.zeros(1, np.int64), np.full(1, len(text))
    if kind == "words":
        return text, *word_spans(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    text = text.lower()
    codes = np.frombuffer(text.encode("latin-1"), np.uint8)
    start, stop = word_spans(codes)
    if not len(start):
        return text, start, stop
    # the last character of each word that is no such punctuation
    last = np.maximum.accumulate(np.where(_TAIL[codes], -1, np.arange(len(codes))))[stop - 1]
    cut = np.flatnonzero((last >= start) & (last < stop - 1) & _LETTER[codes[np.maximum(last, 0)]]) if len(start) else start
    start = np.insert(start, cut + 1, last[cut] + 1)
    stop = np.insert(stop, cut, last[cut] + 1)
    return text, start, stop


def _kind(text: str) -> str:
    if _CONTROL.search(text):
        return "whole"
    if "<|" not in text:
        try:
            text.encode("latin-1")
            return "latin"
        except UnicodeEncodeError:
            pass
    return "words"


_WORKER: dict[str, Runs] = {}


def _worker(path: str) -> Runs:
    if path not in _WORKER:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)

        ends = np.zeros(tok.get_vocab_size(), bool)
        ends[[i for t, i in tok.get_vocab().items() if t.endswith("</w>")]] = True

        def each(units: list[str]) -> list[bytes]:
            return [struct.pack(f"<{len(ids)}I", *ids) for e in tok.encode_batch_fast(units, add_special_tokens=False) for ids in (e.ids,)]

        def lines(words: list[str]) -> list[bytes]:
            """Plain words, many to a text: each is one run of letters, so its tokens end with the one that closes a word."""
            groups = [words[lo : lo + LINE_WORDS] for lo in range(0, len(words), LINE_WORDS)]
            out = []
            for group, e in zip(groups, tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                cuts = [0, *((np.flatnonzero(ends[ids]) + 1) * 4).tolist()]
                raw = ids.tobytes()
                out += [raw[x:y] for x, y in zip(cuts, cuts[1:], strict=False)] if len(cuts) == len(group) + 1 else each(group)
            return out

        def make(units: list[str]) -> list[bytes]:
            out = {}
            for lo in range(0, len(units), ENCODE_UNITS):
                part = units[lo : lo + ENCODE_UNITS]
                plain = [u for u in part if _PLAIN.fullmatch(u)]
                out.update(zip(plain, lines(plain), strict=True))
                rest = [u for u in part if u not in out]
                out.update(zip(rest, each(rest), strict=True))
            return [out[u] for u in units]

        _WORKER[path] = Runs(make, "<u4", CACHE_UNITS)
    return _WORKER[path]


def encode_texts(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The library's ids of all whole texts in order (unsigned 32-bit), and how many each has.

    Each different unit is encoded (or remembered) once.
    """
    counts, found = np.zeros(len(texts), np.int64), []
    kinds = [_kind(t) for t in texts]
    for kind in ("latin", "words", "whole"):
        mine = [i for i, k in enumerate(kinds) if k == kind]
        for at in chunks([texts[i] for i in mine], CHUNK if kind != "whole" else 0):
            own = np.array(mine[at])
            text, start, stop = units_of(" ".join([texts[i] for i in own]))
            if not len(start):
                continue
            codes = np.frombuffer(text.encode("latin-1"), np.uint8) if kind == "latin" else np.frombuffer(text.encode("utf-32-le"), np.uint32)
            known = _worker(path)
            ids, ends = known.gather(known.places(span_hashes(codes, start, stop), sliced(text, start, stop)))
            # units of each text: spans that start before its end
            last = np.searchsorted(start, np.cumsum([len(texts[i]) + 1 for i in own]))
            total = np.concatenate([[0], ends])[last]
            counts[own] = np.diff(total, prepend=0)
            found.append((own, ids))
    if len(found) == 1 and len(found[0][0]) == len(texts):
        return found[0][1], counts
    out, ends = np.zeros(counts.sum(), np.uint32), np.cumsum(counts)
    for own, ids in found:
        size = counts[own]
        out[np.arange(size.sum()) - np.repeat(np.cumsum(size) - ends[own], size)] = ids
    return out, counts


def write(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Write the ids of every whole text, each followed by end_id, in ascending key order.

    Rows of equal keys stand in the order of their compressed texts; null keys come last. A null or
    empty text has the end id only. An empty table writes no segment. Other columns are ignored.
    """
    tok = tokenizer or default_tokenizer()
    plan = order_plan(df, key, text)

    def run(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        end = np.array([end_id], np.uint32)
        bucket, seg, ids, parts, total = None, 0, [], [], 0

        def close():
            code = DirectCodes.encode(np.concatenate(parts)).to_bytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([seg], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(p) for p in parts]], pa.list_(pa.int64())), pa.array([code], pa.binary())],
                names=["bucket", "seg", "doc_ids", "n_tokens", "code"],
            )

        for batch in (whole.slice(lo, 512) for whole in batches for lo in range(0, whole.num_rows, 512)):
            bs, ks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            texts = [unpack(z).decode() for z in batch.column(3).to_pylist()]
            for at in chunks(texts, CHUNK):
                got, counts = encode_texts(texts[at], tok)
                for b, k, own in zip(bs[at], ks[at], np.split(got, np.cumsum(counts)[:-1]), strict=True):
                    if parts and (b != bucket or total >= SEGMENT_TOKENS):
                        yield close()
                        ids, parts, total, seg = [], [], 0, seg + 1 if b == bucket else 0
                    elif not parts:
                        seg = 0
                    bucket = b
                    ids.append(k)
                    parts.append(np.append(own, end))
                    total += len(own) + 1
        if parts:
            yield close()

    rows = packed_in_order(df, key, text, plan)
    rows.transform(batchwise(run, "bucket int, seg int, doc_ids array<bigint>, n_tokens array<bigint>, code binary")).write.parquet(path)


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Rows (key, start, n_tokens, ids_crc32), one for each stored document; each is read by random access.

    start: ids of all documents before it, in file order. ids_crc32: of its ids in 4 little-endian bytes.
    Keys are null or repeat as they were written; a document of a null or empty text has its end id.
    An empty store gives no rows.
    """

    def run(batches):
        import zlib

        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                bucket, seg, docs, n, raw = (batch.column(c)[i].as_py() for c in range(5))
                code = DirectCodes.from_bytes(raw)
                at = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
                crc, lo = [], 0
                while lo < len(n):  # several documents at a time; long ones alone
                    hi = lo + 1
                    while hi < len(n) and at[hi + 1] - at[lo] <= 65536:
                        hi += 1
                    got = code.access(np.arange(at[lo], at[hi])).astype("<u4").tobytes()
                    crc += [zlib.crc32(got[4 * (at[j] - at[lo]) : 4 * (at[j + 1] - at[lo])]) for j in range(lo, hi)]
                    lo = hi
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket] * len(n), pa.int32()), pa.array([seg] * len(n), pa.int32()), pa.array(docs, pa.int64()), pa.array(at[:-1]), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                    names=["bucket", "seg", "k", "inside", "n_tokens", "ids_crc32"],
                )

    stored = spark.read.parquet(path)
    totals = stored.select("bucket", "seg", F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)").alias("n"))
    # A row for each segment of half a million tokens: few enough for one running sum.
    before = totals.select("bucket", "seg", (F.sum("n").over(Window.orderBy("bucket", "seg")) - F.col("n")).alias("before"))
    docs = stored.select("bucket", "seg", "doc_ids", "n_tokens", "code").transform(batchwise(run, "bucket int, seg int, k bigint, inside bigint, n_tokens bigint, ids_crc32 bigint"))
    return docs.join(before, ["bucket", "seg"]).select(F.col("k").alias(key), (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    path = shared_dir(df.sparkSession, "token-store")
    write(df, path, key, text, tokenizer)
    return read(df.sparkSession, path, key)
