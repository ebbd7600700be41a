"""Alignment of two tokenizers' tokens by a dangling-suffix transducer.

Tokens of side A and side B spell the same bytes. The transducer's state is which side leads and the
bytes by which it is ahead; it reads the next token of the side that is behind (of A where none is
ahead). An empty residual closes a group. Transitions are memoised by state and token: residuals are
suffixes of tokens, so states recur. Both tokenizers also end a token before a single space between
other characters, and between a Latin letter and a sign, where the residual is empty: what lies between
two such places is a unit, whose groups are remembered as a whole.

Corpus-wide counts of linked id pairs come from blocks of documents. A block has each of its pairs
once, with a count; counts are summed by pair, and each block gets back the sums of its own pairs. So
a pair that stands in every document is one row for each block, not for each document.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_pieces import byte_characters
from .common import batchwise, chunks, shared_dir, spread
from .piece_codec import LETTERS

MARK = "▁"
#: Units that a Python worker remembers, their characters (each costs some 50 bytes), and transitions.
CACHE_UNITS = 200_000
CACHE_CHARS = 2_000_000
CACHE_STEPS = 1_000_000
#: Units that are encoded and aligned together, and that the libraries get as one text.
ENCODE_UNITS = 4096
GROUP_UNITS = 256
#: Characters of texts that are aligned together (a longer text alone).
CHUNK = 1 << 19
#: A block is closed once it has so many links.
BLOCK_LINKS = 500_000
#: Row groups of the blocks' files: a reader holds one, a writer too, and a block has some megabytes.
ROW_GROUP = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}
#: Signs that begin a token of their own after a Latin letter: in side A by its pattern, in side B if no piece has both.
SIGNS = re.escape('.,;:!?%*#$&)]}"')
#: Python's white space holds all that the tokenizers take for white space, so no other place is cut.
_SPACES = re.compile(r"(?<=\S)(?= \S)")
_SPACES_SIGNS = re.compile(rf"(?<=\S)(?= \S)|(?<=[{LETTERS}])(?=[{SIGNS}])")


def default_models() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class DanglingSuffix:
    """The transducer over the bytes of both sides' tokens."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.bytes = (a_bytes, b_bytes)
        self.forget()

    def forget(self) -> None:
        #: Which side a state reads (0: A, 1: B), its residual, and the state that each token leads to.
        self.reads, self.residual, self.memo = [0], [b""], [{}]
        self.number: dict[tuple[int, bytes], int] = {(0, b""): 0}
        self.steps = 0

    def step(self, state: int, token: int) -> int:
        """The next state; -1 if the bytes disagree."""
        side, ahead = self.reads[state], self.residual[state]
        new = self.bytes[side][token]
        if len(new) <= len(ahead):
            fits, rest, reads = ahead.startswith(new), ahead[len(new) :], side
        else:  # the side that was behind leads now
            fits, rest, reads = new.startswith(ahead), new[len(ahead) :], 1 - side
        to = -1
        if fits:
            where = (reads, rest) if rest else (0, b"")
            if (to := self.number.get(where, -1)) < 0:
                to = self.number[where] = len(self.memo)
                self.reads.append(where[0])
                self.residual.append(rest)
                self.memo.append({})
        self.memo[state][token] = to
        self.steps += 1
        return to

    def align(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """The places (tokens of A, tokens of B) at which groups end; None if the sides spell different bytes."""
        if self.steps > CACHE_STEPS:
            self.forget()
        memo, reads, state, i, j, ends = self.memo, self.reads, 0, 0, 0, []
        while True:
            if reads[state]:
                if j == len(b):
                    break
                token = b[j]
                j += 1
            else:
                if i == len(a):
                    break
                token = a[i]
                i += 1
            to = memo[state].get(token)
            state = self.step(state, token) if to is None else to
            if state < 0:
                return None
            if state == 0:
                ends.append((i, j))
        return ends if state == 0 and i == len(a) and j == len(b) else None


class Flat:
    """Runs of numbers one after another, in a buffer that doubles."""

    def __init__(self, dtype):
        self.values, self.ends, self.runs = np.zeros(1024, dtype), np.zeros(1025, np.int64), 0

    def extend(self, runs: list) -> None:
        new = np.fromiter(chain.from_iterable(runs), self.values.dtype)
        used = self.ends[self.runs]
        if used + len(new) > len(self.values):
            self.values = np.concatenate([self.values[:used], np.zeros(used + 2 * len(new), self.values.dtype)])
        self.values[used : used + len(new)] = new
        if self.runs + len(runs) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends[: self.runs + 1], np.zeros(self.runs + 2 * len(runs), np.int64)])
        self.ends[self.runs + 1 : self.runs + 1 + len(runs)] = used + np.cumsum([len(r) for r in runs])
        self.runs += len(runs)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of these numbers one after another, and the size of each."""
        begin, size = self.ends[at], self.ends[at + 1] - self.ends[at]
        ends = np.cumsum(size)
        return self.values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)], size


class Aligner:
    """Both tokenizers, the transducer, and what is remembered for each unit."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        back = {c: b for b, c in enumerate(byte_characters())}
        with open(a_path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            a_bytes[i] = bytes([back[c] for c in t])
        self.b = SentencePieceProcessor(model_file=b_path)
        proto = pb.ModelProto()
        with open(b_path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("side B must be a merge-type model with identity normaliser and dummy prefix")
        if any(MARK in p.piece.lstrip(MARK) for p in proto.pieces):
            raise ValueError("side B must have word marks at the start of pieces only")
        b_bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(MARK, " ").encode() for p in proto.pieces]
        mixed = re.compile(f"[{LETTERS}][{SIGNS}]")
        self.cut = _SPACES if any(mixed.search(p.piece) for p in proto.pieces if p.type == 1) else _SPACES_SIGNS
        self.transducer = DanglingSuffix(a_bytes, b_bytes)
        self.size = [np.array([len(x) for x in side], np.int64) for side in (a_bytes, b_bytes)]
        self.name = [[str(i) for i in range(len(side))] for side in (a_bytes, b_bytes)]
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.held = 0
        #: Units whose bytes disagree, and each unit's groups as text.
        self.bad: set[int] = set()
        self.groups: list[str] = []
        #: By unit: ids of both sides, ends of its groups on both sides, and linked pairs.
        self.ids, self.ends, self.links = (Flat(np.int32), Flat(np.int32)), (Flat(np.int32), Flat(np.int32)), Flat(np.int64)

    def encode(self, units: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides of each unit.

        Units that begin with one space, or a sign after a letter, and don't end in white space are asked for
        many at once, as one text; a sign gets a letter before it. Where the ids' bytes don't end with the
        units, and for all other units, each is asked for alone.
        """
        out: list[tuple[list[int], list[int]] | None] = [None] * len(units)
        plain = [i for i, u in enumerate(units) if not u[-1].isspace() and (u[0] != " " or not u[1].isspace())]
        for lo in range(0, len(plain), GROUP_UNITS):
            group = plain[lo : lo + GROUP_UNITS]
            parts = [p for i in group for p in ((units[i],) if units[i][0] == " " else (" a", units[i]))]
            text = "".join(parts)
            ends = np.cumsum([len(p.encode()) for p in parts])
            found = []
            for side, ids in enumerate((self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:]))):
                at = np.cumsum(self.size[side][ids])
                cut = np.searchsorted(at, ends)
                found.append((ids, [0, *(cut + 1).tolist()]) if at[-1] == ends[-1] and np.array_equal(at[cut], ends) else None)
            if None in found:
                continue
            k = 0
            (a, x), (b, y) = found
            for i in group:
                k += units[i][0] != " "
                out[i] = (a[x[k] : x[k + 1]], b[y[k] : y[k + 1]])
                k += 1
        for i, u in enumerate(units):
            if out[i] is None:
                lead = "" if u[0] == " " else " a"
                a, b = self.a.encode(lead + u, add_special_tokens=False).ids, self.b.encode((lead + u)[1:])
                out[i] = (a[len(lead) > 0 :], b[len(lead) > 0 :])
        return out

    def remember(self, units: list[str]) -> None:
        """Encode and align new units."""
        spelled, (name_a, name_b) = self.transducer.bytes[0], self.name
        for lo in range(0, len(units), ENCODE_UNITS):
            part = units[lo : lo + ENCODE_UNITS]
            rows: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for unit, (a, b) in zip(part, self.encode(part), strict=True):
                ends = self.transducer.align(a, b)
                self.place[unit] = len(self.groups)
                # equal sides may still spell something else than the unit
                if ends is None or b"".join([spelled[i] for i in a]) != unit.encode():
                    self.bad.add(len(self.groups))
                    a, b, ends = [], [], []
                text, links, i, j = [], [], 0, 0
                for k, m in ends:
                    left = name_a[a[i]] if k == i + 1 else ",".join([name_a[t] for t in a[i:k]])
                    text.append(f"{left}|{name_b[b[j]] if m == j + 1 else ','.join([name_b[t] for t in b[j:m]])}")
                    links.append(a[k - 1] << 32 | b[m - 1])
                    i, j = k, m
                self.groups.append(";".join(text))
                for col, v in zip(rows, (a, b, [k for k, _ in ends], [m for _, m in ends], links), strict=True):
                    col.append(v)
            for flat, runs in zip((*self.ids, *self.ends, self.links), rows, strict=True):
                flat.extend(runs)

    def units(self, texts: list[str]) -> list[np.ndarray | None]:
        """The remembered units of each text, None for a text without tokens.

        A unit whose bytes disagree holds a literal word mark, which side B spells as a space: two bytes
        less, that no other unit makes up for. So the text disagrees exactly if one of its units does.
        """
        cut = [self.cut.split(" " + t) if t else [] for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.place)
        if len(self.place) + len(new) > CACHE_UNITS or self.held + sum(map(len, new)) > CACHE_CHARS:
            self.forget()
            new = set(chain.from_iterable(cut))
        self.held += sum(map(len, new))
        self.remember(sorted(new))
        place, out = self.place, []
        for us in cut:
            at = [place[u] for u in us]
            out.append(np.array(at, np.int64) if at and (not self.bad or self.bad.isdisjoint(at)) else None)
        return out


_WORKER: dict[tuple[str, str], Aligner] = {}


def _worker(paths: tuple[str, str]) -> Aligner:
    if paths not in _WORKER:
        _WORKER[paths] = Aligner(*paths)
    return _WORKER[paths]


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return spread(df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")))


def align(df: DataFrame, key: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Rows (key, a_ids, b_ids, a_ends, b_ends), one for each row of df.

    a_ids: of a space and the text, b_ids: of the text. Group n holds A's tokens from a_ends[n - 1] to
    a_ends[n] and B's likewise. Texts that are null, empty, or spelled differently by the two sides
    have no tokens. Keys may be null or repeat. An empty table gives no rows; other columns are ignored.
    """
    paths = (a_path or default_models()[0], b_path or default_models()[1])

    def run(batches):
        import pyarrow as pa

        own = _worker(paths)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at in chunks(texts, CHUNK):
                rows: list[list] = [[], [], [], []]
                for found in own.units(texts[at]):
                    found = np.zeros(0, np.int64) if found is None else found
                    for side in range(2):
                        ids, size = own.ids[side].gather(found)
                        ends, groups = own.ends[side].gather(found)
                        rows[side].append(ids)
                        rows[2 + side].append(ends + np.repeat(np.cumsum(size) - size, groups))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at.start, at.stop - at.start), *(pa.array(c, pa.list_(pa.int32())) for c in rows)], names=["k", "a_ids", "b_ids", "a_ends", "b_ends"])

    kind = df.schema[key].dataType.simpleString()
    return _texts(df, key, text).transform(batchwise(run, f"k {kind}, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")).withColumnRenamed("k", key)


def write_blocks(df: DataFrame, path: str, key: str, text: str, paths: tuple[str, str]) -> None:
    """A row for each block: its documents' counts and digests, its different pairs (a << 32 | b) with counts, and each link's place among them."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        own, block = _worker(paths), TaskContext.get().partitionId() << 32
        docs: list[tuple] = []
        links: list[np.ndarray] = []
        keys: list = []
        held = 0

        def close():
            pairs, where, n = np.unique(np.concatenate(links), return_inverse=True, return_counts=True) if links else (np.zeros(0, np.int64),) * 3
            columns = [pa.array([x], t) for x, t in ((block, pa.int64()), (pairs, pa.list_(pa.int64())), (n, pa.list_(pa.int64())), (where.astype("<i4").tobytes(), pa.binary()))]
            values = pa.concat_arrays(keys)
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
            columns += [pa.array([[d[c] for d in docs]], pa.list_(t)) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            return pa.RecordBatch.from_arrays(columns, names=["block", "pairs", "n", "links", "keys", "n_a", "n_b", "n_links", "sha"])

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at in chunks(texts, CHUNK):
                keys.append(batch.column(0).slice(at.start, at.stop - at.start))
                for found in own.units(texts[at]):
                    if found is None:
                        docs.append((0, 0, 0, ""))
                        continue
                    mine, _ = own.links.gather(found)
                    n_a, n_b = (int((flat.ends[found + 1] - flat.ends[found]).sum()) for flat in own.ids)
                    groups = own.groups
                    docs.append((n_a, n_b, len(mine), hashlib.sha256(";".join([groups[i] for i in found.tolist()]).encode()).hexdigest()))
                    links.append(mine)
                    held += len(mine)
                if held >= BLOCK_LINKS or len(docs) >= BLOCK_LINKS:
                    yield close()
                    block, held = block + 1, 0
                    docs, links, keys = [], [], []
        if docs:
            yield close()

    kind = df.schema[key].dataType.simpleString()
    schema = f"block bigint, pairs array<bigint>, n array<bigint>, links binary, keys array<{kind}>, n_a array<bigint>, n_b array<bigint>, n_links array<bigint>, sha array<string>"
    _texts(df, key, text).transform(batchwise(run, schema)).write.options(**ROW_GROUP).parquet(path)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """Rows (pair, count, best): links of each id pair, and whether no pair of its B id has more."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "n")).alias("p")).select("p.pairs", "p.n")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("n").alias("count"))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))  # no B id has more pairs than side A has ids
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(b)))


def link_statistics(df: DataFrame, key: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Rows (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one for each row of df.

    A link is a pair of tokens that end together, so each group has one. An id pair counts its links in
    the whole table. n_best: links whose pair has the most links of its B id (ties included);
    count_sum: the counts of all links' pairs. Texts that are null, empty, or spelled differently by
    the two sides have zeros and '' for the groups. Keys may be null or repeat; repeated rows count
    each time. A very long text is one block. An empty table gives no rows; other columns are ignored.
    """
    paths = (a_path or default_models()[0], b_path or default_models()[1])
    path = shared_dir(df.sparkSession, "token-align")
    write_blocks(df, path, key, text, paths)
    blocks = df.sparkSession.read.parquet(path)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        _WORKER.clear()  # what the blocks were made with isn't needed beside their sums
        now, counts, best = None, [], []
        for batch in batches:
            ids, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = 0
            while at < batch.num_rows:
                if kinds[at] == 0:  # pairs of one block, in order
                    end = at + int(np.argmax(np.append((ids[at:] != ids[at]) | (kinds[at:] != 0), True)))
                    if now != ids[at]:
                        now, counts, best = ids[at], [], []
                    counts.append(batch.column(3).slice(at, end - at).to_numpy())
                    best.append(batch.column(4).slice(at, end - at).to_numpy(zero_copy_only=False).astype(np.int64))
                    at = end
                    continue
                some = now == ids[at]
                keys, n_a, n_b, n_links, sha = (batch.column(c).slice(at, 1).flatten() for c in range(6, 11))
                where = np.frombuffer(batch.column(5)[at].as_py(), "<i4")
                ends = np.concatenate([[0], np.cumsum(n_links.to_numpy())])
                sums = [np.diff(np.concatenate([[0], np.cumsum(np.concatenate(c)[where])])[ends]) if some else np.zeros(len(keys), np.int64) for c in (best, counts)]
                yield pa.RecordBatch.from_arrays([keys, n_a, n_b, n_links, *(pa.array(s, pa.int64()) for s in sums), sha], names=["k", "n_a", "n_b", "n_links", "n_best", "count_sum", "sha"])
                at += 1

    asked = blocks.select("block", F.posexplode("pairs").alias("pos", "pair")).join(pair_counts(blocks), "pair")
    rest = ["links", "keys", "n_a", "n_b", "n_links", "sha"]
    kinds = {f.name: f.dataType for f in blocks.schema.fields}
    a = asked.select("block", F.lit(0).alias("kind"), "pos", "count", "best", *(F.lit(None).cast(kinds[c]).alias(c) for c in rest))
    b = blocks.select("block", F.lit(1).alias("kind"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("count"), F.lit(False).alias("best"), *rest)
    dealt = a.unionByName(b).repartition("block").sortWithinPartitions("block", "kind", "pos")
    rows = dealt.transform(batchwise(run, f"k {kind}, n_a bigint, n_b bigint, n_links bigint, n_best bigint, count_sum bigint, sha string"))
    return rows.select(F.col("k").alias(key), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", F.col("sha").alias("groups_sha256"))
