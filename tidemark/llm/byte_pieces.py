"""Byte-level BPE by a sentencepiece model that is made from the rank file.

Every byte has a printable character, so a token's bytes become a piece. The model is written
directly: pieces in rank order, each scored by its negative rank, identity normalisation, no prefix
and no escape of white space. Sentencepiece then merges the best-scored adjacent pair first and the
left one of equals, which is the rule of byte-pair ranks. A text is cut into pre-tokens by the
pattern; each is encoded alone. Decoding looks each id's piece up and maps its characters back to bytes.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batchwise, chunks, spread

#: Pre-tokens that a Python worker remembers; longer ones than LONG characters are encoded anew each time.
CACHE_TOKENS = 300_000
LONG = 64
#: Characters of texts that are encoded together (a longer text alone).
CHUNK = 1 << 20
#: The unknown piece: a character that no byte is mapped to.
UNKNOWN = "▅"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it and it is no space, else the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(0x100 + other.index(b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, from lines of base64 and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model of merge type whose pieces are the tokens in rank order, and an unknown piece after them."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("each byte must be a token")
    if max(ranks.values()) >= 1 << 24:
        raise ValueError("ranks must be exact as 32-bit floats")
    shown = byte_characters()
    model = pb.ModelProto()
    for token in sorted(ranks, key=ranks.get):
        model.pieces.add(piece="".join([shown[b] for b in token]), score=-float(ranks[token]), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece=UNKNOWN, score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id = len(model.pieces) - 1
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class PreTokens:
    """Matches of the pattern, with letters and numbers as the tiktoken library knows them.

    The regex module may follow a newer Unicode version than that library. A character that Python's
    own tables don't assign, and that the regex module takes for a letter or number, is put to the
    library once; if it is neither there, another sign stands for it while the text is cut.
    """

    def __init__(self, pattern: str):
        import regex

        self.pattern, self.text = regex.compile(pattern), pattern
        self.word = regex.compile(r"[\p{L}\p{N}]")
        self.seen: set[str] = set()
        self.instead: dict[int, str] = {}

    def _ask(self, c: str) -> None:
        import tiktoken

        own = {bytes([b]): b for b in range(256)} | {(lead + c).encode(): 256 + i for i, lead in enumerate("a1!")}
        library = tiktoken.Encoding("classes", pat_str=self.text, mergeable_ranks=own, special_tokens={})
        kinds = [len(library.encode_ordinary(lead + c)) == 1 for lead in "a1!"]
        same = [len(self.pattern.findall(lead + c)) == 1 for lead in "a1!"]
        if kinds != same:
            self.instead[ord(c)] = "a1!"[kinds.index(True)] if any(kinds) else " "

    def cut(self, text: str) -> list[str]:
        if not text.isascii():
            chars = set(text)
            for c in chars - self.seen:
                if unicodedata.category(c) == "Cn" and self.word.match(c):
                    self._ask(c)
            self.seen |= chars
            if self.instead and not chars.isdisjoint(map(chr, self.instead)):
                return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.instead))]
        return self.pattern.findall(text)


class BytePieces:
    """Encoder and decoder over one rank file and one pattern."""

    def __init__(self, path: str, pattern: str):
        from sentencepiece import SentencePieceProcessor

        ranks = read_ranks(path)
        self.lib = SentencePieceProcessor(model_proto=serialised_model(ranks))
        self.cut = PreTokens(pattern).cut
        shown = byte_characters()
        self.shown = {b: c for b, c in enumerate(shown)}
        back = {c: b for b, c in enumerate(shown)}
        order = sorted(ranks, key=ranks.get)
        #: Ranks by piece, for ranks with gaps.
        self.rank = np.array([ranks[t] for t in order], np.int32)
        pieces = [self.lib.id_to_piece(i) for i in range(len(order))]
        self.whole = {p: ranks[t] for p, t in zip(pieces, order, strict=True)}
        tokens = [bytes([back[c] for c in p]) for p in pieces]
        size = np.zeros(int(self.rank.max()) + 1, np.int64)
        size[self.rank] = [len(t) for t in tokens]
        begin = np.zeros(len(size), np.int64)
        begin[self.rank] = np.cumsum(size[self.rank]) - size[self.rank]
        self.size, self.begin, self.flat = size, begin, np.frombuffer(b"".join(tokens), np.uint8)
        self.known: dict[str, bytes] = {}

    def encode_pre_tokens(self, tokens: list[str]) -> list[bytes]:
        """Ids (32-bit) of each; a pre-token that is a token itself is that one, as in the tiktoken library."""
        pieces = [t.encode().decode("latin-1").translate(self.shown) for t in tokens]
        out = [np.int32(r).tobytes() if (r := self.whole.get(p)) is not None else b"" for p in pieces]
        rest = [i for i, raw in enumerate(out) if not raw]
        for i, ids in zip(rest, self.lib.encode([pieces[i] for i in rest], num_threads=1) if rest else [], strict=True):
            out[i] = self.rank[ids].tobytes()
        return out

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out, known = [], self.known
        for text in texts:
            found = self.cut(text)
            new = list(set(found).difference(known))
            if new:
                if len(known) + len(new) > CACHE_TOKENS:
                    known.clear()
                    new = list(set(found))
                known.update(zip(new, self.encode_pre_tokens(new), strict=True))
            out.append(np.frombuffer(b"".join([known[t] for t in found]), np.int32))
            for t in new:
                if len(t) > LONG:
                    del known[t]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids' pieces, one after another."""
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ids):
            return b""
        return self.flat[np.arange(ends[-1]) + np.repeat(self.begin[ids] - (ends - size), size)].tobytes()


_WORKER: dict[tuple[str, str], BytePieces] = {}


def encode_decode(df: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Rows (key, ids array<int>, decoded binary), one for each row of df.

    ids: ranks of the whole text's tokens, each match of the pattern encoded alone, no special
    tokens (their strings are plain text). decoded: the bytes that the ids stand for. A null text is
    encoded as an empty one (no ids, no bytes). Keys may be null or repeat; each row is encoded on its
    own. A very long text is encoded whole, by itself. An empty table gives no rows. Other columns
    are ignored, whatever their names.
    """
    where = (ranks_path or default_ranks(), pattern or default_pattern())

    def run(batches):
        import pyarrow as pa

        if where not in _WORKER:
            _WORKER[where] = BytePieces(*where)
        codec = _WORKER[where]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at in chunks(texts, CHUNK):
                ids = codec.encode(texts[at])
                ends = np.cumsum([0, *(len(x) for x in ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                decoded = pa.array([codec.decode(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at.start, at.stop - at.start), lists, decoded], names=["k", "ids", "decoded"])

    kind = df.schema[key].dataType.simpleString()
    rows = spread(df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")))
    return rows.transform(batchwise(run, f"k {kind}, ids array<int>, decoded binary")).withColumnRenamed("k", key)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
