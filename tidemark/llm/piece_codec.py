"""Encoding and decoding with a merge-type piece vocabulary.

The encoder keeps an agenda of adjacent symbol pairs ordered by score (ties: the left pair first)
and merges the best pair until none is in the vocabulary; symbols without a piece fall back to
bytes. A text splits exactly wherever no piece has characters of both sides next to each other:
before word marks, and between Latin letters and other characters, if the vocabulary allows it. Each
distinct unit is encoded once. The agendas of
many short units are kept side by side, as rows of ranks whose least is taken from each; a long unit
has a heap of its own. In that batch the sentencepiece library encodes every new unit, and one text in
WHOLE as a whole; where it differs, its ids are returned and the row says so. The library then decodes
the ids of every text.
"""

from __future__ import annotations

import heapq
import re
import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Runs, batchwise, chunks, kept, sliced, span_hashes, spread

MARK = "▁"
#: Latin letters, as a class of a regular expression.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_LETTER = np.array([re.match(f"[{LETTERS}]", chr(c)) is not None for c in range(0x251)])
#: Units that a Python worker remembers.
CACHE_UNITS = 400_000
#: Characters of texts that are encoded together (a longer text alone).
CHUNK = 1 << 18
#: Symbols of a unit, at most, whose agenda is kept beside others.
ROW_SYMBOLS = 32
#: Units whose agendas are kept side by side.
ROW_UNITS = 16384
#: Units that the library is asked for at once.
GROUP_UNITS = 256
#: One text in so many (by the checksum of its ids) is checked as a whole.
WHOLE = 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PairTable:
    """Pairs of symbols that are pieces together: their rank by score, and the symbol they make.

    Symbols are the vocabulary's pieces and the characters that occur in them. The pairs stand in
    an open-addressed table, so that many are looked up at once.
    """

    def __init__(self, ids: dict[str, int], score: dict[str, float]):
        pieces = sorted(ids, key=lambda p: -score[p])
        symbols = list(dict.fromkeys([*pieces, *sorted(set(chain.from_iterable(pieces)))]))
        number = {s: i for i, s in enumerate(symbols)}
        self.n = len(symbols)
        self.id = np.array([ids.get(s, -1) for s in symbols], np.int32)
        single = {ord(s): i for s, i in number.items() if len(s) == 1}
        self.char = np.full(max(single, default=0) + 2, -1, np.int32)
        self.char[list(single)] = list(single.values())
        # pieces of equal score share a rank: of those the left pair goes first
        ranks = {x: i for i, x in enumerate(sorted(set(score.values()), reverse=True))}
        rows = [(number[p[:i]] * self.n + number[p[i:]], ranks[score[p]], number[p]) for p in pieces for i in range(1, len(p)) if p[:i] in number and p[i:] in number]
        key, rank, made = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
        self.bits = max(4, (4 * len(key)).bit_length())
        self.key = np.full(1 << self.bits, -1)
        self.rank, self.made = np.full(1 << self.bits, self.none, np.int32), np.zeros(1 << self.bits, np.int32)
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):  # the first of those that want a free slot takes it, the others try the next
            free = self.key[slot[todo]] < 0
            some, first = np.unique(slot[todo[free]], return_index=True)
            taken = todo[free][first]
            self.key[some], self.rank[some], self.made[some] = key[taken], rank[taken], made[taken]
            todo = todo[self.key[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    #: The rank of a pair that is no piece.
    none = (1 << 31) - 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (`none` without a piece) and symbol of each pair; a negative symbol is in no pair."""
        key = left.astype(np.int64) * self.n + right
        key[(left < 0) | (right < 0)] = -2
        slot = self._slot(key)
        got = self.key[slot]
        todo = np.flatnonzero((got != key) & (got >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            got = self.key[slot[todo]]
            todo = todo[(got != key[todo]) & (got >= 0)]
        rank = np.where(self.key[slot] == key, self.rank[slot], self.none)
        return rank, self.made[slot]

    def merged(self, units: list[str]) -> list[bytes | None]:
        """Ids of each unit (of up to ROW_SYMBOLS characters); None if one of its symbols is no piece."""
        u, size = len(units), np.array([len(x) for x in units])
        width = int(size.max(initial=1))
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        sym = np.full((u, width + 1), -1, np.int32)
        sym[np.arange(width + 1) < size[:, None]] = self.char[np.minimum(codes, len(self.char) - 1)]
        rank, made = (x.reshape(u, width) for x in self.find(sym[:, :-1].ravel(), sym[:, 1:].ravel()))
        nxt, prv = np.tile(np.arange(1, width + 2), (u, 1)), np.tile(np.arange(-1, width), (u, 1))
        row, flat = np.arange(u), (sym.reshape(-1), nxt.reshape(-1), prv.reshape(-1), rank.reshape(-1), made.reshape(-1))
        sym1, nxt1, prv1, rank1, made1 = flat
        while True:
            at = rank[row].argmin(axis=1)  # the best pair; of equal ones the left
            go = rank[row, at] != self.none
            row, at = row[go], at[go]
            if not len(row):
                break
            base, wide = row * width, row * (width + 1)
            sym1[wide + at] = made1[base + at]
            gone = nxt1[wide + at]  # the right part of the pair goes
            sym1[wide + gone] = -2
            after = nxt1[wide + gone]
            nxt1[wide + at], prv1[wide + np.minimum(after, width)] = after, at
            rank1[base + np.minimum(gone, width - 1)] = self.none
            # new pairs on either side; past the ends there is none
            right = np.where(after < width, sym1[wide + np.minimum(after, width)], -1)
            rank1[base + at], made1[base + at] = self.find(sym1[wide + at], right)
            before = prv1[wide + at]
            some = np.flatnonzero(before >= 0)
            where = base[some] + before[some]
            rank1[where], made1[where] = self.find(sym1[wide[some] + before[some]], sym1[wide[some] + at[some]])
        places = np.arange(width + 1)
        done = sym
        inside = (places < size[:, None]) & (sym != -2)
        left = inside.sum(axis=1)
        ids = np.where(done >= 0, self.id[done], -1)
        whole = (ids >= 0) | ~inside
        raw, ends = ids[inside].tobytes(), (4 * np.cumsum(left)).tolist()
        return [raw[lo:hi] if ok else None for lo, hi, ok in zip([0, *ends], ends, whole.all(axis=1).tolist(), strict=False)]


class PieceVocabulary:
    """Pieces of a sentencepiece model of merge type with byte fallback and identity normaliser."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("a merge-type model with identity normaliser and dummy prefix is needed")
        self.lib = SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_id: dict[int, int] = {}
        self.unk = 0
        for i, p in enumerate(proto.pieces):
            if p.type == 1:
                self.ids[p.piece], self.score[p.piece] = i, p.score
            elif p.type == 6:
                self.byte_id[int(p.piece[3:5], 16)] = i
            elif p.type == 2:
                self.unk = i
            elif p.type in (4, 5):
                raise ValueError("user-defined and unused pieces are not supported")
        self.pieces = [p.piece for p in proto.pieces]
        mixed = re.compile(f"[{LETTERS}][^{LETTERS}{MARK}]|[^{LETTERS}{MARK}][{LETTERS}]")
        #: Where texts may be cut: nowhere (0), before word marks (1), and between letters and others (2).
        self.cuts = 0 if any(MARK in p.lstrip(MARK) for p in self.ids) else 1 if any(mixed.search(p) for p in self.ids) else 2
        #: What comes before a unit without a mark when the library is asked: a character of the other class.
        self.lead = {x: np.array(self.lib.encode(x), np.int32).tobytes() for x in "a."}
        self.pairs = PairTable(self.ids, self.score)

    def unit_spans(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The marked texts one after another, their code points, starts and ends of units that no merge crosses, and how many units each text has."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        text, ends = "".join(marked), np.cumsum([len(m) for m in marked])
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        cut = np.zeros(len(codes) + 1, bool)
        cut[ends] = cut[0] = True
        if self.cuts and len(codes):
            mark = codes == ord(MARK)
            cut[1:-1] |= mark[1:] & ~mark[:-1]
            if self.cuts > 1:
                letter = _LETTER[np.minimum(codes, len(_LETTER) - 1)]
                cut[1:-1] |= ~mark[1:] & ~mark[:-1] & (letter[1:] != letter[:-1])
        edge = np.flatnonzero(cut)
        start = edge[:-1]
        return text, codes, start, edge[1:], np.diff(np.searchsorted(start, ends), prepend=0)

    def units(self, text: str) -> list[str]:
        """The marked text in units that no merge crosses."""
        whole, _, start, stop, _ = self.unit_spans([text])
        return [whole[lo:hi] for lo, hi in zip(start, stop, strict=True)]

    def encode_unit(self, unit: str) -> list[int]:
        score, n = self.score, len(unit)
        sym = list(unit)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = []
        for i in range(n - 1):
            s = score.get(pair := sym[i] + sym[i + 1])
            if s is not None:
                agenda.append((-s, i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            if right[i] != j or sym[i] + sym[j] != pair:
                continue
            sym[i], sym[j] = pair, ""
            k = right[i] = right[j]
            right[j] = -2
            if k >= 0:
                left[k] = i
                s = score.get(new := pair + sym[k])
                if s is not None:
                    heapq.heappush(agenda, (-s, i, k, new))
            h = left[i]
            if h >= 0:
                s = score.get(new := sym[h] + pair)
                if s is not None:
                    heapq.heappush(agenda, (-s, h, i, new))
        out, ids = [], self.ids
        for s in sym:
            if s:
                if (k := ids.get(s)) is not None:
                    out.append(k)
                elif self.byte_id:
                    out += [self.byte_id[b] for b in s.encode()]
                else:
                    out.append(self.unk)
        return out

    def encode_units(self, units: list[str]) -> list[bytes]:
        """The ids of each unit as 32-bit integers; short units of known characters side by side."""
        out: list[bytes | None] = [None] * len(units)
        size = np.array([len(u) for u in units], np.int64)
        order = np.argsort(size, kind="stable")
        order = order[size[order] <= ROW_SYMBOLS]
        for lo in range(0, len(order), ROW_UNITS):
            at = order[lo : lo + ROW_UNITS]
            for i, raw in zip(at.tolist(), self.pairs.merged([units[i] for i in at]), strict=True):
                out[i] = raw
        return [np.array(self.encode_unit(u), np.int32).tobytes() if raw is None else raw for u, raw in zip(units, out, strict=True)]

    def encode(self, text: str) -> list[int]:
        return [i for u in self.units(text) for i in self.encode_unit(u)]

    def shown(self, unit: str) -> tuple[str, bytes]:
        """A text whose library ids are the given bytes and then the unit's; the library adds the first mark itself."""
        if unit[0] == MARK:
            return unit[1:].replace(MARK, " "), b""
        lead = "." if unit[0].isalpha() else "a"
        return lead + unit, self.lead[lead]

    def differing(self, units: list[str], own: list[bytes]) -> list[tuple[int, bytes]]:
        """(place, ids) of the units whose ids the library has otherwise.

        Many units are asked for as one text; where that differs, each alone. A lone mark can't be
        asked for by itself: texts that are checked as a whole hold it.
        """
        out = []
        groups = [[i for i, u in enumerate(units) if u.strip(MARK)], *([i] for i, u in enumerate(units) if u != MARK and not u.strip(MARK))]
        todo = [g[lo : lo + GROUP_UNITS] for g in groups for lo in range(0, len(g), GROUP_UNITS)]
        while todo:
            group = todo.pop()
            shown = [self.shown(units[i]) for i in group]
            raw = np.array(self.lib.encode(" ".join([t for t, _ in shown])), np.int32).tobytes()
            if raw == b"".join([lead + own[i] for (_, lead), i in zip(shown, group, strict=True)]):
                continue
            if len(group) > 1:
                todo += [[i] for i in group]
            else:
                out.append((group[0], raw[len(shown[0][1]) :]))
        return out

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, bytes decoded (each invalid one a replacement character), marks to spaces, the first space dropped."""
        back = {v: k for k, v in self.byte_id.items()}
        out, run = [], bytearray()

        def flush():
            if run:
                out.append(_decode_bytes(bytes(run)))
                run.clear()

        for n, i in enumerate(ids):
            if i in back:
                run.append(back[i])
                continue
            flush()
            p = self.pieces[i].replace(MARK, " ")
            out.append(p[1:] if n == 0 and p.startswith(" ") else p)
        flush()
        return "".join(out)


def _decode_bytes(b: bytes) -> str:
    out, i = [], 0
    while i < len(b):
        for n in (1, 2, 3, 4):
            try:
                out.append(b[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_WORKER: dict[str, tuple] = kept(__name__)


def _worker(path: str) -> tuple:
    """The vocabulary, ids by unit, and the units whose ids the library has otherwise."""
    if path not in _WORKER:
        vocab = PieceVocabulary(path)
        bad: set[str] = set()

        def make(units: list[str]) -> list[bytes]:
            own = vocab.encode_units(units)
            for i, ids in vocab.differing(units, own):
                bad.add(units[i])
                own[i] = ids
            return own

        _WORKER[path] = (vocab, Runs(make, np.int32, CACHE_UNITS), bad)
    return _WORKER[path]


def encode_decode(df: DataFrame, key: str = "doc_id", text: str = "text", model_path: str | None = None) -> DataFrame:
    """Rows (key, ids array<int>, decoded string, agreed boolean), one for each row of df.

    ids: of the whole text, without begin and end ids. decoded: the library's decode of these ids, all of
    a text's at once. agreed: the agenda's ids were the library's for every unit, and for the text where
    it was checked as a whole (else the library's are returned).
    A null text is encoded as an empty one (no ids, decoded ''). Keys may be null or repeat; each
    row is encoded on its own. A very long text is encoded whole, by itself. An empty table gives
    no rows. Other columns are ignored, whatever their names.
    """
    path = model_path or default_model()

    def run(batches):
        import pyarrow as pa

        vocab, known, bad = _worker(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at in chunks(texts, CHUNK):
                text, codes, start, stop, count = vocab.unit_spans(texts[at])
                ids, ends = known.gather(known.places(span_hashes(codes, start, stop), sliced(text, start, stop)))
                cuts = np.concatenate([[0], ends])[np.cumsum(count)]
                parts = np.split(ids, cuts[:-1])
                decoded, agreed, whole = [], [], False
                for i, (t, own) in enumerate(zip(texts[at], parts, strict=True)):
                    fine = not bad or bad.isdisjoint(vocab.units(t))
                    got = own.tolist()
                    if zlib.crc32(own.tobytes()) % WHOLE == 0 and got != (want := vocab.lib.encode(t)):
                        parts[i], got, fine, whole = np.array(want, np.int32), want, False, True
                    decoded.append(vocab.lib.decode(got) if got else "")
                    agreed.append(fine)
                if whole:
                    ids, cuts = np.concatenate(parts), np.cumsum([len(p) for p in parts])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], cuts]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at.start, at.stop - at.start), lists, pa.array(decoded, pa.string()), pa.array(agreed)], names=["k", "ids", "decoded", "agreed"])

    kind = df.schema[key].dataType.simpleString()
    rows = spread(df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")))
    return rows.transform(batchwise(run, f"k {kind}, ids array<int>, decoded string, agreed boolean")).withColumnRenamed("k", key)


def digests(encoded: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "agreed",
        *keep,
    )
