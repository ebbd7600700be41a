"""Token alignment, whitening and byte-level pieces against the libraries and brute force."""

import base64
import hashlib
import json
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import byte_pieces, queries, token_align, whitening

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "   a   b ", "▁x ▁", "a\nb\n\n c", "日本語 テスト 😀", "<s> </s> <0x0A>", "x" * 3000, " lead", "\t\x00z", "tail   ", "naïve café, don't! It's 'S we'll", "<|endoftext|> <|ENDOFTEXT|>,", "x\x1cy. z", "a\xa0b\x85c d", "٣٤٥ 12345", "՘a a࢏1", "a  b   c", "é ⅷ ²"]


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Null texts and ids, repeated rows, and columns named like the operators' own."""
    rows = [(i, t, "k") for i, t in enumerate(ODD)] + [(90, None, "t"), (None, "no id", ""), (3, ODD[3], "k"), (3, "other text", "k"), (3, "other text", "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, k string").withColumns({c: F.lit("x") for c in ("t", "ids", "block", "pair", "n", "count", "best", "links", "pos")})


# ---- 13 byte-level pieces ----


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as p
    import tiktoken

    with open(p.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_pieces_equal_the_library(spark, odd_docs, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter()
    for i, t in texts:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, byte_pieces.digests(byte_pieces.encode_decode(docs)).collect())) == want
    assert byte_pieces.encode_decode(odd_docs).columns == ["doc_id", "ids", "decoded"] and byte_pieces.encode_decode(odd_docs).count() == odd_docs.count()
    assert byte_pieces.encode_decode(odd_docs.where(F.lit(False))).count() == 0


def test_byte_pieces_on_random_text(library):
    import public_tokenizers as p

    codec = byte_pieces.BytePieces(p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN)
    rng = random.Random(13)
    alphabet = [*"aeinrst'dlm  \n\t01!.,", "é", "ß", "日", "本", "한", "я", "щ", "ع", "😀", "՘", "࢏", "㿃b", "\xa0", " ", "́", "▁", "▅", "\x00"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(4000)] + ["ab" * 20000, "é" * 9999, " " * 5000]
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(t), t
        assert codec.decode(ids) == t.encode()


def test_byte_pieces_of_ranks_with_gaps(tmp_path):
    """Ranks needn't be dense, and a token that no merge reaches is still one where it is a whole pre-token."""
    ranks = {bytes([b]): 3 * b for b in range(256)} | {b"ab": 1000, b"abc": 2000, b"xyz": 3000}
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    codec = byte_pieces.BytePieces(str(path), r"\w+|\W+")
    assert [x.tolist() for x in codec.encode(["abc", "xyz", "xyzabc", ""])] == [[2000], [3000], [360, 363, 366, 2000], []]
    with pytest.raises(ValueError):
        byte_pieces.serialised_model({b"a": 0})


# ---- 11 token alignment ----


def plain_alignment(texts):
    """(a ids, b ids, groups as lists of both sides' ids) of each text by byte offsets; None without tokens."""
    import public_tokenizers as p
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=p.path("piece_bpe_32k.model"))
    back = {c: b for b, c in enumerate(byte_pieces.byte_characters())}
    name = {i: t for t, i in json.load(open(p.path("byte_bpe_50k.json"), encoding="utf-8"))["model"]["vocab"].items()}
    out = []
    for t in texts:
        a = a_tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_tok.encode(t) if t else []
        sides = [[bytes([back[c] for c in name[i]]) for i in a], [bytes([int(s[3:5], 16)]) if b_tok.is_byte(i) else s.replace("▁", " ").encode() for i in b for s in [b_tok.id_to_piece(i)]]]
        if not t or any(b"".join(s) != (" " + t).encode() for s in sides):
            out.append(None)
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in sides]
        groups, lo = [], [0, 0]
        for e in sorted(set(ends[0]) & set(ends[1])):
            hi = [ends[0].index(e) + 1, ends[1].index(e) + 1]
            groups.append((a[lo[0] : hi[0]], b[lo[1] : hi[1]]))
            lo = hi
        out.append((a, b, groups))
    return out


def test_alignment_against_byte_offsets(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(token_align, "BLOCK_LINKS", 5000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = plain_alignment([t for _, t in rows])
    count = Counter((a[-1], b[-1]) for f in found if f for a, b in f[2])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    want = Counter()
    for (i, _), f in zip(rows, found, strict=True):
        if f is None:
            want[i, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        pairs = [(a[-1], b[-1]) for a, b in f[2]]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in f[2])
        want[i, len(f[0]), len(f[1]), len(pairs), len(pairs), sum(count[p] == best[p[1]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert None in found and Counter(map(tuple, token_align.link_statistics(docs).collect())) == want
    got = Counter((r.doc_id, tuple(r.a_ids), tuple(r.b_ids), tuple(zip(r.a_ends, r.b_ends, strict=True))) for r in token_align.align(docs).collect())
    ends = [tuple(zip(np.cumsum([len(a) for a, _ in f[2]]).tolist(), np.cumsum([len(b) for _, b in f[2]]).tolist(), strict=True)) if f else () for f in found]
    assert got == Counter((i, tuple(f[0]) if f else (), tuple(f[1]) if f else (), e) for (i, _), f, e in zip(rows, found, ends, strict=True))


def test_alignment_of_odd_rows(spark, odd_docs):
    assert token_align.link_statistics(odd_docs).count() == token_align.align(odd_docs).count() == odd_docs.count()
    assert token_align.link_statistics(odd_docs.where(F.lit(False))).count() == 0


def test_dangling_suffix_transducer():
    t = token_align.DanglingSuffix([b"a", b"ab", b"bc", b"abcd"], [b"ab", b"c", b"d", b"bcd"])
    assert t.align([3], [0, 1, 2]) == [(1, 3)] and t.align([1, 2], [0]) is None and t.align([0, 2], [0, 1]) == [(2, 2)]
    assert t.align([0], [3]) is None and t.align([], []) == [] and t.align([1, 1], [0, 0]) == [(1, 1), (2, 2)]
    steps = t.steps
    assert t.align([0, 2], [0, 1]) == [(2, 2)] and t.steps == steps  # all from memory


# ---- 12 whitening ----


def plain_integers(v):
    return None if v is None or not v or any(x is None or not np.isfinite(x) for x in v) else tuple(int(np.floor(64 * float(x))) + 1_000_000 for x in v)


def check_whitening(rows, got, components=16):
    """rows: (id, vector); got: result rows. Against exact integers and one decomposition of the exact covariance."""
    x = {}
    for i, v in rows:
        if (p := plain_integers(v)) is not None:
            x.setdefault(i, []).append(p)
    fit = np.array(sorted({p for ps in x.values() for p in ps}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    d = (fit * n - sums).astype(object)
    v = np.array([[float(Fraction(int(c), n * n * n)) for c in r] for r in d.T.dot(d)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    by = {}
    for r in got:
        assert r.n == n and r.identity_error <= 1e-4
        assert abs(r.explained - values[r.component - 1] / values.sum()) <= 1e-6 * r.explained
        by.setdefault((r.vec_id, r.component), []).append((r.deviation, r.whitened))
    k = min(components, int((values > values[0] * 1e-12).sum()))
    assert set(by) == {(i, c) for i in x for c in range(1, k + 1)}
    signs = {}
    for (i, c), found in by.items():
        want = []
        for p in x[i]:
            e = np.array(p, dtype=object) * n - sums
            want.append((int((e * e).sum()), float(np.dot([float(Fraction(int(y), n)) for y in e], vectors[:, c - 1]) / np.sqrt(values[c - 1]))))
        for (dev, w), (dev2, w2) in zip(sorted(found, key=lambda z: (z[0], abs(z[1]))), sorted(want, key=lambda z: (z[0], abs(z[1]))), strict=True):
            assert dev == dev2 and abs(abs(w) - abs(w2)) < 1e-6
            if abs(w) > 1e-4:
                signs.setdefault(c, set()).add(w * w2 > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(rows, queries.op12_whitening(spark, SF).collect())


def test_whitening_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "ROWS", 16)
    rng = np.random.default_rng(12)
    rows = [(i, (rng.normal(size=5) * [9, 5, 1, 1, 0] + [0, 3000, 0, -70, 1]).tolist()) for i in range(150)]
    rows += [(i, rows[0][1]) for i in range(200, 400)]  # one vector holds more than half of all rows
    rows += [(7, rows[9][1]), (None, rows[1][1]), (500, None), (501, [1.0, None, 0.0, 0.0, 0.0]), (502, [float("nan")] * 5), (503, [float("inf")] * 5), (504, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, x string, n int").withColumns({"k": F.lit("a"), "dims": F.lit(0)}).repartition(7)
    got = whitening.whiten(df).collect()
    check_whitening(rows, got)
    assert {r.component for r in got} == {1, 2, 3, 4}  # the last dimension has no variance
    assert whitening.whiten(df.where(F.lit(False))).count() == 0 and whitening.whiten(df.where("vec_id = 0")).count() == 0
    two = df.where("vec_id < 20").select("vec_id", "embedding").union(spark.createDataFrame([(900, [1.0, 2.0]), (901, [2.0, 5.0])], "vec_id long, embedding array<double>"))
    assert {(r.vec_id, r.component, r.n) for r in whitening.whiten(two).collect() if r.vec_id >= 900} == {(900, 1, 2), (901, 1, 2)}


def test_merging_loses_nothing():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(300, 6)) * [900, 40, 5, 2, 1, 0.6]).astype(np.int64) + 10**12
    parts = [whitening.Summary.of(p) for p in np.split(x, [3, 4, 120])]
    total = parts[0].merged(parts[1]).merged(parts[2].merged(parts[3]))
    whole = whitening.Summary.of(x)
    assert total.n == 300 and total.sums == whole.sums == [int(s) for s in x.sum(axis=0)]
    assert np.allclose(total.s, whole.s, rtol=1e-12) and np.allclose(np.abs((total.vt * whole.vt).sum(axis=1)), 1, rtol=1e-12)


def test_deviations_beyond_a_long():
    x = np.array([[2**40, 0], [0, 0]])
    assert whitening.deviations(x, 2, [2**40, 0]) == [None, None]
    assert whitening.deviations(x // 2**20, 2, [2**20, 0]) == [2**40, 2**40]
