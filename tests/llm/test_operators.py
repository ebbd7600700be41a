"""The ten training-data operators: brute force, round trips, and odd input (nulls, empties, ties, repeats, clashing columns)."""

import base64
import gzip
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from conftest import SF, oracle, result
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.llm import ann, dart_minhash, html_cut, langid, mixing, piece_codec, queries, simhash, suffix_dedup, token_store, warc

ODD = ["", " ", "   a   b ", "▁x ▁", "a\nb\n\n c", "日本語 テスト 😀", "<s> </s> <0x0A>", "x" * 3000, " lead", "\t\x00z", "▁", "tail   ", "naïve café, don't! It's 'S", "<|endoftext|> <|ENDOFTEXT|>,", "x\x1cy. z", "a\xa0b\x85c", "İstanbul... ΣΑΣ", "É É̀ x̸="]


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Null texts and ids, repeated rows, and columns named like the operators' own."""
    rows = [(i, t, "k", "en", "s") for i, t in enumerate(ODD)] + [(90, None, "t", None, None), (None, "no id", "", "fr", None), (3, ODD[3], "k", "en", "s"), (3, "other text", "k", "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, k string, lang string, source string").withColumns({"t": F.lit(1), "tid": F.lit("x"), "label": F.lit(2), "home": F.lit(0), "text_key": F.lit(0), "bucket": F.lit("b")})


def no_rows(df):
    return df.where(F.lit(False))


# ---- 1 language identification ----


def words_of(seed, letters, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_langid_learns_and_rejects(spark):
    rows = [(i, words_of(i, "abcde" if i % 2 else "vwxyz", 1 + i % 30), "one" if i % 2 else "two") for i in range(300)] + [(1000, None, "one"), (1001, "12 34 !!", "two"), (1002, "", None), (None, "abc ade", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, per_language=100)
    assert (model.weights == 0).any() and model.languages == ["one", "two"] and 0 < model.temperature
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert len(got) == len(rows)
    for i, _, lang in rows[:300]:
        assert got[i].lang_pred == lang and 0 <= got[i].score <= 1
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[None].lang_pred == "one"


def test_langid_without_rows(spark, odd_docs):
    model = langid.fit(no_rows(odd_docs))
    assert langid.predict(no_rows(odd_docs), model).count() == 0
    assert {r.lang_pred for r in langid.predict(odd_docs, model, keep=("k", "t", "text")).collect()} == {"und"}


def test_langid_held_out_accuracy(spark):
    rows = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_langid_against_one_gram_at_a_time(spark, odd_docs):
    """Predictions over batches against a plain loop; a very long text, repeats, and texts on which two languages tie."""
    texts = [t for t in ODD] + ["déjà VU straße", "naïve " * 400, "a", "zz", "a" * 5000]
    rows = [(i, t, "one" if i % 2 else "two") for i, t in enumerate(texts * 2)] + [(999, None, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    for r in langid.predict(docs, model, keep=("text", "lang")).collect():
        want = langid.plain_prediction(model, r.text or "")
        assert r.lang_pred == want[0] and abs(r.score - want[1]) < 1e-9
    flat = langid.LanguageModel(["b", "a"], np.zeros((langid.BUCKETS, 2)), np.zeros(2))
    assert flat.predict(["xyz"]) == [("b", 0.5)] == [langid.plain_prediction(flat, "xyz")]


def test_word_scores_do_not_depend_on_the_batch():
    a, b = langid.ngram_buckets(["abc", "", "déf"]), langid.ngram_buckets(["déf"])
    assert list(a[1][a[0] == 2]) == list(b[1]) and not (a[0] == 1).any()


# ---- 2 pieces ----


def test_pieces_equal_the_library(spark, odd_docs):
    lib = piece_codec.PieceVocabulary(piece_codec.default_model()).lib
    got = sorted(((r.doc_id or -1, tuple(r.ids), r.decoded, r.agreed) for r in piece_codec.encode_decode(odd_docs).collect()))
    want = sorted(((r.doc_id or -1, tuple(lib.encode(r.text or "")), lib.decode(lib.encode(r.text or "")), True) for r in odd_docs.collect()))
    assert got == want
    d = piece_codec.digests(piece_codec.encode_decode(odd_docs.where("doc_id = 4"))).first()
    ids = lib.encode(ODD[4])
    assert d.n_tokens == len(ids) and d.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and d.decoded_sha256 == hashlib.sha256(ODD[4].encode()).hexdigest()
    assert piece_codec.encode_decode(no_rows(odd_docs)).count() == 0


def test_agenda_and_decoder_on_random_text():
    v, rng = piece_codec.PieceVocabulary(piece_codec.default_model()), random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("ab the ▁\n é日\x07") for _ in range(rng.randrange(40)))
        assert v.encode(t) == v.lib.encode(t) and v.decode(v.encode(t)) == v.lib.decode(v.lib.encode(t))


# ---- 3 mixing ----


def test_mix_against_sql(spark):
    assert result(queries.op3_source_mix(spark, SF)) == oracle(mixing.ORACLE_SQL)


def test_mix_targets_and_bounds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 7)  # several cells a source
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(30), rng.choice(["a", "b", "c", None])) for i in range(400)] + [(400, None, "zero"), (401, "", "zero"), (5, "w w", "a"), (5, "w w", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("weight", F.lit(0))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == sorted(map(tuple, got), key=str)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in got)
    assert math.isclose(sum(rs[0].target for rs in by.values()), total, rel_tol=1e-9)
    for rs in by.values():
        assert sum(r.size for r in rs) == rs[0].source_size and abs(sum(r.taken for r in rs) - rs[0].target) < 1.001
        assert rs[0].target <= 3 * rs[0].source_size + 1e-6
        # whole epochs first: takings differ by at most one epoch
        assert len({r.taken // r.size for r in rs if r.size}) <= 2
    assert mixing.mix(no_rows(docs)).count() == 0


# ---- 4 WARC ----


def test_warc_round_trip(spark):
    tricky = "WARC/1.1\r\nWARC-Type: response\r\n\r\nx\r\n\r\nWARC/1.1"
    rows = [(7, "http://a/é b", "héllo"), (3, "http://b", "héllo"), (9, None, "héllo"), (1, "http://c", None), (2, "http://d", ""), (4, "http://e", tricky), (5, "http://f", "\n\n\r\n"), (6, "http://f", "y" * 50000), (6, "http://f", "y" * 50000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "digest": F.lit(2), "first": F.lit(3), "d": F.lit(4)})
    full = warc.round_trip(pages)
    got = sorted(map(tuple, warc.digests(full).collect()), key=str)
    want, first = [], {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        raw = (h or "").encode()
        to = first.get(h or "")
        first.setdefault(h or "", i)
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to is None else "revisit", to))
    assert got == sorted(want, key=str)  # rows that repeat stay: one is the response
    nested = {r.metadata.page_id: r for r in full.collect()}
    assert bytes(nested["4"].response.payload).decode() == tricky and nested["4"].request.target == "http://e" and nested["7"].response.payload is None
    ids = {r.response.id for r in full.collect()}
    assert len(ids) == len(rows) and nested["7"].response.refers_to == nested["3"].response.id and all(r.response.refers_to is None or r.response.refers_to in ids for r in full.collect())
    assert warc.digests(warc.round_trip(no_rows(pages))).count() == 0


def test_warc_files_are_members_of_records(spark, tmp_path):
    """A file decompresses to a plain WARC; each record can be read from where its member begins."""
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>é {i}\r\n\r\n" * i) for i in range(40)], "page_id long, url string, html string")
    warc.write(warc.captures(pages), str(tmp_path / "w"))
    found = 0
    for f in (tmp_path / "w").glob("part-*"):
        raw = f.read_bytes()
        plain = gzip.decompress(raw)
        assert [h["warc-type"] for h, _ in warc.split_records(plain)].count("response") == plain.count(b"WARC-Type: response")
        for member in raw.split(warc.END_MEMBER)[:-1]:
            z = zlib.decompressobj(wbits=31)
            (record,) = warc.split_records(z.decompress(raw[raw.index(member) :]))
            found += record[0]["warc-type"] == "response"
    assert found == 40


def test_warc_minimum_payload(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "v", "abcd"), (4, "v", "abcd")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.digests(warc.round_trip(pages, min_payload=3)).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


# ---- 5 nearest neighbours ----


def brute_nearest(v, ids, q, k):
    s = (v * v[q]).sum(axis=1)
    return [ids[i] for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k], s


def test_nearest_against_brute_force(spark, monkeypatch):
    """Several blocks and tasks a block; ties, unusable vectors, vectors of another length, repeated queries."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    monkeypatch.setattr(ann, "QUERY_ROWS", 10)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 16))
    v = centres[rng.integers(0, 12, 900)] + 0.4 * rng.standard_normal((900, 16))
    v[100:400] = v[100]  # equal vectors: one cell of several blocks
    rows = [(i, [float(x) for x in v[i].astype(np.float32)]) for i in range(900)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (940, [1.0]), (941, [2.0]), (960, [3.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(0), "v": F.lit(1), "block": F.lit(2), "dims": F.lit(3)})
    asked = df.where("vec_id % 20 = 0")
    got = {}
    for r in ann.nearest(df, asked.unionByName(asked.limit(3)), k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    v = v.astype(np.float32).astype(np.float64)
    hit = 0
    for q in range(0, 900, 20):
        order, s = brute_nearest(v, np.arange(900), q, 10)
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and all(m[2] == s[m[1]] for m in mine)
        hit += len({m[1] for m in mine} & set(order))
    assert hit >= 0.9 * 450 and set(got) == {*range(0, 900, 20), 940, 960}
    assert [g[1:] for g in sorted(got[940])] == [(960, 3.0), (941, 2.0)] and [g[1:] for g in sorted(got[960])] == [(941, 6.0), (940, 3.0)]
    assert ann.nearest(no_rows(df), no_rows(df)).count() == 0 and ann.nearest(df, no_rows(df)).count() == 0
    few = df.where("vec_id < 5")
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 4


@pytest.mark.parametrize("clustered", [False, True])
def test_nearest_stops_early(spark, monkeypatch, clustered):
    """Vectors of 64 components in several blocks: a recall of 0.9, with a part of them verified."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 2048)
    rng = np.random.default_rng(64)
    v = rng.normal(size=(12000, 64))
    if clustered:
        v = 0.4 * v + rng.normal(size=(40, 64))[rng.integers(0, 40, 12000)]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.arange(len(v))
    df = spark.createDataFrame(((int(i), x.tolist()) for i, x in zip(ids, v, strict=True)), "vec_id long, embedding array<double>")
    got, verified = {}, {}
    for r in ann.nearest(df, df.where("vec_id % 200 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        verified[r.query_id] = r.verified
    hit = sum(len(got[q] & set(brute_nearest(v, ids, q, 20)[0])) for q in got)
    assert len(got) == 60 and hit >= 0.9 * 20 * len(got) and np.mean(list(verified.values())) < (0.1 if clustered else 0.5) * len(ids)


def test_chi_square():
    assert abs(ann.chi_square_cdf(ann.chi_square_quantile(0.9, 8), 8) - 0.9) < 1e-9 and abs(ann.chi_square_quantile(0.95, 2) - 5.991) < 1e-3


# ---- 6 repeated passages ----


def test_repeats_against_brute_force(spark):
    rng = random.Random(6)
    base = [" ".join(rng.choice("alpha beta gamma délta of the ünd x".split()) for _ in range(60)) for _ in range(8)]
    rows = []
    for _ in range(120):
        p = []
        for _ in range(rng.randrange(0, 4)):
            b = rng.choice(base)
            s = rng.randrange(len(b))
            p.append(b[s : s + rng.randrange(10, 200)] if rng.random() < 0.8 else "".join(rng.choice("abc ") for _ in range(90)))
        rows.append((rng.randrange(100), "".join(p)))
    rows += [(None, base[0]), (None, base[0]), (3, None), (4, ""), (200, "a" * 700), (201, "a" * 300), (202, "ab" * 200), (203, rows[5][1]), (203, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"k": F.lit("x"), "kept": F.lit(1), "home": F.lit(2)})
    want = sorted(str(Row(doc_id=a, n_bytes=b, n_removed=c, n_spans=d, kept_sha256=e)) for a, b, c, d, e in suffix_dedup.brute_force(rows))
    assert sorted(map(str, suffix_dedup.digests(suffix_dedup.remove_repeats(df)).collect())) == want
    kept = suffix_dedup.remove_repeats(df, keep=("k", "home"), as_text=True)
    assert kept.columns == ["doc_id", "n_bytes", "spans", "kept", "k", "home"] and kept.count() == len(rows)
    assert suffix_dedup.remove_repeats(no_rows(df)).count() == 0


def test_texts_without_a_common_passage_stay_whole(spark):
    """They share 48 bytes around one anchor, and agreed in 32 bits of their stretches' hashes."""
    a = "fqagoogaaasknybydrzqjz kojwhptkunbeenbvothe quick brown fox jumps over the lazy dogs yesk m bvpcpvlbbfxltytrc nhj cpuh aelxpwvqa"
    b = "papalhyiqwgxykuzrrhdznmksuvoikhdnuahglbuthe quick brown fox jumps over the lazy dogs yesvkpqr vajtckopkgyngshtso e griwrsgkokzfk"
    got = suffix_dedup.remove_repeats(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()
    assert all(r.spans == [] for r in got) and [r[2] for r in suffix_dedup.brute_force([(1, a), (2, b)])] == [0, 0]


def test_texts_of_one_anchor_whose_hashes_agree_in_32_bits_stay(spark):
    """300,000 texts around one passage of 40 bytes: no two stretches share a key, and those that share half of one aren't taken for each other."""
    rng = np.random.default_rng(3)
    n, passage = 300_000, np.frombuffer(b"the quick brown fox jumps over the lazy ", np.uint8)
    letters = rng.integers(97, 123, (n, 10), dtype=np.uint8)
    rows = np.concatenate([letters[:, :5], np.tile(passage, (n, 1)), letters[:, 5:]], axis=1)  # one window each
    found = [suffix_dedup.Anchors([r.tobytes() for r in rows[lo : lo + 2000]]) for lo in range(0, n, 2000)]
    keys, leads = np.concatenate([a.stretch for a in found]), np.concatenate([a.lead for a in found])
    values, counts = np.unique(leads, return_counts=True)
    same = leads == values[counts.argmax()]  # those that have the passage's commonest anchor
    assert len(keys) == n and same.sum() > n / 4 and len(np.unique(keys)) == n
    order = np.argsort(keys & np.uint64(0xFFFFFFFF), kind="stable")
    half = (keys & np.uint64(0xFFFFFFFF))[order]
    pairs = [(order[i], order[i + 1]) for i in np.flatnonzero(half[1:] == half[:-1]) if same[order[i]] and same[order[i + 1]]]
    assert pairs
    texts = [rows[i].tobytes().decode() for pair in pairs[:5] for i in pair]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for dealt in (df.coalesce(1), df.repartition(2, "doc_id")):  # within a flush, and between flushes
        assert [r.kept for r in suffix_dedup.remove_repeats(dealt, as_text=True).orderBy("doc_id").collect()] == texts



def test_repeats_around_a_hot_anchor(spark, monkeypatch):
    """One 20-byte string in every document, with other text around it, copies of some of that and passages of 60 bytes."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    hot, sides = word(20), [word(40) for _ in range(6)]
    passage = word(60)
    texts = [word(rng.integers(0, 50)) + sides[rng.integers(6)] + hot + sides[rng.integers(6)][: rng.integers(10, 41)] + word(30) + (passage if i % 7 == 0 else "") for i in range(300)]
    rows = [(i, t) for i, t in zip(rng.permutation(290).tolist() + [3, 3, 9, 9, 9, 20, None, None, 4, 5], texts, strict=True)] + [(1000, None), (1001, ""), (1002, hot * 40), (1003, hot * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(str(Row(doc_id=a, n_bytes=b, n_removed=c, n_spans=d, kept_sha256=e)) for a, b, c, d, e in suffix_dedup.brute_force(rows))
    monkeypatch.setattr(suffix_dedup, "PARTITION_BYTES", 1 << 11)  # some 20 index partitions
    monkeypatch.setattr(suffix_dedup, "MOST_TASKS", 2)  # that share the shuffle's 4 tasks
    for most in (0, 5, 1 << 15):
        assert sorted(map(str, suffix_dedup.digests(suffix_dedup.remove_repeats(df, hot=most)).collect())) == want


def test_hot_windows_are_spread():
    """20,000 texts that share 20 bytes: windows of hot anchors are even over 64 index partitions; unspread, one gets many times its share."""
    import pyarrow as pa

    rng, n = np.random.default_rng(6), 64
    around = rng.integers(97, 123, (20000, 80), np.uint8)
    around[:, 30:50] = np.frombuffer(b"shared passage here!", np.uint8)
    texts = [r.tobytes().decode() for r in around]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["k", "t"])
    offers = [r for b in suffix_dedup._offers(n)(iter([batch])) for r in b.to_pylist()]
    as_batch = lambda rows: pa.RecordBatch.from_pylist(sorted(rows, key=lambda r: (r["home"], r["kind"])), pa.schema({"home": pa.int32(), "kind": pa.int32(), "blob": pa.binary()}))
    for hot, even in ((50, True), (1 << 30, False)):
        half = [r for b in suffix_dedup._settle(n, hot)(iter([as_batch(offers)])) for r in b.to_pylist() if r["kind"] == suffix_dedup.HALF]
        by_home: dict = {}
        for h, at in suffix_dedup._groups(suffix_dedup._home(np.arange(len(texts)), n)):
            by_home[h] = batch.take(pa.array(at))
        packed = [r for h, part in by_home.items() for b in suffix_dedup._packed(n, ["k", "t"])(iter([part])) for r in b.to_pylist()]
        sent = [r for b in suffix_dedup._doubtful(n)(iter([as_batch(half + packed)])) for r in b.to_pylist()]
        windows = np.zeros((2, n), int)  # of other anchors, of hot ones
        for r in sent:
            size = int.from_bytes(r["blob"][:8], "little")
            _, _, flag, _, length = suffix_dedup._unpress(r["blob"][8 : 8 + size], "i8", "u8", "u1", "u1", "u2")
            np.add.at(windows[:, r["home"]], (flag >> 2).astype(int), length.astype(int) - suffix_dedup.MATCH + 1)
        if even:
            assert windows[1].sum() > 20000
            assert windows[1].max() < 1.5 * windows[1].mean()
        else:
            assert windows[1].sum() == 0
            assert windows[0].max() > 5 * windows[0].mean()


def test_family_merges_geometrically():
    f, rng, all_ = suffix_dedup.Family(), np.random.default_rng(7), {}
    for _ in range(40):
        k, i = rng.integers(0, 500, 60).astype(np.uint64), rng.integers(0, 1000, 60)
        for a, b in zip(k.tolist(), i.tolist(), strict=True):
            all_[a] = min(b, all_.get(a, b))
        f.insert(k, i)
    assert len(f.levels) <= 10
    keys = np.arange(600).astype(np.uint64)
    assert f.least(keys).tolist() == [all_.get(k, suffix_dedup.LAST_ID) for k in range(600)]


# ---- 7 near duplicates ----


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(500)]
    docs = []
    for _ in range(50):
        t = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 40, 150]))]
        docs.append(" ".join(t))
        for _ in range(rng.randrange(0, 5)):
            u = t[:]
            for _ in range(rng.randrange(0, 5)):
                u[rng.randrange(len(u))] = "q" + str(rng.randrange(9))
            docs.append(" ".join(u))
            if rng.random() < 0.4:
                t = u
    docs += ["", None, "", "one", "one", "two words", "line again\n" * 60, "line again\n" * 62]
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    rows = list(zip(ids, docs, strict=True)) + [(ids[0], docs[0])]
    sets = [dart_minhash.shingles([d or ""])[0] for _, d in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or dart_minhash.similarity(sets[i], sets[j]) >= 0.8:
                parent[root(i)] = root(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(root(i), set()).add(k)
    want = {k: min(g) for g in groups.values() for k in g}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"k": F.lit(0), "tid": F.lit(1), "label": F.lit(2), "bands": F.lit(3)})
    got = dart_minhash.classes(df).collect()
    assert len(got) == len(rows) and {r.doc_id: r.class_id for r in got} == want
    stay = dart_minhash.one_of_each(df)
    assert stay.columns == df.columns and sorted(r.doc_id for r in stay.collect()) == sorted(set(want.values()))
    assert dart_minhash.classes(no_rows(df)).count() == 0 and dart_minhash.one_of_each(no_rows(df)).count() == 0


def test_dense_group_of_weak_copies(spark):
    """Texts whose links are few among many near misses: no link between components is lost."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for _ in range(120):
        u = base[:]
        for _ in range(rng.randrange(1, 9)):
            u[rng.randrange(120)] = "z" + str(rng.randrange(10**6))
        docs.append(" ".join(u))
    sets = dart_minhash.shingles(docs)
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        if dart_minhash.similarity(sets[i], sets[j]) >= 0.8:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    got = {r.doc_id: r.class_id for r in dart_minhash.classes(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert got == {i: root(i) for i in range(len(docs))}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(10)
    a = {int(k): int(w) for k, w in zip(rng.integers(1, 1 << 60, 200), rng.integers(1, 9, 200), strict=True)}
    b = dict(list(a.items())[:160]) | {k: max(1, w - 2) for k, w in list(a.items())[160:]}
    both, k = [sorted(a.items()), sorted(b.items())], 2048
    doc = np.repeat([0, 1], [len(x) for x in both])
    el, w = np.array([e for x in both for e, _ in x], np.uint64), np.array([c for x in both for _, c in x], float)
    sig = dart_minhash.signatures(doc, el, w, 2, k)
    true = sum(min(a[e], b[e]) for e in a) / sum(max(a[e], b[e]) for e in a)
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / k)
    alone = dart_minhash.signatures(np.zeros(len(a), int), el[: len(a)], w[: len(a)], 1, k)
    assert (alone[0] == sig[0]).all()


# ---- very long texts ----


def test_very_long_texts(spark):
    """A million characters of words, of one word, and of nothing but signs, twice each beside short texts."""
    words = " ".join(f"w{i % 5000} de la" for i in range(90_000))
    texts = {1: words, 2: "x" * 300_000, 3: "$ " * 300_000, 4: "short text of six words here", 11: words, 12: "x" * 300_000, 13: "$ " * 300_000, 5: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")}).repartition(3)
    got = {r.doc_id: r.class_id for r in dart_minhash.classes(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 11: 1, 12: 2, 13: 3, 5: 5}
    cut = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.digests(suffix_dedup.remove_repeats(docs)).collect()}
    assert cut == {k: (len(texts[k]), 1) if k > 10 else (0, 0) for k in texts}
    mixed = {r.doc_id: (r.size, r.taken) for r in mixing.mix(docs).collect()}
    assert {k: v[0] for k, v in mixed.items()} == {k: len(t.split()) for k, t in texts.items()} and sum(v[1] for v in mixed.values()) == sum(len(t.split()) for t in texts.values())
    found = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert found == {k: "en" if k in (1, 2, 4, 11, 12) else "und" for k in texts}
    ordered = sorted(texts)
    near = {r.doc_id: r for r in simhash.edited_and_next(docs).collect()}
    for k, after in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        t, q = texts[k], len(texts[k]) // 4
        assert near[k].n_chars == len(t) and near[k].edited_sha256 == hashlib.sha256((t[: len(t) - q] + texts[after][:q]).encode()).hexdigest()
    assert near[1].fingerprint == near[11].fingerprint
    from tokenizers import Tokenizer

    tok, at = Tokenizer.from_file(token_store.default_tokenizer()), 0
    ids = {r.doc_id: r for r in token_store.round_trip(docs).collect()}
    for k in ordered:
        want = np.array([*tok.encode(texts[k], add_special_tokens=False).ids, 1], "<u4")
        assert (ids[k].start, ids[k].n_tokens, ids[k].ids_crc32) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    lib = piece_codec.PieceVocabulary(piece_codec.default_model()).lib
    for r in piece_codec.encode_decode(docs).collect():
        assert r.ids == lib.encode(texts[r.doc_id]) and r.decoded == texts[r.doc_id] and r.agreed


# ---- 8 main text ----


def test_minimum_cut_against_all_labellings():
    rng = random.Random(11)
    for _ in range(60):
        n = rng.randrange(1, 9)
        odds = [rng.uniform(-2, 2) for _ in range(n)]
        ties = [(i, j, rng.uniform(0, 1.5)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cost = lambda y, odds=odds, ties=ties: sum(max(0, -o) if k else max(0, o) for o, k in zip(odds, y, strict=True)) + sum(w for i, j, w in ties if y[i] != y[j])
        assert abs(cost(html_cut.minimum_cut(odds, ties)) - min(cost(y) for y in itertools.product((False, True), repeat=n))) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site name and motto of many words here.</a></header><nav><ul><li><a href=1>Home</a></li><li><a>News</a></li></ul></nav>
<div class="cookie-notice">We use cookies to improve what you see on this site, please agree.</div><!-- <p>hidden</p> -->
<div id="content"><h1>A title &amp; more</h1><p>The first   paragraph has<br>several words, and <b>bold</b>ly so.<p>The second is not closed; it says &lt;p&gt; and 1 &lt; 2, to be sure.
<blockquote>Short quote.</blockquote><p>The third paragraph ends the article with a sentence of its own.</div>
<aside><p>Related things that you might like to read, and there are many of them.</p></aside>
<form><label>Mail</label><input><p>Sign up here to get more of what you like every week.</p></form>
<div class="comments"><p>I am a reader and I liked this text very much, thank you all.</p></div>
<footer><p>All rights reserved, and many more words of a legal kind.</p></footer></body></html>"""


def test_main_text_of_a_page():
    want = "A title & more\nThe first paragraph has several words, and boldly so.\nThe second is not closed; it says <p> and 1 < 2, to be sure.\nShort quote.\nThe third paragraph ends the article with a sentence of its own."
    assert html_cut.main_text(PAGE) == want


ARTICLE = "<h1>On rivers</h1><p>Rivers carry water to the sea, and much else besides.</p><p>Yes.</p><p>They also carry silt, which settles where the current slows down.</p>"
ARTICLE_TEXT = "On rivers\nRivers carry water to the sea, and much else besides.\nYes.\nThey also carry silt, which settles where the current slows down."


@pytest.mark.parametrize(
    "page",
    [
        '<body class="single-post has-sidebar">{}</body>', '<body class="cookies-not-set"><nav><a href=x>Home</a></nav>{}</body>', '<div class="modal-open">{}</div>', '<div id="page-header-wrap" class="site-content">{}</div>', '<article class="post tags-news category-alert">{}</article>',
        '<div class="header"><div class="entry">{}</div></div><div class="footer">Legal words that fill a whole line, at least.</div>', '<main role="main">{}<aside><p>Something else to read, told at some length.</p></aside></main>', '<div class="comments-open">{}</div><div class="comments"><p>I read this text and liked it a lot.</p></div>',
    ],
)
def test_words_around_the_text_dont_empty_it(page):
    assert html_cut.main_text(page.format(ARTICLE)) == ARTICLE_TEXT


def test_sentence_goes_on_after_an_inline_hint():
    assert html_cut.main_text('<p>Water is <span class="tags-h2o">H2O</span> and nothing else, they say.</p>') == "Water is H2O and nothing else, they say."


def scrambled(tag_soup: str, rng) -> str:
    """The page with all elements but links as divs, and class names that tell nothing."""
    import re

    page = re.sub(r"<(script|style|head|title)\b.*?</\1>", "", tag_soup, flags=re.S)
    return re.sub(r"<(/?)(?!a\b|b\b|br\b|/)[a-zA-Z][^>]*>", lambda m: "</div>" if m[1] else f'<div class="{"".join(rng.choices("bcdfghjk", k=5))}">', page)


def by_role(page: str) -> str:
    """What the nearest telling element alone says of each block; blocks without one stay."""
    blocks, elements = html_cut.parse(page)
    x = html_cut.features(blocks, elements)
    return "\n".join(b.text for b, r in zip(blocks, x, strict=True) if r[html_cut.TEXT] + r[html_cut.TEXT + 1] >= 0)


def words_hit(got: str, want: str) -> float:
    """F-measure over lines."""
    a, b = got.split("\n"), want.split("\n")
    both = len([x for x in a if x in set(b)])
    return 2 * both / max(1, len(a) + len(b))


def test_the_cut_finds_articles_without_telling_markup(spark):
    """All elements are divs of random class: text and neighbours decide, and a lookup of roles keeps everything."""
    rng = random.Random(8)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights, hits, looked = html_cut.fit(pages), [], []
    for r in pages.collect():
        want = html_cut.main_text(r.html, weights)
        page = scrambled(r.html, rng)
        hits.append(words_hit(html_cut.main_text(page, weights), want))
        looked.append(words_hit(by_role(page), want))
    assert np.mean(hits) > 0.78 and np.mean(hits) > np.mean(looked) + 0.1  # adverts and footers of whole sentences are what is left


PARAGRAPH = "The harbour was closed for eleven days that winter, and nobody in the town could remember such a thing ever having happened before."


@pytest.mark.parametrize(
    "page, want",
    [
        # a class word that the text under it outvotes
        (f'<article><p>{PARAGRAPH}</p><div class="tags"><p>{PARAGRAPH}</p></div><p>{PARAGRAPH}</p></article>', [PARAGRAPH] * 3),
        (f'<div class="entry"><p>{PARAGRAPH}</p><div class="legal"><p>{PARAGRAPH}</p></div></div>', [PARAGRAPH] * 2),
        # the same word over links stays out
        (f'<article><p>{PARAGRAPH}</p><div class="tags"><a href=1>sea</a> <a href=2>ships</a></div></article>', [PARAGRAPH]),
        # a word of content over a list of links doesn't make it text
        (f'<div class="content"><ul><li><a href=1>Home</a></li><li><a href=2>About us</a></li><li><a href=3>Contact</a></li></ul></div><div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div>', [PARAGRAPH] * 2),
        # nothing tells but the text
        (f'<div class=x1><div><a href=1>Home</a></div><div><a href=2>News</a></div></div><div class=x2><div>{PARAGRAPH}</div><div>Yes.</div><div>{PARAGRAPH}</div></div><div class=x3><a href=3>Imprint</a></div>', [PARAGRAPH, "Yes.", PARAGRAPH]),
    ],
)
def test_the_cut_decides(page, want):
    assert html_cut.main_text(page) == "\n".join(want)
    assert "ships" in page or by_role(page) != "\n".join(want)


@pytest.mark.parametrize(
    "tag",
    ["<p title=don't>", '<p title=5">', "<p title='a>b' x=\">", "<p 'odd' \"names\">", "<p a = b'c>", "<p =x y>", "<p a=>", '<p data-x="1"id="y"/>', "<p\n\tclass\n=\n'x y'\n>", "<p \" >", "<p title=\"never closed>"],
)
def test_odd_attributes_lose_no_text(tag):
    second, third = "The second paragraph is here, with as many words as are needed.", "The third paragraph ends the article with a sentence of its own."
    page = f"<article><p>{PARAGRAPH}</p>{tag}{second}</p><p>{third}</p></article>"
    assert html_cut.main_text(page) == "\n".join([PARAGRAPH, second, third])


@pytest.mark.parametrize("text", ["If a <é then it holds.", "We have 1 <2 and x<ß, or y <日本.", "An arrow <- and <= and <3 and < alone.", "One </é>ends nothing."])
def test_less_than_signs_are_text(text):
    page = f"<article><p>{PARAGRAPH}</p><p>{text}</p><p>{PARAGRAPH}</p></article>"
    assert html_cut.main_text(page) == "\n".join([PARAGRAPH, text.replace("</é>", ""), PARAGRAPH])


def test_fit_moves_towards_the_labels():
    rng = np.random.default_rng(4)
    x = np.column_stack([np.ones(8000), rng.random((8000, 6)), np.zeros((8000, 2))])
    y = x[:, 1] > 0.5  # linked blocks are content here
    w = html_cut.regress(x, y)
    assert w[1] > 1 and np.array_equal(html_cut.regress(x, np.zeros(8000, bool)), html_cut.PRIOR) and ((x @ w > 0) == y).mean() > 0.9


def test_broken_markup_is_one_pass():
    import time

    for page in ('<a b="' * 180_000, "<!--" * 250_000, "<p" * 500_000, "<" * 10**6, "<div>x" * 150_000, "</" * 500_000, "<script>" * 100_000, "a<b " * 250_000):
        began = time.process_time()
        html_cut.parse(page)
        assert time.process_time() - began < 4, page[:10]
    began = time.process_time()
    html_cut.parse('<a b="' * 180_000)
    assert time.process_time() - began < 1


def test_text_after_inline_boilerplate_stays():
    for tag, words in (("span", ' class="share"'), ("button", ""), ("b", ' id="promo"')):
        assert html_cut.main_text(f"<p>Alpha <{tag}{words}>Share</{tag}> gamma delta.</p>") == "Alpha gamma delta."
    assert html_cut.main_text('<p>Alpha <span class="share">Share <span>this</span> now</span> gamma delta.</p>') == "Alpha gamma delta."
    assert html_cut.main_text('<p>Alpha <i class="share">Share <b class="ad">it</i> now</b> gamma delta.</p>') == "Alpha gamma delta."


def test_wrappers_around_the_text_dont_cut_it():
    text = "The paragraph has several words, and ends with a full stop."
    for page in ('<body class="no-sidebar"><p>{}</p></body>', '<form id="aspnetForm"><nav><a href="/">Home</a></nav><p>{}</p></form>', '<div class="page with-sidebar"><article><p>{}</p></article></div>', '<form id="search"><main><form><article><p>{}</p></article></form></main></form>'):
        assert html_cut.main_text(page.format(text)) == text
    assert html_cut.main_text(f'<article><p>{text}</p><div class="related"><article><p>Another text of many words, told elsewhere.</p></article></div></article><aside><article><p>One more text of many words.</p></article></aside>') == text


def test_formulas_and_fallback_text_stay():
    page = '<p>We know that <math><mi>a</mi><mo>=</mo><mi>b</mi><annotation encoding="application/x-tex">a=b</annotation></math> holds.</p><noscript><p>The text for readers without scripts.</p></noscript><object data="x"><p>The text for readers without the object.</p></object>'
    assert html_cut.main_text(page) == "We know that a=b holds.\nThe text for readers without scripts.\nThe text for readers without the object."


def test_extract_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "v", "<"), (4, "v", "<a href='"), (5, "v", "</p></div>"), (6, "v", "<script>only"), (7, "v", "<p>" * 3000 + "deep words in many paragraphs, all open."), (8, "w", PAGE), (8, "w", PAGE), (None, "x", "<!-- open")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"k": F.lit(1), "u": F.lit(2), "h": F.lit(3), "text": F.lit(4)})
    got = html_cut.extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (1, 2, 5, 6, None)} == {""} and {r.text for r in got if r.page_id == 7} == {"deep words in many paragraphs, all open."}
    assert html_cut.extract(no_rows(df)).count() == 0


def test_extract_equals_the_articles_of_the_pages(spark):
    import html as h
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op8_html_cut(spark, SF).collect():
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = (" ".join(h.unescape(re.sub(r"</?b>", "", p).replace("<br>", " ")).split()) for p in re.split(r"</?(?:p|h1)>", body))
        assert r.text == "\n".join(p for p in parts if p)


# ---- 9 token store ----


def test_token_store_equals_the_library(spark, odd_docs, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "SEGMENT_TOKENS", 40)
    tok = Tokenizer.from_file(token_store.default_tokenizer())
    docs = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).cache()
    got = sorted(token_store.round_trip(docs).collect())
    start = 0
    for r, (k, t) in zip(got, sorted((r.doc_id, r.text or "") for r in docs.collect()), strict=True):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    odd = token_store.round_trip(odd_docs).collect()
    assert len(odd) == odd_docs.count() and max(odd, key=lambda r: r.start).doc_id is None
    assert token_store.round_trip(no_rows(odd_docs)).count() == 0


def test_direct_codes_random_access():
    rng = np.random.default_rng(12)
    for values in (np.zeros(0, np.uint32), np.zeros(5, np.uint32), rng.integers(0, 1 << 32, 3000, dtype=np.uint32), (2.0 ** rng.uniform(0, 20, 5000)).astype(np.uint32), np.full(129, 256, np.uint32)):
        code = token_store.DirectCodes.from_bytes(token_store.DirectCodes.encode(values).to_bytes())
        at = rng.permutation(len(values))
        assert (code.access(at) == values[at]).all() and (code.all() == values).all()


# ---- 10 SimHash ----


def test_edited_and_next(spark, odd_docs):
    docs = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).cache()
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = sorted(simhash.edited_and_next(docs).collect())
    fps = simhash.fingerprints([t for _, t in rows])
    for i, r in enumerate(got):
        t, nxt = rows[i][1], rows[(i + 1) % len(rows)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        f = simhash.fingerprints([e])[0]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (rows[i][0], len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (f"{fps[i]:016x}", f"{f:016x}")
        assert r.near_edited == simhash.likeness(fps[i], f) and r.near_next == simhash.likeness(fps[i], fps[(i + 1) % len(rows)])
    assert simhash.edited_and_next(odd_docs).count() == odd_docs.count()
    assert simhash.edited_and_next(no_rows(odd_docs)).count() == 0
    lone = simhash.edited_and_next(docs.limit(1)).first()
    assert lone.near_next == 1.0


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(13)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for f in fps for _ in range(3)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps] + [None]
    df = spark.createDataFrame([(f,) for f in signed], "fingerprint long").withColumn("t", F.lit(0))
    for radius in (0, 3, 4):
        got = {(r.query_fp, r.fp): r.distance for r in simhash.within_radius(df, df, radius).collect()}
        want = {(a, b): ((a ^ b) & ((1 << 64) - 1)).bit_count() for a in set(signed[:-1]) for b in set(signed[:-1]) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= radius}
        assert got == want


@pytest.mark.parametrize("held", [1 << 18, 7])
def test_counts_within_the_radius(spark, monkeypatch, held):
    """Counts against all pairs, with a dense bucket; with `held` of 7, buckets are shared out."""
    monkeypatch.setattr(simhash, "BUCKET_QUERIES", held)
    rng = random.Random(17)
    fps = [rng.getrandbits(64) for _ in range(10)]
    fps += [fps[0] ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)] + [0]
    rows = [(i, f"{f:016x}") for i, f in enumerate(fps + fps[:5])] + [(None, f"{fps[3]:016x}")]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string").repartition(3)
    for every in (1, 3):
        got = {(r.doc_id, r.fingerprint): r.near_fingerprints for r in simhash.with_neighbours(df, every).collect()}
        assert len(got) == len(rows)
        for i, f in rows:
            want = sum(0 < (int(f, 16) ^ g).bit_count() <= 3 for g in set(fps)) if i is not None and i % every == 0 else None
            assert got[i, f] == want
    assert simhash.with_neighbours(no_rows(df)).count() == 0


def test_equal_texts_have_equal_fingerprints(spark, odd_docs):
    got = simhash.fingerprint_table(odd_docs).where("doc_id = 3").collect()
    assert len(got) == 3 and len({r.fingerprint for r in got}) == 2
