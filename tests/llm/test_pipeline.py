"""The corpus pipeline, stage by stage, over the smallest tables, each against a plain version of its own input."""

import hashlib
import itertools

import corpus_pipeline as cp
import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from tidemark.llm import dart_minhash, langid, mixing, piece_codec, suffix_dedup


def odd_rows(docs):
    """Documents with nulls, repeats, ties, an empty and a very long text beside them."""
    long = " ".join(f"palabra{i % 900} de la casa que no es" for i in range(30_000))
    rows = [(10**6, "123 456 !!", None, "src0", 10), (10**6 + 1, None, "en", None, None), (10**6 + 2, "", None, "src0", 0), (10**6 + 3, long, None, "src1", len(long)), (None, "the words of this text have no id at all, none", None, "src1", 46)]
    first = docs.orderBy("doc_id").limit(1)
    return docs.unionByName(docs.sparkSession.createDataFrame(rows, docs.schema)).unionByName(first)


def plain_cut(rows):
    """Bytes left of each row, by comparing all strings."""
    raw = [(suffix_dedup.LAST_ID if k is None else k, (t or "").encode()) for k, t in rows]
    least = {}
    for k, b in raw:
        for i in range(len(b) - suffix_dedup.MATCH + 1):
            w = b[i : i + suffix_dedup.MATCH]
            least[w] = min(k, least.get(w, k))
    out = []
    for k, b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - suffix_dedup.MATCH + 1):
            if least[b[i : i + suffix_dedup.MATCH]] < k:
                gone[i : i + suffix_dedup.MATCH] = True
        out.append(np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


def plain_classes(rows):
    """Sets of row numbers, by comparing all pairs."""
    sets, parent = dart_minhash.shingles([t or "" for _, t in rows]), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] or "") == (rows[j][1] or "") or dart_minhash.similarity(sets[i], sets[j]) >= dart_minhash.SIMILARITY:
            parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    return list(groups.values())


def test_stages(spark, tmp_path):
    docs = odd_rows(spark.read.parquet(f"{SF}/documents.parquet"))
    seen = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        seen[name] = (docs.collect(), spark.read.parquet(str(tmp_path / name)).collect())
        docs = spark.read.parquet(str(tmp_path / name))
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")

    before, after = seen["language_id"]
    model = langid.fit(odd_rows(spark.read.parquet(f"{SF}/documents.parquet")))
    want = [r for r in before if (p := langid.plain_prediction(model, r.text or ""))[0] != langid.UNDETERMINED and p[1] >= cp.LEAST_SCORE]
    assert sorted(map(key, after)) == sorted(map(key, want)) and {r.doc_id for r in before} - {r.doc_id for r in after} == {10**6, 10**6 + 1, 10**6 + 2}

    before, after = seen["near_duplicates"]
    classes = plain_classes([(r.doc_id, r.text) for r in before])
    stay = [min((before[i] for i in c), key=key) for c in classes]
    assert sorted(map(key, after)) == sorted(map(key, stay))

    before, after = seen["repeated_passages"]
    want = {r.doc_id: kept.decode(errors="ignore") for r, kept in zip(before, plain_cut([(r.doc_id, r.text) for r in before]), strict=True)}
    assert {r.doc_id: r.text for r in after} == want and len(after) == len(before) and all(r.n_chars == len(r.text) for r in after)

    before, after = seen["source_mix"]
    sized = mixing.mix(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long"), mixing.quality_weights(spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    want = {r.doc_id: int(r.taken / r.size + 0.5) for r in sized if r.size and int(r.taken / r.size + 0.5)}
    got = {}
    for r in after:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want and max(got.values()) <= 3

    before, after = seen["token_ids"]
    lib = piece_codec.PieceVocabulary(piece_codec.default_model()).lib
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = sorted(((r.doc_id is None, r.doc_id or 0), len(ids), digest(",".join(map(str, ids))), digest(lib.decode(ids))) for r in before for ids in [lib.encode(r.text or "")])
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after) == want and all(r.agreed for r in after)


def test_run_leaves_one_folder_for_each_open_input(spark):
    from tidemark.session import made

    before = made()
    out = cp.run(spark, SF)
    assert out.where(~F.col("agreed")).count() == 0 and out.count() > 0
    left = [p for p in made() if p not in before]
    assert len([p for p in left if "pipeline-" in p]) == 1 and not any("dart-" in p or "suffix-" in p for p in left)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
