"""op2: what stands as a text's decoded form is what the library's decode makes of that text's ids."""

import pyarrow as pa

from tidemark.llm import piece_codec


def test_every_text_is_decoded_from_its_ids(spark, monkeypatch):
    vocab = piece_codec._worker(piece_codec.default_model())[0]
    asked, held, runs = [], vocab.lib, []

    class Seen:
        def encode(self, text):
            return held.encode(text)

        def decode(self, ids):
            asked.append(tuple(ids))
            return held.decode(ids)

    monkeypatch.setattr(vocab, "lib", Seen())
    monkeypatch.setattr(piece_codec, "batchwise", lambda run, schema: runs.append(run) or (lambda df: df))
    docs = spark.createDataFrame([(0, "x")], "doc_id long, text string")
    piece_codec.encode_decode(docs)
    texts = [f"text {i} \t of 日本 ▁ \x07 words" for i in range(200)] + ["", None]
    rows = [r for b in runs[0]([pa.record_batch({"k": list(range(len(texts))), "t": texts})]) for r in b.to_pylist()]
    want = [held.encode(t or "") for t in texts]
    assert [r["ids"] for r in rows] == want and [r["decoded"] for r in rows] == [held.decode(i) if i else "" for i in want]
    assert set(map(tuple, want)) - {()} <= set(asked)
