"""op11: what a worker remembers is bounded in bytes, not only in units, and so are row groups of blocks."""

import glob

import pyarrow.parquet as pq

from tidemark.llm import token_align as ta


def test_long_units_are_forgotten_by_their_characters(monkeypatch):
    monkeypatch.setattr(ta, "CACHE_CHARS", 5000, raising=False)
    own, fresh = ta.Aligner(*ta.default_models()), ta.Aligner(*ta.default_models())
    for i in range(20):
        text = f"{i:03d}ab" * 200 + " some words"
        found = own.units([text])[0]
        assert sum(map(len, own.place)) <= 5000
        again = fresh.units([text])[0]
        assert [own.groups[u] for u in found] == [fresh.groups[u] for u in again]
        fresh.forget()


def test_blocks_are_written_in_small_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ta, "BLOCK_LINKS", 20_000)
    df = spark.createDataFrame([(i, " ".join(f"w{j % 997}x" for j in range(i, i + 8000))) for i in range(60)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(ta, "ROW_GROUP", {"parquet.block.size": str(1 << 18), "parquet.page.size.row.check.min": "1"}, raising=False)
    ta.write_blocks(df, f"file://{tmp_path}/blocks", "doc_id", "text", ta.default_models())
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{tmp_path}/blocks/part-*")]
    rows = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(rows) > 5 and max(rows) == 1
