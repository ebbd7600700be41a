"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_pieces, dart_minhash, html_cut, langid, mixing, piece_codec, simhash, suffix_dedup, token_align, token_store, warc, whitening
from .common import shared_dir, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs, langid.fit(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(piece_codec.encode_decode(table(spark, sf_dir, "documents")))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = mixing.quality_weights(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), weights).select("doc_id", "size", "source_size", "target", "taken")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(warc.round_trip(table(spark, sf_dir, "pages"), payloads=False))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dart_minhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("stays"))


def op8_html_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_cut.extract(table(spark, sf_dir, "pages"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "simhash")
    simhash.edited_and_next(table(spark, sf_dir, "documents")).write.parquet(path)
    return simhash.with_neighbours(spark.read.parquet(path))


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.link_statistics(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_byte_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pieces.digests(byte_pieces.encode_decode(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_piece_codec": op2_piece_codec,
    "op3_source_mix": op3_source_mix,
    "op4_warc": op4_warc,
    "op5_nearest": op5_nearest,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_dart_minhash": op7_dart_minhash,
    "op8_html_cut": op8_html_cut,
    "op9_token_store": op9_token_store,
    "op10_simhash": op10_simhash,
    "op11_token_align": op11_token_align,
    "op12_whitening": op12_whitening,
    "op13_byte_pieces": op13_byte_pieces,
}
ORACLE_SQL: dict[str, str] = {"op3_source_mix": mixing.ORACLE_SQL}
