"""From raw documents to token ids: five stages, each one of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import dart_minhash, langid, mixing, piece_codec, suffix_dedup
from tidemark.session import made, release, shared_dir, table

#: A document stays if a language is found with at least this probability.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts among them), and those whose language is not found with LEAST_SCORE.

    Rows that repeat are judged alike. Without any labelled row nothing can be found, and no row stays.
    """
    model = langid.fit(docs)
    rest = tuple(c for c in docs.columns if c != "doc_id")
    found = langid.predict(docs, model, keep=rest)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near duplicates.

    Null texts are empty, and empty texts one class; of null ids the one with the smallest text_id stays,
    after all others. Of rows that repeat id and text one stays.
    """
    return dart_minhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes or more that start in a document with a smaller id; n_chars follows. No row goes.

    Null texts become empty ones. Rows of equal ids don't cut each other; null ids come last. Characters of
    which a part was cut go as a whole.
    """
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = suffix_dedup.remove_repeats(docs, keep=rest, as_text=True).withColumnRenamed("kept", "text")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; a part of at least a half counts as once.

    Documents without words are not taken. Rows of equal id and text are taken together.
    """
    tid = dart_minhash.text_id("text")
    sized = mixing.mix(docs.withColumn("text_key", tid), mixing.quality_weights(table(spark, sf_dir, "labels")), keep=("text_key",))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)
    taken = sized.groupBy(F.col("doc_id").alias("k"), F.col("text_key").alias("t")).agg(F.sum(copies).alias("copies")).where("copies > 0")
    rows = docs.withColumn("text_key", tid).dropDuplicates(["doc_id", "text_key"])
    joined = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("text_key") == F.col("t")))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256, agreed, ids), one for each copy in the mix.

    Null and empty texts have no ids; rows that repeat are encoded alike, one row each.
    """
    encoded = piece_codec.encode_decode(docs)
    return piece_codec.digests(encoded, keep=("ids",))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]
#: SQL can't express the learned, hashed and tokenized stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's own folders, and its input, go once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, keep=(*before, path))
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
