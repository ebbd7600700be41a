"""Whole tables written in the library's file formats, or run through its streams, and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import store as st
from tidemark.plans import relations
from tidemark.session import shared_dir, table
from tidemark.sources import files
from tidemark.streaming import limits
from tidemark.streaming import usage as stream


# ---- files ----


def catalog_tracks(spark, d):
    """Documents as tracks of a catalog."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("track_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_path"), F.sha2(text, 256).alias("sha256"), (F.length(text) / 8).alias("duration_sec"),
        F.octet_length(text).cast("long").alias("bytes"), F.length(text).cast("int").alias("fingerprint_count"), F.col("lang").alias("title"), F.col("source").alias("artist"),
    )


def catalog_files(spark, d):
    """A catalog saved, its content checked against its head, and loaded."""
    path = shared_dir(spark, "catalog")
    st.save_catalog(catalog_tracks(spark, d), path, "documents")
    return st.load_catalog(spark, path).withColumn("fingerprint_count", F.col("fingerprint_count").cast("long"))


def manifest_file(spark, d):
    """Documents as a corpus manifest: one JSON object over the parts of a folder, read back line by line."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tracks = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("track_id"), F.concat(F.lit('a "b"/'), F.col("doc_id").cast("string")).alias("path"), F.sha2(text, 256).alias("sha256"), "source", F.coalesce("lang", F.lit("none")).alias("license"), F.lit(None).cast("string").alias("license_url"),
        (F.length(text) / 8).alias("duration_sec"), F.octet_length(text).cast("long").alias("bytes"), F.substring(text, 1, 40).alias("title"), F.lit("x").alias("artist"), F.col("lang").alias("genre"), F.lit(None).cast("string").alias("source_url"), (F.col("doc_id") % 5 == 0).alias("held_out"),
    )
    path = shared_dir(spark, "manifest")
    files.save_manifest(tracks, path)
    return files.manifest(spark, path).withColumn("version", F.col("version").cast("long")).drop("content_hash", "license_url", "source_url")


def query_index(spark, d):
    """Conversation turns as query specifications, through JSON lines."""
    c = table(spark, d, "conversations")
    name = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    specs = c.select(
        name.alias("query_id"), F.col("conv_id").cast("string").alias("track_id"), (F.length("text") / 4).alias("duration"), F.when(F.col("turn") == 0, "head").otherwise("tail").alias("position"), F.col("role").alias("condition"), F.lit("clean").alias("family"),
        F.map_from_arrays(F.array(F.lit("turn")), F.array(F.col("turn").cast("string"))).alias("params"), F.col("turn").cast("long").alias("seed"), F.md5("text").alias("source_hash"), (F.col("role") == "system").alias("is_negative"),
    )
    path = shared_dir(spark, "query-index")
    files.write_query_index(specs, path)
    read = files.query_index(spark, path)
    return read.select("query_id", "track_id", "duration", "position", "condition", "family", F.col("params")["turn"].alias("turn"), "seed", "source_hash", "is_negative", F.col("rendered_path").isNull().alias("unrendered"))


def annotation_csv(spark, d):
    """Parts as an annotation sheet in CSV with comments and blank rows; the rules that its rows break, counted."""
    k = F.col("p_partkey")
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '\\\\"'), F.lit('"'))
    cells = [
        F.when(k % 40 == 1, "").otherwise(k.cast("string")), F.lit("a.wav"), quoted(F.concat("p_name", F.lit(", mixed"))), F.col("p_brand"), F.when(k % 40 == 2, "0").otherwise(F.col("p_size").cast("string")), F.lit("CC0-1.0"), F.lit("u"),
        F.when(k % 40 == 3, "9").when(k % 40 == 4, "no_stable_tempo").otherwise("120.5"), F.lit("C major"), F.when(k % 40 == 5, "open").when(k % 4 == 0, "pending").otherwise("annotated"), F.when(k % 40 == 7, "").otherwise("ann"),
        F.when(k % 40 == 9, "yesterday").otherwise("2026-08-31T14:05:00Z"), F.lit(""),
    ]
    before = F.when(k % 50 == 0, F.array(F.lit("# a comment, here"), F.lit(",,,"), F.lit("track_id,path,title"))).otherwise(F.array().cast("array<string>"))
    lines = table(spark, d, "part").select(F.explode(F.concat(before, F.array(F.concat_ws(",", *cells)))).alias("value"))
    path = shared_dir(spark, "sheet")
    lines.write.text(path)
    return files.annotation_errors(files.annotation_sheet(spark, path)).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


# ---- streams ----


def stream_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files; as a pattern, since the source takes a single file's path for a folder."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def streamed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """What a stream gives for all there is, through a file sink."""
    key, provider = limits.STATE_STORE
    before = spark.conf.get(key)
    path = shared_dir(spark, "stream")
    spark.conf.set(key, provider)
    try:
        rows.writeStream.format("parquet").option("checkpointLocation", shared_dir(spark, "stream-state")).trigger(availableNow=True).start(path).awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(rows.schema).parquet(path)


def stream_events(spark, d):
    e = stream_of(spark, d, "events")
    return e.select((F.col("user_id") % 10).alias("tenant"), F.col("user_id").alias("key_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("audio_seconds"), (F.col("event_type") == "purchase").alias("matched"))


def stream_quota(spark, d):
    out = streamed(spark, limits.quota(stream_events(spark, d), 500.0))
    return out.groupBy("tenant").agg(F.count(F.lit(1)).alias("requests"), F.sum(F.when(F.col("accepted"), 1).otherwise(0)).alias("accepted"))


def stream_bucket(spark, d):
    return streamed(spark, limits.token_bucket(stream_events(spark, d), rate=1 / 3600, burst=2.0))


def stream_interval(spark, d):
    return streamed(spark, limits.minimum_interval(stream_events(spark, d), 1800.0)).groupBy("key_id").agg(F.sum("wait_micros").alias("wait_micros"))


def stream_usage(spark, d):
    """Daily usage by write-behind micro-batches."""
    path = shared_dir(spark, "usage")
    stream.write_behind(stream_events(spark, d), path, shared_dir(spark, "usage-state")).awaitTermination()
    return stream.usage_table(spark, path).withColumns({"usage_day": F.col("usage_day").cast("string"), "audio_seconds": F.col("audio_seconds").cast("double")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "catalog_files__S9": catalog_files,
    "manifest_file__S16": manifest_file,
    "query_index__S15": query_index,
    "annotation_csv__S18": annotation_csv,
    "stream_quota__T2": stream_quota,
    "stream_bucket__T1": stream_bucket,
    "stream_interval__T5": stream_interval,
    "stream_usage__T3": stream_usage,
}

ORACLE_SQL = {
    "catalog_files__S9": """SELECT doc_id::VARCHAR AS track_id, concat_ws('/', source, doc_id::VARCHAR) AS source_path, sha256(coalesce(text, '')) AS sha256, length(coalesce(text, '')) / 8.0::DOUBLE AS duration_sec,
  octet_length(encode(coalesce(text, '')))::BIGINT AS bytes, length(coalesce(text, ''))::BIGINT AS fingerprint_count, lang AS title, source AS artist FROM documents""",
    "manifest_file__S16": """SELECT 1::BIGINT AS version, doc_id::VARCHAR AS track_id, 'a "b"/' || doc_id::VARCHAR AS path, sha256(coalesce(text, '')) AS sha256, source, coalesce(lang, 'none') AS license, length(coalesce(text, '')) / 8.0::DOUBLE AS duration_sec,
  octet_length(encode(coalesce(text, '')))::BIGINT AS bytes, substr(coalesce(text, ''), 1, 40) AS title, 'x' AS artist, lang AS genre, doc_id % 5 = 0 AS held_out FROM documents""",
    "query_index__S15": """SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS query_id, conv_id::VARCHAR AS track_id, length(text) / 4.0::DOUBLE AS duration, CASE WHEN turn = 0 THEN 'head' ELSE 'tail' END AS position,
  role AS condition, 'clean' AS family, turn::VARCHAR AS turn, turn::BIGINT AS seed, md5(text) AS source_hash, role = 'system' AS is_negative, TRUE AS unrendered FROM conversations""",
    "annotation_csv__S18": """WITH s AS (SELECT p_partkey % 40 AS k, p_size, CASE WHEN p_partkey % 40 = 5 THEN 'open' WHEN p_partkey % 4 = 0 THEN 'pending' ELSE 'annotated' END AS status FROM part),
e AS (SELECT 'track_id is missing' AS error FROM s WHERE k = 1 UNION ALL SELECT 'unknown status' FROM s WHERE status = 'open' UNION ALL SELECT 'annotator is missing' FROM s WHERE k = 7 AND status = 'annotated'
  UNION ALL SELECT 'time is not UTC ISO-8601' FROM s WHERE k = 9 AND status = 'annotated' UNION ALL SELECT 'bpm is out of range' FROM s WHERE k = 3 AND status = 'annotated' UNION ALL SELECT 'duration is not positive' FROM s WHERE k = 2 OR p_size <= 0
  UNION ALL SELECT 'track_id repeats' WHERE (SELECT count(*) FROM s WHERE k = 1) > 1)
SELECT error, count(*) AS n FROM e GROUP BY 1""",
    "stream_quota__T2": relations.ORACLE_SQL["quota__T2"],
    "stream_bucket__T1": f"SELECT key_id, event_id, allowed, retry_after FROM ({relations.ORACLE_SQL['token_bucket__T1']})",
    "stream_interval__T5": relations.ORACLE_SQL["min_interval__T5"],
    "stream_usage__T3": relations.ORACLE_SQL["usage_daily__A35_T4"],
}
