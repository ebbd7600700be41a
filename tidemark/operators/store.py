"""Catalogs and artifacts as files: saved, loaded, published by content, verified, and compared."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import valid_catalog_id, version
from tidemark.sources.files import members, verify

CATALOG_TRACK = "track_id string, source_path string, sha256 string, duration_sec double, bytes bigint, fingerprint_count int, title string, artist string"
#: The manifest of an artifact, beside its folder, not in it.
MANIFEST = "manifest.json"


class StorageError(ValueError):
    """An id or version that can't name an artifact, or an artifact that isn't there."""


class ArtifactConflict(StorageError):
    """The key holds other bytes; they are never overwritten."""


class ArtifactIncomplete(StorageError):
    """What was stored or fetched doesn't match its manifest."""


def pair_hash(rows: DataFrame, group: str, key: str, digest: str) -> DataFrame:
    """(group, track_count, content_hash): sha256 of the JSON text of each group's sorted (key, digest) pairs.

    The text is a list of two-element lists with ", " between, so it equals what any JSON writer with
    default separators gives. Rows stream through in order; a group is never held.
    """

    def run(batches):
        import hashlib

        import pyarrow as pa

        now, h, n = None, None, 0
        out: list[tuple] = []
        for batch in batches:
            for g, k, d in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if h is None or g != now:
                    if h is not None:
                        h.update(b"]")
                        out.append((now, n, h.hexdigest()))
                    now, h, n = g, hashlib.sha256(b"["), 0
                h.update(((", " if n else "") + json.dumps([k, d])).encode())
                n += 1
        if h is not None:
            h.update(b"]")
            out.append((now, n, h.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())], names=["g", "track_count", "content_hash"])

    cols = rows.select(F.col(group).cast("string").alias("g"), F.col(key).cast("string").alias("k"), F.col(digest).alias("d"))
    dealt = cols.repartition("g").sortWithinPartitions("g", "k", "d")
    return dealt.mapInArrow(run, "g string, track_count bigint, content_hash string").withColumnRenamed("g", group)


def lines_hash(rows: DataFrame, path: str, digest: str) -> Column:
    """Aggregate: sha256 over the sorted lines 'path:digest'; a missing file's digest is 'missing'. For lists of source files."""
    line = F.concat(F.col(path), F.lit(":"), F.coalesce(F.col(digest), F.lit("missing")), F.lit("\n"))
    return F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "").cast("binary"), 256)


def duplicate_members(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """(digest, key, copies) of every row whose digest others share; a group is never gathered."""
    shared = rows.groupBy(F.col(digest).alias("_d")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return rows.join(shared, F.col(digest) == F.col("_d")).select(digest, key, "copies")


def totals(tracks: DataFrame, *by: str) -> DataFrame:
    return tracks.groupBy(*by).agg(F.count(F.lit(1)).alias("tracks"), F.sum(F.col("duration_sec").cast("decimal(18,3)")).cast("double").alias("duration_sec"), F.sum("fingerprint_count").alias("fingerprints"), F.sum("bytes").alias("bytes"))


def value_counts(rows: DataFrame, **kinds: Column) -> DataFrame:
    """(kind, value, n) of several columns in one pass: grouping sets, not one scan each."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in kinds.items())))
    return rows.select(each.alias("e")).groupBy("e.kind", "e.value").agg(F.count(F.lit(1)).alias("n"))


def extension(path: Column) -> Column:
    """The last extension of a path, dot included, in lower case; '' without one."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(?<=.)(\.[^.]+)$", 1))


def scale_figures(tracks: DataFrame, postings: Column, seconds: Column) -> DataFrame:
    """Postings a track and an audio second, tracks a second and the real-time factor of one ingestion."""
    t = tracks.agg(F.count(F.lit(1)).alias("tracks"), F.sum(F.col("duration_sec").cast("decimal(18,3)")).cast("double").alias("audio"))
    return t.select("tracks", (postings / F.col("tracks")).alias("postings_per_track"), (postings / F.col("audio")).alias("postings_per_second"), (F.col("tracks") / seconds).alias("tracks_per_second"), (F.col("audio") / seconds).alias("realtime_factor"))


def ingest_summary(runs: DataFrame) -> DataFrame:
    """Of (state: ingested, cached or skipped): counts, and the share of ingested tracks that the cache had."""
    n = lambda *s: F.sum(F.when(F.col("state").isin(*s), 1).otherwise(0)).cast("long")
    out = runs.agg(n("ingested", "cached").alias("ingested"), n("cached").alias("cache_hits"), n("skipped").alias("skipped"))
    return out.withColumn("cache_hit_rate", F.when(F.col("ingested") > 0, F.col("cache_hits") / F.col("ingested")).otherwise(0.0))


def catalog_problems(tracks: DataFrame) -> DataFrame:
    """(track_id, problem): an empty or repeated id, a malformed digest, no duration."""
    rows = tracks.select("track_id", F.explode(F.array_compact(F.array(
        F.when(F.coalesce("track_id", F.lit("")) == "", "empty id"), F.when(F.coalesce(F.length("sha256"), F.lit(0)) != 64, "malformed digest"), F.when(~F.coalesce(F.col("duration_sec") > 0, F.lit(False)), "no duration"),
    ))).alias("problem"))
    twice = tracks.groupBy("track_id").count().where("count > 1").select("track_id", F.lit("id repeats").alias("problem"))
    return rows.unionByName(twice)


def delete_catalog(catalogs: DataFrame, children: dict[str, DataFrame], catalog_id: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The catalogs and their child tables without one catalog."""
    rest = F.col("catalog_id") != catalog_id
    return catalogs.where(rest), {n: c.where(rest) for n, c in children.items()}


# ---- files ----


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _fs(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def save_catalog(tracks: DataFrame, path: str, catalog_id: str) -> None:
    """Tracks as JSON lines in order of id, and beside them one line about them: counts, totals, content hash."""
    rows = tracks.select(*(c.split()[0] for c in CATALOG_TRACK.split(", ")))
    rows.repartitionByRange("track_id").sortWithinPartitions("track_id").write.json(f"{path}/tracks")
    head = totals(rows).crossJoin(pair_hash(rows.withColumn("c", F.lit(catalog_id)), "c", "track_id", "sha256").select("content_hash"))
    head.withColumns({"catalog_id": F.lit(catalog_id), "version": F.lit(1)}).coalesce(1).write.json(f"{path}/catalog")


def load_catalog(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """The tracks of a saved catalog; refuses one whose content is not what its head names."""
    fs, at = _fs(spark, f"{path}/catalog")
    if not fs.exists(at):
        raise ValueError(f"{path} is not a catalog")
    rows = spark.read.schema(CATALOG_TRACK).json(f"{path}/tracks")
    if check:
        head = spark.read.schema("catalog_id string, tracks long, content_hash string").json(f"{path}/catalog").first()
        got = pair_hash(rows.withColumn("c", F.lit("")), "c", "track_id", "sha256").first()
        if head is None or (head["tracks"], head["content_hash"]) != ((got["track_count"], got["content_hash"]) if got else (0, None)):
            raise ValueError("the catalog doesn't hold what its head names")
    return rows


class ArtifactStore:
    """Immutable artifacts at root/catalogs/<catalog_id>/<version>, each with the manifest of its members."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def key(self, catalog_id: str, v: str) -> str:
        row = self.spark.range(1).select(valid_catalog_id(F.lit(catalog_id)).alias("ok"), version(F.lit(v)).alias("v")).first()
        if not row["ok"] or row["v"] is None:
            raise StorageError("a catalog id and a version of 64 hexadecimal digits are needed")
        return f"{self.root}/catalogs/{catalog_id}/{row['v']}"

    def _manifest(self, at: str) -> dict | None:
        fs, path = _fs(self.spark, f"{at}/{MANIFEST}")
        return json.loads(self.spark.read.text(f"{at}/{MANIFEST}", wholetext=True).first()[0]) if fs.exists(path) else None

    def _members(self, folder: str) -> dict[str, dict]:
        return {r["path"]: {"sha256": r["sha256"], "bytes": r["bytes"]} for r in members(self.spark, folder).collect()}

    def exists(self, catalog_id: str, v: str) -> bool:
        return self._manifest(self.key(catalog_id, v)) is not None

    def list_versions(self, catalog_id: str) -> list[str]:
        return [n for n in _names(self.spark, f"{self.root}/catalogs/{catalog_id}") if self._manifest(f"{self.root}/catalogs/{catalog_id}/{n}") is not None]

    def list_catalogs(self) -> list[str]:
        return [n for n in _names(self.spark, f"{self.root}/catalogs") if self.list_versions(n)]

    def put(self, catalog_id: str, v: str, source: str) -> str:
        """Copy a folder; the same bytes again change nothing, other bytes are a conflict. The manifest is written last."""
        at, own = self.key(catalog_id, v), self._members(source)
        if not own:
            raise ArtifactIncomplete("the artifact has no member")
        held = self._manifest(at)
        if held is not None:
            if held["members"] != own:
                raise ArtifactConflict(f"{at} holds other bytes")
            return at
        self._copy(source, f"{at}/members", own)
        text = json.dumps({"catalog_id": catalog_id, "version": at.rsplit("/", 1)[1], "members": own}, indent=2, sort_keys=True)
        _write_text(self.spark, f"{at}/{MANIFEST}", text + "\n")
        return at

    def get(self, catalog_id: str, v: str, target: str) -> dict:
        """Copy an artifact's members to a folder that must not exist; every byte is checked against the manifest."""
        at = self.key(catalog_id, v)
        held = self._manifest(at)
        if held is None:
            raise StorageError(f"{at} is not there")
        self._copy(f"{at}/members", target, held["members"])
        return held

    def _copy(self, source: str, target: str, want: dict[str, dict]) -> None:
        util = self.spark._jvm.org.apache.hadoop.fs.FileUtil
        fs, a = _fs(self.spark, source)
        to, b = _fs(self.spark, target)
        if to.exists(b):
            to.delete(b, True)
        util.copy(fs, a, to, b, False, self.spark._jsc.hadoopConfiguration())
        expected = self.spark.createDataFrame([(p, m["sha256"], m["bytes"]) for p, m in want.items()], "path string, sha256 string, bytes long")
        bad = verify(expected, members(self.spark, target)).collect()
        if bad:
            raise ArtifactIncomplete(f"{target}: {[tuple(r) for r in bad]}")
