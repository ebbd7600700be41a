"""File formats of catalogs and evaluation: JSON lines, manifests, sidecars, annotation sheets, artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import version

QUERY_SPEC = "query_id string, track_id string, duration double, position string, condition string, family string, params map<string,string>, seed bigint, source_hash string, is_negative boolean, rendered_path string, measured map<string,string>"
TRACK = "struct<track_id:string,path:string,sha256:string,source:string,license:string,license_url:string,duration_sec:double,bytes:bigint,title:string,artist:string,genre:string,source_url:string,held_out:boolean>"
SHEET = "track_id string, path string, title string, artist string, duration_sec double, license string, license_url string, bpm string, key string, annotation_status string, annotator string, annotated_utc string, notes string"


def query_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERY_SPEC).json(path)


def write_query_index(specs: DataFrame, path: str) -> None:
    specs.write.mode("errorifexists").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each track of a corpus manifest; unknown fields are dropped."""
    head, arrays = _elements(spark, path, tracks=TRACK)
    return head.crossJoin(arrays["tracks"])  # the head is one row


SOURCE = "array<struct<track_id:string,path:string,sha256:string,duration_sec:double,license:string,license_url:string,source:string,source_url:string,artist:string,title:string,origin:string>>"
EXCERPTS = "array<struct<query_id:string,category:string,source_track:string,start_sec:double,duration:double,split:string,rendered_path:string>>"


def _written(path: str, head: DataFrame, **arrays: DataFrame) -> None:
    """One JSON object over the part files in the order of their names: the one row of head, then each array, one element a line.

    head's last column is a number, so that its line ends otherwise than an element's. Elements are rows (at, element)
    with element a struct; they are dealt by ranges of `at` and never gathered. Whoever wants one file concatenates the parts.
    """
    top = head.select(F.to_json(F.struct(*head.columns), {"ignoreNullFields": "false"}).alias("h"))
    lines = top.select(F.lit(-1).alias("section"), F.lit(0).alias("part"), F.lit("").alias("at"), F.expr("substring(h, 1, length(h) - 1)").alias("value"))
    for i, (name, rows) in enumerate(arrays.items()):
        texts = rows.select("at", F.to_json("element", {"ignoreNullFields": "false"}).alias("j"))
        least = texts.agg(F.min(F.struct("at", "j")).alias("least"))  # the first element has no comma before it
        body = texts.crossJoin(F.broadcast(least)).select("at", F.when(F.struct("at", "j") == F.col("least"), F.col("j")).otherwise(F.concat(F.lit(","), F.col("j"))).alias("value"), (F.struct("at", "j") != F.col("least")).alias("later"))
        edge = lambda part, text: head.select(F.lit(part).alias("part"), F.lit("").alias("at"), F.lit(text).alias("value"))
        body = body.select(F.when(F.col("later"), 2).otherwise(1).alias("part"), "at", "value")
        section = edge(0, f', "{name}": [').unionByName(body).unionByName(edge(3, "]" + ("}" if i + 1 == len(arrays) else "")))
        lines = lines.unionByName(section.select(F.lit(i).alias("section"), "part", "at", "value"))
    order = ["section", "part", "at", "value"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("errorifexists").text(path)


def _elements(spark: SparkSession, path: str, **kinds: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The head and the arrays of what _written wrote, line by line; a file laid out otherwise is read as a whole.

    A line belongs to an array by its fields: no two arrays of one object share their first field.
    """
    text = spark.read.text(path).select(F.trim("value").alias("v"))
    opened = text.where(F.col("v").rlike(r'^, "\w+": \[$')).limit(1).count()
    if not opened:
        whole = spark.read.schema(", ".join(f"{n} array<{k}>" for n, k in kinds.items()) + ", version int, content_hash string").option("multiLine", "true").json(path)
        return whole.select("version", "content_hash"), {n: whole.select(F.explode(n).alias("e")).select("e.*") for n in kinds}
    head = text.where(F.col("v").startswith("{") & ~F.col("v").endswith("}")).select(F.from_json(F.concat("v", F.lit("}")), "version int, content_hash string").alias("h")).where("h.version IS NOT NULL").select("h.*")
    lines = text.where(F.col("v").rlike(r"^,?\{.*\}$")).select(F.regexp_replace("v", "^,", "").alias("v"))
    out = {}
    for n, k in kinds.items():
        first = k[len("struct<") :].split(":")[0]
        out[n] = lines.where(F.col("v").startswith('{"' + first + '"')).select(F.from_json("v", k).alias("e")).select("e.*")
    return head, out


def _element(kind: str) -> str:
    return kind[len("array<") : -1] if kind.startswith("array<") else kind


def _struct(kind: str) -> list[str]:
    return [f.split(":")[0] for f in _element(kind)[len("struct<") : -1].split(",")]


def save_manifest(tracks: DataFrame, path: str, version: int = 1) -> None:
    """A corpus manifest: one JSON object over the folder's parts, with its tracks in order of id, counts by licence, and the content hash."""
    from tidemark.operators.store import pair_hash

    digest = pair_hash(tracks.withColumn("c", F.lit("")), "c", "track_id", "sha256").select("content_hash")
    counts = tracks.groupBy("license").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("license", F.lit("")).alias("license"), "n")))).alias("license_counts"))
    head = tracks.agg(F.count(F.lit(1)).alias("track_count")).crossJoin(F.broadcast(counts)).join(F.broadcast(digest), F.lit(True), "left").select("content_hash", "license_counts", "track_count", F.lit(version).alias("version"))
    _written(path, head, tracks=tracks.select(F.coalesce("track_id", F.lit("")).alias("at"), F.struct(*_struct(TRACK)).alias("element")))


def save_negative_set(sources: DataFrame, excerpts: DataFrame, path: str) -> None:
    """A negative set as one JSON object over the folder's parts: counts by category and by split, sources, excerpts."""
    per = lambda c: excerpts.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(c, F.lit("")).alias(c), "n")))).alias(f"counts_by_{c}"))
    head = sources.agg(F.count(F.lit(1)).alias("source_count")).crossJoin(F.broadcast(excerpts.agg(F.count(F.lit(1)).alias("excerpt_count"))))
    head = head.crossJoin(F.broadcast(per("category"))).crossJoin(F.broadcast(per("split"))).withColumn("version", F.lit(1))
    rows = lambda df, key, kind: df.select(F.coalesce(key, F.lit("")).alias("at"), F.struct(*_struct(kind)).alias("element"))
    _written(path, head, sources=rows(sources, "track_id", SOURCE), excerpts=rows(excerpts, "query_id", EXCERPTS))


def negative_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sources and excerpts of a negative set; unknown fields are dropped."""
    _, arrays = _elements(spark, path, sources=_element(SOURCE), excerpts=_element(EXCERPTS))
    return arrays["sources"], arrays["excerpts"]


def annotation_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV sheet without its comment block, header, and rows that are blank or only commas."""
    lines = spark.read.text(path).where(~F.ltrim("value").startswith("#") & ~F.ltrim("value").startswith('"#') & ~F.col("value").rlike(r"^[\s,]*$") & ~F.col("value").startswith("track_id,"))
    return lines.select(F.from_csv("value", SHEET).alias("r")).select("r.*")


def annotation_errors(rows: DataFrame) -> DataFrame:
    """(track_id, error): each rule that a row breaks."""
    done = F.col("annotation_status") == "annotated"
    bpm = F.expr("try_cast(bpm AS DOUBLE)")
    rules = [
        (F.col("track_id").isNull() | (F.trim("track_id") == ""), "track_id is missing"),
        (~F.coalesce("annotation_status", F.lit("")).isin("annotated", "pending", "withdrawn"), "unknown status"),
        (done & F.coalesce(F.trim("annotator"), F.lit("")).eqNullSafe(""), "annotator is missing"),
        (done & F.col("annotated_utc").isNotNull() & ~F.col("annotated_utc").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), "time is not UTC ISO-8601"),
        (done & F.col("bpm").isNotNull() & (F.col("bpm") != "no_stable_tempo") & (bpm.isNull() | (bpm < 20) | (bpm > 400)), "bpm is out of range"),
        (~F.coalesce(F.col("duration_sec") > 0, F.lit(False)), "duration is not positive"),
    ]
    found = F.array_compact(F.array(*(F.when(c, F.lit(e)) for c, e in rules)))
    twice = rows.groupBy("track_id").count().where("count > 1").select("track_id", F.lit("track_id repeats").alias("error"))
    return rows.select("track_id", F.explode(found).alias("error")).unionByName(twice)


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """(key_kind, key, title, artist) of a JSON list of entries, an object {key: entry}, or {"tracks": either of them}.

    A listed entry is found by its sha256 and by its track_id, if it has both by either; in an object, a key of
    64 hexadecimal digits is a content hash (in lower case) and any other an id. Blank and "none" texts are null;
    entries without title and artist, and what is no object, are dropped. Of repeated keys the last counts.
    """
    entry = "struct<track_id:string,sha256:string,title:string,artist:string>"
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.ltrim(F.coalesce(F.get_json_object("value", "$.tracks"), F.col("value"))).alias("v"))
    clean = lambda c: F.when(~F.lower(F.trim(c)).isin("", "none"), F.trim(c))
    # each entry on its own: what is no object is null and drops out
    parsed = lambda c: F.when(F.ltrim(c).startswith("{"), F.from_json(c, entry))
    listed = rows.where(F.col("v").startswith("[")).select(F.posexplode(F.from_json("v", "array<string>")).alias("place", "x")).select("place", parsed(F.col("x")).alias("e"))
    keys = F.array(F.struct(F.lit("sha256").alias("key_kind"), clean(F.col("e.sha256")).alias("key")), F.struct(F.lit("track_id").alias("key_kind"), clean(F.col("e.track_id")).alias("key")))
    a = listed.select("place", F.explode(keys).alias("k"), "e.title", "e.artist").select("place", "k.key_kind", "k.key", "title", "artist")
    mapped = rows.where(F.col("v").startswith("{")).select(F.posexplode(F.map_entries(F.from_json("v", "map<string,string>"))).alias("place", "m")).select("place", "m.key", parsed(F.col("m.value")).alias("e"))
    b = mapped.select("place", F.when(version(F.col("key")).isNotNull(), "sha256").otherwise("track_id").alias("key_kind"), F.coalesce(version(F.col("key")), F.col("key")).alias("key"), "e.title", "e.artist")
    both = a.unionByName(b).select("place", "key_kind", "key", clean(F.col("title")).alias("title"), clean(F.col("artist")).alias("artist"))
    both = both.where("key IS NOT NULL AND (title IS NOT NULL OR artist IS NOT NULL)")
    return both.groupBy("key_kind", "key").agg(F.max_by(F.struct("title", "artist"), "place").alias("t")).select("key_kind", "key", "t.title", "t.artist")


def members(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256, bytes) of every file below an artifact folder, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    tail = F.element_at(F.split("path", F.lit("/" + root.rstrip("/").rsplit("/", 1)[-1] + "/"), 2), -1)
    return files.select(tail.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def verify(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem): missing, unexpected, size or digest; no row if all agree."""
    a, b = expected.select("path", F.col("sha256").alias("want"), F.col("bytes").alias("want_bytes")), found.select("path", F.col("sha256").alias("got"), F.col("bytes").alias("got_bytes"))
    problem = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want_bytes") != F.col("got_bytes"), "size").when(F.col("want") != F.col("got"), "digest")
    return a.join(b, "path", "full").select("path", problem.alias("problem")).where("problem IS NOT NULL")
