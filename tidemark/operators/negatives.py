"""Query plans and negative sets: conditions, held-out excerpts, leakage screens, assembly and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import base_id, normalise
from tidemark.operators.catalog import adjacent_overlaps
from tidemark.session import checkpointed

# The degradation conditions by family, and the durations and places of excerpts.
CONDITIONS = (
    ("clean", "clean"),
    ("noise_pink_snr20db", "noise"), ("noise_pink_snr10db", "noise"), ("noise_pink_snr5db", "noise"), ("noise_pink_snr0db", "noise"),
    ("noise_white_snr20db", "noise"), ("noise_white_snr10db", "noise"), ("noise_white_snr5db", "noise"), ("noise_white_snr0db", "noise"),
    ("codec_mp3_128k", "codec"), ("codec_mp3_64k", "codec"), ("codec_mp3_32k", "codec"), ("codec_opus_64k", "codec"), ("codec_opus_32k", "codec"),
    ("filter_telephone", "filter"), ("filter_lowpass8k", "filter"),
    ("speed_-5pct", "speed"), ("speed_-2pct", "speed"), ("speed_+2pct", "speed"), ("speed_+5pct", "speed"),
    ("pitch_-2st", "pitch"), ("pitch_-1st", "pitch"), ("pitch_+1st", "pitch"), ("pitch_+2st", "pitch"),
)
DURATIONS, PLACES = (3.0, 5.0, 10.0), ("beginning", "middle", "end")
SINGLE_DURATION, DEFAULT_PLACE = 5.0, "middle"
SIDES = ("calibration", "evaluation")
SOURCE = "track_id string, path string, sha256 string, duration_sec double, license string, license_url string, source string, source_url string, artist string, title string, origin string"
EXCERPT = "query_id string, category string, source_track string, start_sec double, duration double, split string, rendered_path string"


def condition_matrix(spark) -> DataFrame:
    return spark.createDataFrame(list(CONDITIONS), "condition string, family string")


def excerpt_offset(total: Column, duration: Column, place: Column) -> Column:
    """Where an excerpt starts, never past the source's end; null for an unknown place."""
    room = F.greatest(total - duration, F.lit(0.0))
    return F.when(place == "beginning", F.lit(0.0)).when(place == "middle", room / 2).when(place == "end", room)


def seed_of(query_id: Column) -> Column:
    """32 bits of the id's sha256."""
    return F.conv(F.substring(F.sha2(query_id.cast("binary"), 256), 1, 8), 16, 10).cast("long")


def shown_seconds(duration: Column) -> Column:
    """A duration as it stands in ids: without a fraction of zero."""
    return F.regexp_replace(duration.cast("string"), r"\.0$", "")


def query_id(track: Column, condition: Column, duration: Column, place: Column) -> Column:
    return F.concat(track, F.lit("__"), condition, F.lit("__d"), shown_seconds(duration), F.lit("s__"), place)


def heldout_plan(tracks: DataFrame) -> DataFrame:
    """Held-out (track_id, duration_sec, sha256) by duration and place, longer excerpts than the source left out."""
    spark = tracks.sparkSession
    grid = spark.createDataFrame([(d, p) for d in DURATIONS for p in PLACES], "duration double, position string")
    rows = tracks.crossJoin(F.broadcast(grid)).where("duration <= duration_sec")
    qid = query_id(F.col("track_id"), F.lit("neg_music"), F.col("duration"), F.col("position"))
    start = excerpt_offset(F.col("duration_sec"), F.col("duration"), F.col("position"))
    return rows.select(qid.alias("query_id"), F.col("track_id").alias("source_track"), "duration", "position", start.alias("start_sec"), F.col("sha256").alias("source_hash"), seed_of(qid).alias("seed"))


def positive_plan(tracks: DataFrame) -> DataFrame:
    """Every track by condition, duration and place: clean ones by all of them, white noise, speed and pitch at 5 s from the middle, the others at every duration from the middle.

    Longer excerpts than the track are left out.
    """
    spark = tracks.sparkSession
    crossed = lambda c, f: f in ("codec", "filter") or c.startswith("noise_pink")
    grid = [(c, f, s, p) for c, f in CONDITIONS for s in DURATIONS for p in PLACES if f == "clean" or p == DEFAULT_PLACE and (crossed(c, f) or s == SINGLE_DURATION)]
    rows = tracks.crossJoin(F.broadcast(spark.createDataFrame(grid, "condition string, family string, duration double, position string"))).where("duration <= duration_sec")
    qid = query_id(F.col("track_id"), F.col("condition"), F.col("duration"), F.col("position"))
    start = excerpt_offset(F.col("duration_sec"), F.col("duration"), F.col("position"))
    return rows.select(qid.alias("query_id"), "track_id", "duration", "position", "condition", "family", start.alias("start_sec"), F.col("sha256").alias("source_hash"), seed_of(qid).alias("seed"))


#: Synthetic negatives, their tag and the loudness of their noise.
SYNTHETIC = (("negative_silence", "digital", 0.0), ("negative_near_silence", "dither", 1e-4), ("negative_noise_white", "w", 0.1), ("negative_noise_pink", "p", 0.1))


def synthetic_plan(spark) -> DataFrame:
    """Silence and noise by duration: (query_id, condition, duration, level, seed). Speech needs a synthesizer and is left out."""
    grid = spark.createDataFrame([(c, t, level, d) for c, t, level in SYNTHETIC for d in DURATIONS], "condition string, tag string, level double, duration double")
    qid = F.concat(F.lit("synthetic__"), "condition", F.lit("__d"), shown_seconds(F.col("duration")), F.lit("s__"), "tag")
    return grid.select(qid.alias("query_id"), "condition", "duration", "level", seed_of(qid).alias("seed"))


#: Undecided rows that one task may go through.
REST_ROWS = 100_000


def first_of_each(rows: DataFrame, key: str, digest: str, base: str) -> DataFrame:
    """Adds verdict: kept, 'digest' or 'base', as going through the rows in key order gives them.

    A row is kept if no kept row before it has its digest or its base; a rejected row shadows none.
    In each round the rows that are first both by digest and by base among the undecided are kept,
    and what they shadow is rejected. Chains of alternating digests and bases would take as many rounds, so
    once REST_ROWS or fewer are undecided, one task goes through those in order.
    """
    keyed = rows.select(F.col(key).alias("_k"), F.col(digest).alias("_d"), F.col(base).alias("_b"))
    left, kept = checkpointed(keyed), None

    def in_order(batches):
        import pyarrow as pa

        digests, bases = set(), set()
        for batch in batches:
            keep = []
            for d, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                keep.append(d not in digests and b not in bases)
                if keep[-1]:
                    digests |= {d} - {None}
                    bases |= {b} - {None}
            yield batch.filter(pa.array(keep))

    while n := left.count():
        if n <= REST_ROWS:
            now = checkpointed(left.coalesce(1).sortWithinPartitions("_k").mapInArrow(in_order, left.schema))
            kept = now if kept is None else kept.unionByName(now)
            break
        firsts = lambda c: left.groupBy(c).agg(F.min("_k").alias("_k")).select("_k")
        now = checkpointed(left.join(firsts("_d").join(firsts("_b"), "_k"), "_k", "left_semi"))
        kept = now if kept is None else kept.unionByName(now)
        left = checkpointed(left.join(now.select("_d"), "_d", "left_anti").join(now.select("_b"), "_b", "left_anti"))
    if kept is None:
        return rows.withColumn("verdict", F.lit(None).cast("string"))
    by_d = kept.select(F.col("_d").alias("_e"), F.col("_k").alias("_first"))
    verdict = F.when(F.col("_first") == F.col(key), "kept").when(F.col("_first") < F.col(key), "digest").otherwise("base")
    return rows.join(by_d, F.col(digest) == F.col("_e"), "left").withColumn("verdict", verdict).drop("_e", "_first")


def _has(rows: DataFrame, held: DataFrame, on: list[tuple[Column, str]], name: str) -> DataFrame:
    """Adds name: whether the held frame has a row whose columns equal the given expressions."""
    names = [f"_{name}{i}" for i in range(len(on))]
    keys = held.select(*(F.col(c).alias(n) for (_, c), n in zip(on, names, strict=True))).distinct()
    cond = F.lit(True)
    for (expr, _), n in zip(on, names, strict=True):
        cond = cond & (expr == F.col(n))
    return rows.join(keys, cond, "left").withColumn(name, F.col(names[0]).isNotNull()).drop(*names)


def screen_candidates(candidates: DataFrame, catalog: DataFrame, corpus: DataFrame) -> DataFrame:
    """(track_id, reason): what lets a candidate carry indexed audio, in a fixed order, else 'kept'.

    catalog has (sha256, artist, title), corpus (track_id); candidates (track_id, sha256, artist, title)
    in order of track_id. After the five tests against them, a candidate that shares its digest or its
    family of ids with one kept before goes.
    """
    artist, title = normalise(F.coalesce("artist", F.lit(""))), normalise(F.coalesce("title", F.lit("")))
    known = catalog.select("sha256", artist.alias("a"), title.alias("t"))
    ids = corpus.select("track_id", base_id(F.col("track_id")).alias("family"))
    rows = candidates.withColumns({"_a": artist, "_t": title, "_base": base_id(F.col("track_id"))})
    rows = _has(rows, known, [(F.col("sha256"), "sha256")], "by_sha")
    rows = _has(rows, ids, [(F.col("track_id"), "track_id")], "by_id")
    rows = _has(rows, ids, [(F.col("_base"), "family")], "by_family")
    rows = _has(rows, known, [(F.col("_a"), "a"), (F.col("_t"), "t")], "by_title")
    rows = _has(rows, known.where("a <> ''"), [(F.col("_a"), "a")], "by_artist")
    reason = F.when(F.col("by_sha"), "digest in the corpus").when(F.col("by_id"), "id in the corpus").when(F.col("by_family"), "id family in the corpus").when(F.col("by_title"), "artist and title in the catalog").when(F.col("by_artist"), "artist in the catalog")
    rows = checkpointed(rows.select("track_id", "sha256", "_base", reason.alias("reason")))
    self_ = first_of_each(rows.where("reason IS NULL"), "track_id", "sha256", "_base")
    late = F.when(F.col("verdict") == "digest", "digest of another candidate").when(F.col("verdict") == "base", "id family of another candidate").otherwise("kept")
    return rows.where("reason IS NOT NULL").select("track_id", "reason").unionByName(self_.select("track_id", late.alias("reason")))


def screen_corpus(fetched: DataFrame, frozen: DataFrame) -> DataFrame:
    """(place, track_id, reason) of a fetch of (place, track_id, sha256, duration_sec, present) against frozen (track_id, sha256), in order of place."""
    rows = _has(fetched, frozen, [(F.col("sha256"), "sha256")], "by_sha")
    rows = _has(rows, frozen, [(F.col("track_id"), "track_id")], "by_id")
    reason = (
        F.when(F.coalesce(F.length("sha256"), F.lit(0)) != 64, "malformed digest").when(F.col("duration_sec") <= 0, "no duration").when(~F.col("present"), "missing file")
        .when(F.col("by_sha"), "digest is frozen").when(F.col("by_id"), "id is frozen")
    )
    rows = checkpointed(rows.select("place", "track_id", "sha256", reason.alias("reason")))
    self_ = first_of_each(rows.where("reason IS NULL"), "place", "sha256", "track_id")
    late = F.when(F.col("verdict") == "digest", "digest repeats").when(F.col("verdict") == "base", "id repeats").otherwise("kept")
    return rows.where("reason IS NOT NULL").select("place", "track_id", "reason").unionByName(self_.select("place", "track_id", late.alias("reason")))


def first_targets(accepted: DataFrame, n: int, key: str = "track_id") -> DataFrame:
    """The first n by id, whatever order they came in."""
    return accepted.orderBy(key).limit(n)


def content_gate(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates that the recognizer matches with no track, and that could be decoded."""
    bad = decisions.where((F.col("decision") == "MATCH") | F.col("error").isNotNull()).select("track_id").distinct()
    return candidates.join(bad, "track_id", "left_anti")


def assign_splits(excerpts: DataFrame, calibration: DataFrame) -> DataFrame:
    """Excerpts with their split: by source track, never by excerpt; those without a source by the parity of their id's hash."""
    side = F.when(F.conv(F.substring(F.sha2(F.col("query_id").cast("binary"), 256), 1, 4), 16, 10).cast("long") % 2 == 0, SIDES[0]).otherwise(SIDES[1])
    cal = calibration.select(F.col("track_id").alias("_t")).distinct()
    rows = excerpts.drop("split").join(cal, F.col("source_track") == F.col("_t"), "left")
    return rows.withColumn("split", F.when(F.col("source_track").isNull(), side).when(F.col("_t").isNotNull(), SIDES[0]).otherwise(SIDES[1])).drop("_t")


def verify(sources: DataFrame, excerpts: DataFrame, catalog: DataFrame) -> DataFrame:
    """(rule, subject): what would invalidate a false-accept rate measured on the set; no row if it is sound."""
    ids = sources.select("track_id").distinct()
    rule = lambda df, name, c: df.select(F.lit(name).alias("rule"), F.col(c).cast("string").alias("subject"))
    own = excerpts.where("source_track IS NOT NULL")
    straddling = own.groupBy("source_track").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo <> hi")
    timed = own.withColumn("stop_sec", F.col("start_sec") + F.col("duration"))
    found = [
        rule(ids.join(catalog.select("track_id"), "track_id", "left_semi"), "source is indexed", "track_id"),
        rule(excerpts.groupBy("query_id").count().where("count > 1"), "query repeats", "query_id"),
        rule(own.join(ids.select(F.col("track_id").alias("source_track")), "source_track", "left_anti"), "unknown source", "query_id"),
        rule(excerpts.where(~F.coalesce(F.col("split").isin(*SIDES), F.lit(False))), "unknown split", "query_id"),
        rule(straddling, "source in both splits", "source_track"),
        rule(adjacent_overlaps(timed, "source_track", "start_sec", "stop_sec").select("source_track").distinct(), "excerpts overlap", "source_track"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def set_counts(excerpts: DataFrame) -> DataFrame:
    """(kind, name, n): excerpts by category and by split, and distinct source recordings by split, the real sample size."""
    by = lambda c: excerpts.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("kind"), "name", "n")
    recordings = excerpts.where("source_track IS NOT NULL").groupBy(F.col("split").alias("name")).agg(F.countDistinct("source_track").alias("n"))
    return by("category").unionByName(by("split")).unionByName(recordings.select(F.lit("sources").alias("kind"), "name", "n"))


def assemble(survivors: DataFrame, held_out: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Excerpts of a negative set: sources tiled (see catalog.tile), synthetic ones as they are, split by interleaved source."""
    from tidemark.operators.catalog import tile
    from tidemark.operators.evaluate import interleave

    sources = survivors.select("track_id", "duration_sec").unionByName(held_out.select("track_id", "duration_sec"))
    # a second at either end is left out
    tiles = tile(sources.select(F.col("track_id").alias("source_id"), (F.col("duration_sec") - 2).alias("length")))
    start = F.col("start") + 1
    cut = tiles.select(
        F.concat(F.lit("neg__"), F.col("source_id"), F.lit("__d"), shown_seconds(F.col("duration")), F.lit("s__t"), F.format_string("%.1f", start)).alias("query_id"),
        F.lit("negative_out_of_catalog_music").alias("category"), F.col("source_id").alias("source_track"), start.alias("start_sec"), "duration",
    )
    every = cut.unionByName(synthetic.select("query_id", "category", F.lit(None).cast("string").alias("source_track"), F.lit(0.0).alias("start_sec"), "duration"))
    return assign_splits(every, interleave(sources, "track_id").where("split = 'tune'"))
