"""Report forms and small relations: sampled sweeps, columnar results, ledgers, file choice, gates on hashes, scale checks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import version
from tidemark.operators.evaluate import n_if, share
from tidemark.session import running

# Formats, lengths and size of audio files that may be picked; tempo fixtures with their seconds.
FILE_FORMATS = ("VBR MP3", "128Kbps MP3", "256Kbps MP3", "320Kbps MP3", "64Kbps MP3")
MIN_SECONDS, MAX_SECONDS, MAX_FILE_BYTES = 45.0, 600.0, 18 * 1024 * 1024
TEMPO_FIXTURES = ((60.0, 30.0), (70.0, 30.0), (80.0, 20.0), (90.0, 20.0), (100.0, 20.0), (110.0, 20.0), (120.0, 30.0), (128.0, 20.0), (140.0, 30.0), (160.0, 20.0), (174.0, 20.0), (180.0, 20.0), (95.5, 20.0), (143.0, 10.0))
KEY_SECONDS = 12.0


def sample_points(swept: DataFrame, order: str, points: int) -> DataFrame:
    """At most `points` rows at even steps of the order, the first and the last among them; all rows if there are no more."""
    n = swept.count()
    if n <= points:
        return swept
    wanted = sorted({int(i * ((n - 1) / (points - 1))) for i in range(points - 1)} | {n - 1})
    places = running(swept, [F.col(order)], {"_place": F.lit(1)})
    # at most `points` literals
    return places.where((F.col("_place") - 1).isin(wanted)).drop("_place")


def columnar(rows: DataFrame, order: str) -> DataFrame:
    """One row with an array for each column, in order; for reports of a bounded number of points."""
    packed = rows.agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in rows.columns if c != order)))).alias("r"))
    return packed.select(*(F.col(f"r.{c}").alias(c) for c in rows.columns))


def rolled_up(before: DataFrame, after: DataFrame) -> DataFrame:
    """(family, queries, before, after, delta) of two tables (condition, family, queries, hits): conditions of both, weighted by the later one's queries."""
    a = before.select("condition", share(F.col("hits"), F.col("queries")).alias("_a"))
    both = after.join(a, "condition").withColumn("_b", share(F.col("hits"), F.col("queries")))
    out = both.groupBy("family").agg(F.sum("queries").alias("queries"), F.sum(F.coalesce("_a", F.lit(0.0)) * F.col("queries")).alias("_x"), F.sum(F.coalesce("_b", F.lit(0.0)) * F.col("queries")).alias("_y"))
    return out.select("family", "queries", (F.col("_x") / F.col("queries")).alias("before"), (F.col("_y") / F.col("queries")).alias("after"), ((F.col("_y") - F.col("_x")) / F.col("queries")).alias("delta"))


def pick_files(files: DataFrame, most: int = 2) -> DataFrame:
    """Of (item, name, format, size text, length text) the shortest suitable files of each item, by length and name."""
    size, length = F.col("size").try_cast("long"), F.col("length").try_cast("double")
    fine = F.col("format").isin(*FILE_FORMATS) & length.between(MIN_SECONDS, MAX_SECONDS) & (size > 0) & (size <= MAX_FILE_BYTES)
    rows = files.where(F.coalesce(fine, F.lit(False))).withColumn("_length", length)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy("_length", "name"))).where(F.col("place") <= most).drop("_length")


def ledger(files: DataFrame, applied: DataFrame) -> DataFrame:
    """(name, state) of migration files (name, sha256) against a ledger: pending, applied, changed since, or gone."""
    a = applied.select("name", F.col("sha256").alias("_held"), F.lit(True).alias("_in"))
    rows = files.withColumn("_file", F.lit(True)).join(a, "name", "full")
    state = F.when(F.col("_file").isNull(), "gone").when(F.col("_in").isNull(), "pending").when(F.col("sha256").eqNullSafe(F.col("_held")), "applied").otherwise("changed")
    return rows.select("name", state.alias("state"))


def backfilled(tracks: DataFrame, metadata: DataFrame, digest: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Tracks with title and artist from metadata where they have none; raises if the content digest (one value) changed by it."""
    m = metadata.select("track_id", F.col("title").alias("_t"), F.col("artist").alias("_a"))
    out = tracks.join(m, "track_id", "left").withColumns({"title": F.coalesce("title", "_t"), "artist": F.coalesce("artist", "_a")}).drop("_t", "_a")
    if digest(tracks).first() != digest(out).first():
        raise ValueError("the backfill would change what the catalog holds")
    return out


def scale_checks(tracks: DataFrame, frozen: DataFrame, digest: str = "sha256") -> DataFrame:
    """One row: tracks, distinct digests, groups that share one, overlap with a frozen corpus."""
    per = tracks.groupBy(digest).agg(F.count(F.lit(1)).alias("n"))
    held = frozen.select(digest).distinct().withColumn("_in", F.lit(1))
    return per.join(held, digest, "left").agg(F.sum("n").alias("tracks"), F.count(F.lit(1)).alias("distinct_digests"), n_if(F.col("n") > 1).alias("duplicate_groups"), F.count("_in").alias("overlap"))


def artifact_version(descriptor: Column) -> Column:
    """(version, problem) of an artifact's descriptor (JSON text): its index hash, if it is one."""
    found = F.get_json_object(descriptor, "$.index_content_hash")
    valid = version(found)
    problem = F.when(F.from_json(descriptor, "map<string,string>").isNull(), "not JSON").when(F.coalesce(found, F.lit("")) == "", "no version").when(valid.isNull(), "invalid version")
    return F.struct(F.when(problem.isNull(), valid).alias("version"), problem.alias("problem"))


def wanted_catalogs(listed: DataFrame, pinned: DataFrame) -> DataFrame:
    """Ids that are listed or pinned, once each, in order."""
    return listed.select("catalog_id").union(pinned.select("catalog_id")).distinct().orderBy("catalog_id")


def midi_to_hz(note: Column) -> Column:
    return 440.0 * F.pow(F.lit(2.0), (note - 69) / 12.0)


def decibels(power: Column, floor: float = 1e-10) -> Column:
    return 10 * F.log10(F.greatest(F.lit(floor), power))


def seconds_to_midnight(ts: Column) -> Column:
    """Whole seconds to the next UTC midnight, at least 1."""
    day = F.unix_micros(ts) % 86_400_000_000
    return F.greatest(F.lit(1), F.floor((86_400_000_000 - day) / 1_000_000)).cast("long")


def is_stale(fetched: Column, now: Column, days: int) -> Column:
    return F.coalesce(fetched < now - F.make_dt_interval(F.lit(days)), F.lit(True))


def fixture_specs(spark) -> DataFrame:
    """The 38 synthetic fixtures: click tracks (tempo) and cadences (key), with their tags."""
    tempi = {b for b, _ in TEMPO_FIXTURES}
    rows = []
    for bpm, seconds in TEMPO_FIXTURES:
        tag = "octave-pair" if {bpm * 2, bpm / 2} & tempi else "short" if seconds <= 10 else "non-integer" if bpm % 1 else None
        rows.append((f"bpm_{bpm:g}", "bpm", seconds, bpm, None, tag))
    for mode in ("major", "minor"):
        for name in ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"):
            rows.append((f"key_{name.replace('#', 's')}_{mode}", "key", KEY_SECONDS, None, f"{name} {mode}", "relative-pair"))
    return spark.createDataFrame(rows, "fixture_id string, kind string, seconds double, bpm double, key string, tag string")


def run_detector(items: DataFrame, detector: Callable, payload: str = "content") -> DataFrame:
    """(track_id, bpm, key, timings, error): a user's function over each item's bytes, which gives {"bpm", "key", "timings"}.

    Answers are JSON texts, as operators.items judges them. An item on which it raises has an error and no
    answers, and stays: it is a wrong answer, and other items are not touched.
    """

    def run(batches):
        import json

        text = lambda v: None if v is None else json.dumps(v)
        for batch in batches:
            rows = []
            for track, content in zip(batch["track_id"], batch["payload"], strict=True):
                try:
                    got = detector(content)
                    times = {str(k): text(v) for k, v in (got.get("timings") or {}).items()}
                    rows.append((track, text(got.get("bpm")), text(got.get("key")), times, None))
                except Exception as e:  # noqa: BLE001 - whatever a user's function raises is that item's failure
                    rows.append((track, None, None, {}, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["track_id", "bpm", "key", "timings", "error"])

    return items.select("track_id", F.col(payload).alias("payload")).mapInPandas(run, "track_id string, bpm string, key string, timings map<string,string>, error string")
