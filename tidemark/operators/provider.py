"""Answers of a metadata provider: queries, normalised recordings, classification and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import bounded_error
from tidemark.operators.catalog import enrichment_status, upsert

# Characters that a query escapes, statuses of a stored answer.
QUERY_SPECIAL = '+-&|!(){}[]^"~*?:\\/'
STATUSES = ("matched", "no_match", "ambiguous", "error", "skipped")
FIELDS = "title string, artist string, album string, release_date string, isrc string, mb_recording_id string, mb_release_id string, mb_artist_id string, match_score double"
_UUID = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def text_or_null(c: Column) -> Column:
    s = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(s != "", s)


def uuid_or_null(c: Column) -> Column:
    low = F.lower(text_or_null(c))
    return F.when(low.rlike(_UUID), low)


def query_text(artist: Column, title: Column) -> Column:
    escaped = "[" + "".join("\\" + c for c in QUERY_SPECIAL) + "]"
    value = lambda c: F.trim(F.regexp_replace(c, f"({escaped})", r"\\$1"))
    return F.concat(F.lit('recording:"'), value(title), F.lit('" AND artist:"'), value(artist), F.lit('"'))


def recording_fields(recording: Column) -> Column:
    """Storable fields of one recording (JSON text); what is missing or malformed is null, nothing raises.

    The artist is the credit list joined with its join phrases (an entry may be a bare text); album,
    release and date are the first release's; the first code that isn't blank counts; identifiers
    that are none are dropped; the score is clamped to 0..100.
    """
    at = lambda path: F.get_json_object(recording, path)
    entry = "struct<name:string,joinphrase:string,artist:struct<id:string,name:string>>"
    credits = F.from_json(at("$.artist-credit"), "array<string>")
    parsed = F.transform(credits, lambda c: F.struct(c.alias("raw"), F.when(F.ltrim(c).startswith("{"), F.from_json(c, entry)).alias("e")))
    named = lambda x: F.coalesce(text_or_null(x["e"]["name"]), text_or_null(x["e"]["artist"]["name"]), F.lit(""))
    parts = F.transform(parsed, lambda x: F.when(x["e"].isNull(), x["raw"]).otherwise(F.concat(named(x), F.coalesce(x["e"]["joinphrase"], F.lit("")))))
    ids = F.array_compact(F.transform(parsed, lambda x: uuid_or_null(x["e"]["artist"]["id"])))
    codes = F.array_compact(F.transform(F.from_json(at("$.isrcs"), "array<string>"), text_or_null))
    first, score = lambda name: at(f"$.releases[0].{name}"), at("$.score").try_cast("double")
    return F.struct(
        text_or_null(at("$.title")).alias("title"), text_or_null(F.array_join(parts, "")).alias("artist"), text_or_null(first("title")).alias("album"), text_or_null(first("date")).alias("release_date"),
        F.upper(F.try_element_at(codes, F.lit(1))).alias("isrc"), uuid_or_null(at("$.id")).alias("mb_recording_id"), uuid_or_null(first("id")).alias("mb_release_id"), F.try_element_at(ids, F.lit(1)).alias("mb_artist_id"),
        F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).alias("match_score"),
    )


def answers(lookups: DataFrame) -> DataFrame:
    """Of (track_id, query_used, response, error, attempts): status and the first candidate's fields.

    response is the provider's JSON with a list `recordings`; without the list, or with an error, the
    status is error. Fields are kept for matched and ambiguous answers only.
    """
    recordings = F.from_json(F.get_json_object("response", "$.recordings"), "array<string>")
    objects = F.filter(recordings, lambda r: F.ltrim(r).startswith("{"))
    scores = F.transform(objects, lambda r: F.coalesce(F.get_json_object(r, "$.score").try_cast("double"), F.lit(0.0)))
    status = F.when(F.col("error").isNotNull() | recordings.isNull(), "error").otherwise(enrichment_status(scores))
    detail = F.when(F.col("error").isNotNull(), bounded_error(F.col("error"))).when(recordings.isNull(), "response has no 'recordings' list")
    rows = lookups.select("track_id", "query_used", "attempts", status.alias("match_status"), detail.alias("error_detail"), F.try_element_at(objects, F.lit(1)).alias("_first"))
    kept = F.when(F.col("match_status").isin("matched", "ambiguous"), recording_fields(F.col("_first")))
    return rows.withColumn("_f", kept).select("track_id", "match_status", "query_used", "error_detail", "attempts", "_f.*")


def pending_tracks(tracks: DataFrame, metadata: DataFrame, stale_before: Column | None = None, force: bool = False) -> DataFrame:
    """Tracks with title and artist that have no answer yet (or one older than the given time; all if forced)."""
    able = tracks.where("title IS NOT NULL AND artist IS NOT NULL")
    if force:
        return able
    m = metadata if stale_before is None else metadata.where(F.coalesce(F.col("fetched_at") >= stale_before, F.lit(False)))
    return able.join(m.select("track_id"), "track_id", "left_anti")


def without_metadata(tracks: DataFrame) -> DataFrame:
    """Tracks that can't be asked for: title or artist is null."""
    return tracks.where("title IS NULL OR artist IS NULL")


def enrich(tracks: DataFrame, metadata: DataFrame, lookups: DataFrame, stale_before: Column | None = None) -> DataFrame:
    """The metadata after one run: answers of pending tracks and skipped ones replace what was stored for them.

    A metadata row holds one provider's answer for one track; a new answer replaces it, it is not added to.
    """
    found = answers(lookups.join(pending_tracks(tracks, metadata, stale_before).select("track_id"), "track_id", "left_semi"))
    skipped = without_metadata(tracks).select("track_id", F.lit("skipped").alias("match_status"))
    new = found.unionByName(skipped, allowMissingColumns=True)
    return upsert(metadata.select(new.columns), new, ["track_id"])


def store_problems(metadata: DataFrame) -> DataFrame:
    """(track_id, problem): an unknown status, a score out of range, a match without title and recording."""
    s = F.col("match_status")
    bad = F.when(~F.coalesce(s.isin(*STATUSES), F.lit(False)), "unknown status").when(~F.col("match_score").between(0, 100), "score out of range").when((s == "matched") & F.col("title").isNull() & F.col("mb_recording_id").isNull(), "match without a name")
    return metadata.select("track_id", bad.alias("problem")).where("problem IS NOT NULL")


def dispatch_rate(dispatches: Column, seconds: Column) -> Column:
    """Requests per second over a window: n requests span n - 1 intervals; 0 below two or without a window."""
    return F.when((dispatches >= 2) & (seconds > 0), (dispatches - 1) / seconds).otherwise(0.0)
