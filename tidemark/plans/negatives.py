"""Queries of excerpt plans and negative sets; parts stand for candidates, suppliers for the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import negatives as ng
from tidemark.session import table


def conditions(spark, d):
    return ng.condition_matrix(spark)


def tracks(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("track_id"), (F.col("s_suppkey") % 14 + 0.5).cast("double").alias("duration_sec"), F.sha2(F.col("s_suppkey").cast("string"), 256).alias("sha256"))


def positive_plan(spark, d):
    """Every condition with the durations and places its family asks for, over each track."""
    return ng.positive_plan(tracks(spark, d)).drop("source_hash")


def heldout(spark, d):
    return ng.heldout_plan(tracks(spark, d)).drop("source_hash")


def synthetic(spark, d):
    return ng.synthetic_plan(spark)


def candidates(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.format_string("t%d_%d", k % 700, k).alias("track_id"), F.sha2(F.concat(F.lit("x"), (k * 7 % 900).cast("string")), 256).alias("sha256"), F.concat(F.lit("Artist-"), (k % 40).cast("string")).alias("artist"), F.concat(F.lit(" Title "), (k % 11).cast("string"), F.lit("!")).alias("title"),
    )


def corpus(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        F.format_string("t%d_%d", k * 5 % 700, k * 5 % 900).alias("track_id"), F.sha2(F.concat(F.lit("x"), (k * 13 % 900).cast("string")), 256).alias("sha256"), F.concat(F.lit("artist "), (k % 4).cast("string")).alias("artist"), F.concat(F.lit("title "), (k % 3).cast("string")).alias("title"),
    )


def screened(spark, d):
    c = corpus(spark, d)
    return ng.screen_candidates(candidates(spark, d), c.where("artist <> 'artist 3'"), c)


def corpus_screened(spark, d):
    k = F.col("p_partkey")
    fetched = candidates(spark, d).join(table(spark, d, "part").select(F.format_string("t%d_%d", k % 700, k).alias("track_id"), k.alias("place")), "track_id")
    n = F.col("place")
    fetched = fetched.select(n.alias("place"), F.concat(F.lit("t"), (n % 650).cast("string")).alias("track_id"), F.when(n % 23 == 0, "short").otherwise(F.col("sha256")).alias("sha256"), F.when(n % 29 == 0, 0.0).otherwise(3.5).alias("duration_sec"), (n % 31 != 0).alias("present"))
    frozen = corpus(spark, d).select(F.regexp_replace("track_id", "_.*", "").alias("track_id"), "sha256")
    return ng.screen_corpus(fetched, frozen)


def target_tracks(spark, d):
    return ng.first_targets(corpus_screened(spark, d).where("reason = 'kept'"), 60, "track_id").select("track_id", "place")


def gated_candidates(spark, d):
    """Suppliers whose largest order line (a verdict here) matched, or that failed, are dropped."""
    li = table(spark, d, "lineitem").groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("track_id")).agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("x"), F.count(F.lit(1)).alias("n"))
    decisions = li.select("track_id", F.when(F.col("n") % 2 == 0, "MATCH").otherwise("NO_MATCH").alias("decision"), F.when(F.col("n") % 5 == 0, "decode").alias("error"))
    return ng.content_gate(tracks(spark, d).select("track_id"), decisions)


def negative_set(spark, d):
    s = tracks(spark, d).withColumn("duration_sec", F.col("duration_sec") * 4)
    k = F.substring("track_id", 2, 9).cast("long")
    synthetic = table(spark, d, "nation").select(F.concat(F.lit("noise_"), "n_name").alias("query_id"), F.lit("white").alias("category"), F.lit(5.0).alias("duration"))
    return ng.assemble(s.where(k % 4 != 0), s.where(k % 4 == 0), synthetic)


def assembled(spark, d):
    return negative_set(spark, d).select("query_id", "category", "source_track", "start_sec", "duration", "split")


def set_counts(spark, d):
    return ng.set_counts(negative_set(spark, d))


def broken_set(spark, d):
    """Purchases as excerpts of users, an hour each: overlaps, unknown and indexed sources, both splits, repeats."""
    e = table(spark, d, "events").where("event_type = 'purchase'")
    u = F.col("user_id")
    excerpts = e.select(
        F.concat(F.lit("q"), (F.col("event_id") % 500).cast("string")).alias("query_id"), F.when(u % 10 != 0, F.concat(F.lit("u"), u.cast("string"))).alias("source_track"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("start_sec"), F.lit(3600.0).alias("duration"),
        F.when(u % 10 == 1, "nowhere").when((u % 10 == 2) & (F.col("event_id") % 2 == 0), "evaluation").otherwise("calibration").alias("split"),
    )
    ids = table(spark, d, "events").select(F.concat(F.lit("u"), u.cast("string")).alias("track_id"), u.alias("u")).distinct()
    return ng.verify(ids.where("u % 7 <> 0").select("track_id"), excerpts, ids.where("u % 9 = 0").select("track_id"))


QUERIES = {
    "condition_matrix__Q1": conditions, "positive_plan__Q2": positive_plan, "heldout_plan__Q3": heldout, "synthetic_plan__Z8": synthetic, "screen_leakage__J10": screened, "screen_corpus__J11": corpus_screened, "first_targets__limit": target_tracks, "content_gate__Z6": gated_candidates,
    "negative_set__Z7_Q5": assembled, "set_counts__A32": set_counts, "verify_set__Q7_J15": broken_set,
}

_TRACKS = "t AS (SELECT s_suppkey AS k, 's' || s_suppkey AS track_id, (s_suppkey % 14 + 0.5)::DOUBLE AS dur FROM supplier)"
_GRID = "g AS (SELECT unnest([3, 5, 10]) AS sec), pl AS (SELECT unnest(['beginning', 'middle', 'end']) AS pos)"
_START = "CASE pos WHEN 'beginning' THEN 0.0 WHEN 'middle' THEN (dur - sec) / 2 ELSE dur - sec END::DOUBLE"
_SEED = "('0x' || substr(sha256(query_id), 1, 8))::BIGINT"
_CONDS = """cond AS (SELECT 'clean' AS condition, 'clean' AS family UNION ALL SELECT 'noise_' || k || '_snr' || s || 'db', 'noise' FROM (SELECT unnest(['pink', 'white']) AS k), (SELECT unnest([20, 10, 5, 0]) AS s)
  UNION ALL SELECT 'codec_mp3_' || s || 'k', 'codec' FROM (SELECT unnest([128, 64, 32]) AS s) UNION ALL SELECT 'codec_opus_' || s || 'k', 'codec' FROM (SELECT unnest([64, 32]) AS s) UNION ALL SELECT 'filter_' || s, 'filter' FROM (SELECT unnest(['telephone', 'lowpass8k']) AS s)
  UNION ALL SELECT 'speed_' || CASE WHEN s > 0 THEN '+' ELSE '' END || s || 'pct', 'speed' FROM (SELECT unnest([-5, -2, 2, 5]) AS s) UNION ALL SELECT 'pitch_' || CASE WHEN s > 0 THEN '+' ELSE '' END || s || 'st', 'pitch' FROM (SELECT unnest([-2, -1, 1, 2]) AS s))"""
#: Going through candidates one by one: a list of seen digests and one of seen families.
_WALK = """n AS (SELECT *, row_number() OVER (ORDER BY {order}) AS i FROM ({src})),
  w AS (SELECT 0::BIGINT AS i, NULL::{kind} AS id, ''::VARCHAR AS verdict, []::VARCHAR[] AS ds, []::VARCHAR[] AS bs
    UNION ALL SELECT n.i, n.id, CASE WHEN list_contains(w.ds, n.d) THEN 'd' WHEN list_contains(w.bs, n.b) THEN 'b' ELSE 'kept' END, CASE WHEN list_contains(w.ds, n.d) OR list_contains(w.bs, n.b) THEN w.ds ELSE list_append(w.ds, n.d) END, CASE WHEN list_contains(w.ds, n.d) OR list_contains(w.bs, n.b) THEN w.bs ELSE list_append(w.bs, n.b) END FROM w JOIN n ON n.i = w.i + 1)"""
_CAND = """c AS (SELECT p_partkey AS k, 't' || p_partkey % 700 || '_' || p_partkey AS track_id, 't' || p_partkey % 700 AS base, sha256('x' || p_partkey * 7 % 900) AS sha, p_partkey % 40 AS a, p_partkey % 11 AS ti FROM part),
  s AS (SELECT 't' || s_suppkey * 5 % 700 || '_' || s_suppkey * 5 % 900 AS track_id, 't' || s_suppkey * 5 % 700 AS base, sha256('x' || s_suppkey * 13 % 900) AS sha, s_suppkey % 4 AS a, s_suppkey % 3 AS ti FROM supplier)"""
_SCREEN = f"""{_CAND}, r AS (SELECT *, CASE WHEN sha IN (SELECT sha FROM s WHERE a <> 3) THEN 'digest in the corpus' WHEN track_id IN (SELECT track_id FROM s) THEN 'id in the corpus' WHEN base IN (SELECT base FROM s) THEN 'id family in the corpus'
  WHEN EXISTS (SELECT 1 FROM s WHERE s.a <> 3 AND s.a = c.a AND s.ti = c.ti) THEN 'artist and title in the catalog' WHEN a IN (SELECT a FROM s WHERE a <> 3) THEN 'artist in the catalog' END AS reason FROM c)"""
_FETCH = f"""{_CAND}, f AS (SELECT k AS place, 't' || k % 650 AS track_id, CASE WHEN k % 23 = 0 THEN 'short' ELSE sha END AS sha FROM c),
  r AS (SELECT *, CASE WHEN place % 23 = 0 THEN 'malformed digest' WHEN place % 29 = 0 THEN 'no duration' WHEN place % 31 = 0 THEN 'missing file' WHEN sha IN (SELECT sha FROM s) THEN 'digest is frozen' WHEN track_id IN (SELECT base FROM s) THEN 'id is frozen' END AS reason FROM f)"""
_FWALK = _WALK.format(order="id", kind="BIGINT", src="SELECT place AS id, sha AS d, track_id AS b FROM r WHERE reason IS NULL")
_NEG = """t AS (SELECT s_suppkey AS k, 's' || s_suppkey AS track_id, ((s_suppkey % 14 + 0.5) * 4 - 2)::DOUBLE AS len FROM supplier),
  w AS (SELECT track_id, len, -1::BIGINT AS place, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS start, 0.0::DOUBLE AS duration FROM t WHERE len > 0
    UNION ALL SELECT track_id, len, place + 1, pos + d, pos, d FROM (SELECT *, CASE WHEN pos + want <= len THEN want WHEN pos + 3 <= len THEN 3.0 END::DOUBLE AS d FROM (SELECT track_id, len, place, pos, CASE (place + 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 5.0 ELSE 10.0 END AS want FROM w)) WHERE d IS NOT NULL),
  side AS (SELECT track_id, CASE WHEN (row_number() OVER (ORDER BY track_id) - 1) % 2 = 0 THEN 'calibration' ELSE 'evaluation' END AS split FROM t),
  e AS (SELECT 'neg__' || track_id || '__d' || duration::INT || 's__t' || printf('%.1f', start + 1) AS query_id, 'negative_out_of_catalog_music' AS category, track_id AS source_track, start + 1 AS start_sec, duration, split FROM w JOIN side USING (track_id) WHERE place >= 0
    UNION ALL SELECT 'noise_' || n_name, 'white', NULL, 0.0, 5.0, CASE WHEN ('0x' || substr(sha256('noise_' || n_name), 1, 4))::BIGINT % 2 = 0 THEN 'calibration' ELSE 'evaluation' END FROM nation)"""
ORACLE_SQL = {
    "condition_matrix__Q1": f"WITH {_CONDS} SELECT * FROM cond",
    "positive_plan__Q2": f"""WITH {_TRACKS}, {_GRID}, {_CONDS}, q AS (SELECT track_id, dur, condition, family, sec, pos FROM cond CROSS JOIN t CROSS JOIN g CROSS JOIN pl WHERE sec <= dur AND (family = 'clean' OR pos = 'middle') AND (family IN ('clean', 'codec', 'filter') OR condition LIKE 'noise_pink%' OR sec = 5)),
  i AS (SELECT track_id || '__' || condition || '__d' || sec || 's__' || pos AS query_id, * FROM q) SELECT query_id, track_id, sec::DOUBLE AS duration, pos AS position, condition, family, {_START} AS start_sec, {_SEED} AS seed FROM i""",
    "heldout_plan__Q3": f"WITH {_TRACKS}, {_GRID}, i AS (SELECT track_id || '__neg_music__d' || sec || 's__' || pos AS query_id, * FROM t CROSS JOIN g CROSS JOIN pl WHERE sec <= dur) SELECT query_id, track_id AS source_track, sec::DOUBLE AS duration, pos AS position, {_START} AS start_sec, {_SEED} AS seed FROM i",
    "synthetic_plan__Z8": f"""WITH c AS (SELECT unnest(['silence', 'near_silence', 'noise_white', 'noise_pink']) AS c, unnest(['digital', 'dither', 'w', 'p']) AS t, unnest([0.0, 0.0001, 0.1, 0.1])::DOUBLE AS level), g AS (SELECT unnest([3, 5, 10]) AS sec),
  i AS (SELECT 'synthetic__negative_' || c || '__d' || sec || 's__' || t AS query_id, 'negative_' || c AS condition, sec::DOUBLE AS duration, level FROM c CROSS JOIN g) SELECT query_id, condition, duration, level, {_SEED} AS seed FROM i""",
    "screen_leakage__J10": f"""WITH RECURSIVE {_SCREEN}, {_WALK.format(order='id', kind='VARCHAR', src='SELECT track_id AS id, sha AS d, base AS b FROM r WHERE reason IS NULL')}
  SELECT track_id, reason FROM r WHERE reason IS NOT NULL UNION ALL SELECT id, CASE verdict WHEN 'd' THEN 'digest of another candidate' WHEN 'b' THEN 'id family of another candidate' ELSE 'kept' END FROM w WHERE i > 0""",
    "screen_corpus__J11": f"""WITH RECURSIVE {_FETCH}, {_FWALK}
  SELECT place, track_id, reason FROM r WHERE reason IS NOT NULL UNION ALL SELECT w.id, r.track_id, CASE verdict WHEN 'd' THEN 'digest repeats' WHEN 'b' THEN 'id repeats' ELSE 'kept' END FROM w JOIN r ON r.place = w.id WHERE i > 0""",
    "first_targets__limit": f"WITH RECURSIVE {_FETCH}, {_FWALK} SELECT r.track_id, r.place FROM w JOIN r ON r.place = w.id WHERE i > 0 AND verdict = 'kept' ORDER BY r.track_id LIMIT 60",
    "content_gate__Z6": f"WITH {_TRACKS} SELECT track_id FROM t WHERE k NOT IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(*) % 2 = 0 OR count(*) % 5 = 0)",
    "negative_set__Z7_Q5": f"WITH RECURSIVE {_NEG} SELECT * FROM e",
    "set_counts__A32": f"WITH RECURSIVE {_NEG} SELECT 'category' AS kind, category AS name, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'split', split, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'sources', split, count(DISTINCT source_track) FROM e WHERE source_track IS NOT NULL GROUP BY 2",
    "verify_set__Q7_J15": """WITH x AS (SELECT 'q' || event_id % 500 AS query_id, user_id AS u, CASE WHEN user_id % 10 <> 0 THEN 'u' || user_id END AS src, epoch_us(ts) AS s, CASE WHEN user_id % 10 = 1 THEN 'nowhere' WHEN user_id % 10 = 2 AND event_id % 2 = 0 THEN 'evaluation' ELSE 'calibration' END AS split FROM events WHERE event_type = 'purchase'),
  ids AS (SELECT DISTINCT user_id AS u FROM events), l AS (SELECT src, s, lead(s) OVER (PARTITION BY src ORDER BY s) AS nx FROM x WHERE src IS NOT NULL)
  SELECT 'source is indexed' AS rule, 'u' || u AS subject FROM ids WHERE u % 7 <> 0 AND u % 9 = 0 UNION ALL SELECT 'query repeats', query_id FROM x GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'unknown source', query_id FROM x WHERE src IS NOT NULL AND u % 7 = 0
  UNION ALL SELECT 'unknown split', query_id FROM x WHERE split = 'nowhere' UNION ALL SELECT 'source in both splits', src FROM x WHERE src IS NOT NULL GROUP BY 2 HAVING count(DISTINCT split) > 1 UNION ALL SELECT DISTINCT 'excerpts overlap', src FROM l WHERE nx < s + 3600000000""",
}
