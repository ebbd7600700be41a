"""Queries of report forms and small relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluate as ev
from tidemark.operators import negatives as ng
from tidemark.operators import reports as rp
from tidemark.operators.index import row_digest
from tidemark.plans import evaluation as pe
from tidemark.plans import negatives as pn
from tidemark.plans import service as ps
from tidemark.session import table

POINTS = 12


def sampled_sweep(spark, d):
    return rp.sample_points(ev.sweep(pe.scored(spark, d)), "score", POINTS).select("score", "tp", "wrong", "fp", "recall", "far")


def columnar_sweep(spark, d):
    c = rp.columnar(sampled_sweep(spark, d), "score")
    return c.select(F.size("score").cast("long").alias("points"), F.element_at("score", 1).alias("least"), F.element_at("score", -1).alias("most"), F.array_join("tp", ",").alias("tp"), F.array_join("fp", ",").alias("fp"))


def families(spark, d):
    """Conditions (line numbers) of returned lines before, of the others after, by family (ship month)."""
    li = table(spark, d, "lineitem")
    one = lambda part: li.where(part).groupBy(F.concat_ws("/", F.month("l_shipdate").cast("string"), F.col("l_linenumber").cast("string")).alias("condition")).agg(F.first(F.month("l_shipdate").cast("long")).alias("family"), F.count(F.lit(1)).alias("queries"), ev.n_if(F.col("l_quantity") > 25).alias("hits"))
    return rp.rolled_up(one(F.col("l_returnflag") == "R"), one(F.col("l_returnflag") != "R")).select("family", "queries", *(F.round(c, 9).alias(c) for c in ("before", "after", "delta")))


def picked_files(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    files = o.select(
        F.col("o_custkey").alias("item"), F.concat(F.lit("f"), k.cast("string")).alias("name"), F.when(k % 4 == 0, "Ogg").otherwise("VBR MP3").alias("format"),
        F.when(k % 9 == 0, "big").otherwise((k * 100 % 30_000_000).cast("string")).alias("size"), F.when(k % 11 == 0, "1:02").otherwise((k % 700).cast("string")).alias("length"),
    )
    return rp.pick_files(files).select("item", "name", F.col("place").cast("long").alias("place"))


def point_lookup(spark, d):
    """Some ids among all documents; the filter reaches the scan."""
    return table(spark, d, "documents").where(F.col("doc_id").isin(7, 40, 199, 10**9)).select("doc_id", "lang", "source")


def distance_domain(spark, d):
    s = pe.scored(spark, d)
    return s.where("is_negative").select("score").union(s.where(~F.col("is_negative")).select("score")).distinct()


def catalogs_wanted(spark, d):
    n = table(spark, d, "nation")
    return rp.wanted_catalogs(n.where("n_regionkey < 2").select(F.col("n_name").alias("catalog_id")), n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("catalog_id")))


def listing(spark, d):
    """Catalogs of one tenant in order of id."""
    return table(spark, d, "customer").where("c_nationkey = 3").select("c_custkey", "c_name").orderBy("c_custkey")


def math_columns(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(rp.midi_to_hz(F.col("p_size") + 40), 6).alias("hz"), F.round(rp.decibels((F.col("p_size") - 1) / 10.0), 6).alias("db"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("p_retailprice") - 900)).alias("clamped"))


def day_columns(spark, d):
    e, ts = table(spark, d, "events"), F.col("ts").cast("timestamp")
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return e.select("event_id", rp.seconds_to_midnight(ts).alias("left"), rp.is_stale(F.when(F.col("event_type") != "view", ts), now, 5).alias("stale"))


def map_columns(spark, d):
    """Parameters as a map: values transformed, one dropped, read back."""
    p = table(spark, d, "part").withColumn("m", F.map_from_arrays(F.array(F.lit("brand"), F.lit("size"), F.lit("type")), F.array("p_brand", F.col("p_size").cast("string"), "p_type")))
    m = F.map_filter(F.transform_values("m", lambda k, v: F.concat(k, F.lit("="), v)), lambda k, v: k != "type")
    return p.select("p_partkey", F.array_join(F.array_sort(F.map_values(m)), ";").alias("shown"), F.size(m).cast("long").alias("entries"), F.element_at("m", "type").alias("type"))


def render_groups(spark, d):
    """Queries to cut by source: each source is read once, for all its excerpts."""
    plan = ng.heldout_plan(pn.tracks(spark, d))
    return plan.groupBy("source_track").agg(F.count(F.lit(1)).alias("excerpts"), F.max(F.col("start_sec") + F.col("duration")).alias("until"))


def migrations(spark, d):
    n = table(spark, d, "nation")
    sha = F.sha2("n_name", 256)
    files = n.where("n_nationkey <> 4").select(F.col("n_name").alias("name"), sha.alias("sha256"))
    applied = n.where("n_nationkey < 10").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") == 6, "old").otherwise(sha).alias("sha256"))
    return rp.ledger(files, applied)


def backfill(spark, d):
    t = ps.catalog_tracks(spark, d).select("track_id", "sha256", F.lit(None).cast("string").alias("title"), F.when(F.col("bytes") % 3 == 0, "A").alias("artist"))
    about = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("track_id"), F.col("o_orderstatus").alias("title"), F.lit("B").alias("artist"))
    digest = lambda x: row_digest(x.select(F.xxhash64("track_id").alias("hash"), "track_id", F.xxhash64("sha256").alias("anchor_frame")))
    return rp.backfilled(t, about, digest).groupBy("title", "artist").agg(F.count(F.lit(1)).alias("tracks"))


def scale_check(spark, d):
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("sha256"), "source")
    return rp.scale_checks(docs, docs.where("source = 'src0'"))


def artifact_versions(spark, d):
    k = F.col("s_suppkey")
    sha = F.upper(F.sha2(F.col("s_name"), 256))
    text = F.when(k % 5 == 0, "{").when(k % 5 == 1, '{"other": 1}').when(k % 5 == 2, F.lit('{"index_content_hash": "abc"}')).otherwise(F.concat(F.lit('{"index_content_hash": " '), sha, F.lit('", "n": 2}')))
    return table(spark, d, "supplier").select("s_suppkey", rp.artifact_version(text).alias("v")).select("s_suppkey", "v.*")


def fixtures(spark, d):
    return rp.fixture_specs(spark)


def batch_errors(spark, d):
    """One job over all queries: a row that fails keeps its place with an error, and counts by error."""
    e = table(spark, d, "events")
    value = F.when(F.col("event_type") != "error", F.try_divide(F.col("value"), F.floor(F.col("value") / 20)))
    error = F.when(F.col("event_type") == "error", "failed").when(value.isNull(), "division by zero")
    return e.groupBy("event_type", error.alias("error")).agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("answers"))


QUERIES = {
    "sampled_sweep__A12_A16": sampled_sweep, "columnar_sweep__A16_S24": columnar_sweep, "family_delta__J13": families, "picked_files__P8": picked_files, "point_lookup__P2": point_lookup, "distance_domain__set": distance_domain, "wanted_catalogs__set": catalogs_wanted,
    "ordered_listing__sort": listing, "math_columns__scalar": math_columns, "day_columns__scalar": day_columns, "map_columns__scalar": map_columns, "render_groups__Q6": render_groups, "migration_ledger__S23": migrations, "backfill_gate__Z27": backfill,
    "scale_check__Z28": scale_check, "artifact_versions__Z20": artifact_versions, "fixture_specs__X20": fixtures, "batch_errors__Z10": batch_errors,
}

_N = f"n AS (SELECT *, row_number() OVER (ORDER BY score) - 1 AS place, count(*) OVER () AS n FROM swept), w AS (SELECT CASE WHEN i = {POINTS - 1} THEN n - 1 ELSE floor(i * ((n - 1) / {POINTS - 1}.0::DOUBLE)) END::BIGINT AS place FROM (SELECT any_value(n) AS n FROM n), (SELECT unnest(range({POINTS})) AS i)), s AS (SELECT score, tp, wrong, fp, recall, far FROM n WHERE n <= {POINTS} OR place IN (SELECT place FROM w))"
_LI = "c AS (SELECT l_returnflag = 'R' AS r, month(l_shipdate) || '/' || l_linenumber AS condition, any_value(month(l_shipdate)) AS family, count(*) AS q, count(*) FILTER (l_quantity > 25) AS h FROM lineitem GROUP BY 1, 2)"
ORACLE_SQL = {
    "sampled_sweep__A12_A16": f"{pe._SWEPT}, {_N} SELECT * FROM s",
    "columnar_sweep__A16_S24": f"{pe._SWEPT}, {_N} SELECT count(*) AS points, min(score) AS least, max(score) AS most, string_agg(tp::VARCHAR, ',' ORDER BY score) AS tp, string_agg(fp::VARCHAR, ',' ORDER BY score) AS fp FROM s",
    "family_delta__J13": f"WITH {_LI} SELECT b.family, sum(b.q)::BIGINT AS queries, round(sum(a.h::DOUBLE / a.q * b.q) / sum(b.q), 9) AS before, round(sum(b.h)::DOUBLE / sum(b.q), 9) AS after, round((sum(b.h) - sum(a.h::DOUBLE / a.q * b.q)) / sum(b.q), 9) AS delta FROM c b JOIN c a USING (condition) WHERE a.r AND NOT b.r GROUP BY 1",
    "picked_files__P8": """WITH f AS (SELECT o_custkey AS item, 'f' || o_orderkey AS name, o_orderkey % 700 AS len, o_orderkey * 100 % 30000000 AS size FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 9 <> 0 AND o_orderkey % 11 <> 0)
  SELECT item, name, row_number() OVER (PARTITION BY item ORDER BY len, name) AS place FROM f WHERE len BETWEEN 45 AND 600 AND size > 0 AND size <= 18 * 1024 * 1024 QUALIFY place <= 2""",
    "point_lookup__P2": "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (7, 40, 199, 1000000000)",
    "distance_domain__set": f"{pe._SCORED} SELECT DISTINCT score FROM scored",
    "wanted_catalogs__set": "SELECT n_name AS catalog_id FROM nation WHERE n_regionkey < 2 UNION SELECT n_name FROM nation WHERE n_nationkey % 2 = 0",
    "ordered_listing__sort": "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey",
    "math_columns__scalar": "SELECT p_partkey, round(440.0 * pow(2.0, (p_size + 40 - 69) / 12.0), 6) AS hz, round(10 * log10(greatest(1e-10, (p_size - 1) / 10.0)), 6) AS db, greatest(0.0, least(100.0, p_retailprice - 900))::DOUBLE AS clamped FROM part",
    "day_columns__scalar": "SELECT event_id, greatest(1, floor((86400000000 - epoch_us(ts) % 86400000000) / 1000000.0))::BIGINT AS left, event_type = 'view' OR ts < TIMESTAMP '2024-01-15' AS stale FROM events",
    "map_columns__scalar": "SELECT p_partkey, 'brand=' || p_brand || ';size=' || p_size AS shown, 2::BIGINT AS entries, p_type AS type FROM part",
    "render_groups__Q6": f"WITH {pn._TRACKS}, {pn._GRID}, i AS (SELECT track_id, sec, {pn._START} AS s FROM t CROSS JOIN g CROSS JOIN pl WHERE sec <= dur) SELECT track_id AS source_track, count(*) AS excerpts, max(s + sec)::DOUBLE AS until FROM i GROUP BY 1",
    "migration_ledger__S23": "SELECT n_name AS name, CASE WHEN n_nationkey = 4 THEN 'gone' WHEN n_nationkey >= 10 THEN 'pending' WHEN n_nationkey = 6 THEN 'changed' ELSE 'applied' END AS state FROM nation",
    "backfill_gate__Z27": "SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'A' WHEN o_orderkey % 2 = 0 THEN 'B' END AS artist, count(*) AS tracks FROM orders GROUP BY 1, 2",
    "scale_check__Z28": "WITH p AS (SELECT sha256(text) AS s, count(*) AS n, bool_or(source = 'src0') AS f FROM documents GROUP BY 1) SELECT sum(n)::BIGINT AS tracks, count(*) AS distinct_digests, count(*) FILTER (n > 1) AS duplicate_groups, count(*) FILTER (f AND s IS NOT NULL) AS overlap FROM p",
    "artifact_versions__Z20": "SELECT s_suppkey, CASE WHEN s_suppkey % 5 > 2 THEN sha256(s_name) END AS version, CASE s_suppkey % 5 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'no version' WHEN 2 THEN 'invalid version' END AS problem FROM supplier",
    "fixture_specs__X20": """WITH b AS (SELECT unnest([60.0, 70, 80, 90, 100, 110, 120, 128, 140, 160, 174, 180, 95.5, 143])::DOUBLE AS bpm, unnest([30.0, 30, 20, 20, 20, 20, 30, 20, 30, 20, 20, 20, 20, 10])::DOUBLE AS seconds), k AS (SELECT unnest(['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']) AS t), m AS (SELECT unnest(['major', 'minor']) AS m)
  SELECT 'bpm_' || CASE WHEN bpm = floor(bpm) THEN bpm::INT::VARCHAR ELSE bpm::VARCHAR END AS fixture_id, 'bpm' AS kind, seconds, bpm, NULL::VARCHAR AS key, CASE WHEN bpm * 2 IN (SELECT bpm FROM b) OR bpm / 2 IN (SELECT bpm FROM b) THEN 'octave-pair' WHEN seconds <= 10 THEN 'short' WHEN bpm <> floor(bpm) THEN 'non-integer' END AS tag FROM b
  UNION ALL SELECT 'key_' || replace(t, '#', 's') || '_' || m, 'key', 12.0, NULL, t || ' ' || m, 'relative-pair' FROM k CROSS JOIN m""",
    "batch_errors__Z10": "SELECT event_type, CASE WHEN event_type = 'error' THEN 'failed' WHEN floor(value / 20) = 0 THEN 'division by zero' END AS error, count(*) AS n, count(*) FILTER (event_type <> 'error' AND floor(value / 20) <> 0) AS answers FROM events GROUP BY 1, 2",
}
