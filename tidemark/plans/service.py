"""Queries of access, provider answers and catalog storage; suppliers stand for keys, parts for tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import access as ac
from tidemark.operators import provider as pr
from tidemark.operators import store as st
from tidemark.operators import usage as us
from tidemark.plans.relations import usage_events
from tidemark.session import table


def key_records(spark, d):
    s = table(spark, d, "supplier")
    raw = F.sha2(F.concat(F.lit("sk_live_"), "s_name").cast("binary"), 256)
    k = F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("k"), k.cast("string")).alias("key_id"), F.concat(F.lit("t"), F.col("s_nationkey").cast("string")).alias("tenant"), F.when(k % 2 == 0, F.concat(F.lit(" "), F.upper(raw), F.lit(" "))).otherwise(raw).alias("key_sha256"),
        F.when(k % 3 != 0, F.array(F.concat(F.lit("c"), F.col("s_nationkey").cast("string")), F.concat(F.lit("c"), ((F.col("s_nationkey") + 1) % 25).cast("string")))).alias("catalogs"),
        F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("identify"))).alias("scopes"), F.when(k % 5 != 0, F.lit(30)).alias("rate_limit_per_minute"), F.lit(None).cast("int").alias("rate_limit_burst"),
        k.cast("int").alias("audio_seconds_per_day"), F.when(F.col("s_acctbal") < 0, False).when(k % 7 != 0, True).alias("active"),
    )


def keys_defaults(spark, d):
    r = ac.with_defaults(key_records(spark, d))
    limits = [F.col(c).cast("long").alias(c) for c in ac.DEFAULT_LIMITS]
    return r.select("key_id", "tenant", "key_sha256", F.array_join("catalogs", ",").alias("catalogs"), F.array_join("scopes", ",").alias("scopes"), *limits, "active")


def key_upsert(spark, d):
    """Keys of the first load, then newer records of every third: half the limit, tenants swapped."""
    old = ac.with_defaults(key_records(spark, d))
    new = key_records(spark, d).where(F.substring("key_id", 2, 9).cast("long") % 3 == 0).withColumns({"tenant": F.lit("t-new"), "rate_limit_per_minute": F.lit(15)})
    out = ac.upsert_keys(old, new)
    return out.groupBy("tenant").agg(F.count(F.lit(1)).alias("keys"), F.sum("rate_limit_per_minute").alias("per_minute"), F.sum(F.col("active").cast("int")).alias("active"))


def key_revoke(spark, d):
    keys = ac.with_defaults(key_records(spark, d))
    gone = table(spark, d, "supplier").where("s_suppkey % 6 = 0").select(F.concat(F.lit("k"), F.col("s_suppkey").cast("string")).alias("key_id"))
    return ac.revoke(keys, gone).select("key_id", "active")


def key_problems(spark, d):
    n = F.substring("key_id", 2, 9).cast("long") % 10
    r = key_records(spark, d).withColumns({"key_sha256": F.when(n == 1, "xyz").when(n == 2, F.sha2(F.lit("same").cast("binary"), 256)).otherwise(F.col("key_sha256")), "tenant": F.when(n != 3, F.col("tenant"))})
    return ac.record_problems(r)


def requests(spark, d):
    c = F.col("c_custkey")
    key = F.format_string("sk_live_Supplier#%09d", c % 150 + 1)
    auth = F.when(c % 4 == 0, F.concat(F.lit("Bearer "), key)).when(c % 4 == 1, F.concat(F.lit("bearer   "), key, F.lit(" "))).when(c % 4 == 2, F.lit("Basic xyz"))
    api = F.when(c % 8 >= 6, F.concat(key, F.lit(" ")))
    return table(spark, d, "customer").select("c_custkey", ac.presented_key(auth, api).alias("raw"), F.concat(F.lit("c"), (c % 30).cast("string")).alias("catalog_id"))


def key_resolve(spark, d):
    return ac.resolve(requests(spark, d), ac.with_defaults(key_records(spark, d)), "raw").select("c_custkey", "key_id", "tenant")


def catalogs_readable(spark, d):
    who = ac.resolve(requests(spark, d), ac.with_defaults(key_records(spark, d)), "raw").where("key_id IS NOT NULL")
    held = table(spark, d, "nation").select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("catalog_id"))
    return ac.readable(who, held).select("c_custkey", "status")


def tenant_resolution(spark, d):
    n = table(spark, d, "nation")
    mapping = n.where("n_regionkey < 3").select(F.col("n_name").alias("catalog_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("tenant"))
    return ac.tenants(n.select(F.col("n_name").alias("catalog_id")), mapping)


def usage_history(spark, d):
    rows = ac.history(us.daily(usage_events(spark, d)), F.lit(3), F.lit("2024-01-10").cast("date"))
    return rows.select("key_id", F.col("usage_day").cast("string").alias("usage_day"), F.col("audio_seconds").cast("double").alias("audio_seconds"), "request_count", "match_count")


# ---- provider ----


def _uuid(c):
    h = F.md5(c.cast("string").cast("binary"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def recording(k):
    """A provider's recording as JSON text, made of a part: blanks, bad identifiers, a bare credit, scores out of range."""
    credit = F.array(
        F.struct(F.concat(F.lit(" "), "p_type").alias("name"), F.lit(" feat. ").alias("joinphrase"), F.struct(F.when(k % 3 == 0, F.lit("none")).otherwise(_uuid(k)).alias("id"), F.col("p_type").alias("name")).alias("artist")),
        F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("joinphrase"), F.struct(F.upper(_uuid(k + 1)).alias("id"), F.col("p_brand").alias("name")).alias("artist")),
    )
    release = F.array(F.struct(F.concat("p_type", F.lit("  ")).alias("title"), _uuid(k + 2).alias("id"), F.when(k % 2 == 0, "1998").alias("date")))
    return F.to_json(F.struct(
        F.when(k % 5 == 0, F.lit("x-1")).otherwise(_uuid(k)).alias("id"), F.when(k % 11 == 0, F.lit("n/a")).otherwise((F.col("p_size") * 3 - 20).cast("string")).alias("score"), F.when(k % 13 == 0, F.lit("   ")).otherwise(F.col("p_name")).alias("title"),
        credit.alias("artist-credit"), F.when(k % 4 != 0, release).alias("releases"), F.array(F.lit(" "), F.concat(F.lit(" us"), k.cast("string"))).alias("isrcs"),
    ))


def provider_recordings(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", pr.recording_fields(recording(k)).alias("f")).select("p_partkey", "f.*")


def lucene_query(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", pr.query_text(F.concat("p_type", F.lit(" & co/"), "p_brand"), F.concat("p_name", F.lit(" (live): \"x\" [a-b]?"))).alias("query"))


def enrich_run(spark, d):
    """Parts as tracks; every third has an answer already; the provider's first score is size * 2, the second size + 20."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    tracks = p.select(k.alias("track_id"), F.when(k % 7 != 0, F.col("p_name")).alias("title"), F.col("p_type").alias("artist"))
    old = p.where(k % 3 == 0).select(k.alias("track_id"), F.lit("matched").alias("match_status"), F.lit("q").alias("query_used"), F.lit(None).cast("string").alias("error_detail"), F.lit(1).alias("attempts"), F.from_json(F.lit('{"title":"old"}'), pr.FIELDS).alias("f")).select("track_id", "match_status", "query_used", "error_detail", "attempts", "f.*")
    body = F.concat(F.lit('{"recordings":[{"score":'), (F.col("p_size") * 2).cast("string"), F.lit(',"title":"one"},"junk",{"score":'), (F.col("p_size") + 20).cast("string"), F.lit("}]}"))
    lookups = p.select(k.alias("track_id"), F.lit("q").alias("query_used"), F.when(k % 17 == 0, F.lit('{"error":1}')).otherwise(body).alias("response"), F.when(k % 19 == 0, F.repeat(F.lit("x"), 600)).alias("error"), F.lit(2).alias("attempts"))
    out = pr.enrich(tracks, old, lookups)
    return out.groupBy("match_status", "title").agg(F.count(F.lit(1)).alias("n"), F.sum("attempts").cast("long").alias("attempts"), F.max(F.length("error_detail")).cast("long").alias("longest_error"), F.sum("match_score").alias("score_sum"))


def dispatch_rates(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_linenumber").cast("double").alias("seconds"))
    return li.select("l_orderkey", pr.dispatch_rate(F.col("n"), F.col("seconds") - 1).alias("rate"))


# ---- catalogs ----


def content_pairs_hash(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return st.pair_hash(docs, "source", "doc_id", "sha")


def source_lines_hash(spark, d):
    s = table(spark, d, "supplier").select("s_nationkey", "s_name", F.when(F.col("s_suppkey") % 5 != 0, F.sha2(F.col("s_acctbal").cast("decimal(12,2)").cast("string"), 256)).alias("sha"))
    return s.groupBy("s_nationkey").agg(st.lines_hash(s, "s_name", "sha").alias("fingerprint")).withColumn("s_nationkey", F.col("s_nationkey").cast("long"))


def duplicate_ids(spark, d):
    return st.duplicate_members(table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha")), "doc_id", "sha")


def counts_of_values(spark, d):
    docs = table(spark, d, "documents")
    return st.value_counts(docs, lang=F.col("lang"), source=F.col("source"), extension=st.extension(F.concat(F.col("source"), F.lit("/a."), F.coalesce("lang", F.lit("")))))


def catalog_tracks(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("catalog_id"), F.col("o_orderkey").cast("string").alias("track_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"), F.col("o_totalprice").alias("duration_sec"), F.col("o_orderkey").alias("bytes"), (F.col("o_orderkey") % 100).alias("fingerprint_count"))


def catalog_totals(spark, d):
    return st.totals(catalog_tracks(spark, d), "catalog_id")


def scale_scalars(spark, d):
    return st.scale_figures(catalog_tracks(spark, d), F.lit(1_000_000.0), F.lit(50.0))


def ingest_counts(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "cached").when(F.col("o_orderstatus") == "O", "ingested").otherwise("skipped")
    return st.ingest_summary(table(spark, d, "orders").select(state.alias("state")))


def track_problems(spark, d):
    k = F.col("track_id").cast("long")
    t = catalog_tracks(spark, d).withColumns({"sha256": F.when(k % 31 == 0, "abc").otherwise(F.col("sha256")), "duration_sec": F.when(k % 37 != 0, F.col("duration_sec"))})
    return st.catalog_problems(t.withColumn("track_id", F.when(k % 41 == 0, "").when(k % 43 == 0, "twice").otherwise(F.col("track_id")))).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def catalogs_after_delete(spark, d):
    """What is left of catalogs (nations) and their tracks (customers) without one catalog."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("catalog_id"))
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("catalog_id"), "c_custkey")
    rest, kids = st.delete_catalog(n, {"tracks": c}, 7)
    return rest.join(kids["tracks"].groupBy("catalog_id").agg(F.count(F.lit(1)).alias("tracks")), "catalog_id", "left").select(F.col("catalog_id").cast("long").alias("catalog_id"), F.coalesce("tracks", F.lit(0)).cast("long").alias("tracks"))


QUERIES = {
    "keys_with_defaults__Z1": keys_defaults, "key_upsert__Z1": key_upsert, "key_revoke__Z1": key_revoke, "key_problems__P15": key_problems, "key_resolve__P15_Z32": key_resolve, "catalogs_readable__P16": catalogs_readable,
    "tenant_resolution__Z26": tenant_resolution, "usage_history__Z3": usage_history, "provider_recordings__json": provider_recordings, "lucene_query__scalar": lucene_query, "enrich_run__Z35_J7_Z4": enrich_run, "dispatch_rates__A40": dispatch_rates,
    "content_pairs_hash__A31": content_pairs_hash, "source_lines_hash__Z24": source_lines_hash, "duplicate_ids__A30": duplicate_ids, "value_counts__A33": counts_of_values, "catalog_totals__A34": catalog_totals, "scale_scalars__A41": scale_scalars,
    "ingest_counts__A38": ingest_counts, "track_problems__constraints": track_problems, "catalogs_after_delete__Z2": catalogs_after_delete,
}

_KEYS = """k AS (SELECT 'k' || s_suppkey AS key_id, s_suppkey AS n, 't' || s_nationkey AS tenant, sha256('sk_live_' || s_name) AS key_sha256, CASE WHEN s_suppkey % 3 <> 0 THEN ['c' || s_nationkey, 'c' || (s_nationkey + 1) % 25] ELSE [] END AS catalogs,
  CASE WHEN s_suppkey % 4 = 0 THEN ['identify', 'catalogs:read'] ELSE ['identify'] END AS scopes, CASE WHEN s_suppkey % 5 <> 0 THEN 30 ELSE 60 END AS rpm, NOT coalesce(s_acctbal < 0, FALSE) AS active FROM supplier)"""
_REQ = """c AS (SELECT c_custkey, 'sk_live_Supplier#' || lpad((c_custkey % 150 + 1)::VARCHAR, 9, '0') AS v FROM customer), r AS (SELECT c_custkey, 'c' || c_custkey % 30 AS catalog_id, CASE WHEN c_custkey % 4 IN (0, 1) THEN v WHEN c_custkey % 4 = 3 AND c_custkey % 8 >= 6 THEN v END AS raw FROM c)"""
_M = "md5(({0})::VARCHAR)"


def _u(k: str) -> str:
    m = f"md5(({k})::VARCHAR)"
    return f"(substr({m}, 1, 8) || '-' || substr({m}, 9, 4) || '-' || substr({m}, 13, 4) || '-' || substr({m}, 17, 4) || '-' || substr({m}, 21, 12))"


_DAILY = "u AS (SELECT user_id % 10 AS tenant, user_id AS key_id, ts::DATE AS day, value AS s, event_type = 'purchase' AS matched FROM events)"
ORACLE_SQL = {
    "keys_with_defaults__Z1": f"WITH {_KEYS} SELECT key_id, tenant, key_sha256, array_to_string(catalogs, ',') AS catalogs, array_to_string(scopes, ',') AS scopes, rpm::BIGINT AS rate_limit_per_minute, 0::BIGINT AS rate_limit_burst, n::BIGINT AS audio_seconds_per_day, active FROM k",
    "key_upsert__Z1": f"WITH {_KEYS} SELECT CASE WHEN n % 3 = 0 THEN 't-new' ELSE tenant END AS tenant, count(*) AS keys, sum(CASE WHEN n % 3 = 0 THEN 15 ELSE rpm END)::BIGINT AS per_minute, count(*) FILTER (active) AS active FROM k GROUP BY 1",
    "key_revoke__Z1": f"WITH {_KEYS} SELECT key_id, active AND n % 6 <> 0 AS active FROM k",
    "key_problems__P15": f"""WITH {_KEYS} SELECT key_id, CASE n % 10 WHEN 1 THEN 'not a digest' WHEN 3 THEN 'incomplete' END AS problem FROM k WHERE n % 10 IN (1, 3)
  UNION ALL SELECT key_id, 'digest repeats' FROM k WHERE n % 10 = 2 AND key_id <> (SELECT min(key_id) FROM k WHERE n % 10 = 2)""",
    "key_resolve__P15_Z32": f"WITH {_KEYS}, {_REQ} SELECT c_custkey, key_id, tenant FROM r LEFT JOIN k ON k.active AND k.key_sha256 = sha256(r.raw)",
    "catalogs_readable__P16": f"WITH {_KEYS}, {_REQ} SELECT c_custkey, CASE WHEN (len(k.catalogs) = 0 OR list_contains(k.catalogs, r.catalog_id)) AND c_custkey % 30 < 25 THEN 'found' ELSE 'not found' END AS status FROM r JOIN k ON k.active AND k.key_sha256 = sha256(r.raw)",
    "tenant_resolution__Z26": "SELECT n_name AS catalog_id, CASE WHEN n_regionkey < 3 THEN 'r' || n_regionkey END AS tenant, CASE WHEN n_regionkey >= 3 THEN 'no tenant' END AS problem FROM nation",
    "usage_history__Z3": f"WITH {_DAILY} SELECT key_id, strftime(day, '%Y-%m-%d') AS usage_day, sum(round(s::DECIMAL(18,6), 3)::DECIMAL(14,3))::DOUBLE AS audio_seconds, count(*) AS request_count, count(*) FILTER (matched) AS match_count FROM u WHERE tenant = 3 AND day >= DATE '2024-01-10' GROUP BY 1, 2",
    "provider_recordings__json": f"""SELECT p_partkey, CASE WHEN p_partkey % 13 <> 0 THEN trim(p_name) END AS title, trim(p_type) || ' feat. ' || p_brand AS artist, CASE WHEN p_partkey % 4 <> 0 THEN trim(p_type) END AS album, CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 2 = 0 THEN '1998' END AS release_date,
  'US' || p_partkey AS isrc, CASE WHEN p_partkey % 5 <> 0 THEN {_u('p_partkey')} END AS mb_recording_id, CASE WHEN p_partkey % 4 <> 0 THEN {_u('p_partkey + 2')} END AS mb_release_id, CASE WHEN p_partkey % 3 = 0 THEN {_u('p_partkey + 1')} ELSE {_u('p_partkey')} END AS mb_artist_id,
  CASE WHEN p_partkey % 11 <> 0 THEN greatest(0, least(100, p_size * 3 - 20))::DOUBLE END AS match_score FROM part""",
    "lucene_query__scalar": r"""SELECT p_partkey, 'recording:"' || trim(regexp_replace(p_name || ' (live): "x" [a-b]?', '([-+&|!(){}\[\]^"~*?:\\/])', '\\\1', 'g')) || '" AND artist:"' || trim(regexp_replace(p_type || ' & co/' || p_brand, '([-+&|!(){}\[\]^"~*?:\\/])', '\\\1', 'g')) || '"' AS query FROM part""",
    "enrich_run__Z35_J7_Z4": """WITH p AS (SELECT p_partkey AS k, p_size * 2.0 AS a, p_size + 20.0 AS b FROM part),
  s AS (SELECT k, CASE WHEN k % 7 = 0 THEN 'skipped' WHEN k % 3 = 0 THEN 'matched' WHEN k % 19 = 0 OR k % 17 = 0 THEN 'error' WHEN a < 80 THEN 'no_match' WHEN a - b < 5 THEN 'ambiguous' ELSE 'matched' END AS match_status, k % 7 <> 0 AND k % 3 = 0 AS old, a FROM p)
  SELECT match_status, CASE WHEN old THEN 'old' WHEN match_status IN ('matched', 'ambiguous') THEN 'one' END AS title, count(*) AS n, sum(CASE WHEN match_status = 'skipped' THEN NULL WHEN old THEN 1 ELSE 2 END)::BIGINT AS attempts,
  max(CASE WHEN match_status = 'error' THEN CASE WHEN k % 19 = 0 THEN 512 ELSE 34 END END)::BIGINT AS longest_error, sum(CASE WHEN NOT old AND match_status IN ('matched', 'ambiguous') THEN least(100.0, a)::DOUBLE END) AS score_sum FROM s GROUP BY 1, 2""",
    "dispatch_rates__A40": "SELECT l_orderkey, CASE WHEN count(*) >= 2 AND max(l_linenumber) > 1 THEN (count(*) - 1)::DOUBLE / (max(l_linenumber) - 1) ELSE 0.0 END::DOUBLE AS rate FROM lineitem GROUP BY 1",
    "content_pairs_hash__A31": """SELECT source, count(*) AS track_count, sha256('[' || string_agg('["' || doc_id || '", "' || sha256(coalesce(text, '')) || '"]', ', ' ORDER BY doc_id::VARCHAR, sha256(coalesce(text, ''))) || ']') AS content_hash FROM documents GROUP BY 1""",
    "source_lines_hash__Z24": "SELECT s_nationkey::BIGINT AS s_nationkey, sha256(string_agg(s_name || ':' || CASE WHEN s_suppkey % 5 <> 0 THEN sha256(s_acctbal::DECIMAL(12,2)::VARCHAR) ELSE 'missing' END || chr(10), '' ORDER BY s_name)) AS fingerprint FROM supplier GROUP BY 1",
    "duplicate_ids__A30": "SELECT sha256(text) AS sha, doc_id, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents WHERE text IS NOT NULL QUALIFY copies > 1",
    "value_counts__A33": "SELECT 'lang' AS kind, lang AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL UNION ALL SELECT 'extension', CASE WHEN source IS NOT NULL THEN CASE WHEN coalesce(lang, '') <> '' THEN '.' || lower(lang) ELSE '' END END, count(*) FROM documents GROUP BY ALL",
    "catalog_totals__A34": "SELECT o_custkey AS catalog_id, count(*) AS tracks, sum(o_totalprice::DECIMAL(18,3))::DOUBLE AS duration_sec, sum(o_orderkey % 100)::BIGINT AS fingerprints, sum(o_orderkey)::BIGINT AS bytes FROM orders GROUP BY 1",
    "scale_scalars__A41": "SELECT count(*) AS tracks, 1000000.0::DOUBLE / count(*) AS postings_per_track, 1000000.0::DOUBLE / sum(o_totalprice::DECIMAL(18,3))::DOUBLE AS postings_per_second, count(*) / 50.0::DOUBLE AS tracks_per_second, sum(o_totalprice::DECIMAL(18,3))::DOUBLE / 50.0::DOUBLE AS realtime_factor FROM orders",
    "ingest_counts__A38": "SELECT count(*) FILTER (o_orderstatus IN ('F', 'O')) AS ingested, count(*) FILTER (o_orderstatus = 'F') AS cache_hits, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS skipped, count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*) FILTER (o_orderstatus IN ('F', 'O')) AS cache_hit_rate FROM orders",
    "track_problems__constraints": """WITH t AS (SELECT o_orderkey AS k FROM orders) SELECT 'malformed digest' AS problem, count(*) AS n FROM t WHERE k % 31 = 0 UNION ALL SELECT 'no duration', count(*) FROM t WHERE k % 37 = 0 UNION ALL SELECT 'empty id', count(*) FROM t WHERE k % 41 = 0 HAVING count(*) > 0
  UNION ALL SELECT 'id repeats', (CASE WHEN count(*) FILTER (k % 41 = 0) > 1 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (k % 41 <> 0 AND k % 43 = 0) > 1 THEN 1 ELSE 0 END)::BIGINT FROM t""",
    "catalogs_after_delete__Z2": "SELECT n_nationkey::BIGINT AS catalog_id, count(c_custkey) AS tracks FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey <> 7 GROUP BY 1",
}
