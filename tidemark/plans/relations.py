"""Catalog, enrichment, access and usage queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import catalog as ct
from tidemark.operators import usage as us
from tidemark.session import table


def duplicates(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return ct.duplicate_content(docs, "doc_id", "sha")


def content_hash(spark, d):
    from tidemark.operators.index import content_hash as digest

    docs = table(spark, d, "documents").select("source", "doc_id", F.sha2("text", 256).alias("sha"))
    return digest(docs, "source", "doc_id", "sha")


def pending(spark, d):
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("fetched_at")).withColumnRenamed("o_custkey", "c_custkey")
    return ct.pending(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), orders, "c_custkey", F.lit("2000-06-01").cast("timestamp_ntz"))


def unmatched(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 300000")
    return c.join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers")).withColumn("c_nationkey", F.col("c_nationkey").cast("long"))


def sidecar(spark, d):
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    by_digest = p.groupBy("p_name").agg(F.max("p_brand").alias("title"))
    by_id = s.select(F.col("s_suppkey").alias("p_partkey"), F.col("s_name").alias("title"))
    rows = p.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("p_name"))
    return ct.coalescing_lookup(rows, by_digest, by_id, "p_name", "p_partkey", "title").select("p_partkey", "title")


def drift(spark, d):
    o = table(spark, d, "orders")
    at = lambda lo, hi: o.where((F.col("o_orderdate") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(hi).cast("timestamp_ntz"))).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return ct.drift(at("1996-01-01", "1997-01-01"), at("1997-01-01", "1998-01-01"), "o_custkey", "n").groupBy("change").agg(F.count(F.lit(1)).alias("customers"), F.sum("before").alias("before"), F.sum("after").alias("after"))


def sym_diff(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    b = table(spark, d, "orders").where("o_totalprice > 300000").select((F.col("o_custkey") + 7).alias("id")).distinct()
    return ct.symmetric_difference(a, b)


def cohort_union(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).withColumn("cohort", F.lit("legacy"))
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct().withColumn("cohort", F.lit("expanded"))
    return a.unionByName(b).groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))


def sha_overlap(spark, d):
    sha = lambda t: table(spark, d, t).select(F.sha2("text", 256).alias("sha"))
    first = table(spark, d, "documents").where("source = 'src0'").select(F.sha2("text", 256).alias("sha"))
    rest = table(spark, d, "documents").where("source <> 'src0'").select(F.sha2("text", 256).alias("sha"))
    return first.intersect(rest).withColumn("with", F.lit("sources")).unionByName(sha("documents").intersect(sha("benchmark")).withColumn("with", F.lit("benchmark")))


def overlaps(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("start"))
    rows = e.withColumn("stop", F.col("start") + 3_600_000_000)
    return ct.adjacent_overlaps(rows, "user_id", "start", "stop", 0.0).select("user_id", "event_id", "next_start")


def screening(spark, d):
    """Documents as candidates: rejected if short, without a label or toxic; then by content and by leading words."""
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = table(spark, d, "documents").join(labels, "doc_id", "left").select("doc_id", "n_chars", "toxic", F.sha2("text", 256).alias("sha"), F.substring("text", 1, 12).alias("base"))
    reasons = [("short", F.col("n_chars") < 200), ("unlabelled", F.col("toxic").isNull()), ("toxic", F.col("toxic") == 1)]
    return ct.screen(docs, reasons, "doc_id", "sha", "base").select("doc_id", "why")


def upserted(spark, d):
    o = table(spark, d, "orders")
    per = lambda part: o.where(part).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("latest"))
    return ct.upsert(per("o_orderkey % 2 = 0"), per("o_orderkey % 3 = 0"), ["k"], add=("n",))


def constraints(spark, d):
    return ct.violations(table(spark, d, "part"), {"price positive": F.col("p_retailprice") > 0, "size to 40": F.col("p_size") <= 40, "name not red": ~F.col("p_name").startswith("red")})


def enrichment(spark, d):
    """Provider answers made of props: three scores a user, in event order, classified."""
    from pyspark.sql import Window

    e = table(spark, d, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    e = e.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("r <= 3")
    g = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "k"))), lambda x: x["k"]).alias("scores"))
    return g.select("user_id", ct.enrichment_status(F.col("scores")).alias("status"), F.col("scores")[0].cast("long").alias("top"))


def json_normalise(spark, d):
    k = F.try_element_at(F.from_json("props", "map<string,string>"), F.lit("k")).try_cast("int")
    rows = table(spark, d, "events").select("event_type", F.greatest(F.lit(0), F.least(F.lit(90), k)).alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("k_sum"), F.min("k").cast("long").alias("low"), F.max("k").cast("long").alias("high"))


def text_normalise(spark, d):
    p = table(spark, d, "part")
    return p.groupBy(tx.normalise(F.concat_ws("--", "p_name", "p_type")).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min(tx.base_id(F.concat_ws("_", "p_brand", F.col("p_size").cast("string")))).alias("base"))


def licences(spark, d):
    """URLs with a licence address put on by page number."""
    tails = ("creativecommons.org/licenses/by/4.0", "CreativeCommons.org/licenses/by-sa/4.0", "creativecommons.org/licenses/by-nc/4.0", "creativecommons.org/publicdomain/zero/1.0", "creativecommons.org/publicdomain/mark/1.0", "example.com/by/someone", "CC BY 4.0")
    tail = F.element_at(F.array(*(F.lit(x) for x in tails)), (F.col("page_id") % len(tails) + 1).cast("int"))
    u = F.concat("url", F.lit("?"), tail)
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    rows = table(spark, d, "pages").select(host.alias("host"), tx.permissive(u).alias("ok"), tx.licence_name(u).alias("name"))
    return rows.groupBy("name", "ok").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("host").alias("hosts"))


def access(spark, d):
    """Keys (customers) with lists of nations they may read, against catalogs (nations)."""
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") < 5, F.array().cast("array<int>")).otherwise(F.array("c_nationkey", (F.col("c_nationkey") + 1) % 25)).alias("allowed"))
    n = table(spark, d, "nation").select("n_nationkey")
    return c.crossJoin(F.broadcast(n)).where(ct.may_read(F.col("allowed"), F.col("n_nationkey"))).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("readable"))


def page_of(spark, d):
    return table(spark, d, "orders").orderBy("o_orderkey").offset(100).limit(50).select("o_orderkey", "o_orderstatus")


def usage_events(spark, d):
    return table(spark, d, "events").select((F.col("user_id") % 10).alias("tenant"), F.col("user_id").alias("key_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("audio_seconds"), (F.col("event_type") == "purchase").alias("matched"))


def usage_daily(spark, d):
    out = us.daily(usage_events(spark, d))
    return out.withColumns({"usage_day": F.col("usage_day").cast("string"), "audio_seconds": F.col("audio_seconds").cast("double")})


def tenant_total(spark, d):
    tenants = spark.range(12).select(F.col("id").alias("tenant"))
    total = us.daily(usage_events(spark, d)).groupBy("tenant").agg(F.sum("audio_seconds").alias("s"))
    return tenants.join(total, "tenant", "left").select("tenant", F.coalesce("s", F.lit(0)).cast("double").alias("audio_seconds"))


def quota(spark, d):
    return us.quota(usage_events(spark, d), 500.0).groupBy("tenant").agg(F.count(F.lit(1)).alias("requests"), F.sum(F.when(F.col("accepted"), 1).otherwise(0)).alias("accepted"))


def token_bucket(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "event_id")
    return us.token_bucket(e, rate=1 / 3600, burst=2.0).withColumn("tokens", F.round("tokens", 6))


def min_interval(spark, d):
    return us.minimum_interval(usage_events(spark, d), "key_id", 1800.0).groupBy("key_id").agg(F.sum("wait_micros").alias("wait_micros"))


def buckets(spark, d):
    return us.histogram(table(spark, d, "events"), "event_type", "value", [5.0, 25.0, 100.0])


def ordered_turns(spark, d):
    """Each conversation's changes of role, by the turn before."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("before", F.lag("role").over(w))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.when(F.col("before") != F.col("role"), 1).otherwise(0)).alias("changes"))


def first_seen(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders")
    return o.withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).where("r = 1").select("o_custkey", "o_orderkey")


def versions(spark, d):
    n = table(spark, d, "nation")
    cats = n.select(F.col("n_name").alias("catalog_id"))
    pins = n.where("n_nationkey % 6 = 0").select(F.col("n_name").alias("catalog_id"), F.lit("v1").alias("version"))
    db = n.where("n_nationkey % 4 = 0").select(F.col("n_name").alias("catalog_id"), F.lit("v2").alias("version"))
    stored = n.where("n_nationkey % 3 <> 1").select(F.col("n_name").alias("catalog_id"), F.explode(F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("v1"), F.lit("v2"))).otherwise(F.array(F.lit("v1")))).alias("version"))
    return ct.resolve_version(cats, pins, db, stored)


def tiling(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), F.floor(F.abs("s_acctbal") % 60).cast("double").alias("length"))
    return ct.tile(s).withColumn("place", F.col("place").cast("long"))


QUERIES = {
    "tiling__Q4": tiling,
    "duplicate_content__A30": duplicates, "content_hash__A31": content_hash, "pending_enrichment__J6": pending, "unmatched__J7_J8": unmatched, "coalesce_sidecar__J9": sidecar, "catalog_drift__J17": drift,
    "id_symmetric_difference__set": sym_diff, "cohort_union__set": cohort_union, "sha_overlap__set": sha_overlap, "overlap_intervals__J16_W9": overlaps, "screen_candidates__J10": screening, "upsert__A35_Z4": upserted,
    "violations__constraints": constraints, "enrichment_status__A22": enrichment, "json_normalise__scalar": json_normalise, "text_normalise__scalar": text_normalise, "license_predicates__P6_P7": licences, "catalog_access__P14": access,
    "pagination__limit": page_of, "usage_daily__A35_T4": usage_daily, "tenant_total__A36": tenant_total, "quota__T2": quota, "token_bucket__T1": token_bucket, "min_interval__T5": min_interval, "latency_buckets__T6": buckets,
    "ordered_turns__W5": ordered_turns, "first_seen__W11": first_seen, "resolve_version__S13": versions,
}

_U = "u AS (SELECT user_id % 10 AS tenant, user_id AS key_id, ts, event_id, value AS s, event_type = 'purchase' AS matched FROM events)"
ORACLE_SQL = {
    "tiling__Q4": """WITH RECURSIVE s AS (SELECT s_suppkey AS source_id, floor(abs(s_acctbal) % 60)::DOUBLE AS len FROM supplier), w AS (SELECT source_id, len, -1::BIGINT AS place, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS start, 0.0::DOUBLE AS duration FROM s WHERE len > 0
  UNION ALL SELECT source_id, len, place + 1, pos + d, pos, d FROM (SELECT *, CASE WHEN pos + want <= len THEN want WHEN pos + 3 <= len THEN 3.0 END::DOUBLE AS d FROM (SELECT source_id, len, place, pos, CASE (place + 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 5.0 ELSE 10.0 END AS want FROM w)) WHERE d IS NOT NULL)
  SELECT source_id, place, start, duration FROM w WHERE place >= 0""",
    "duplicate_content__A30": "SELECT sha256(text) AS sha, count(*) AS copies, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "content_hash__A31": "SELECT source, count(*) AS row_count, sum(('0x' || substr(sha256(doc_id::VARCHAR || chr(31) || sha256(text)), 1, 15))::BIGINT)::VARCHAR AS digest_sum FROM documents GROUP BY 1",
    "pending_enrichment__J6": "SELECT c.c_custkey, c.c_mktsegment, CASE WHEN m.k IS NULL THEN 'missing' ELSE 'stale' END AS why FROM customer c LEFT JOIN (SELECT o_custkey AS k, max(o_orderdate) AS f FROM orders GROUP BY 1) m ON m.k = c.c_custkey WHERE m.k IS NULL OR m.f < TIMESTAMP '2000-06-01'",
    "unmatched__J7_J8": "SELECT c_nationkey::BIGINT AS c_nationkey, count(*) AS customers FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000) GROUP BY 1",
    "coalesce_sidecar__J9": "SELECT p.p_partkey, coalesce(g.title, s.s_name) AS title FROM part p LEFT JOIN (SELECT p_name, max(p_brand) AS title FROM part GROUP BY 1) g ON p.p_size % 2 = 0 AND g.p_name = p.p_name LEFT JOIN supplier s ON s.s_suppkey = p.p_partkey",
    "catalog_drift__J17": """WITH a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1)
  SELECT CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS change, count(*) AS customers, sum(a.n)::BIGINT AS before, sum(b.n)::BIGINT AS after FROM a FULL JOIN b USING (o_custkey) GROUP BY 1""",
    "id_symmetric_difference__set": "WITH o AS (SELECT o_custkey + 7 AS id FROM orders WHERE o_totalprice > 300000) SELECT id, 'left' AS side FROM (SELECT c_custkey AS id FROM customer EXCEPT SELECT id FROM o) UNION ALL SELECT id, 'right' FROM (SELECT id FROM o EXCEPT SELECT c_custkey FROM customer)",
    "cohort_union__set": "SELECT cohort, count(*) AS n, min(id) AS low, max(id) AS high FROM (SELECT o_orderkey AS id, 'legacy' AS cohort FROM orders UNION ALL SELECT DISTINCT l_orderkey, 'expanded' FROM lineitem) GROUP BY 1",
    "sha_overlap__set": "SELECT sha, 'sources' AS \"with\" FROM (SELECT sha256(text) AS sha FROM documents WHERE source = 'src0' INTERSECT SELECT sha256(text) FROM documents WHERE source <> 'src0') UNION ALL SELECT sha, 'benchmark' FROM (SELECT sha256(text) AS sha FROM documents INTERSECT SELECT sha256(text) FROM benchmark)",
    "overlap_intervals__J16_W9": "SELECT user_id, event_id, next_start FROM (SELECT user_id, event_id, epoch_us(ts) AS start, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS next_start FROM events WHERE event_type = 'purchase') WHERE next_start < start + 3600000000",
    "screen_candidates__J10": """WITH c AS (SELECT doc_id, sha256(text) AS sha, substr(text, 1, 12) AS base, CASE WHEN n_chars < 200 THEN 'short' WHEN toxic IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'toxic' END AS why FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)),
  d AS (SELECT *, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY why, sha ORDER BY doc_id) > 1 THEN 'duplicate content' ELSE why END AS w2 FROM c)
  SELECT doc_id, CASE WHEN w2 IS NULL AND row_number() OVER (PARTITION BY w2, base ORDER BY doc_id) > 1 THEN 'duplicate base' ELSE coalesce(w2, 'kept') END AS why FROM d""",
    "upsert__A35_Z4": "WITH a AS (SELECT o_custkey AS k, count(*) AS n, max(o_orderkey) AS latest FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n, max(o_orderkey) AS latest FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) SELECT k, coalesce(a.n, 0) + coalesce(b.n, 0) AS n, coalesce(b.latest, a.latest) AS latest FROM a FULL JOIN b USING (k)",
    "violations__constraints": "SELECT 'price positive' AS rule, count(*) FILTER (NOT p_retailprice > 0) AS broken FROM part UNION ALL SELECT 'size to 40', count(*) FILTER (NOT p_size <= 40) FROM part UNION ALL SELECT 'name not red', count(*) FILTER (starts_with(p_name, 'red')) FROM part",
    "enrichment_status__A22": """WITH e AS (SELECT user_id, (props->>'k')::INT AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), g AS (SELECT user_id, max(k) FILTER (r = 1) AS a, max(k) FILTER (r = 2) AS b FROM e WHERE r <= 3 GROUP BY 1)
  SELECT user_id, CASE WHEN a IS NULL OR a < 80 THEN 'no_match' WHEN b IS NOT NULL AND a - b < 5 THEN 'ambiguous' ELSE 'matched' END AS status, a::BIGINT AS top FROM g""",
    "json_normalise__scalar": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS k_sum, min(k)::BIGINT AS low, max(k)::BIGINT AS high FROM (SELECT event_type, greatest(0, least(90, (props->>'k')::INT)) AS k FROM events) GROUP BY 1",
    "text_normalise__scalar": "SELECT trim(regexp_replace(lower(p_name || '--' || p_type), '[^a-z0-9]+', ' ', 'g')) AS name, count(*) AS n, min(regexp_replace(p_brand || '_' || p_size, '_[0-9]+$', '')) AS base FROM part GROUP BY 1",
    "license_predicates__P6_P7": """WITH p AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, lower(url) AS u, page_id % 7 AS m FROM pages)
  SELECT CASE m WHEN 0 THEN 'CC-BY' WHEN 1 THEN 'CC-BY-SA' WHEN 3 THEN 'CC0-1.0' WHEN 4 THEN 'PublicDomainMark-1.0' ELSE 'UNKNOWN' END AS name, m IN (0, 1, 3, 4) AND NOT regexp_matches(u, '-nd|-nc|/nc-|by-nc|by-nd|nc-sa|nc-nd') AS ok, count(*) AS pages, count(DISTINCT host) AS hosts FROM p GROUP BY 1, 2""",
    "catalog_access__P14": "SELECT c_custkey, count(*) AS readable FROM customer CROSS JOIN nation WHERE (c_nationkey < 5 OR n_nationkey IN (c_nationkey, (c_nationkey + 1) % 25)) GROUP BY 1",
    "pagination__limit": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100",
    "usage_daily__A35_T4": f"WITH {_U} SELECT tenant, key_id, strftime(ts, '%Y-%m-%d') AS usage_day, sum(round(s::DECIMAL(18,6), 3)::DECIMAL(14,3))::DOUBLE AS audio_seconds, count(*) AS request_count, count(*) FILTER (matched) AS match_count FROM u GROUP BY 1, 2, 3",
    "tenant_total__A36": f"WITH {_U} SELECT t.tenant, coalesce(sum(round(s::DECIMAL(18,6), 3)::DECIMAL(14,3)), 0)::DOUBLE AS audio_seconds FROM (SELECT unnest(range(12)) AS tenant) t LEFT JOIN u USING (tenant) GROUP BY 1",
    "quota__T2": f"WITH {_U}, r AS (SELECT *, coalesce(sum(s::DECIMAL(18,6)) OVER (PARTITION BY tenant, ts::DATE ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM u) SELECT tenant, count(*) AS requests, count(*) FILTER (used < 500) AS accepted FROM r GROUP BY 1",
    "token_bucket__T1": """WITH RECURSIVE e AS (SELECT user_id AS key_id, epoch_us(ts) / 1e6::DOUBLE AS ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  s AS (SELECT key_id, event_id, i, ts AS last, 2.0::DOUBLE AS had FROM e WHERE i = 1
    UNION ALL SELECT e.key_id, e.event_id, e.i, greatest(s.last, e.ts), least(2.0::DOUBLE, (CASE WHEN s.had >= 1 THEN s.had - 1 ELSE s.had END) + greatest(0.0, e.ts - s.last) * (1.0::DOUBLE / 3600)) FROM s JOIN e ON e.key_id = s.key_id AND e.i = s.i + 1)
  SELECT key_id, event_id, had >= 1 AS allowed, CASE WHEN had >= 1 THEN 0 ELSE ceil((1.0 - had) / (1.0::DOUBLE / 3600)) END::INT AS retry_after, round(CASE WHEN had >= 1 THEN had - 1 ELSE had END, 6) AS tokens FROM s""",
    "min_interval__T5": f"WITH {_U}, g AS (SELECT key_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY key_id ORDER BY ts, event_id) AS gap FROM u) SELECT key_id, sum(CASE WHEN gap IS NULL OR gap < 0 THEN 0 ELSE greatest(0, 1800000000 - gap) END)::BIGINT AS wait_micros FROM g GROUP BY 1",
    "latency_buckets__T6": "SELECT event_type, count(*) FILTER (value <= 5) AS le_5_0, count(*) FILTER (value <= 25) AS le_25_0, count(*) FILTER (value <= 100) AS le_100_0, count(*) AS le_inf FROM events GROUP BY 1",
    "ordered_turns__W5": "SELECT conv_id, count(*) AS turns, count(*) FILTER (before <> role) AS changes FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) GROUP BY 1",
    "first_seen__W11": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1",
    "resolve_version__S13": """WITH st AS (SELECT n_name AS c, unnest(CASE WHEN n_nationkey % 2 = 0 THEN ['v1', 'v2'] ELSE ['v1'] END) AS v FROM nation WHERE n_nationkey % 3 <> 1), n AS (SELECT n_name AS c, CASE WHEN n_nationkey % 6 = 0 THEN 'v1' END AS pin, CASE WHEN n_nationkey % 4 = 0 THEN 'v2' END AS db, (SELECT count(*) FROM st WHERE st.c = n_name) AS k, (SELECT min(v) FROM st WHERE st.c = n_name) AS sole FROM nation),
  r AS (SELECT *, coalesce(pin, db, CASE WHEN k = 1 THEN sole END) AS version FROM n)
  SELECT c AS catalog_id, version, CASE WHEN version IS NULL AND k > 1 THEN 'several versions' WHEN version IS NULL THEN 'no version' WHEN NOT EXISTS (SELECT 1 FROM st WHERE st.c = r.c AND st.v = r.version) THEN 'not stored' END AS problem FROM r""",
}
