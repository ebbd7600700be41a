"""Queries over stored cascade evidence; order lines stand for queries whose stages were recorded."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import replays as rp
from tidemark.session import table

GATE, STAGE2, MAX_FAR = 0.1, 0.5, 0.3
GRIDS = {"full": (-5.0, -4.0, -3.0, -2.0, -1.0, 1.0, 2.0, 3.0, 4.0, 5.0), "wide": (-4.0, -2.0, 2.0, 4.0), "coarse": (-5.0, -2.0, 2.0, 5.0), "narrow": (-2.0, -1.0, 1.0, 2.0)}


def stored(spark, d):
    li = table(spark, d, "lineitem")
    p, q = F.col("l_partkey"), F.col("l_quantity")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("query_id"), (F.col("l_returnflag") == "N").alias("is_negative"), (p % 10).alias("truth"), (F.col("l_suppkey") % 10).alias("stage1_top"), (F.col("l_tax") >= 0.07).alias("stage1_accept"),
        F.col("l_discount").alias("gate_value"), (q > 10).alias("probe_passed"), F.when(q > 12, F.when(p % 3 == 0, (p + 1) % 10).otherwise(p % 10)).alias("confirm_id"), (q % 9).cast("long").alias("confirm_aligned"), (q / 50).alias("confirm_evidence"),
        (p % 5 - 2).cast("double").alias("rate"), F.when(F.col("l_linestatus") != "O", F.col("l_linestatus")).alias("category"),
    )


def hypotheses(spark, d):
    """Eleven rates a line, with whole hundredths as evidence."""
    rows = stored(spark, d).withColumn("r", F.explode(F.sequence(F.lit(-5), F.lit(5))))
    r, k = F.col("r"), F.col("query_id")
    return rows.select("query_id", r.cast("double").alias("rate"), F.when(k % 7 != 0, (k + r * (k % 2)) % 10).alias("id"), (k % 13).alias("aligned"), (F.pmod(k * 3 - F.abs(r - k % 4) * 9, F.lit(101)) / 100.0).alias("evidence"), F.when((k + r) % 17 == 0, "failed").alias("error"))


def confusion(spark, d):
    return rp.confusion(stored(spark, d), rp.verdict(GATE, STAGE2))


def far_by_category(spark, d):
    rows = stored(spark, d).withColumn("category", F.coalesce("category", F.lit("-")))
    return rp.confusion(rows, rp.verdict(GATE, STAGE2), "category").select("category", "negatives", "fp", "far")


def stage2_pick(spark, d):
    return rp.pick_stage2(stored(spark, d), MAX_FAR)


def gate_pick(spark, d):
    return rp.pick_gate(stored(spark, d), STAGE2)


def behaviour(spark, d):
    return rp.behaviour(stored(spark, d), GATE, STAGE2)


def winning_rates(spark, d):
    return rp.winning_rates(stored(spark, d), GATE, STAGE2)


def grid_study(spark, d):
    return rp.grid_study(stored(spark, d), hypotheses(spark, d), GRIDS, STAGE2)


def unimodal(spark, d):
    return rp.unimodal(hypotheses(spark, d))


def resolution(spark, d):
    n = stored(spark, d).groupBy("category").agg(F.sum(F.col("is_negative").cast("int")).alias("negatives"))
    return n.select("category", "negatives", rp.resolution(F.col("negatives")).alias("r")).select("category", "negatives", "r.*")


def replay_at(spark, d):
    """Verdicts of the cascade without gate at a stage-2 threshold, by stage."""
    v = stored(spark, d).select(rp.verdict(0.0, STAGE2).alias("v"))
    return v.groupBy(F.col("v.stage").alias("stage"), F.col("v.accepted").alias("accepted")).agg(F.count(F.lit(1)).alias("n"), F.sum("v.id").alias("ids"))


QUERIES = {
    "cascade_confusion__A18": confusion, "stage2_pick__A19": stage2_pick, "gate_pick__A20": gate_pick, "cascade_behaviour__A21": behaviour, "winning_rates__A21": winning_rates, "grid_study__A23": grid_study, "unimodal_profiles__A24": unimodal,
    "far_by_category__A25": far_by_category, "resolution__A26": resolution, "replay_stage2__Z12": replay_at,
}

_S = f"""s AS (SELECT l_orderkey * 10 + l_linenumber AS query_id, l_returnflag = 'N' AS neg, l_partkey % 10 AS truth, l_suppkey % 10 AS top1, l_tax >= 0.07 AS once, l_discount AS g, l_quantity > 10 AS probe,
  CASE WHEN l_quantity > 12 THEN CASE WHEN l_partkey % 3 = 0 THEN (l_partkey + 1) % 10 ELSE l_partkey % 10 END END AS cid, (l_quantity % 9)::BIGINT AS al, l_quantity / 50 AS ev, (l_partkey % 5 - 2)::DOUBLE AS rate, CASE WHEN l_linestatus <> 'O' THEN l_linestatus END AS category FROM lineitem),
v AS (SELECT *, NOT once AND g >= {GATE} AND probe AND cid IS NOT NULL AND ev >= {STAGE2} AND al >= 5 AS ok2, NOT once AND probe AND cid IS NOT NULL AND al >= 5 AS able FROM s)"""
_CONF = "count(*) FILTER (NOT neg) AS positives, count(*) FILTER (neg) AS negatives, count(*) FILTER (NOT neg AND (once AND top1 = truth OR ok2 AND cid = truth)) AS tp, count(*) FILTER (NOT neg AND (once AND top1 <> truth OR ok2 AND cid <> truth)) AS wrong, count(*) FILTER (neg AND (once OR ok2)) AS fp"
_BASE = "b AS (SELECT count(*) FILTER (NOT neg) AS p, count(*) FILTER (neg) AS n, count(*) FILTER (once AND NOT neg AND top1 = truth) AS tp1, count(*) FILTER (once AND neg) AS fp1, count(*) AS a FROM s)"
_HYP = """h AS (SELECT query_id, r::DOUBLE AS rate, CASE WHEN query_id % 7 <> 0 THEN (query_id + r * (query_id % 2)) % 10 END AS id, query_id % 13 AS al, ((((query_id * 3 - abs(r - query_id % 4) * 9) % 101) + 101) % 101) / 100.0 AS ev, (query_id + r) % 17 = 0 AS bad FROM s CROSS JOIN (SELECT unnest(range(-5, 6)) AS r))"""
ORACLE_SQL = {
    "cascade_confusion__A18": f"WITH {_S}, c AS (SELECT {_CONF} FROM v) SELECT *, positives - tp - wrong AS fn, negatives - fp AS tn, tp::DOUBLE / positives AS recall, fp::DOUBLE / negatives AS far, tp::DOUBLE / (tp + wrong + fp) AS precision, (negatives - fp)::DOUBLE / negatives AS correct_rejection FROM c",
    "far_by_category__A25": f"WITH {_S}, c AS (SELECT coalesce(category, '-') AS category, {_CONF} FROM v GROUP BY 1) SELECT category, negatives, fp, fp::DOUBLE / nullif(negatives, 0) AS far FROM c",
    "stage2_pick__A19": f"""WITH {_S}, {_BASE}, t AS (SELECT DISTINCT ev AS t FROM s WHERE ev > 0), x AS (SELECT t, (any_value(tp1) + count(*) FILTER (able AND NOT neg AND cid = truth AND ev >= t))::DOUBLE / any_value(p) AS recall, (any_value(fp1) + count(*) FILTER (able AND neg AND ev >= t))::DOUBLE / any_value(n) AS far FROM t CROSS JOIN v CROSS JOIN b GROUP BY t)
  SELECT coalesce((SELECT t FROM x WHERE far <= {MAX_FAR} ORDER BY recall DESC, t LIMIT 1), 1.0)::DOUBLE AS threshold""",
    "gate_pick__A20": f"""WITH {_S}, {_BASE}, t AS (SELECT DISTINCT round(g, 6) AS t FROM s WHERE NOT once UNION SELECT 0.0), x AS (SELECT t, (any_value(tp1) + count(*) FILTER (able AND ev >= {STAGE2} AND NOT neg AND cid = truth AND g >= t))::DOUBLE / any_value(p) AS recall, count(*) FILTER (NOT once AND g >= t)::DOUBLE / any_value(a) AS escalation FROM t CROSS JOIN v CROSS JOIN b GROUP BY t)
  SELECT t AS gate, recall, escalation FROM x WHERE recall >= (SELECT recall FROM x WHERE t = 0) - 0.01 ORDER BY escalation, t DESC LIMIT 1""",
    "cascade_behaviour__A21": f"""WITH {_S} SELECT count(*) FILTER (once)::DOUBLE / count(*) AS stage1_match_rate, count(*) FILTER (NOT once AND g >= {GATE})::DOUBLE / count(*) AS escalation_rate, count(*) FILTER (NOT once AND g >= {GATE} AND probe)::DOUBLE / count(*) AS probe_pass_rate, count(*) FILTER (ok2) AS stage2_acceptances,
  count(*) FILTER (neg AND NOT once AND NOT g >= {GATE})::DOUBLE / greatest(1, count(*) FILTER (neg)) AS gate_skipped_negatives FROM v""",
    "winning_rates__A21": f"WITH {_S} SELECT rate, count(*) AS n FROM v WHERE ok2 GROUP BY 1",
    "grid_study__A23": f"""WITH {_S}, {_BASE}, {_HYP}, g AS (SELECT 'full' AS grid, 10 AS rates, unnest(range(-5, 6)) AS r UNION ALL SELECT 'wide', 4, unnest([-4, -2, 0, 2, 4]) UNION ALL SELECT 'coarse', 4, unnest([-5, -2, 0, 2, 5]) UNION ALL SELECT 'narrow', 4, unnest([-2, -1, 0, 1, 2])),
  x AS (SELECT grid, h.* FROM h JOIN g ON g.r = h.rate WHERE NOT bad AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY grid, query_id ORDER BY ev DESC, abs(rate), rate) = 1),
  y AS (SELECT grid, count(*) AS won FROM x JOIN s USING (query_id) WHERE NOT once AND NOT neg AND x.ev >= {STAGE2} AND x.al >= 5 AND id = truth GROUP BY 1)
  SELECT grid, rates::BIGINT AS rates, (SELECT tp1 FROM b) + coalesce(won, 0) AS tp, ((SELECT tp1 FROM b) + coalesce(won, 0))::DOUBLE / (SELECT p FROM b) AS recall FROM (SELECT DISTINCT grid, rates FROM g) LEFT JOIN y USING (grid)""",
    "unimodal_profiles__A24": f"""WITH {_S}, {_HYP}, l AS (SELECT query_id, list(ev ORDER BY rate) AS e FROM h WHERE NOT bad GROUP BY 1), k AS (SELECT e, list_position(e, list_max(e)) AS p FROM l WHERE list_max(e) > 0),
  u AS (SELECT list_bool_and([e[i] <= e[i + 1] + 1e-12 FOR i IN range(1, p)]) IS DISTINCT FROM FALSE AND list_bool_and([e[i] >= e[i + 1] - 1e-12 FOR i IN range(p, len(e))]) IS DISTINCT FROM FALSE AS ok FROM k)
  SELECT count(*) AS profiles, count(*) FILTER (ok) AS unimodal, count(*) FILTER (ok)::DOUBLE / count(*) AS fraction FROM u""",
    "resolution__A26": f"WITH {_S} SELECT category, count(*) FILTER (neg) AS negatives, 1.0::DOUBLE / nullif(count(*) FILTER (neg), 0) AS one, 100.0::DOUBLE / nullif(count(*) FILTER (neg), 0) AS percent, 3.0::DOUBLE / nullif(count(*) FILTER (neg), 0) AS rule_of_three FROM s GROUP BY 1",
    "replay_stage2__Z12": f"WITH {_S}, r AS (SELECT CASE WHEN once THEN 1 WHEN able AND ev >= {STAGE2} THEN 2 END AS stage, once OR (able AND ev >= {STAGE2}) AS accepted, CASE WHEN once THEN top1 WHEN able AND ev >= {STAGE2} THEN cid END AS id FROM v) SELECT stage::BIGINT AS stage, accepted, count(*) AS n, sum(id)::BIGINT AS ids FROM r GROUP BY 1, 2",
}
