"""Cascades replayed from stored evidence: verdicts, threshold and gate choice, behaviour, rate grids.

A stored row: stage1_accept, stage1_top, gate_value, probe_passed, confirm_id, confirm_aligned,
confirm_evidence, truth, is_negative (and split, rate, category where they are asked for).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.decide import accepted
from tidemark.operators.evaluate import n_if, share
from tidemark.session import running

MIN_ALIGNED = 5
#: What recall the gate may cost.
GATE_TOLERANCE = 0.01


def verdict(gate, stage2) -> Column:
    """(accepted, id, stage) of a stored row at a gate and a stage-2 threshold, without matching again."""
    able = F.col("probe_passed") & F.col("confirm_id").isNotNull() & (F.col("gate_value") >= gate)
    ok = able & accepted(F.col("confirm_evidence"), F.col("confirm_aligned"), stage2, MIN_ALIGNED)
    once = F.col("stage1_accept")
    return F.struct((once | ok).alias("accepted"), F.when(once, F.col("stage1_top")).when(ok, F.col("confirm_id")).alias("id"), F.when(once, 1).when(ok, 2).cast("long").alias("stage"))


def confusion(rows: DataFrame, verdict: Column, *by: str) -> DataFrame:
    """Counts and rates of verdicts (accepted, id): a wrong accept is one of a positive with another id."""
    v = rows.withColumn("_v", verdict)
    ok, pos = F.col("_v.accepted"), ~F.col("is_negative")
    right = F.coalesce(F.col("_v.id") == F.col("truth"), F.lit(False))
    out = v.groupBy(*by).agg(n_if(pos).alias("positives"), n_if(~pos).alias("negatives"), n_if(pos & ok & right).alias("tp"), n_if(pos & ok & ~right).alias("wrong"), n_if(~pos & ok).alias("fp"))
    c = F.col
    return out.withColumns({
        "fn": c("positives") - c("tp") - c("wrong"), "tn": c("negatives") - c("fp"), "recall": share(c("tp"), c("positives")), "far": share(c("fp"), c("negatives")),
        "precision": share(c("tp"), c("tp") + c("wrong") + c("fp")), "correct_rejection": share(c("negatives") - c("fp"), c("negatives")),
    })


def _swept(rows: DataFrame, points: DataFrame, value: str, able: Column, right: Column) -> DataFrame:
    """At each point (p): stage-1 accepts and those of the able rows whose value is at least p, as tp and fp, and open rows so far."""
    pos, once = ~F.col("is_negative"), F.col("stage1_accept")
    marks = rows.select(F.col(value).alias("p"), F.lit(0).alias("is_point"), (~once & able & pos & right).cast("int").alias("tp"), (~once & able & ~pos).cast("int").alias("fp"), (~once).cast("int").alias("open"))
    marks = marks.unionByName(points.select("p", F.lit(1).alias("is_point")), allowMissingColumns=True).fillna(0)
    # equal rows are one; points come after the rows of their value
    marks = marks.groupBy("p", "is_point").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "open")))
    sums = running(marks, [F.desc("p"), F.asc("is_point")], {"s_tp": F.col("tp"), "s_fp": F.col("fp"), "s_open": F.col("open")}).where("is_point = 1")
    first = rows.agg(n_if(pos).alias("positives"), n_if(~pos).alias("negatives"), n_if(once & pos & F.coalesce(F.col("stage1_top") == F.col("truth"), F.lit(False))).alias("tp1"), n_if(once & ~pos).alias("fp1"), F.count(F.lit(1)).alias("n"))
    both = sums.select("p", "s_tp", "s_fp", "s_open").crossJoin(F.broadcast(first))
    return both.select("p", share(F.col("tp1") + F.col("s_tp"), F.col("positives")).alias("recall"), share(F.col("fp1") + F.col("s_fp"), F.col("negatives")).alias("far"), share(F.col("s_open"), F.col("n")).alias("escalation"))


def _able() -> Column:
    return F.col("probe_passed") & F.col("confirm_id").isNotNull() & (F.col("confirm_aligned") >= MIN_ALIGNED)


def _right() -> Column:
    return F.coalesce(F.col("confirm_id") == F.col("truth"), F.lit(False))


def stage2_sweep(rows: DataFrame) -> DataFrame:
    """(p, recall, far) of the whole cascade, gate open, at each positive confirmed evidence as stage-2 threshold: one running sum."""
    points = rows.where("confirm_evidence > 0").select(F.col("confirm_evidence").alias("p")).distinct()
    return _swept(rows, points, "confirm_evidence", _able(), _right()).drop("escalation")


def pick_stage2(rows: DataFrame, max_far: float) -> DataFrame:
    """The stage-2 threshold of most recall whose end-to-end far is within the limit (the least of several); 1 if there is none."""
    ok = stage2_sweep(rows).where(F.col("far") <= max_far).orderBy(F.desc("recall"), "p").limit(1).select(F.col("p").alias("threshold"))
    spark = rows.sparkSession
    return ok.unionByName(spark.createDataFrame([(1.0,)], "threshold double")).agg(F.min("threshold").alias("threshold"))


def gate_sweep(rows: DataFrame, stage2: float) -> DataFrame:
    """(p, recall, far, escalation) at 0 and each open row's gate value (to 6 places) as gate."""
    spark = rows.sparkSession
    points = rows.where(~F.col("stage1_accept")).select(F.round("gate_value", 6).alias("p")).unionByName(spark.createDataFrame([(0.0,)], "p double")).distinct()
    return _swept(rows, points, "gate_value", _able() & (F.col("confirm_evidence") >= stage2), _right())


def pick_gate(rows: DataFrame, stage2: float, tolerance: float = GATE_TOLERANCE) -> DataFrame:
    """The gate of least escalation whose recall is within the tolerance of the open gate's (the greatest of several); 0 if there is none."""
    swept = gate_sweep(rows, stage2)
    base = swept.where("p = 0").select(F.coalesce("recall", F.lit(0.0)).alias("open_recall"))
    ok = swept.crossJoin(F.broadcast(base)).where(F.coalesce("recall", F.lit(0.0)) >= F.col("open_recall") - tolerance)
    return ok.orderBy("escalation", F.desc("p")).limit(1).select(F.col("p").alias("gate"), "recall", "escalation")


def behaviour(rows: DataFrame, gate, stage2) -> DataFrame:
    """Rates of stage-1 matches, gate passes and probe passes, stage-2 acceptances, and negatives that the gate saved."""
    v = rows.withColumn("_s", verdict(gate, stage2)["stage"])
    once, passed = F.col("stage1_accept"), ~F.col("stage1_accept") & (F.col("gate_value") >= gate)
    n = F.count(F.lit(1))
    return v.agg(
        share(n_if(once), n).alias("stage1_match_rate"), share(n_if(passed), n).alias("escalation_rate"), share(n_if(passed & F.col("probe_passed")), n).alias("probe_pass_rate"),
        n_if(F.col("_s") == 2).alias("stage2_acceptances"), share(n_if(F.col("is_negative") & ~once & ~passed), F.greatest(F.lit(1), n_if(F.col("is_negative")))).alias("gate_skipped_negatives"),
    )


def winning_rates(rows: DataFrame, gate, stage2) -> DataFrame:
    """How many queries each rate won at stage 2."""
    return rows.where(verdict(gate, stage2)["stage"] == 2).groupBy("rate").agg(F.count(F.lit(1)).alias("n"))


def grid_study(rows: DataFrame, hypotheses: DataFrame, grids: dict[str, tuple[float, ...]], stage2: float) -> DataFrame:
    """(grid, rates, tp, recall): stage 1 or the best hypothesis of a subset of the rates (0 always among them).

    hypotheses: (query_id, rate, id, aligned, evidence, error); rows: (query_id, stage1_accept, stage1_top, truth, is_negative).
    Only a hypothesis whose evidence reaches stage2 can be a grid's best and accepted, and only an open query can win:
    the others go before anything is grouped. Hypotheses move once, to their query, where each grid takes its best.
    """
    spark = rows.sparkSession
    names = spark.createDataFrame([(n, float(r), len(g)) for n, g in grids.items() for r in {*g, 0.0}], "grid string, rate double, rates long")
    open_ = rows.where(~F.col("stage1_accept") & ~F.col("is_negative")).select("query_id", "truth")
    usable = hypotheses.where("error IS NULL AND id IS NOT NULL").where(F.col("evidence") >= stage2).join(F.broadcast(names.select("rate").distinct()), "rate", "left_semi")
    asked = usable.select("query_id", "rate", "id", "aligned", "evidence").repartition("query_id").join(open_, "query_id", "left_semi")
    best = asked.join(F.broadcast(names), "rate").groupBy("grid", "query_id").agg(F.max_by(F.struct("id", "aligned", "evidence"), F.struct("evidence", (-F.abs("rate")).alias("a"), (-F.col("rate")).alias("r"))).alias("b"))
    won = open_.join(best, "query_id").where(accepted(F.col("b.evidence"), F.col("b.aligned"), stage2, MIN_ALIGNED) & (F.col("b.id") == F.col("truth"))).groupBy("grid").agg(F.count(F.lit(1)).alias("won"))
    first = rows.agg(n_if(~F.col("is_negative")).alias("positives"), n_if(F.col("stage1_accept") & ~F.col("is_negative") & (F.col("stage1_top") == F.col("truth"))).alias("tp1"))
    out = names.select("grid", "rates").distinct().join(won, "grid", "left").crossJoin(F.broadcast(first))
    tp = F.col("tp1") + F.coalesce("won", F.lit(0))
    return out.select("grid", "rates", tp.alias("tp"), share(tp, F.col("positives")).alias("recall"))


def unimodal(hypotheses: DataFrame) -> DataFrame:
    """(profiles, unimodal, fraction): queries whose evidence by rate rises to its greatest value (the first of several) and falls after it.

    Profiles without any evidence don't count.
    """
    rows = hypotheses.where("error IS NULL")
    w = Window.partitionBy("query_id").orderBy("rate")
    all_ = Window.partitionBy("query_id")
    rows = rows.withColumns({"before": F.lag("evidence").over(w), "top": F.max("evidence").over(all_)})
    rows = rows.withColumn("peak", F.min(F.when(F.col("evidence") == F.col("top"), F.col("rate"))).over(all_))
    fits = F.when(F.col("before").isNull(), True).when(F.col("rate") <= F.col("peak"), F.col("before") <= F.col("evidence") + 1e-12).otherwise(F.col("before") >= F.col("evidence") - 1e-12)
    per = rows.where("top > 0").groupBy("query_id").agg(F.bool_and(fits).alias("fits"))
    return per.agg(F.count(F.lit(1)).alias("profiles"), n_if(F.col("fits")).alias("unimodal")).withColumn("fraction", share(F.col("unimodal"), F.col("profiles")))


def resolution(negatives: Column) -> Column:
    """(one, percent, rule_of_three): what one false accept weighs among n negatives, and the bound that none observed gives."""
    n = F.nullif(negatives.cast("double"), F.lit(0.0))
    return F.struct((1 / n).alias("one"), (100 / n).alias("percent"), (3 / n).alias("rule_of_three"))
