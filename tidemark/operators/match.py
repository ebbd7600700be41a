"""Probing the index and finding the densest agreement of time offsets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import MatchConfig
from tidemark.session import fits, small, stored


def query_landmarks(landmarks: DataFrame) -> DataFrame:
    """Adds qidx, the place of each landmark in its query's (anchor, hash) order."""
    w = Window.partitionBy("query_id").orderBy("anchor_frame", "hash")
    return landmarks.withColumn("qidx", F.row_number().over(w))


#: Bytes of query landmarks for an estimated byte of the queries' plan, at most.
LANDMARK_FACTOR = 64


def probe(queries: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(query_id, track_id, qidx, frame, q_frame, offset) of every query landmark with every posting of its hash."""
    q = small(queries.select("query_id", "qidx", "hash", F.col("anchor_frame").alias("q_frame")), LANDMARK_FACTOR)
    hits = landmarks.join(q, "hash").select("query_id", "track_id", "qidx", F.col("anchor_frame").alias("frame"), "q_frame")
    return hits.withColumn("offset", F.col("frame") - F.col("q_frame"))


def alignments(hits: DataFrame, cfg: MatchConfig = MatchConfig(), by: tuple[str, ...] = ("query_id",), second: bool = False, dealt: bool = False) -> DataFrame:
    """For each query (by) and track_id: score, best_offset, best_offset_count, lo, hi, total_hits, matched_query_landmarks.

    The window [v - tolerance, v] with most distinct query landmarks, then most hits, then least v;
    only offsets that occur need to be tried as its end, since one that doesn't sees no more than the
    last one below it. best_offset is the window's most frequent offset (the least of several).
    With `second` also second_best_score and second_best_offset, of the densest window among the hits
    outside [lo - tolerance, hi + tolerance]; null where there are none.
    Hits move once, to their query and track (not at all if they are `dealt` so already, or by track); the rest
    happens there: hits of equal offset become one row with the query landmarks it saw, and a frame of
    the tolerance's width looks back over them. The second window's frames look back over the outer rows only.
    """
    keys = [*by, "track_id"]
    t = cfg.validate().tolerance
    distinct = lambda lists: F.size(F.array_distinct(F.flatten(lists))).cast("long")

    def end(*among: str):
        frame = Window.partitionBy(*keys, *among).orderBy("offset").rangeBetween(-t, 0)
        modal = F.max(F.struct("n", (-F.col("offset")).alias("o"))).over(frame)["o"]
        return F.struct(distinct(F.collect_list("seen").over(frame)).alias("d"), F.sum("n").over(frame).alias("h"), (-F.col("offset")).alias("v"), F.min("offset").over(frame).alias("lo"), modal.alias("o"))

    per = (hits if dealt else hits.select(*keys, "qidx", "offset").repartition(*keys)).groupBy(*keys, "offset").agg(F.count(F.lit(1)).alias("n"), F.collect_set("qidx").alias("seen"))
    ends = per.select(*keys, "offset", "n", "seen", end().alias("end"))
    made = [F.max("end").alias("b"), F.sum("n").alias("total_hits"), distinct(F.collect_list("seen")).alias("matched_query_landmarks")]
    out = [F.col("b.d").alias("score"), F.col("b.h").alias("best_offset_count"), (-F.col("b.o")).alias("best_offset"), F.col("b.lo").alias("lo"), (-F.col("b.v")).alias("hi"), "total_hits", "matched_query_landmarks"]
    if second:
        first = F.max("end").over(Window.partitionBy(*keys))
        ends = ends.withColumn("first", first).withColumn("outer", (F.col("offset") < F.col("first.lo") - t) | (F.col("offset") > t - F.col("first.v")))
        ends = ends.withColumn("again", F.when(F.col("outer"), end("outer")))
        made.append(F.max("again").alias("c"))
        out += [F.col("c.d").alias("second_best_score"), (-F.col("c.o")).alias("second_best_offset")]
    return ends.groupBy(*keys).agg(*made).select(*keys, *out)


def densest(hits: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """For each (query_id, track_id): score, best_offset, best_offset_count, lo, hi."""
    return alignments(hits, cfg).drop("total_hits", "matched_query_landmarks")


def totals(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id", "track_id").agg(F.count(F.lit(1)).alias("total_hits"), F.countDistinct("qidx").alias("matched_query_landmarks"))


def query_totals(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_hits"), F.countDistinct("qidx").alias("matched_query_landmarks"))


def second_best(hits: DataFrame, cfg: MatchConfig = MatchConfig(), dealt: bool = False) -> DataFrame:
    """Both densest windows of each (query_id, track_id), in one pass over the hits."""
    return alignments(hits, cfg, second=True, dealt=dealt).drop("total_hits", "matched_query_landmarks")


def rank(hits: DataFrame, cfg: MatchConfig = MatchConfig(), by: tuple[str, ...] = ("query_id",), dealt: bool = False) -> DataFrame:
    """The candidates of each query by (-score, -hits, -matched, track_id), at most max_candidates."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("best_offset_count"), F.desc("matched_query_landmarks"), "track_id")
    return alignments(hits, cfg, by, dealt=dealt).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.max_candidates)


#: Offsets in a coarse bucket; a window must fit into half of one.
COARSE = 64


def _bounds(hits: DataFrame, cfg: MatchConfig, by: tuple[str, ...], dealt: bool) -> DataFrame:
    """(by, track_id, bound, most, total_hits, held) of each pair that has hits, made where its hits lie; held: its hits."""
    keys = [*by, "track_id"]
    width = max(COARSE, 4 * (cfg.validate().tolerance + 1))
    cells = F.array(*(F.struct(F.lit(i).alias("series"), F.floor((F.col("offset") + i * width // 2) / width).alias("cell")) for i in range(2)))
    rows = hits.select(*keys, "qidx", "offset")
    rows = (rows if dealt else rows.repartition(*keys)).withColumn("c", F.explode(cells))
    first = F.col("c.series") == 0
    each = rows.groupBy(*keys, "c").agg(F.size(F.collect_set("qidx")).cast("long").alias("d"), F.count(F.lit(1)).alias("n"), F.collect_list(F.when(first, F.struct("qidx", "offset"))).alias("held"))
    return each.groupBy(*keys).agg(F.max("d").alias("bound"), F.max("n").alias("most"), F.sum(F.when(first, F.col("n")).otherwise(0)).alias("total_hits"), F.flatten(F.collect_list("held")).alias("held"))


def _open(hits: DataFrame, cfg: MatchConfig, by: tuple[str, ...], dealt: bool) -> tuple[DataFrame, bool]:
    """Rows of _bounds with `open`, and whether they still lie where their hits lay.

    Only the k pairs of largest bounds move with their hits, and the floors: at most k rows of a query leave a task.
    """
    keys = [*by, "track_id"]
    bounds = _bounds(hits, cfg, by, dealt)
    order = Window.partitionBy(*by).orderBy(F.desc("bound"), F.desc("most"), F.desc("total_hits"), "track_id")
    first = bounds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= cfg.max_candidates)
    last = rank(first.select(*keys, F.explode("held").alias("h")).select(*keys, "h.qidx", "h.offset"), cfg, by).where(F.col("rank") == cfg.max_candidates)
    floors = stored(last.select(*by, F.struct("score", "best_offset_count", "matched_query_landmarks").alias("floor"), F.col("track_id").alias("floor_track")), "floors")
    few = fits(floors)
    top = F.struct(F.col("bound").alias("score"), F.col("most").alias("best_offset_count"), F.col("total_hits").alias("matched_query_landmarks"))
    may = F.col("floor").isNull() | (top > F.col("floor")) | ((top == F.col("floor")) & (F.col("track_id") <= F.col("floor_track")))
    return bounds.join(F.broadcast(floors) if few else floors, list(by), "left").select(*keys, "bound", "most", "total_hits", "held", may.alias("open")), few


def open_pairs(hits: DataFrame, cfg: MatchConfig = MatchConfig(), by: tuple[str, ...] = ("query_id",), dealt: bool = False) -> DataFrame:
    """(by, track_id, bound, most, total_hits, open) of each pair that has hits; open: it may still be among its query's first k.

    Two series of coarse buckets of offsets overlap by half, so each window lies in one bucket, and the largest
    bucket bounds a pair's score (distinct query landmarks) and its window's hits; all hits bound what it
    matched. The k pairs of largest bounds are ranked exactly; the last of them is a floor, and a pair
    whose bounds stand behind it in the ranking's own order can't be among the first k. A query of
    fewer pairs has no floor. Hits are read twice: what isn't `dealt` (by track) should be a stored table.
    """
    return _open(hits, cfg, by, dealt)[0].drop("held")


def bounded_rank(hits: DataFrame, cfg: MatchConfig = MatchConfig(), by: tuple[str, ...] = ("query_id",), dealt: bool = False) -> DataFrame:
    """What rank gives, with windows built only for pairs whose bound reaches the query's k-th score.

    Hits that are `dealt` by track are found twice and stay where they are; others are stored once.
    """
    keys = [*by, "track_id"]
    pairs, stay = _open(hits if dealt else stored(hits.select(*keys, "qidx", "offset"), "hits"), cfg, by, dealt)
    some = pairs.where("open").select(*keys, F.explode("held").alias("h")).select(*keys, "h.qidx", "h.offset")
    return rank(some, cfg, by, stay)


#: A hash is hot if it has more than this share of a shuffle partition's fair part, and HOT_ROWS rows at least.
HOT_SHARE = 0.25
HOT_ROWS = 1 << 16


#: Groups that hashes are counted by, before any hash is counted alone.
HASH_GROUPS = 1 << 14


def hot_hashes(rows: DataFrame, least: int = HOT_ROWS) -> tuple[DataFrame, int]:
    """(hash, n) of hashes with more rows than the bound, and the bound: so at most 1 / HOT_SHARE of them for each shuffle partition.

    Groups of hashes are counted first, a bounded number from each task; only hashes of a group that has more rows
    than the bound can be hot, so only those are counted one by one.
    """
    group = F.pmod(F.xxhash64("hash"), F.lit(HASH_GROUPS)).cast("int").alias("group")
    counts = stored(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")), "group-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bound = max(least, math.ceil(HOT_SHARE * total / int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    wide = [r[0] for r in counts.where(F.col("n") > bound).select("group").collect()]  # HASH_GROUPS rows at most
    some = rows.where(group.isin(wide)) if len(wide) < HASH_GROUPS else rows
    found = some.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bound)
    return stored(found if wide else found.limit(0), "hot-hashes"), bound


def split_sides(queries: DataFrame, landmarks: DataFrame, least: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Postings and query landmarks with cells (salt, q_salt): a hot hash becomes a grid, any other hash one cell.

    A hash's postings are dealt to as many rows of the grid as they exceed the bound, by track and frame, since
    one track may hold most of them; its query landmarks likewise to columns. Each posting meets each query
    landmark of its hash in one cell.
    """
    (p, p_bound), (q, q_bound) = hot_hashes(landmarks, least), hot_hashes(queries, least)
    side = lambda rows, bound, name: rows.select("hash", F.ceil(F.col("n") / bound).cast("int").alias(name))
    hot = stored(side(p, p_bound, "p").join(side(q, q_bound, "q"), "hash", "full").select("hash", F.coalesce("p", F.lit(1)).alias("p"), F.coalesce("q", F.lit(1)).alias("q")), "hot")

    def dealt(rows: DataFrame, own: str, own_salt: str, other: str, other_salt: str, *by: str) -> DataFrame:
        marked = rows.join(small(hot), "hash", "left").fillna(1, ["p", "q"])
        cells = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return marked.withColumn(own_salt, F.pmod(F.xxhash64(*by), F.col(own)).cast("int")).withColumn(other_salt, cells).drop("p", "q")

    return dealt(landmarks, "p", "salt", "q", "q_salt", "track_id", "anchor_frame"), dealt(queries, "q", "q_salt", "p", "salt", "query_id", "qidx")


def probe_split(queries: DataFrame, landmarks: DataFrame, least: int = HOT_ROWS) -> DataFrame:
    """What probe gives when the queries are too many to broadcast: no hash is one task, on either side.

    Postings whose hash isn't asked for stay where they are, if the different asked hashes can be broadcast; the others
    are stored, so that landmarks are made once and not for each count of hot hashes too.
    """
    asked = stored(queries.where("hash IS NOT NULL").select("hash").distinct(), "asked-hashes")
    if fits(asked):
        landmarks = stored(landmarks.select("hash", "track_id", "anchor_frame").join(F.broadcast(asked), "hash", "left_semi"), "asked-postings")
    a, b = split_sides(queries.select("query_id", "qidx", "hash", F.col("anchor_frame").alias("q_frame")), landmarks, least)
    found = a.join(b.hint("shuffle_merge"), ["hash", "salt", "q_salt"]).select("query_id", "track_id", "qidx", F.col("anchor_frame").alias("frame"), "q_frame")
    return found.withColumn("offset", F.col("frame") - F.col("q_frame"))
