"""Catalog relations: duplicates, drift, manifests, upserts, screening, enrichment, access and constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.evaluate import n_if


def duplicate_content(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """Digests that several rows share: their count, least and greatest key. Counts and bounds combine on the map side."""
    return rows.groupBy(digest).agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_id"), F.max(key).alias("last_id")).where("copies > 1")


def pending(tracks: DataFrame, metadata: DataFrame, key: str, stale_before: Column | None = None, at: str = "fetched_at") -> DataFrame:
    """Tracks without metadata, or with metadata fetched before the given time; `why` tells."""
    m = metadata.select(F.col(key).alias("_k"), F.col(at).alias("_at"))
    stale = F.lit(False) if stale_before is None else F.coalesce(F.col("_at") < stale_before, F.lit(False))
    rows = tracks.join(m, F.col(key) == F.col("_k"), "left")
    return rows.where(F.col("_k").isNull() | stale).withColumn("why", F.when(F.col("_k").isNull(), "missing").otherwise("stale")).drop("_k", "_at")


def drift(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison by key: added, removed, changed or same (nulls compare equal)."""
    a, b = before.select(key, F.col(value).alias("before"), F.lit(1).alias("_a")), after.select(key, F.col(value).alias("after"), F.lit(1).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, "before", "after", kind.alias("change"))


def coalescing_lookup(rows: DataFrame, by_digest: DataFrame, by_id: DataFrame, digest: str, key: str, value: str) -> DataFrame:
    """Adds value: the digest's entry first, then the id's."""
    d = by_digest.select(F.col(digest).alias("_d"), F.col(value).alias("_dv"))
    i = by_id.select(F.col(key).alias("_i"), F.col(value).alias("_iv"))
    out = rows.join(d, F.col(digest) == F.col("_d"), "left").join(i, F.col(key) == F.col("_i"), "left")
    return out.withColumn(value, F.coalesce("_dv", "_iv")).drop("_d", "_dv", "_i", "_iv")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values of one column that only one side has, with the side."""
    return a.exceptAll(b).distinct().withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).distinct().withColumn("side", F.lit("right")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], add: tuple[str, ...] = ()) -> DataFrame:
    """Full outer merge: columns in `add` are summed, the others are the new row's where there is one."""
    values = [c for c in old.columns if c not in keys]
    a, b = old.select(*keys, F.struct(*values).alias("_a")), new.select(*keys, F.struct(*values).alias("_b"))
    pick = lambda c: (F.coalesce(F.col(f"_a.{c}"), F.lit(0)) + F.coalesce(F.col(f"_b.{c}"), F.lit(0))).cast(old.schema[c].dataType) if c in add else F.when(F.col("_b").isNotNull(), F.col(f"_b.{c}")).otherwise(F.col(f"_a.{c}"))
    return a.join(b, keys, "full").select(*keys, *(pick(c).alias(c) for c in values))


def adjacent_overlaps(rows: DataFrame, by: str, start: str, stop: str, eps: float = 1e-6) -> DataFrame:
    """Neighbours in start order (of one `by`) where the next starts before this stops, but for eps."""
    w = Window.partitionBy(by).orderBy(start, stop)
    return rows.withColumn("next_start", F.lead(start).over(w)).where(F.col("next_start") < F.col(stop) - eps)


def screen(candidates: DataFrame, reasons: list[tuple[str, Column]], key: str, digest: str, base: str) -> DataFrame:
    """Each candidate's first reason for rejection, in order, else 'kept'.

    After the static reasons, the first (by key) of equal digests stays, then the first of equal
    bases among those; a candidate that a static reason rejected shadows none.
    """
    why = F.lit(None).cast("string")
    for name, c in reversed(reasons):
        why = F.when(c, name).otherwise(why)
    rows = candidates.withColumn("why", why)
    place = lambda col: F.row_number().over(Window.partitionBy("why", col).orderBy(key))
    rows = rows.withColumn("why", F.when(F.col("why").isNull() & (place(digest) > 1), "duplicate content").otherwise(F.col("why")))
    return rows.withColumn("why", F.when(F.col("why").isNull() & (place(base) > 1), "duplicate base").otherwise(F.coalesce("why", F.lit("kept"))))


def enrichment_status(scores: Column) -> Column:
    """Of an array of scores in the provider's order: no_match below 80, ambiguous within 5 of the second, else matched."""
    top, second = F.try_element_at(scores, F.lit(1)), F.try_element_at(scores, F.lit(2))
    return F.when(top.isNull() | (top < 80), "no_match").when(second.isNotNull() & (top - second < 5), "ambiguous").otherwise("matched")


def may_read(catalogs: Column, catalog: Column) -> Column:
    """An empty list allows every catalog."""
    return (F.size(catalogs) == 0) | F.array_contains(catalogs, catalog)


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule (a rule is what must hold; null breaks it)."""
    counts = rows.agg(*(n_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("broken")) for n in rules))).alias("r")).select("r.*")


def assert_valid(rows: DataFrame, rules: dict[str, Column]) -> None:
    bad = [r.asDict() for r in violations(rows, rules).where("broken > 0").collect()]
    if bad:
        raise ValueError(f"constraints are broken: {bad}")


def resolve_version(catalogs: DataFrame, pins: DataFrame, current: DataFrame, stored: DataFrame) -> DataFrame:
    """(catalog_id, version, problem): the pin, else the database's version, else the only stored one; otherwise a problem."""
    sole = stored.groupBy("catalog_id").agg(F.count(F.lit(1)).alias("n"), F.min("version").alias("sole"))
    rows = catalogs.join(pins.withColumnRenamed("version", "pin"), "catalog_id", "left").join(current.withColumnRenamed("version", "db"), "catalog_id", "left").join(sole, "catalog_id", "left")
    chosen = F.coalesce("pin", "db", F.when(F.col("n") == 1, F.col("sole")))
    held = stored.select(F.col("catalog_id").alias("_c"), F.col("version").alias("_v"))
    rows = rows.withColumn("version", chosen).join(held, (F.col("catalog_id") == F.col("_c")) & (F.col("version") == F.col("_v")), "left")
    problem = F.when(F.col("version").isNull() & (F.col("n") > 1), "several versions").when(F.col("version").isNull(), "no version").when(F.col("_v").isNull(), "not stored")
    return rows.select("catalog_id", "version", problem.alias("problem"))


def tile(sources: DataFrame, durations: tuple[float, ...] = (3.0, 5.0, 10.0), gap: float = 0.0) -> DataFrame:
    """Disjoint excerpts (source_id, place, start, duration) of each source, one after another.

    Durations cycle; where the next doesn't fit, the shortest is tried; where that doesn't, the source
    is done. The state is a fold over the steps of one row, so nothing leaves the row.
    """
    ds, short = F.array(*(F.lit(x) for x in durations)), F.lit(min(durations))
    step = F.struct(F.lit(0.0).alias("at"), F.array().cast("array<struct<start:double,duration:double>>").alias("out"))

    def put(acc: Column, i: Column) -> Column:
        want = F.element_at(ds, (F.size(acc["out"]) % len(durations) + 1).cast("int"))
        fits = lambda d: acc["at"] + d <= F.col("length") + 1e-9
        d = F.when(fits(want), want).when(fits(short), short)
        return F.when(d.isNull(), acc).otherwise(F.struct((acc["at"] + d + gap).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), d.alias("duration")))).alias("out")))

    steps = F.sequence(F.lit(1), F.ceil(F.col("length") / short).cast("int") + 1)
    rows = sources.where("length > 0").withColumn("tiles", F.aggregate(steps, step, put)["out"])
    return rows.select("source_id", F.posexplode("tiles").alias("place", "t")).select("source_id", "place", "t.start", "t.duration")
