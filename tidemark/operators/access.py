"""API keys, what they may read, and usage records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.catalog import may_read, upsert

# What a key without scopes or limits has.
DEFAULT_SCOPES = ("identify", "catalogs:read")
DEFAULT_LIMITS = {"rate_limit_per_minute": 60, "rate_limit_burst": 0, "audio_seconds_per_day": 3600}


def key_digest(raw: Column) -> Column:
    return F.sha2(raw.cast("binary"), 256)


def presented_key(authorization: Column, api_key: Column) -> Column:
    """The key of a request: of an authorization header, if there is one, else of the key header; null if neither has one.

    An authorization header of another scheme, or without a value, hides the key header.
    """
    scheme, value = F.substring_index(authorization, " ", 1), F.trim(F.regexp_replace(authorization, "^[^ ]* ?", ""))
    some = F.coalesce(authorization, F.lit("")) != ""
    bearer = F.when((F.lower(scheme) == "bearer") & (value != ""), value)
    return F.when(some, bearer).otherwise(F.when(F.coalesce(api_key, F.lit("")) != "", F.trim(api_key)))


def with_defaults(records: DataFrame) -> DataFrame:
    """Key records with digests trimmed and in lower case, and defaults where a value is null; a raw key is refused."""
    if {"key", "secret"} & set(records.columns):
        raise ValueError("records hold digests, never raw keys")
    scopes = F.when(F.size("scopes") > 0, F.col("scopes")).otherwise(F.array(*(F.lit(s) for s in DEFAULT_SCOPES)))
    limits = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULT_LIMITS.items()}
    return records.withColumns({"key_sha256": F.lower(F.trim("key_sha256")), "catalogs": F.coalesce("catalogs", F.array().cast("array<string>")), "scopes": scopes, "active": F.coalesce("active", F.lit(True)), **limits})


def record_problems(records: DataFrame) -> DataFrame:
    """(key_id, problem): an incomplete record, a digest that is none, a digest that several records have."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    digest = F.lower(F.trim("key_sha256"))
    bad = F.when(blank("key_id") | blank("tenant") | blank("key_sha256"), "incomplete").when(~digest.rlike("^[0-9a-f]{64}$"), "not a digest")
    rows = records.withColumn("problem", bad).withColumn("digest", digest)
    twice = rows.where("problem IS NULL").groupBy("digest").agg(F.min("key_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    again = rows.where("problem IS NULL").join(twice, "digest").where("key_id <> first").select("key_id", F.lit("digest repeats").alias("problem"))
    return rows.where("problem IS NOT NULL").select("key_id", "problem").unionByName(again)


def resolve(requests: DataFrame, keys: DataFrame, raw: str) -> DataFrame:
    """Requests with key_id and tenant of the active key whose digest theirs has; null for an unknown, revoked or missing one alike."""
    known = keys.where("active").select(F.col("key_sha256").alias("_digest"), "key_id", "tenant", "catalogs", "scopes")
    return requests.join(known, key_digest(F.col(raw)) == F.col("_digest"), "left").drop("_digest")


def readable(principals: DataFrame, catalogs: DataFrame) -> DataFrame:
    """Requests (catalog_id, catalogs, ...) with the catalog they may read, else none: a missing and a forbidden one look alike."""
    held = catalogs.select(F.col("catalog_id").alias("_c"))
    found = principals.join(held, (F.col("catalog_id") == F.col("_c")) & may_read(F.col("catalogs"), F.col("catalog_id")), "left")
    return found.withColumn("status", F.when(F.col("_c").isNotNull(), "found").otherwise("not found")).drop("_c")


def upsert_keys(old: DataFrame, new: DataFrame) -> DataFrame:
    """Records by key_id, the new one where there is one."""
    return upsert(old, with_defaults(new).select(old.columns), ["key_id"])


def revoke(keys: DataFrame, ids: DataFrame) -> DataFrame:
    """The keys of these ids stay, no longer active."""
    gone = ids.select(F.col("key_id").alias("_id")).distinct()
    return keys.join(gone, F.col("key_id") == F.col("_id"), "left").withColumn("active", F.col("active") & F.col("_id").isNull()).drop("_id")


def tenants(catalogs: DataFrame, mapping: DataFrame, default: str | None = None) -> DataFrame:
    """(catalog_id, tenant, problem): the mapped tenant, else the default, else a problem."""
    rows = catalogs.join(mapping.select("catalog_id", F.col("tenant").alias("_t")), "catalog_id", "left")
    tenant = F.coalesce(F.col("_t"), F.lit(default))
    return rows.select("catalog_id", tenant.alias("tenant"), F.when(tenant.isNull(), "no tenant").alias("problem"))


def history(usage: DataFrame, tenant: Column, since: Column | None = None) -> DataFrame:
    """One tenant's usage rows from a day on, by day and key."""
    rows = usage.where(F.col("tenant") == tenant)
    return (rows if since is None else rows.where(F.col("usage_day") >= since)).orderBy("usage_day", "key_id")
