"""Usage metering: daily sums, quota, token bucket, intervals, histograms."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.evaluate import n_if

AMOUNT = "decimal(14,3)"
USAGE = "tenant bigint, key_id bigint, usage_day date, audio_seconds decimal(14,3), request_count bigint, match_count bigint"


def daily(events: DataFrame) -> DataFrame:
    """Of (tenant, key_id, ts, audio_seconds, matched): sums by tenant, key and UTC day. Each amount is rounded to 3 places before it is added."""
    amount = F.round(F.col("audio_seconds").cast("decimal(18,6)"), 3).cast(AMOUNT)
    return events.groupBy("tenant", "key_id", F.to_date("ts").alias("usage_day")).agg(F.sum(amount).cast(AMOUNT).alias("audio_seconds"), F.count(F.lit(1)).alias("request_count"), n_if(F.col("matched")).alias("match_count"))


def quota(events: DataFrame, limit: float) -> DataFrame:
    """Accepted if what the tenant used earlier that day is below the limit (so a charge may overshoot).

    Costs of refused requests don't count, but once the limit is reached all later ones are refused;
    hence the running sum of all earlier costs decides alike.
    """
    w = Window.partitionBy("tenant", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.col("audio_seconds").cast("decimal(18,6)")).over(w), F.lit(0).cast("decimal(28,6)"))
    return events.withColumn("used_before", used).withColumn("accepted", used < limit)


def bucket_step(tokens: float, last: float | None, now: float, rate: float, burst: float) -> tuple[float, bool, int]:
    """(tokens left, allowed, seconds to wait) of one request of cost 1; time that runs backwards refills nothing."""
    if last is not None:
        tokens = min(burst, tokens + max(0.0, now - last) * rate)
    if tokens >= 1.0:
        return tokens - 1.0, True, 0
    return tokens, False, math.ceil((1.0 - tokens) / rate) if rate > 0 else 2**31 - 1


def token_bucket(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """Of (key_id, ts double, event_id): each request's verdict, in time order by key. State passes from row to row, so this runs in Python, one key at a time."""

    def stream(batches):
        # rows come sorted by key and time; a key's state lives across Arrow batches and is dropped with the key
        state: dict = {}
        for f in batches:
            parts = []
            for k, g in f.groupby("key_id", sort=False):
                tokens, last = state.get(k, (burst, None))
                out = []
                for now in g["ts"]:
                    tokens, ok, wait = bucket_step(tokens, last, now, rate, burst)
                    last = now if last is None else max(last, now)
                    out.append((ok, wait, tokens))
                state = {k: (tokens, last)}
                parts.append(pd.DataFrame({"key_id": g["key_id"], "event_id": g["event_id"], "allowed": [o[0] for o in out], "retry_after": [o[1] for o in out], "tokens": [o[2] for o in out]}))
            yield pd.concat(parts) if parts else pd.DataFrame({"key_id": [], "event_id": [], "allowed": [], "retry_after": [], "tokens": []})

    rows = requests.select("key_id", "ts", "event_id").repartition("key_id").sortWithinPartitions("key_id", "ts", "event_id")
    return rows.mapInPandas(stream, "key_id bigint, event_id bigint, allowed boolean, retry_after int, tokens double")


def minimum_interval(events: DataFrame, by: str, seconds: float) -> DataFrame:
    """Seconds each request would wait for `seconds` to have passed since the one before (0 if the clock ran backwards)."""
    w = Window.partitionBy(by).orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts")) - F.unix_micros(F.lag("ts").over(w))
    return events.withColumn("wait_micros", F.when(gap.isNull() | (gap < 0), F.lit(0)).otherwise(F.greatest(F.lit(0), F.lit(int(seconds * 1e6)) - gap)).cast("long"))


def histogram(rows: DataFrame, by: str, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts at or below each bound, as a wide row."""
    return rows.groupBy(by).agg(*(n_if(F.col(value) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in bounds), F.count(F.lit(1)).alias("le_inf"))
