"""Usage metering as Structured Streaming: idempotent daily sums, windowed sums with a watermark, and a stateful limiter."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.usage import bucket_step, daily

EVENTS = "tenant bigint, key_id bigint, ts timestamp, event_id bigint, audio_seconds double, matched boolean"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def daily_windows(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Sums by tenant and UTC day in append mode: a day is emitted once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy("tenant", F.window("ts", "1 day").alias("day")).agg(F.sum(F.col("audio_seconds").cast("decimal(18,3)")).alias("audio_seconds"), F.count(F.lit(1)).alias("request_count"))


def write_behind(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch's daily sums go to path/batch=<id>; a batch that runs again replaces its own folder, so nothing counts twice."""

    def save(batch: DataFrame, number: int) -> None:
        daily(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_table(spark: SparkSession, path: str) -> DataFrame:
    """The daily usage over all batches."""
    rows = spark.read.parquet(path)
    return rows.groupBy("tenant", "key_id", "usage_day").agg(*(F.sum(c).alias(c) for c in ("audio_seconds", "request_count", "match_count")))


def limited(events: DataFrame, rate: float, burst: float) -> DataFrame:
    """Token-bucket verdicts of each request; a key's tokens and last time are streaming state. Within a micro-batch a key's requests run in time order."""

    def run(key: tuple, frames, state: GroupState):
        tokens, last = state.get if state.exists else (burst, None)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for at in rows["ts"].astype("int64") / 1e9 if str(rows["ts"].dtype).startswith("datetime64[ns") else rows["ts"].map(lambda t: t.timestamp()):
            tokens, ok, wait = bucket_step(tokens, last, at, rate, burst)
            last = at if last is None else max(last, at)
            out.append((ok, wait))
        state.update((tokens, last))
        yield pd.DataFrame({"key_id": key[0], "event_id": rows["event_id"].to_numpy(), "allowed": [o[0] for o in out], "retry_after": [o[1] for o in out]})

    return events.groupBy("key_id").applyInPandasWithState(run, "key_id bigint, event_id bigint, allowed boolean, retry_after int", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)
