"""Quota, token bucket and minimum interval as streams whose state ends by itself.

Each request's verdict is that of the batch operator over all requests so far, however the stream is cut into
micro-batches, if requests arrive in time order but for the watermark's delay. State is small and goes
when nothing can depend on it: a tenant's day once the watermark passes its UTC midnight, a bucket once it is
full again, an interval once it has passed. Timers are event time, so an idle stream keeps what it has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.usage import bucket_step

DAY = 86_400_000_000
QUOTA = "tenant bigint, event_id bigint, used_before decimal(18,6), accepted boolean"
BUCKET = "key_id bigint, event_id bigint, allowed boolean, retry_after int"
INTERVAL = "key_id bigint, event_id bigint, wait_micros bigint"


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["micros", "event_id"], kind="stable")


class _Timed(StatefulProcessor):
    """Shared: one timer for a key at most, moved to where its state ends."""

    def _end_at(self, micros: int) -> None:
        at = -(-micros // 1000)
        for old in list(self.handle.listTimers()):
            if old == at:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class Quota(_Timed):
    """Costs of each UTC day that isn't over, in millionths, by tenant."""

    def __init__(self, limit: float):
        self.limit = round(limit * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getMapState("used", "day bigint", "used bigint")

    def handleInputRows(self, key, rows, timerValues):
        frame = _in_order(rows)
        day = frame["micros"].to_numpy() // DAY
        before = np.zeros(len(frame), np.int64)
        for d in np.unique(day).tolist():
            at, held = day == d, self.used.getValue((d,)) if self.used.containsKey((d,)) else None
            cost = frame["cost"].to_numpy()[at]
            total = np.cumsum(cost) + (held[0] if held is not None else 0)
            before[at] = total - cost
            self.used.updateValue((d,), (int(total[-1]),))
        self._end_at((int(min(k[0] for k in self.used.keys())) + 1) * DAY)
        yield pd.DataFrame({"tenant": key[0], "event_id": frame["event_id"].to_numpy(), "used": before, "accepted": before < self.limit})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        over = expiredTimerInfo.getExpiryTimeInMs() * 1000
        for d in [k[0] for k in self.used.keys()]:
            if (d + 1) * DAY <= over:
                self.used.removeKey((d,))
        left = [k[0] for k in self.used.keys()]
        if left:
            self.handle.registerTimer((min(left) + 1) * DAY // 1000)
        return iter([])


class Bucket(_Timed):
    """Tokens and the time of the last request, by key; a bucket that is full again is as one never used."""

    def __init__(self, rate: float, burst: float):
        self.rate, self.burst = rate, burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("bucket", "tokens double, last double")

    def handleInputRows(self, key, rows, timerValues):
        frame = _in_order(rows)
        tokens, last = self.held.get() if self.held.exists() else (self.burst, None)
        out = []
        for now in (frame["micros"].to_numpy() / 1e6).tolist():
            tokens, ok, wait = bucket_step(tokens, last, now, self.rate, self.burst)
            last = now if last is None else max(last, now)
            out.append((ok, wait))
        self.held.update((tokens, last))
        if self.rate > 0:
            self._end_at(math.ceil((last + (self.burst - tokens) / self.rate) * 1e6))
        yield pd.DataFrame({"key_id": key[0], "event_id": frame["event_id"].to_numpy(), "allowed": [o[0] for o in out], "retry_after": [o[1] for o in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.held.clear()
        return iter([])


class Interval(_Timed):
    """The time of the last request, by key, until the interval after it has passed."""

    def __init__(self, seconds: float):
        self.micros = int(seconds * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "micros bigint")

    def handleInputRows(self, key, rows, timerValues):
        frame = _in_order(rows)
        now = frame["micros"].to_numpy()
        before = np.concatenate([[self.last.get()[0] if self.last.exists() else now[0] - self.micros], now[:-1]])
        gap = now - before
        self.last.update((int(now[-1]),))
        self._end_at(int(now[-1]) + self.micros)
        yield pd.DataFrame({"key_id": key[0], "event_id": frame["event_id"].to_numpy(), "wait_micros": np.where(gap < 0, 0, np.maximum(0, self.micros - gap))})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        return iter([])


def _run(events: DataFrame, key: str, columns: list[str], processor: StatefulProcessor, schema: str, late: str) -> DataFrame:
    rows = events.withWatermark("ts", late).select(key, "ts", F.unix_micros("ts").alias("micros"), "event_id", *columns)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def quota(events: DataFrame, limit: float, late: str = "10 minutes") -> DataFrame:
    """Each request's verdict under a daily quota: accepted if what its tenant used earlier that UTC day is below the limit.

    events: (tenant, ts, event_id, audio_seconds). Nulls in audio_seconds cost nothing.
    """
    cost = (F.coalesce(F.col("audio_seconds").cast("decimal(18,6)"), F.lit(0)) * 1_000_000).cast("long").alias("cost")
    rows = _run(events.select("tenant", "ts", "event_id", cost), "tenant", ["cost"], Quota(limit), "tenant bigint, event_id bigint, used bigint, accepted boolean", late)
    return rows.select("tenant", "event_id", (F.col("used").cast("decimal(24,6)") / 1_000_000).cast("decimal(18,6)").alias("used_before"), "accepted")


def token_bucket(events: DataFrame, rate: float, burst: float, late: str = "10 minutes") -> DataFrame:
    """Each request's token-bucket verdict by key_id: (key_id, ts, event_id) in, (key_id, event_id, allowed, retry_after) out."""
    return _run(events, "key_id", [], Bucket(rate, burst), BUCKET, late)


def minimum_interval(events: DataFrame, seconds: float, late: str = "10 minutes") -> DataFrame:
    """Microseconds each request would have to wait for `seconds` to have passed since its key's last one."""
    return _run(events, "key_id", [], Interval(seconds), INTERVAL, late)


#: State stores for these operators: Spark's RocksDB provider, which timers need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
