"""Peaks, density caps, landmark pairing and key packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import LandmarkConfig
from tidemark.operators.ranks import percentiles

BIN_BITS, DT_BITS = 10, 8
MAX_BIN, MAX_DT = (1 << BIN_BITS) - 1, (1 << DT_BITS) - 1
SPACES = r"[ \t\n\r\f]+"


def pack_key(f1: Column, f2: Column, dt: Column) -> Column:
    """f1 << 18 | f2 << 8 | dt as a bigint; null if a part is out of range."""
    fits = f1.between(0, MAX_BIN) & f2.between(0, MAX_BIN) & dt.between(0, MAX_DT)
    key = F.shiftleft(f1.cast("long"), BIN_BITS + DT_BITS).bitwiseOR(F.shiftleft(f2.cast("long"), DT_BITS)).bitwiseOR(dt.cast("long"))
    return F.when(fits, key)


def unpack_key(key: Column) -> tuple[Column, Column, Column]:
    f1 = F.shiftright(key, BIN_BITS + DT_BITS).bitwiseAND(F.lit(MAX_BIN))
    f2 = F.shiftright(key, DT_BITS).bitwiseAND(F.lit(MAX_BIN))
    return f1.cast("int"), f2.cast("int"), key.bitwiseAND(F.lit(MAX_DT)).cast("int")


def bin_of(token: Column) -> Column:
    """A token's bin: the first 16 bits of its sha256, modulo 1024."""
    return F.conv(F.substring(F.sha2(token, 256), 1, 4), 16, 10).cast("int").bitwiseAND(F.lit(MAX_BIN))


def token_landmarks(df: DataFrame, key: str, text: str, out: str, cfg: LandmarkConfig = LandmarkConfig()) -> DataFrame:
    """(out, hash, anchor_frame): tokens as one peak a frame, each paired with the next fan_out ones.

    A text's landmarks come from its own array of bins, so there is neither a join nor a shuffle.
    """
    cfg.validate()
    reach = min(cfg.fan_out, cfg.max_dt)
    bins = F.transform(F.split(F.col(text), SPACES), bin_of)
    rows = df.select(F.col(key).alias(out), bins.alias("bins")).select(out, F.posexplode(F.transform("bins", lambda b, i: F.struct(b.alias("a"), F.slice(F.col("bins"), i + 2, reach).alias("next")))).alias("anchor_frame", "p"))
    pairs = rows.select(out, "anchor_frame", F.col("p.a").alias("f1"), F.posexplode("p.next").alias("k", "f2"))
    return pairs.select(out, pack_key(F.col("f1"), F.col("f2"), F.col("k") + 1).alias("hash"), "anchor_frame")


def landmark_count(text: Column, frames: int | None = None, cfg: LandmarkConfig = LandmarkConfig()) -> Column:
    """How many landmarks token_landmarks makes of a text (of its first `frames` anchors): 0 for a null one."""
    n, reach = F.size(F.split(text, SPACES)), min(cfg.fan_out, cfg.max_dt)
    anchors = n if frames is None else F.least(n, F.lit(frames))
    # anchors before `tail` have `reach` partners, those after it one fewer each
    tail = F.greatest(F.lit(0), n - reach)
    rest = F.greatest(F.lit(0), anchors - tail)
    total = F.least(anchors, tail) * reach + rest * (n - 1 - tail) - F.floor(rest * (rest - 1) / 2)
    return F.when(text.isNull(), 0).otherwise(total).cast("long")


def pair_peaks(peaks: DataFrame, cfg: LandmarkConfig = LandmarkConfig()) -> DataFrame:
    """(track_id, hash, anchor_frame) from (track_id, frame, freq_bin): each peak with the first fan_out later ones at most max_dt frames on."""
    cfg.validate()
    ahead = Window.partitionBy("track_id").orderBy("frame").rangeBetween(1, cfg.max_dt)
    rows = peaks.withColumn("ahead", F.slice(F.array_sort(F.collect_list(F.struct("frame", "freq_bin")).over(ahead)), 1, cfg.fan_out))
    return rows.select("track_id", "frame", "freq_bin", F.explode("ahead").alias("b")).select(
        "track_id", pack_key(F.col("freq_bin"), F.col("b.freq_bin"), F.col("b.frame") - F.col("frame")).alias("hash"), F.col("frame").alias("anchor_frame")
    )


def amplitude_gate(peaks: DataFrame, cfg: LandmarkConfig = LandmarkConfig()) -> DataFrame:
    """Peaks strictly above their track's percentile of magnitude. A track of many peaks is not one task: its rank comes from brackets."""
    gate = percentiles(peaks, ["track_id"], "mag", [cfg.gate_percentile]).select("track_id", F.col("value").alias("gate"))
    return peaks.join(gate, "track_id").where(F.col("mag") > F.col("gate")).drop("gate")


def density_caps(peaks: DataFrame, cfg: LandmarkConfig = LandmarkConfig()) -> DataFrame:
    """At most peaks_per_frame of a frame, then peaks_per_bucket of a bucket, strongest first; frames nest in buckets, so two ranks are the greedy choice."""
    cfg.validate()
    strongest = [F.desc("mag"), F.asc("frame"), F.asc("freq_bin")]
    per_frame = F.row_number().over(Window.partitionBy("track_id", "frame").orderBy(*strongest))
    rows = peaks.withColumn("r", per_frame).where(F.col("r") <= cfg.peaks_per_frame)
    bucket = F.floor(F.col("frame") / cfg.bucket_frames)
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("track_id", bucket).orderBy(*strongest)))
    return rows.where(F.col("r") <= cfg.peaks_per_bucket).drop("r")
