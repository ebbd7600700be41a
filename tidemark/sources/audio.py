"""Audio files: discovery, decoding of PCM WAV, spectral peaks, degradations and synthetic fixtures.

Decoding and the signal steps work on raw samples in Python, one file or track a row; everything
after peaks is DataFrame code (operators.landmarks).
"""

from __future__ import annotations

import hashlib
import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import LandmarkConfig
from tidemark.functions.text import sniff, stem

# Extensions of audio files, and the analysis grid.
EXTENSIONS = ("wav", "mp3", "flac", "ogg", "m4a", "aac", "aiff", "aif", "opus")
RATE, N_FFT, HOP = 11025, 1024, 128
LOW_HZ, HIGH_HZ = 200.0, 3000.0
AREA, FLOOR = 4, 1e-10
MAX_CHANNELS = 8


#: Any case of the extensions, as a file pattern: other files are never opened.
_PATTERN = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in EXTENSIONS) + "}"


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, sha256, track_id, format, content) of audio files below root, by extension in any case, in order of path; hidden files skipped.

    A missing root raises. Other files are left out by name, before any byte is read. The content hash
    and the container come from the bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _PATTERN).load(root)
    kept = files.where(~F.element_at(F.split("path", "/"), -1).startswith("."))
    rows = kept.select("path", "length", F.sha2("content", 256).alias("sha256"), stem(F.col("path")).alias("track_id"), sniff(F.col("content")).alias("format"), "content")
    return rows.orderBy("path")


def track_id(path: Column, digest: Column, by_content: bool = False) -> Column:
    """A track's id: its file's stem, or the first 16 digits of its content hash."""
    return F.substring(digest, 1, 16) if by_content else stem(path)


def new_sources(found: DataFrame, cache: DataFrame, config_digest: str) -> DataFrame:
    """Sources whose fingerprints for this configuration aren't cached."""
    held = cache.where(F.col("config_digest") == config_digest).select("sha256")
    return found.join(held, "sha256", "left_anti")


def decode_wav(content: bytes, rate: int = RATE, max_seconds: float | None = None) -> tuple[np.ndarray, bool]:
    """Mono float32 samples at `rate`, and whether the input was longer than max_seconds. Raises ValueError on what isn't PCM."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            width, channels, own, frames = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.getnframes()
            limit = frames if max_seconds is None else min(frames, int(max_seconds * own) + 1)
            raw = w.readframes(limit)
    except (wave.Error, EOFError) as e:
        raise ValueError(f"not a PCM WAV: {e}") from e
    if channels > MAX_CHANNELS or width not in (1, 2, 3, 4):
        raise ValueError("unsupported layout")
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 3:  # 24 bits: the upper bytes of 32
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        raw, width = wide.tobytes(), 4
    x = np.frombuffer(raw, {1: "u1", 2: "<i2", 4: "<i4"}[width]).astype(np.float32)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    x = x.reshape(-1, channels).mean(axis=1)
    cut = max_seconds is not None and len(x) > int(max_seconds * own)
    return resample(x[: int(max_seconds * own)] if cut else x, own, rate).astype(np.float32), cut


def encode_wav(x: np.ndarray, rate: int = RATE) -> bytes:
    """PCM-16 with its peak at 0.99 if it would clip."""
    peak = float(np.abs(x).max()) if len(x) else 0.0
    x = x * (0.99 / peak) if peak > 1 else x
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def resample(x: np.ndarray, own: float, rate: float) -> np.ndarray:
    """Linear interpolation after a box filter when the rate falls."""
    if own == rate or not len(x):
        return x
    if rate < own:
        k = max(1, round(own / rate))
        x = np.convolve(x, np.ones(k) / k, "same")
    n = max(1, round(len(x) * rate / own))
    return np.interp(np.arange(n) * own / rate, np.arange(len(x)), x)


def spectrogram(x: np.ndarray) -> np.ndarray:
    """Log power (bins x frames): centred Hann frames with zero padding, 10 log10(max(1e-10, power))."""
    x = np.pad(np.asarray(x, np.float64), N_FFT // 2)
    if len(x) < N_FFT:
        return np.zeros((N_FFT // 2 + 1, 0))
    frames = np.lib.stride_tricks.sliding_window_view(x, N_FFT)[::HOP]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(N_FFT) / N_FFT)
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
    return (10 * np.log10(np.maximum(FLOOR, power))).T


def local_peaks(s: np.ndarray, percentile: float = 75.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frame, bin, magnitude) of band maxima over 9 x 9 that are strictly above the band's percentile; silence has none."""
    hz = RATE / N_FFT
    lo, hi = int(np.ceil(LOW_HZ / hz)), min(s.shape[0] - 1, int(HIGH_HZ // hz))
    band = s[lo : hi + 1]
    if not band.size or band.max() <= 10 * np.log10(FLOOR):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
    top = np.pad(band, AREA, constant_values=-np.inf)
    view = np.lib.stride_tricks.sliding_window_view(top, 2 * AREA + 1, axis=0).max(axis=-1)
    view = np.lib.stride_tricks.sliding_window_view(view, 2 * AREA + 1, axis=1).max(axis=-1)
    b, f = np.nonzero((band >= view) & (band > np.percentile(band, percentile)))
    return f, b + lo, band[b, f]


def peaks(files: DataFrame) -> DataFrame:
    """(track_id, frame, freq_bin, mag, error) from (track_id, content); a file that can't be decoded gives one row with its error."""

    def run(batches):
        for batch in batches:
            for t, c in zip(batch["track_id"], batch["content"], strict=True):
                try:
                    f, b, m = local_peaks(spectrogram(decode_wav(bytes(c))[0]))
                    yield pd.DataFrame({"track_id": t, "frame": f.astype(np.int32), "freq_bin": b.astype(np.int32), "mag": m, "error": None})
                except ValueError as e:
                    yield pd.DataFrame({"track_id": [t], "frame": pd.array([None], "Int32"), "freq_bin": pd.array([None], "Int32"), "mag": [None], "error": [str(e)]})

    return files.select("track_id", "content").mapInPandas(run, "track_id string, frame int, freq_bin int, mag double, error string")


def apply_rate(x: np.ndarray, percent: float, rate: int = RATE) -> np.ndarray:
    """As played percent faster: resampled to round(rate / (1 + percent / 100)) and read at the old rate."""
    return resample(x, rate, round(rate / (1 + percent / 100)))


def add_noise(x: np.ndarray, snr_db: float, seed: int) -> np.ndarray:
    """White noise at a signal-to-noise ratio; silence stays silent."""
    power = float(np.mean(np.square(x))) if len(x) else 0.0
    noise = np.random.default_rng(seed).standard_normal(len(x))
    return x + noise * np.sqrt(power / 10 ** (snr_db / 10))


def seed_of(name: str) -> int:
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:4], "big")


def click_track(bpm: float, seconds: float, name: str, rate: int = RATE) -> np.ndarray:
    """Decaying bursts on each beat, seeded by the name."""
    x, rng = np.zeros(int(seconds * rate)), np.random.default_rng(seed_of(name))
    burst = np.exp(-np.arange(int(0.05 * rate)) / (0.008 * rate)) * rng.standard_normal(int(0.05 * rate))
    for k in range(int(seconds * bpm / 60) + 1):
        at = int(k * 60 / bpm * rate)
        n = min(len(burst), len(x) - at)
        if n > 0:
            x[at : at + n] += burst[:n]
    return x / max(1e-9, np.abs(x).max())


def triads(root: int, minor: bool, seconds: float, rate: int = RATE) -> np.ndarray:
    """I-IV-V-I of a key as sums of sines."""
    t = np.arange(int(seconds * rate / 4)) / rate
    third = 3 if minor else 4
    chord = lambda at: sum(np.sin(2 * np.pi * 261.6256 * 2 ** ((root + at + i) / 12) * t) for i in (0, third, 7))
    return np.concatenate([chord(at) for at in (0, 5, 7, 0)]) / 3


def landmarks(files: DataFrame, cfg: LandmarkConfig = LandmarkConfig()) -> DataFrame:
    """(track_id, hash, anchor_frame) from (track_id, content): peaks, density caps, pairs; files that can't be decoded have none."""
    from tidemark.operators import landmarks as lm

    found = peaks(files).where("error IS NULL").select("track_id", "frame", "freq_bin", "mag")
    return lm.pair_peaks(lm.density_caps(found, cfg).select("track_id", "frame", "freq_bin"), cfg)


def config_digest(cfg: LandmarkConfig = LandmarkConfig()) -> str:
    """What a cache entry was made with."""
    return hashlib.sha256(repr((cfg, RATE, N_FFT, HOP, LOW_HZ, HIGH_HZ)).encode()).hexdigest()[:16]


def cached_landmarks(files: DataFrame, cache: str, cfg: LandmarkConfig = LandmarkConfig()) -> tuple[DataFrame, int]:
    """Landmarks of (track_id, sha256, content), and how many files the cache had.

    The cache is Parquet by configuration: a row for each file's content hash with its landmarks. Files
    that it lacks are analysed and appended; an unreadable file is kept as one without landmarks, so that it
    isn't tried again.
    """
    spark, at = files.sparkSession, f"{cache}/config={config_digest(cfg)}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(at)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    kind = "sha256 string, marks array<struct<hash:bigint,anchor_frame:int>>"
    held = spark.read.schema(kind).parquet(at) if there else spark.createDataFrame([], kind)
    fresh = files.dropDuplicates(["sha256"]).join(held.select("sha256"), "sha256", "left_anti")
    found = landmarks(fresh.select(F.col("sha256").alias("track_id"), "content"), cfg).groupBy(F.col("track_id").alias("sha256")).agg(F.collect_list(F.struct(F.col("hash"), F.col("anchor_frame").cast("int").alias("anchor_frame"))).alias("marks"))
    hits = files.join(held.select("sha256"), "sha256", "left_semi").count()
    fresh.select("sha256").join(found, "sha256", "left").write.mode("append").parquet(at)
    rows = files.select("track_id", "sha256").join(spark.read.schema(kind).parquet(at).dropDuplicates(["sha256"]), "sha256")
    return rows.select("track_id", F.explode("marks").alias("m")).select("track_id", "m.hash", "m.anchor_frame"), hits


def density(marks: DataFrame, durations: DataFrame) -> DataFrame:
    """(track_id, landmarks, per_second, bytes) of tracks (track_id, duration_sec): 12 bytes a posting; 0 a second without duration."""
    n = marks.groupBy("track_id").agg(F.count(F.lit(1)).alias("landmarks"))
    rows = durations.join(n, "track_id", "left").withColumn("landmarks", F.coalesce("landmarks", F.lit(0)))
    rate = F.when(F.col("duration_sec") > 0, F.col("landmarks") / F.col("duration_sec")).otherwise(0.0)
    return rows.select("track_id", "landmarks", rate.alias("per_second"), (F.col("landmarks") * 12).alias("bytes"))


def decode_reason(error: Column, length: Column, too_long: Column) -> Column:
    """Why a file wasn't decoded: empty, unknown container, unsupported layout, too long; null if it was."""
    return F.when(length == 0, "empty").when(error.startswith("not a PCM WAV"), "unsupported container").when(error.isNotNull(), "unsupported layout").when(too_long, "too long")


def pink_noise(n: int, seed: int) -> np.ndarray:
    """Noise whose power falls with frequency, scaled to a peak of 1."""
    spectrum = np.fft.rfft(np.random.default_rng(seed).standard_normal(n))
    spectrum[1:] /= np.sqrt(np.fft.rfftfreq(n)[1:])
    out = np.fft.irfft(spectrum, n=n)
    return out / max(1e-12, np.abs(out).max())


def mix_noise(x: np.ndarray, snr_db: float, kind: str, seed: int) -> tuple[np.ndarray, dict]:
    """White or pink noise at a signal-to-noise ratio by power, trimmed to full scale; what was done."""
    noise = pink_noise(len(x), seed) if kind == "pink" else np.random.default_rng(seed).standard_normal(len(x))
    signal, power = float(np.mean(np.square(x))) if len(x) else 0.0, float(np.mean(np.square(noise))) if len(x) else 0.0
    if signal <= 0 or power <= 0:
        return x.copy(), {"applied": False}
    out = x + noise * np.sqrt(signal / (power * 10 ** (snr_db / 10)))
    gain = min(1.0, 0.99 / float(np.abs(out).max()))
    return out * gain, {"applied": True, "snr_db": snr_db, "gain": gain}


def band_limit(x: np.ndarray, low: float | None, high: float | None, rate: int = RATE, order: int = 4) -> np.ndarray:
    """The gains of a Butterworth filter of this order over the signal's spectrum; no phase shift."""
    f = np.fft.rfftfreq(len(x), 1 / rate)
    gain = np.ones(len(f))
    if high is not None:
        gain /= np.sqrt(1 + (f / high) ** (2 * order))
    if low is not None:
        with np.errstate(divide="ignore"):
            gain /= np.sqrt(1 + np.where(f > 0, low / np.maximum(f, 1e-12), np.inf) ** (2 * order))
    return np.fft.irfft(np.fft.rfft(x) * gain, n=len(x))


def shift_pitch(x: np.ndarray, semitones: float, frame: int = 1024) -> np.ndarray:
    """Resampled by the interval and stretched back to its length by overlapping frames."""
    factor = 2 ** (semitones / 12)
    fast = np.interp(np.arange(0, len(x), factor), np.arange(len(x)), x)
    hop, window = frame // 4, 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)
    out, weight = np.zeros(len(x) + frame), np.full(len(x) + frame, 1e-9)
    for at in range(0, len(x), hop):
        start = min(max(0, len(fast) - frame), int(at / factor))
        piece = fast[start : start + frame]
        out[at : at + len(piece)] += piece * window[: len(piece)]
        weight[at : at + len(piece)] += window[: len(piece)]
    return (out / weight)[: len(x)]


def synthetic_audio(plan: DataFrame) -> DataFrame:
    """(query_id, content) of a plan (query_id, condition, duration, level, seed) of silence and noise, as PCM-16 files."""

    def run(batches):
        for batch in batches:
            out = []
            for condition, seconds, level, seed in zip(batch["condition"], batch["duration"], batch["level"], batch["seed"], strict=True):
                n = int(RATE * seconds)
                noise = pink_noise(n, seed) if condition.endswith("pink") else np.random.default_rng(seed).standard_normal(n)
                out.append(encode_wav(noise * level))
            yield pd.DataFrame({"query_id": batch["query_id"], "content": out})

    return plan.select("query_id", "condition", "duration", "level", "seed").mapInPandas(run, "query_id string, content binary")


# ---- features of a whole signal ----


def _mel_bank(n_mels: int, n_fft: int, rate: int) -> np.ndarray:
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), n_mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(n_fft, 1 / rate)
    up, down = (f - edges[:-2, None]) / np.diff(edges)[:-1, None], (edges[2:, None] - f) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def _power(x: np.ndarray, n_fft: int = 2048, hop: int = 512) -> np.ndarray:
    x = np.pad(np.asarray(x, np.float64), n_fft // 2)
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
    return np.abs(np.fft.rfft(frames * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)), axis=1)).T ** 2


def mfcc(x: np.ndarray, rate: int = RATE, n: int = 13, n_mels: int = 40) -> np.ndarray:
    """n x frames: orthonormal cosine transform of log mel energies."""
    log = 10 * np.log10(np.maximum(FLOOR, _mel_bank(n_mels, 2048, rate) @ _power(x)))
    k, m = np.arange(n)[:, None], np.arange(n_mels)[None, :]
    basis = np.cos(np.pi * k * (2 * m + 1) / (2 * n_mels)) * np.sqrt(2 / n_mels)
    basis[0] /= np.sqrt(2)
    return basis @ log


def chroma(x: np.ndarray, rate: int = RATE) -> np.ndarray:
    """12 x frames: power by pitch class (from C), the strongest of a frame 1."""
    p, f = _power(x), np.fft.rfftfreq(2048, 1 / rate)
    some = f > 30
    classes = np.round(12 * np.log2(f[some] / 261.6256)).astype(int) % 12
    out = np.zeros((12, p.shape[1]))
    np.add.at(out, classes, p[some])
    return out / np.maximum(FLOOR, out.max(axis=0))


def chroma_mean(x: np.ndarray, rate: int = RATE) -> np.ndarray:
    return chroma(x, rate).mean(axis=1)


def mfcc_embedding(x: np.ndarray, rate: int = RATE) -> np.ndarray:
    """26 values: means and deviations of 13 coefficients."""
    m = mfcc(x, rate)
    return np.concatenate([m.mean(axis=1), m.std(axis=1)]).astype(np.float32)


def contrast(x: np.ndarray, rate: int = RATE) -> np.ndarray:
    """7 x frames: peaks over valleys (decibels) of octave bands from 200 Hz."""
    p, f = _power(x), np.fft.rfftfreq(2048, 1 / rate)
    edges = [0.0, *(200.0 * 2**i for i in range(6)), rate / 2 + 1]
    out = np.zeros((7, p.shape[1]))
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        band = np.sort(p[(f >= lo) & (f < max(hi, lo))], axis=0)
        if len(band):
            n = max(1, len(band) // 50)
            out[i] = 10 * np.log10(np.maximum(FLOOR, band[-n:].mean(axis=0))) - 10 * np.log10(np.maximum(FLOOR, band[:n].mean(axis=0)))
    return out


def features(x: np.ndarray, rate: int = RATE) -> np.ndarray | None:
    """96 values of a signal, scaled to a peak of 1 and trimmed of what is 60 decibels below it; None for silence or too little.

    Means and deviations of 13 coefficients and their slopes, 12 pitch classes, 7 contrasts, zero crossings, loudness and centroid.
    """
    peak = float(np.abs(x).max()) if len(x) else 0.0
    if peak <= 0 or not np.isfinite(peak):
        return None
    loud = np.flatnonzero(np.abs(x) > peak * 1e-3)
    x = x[loud[0] : loud[-1] + 1] / peak
    if len(x) < 2048:
        return None
    m = mfcc(x, rate)
    frames = np.lib.stride_tricks.sliding_window_view(np.pad(x, 1024), 2048)[::512]
    zero = (np.diff(np.signbit(frames), axis=1) != 0).mean(axis=1)
    p, f = _power(x), np.fft.rfftfreq(2048, 1 / rate)
    centroid = (f[:, None] * np.sqrt(p)).sum(axis=0) / np.maximum(FLOOR, np.sqrt(p).sum(axis=0))
    parts = []
    for rows in (m, np.gradient(m, axis=1) if m.shape[1] > 1 else np.zeros_like(m), chroma(x, rate), contrast(x, rate), zero[None, :], np.sqrt((frames**2).mean(axis=1))[None, :], centroid[None, :]):
        parts += [rows.mean(axis=1), rows.std(axis=1)]
    return np.concatenate(parts)


def feature_table(files: DataFrame, kind: str = "features") -> DataFrame:
    """(track_id, embedding) from (track_id, content): features (96), mfcc (26) or chroma (12); null where there are none."""
    make = {"features": features, "mfcc": mfcc_embedding, "chroma": chroma_mean}[kind]

    def run(batches):
        for batch in batches:
            out = []
            for c in batch["content"]:
                try:
                    v = make(decode_wav(bytes(c))[0])
                except ValueError:
                    v = None
                out.append(None if v is None else np.asarray(v, np.float64).tolist())
            yield pd.DataFrame({"track_id": batch["track_id"], "embedding": out})

    return files.select("track_id", "content").mapInPandas(run, "track_id string, embedding array<double>")
