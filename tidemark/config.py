"""Settings of the recognition operators; validate() refuses what the operators can't honour."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LandmarkConfig:
    """Packing: 10 bits for either bin, 8 for the frame difference."""

    fan_out: int = 5
    max_dt: int = 128
    peaks_per_frame: int = 5
    bucket_frames: int = 86
    peaks_per_bucket: int = 30
    gate_percentile: float = 0.75

    def validate(self) -> LandmarkConfig:
        if self.fan_out < 1 or not 1 <= self.max_dt <= 255:
            raise ValueError("fan_out >= 1 and 1 <= max_dt <= 255 are needed")
        if self.peaks_per_frame < 1 or self.peaks_per_bucket < 1 or self.bucket_frames < 1:
            raise ValueError("density caps must be positive")
        if not 0 <= self.gate_percentile < 1:
            raise ValueError("gate_percentile must be in [0, 1)")
        return self


@dataclass(frozen=True)
class MatchConfig:
    tolerance: int = 2
    max_candidates: int = 10

    def validate(self) -> MatchConfig:
        if self.tolerance < 0 or self.max_candidates < 1:
            raise ValueError("tolerance >= 0 and max_candidates >= 1 are needed")
        return self


@dataclass(frozen=True)
class DecisionConfig:
    threshold: float = 0.05
    min_aligned: int = 5

    def validate(self) -> DecisionConfig:
        if not 0 <= self.threshold <= 1 or self.min_aligned < 1:
            raise ValueError("0 <= threshold <= 1 and min_aligned >= 1 are needed")
        return self


@dataclass(frozen=True)
class AnalysisConfig:
    """From samples to peaks: frames of n_fft samples every hop, bins of a band, a percentile gate."""

    rate: int = 11025
    n_fft: int = 1024
    hop: int = 128
    low_hz: float = 200.0
    high_hz: float = 3000.0
    percentile: float = 75.0

    @property
    def frame_rate(self) -> float:
        return self.rate / self.hop

    @property
    def bin_hz(self) -> float:
        return self.rate / self.n_fft

    def seconds(self, frames: float) -> float:
        return frames * self.hop / self.rate

    def validate(self) -> AnalysisConfig:
        if self.rate < 1 or self.n_fft < 2 or self.hop < 1 or self.hop > self.n_fft:
            raise ValueError("rate >= 1, n_fft >= 2 and 1 <= hop <= n_fft are needed")
        if not 0 <= self.low_hz < self.high_hz <= self.rate / 2:
            raise ValueError("0 <= low_hz < high_hz <= rate / 2 is needed")
        if self.high_hz // self.bin_hz > 1023:
            raise ValueError("the band's last bin doesn't fit 10 bits")
        if not 0 <= self.percentile < 100:
            raise ValueError("percentile must be in [0, 100)")
        return self


# Thresholds, rates and probe length of the service.
@dataclass(frozen=True)
class CascadeConfig:
    """Rates in percent tried for queries that the first stage leaves open."""

    stage1: float = 0.026316
    gate: float = 0.032520
    stage2: float = 0.028571
    min_aligned: int = 5
    rates: tuple[float, ...] = (-5.0, -4.0, -3.0, -2.0, -1.0, 1.0, 2.0, 3.0, 4.0, 5.0)
    probe_rates: tuple[float, ...] = (-4.0, -2.0, 2.0, 4.0)
    probe_frames: int = 24
