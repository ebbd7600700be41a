"""From files to landmarks and features, on generated sound; the stored index and its refusals; the classifier."""

import io
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import AnalysisConfig, LandmarkConfig
from tidemark.operators import genre
from tidemark.operators import index as ix
from tidemark.operators import match as mt
from tidemark.sources import audio


def wav(x, width=2, rate=audio.RATE):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(width)
        w.setframerate(rate)
        full = (np.clip(x, -1, 1) * (2 ** (8 * width - 1) - 1)).astype("<i4")
        w.writeframes(full.view(np.uint8).reshape(-1, 4)[:, :width].tobytes())
    return out.getvalue()


def songs():
    rng = np.random.default_rng(1)
    return {f"s{k}": np.concatenate([np.sin(2 * np.pi * f * np.arange(2200) / audio.RATE) for f in rng.uniform(250, 2800, 40)]) * 0.5 for k in range(3)}


def test_files_to_landmarks_and_back(spark, tmp_path):
    whole = songs()
    for k, x in whole.items():
        (tmp_path / f"{k}.WAV").write_bytes(wav(x))
    (tmp_path / "notes.txt").write_bytes(b"RIFF")
    (tmp_path / ".hid.wav").write_bytes(b"")
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    found = audio.discover(spark, str(tmp_path))
    assert [r.track_id for r in found.collect()] == ["bad", "s0", "s1", "s2"] and found.where("format = 'wav'").count() == 3
    marks = audio.landmarks(found).cache()
    assert {r.track_id for r in marks.select("track_id").distinct().collect()} == set(whole)
    path = "file://" + str(tmp_path / "ix")
    ix.save(marks, path, "c")
    stored = ix.load(spark, path, "c", LandmarkConfig())
    ask = spark.createDataFrame([("q", wav(whole["s1"][22000:60000]))], "track_id string, content binary")
    top = mt.rank(mt.probe(mt.query_landmarks(audio.landmarks(ask).withColumnRenamed("track_id", "query_id")), stored)).where("rank = 1").first()
    assert top.track_id == "s1" and abs(AnalysisConfig().seconds(top.best_offset) - 22000 / audio.RATE) < 0.1
    dense = {r.track_id: r for r in audio.density(marks, spark.createDataFrame([("s0", 8.0), ("none", 0.0)], "track_id string, duration_sec double")).collect()}
    assert dense["s0"].per_second == dense["s0"].landmarks / 8 and dense["none"].landmarks == 0 and dense["none"].per_second == 0


def test_landmark_cache(spark, tmp_path):
    rows = [(k, str(i), wav(x)) for i, (k, x) in enumerate(songs().items())] + [("bad", "9", b"junk")]
    files = spark.createDataFrame(rows, "track_id string, sha256 string, content binary")
    at = "file://" + str(tmp_path / "cache")
    first, hits = audio.cached_landmarks(files.where("track_id <> 's2'"), at)
    want = sorted(map(tuple, audio.landmarks(files.select("track_id", "content")).collect()))
    assert hits == 0 and sorted(map(tuple, first.collect())) == [w for w in want if w[0] != "s2"]
    again, hits = audio.cached_landmarks(files, at)
    assert hits == 3 and sorted(map(tuple, again.collect())) == want
    assert audio.cached_landmarks(files, at, LandmarkConfig(fan_out=2))[1] == 0


def test_stored_index_refusals(spark, tmp_path):
    marks = spark.createDataFrame([(k % 7, f"t{k % 3}", k) for k in range(40)], "hash long, track_id string, anchor_frame int")
    path = str(tmp_path / "ix")
    at = "file://" + path
    ix.save(marks, at, "c")
    assert sorted(map(tuple, ix.load(spark, at, "c").select("hash", "track_id", "anchor_frame").collect())) == sorted(map(tuple, marks.collect()))
    with pytest.raises(ix.IndexRefused):
        ix.load(spark, at, "other")
    with pytest.raises(ix.IndexRefused):
        ix.load(spark, at, "c", LandmarkConfig(fan_out=3))
    meta = ix.load.__globals__["META"]
    good = spark.read.schema(meta).json(at + "/meta/catalog=c").first().asDict()
    other = json.dumps({**json.loads(good["config"]), "new": 1})
    for change in ({"format_version": 1}, {"catalog_id": "d"}, {"config": other}, {"config": "{"}, {"postings": 39}, {"unique_hashes": 6}, {"tracks": 2}, {"digest": "1"}):
        spark.createDataFrame([tuple({**good, **change}.values())], meta).write.mode("overwrite").json(at + "/meta/catalog=c")
        with pytest.raises(ix.IndexRefused):
            ix.load(spark, at, "c")


def test_analysis_config():
    cfg = AnalysisConfig().validate()
    assert cfg.seconds(cfg.frame_rate) == 1.0 and abs(cfg.bin_hz - 10.766) < 1e-3
    for bad in ({"hop": 0}, {"hop": 2048}, {"low_hz": 3000.0}, {"high_hz": 6000.0}, {"n_fft": 8192}, {"percentile": 100.0}):
        with pytest.raises(ValueError):
            AnalysisConfig(**bad).validate()


def test_decoding_24_bits():
    x = np.sin(np.arange(3000) / 20) * 0.8
    for width in (2, 3, 4):
        assert np.allclose(audio.decode_wav(wav(x, width))[0], x, atol=2e-4)


def test_degradations():
    x = np.sin(2 * np.pi * 440 * np.arange(22050) / audio.RATE) * 0.4
    for kind in ("white", "pink"):
        y, done = audio.mix_noise(x, 10.0, kind, 3)
        noise = y / done["gain"] - x
        assert abs(10 * np.log10(np.mean(x**2) / np.mean(noise**2)) - 10) < 1e-6 and np.abs(y).max() <= 0.99 + 1e-9
    assert audio.mix_noise(np.zeros(100), 10, "pink", 1)[1] == {"applied": False}
    power = lambda y, hz: np.abs(np.fft.rfft(y))[round(hz * len(y) / audio.RATE)]
    both = x + np.sin(2 * np.pi * 3000 * np.arange(22050) / audio.RATE)
    cut = audio.band_limit(both, None, 1000.0)
    assert power(cut, 3000) < 0.02 * power(both, 3000) and power(cut, 440) > 0.9 * power(both, 440)
    up = audio.shift_pitch(x, 12)
    assert len(up) == len(x) and power(up[2000:-2000], 880) > 3 * power(up[2000:-2000], 440)


def test_synthetic_negatives_have_no_landmarks_of_songs(spark):
    from tidemark.operators import negatives as ng

    made = {r.query_id: audio.decode_wav(bytes(r.content))[0] for r in audio.synthetic_audio(ng.synthetic_plan(spark)).collect()}
    assert len(made) == 12 and len(made["synthetic__negative_silence__d3s__digital"]) == 3 * audio.RATE and not made["synthetic__negative_silence__d10s__digital"].any()
    assert abs(np.std(made["synthetic__negative_noise_white__d5s__w"]) - 0.1) < 0.01 and np.std(made["synthetic__negative_near_silence__d5s__dither"]) < 2e-4


def test_features(spark):
    tone = np.sin(2 * np.pi * 440 * np.arange(30000) / audio.RATE)
    assert audio.features(tone).shape == (96,) and np.isfinite(audio.features(tone)).all() and audio.features(np.zeros(9000)) is None and audio.features(tone[:100]) is None
    assert audio.chroma_mean(tone).argmax() == 9 and audio.mfcc_embedding(tone).shape == (26,)  # A
    assert np.allclose(audio.features(tone), audio.features(tone * 0.1), atol=1e-6)
    rows = spark.createDataFrame([("a", wav(tone)), ("b", b"x")], "track_id string, content binary")
    got = {r.track_id: r.embedding for r in audio.feature_table(rows, "chroma").collect()}
    assert np.argmax(got["a"]) == 9 and got["b"] is None


def test_classifier(spark):
    rng = np.random.default_rng(2)
    centres = {"rock": (0, 0, 3), "jazz": (3, 0, 0), "folk": (0, 3, 0)}
    rows = [(i, g, (np.array(c) + rng.normal(size=3)).tolist()) for i, (g, c) in enumerate(list(centres.items()) * 40)] + [(999, "rock", None)]
    train, held = genre.split(spark.createDataFrame(rows, "id int, genre string, embedding array<double>"), "id", "genre")
    model = genre.train(train, trees=5, depth=2)
    assert held.count() > 5 and genre.accuracy(model, held) > 0.8
    assert set(model.transform(genre.with_vectors(held)).select(F.col("predicted")).distinct().toPandas()["predicted"]) <= set(centres)
