"""Audio, file formats, streaming metering and similarity kernels."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import similarity as sim
from tidemark.operators import usage as us
from tidemark.sources import audio, files
from tidemark.streaming import usage as stream


def test_tone_gives_peaks_at_its_bin(spark, tmp_path):
    t = np.arange(3 * audio.RATE) / audio.RATE
    x = sum(np.sin(2 * np.pi * f * t) * (np.sin(2 * np.pi * 3 * t) > 0) for f in (500.0, 1200.0))
    (tmp_path / "tone.WAV").write_bytes(audio.encode_wav(x / 2))
    (tmp_path / ".hidden.wav").write_bytes(b"x")
    (tmp_path / "broken.wav").write_bytes(b"RIFFxxxxWAVE")
    (tmp_path / "note.txt").write_bytes(b"x")
    found = audio.discover(spark, str(tmp_path))
    assert sorted((r.track_id, r.format) for r in found.select("track_id", "format").collect()) == [("broken", "wav"), ("tone", "wav")]
    rows = audio.peaks(found).collect()
    assert {r.error is None for r in rows if r.track_id == "tone"} == {True} and all(r.error for r in rows if r.track_id == "broken")
    bins = [r.freq_bin for r in rows if r.track_id == "tone"]
    assert {round(500 * 1024 / audio.RATE), round(1200 * 1024 / audio.RATE)} <= set(bins)
    assert not len(audio.local_peaks(audio.spectrogram(np.zeros(5000)))[0])


def test_rate_noise_and_fixtures():
    x = audio.click_track(120, 2, "a")
    assert abs(len(audio.apply_rate(x, 5.0)) - len(x) / 1.05) < 3 and np.array_equal(x, audio.click_track(120, 2, "a"))
    noisy = audio.add_noise(x, 10.0, 1)
    assert abs(10 * np.log10(np.mean(x**2) / np.mean((noisy - x) ** 2)) - 10) < 1
    back, cut = audio.decode_wav(audio.encode_wav(x), max_seconds=1.0)
    assert cut and len(back) == audio.RATE
    assert len(audio.triads(0, True, 2.0)) > 0


def test_annotation_sheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text('# note\n"# quoted, note"\ntrack_id,path\n,,,\n\nt1,p,T,A,10.0,l,u,120,C,annotated,me,2024-01-01T00:00:00Z,\nt2,p,T,A,-1,l,u,9000,C,annotated,,yesterday,\nt1,p,T,A,10.0,l,u,,,pending,,,\n')
    rows = files.annotation_sheet(spark, str(tmp_path / "s.csv"))
    assert rows.count() == 3
    got = {(r.track_id, r.error) for r in files.annotation_errors(rows).collect()}
    assert got == {("t2", "annotator is missing"), ("t2", "time is not UTC ISO-8601"), ("t2", "bpm is out of range"), ("t2", "duration is not positive"), ("t1", "track_id repeats")}


def test_sidecar(spark, tmp_path):
    """Lists, objects and {"tracks": ...}: an entry is found by either of its ids; entries without a name are dropped."""
    sha, listed = "A" * 64, '[{"sha256": "%s", "track_id": "t1", "title": " Song ", "artist": "None"}, {"track_id": "t2", "title": "none"}, 3, {"track_id": "t3", "artist": "B"}, {"track_id": "t3", "artist": "C"}]' % ("b" * 64)
    listed = listed.replace(", {", ",\n {")
    keyed = '{"%s": {"title": "By hash"}, "t9": {"artist": 7, "year": 1990}, "t8": {"title": "  "}, "t7": 1}' % sha
    of = lambda text: {(r.key_kind, r.key, r.title, r.artist) for r in files.sidecar(spark, written(tmp_path, text)).collect()}
    want = {("sha256", "b" * 64, "Song", None), ("track_id", "t1", "Song", None), ("track_id", "t3", None, "C")}
    assert of(listed) == want and of('{"tracks": %s}' % listed) == want
    want = {("sha256", sha.lower(), "By hash", None), ("track_id", "t9", None, "7")}
    assert of(keyed) == want and of('{"tracks": %s}' % keyed) == want
    assert of("[]") == set()


def written(tmp_path, text):
    (tmp_path / "m.json").write_text(text)
    return str(tmp_path / "m.json")


def test_artifacts(spark, tmp_path):
    root = tmp_path / "art"
    (root / "sub").mkdir(parents=True)
    (root / "a.bin").write_bytes(b"1")
    (root / "sub" / "b.bin").write_bytes(b"22")
    held = files.members(spark, str(root)).collect()
    before = spark.createDataFrame(held)
    assert sorted((r.path, r.bytes) for r in held) == [("a.bin", 1), ("sub/b.bin", 2)]
    (root / "a.bin").write_bytes(b"3")
    (root / "sub" / "b.bin").unlink()
    assert {(r.path, r.problem) for r in files.verify(before, files.members(spark, str(root))).collect()} == {("a.bin", "digest"), ("sub/b.bin", "missing")}


def test_text_functions(spark):
    row = spark.range(1).select(
        tx.normalise(F.lit("  A--b_C ")).alias("a"), tx.base_id(F.lit("x_y_12")).alias("b"), tx.stem(F.lit("/p/a.b.mp3")).alias("c"), tx.permissive(F.lit("https://x/licenses/by-nc/4.0")).alias("d"),
        tx.valid_catalog_id(F.lit("a..b")).alias("e"), tx.version(F.lit(" " + "F" * 64)).alias("f"), F.length(tx.bounded_error(F.lit("e" * 600))).alias("g"),
    ).first()
    assert tuple(row) == ("a b c", "x_y", "a.b", False, False, "f" * 64, 512)


def test_streaming_usage_is_idempotent(spark, tmp_path):
    rows = [(k % 2, k % 3, f"2024-01-0{1 + k % 2} 0{k % 9}:00:00", k, 1.5, k % 2 == 0) for k in range(40)]
    events = spark.createDataFrame(rows, "tenant long, key_id long, t string, event_id long, audio_seconds double, matched boolean").select("tenant", "key_id", F.to_timestamp("t").alias("ts"), "event_id", "audio_seconds", "matched")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    src = stream.read_events(spark, str(tmp_path / "in"), 1)
    for _ in range(2):  # the second run finds nothing new
        stream.write_behind(src, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {tuple(r) for r in stream.usage_table(spark, str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in us.daily(events).collect()}
    q = stream.limited(src, 1 / 3600, 2.0).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.awaitTermination()
    assert spark.table("limited").count() == 40
    w = stream.daily_windows(src).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    w.awaitTermination()
    assert sum(r.request_count for r in spark.table("windows").collect()) == 40


def test_token_bucket_matches_a_loop(spark):
    ev = [(k % 3, float((k * 37) % 200), k) for k in range(120)]
    got = {r.event_id: (r.allowed, r.retry_after) for r in us.token_bucket(spark.createDataFrame(ev, "key_id long, ts double, event_id long"), 0.05, 3.0).collect()}
    state, want = {}, {}
    for k, t, i in sorted(ev, key=lambda e: (e[0], e[1], e[2])):
        tokens, last = state.get(k, (3.0, None))
        tokens, ok, wait = us.bucket_step(tokens, last, t, 0.05, 3.0)
        state[k] = (tokens, t if last is None else max(last, t))
        want[i] = (ok, wait)
    assert got == want


def test_dtw_and_resize(spark):
    a, b = np.array([1.0, 2, 3, 4]), np.array([1.0, 1, 2, 3, 4, 4])
    assert sim.dtw(a, b) == 0 and sim.dtw(a, a + 1) > 0
    r = sim.resize(spark.createDataFrame([([0.0, 10.0, 20.0],)], "m array<double>"), "m", 4).first().m
    assert [round(x, 6) for x in r] == [0.0, 10.0, 20.0, 20.0]
