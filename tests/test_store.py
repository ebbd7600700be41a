"""Catalogs and artifacts as files, hashes against plain Python, and refusals."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import store as st

TRACKS = [("b", "x/b.WAV", "b" * 64, 2.5, 10, 3, "T", None), ("a\"é", "x/a.mp3", "a" * 64, 1.5, 20, 4, None, "A")]


def tracks(spark, rows=TRACKS):
    return spark.createDataFrame(rows, st.CATALOG_TRACK)


def test_pair_hash_is_that_of_the_json_text(spark):
    rows = [("g", t[0], t[2]) for t in TRACKS] + [("h", "z", "0" * 64), ("g", "b", "c" * 64)]
    got = {r.c: (r.track_count, r.content_hash) for r in st.pair_hash(spark.createDataFrame(rows, "c string, k string, d string"), "c", "k", "d").collect()}
    for g in "gh":
        pairs = sorted([k, d] for c, k, d in rows if c == g)
        assert got[g] == (len(pairs), hashlib.sha256(json.dumps(pairs).encode()).hexdigest())


def test_catalog_round_trip_and_refusal(spark, tmp_path):
    at = str(tmp_path / "cat")
    st.save_catalog(tracks(spark), at, "c1")
    assert sorted(map(tuple, st.load_catalog(spark, at).collect())) == sorted(TRACKS, key=lambda t: t[0])
    tracks(spark, TRACKS[:1]).write.mode("overwrite").json(at + "/tracks")
    with pytest.raises(ValueError):
        st.load_catalog(spark, at)
    with pytest.raises(ValueError):
        st.load_catalog(spark, str(tmp_path / "none"))


def test_artifacts_are_immutable(spark, tmp_path):
    source, v = tmp_path / "src", "AB" * 32
    (source / "sub").mkdir(parents=True)
    (source / "one").write_bytes(b"1")
    (source / "sub" / "two").write_bytes(b"22")
    store = st.ArtifactStore(spark, "file://" + str(tmp_path / "store"))
    assert not store.exists("c", v) and store.list_catalogs() == []
    at = store.put("c", f" {v} ", "file://" + str(source))
    assert at.endswith(v.lower()) and store.put("c", v, "file://" + str(source)) == at
    assert store.exists("c", v) and store.list_versions("c") == [v.lower()] and store.list_catalogs() == ["c"]
    held = store.get("c", v, "file://" + str(tmp_path / "out"))
    assert (tmp_path / "out" / "sub" / "two").read_bytes() == b"22" and set(held["members"]) == {"one", "sub/two"}
    (source / "one").write_bytes(b"3")
    with pytest.raises(st.ArtifactConflict):
        store.put("c", v, "file://" + str(source))
    members = tmp_path / "store" / "catalogs" / "c" / v.lower() / "members"
    (members / ".one.crc").unlink()  # else the file system refuses first
    (members / "one").write_bytes(b"9")
    with pytest.raises(st.ArtifactIncomplete):
        store.get("c", v, "file://" + str(tmp_path / "out"))
    for bad in [("../c", v), ("c", "12")]:
        with pytest.raises(st.StorageError):
            store.exists(*bad)
    with pytest.raises(st.StorageError):
        store.get("c", "0" * 64, "file://" + str(tmp_path / "out"))


def test_catalog_delete_takes_children(spark):
    cats = spark.createDataFrame([("a",), ("b",)], "catalog_id string")
    rest, kids = st.delete_catalog(cats, {"t": spark.createDataFrame([("a", 1), ("b", 2)], "catalog_id string, n int")}, "a")
    assert [r.catalog_id for r in rest.collect()] == ["b"] and [r.n for r in kids["t"].collect()] == [2]


def test_manifest_and_negative_set_round_trips(spark, tmp_path):
    from tidemark.sources import files

    track = files.TRACK[len("struct<") : -1].replace(":", " ")
    rows = [("b", "p", "b" * 64, "s", "CC-BY", "u", 1.5, 10, "T", None, "g", None, False), ("a", "q", "a" * 64, "s", "CC0-1.0", "u", 2.5, 20, None, "A", "g", None, True)]
    at = str(tmp_path / "m")
    files.save_manifest(spark.createDataFrame(rows, track), at)
    got = files.manifest(spark, at).collect()
    assert [tuple(r)[2:] for r in got] == sorted(rows) and got[0].content_hash == hashlib.sha256(json.dumps([["a", "a" * 64], ["b", "b" * 64]]).encode()).hexdigest()
    kinds = [k[len("array<struct<") : -2].replace(":", " ") for k in (files.SOURCE, files.EXCERPTS)]
    sources = [("t", "p", "c" * 64, 9.0, "CC0-1.0", "u", "s", None, None, "T", "fetched")]
    excerpts = [("q2", "music", "t", 4.0, 3.0, "evaluation", None), ("q1", "music", "t", 1.0, 3.0, "evaluation", None)]
    files.save_negative_set(spark.createDataFrame(sources, kinds[0]), spark.createDataFrame(excerpts, kinds[1]), str(tmp_path / "n"))
    s, e = files.negative_set(spark, str(tmp_path / "n"))
    assert list(map(tuple, s.collect())) == sources and list(map(tuple, e.collect())) == sorted(excerpts)


def test_detectors_are_judged_one_by_one(spark):
    from tidemark.operators import items as it
    from tidemark.operators import reports as rp

    def detector(content):
        if bytes(content) == b"boom":
            raise RuntimeError("no sound")
        return {"bpm": 120 if bytes(content) == b"ok" else "fast", "key": "Db minor", "timings": {"bpm_ms": 1.5, "key_ms": -1}}

    items = spark.createDataFrame([("a", b"ok"), ("b", b"boom"), ("c", b"odd")], "track_id string, content binary")
    rows = rp.run_detector(items, detector).withColumns({"b": it.bpm_prediction(F.col("bpm")), "k": it.key_prediction(F.col("key")), "t": it.timings(F.col("timings"))}).collect()
    got = {r.track_id: (r.b.value, r.k.value, r.t.valid, r.t.unavailable, r.error) for r in rows}
    assert got["a"] == (120.0, "C# minor", {"bpm_ms": 1.5}, ["key_ms"], None)
    assert got["b"][:2] == (None, None) and got["b"][4].startswith("RuntimeError") and got["c"][0] is None and got["c"][1] == "C# minor"


def test_parts_of_a_manifest_are_one_object(spark, tmp_path):
    """The parts, one after another, are the single JSON object of the format; a file laid out otherwise is read too."""
    from tidemark.sources import files

    track = files.TRACK[len("struct<") : -1].replace(":", " ")
    rows = [(f"t{i:03d}", 'p "q", {x}', "a" * 64, "s", "CC-BY" if i % 2 else None, "u", 1.5, 10, "T\\n", None, "g", None, False) for i in range(50)]
    at = tmp_path / "m"
    files.save_manifest(spark.createDataFrame(rows, track).repartition(7), str(at))
    whole = json.loads("".join(p.read_text() for p in sorted(at.glob("part-*"))))
    assert [t["track_id"] for t in whole["tracks"]] == [r[0] for r in rows] and whole["track_count"] == 50 and whole["license_counts"] == {"": 25, "CC-BY": 25}
    (tmp_path / "one.json").write_text(json.dumps(whole, indent=2))
    for path in (at, tmp_path / "one.json"):
        assert sorted(tuple(r)[2:] for r in files.manifest(spark, str(path)).collect()) == rows
    files.save_manifest(spark.createDataFrame([], track), str(tmp_path / "e"))
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "e").glob("part-*"))))["tracks"] == [] and files.manifest(spark, str(tmp_path / "e")).count() == 0
