import json
import tarfile

import numpy as np
import pytest

from voxloom.operators import signal as G
from voxloom.plans import pipeline
from voxloom.sources import manifests, sinks

ROW = {"uid": "u", "audio_filepath": "a.wav", "text": "zażółć", "duration": 1.5, "language": "pl", "dataset": "d", "source": "s"}


def jsonl(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in rows), "utf-8")
    return str(path)


def test_read_manifest(spark, tmp_path):
    path = jsonl(tmp_path / "m.jsonl", ROW, "", "   ", ROW | {"uid": "v", "duration": "2.5", "extra": 1}, ROW | {"uid": "w", "duration": None})
    rows = manifests.typed(manifests.read_manifest(spark, path)).orderBy("ord").collect()
    assert [(r["uid"], r["duration"]) for r in rows] == [("u", 1.5), ("v", 2.5), ("w", None)]
    assert manifests.read_manifest(spark, str(tmp_path / "absent"), missing="empty").count() == 0
    with pytest.raises(Exception):
        manifests.read_manifest(spark, str(tmp_path / "absent")).count()


def test_bad_json(spark, tmp_path):
    path = jsonl(tmp_path / "m.jsonl", ROW, "{not json")
    assert manifests.read_manifest(spark, path).where("uid is null").count() == 1
    with pytest.raises(Exception, match="invalid JSON"):
        manifests.read_manifest(spark, path, strict=True).collect()


def test_lines_keep_their_order_over_blocks(spark, tmp_path):
    path = jsonl(tmp_path / "m.txt", *[f"line {i}" for i in range(5000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = manifests.lines(spark, path).orderBy("ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["ord"], r["value"]) for r in got] == [(i, f"line {i}") for i in range(5000)]


def test_manifest_round_trip(spark, tmp_path):
    source = manifests.typed(manifests.read_manifest(spark, jsonl(tmp_path / "m.jsonl", ROW, ROW | {"uid": None})))
    out = str(tmp_path / "out.jsonl")
    sinks.write_manifest(source, out)
    sinks.write_manifest(source, out)
    again = manifests.typed(manifests.read_manifest(spark, out))
    assert sorted(again.drop("ord").collect(), key=str) == sorted(source.drop("ord").collect(), key=str)
    sinks.write_manifest(source, out, mode="append")
    assert manifests.read_manifest(spark, out).count() == 4
    copy = sinks.backup(spark, out, str(tmp_path / "backups"))
    assert manifests.read_manifest(spark, copy).count() == 4
    assert sinks.backup(spark, str(tmp_path / "absent"), str(tmp_path / "backups")) is None


def test_results_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1.5)], "x string, y int, z double")
    sinks.write_results(df, str(tmp_path / "r"))
    text = next((tmp_path / "r").glob("*.csv")).read_text()
    assert text.split() == ["x,y,z", "a,-,1.5"]
    assert json.loads(sinks.report_json(df)) == [{"x": "a", "z": 1.5}]


def test_corpus_counts(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a"), (1, "b\nc"), (2, " ")], "ord bigint, text string")
    assert sinks.write_corpus(rows, str(tmp_path / "c"), 1) == 1
    assert sinks.write_corpus(rows, str(tmp_path / "c"), 0) == 2 and spark.read.text(str(tmp_path / "c")).count() == 0
    assert sinks.write_corpus(rows, str(tmp_path / "c")) == 2
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "c")).collect()) == ["a", "b c"]


def test_shards(spark, tmp_path):
    rows = [(i, f"{i}.wav", "t", "en", 1.0, b"x%d" % i if i != 1 else None) for i in range(5)]
    df = spark.createDataFrame(rows, "ord bigint, audio_filepath string, text string, language string, duration double, content binary")
    got = sorted(map(tuple, sinks.write_shards(df, str(tmp_path), 2, 2, missing="skip").collect()))
    assert got == [("000000", 1, 1), ("000001", 2, 0)]
    with tarfile.open(tmp_path / "000001.tar") as tar:
        assert tar.getnames() == ["000000002.wav", "000000002.json", "000000003.wav", "000000003.json"]
        assert json.load(tar.extractfile("000000003.json")) == {"text": "t", "language": "en", "duration": 1.0}
    with pytest.raises(Exception):
        sinks.write_shards(df, str(tmp_path), 2).collect()


def test_resampled(spark, tmp_path):
    data = G.write_wav(np.zeros(8000), 8000)
    df = spark.createDataFrame([("a.wav", None, data), ("b.wav", 3.0, b"bad")], "audio_filepath string, duration double, content binary")
    got = {r["status"]: r for r in sinks.write_resampled(df, str(tmp_path / "w")).collect()}
    assert got["ok"]["duration"] == 1.0 and G.read_wav(open(got["ok"]["audio_filepath"], "rb").read())[1] == 16000
    assert got["failed"]["audio_filepath"] == "b.wav" and got["failed"]["duration"] == 3.0


def test_vocabulary_and_lists(spark, tmp_path):
    (tmp_path / "v").write_text('<unk>\t0\n"\t-1.5\n▁a\t-2\n', "utf-8")
    assert [tuple(r) for r in manifests.vocabulary(spark, str(tmp_path / "v")).orderBy("id").collect()] == [(0, "<unk>", 0.0), (1, '"', -1.5), (2, "▁a", -2.0)]
    (tmp_path / "l").write_text(" a.wav \n\nb.wav\n")
    assert sorted(r[0] for r in manifests.path_list(spark, str(tmp_path / "l")).collect()) == ["a.wav", "b.wav"]


def test_config(tmp_path, monkeypatch):
    (tmp_path / "configs").mkdir()
    (tmp_path / "configs" / "x.json").write_text('{"training": {"max_train_hours": 2}}')
    monkeypatch.chdir(tmp_path)
    config = manifests.load_config("configs/x.json")
    assert pipeline.max_hours(None, config) == 2 and pipeline.max_hours(1.0, config) == 1.0
    with pytest.raises(FileNotFoundError):
        manifests.resolve_config("absent")


def test_rebuild(spark, tmp_path):
    row = lambda u, d, p="x.wav": ROW | {"uid": u, "dataset": d, "audio_filepath": p}
    folders = pipeline.Folders(str(tmp_path / "buckets"), str(tmp_path / "finals"))
    jsonl(tmp_path / "buckets" / "A.jsonl", row("1", "A"), row("2", "A"), row("2", "A"))
    jsonl(tmp_path / "buckets" / "B.jsonl", row("2", "B"), row("3", "B"))
    jsonl(tmp_path / "buckets" / "V.jsonl", row("7", "V", "far/1"), row("8", "V", "near/1"))
    spec = {"hf_id": "h", "split": "s", "lang": "pl", "samples": 2}
    config = {"datasets": {"train": [spec | {"name": "A"}, spec | {"name": "B", "samples": 1}], "val": [spec | {"name": "V", "samples": 1}, spec | {"name": "F", "samples": 1}]}}
    specs = manifests.specs_of(spark, config, "train").unionByName(manifests.specs_of(spark, config, "val"))
    out = pipeline.rebuild(spark, folders, specs, mixed=("V", "far/", "F"), backups=str(tmp_path / "backups"))
    assert [r["uid"] for r in out["train"].orderBy("ord").collect()] == ["1", "2", "3"]
    assert [(r["uid"], r["dataset"]) for r in out["val"].orderBy("ord").collect()] == [("8", "V"), ("7", "F")]
    assert out["comparison"].count() == 4


def test_stored_samples(spark, tmp_path):
    data = G.write_wav(np.ones(800) * 0.1, 8000)
    (tmp_path / "own.wav").write_bytes(data)
    schema = "name string, text string, audio struct<array:array<float>,sampling_rate:int,bytes:binary,path:string>"
    rows = [
        ("a", "t", (None, None, data, "x/y.wav")), ("b", "t", ([0.1] * 800, 8000, None, None)), ("c", "t", (None, None, None, str(tmp_path / "own.wav"))),
        ("d", "t", (None, None, b"bad", "z.wav")), ("e", "t", ([], 8000, None, None)), ("f", "t", (None, None, None, "absent")), ("g", "t", None),
    ]
    got = {r["name"]: (r["audio_filepath"].rsplit("/", 1)[1], r["duration"]) for r in sinks.store_samples(spark.createDataFrame(rows, schema), str(tmp_path / "out")).collect()}
    assert got == {"a": ("a.wav", 0.1), "b": ("b.wav", 0.1), "c": ("own.wav", 0.1)}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.wav", "b.wav"]
    assert abs(G.read_wav((tmp_path / "out" / "b.wav").read_bytes())[0].max() - 1) < 1e-3


def test_stored_samples_of_other_kinds_stay(spark, tmp_path):
    from voxloom.operators.assemble import check_failures

    flac, mp3, empty = b"fLaC\0\0\0\x22" + b"\1" * 40, b"ID3\4" + b"\0" * 40, G.write_wav(np.zeros(0), 8000)
    (tmp_path / "own.mp3").write_bytes(mp3)
    (tmp_path / "bad.wav").write_bytes(b"bad")
    schema = "name string, audio struct<array:array<float>,sampling_rate:int,bytes:binary,path:string>"
    rows = [
        ("a", (None, None, flac, "x/y.flac")), ("b", (None, None, flac, None)), ("c", (None, None, mp3, "z.wav")), ("d", (None, None, None, str(tmp_path / "own.mp3"))),
        ("e", (None, None, b"bad", "z.wav")), ("f", (None, None, None, str(tmp_path / "bad.wav"))), ("g", (None, None, empty, "z.wav")), ("h", None), ("i", ([0.1] * 800, 8000, None, None)),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r["name"]: (r["audio_filepath"].rsplit("/", 1)[1], r["duration"], r["status"]) for r in sinks.store_samples(df, str(tmp_path / "out")).collect()}
    assert got == {"a": ("a.flac", None, "unread"), "b": ("b.audio", None, "unread"), "c": ("c.wav", None, "unread"), "d": ("own.mp3", None, "unread"), "i": ("i.wav", 0.1, "ok")}
    assert (tmp_path / "out" / "a.flac").read_bytes() == flac
    every = sinks.sample_outcomes(df, str(tmp_path / "every"))
    assert {r["name"]: r["status"] for r in every.collect() if r["name"] in "efgh"} == {"e": "failed", "f": "failed", "g": "empty", "h": "missing"}
    assert every.where("duration is null").count() == 8 and check_failures(every, 2) == 2


def test_rebuild_splits_a_bucket_under_a_uri(spark, tmp_path):
    row = lambda u, d, p="x.wav": ROW | {"uid": u, "dataset": d, "audio_filepath": p}
    folders = pipeline.Folders((tmp_path / "buckets").as_uri(), (tmp_path / "finals").as_uri())
    jsonl(tmp_path / "buckets" / "A.jsonl", row("1", "A"))
    jsonl(tmp_path / "buckets" / "V.jsonl", row("7", "V", "far/1"), row("8", "V", "near/1"))
    jsonl(tmp_path / "buckets" / "F.jsonl", row("9", "F", "far/2"))
    spec = {"hf_id": "h", "split": "s", "lang": "pl", "samples": 1}
    config = {"datasets": {"train": [spec | {"name": "A"}], "val": [spec | {"name": "V"}, spec | {"name": "F", "samples": 2}]}}
    specs = manifests.specs_of(spark, config, "train").unionByName(manifests.specs_of(spark, config, "val"))
    out = pipeline.rebuild(spark, folders, specs, mixed=("V", "far/", "F"))
    assert [(r["uid"], r["dataset"]) for r in out["val"].orderBy("ord").collect()] == [("8", "V"), ("9", "F"), ("7", "F")]
