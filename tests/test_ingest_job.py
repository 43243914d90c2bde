import itertools
import json
import os

import numpy as np
import pytest
from pyspark.sql import Row

from voxloom.operators.assemble import Underdelivery
from voxloom.operators.beam import prefix_beam
from voxloom.plans import ingest_job as J
from voxloom.plans.pipeline import Folders
from voxloom.scale import head_and_tail, scratch, shared_folder, split_join, written
from voxloom.sources import sinks
from voxloom.sources.manifests import read_manifest

SPEC = "seq int, phase string, name string, hf_id string, config_name string, split string, samples int, use_streaming boolean, start_offset bigint"


def rows_of(spark, n, first=0, extra="x"):
    return spark.createDataFrame([(i, f"{first + i}", f"/a/{i}.wav", f"text {i}" if i % 5 else " ", 1.0, extra) for i in range(n)], "position bigint, uid string, audio_filepath string, text string, duration double, note string")


@pytest.fixture
def job(spark, tmp_path):
    folders = Folders(str(tmp_path / "buckets"), str(tmp_path / "finals"))
    specs = spark.createDataFrame([(1, "train", "a", "h", "c1", "s", 12, False, 0), (2, "train", "a", "h", "c2", "s", 12, False, 3), (3, "train", "b", "h", "c3", "s", 4, False, 0), (4, "val", "v", "h", "c4", "s", 3, False, 0)], SPEC)
    tables = {"c1": rows_of(spark, 10), "c2": rows_of(spark, 20, 5), "c3": rows_of(spark, 9, 8), "c4": rows_of(spark, 9, 100)}
    return folders, specs, lambda spec: J.TableSource(tables[spec["config_name"]])


def test_fills_in_order_and_resumes(spark, job):
    folders, specs, source_of = job
    finals = J.run(spark, folders, specs, source_of, J.Options(chunk=4))
    bucket = read_manifest(spark, folders.bucket("a"), extra=True).orderBy("ord").collect()
    # the first source gives 1..4 and 6..9, the second goes on behind its offset with keys that aren't there yet
    assert [r["uid"] for r in bucket] == ["1", "2", "3", "4", "6", "7", "8", "9", "11", "12", "13", "14"]
    assert {r["note"] for r in bucket} == {"x"} and "note" in finals["train"].columns
    states = {s["config_name"]: J.state_of(spark, folders, s) for s in specs.collect()}
    assert states["c1"] == {"cursor": 10, "exhausted": True} and states["c2"] == {"cursor": 7, "exhausted": False}
    assert [r["uid"] for r in finals["train"].orderBy("ord").collect()] == [*(r["uid"] for r in bucket), "10"]  # bucket b has 9 to 12, all but one of them taken
    again = J.fill_buckets(spark, folders, specs, "train", source_of)
    assert again["a"] == 12 and read_manifest(spark, folders.bucket("a")).count() == 12


def test_a_stopped_run_leaves_nothing_twice(spark, job):
    folders, specs, source_of = job
    spec = specs.where("seq = 1").first()

    class Breaks(J.TableSource):
        def read(self, first, last):
            if first >= 4:
                raise RuntimeError("gone")
            return super().read(first, last)

    with pytest.raises(RuntimeError):
        J.fill_source(spark, folders, spec, 12, Breaks(source_of(spec).table), J.Options(chunk=4))
    assert J.state_of(spark, folders, spec)["cursor"] == 4
    streamed = Row(**(spec.asDict() | {"use_streaming": True}))
    assert J.fill_source(spark, folders, streamed, 12, source_of(spec), J.Options(chunk=4)) == 8
    assert [r["uid"] for r in read_manifest(spark, folders.bucket("a")).orderBy("ord").collect()] == ["1", "2", "3", "4", "6", "7", "8", "9"]
    assert J.state_of(spark, folders, streamed)["exhausted"] is False
    assert J.fill_source(spark, folders, spec, 3, source_of(spec), J.Options(skip_existing=False)) == 3


def test_short_validation_is_an_error(spark, job):
    folders, specs, source_of = job
    few = specs.where("phase = 'val'").selectExpr(*[c if c != "samples" else "50 as samples" for c in specs.columns])
    with pytest.raises(Underdelivery):
        J.fill_buckets(spark, folders, few, "val", source_of)


def test_command_line(spark, tmp_path):
    from voxloom.__main__ import main

    table = rows_of(spark, 30).drop("position")
    table.coalesce(1).write.parquet(str(tmp_path / "hub/h/c/s"))
    spec = {"name": "a", "hf_id": "h", "config_name": "c", "split": "s", "lang": "en", "samples": 7}
    config = {"paths": {"sources": str(tmp_path / "hub"), "buckets": str(tmp_path / "b"), "finals": str(tmp_path / "f")}, "datasets": {"train": [spec]}}
    (tmp_path / "c.json").write_text(json.dumps(config))
    finals = main([str(tmp_path / "c.json"), "--phases", "train"])
    assert finals["train"].count() == 7


@pytest.mark.parametrize("crash", ["before", "between"])
def test_replacing_survives_a_crash(spark, tmp_path, crash):
    path = str(tmp_path / "m")
    sinks.write_manifest(spark.createDataFrame([(1, "old")], "ord int, text string"), path)
    if crash == "between":  # the old one aside, the new one not yet in
        os.rename(path, path + ".old")
        assert sinks.recover_folder(spark, path)
    else:
        with pytest.raises(ZeroDivisionError):
            sinks.replace_folder(spark.range(1), path, lambda d, p: 1 / 0)
    assert [r["text"] for r in read_manifest(spark, path).collect()] == ["old"]
    sinks.write_manifest(spark.createDataFrame([(1, "new")], "ord int, text string"), path)
    assert [r["text"] for r in read_manifest(spark, path).collect()] == ["new"] and not os.path.exists(path + ".old")


def test_appended_lines_come_last(spark, tmp_path):
    path = str(tmp_path / "m")
    for at, mode in ((0, "overwrite"), (3, "append"), (6, "append")):
        sinks.write_manifest(spark.createDataFrame([(i, str(at + i)) for i in range(3)], "ord int, text string").repartition(2), path, mode, drop=["ord"])
    assert [r["text"] for r in read_manifest(spark, path).orderBy("ord").collect()] == [str(i) for i in range(9)]


def test_heads_and_tails(spark):
    table = written(spark.createDataFrame([(f"k{i}", max(1, 1000 // (i + 1)), i) for i in range(300)] + [("long" * 30, 5000, -1)], "k string, n bigint, v int"))
    for keys in (0, 1, 7, 50, 400):
        head, tail = head_and_tail(table, "k", keys=keys)
        assert head.count() <= keys and head.count() + tail.count() == 301 and tail.where("v = -1").count() == 1
    big = spark.createDataFrame([("k1",)] * 500 + [("k299",), ("none",), (None,), ("long" * 30,)], "k string")
    got = sorted(map(repr, split_join(big, table, "k", keys=10).collect()))
    assert got == sorted(map(repr, big.join(table.drop("n"), "k", "left").collect())) and len(got) == 504


def test_scope_of_written_tables(spark):
    with scratch():
        path = written(spark.range(3)).inputFiles()[0]
        assert os.path.exists(path.removeprefix("file://"))
    assert not os.path.exists(path.removeprefix("file://"))


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://x/y/"}
    assert shared_folder(Session()) == "hdfs://x/y"


@pytest.mark.parametrize("seed", range(6))
def test_beam_equals_all_paths(seed):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet(np.ones(3), size=5)
    sums = {}
    for path in itertools.product(range(3), repeat=5):
        ids = tuple(c for i, c in enumerate(path) if c and (i == 0 or path[i - 1] != c))
        sums[ids] = sums.get(ids, 0.0) + float(np.prod([p[t, c] for t, c in enumerate(path)]))
    assert tuple(prefix_beam(np.log(p), 1000)) == max(sums, key=sums.get)
    model = lambda ids, c: -float(c) * (1 + len(ids))
    bonus = lambda ids: sum(0.3 * model(ids[:k], c) + 0.2 for k, c in enumerate(ids))
    assert tuple(prefix_beam(np.log(p), 1000, model=model, alpha=0.3, beta=0.2)) == max(sums, key=lambda ids: np.log(sums[ids]) + bonus(ids))
    assert prefix_beam(np.zeros((0, 3)), 4) == []
    with pytest.raises(ValueError):
        prefix_beam(np.log(p), 0)
