import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from voxloom.functions.arrays import schedule
from voxloom.operators.decode import transcribe_files
from voxloom.operators.signal import mute_gaps, read_wav, reverberate, write_wav
from voxloom.sources.archives import fetched, unpacked
from voxloom.sources.audio import audio_files, load_bank, probe
from voxloom.sources.manifests import check_source_split
from voxloom.streaming.ingest import rate_limited
from voxloom.streaming.supervise import Watch, looked, supervise


def test_archives(tmp_path):
    (tmp_path / "in/top").mkdir(parents=True)
    (tmp_path / "in/top/a.txt").write_text("a")
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as t:
        t.add(tmp_path / "in/top", "top")
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a.txt", "a")
        z.writestr("b/c.txt", "c")
    for name in ("x.tar.gz", "x.zip"):
        archive = fetched(str(tmp_path / name), str(tmp_path / "cache"))
        target = str(tmp_path / f"out-{name}")
        assert unpacked(archive, target) and not unpacked(archive, target)
        assert (tmp_path / f"out-{name}/a.txt").read_text() == "a"
        assert fetched(str(tmp_path / name), str(tmp_path / "cache")) == archive
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../evil.txt", "x")
    with pytest.raises(ValueError):
        unpacked(tmp_path / "bad.zip", str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists() and not (tmp_path / "evil.txt").exists()


def test_looks_at_a_job():
    w = Watch("big", 5)
    for _ in range(5):
        w, act = looked(w, True, 5)
        assert act == "wait"
    assert looked(w, True, 5) == (Watch("big", 5), "kill")
    assert looked(w, True, 6) == (Watch("big", 6), "wait")
    assert looked(Watch("big", 0, 9), True, 0)[1] == "wait"
    assert looked(w, False, 7, "OutOfMemoryError", ["big", "small"]) == (Watch("small", 7), "start")
    assert looked(Watch("small", 7), False, 7, "OutOfMemoryError", ["big", "small"]) == (Watch("small", 7), "start")
    assert looked(w, False, 7, "gone", ["big", "small"]) == (Watch("big", 7), "start")


def test_supervises():
    class Job:
        at, started, stopped = 3, [], 0

        def running(self):
            return len(self.started) != 1

        def step(self):
            return self.at

        def failure(self):
            return "OutOfMemoryError"

        def stop(self):
            self.stopped += 1

        def start(self, preset):
            self.started.append(preset)

    job, pauses = Job(), []
    supervise(job, ["big", "small"], looks=7, sleep=pauses.append)
    assert job.started == ["big", "small"] and job.stopped == 1 and pauses == [300.0] * 7


def test_causes_in_a_circle():
    a, b = ValueError("x"), ValueError("HTTP 429")
    a.__context__, b.__context__ = b, a
    assert rate_limited(a) and not rate_limited(ValueError("y"))


def test_waveforms():
    import numpy as np

    x = np.sin(np.arange(16000) / 9).astype(np.float32)
    y = mute_gaps(x, 3)
    assert len(y) == len(x) and 0 < np.mean(np.abs(y) < np.abs(x)) < 0.5 and np.array_equal(y, mute_gaps(x, 3))
    assert len(mute_gaps(x[:3], 1)) == 3
    r = np.random.default_rng(0).normal(0, 1, 500).astype(np.float32)
    assert np.allclose(reverberate(x, r), np.convolve(x, r)[: len(x)], atol=1e-3)
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1), f.setsampwidth(3), f.setframerate(8000)
        f.writeframes(b"".join(int(v * 8388607).to_bytes(3, "little", signed=True) for v in x[:99]))
    back, rate = read_wav(out.getvalue())
    assert rate == 8000 and np.allclose(back, x[:99], atol=1e-6)


def test_lists_and_folders_are_united(spark, tmp_path):
    import numpy as np

    (tmp_path / "f").mkdir()
    for name in ("f/a.wav", "f/b.txt", "c.wav"):
        (tmp_path / name).write_bytes(write_wav(np.ones(1600, np.float32) / 2, 16000))
    listed = spark.createDataFrame([(str(tmp_path / "c.wav"),), (str(tmp_path / "f/a.wav"),)], "path string")
    found = probe(audio_files(spark, str(tmp_path / "f"), listed=listed)).collect()
    assert sorted((r["path"].rsplit("/")[-1], r["seconds"]) for r in found) == [("a.wav", 0.1), ("c.wav", 0.1)]
    assert load_bank(spark, str(tmp_path / "f"), least_s=0.05).count() == 1 and load_bank(spark, str(tmp_path / "none")).count() == 0
    texts = transcribe_files(spark, [str(tmp_path / "c.wav")], lambda: lambda waves: [str(len(w)) for w in waves]).collect()
    assert [r["text"] for r in texts] == ["1600"]


def test_schedulers_and_splits(spark):
    step = spark.range(1).select(schedule("noam", F.lit(9), 100, 0.1).alias("n"), schedule("cosine", F.lit(9), 100, 0.1).alias("c")).first()
    assert step["n"] == 1.0 and step["c"] == 1.0
    with pytest.raises(ValueError):
        schedule("other", F.lit(1), 10, 0.1)
    assert check_source_split("train.clean.100") and check_source_split("validation[:5%]")
    with pytest.raises(ValueError):
        check_source_split("everything")
