import numpy as np
from pyspark.sql import functions as F

from voxloom.operators import decode as D
from voxloom.operators import signal as G
from voxloom.sources import audio


def _fake(table):
    """A joint that looks up (frame, tokens so far) and is blank elsewhere; frames hold their own index."""

    def networks():
        predictor = lambda tokens: np.array([len(tokens) - 1, tokens[-1]])

        def joint(frame, state):
            token, jump = table.get((int(frame[0]), int(state[0])), (0, 0))
            return np.eye(4)[token], np.eye(4)[jump]

        return predictor, joint

    return networks


def test_rnnt():
    predictor, joint = _fake({(0, 0): (1, 0), (1, 1): (2, 0)})()
    frames = np.arange(3)[:, None]
    stats = D.DecodeStats()
    assert D.greedy(frames, predictor, joint, most_per_frame=2, stats=stats) == [1, 2]
    assert (stats.steps, stats.blanks) == (5, 3)
    always = lambda f, s: (np.eye(4)[3], None)
    assert D.greedy(frames, predictor, always, most_per_frame=2) == [3] * 6
    assert D.greedy(frames[:0], predictor, joint) == []


def test_tdt():
    predictor, joint = _fake({(0, 0): (1, 2), (3, 1): (2, 1)})()
    assert D.greedy(np.arange(6)[:, None], predictor, joint, durations=True) == [1, 2]
    predictor, joint = _fake({(1, 0): (1, 3)})()
    assert D.greedy(np.arange(4)[:, None], predictor, joint, durations=True) == [1]


def test_decode_in_spark(spark):
    rows = spark.createDataFrame([(1, [[0.0], [1.0], [2.0]]), (2, []), (3, None)], "utt_id bigint, frames array<array<double>>")
    got = {r["utt_id"]: r["ids"] for r in D.decode(rows, _fake({(0, 0): (1, 0), (1, 1): (2, 0)}), most_per_frame=2).collect()}
    assert got == {1: [1, 2], 2: [], 3: []}


def test_transcribe(spark):
    rows = spark.createDataFrame([("a", [0.0]), ("b", [0.0, 1.0])], "path string, samples array<float>")
    assert dict(D.transcribe(rows, lambda: lambda xs: [str(len(x)) for x in xs]).collect()) == {"a": "1", "b": "2"}


def test_wav_round_trip_and_lengths(spark, tmp_path):
    tone = np.sin(np.arange(8000) / 20).astype(np.float32) * 0.5
    data = G.write_wav(tone, 8000)
    x, rate = G.read_wav(data)
    assert rate == 8000 and np.abs(x - tone).max() < 1e-4
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.wav").write_bytes(data)
    (tmp_path / "b.wav").write_bytes(b"nothing")
    (tmp_path / "c.txt").write_bytes(b"text")
    files = audio.audio_files(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r["seconds"] for r in audio.probe(files).collect()}
    assert got == {"a.wav": 1.0, "b.wav": None}
    one = audio.decoded(files.where("path like '%a.wav'")).first()
    assert len(one["samples"]) == 8000 and one["rate"] == 8000


def test_resample_keeps_a_tone():
    t = np.arange(16000) / 16000
    x = np.sin(2 * np.pi * 440 * t)
    y = G.resample(x, 16000, 8000)
    assert len(y) == 8000 and np.abs(y[100:-100] - np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)[100:-100]).max() < 0.02
    assert len(G.telephone(x)) == 16000
    assert len(G.resample(x, 16000, 44100)) == 44100


def test_log_mel():
    m = G.log_mel(np.random.default_rng(0).normal(size=32001).astype(np.float32))
    assert m.shape == (201, 80) and m.max() - m.min() <= 80.0001
    assert G.log_mel(np.zeros(0, np.float32)).shape == (0, 80)


def test_augmentations():
    x = np.random.default_rng(1).normal(size=1000).astype(np.float32) * 0.1
    assert len(G.change_speed(x, 1.1)) == round(1000 / 1.1) and np.array_equal(G.change_speed(x, 1.0), x)
    assert np.allclose(G.reverberate(x, np.array([1.0, 0, 0])), x)
    noisy = G.add_noise(x, np.ones(10, np.float32), 20.0)
    ratio = np.mean(x**2) / np.mean((noisy - x) ** 2)
    assert abs(10 * np.log10(ratio) - 20) < 0.1
    segments = G.noise_segments(x, 100, 1, segment_s=2)
    assert segments and all(len(s) == 200 for s in segments)
    assert G.noise_segments(x[:50], 100, 1) == [] and G.noise_segments(np.zeros(1000), 100, 1) == []


def test_clean_rows_are_untouched(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], True), (2, [1.0, 2.0], False)], "i int, x array<float>, clean_pass boolean")
    doubled = G.samples_udf(lambda x: 2 * x)
    out = dict(rows.select("i", F.when(F.col("clean_pass"), F.col("x")).otherwise(doubled(F.col("x")))).collect())
    assert out == {1: [1.0, 2.0], 2: [2.0, 4.0]}


def test_bank(spark):
    clips = spark.createDataFrame([(i, [float(i)] * n) for i, n in enumerate([16000, 100, 20000, 0])], "clip_id int, samples array<float>")
    assert {r["clip_id"] for r in audio.bank(clips, least_s=0.5).collect()} == {0, 2}
    assert audio.bank(clips.limit(0)).count() == 0
    many = spark.createDataFrame([(i, [1.0, -3.0]) for i in range(10)], "clip_id int, samples array<float>")
    assert audio.bank(many, most_items=4).count() == 4
    assert abs(sum(map(abs, audio.bank(many, responses=True).first()["samples"])) - 1) < 1e-6
    packed = audio.packed_bank(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "clip_id int, samples array<float>")).orderBy("clip_id").collect()
    assert [(r["samples"], r["length"]) for r in packed] == [([1.0, 0.0], 1), ([1.0, 2.0], 2)]


def test_sample_audio(spark):
    import pytest

    schema = "a struct<array:array<float>,sampling_rate:int,bytes:binary,path:string>"
    data = G.write_wav(np.zeros(10), 8000)
    rows = spark.createDataFrame([(([0.5], 16000, None, None),), ((None, None, data, None),)], schema)
    got = [(len(r["r"]["samples"]), r["r"]["rate"]) for r in rows.select(audio.sample_audio(F.col("a")).alias("r")).collect()]
    assert got == [(1, 16000), (10, 8000)]
    with pytest.raises(Exception, match="neither samples nor bytes"):
        spark.createDataFrame([((None, None, None, "p"),)], schema).select(audio.sample_audio(F.col("a"))).collect()


def test_augmented_rows(spark):
    from voxloom.operators.augment import Augment, augmented, with_banks

    x = [float(v) for v in np.sin(np.arange(400)) * 0.3]
    rows = spark.createDataFrame([(i, x, i % 2 == 0) for i in range(6)] + [(9, None, False)], "ord int, samples array<float>, clean_pass boolean")
    noise = spark.createDataFrame([([0.5] * 50,)], "samples array<float>")
    config = Augment(speed_prob=0, gain_prob=1.0, noise_prob=1.0, rir_prob=1.0, start_epoch=1, heavy_epoch=2)
    same = lambda a: np.allclose(a, x, atol=1e-6)
    before = {r["ord"]: r["samples"] for r in augmented(rows, config, 0, noise).collect()}
    assert all(same(before[i]) for i in range(6)) and before[9] is None
    after = {r["ord"]: r["samples"] for r in augmented(rows, config, 2, noise, noise).collect()}
    assert [same(after[i]) for i in range(6)] == [True, False] * 3
    assert after == {r["ord"]: r["samples"] for r in augmented(rows.repartition(3), config, 2, noise, noise).collect()}
    assert with_banks(Augment(), 1, 0).noise_prob == 0.4 and with_banks(Augment(noise_prob=0.2), 1, 1).noise_prob == 0.2


def test_more_waveforms():
    x = np.sin(np.arange(16000)).astype(np.float32)
    gaps = G.mute_gaps(x, 3)
    assert len(gaps) == len(x) and (np.abs(gaps) <= np.abs(x) + 1e-6).all() and not np.array_equal(gaps, x)
    assert np.array_equal(G.add_noise(x, np.zeros(5), 10), x)
    assert len(G.add_gaussian(x, 0.1, np.random.default_rng(0))) == len(x)
    room = np.zeros(4000)
    room[100], room[101:300] = 1.0, 0.1
    assert np.argmax(np.abs(G.room_response(room, 16000))) == 0 and G.room_response(room[:10], 16000) is None
    assert G.room_response(np.zeros(4000), 16000) is None


def test_tokenizer_columns(spark):
    from voxloom.operators import reports, tokens

    rows = spark.createDataFrame([(1, "ab c", "en"), (2, None, "en"), (3, " ", "pl")], "ord int, text string, language string")
    ids = tokens.tokenize(tokens.Words)
    assert [r[0] for r in rows.select(ids(F.col("text"))).collect()] == [[2, 1], None, [0]]
    back = tokens.detokenize(tokens.Words)
    shifted = spark.createDataFrame([([3, 0, 2],), ([0],), (None,)], "ids array<int>")
    assert [r[0] for r in shifted.select(back(F.col("ids"))).collect()] == ["xx x", "", None]
    assert [tuple(r) for r in reports.coverage(rows, ids, unknown=1).collect()] == [("en", 1, 4, 2, 1)]
