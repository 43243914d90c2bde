import random

import pytest
from pyspark.sql import functions as F

from voxloom.operators import scoring as S
from voxloom.schema import HYPOTHESIS


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def hyp(spark, *rows):
    """(id, reference, hypothesis[, decode_type, beam_width, alpha, beta, language])"""
    full = []
    for i, r, h, *more in rows:
        kind, width, a, b, lang = [*more, *["greedy", None, None, None, "en"][len(more) :]]
        full.append((i, "val", lang, "d", r, h, kind, width, a, b))
    return spark.createDataFrame(full, HYPOTHESIS)


def test_distances_equal_the_fold(spark):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choices(["a", "b", "żółw", "zolw", "C", "c", "d-e"], k=rng.randint(0, 12)))
    pairs = [(i, text(), text()) for i in range(80)]
    for r in S.with_errors(hyp(spark, *pairs)).collect():
        a, b = r["reference"].strip().lower(), r["hypothesis"].strip().lower()
        want = (lev(a.split(), b.split()), len(a.split()), lev(a, b), len(a)) if a else (0, 0, 0, 0)
        assert (r["wer_num"], r["wer_den"], r["cer_num"], r["cer_den"]) == want


def test_edge_cases(spark):
    got = {r["utt_id"]: tuple(r[c] for c in S.SUMS[1:]) for r in S.with_errors(hyp(spark, (1, "  ", "abc"), (2, None, "x"), (3, "a b", None), (4, "A  B ", " a b"))).collect()}
    assert got == {1: (0, 0, 0, 0), 2: (0, 0, 0, 0), 3: (2, 2, 3, 3), 4: (0, 2, 1, 4)}


def test_full_rollup_drops_null_parameters(spark):
    rows = hyp(spark, (1, "a", "a"), (2, "a b", "a", "beam_kenlm", 4, 0.5, 1.0))
    metrics = S.split_metrics(rows)
    full = lambda flag: {r["decode_type"] for r in S.rollup(metrics, flag).where("split = 'full'").collect()}
    assert full(False) == {"beam_kenlm"} and full(True) == {"greedy", "beam_kenlm"}
    assert metrics.where("language = 'all'").count() == 2


def test_a_language_called_all_counts_twice(spark):
    r = S.split_metrics(hyp(spark, (1, "a", "b", "greedy", None, None, None, "all"))).collect()
    assert [(x["language"], x["num_samples"]) for x in r] == [("all", 2)]


def test_worst_breaks_ties_by_arrival(spark):
    rows = hyp(spark, (3, "ab", "ax"), (1, "ab", "ay"), (2, "ab", "xy"))
    assert [r["utt_id"] for r in S.worst(rows, 2).collect()] == [2, 1]


def test_by_language(spark):
    got = dict(S.by_language(hyp(spark, (1, "a b", "a x"), (2, "c", "c", "greedy", None, None, None, "pl"), (3, "d", "", "greedy", None, None, None, "de"))).collect())
    assert got["wer/overall"] == 0.5 and got["wer/en"] == 0.5 and got["wer/pl"] == 0.0 and "wer/de" not in got


def test_frames(spark):
    frames = spark.createDataFrame([(1, t, k) for t, k in enumerate([0, 1, 1, 0, 1, 2])] + [(2, 0, 0)], "utt_id bigint, t int, token int")
    assert dict(S.frames_to_ids(frames).collect()) == {1: [1, 1, 2], 2: []}
    assert {r["utt_id"]: r["blank_fraction"] for r in S.blank_fraction(frames, ["utt_id"]).collect()} == {1: 2 / 6, 2: 1.0}
    assert S.blank_fraction(frames.limit(0)).first()["blank_fraction"] == 0


def test_checks(spark):
    with pytest.raises(ValueError):
        S.check_split("dev")
    with pytest.raises(ValueError):
        S.parameter_sweep(spark, ["other"], [], [], [])
    assert S.effective_decoders("tdt", ["beam"]) == ["greedy"]
    keys = spark.createDataFrame([("a", "net.joint.x"), ("a", "net.proj.y"), ("b", "net.proj.y"), ("c", "other")], "checkpoint string, name string")
    assert dict(S.model_type(keys).collect()) == {"a": "tdt", "b": "ctc", "c": None}


def test_empty(spark):
    none = hyp(spark, (1, "a", "a")).limit(0)
    assert S.rollup(S.split_metrics(none)).count() == 0 and S.worst(none).count() == 0
    assert S.first_per_language(none).where(F.lit(True)).count() == 0
