import math

import pytest
from pyspark.sql import functions as F

from voxloom.functions import arrays as A


def value(spark, column):
    return spark.range(1).select(column.alias("r")).first()["r"]


def arr(*xs, kind="double"):
    return F.array(*[F.lit(x) for x in xs]).cast(f"array<{kind}>")


def test_collapse_of_the_reference_example(spark):
    frames = F.array(arr(0, 0, 0), arr(0, 10, 0), arr(0, 10, 0), arr(0, 0, 10))
    assert value(spark, A.greedy_ids(frames, F.lit(4))) == [1, 2]
    assert value(spark, A.greedy_ids(frames, F.lit(2))) == [1]
    assert value(spark, A.collapse(arr(kind="int"))) == []
    assert value(spark, A.collapse(arr(1, 0, 1, 1, 2, 2, 0, kind="int"))) == [1, 1, 2]


def test_ids(spark):
    ids = arr(1, 0, 3, kind="int")
    assert value(spark, A.unshift_ids(ids)) == [0, 2]
    assert value(spark, A.shift_ids(ids)) == [2, 1, 4]
    assert value(spark, A.pad_to(ids, F.lit(5))) == [1, 0, 3, 0, 0]
    assert value(spark, A.pad_to(ids, F.lit(2))) == [1, 0, 3]


@pytest.mark.parametrize("n, factor, want", [(100, 2, 50), (101, 2, 51), (100, 4, 25), (100, 8, 12)])
def test_subsampling(spark, n, factor, want):
    assert value(spark, A.subsampled(F.lit(n).cast("bigint"), factor)) == want


def test_subsampling_by_three_is_an_error():
    with pytest.raises(ValueError):
        A.subsampled(None, 3)


def test_encoder_length(spark):
    assert value(spark, A.encoder_length(F.lit(2.0), 4)) == 50
    assert value(spark, A.encoder_length(F.lit(2.0), 4, 0.95)) <= 50
    assert [value(spark, A.mel_frames(F.lit(n))) for n in (8000, 16000, 32001)] == [51, 101, 201]


def test_schedules(spark):
    assert value(spark, A.noam(F.lit(49), 50)) == 1.0
    assert math.isclose(value(spark, A.noam(F.lit(199), 50)), 0.5)
    assert value(spark, A.cosine(F.lit(9), 10, 100)) == 1.0
    assert math.isclose(value(spark, A.cosine(F.lit(99), 10, 100, 0.1)), 0.1)
    assert value(spark, A.drop_path(3, 0.2)) == [0.0, 0.1, 0.2]
    for wrong in ((0, 10), (10, 10)):
        with pytest.raises(ValueError):
            A.cosine(None, *wrong)


def test_waveforms(spark):
    assert value(spark, A.pcm_to_float(arr(-32768, 16384, kind="int"), "int16")) == [-1.0, 0.5]
    assert value(spark, A.pcm_to_float(arr(0, 192, kind="int"), "uint8")) == [-1.0, 0.5]
    assert value(spark, A.peak_normalise(arr(0, 0))) == [0.0, 0.0]
    assert value(spark, A.mono(F.array(arr(1, 2, 3), arr(3, 2, 1)))) == [2.0, 2.0, 2.0]
    assert value(spark, A.mono(F.array(arr(1, 3), arr(2, 2), arr(0, 1)))) == [2.0, 2.0, 0.5]
    assert value(spark, A.from_peak(arr(0, 1, -5, 2), 2)) == [-5.0, 2.0]
    assert value(spark, A.clip_to_one(arr(-2, 0.5, 2))) == [-1.0, 0.5, 1.0]
    assert math.isclose(sum(map(abs, value(spark, A.unit_energy(arr(1, -3))))), 1)
    assert sum(value(spark, A.demean(arr(1, 2, 6)))) == 0


def test_standardise_moves_padding_too(spark):
    out = value(spark, A.standardise(arr(1, 3, 100), F.lit(2)))
    assert out[:2] == [-1.0, 1.0] and out[2] == 98.0


def test_masks(spark):
    assert value(spark, A.length_mask(F.lit(3), F.lit(2))) == [True, True, False]
    matrix = F.array(*[arr(1, 1, 1, 1) for _ in range(40)])
    masked = value(spark, A.spec_augment(matrix, F.lit(5), freq_masks=1, freq_width=2, time_masks=2, time_share=0.2))
    assert masked == value(spark, A.spec_augment(matrix, F.lit(5), freq_masks=1, freq_width=2, time_masks=2, time_share=0.2))
    assert {x for row in masked for x in row} <= {0.0, 1.0}
