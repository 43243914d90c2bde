import pytest
from pyspark.sql import functions as F

from voxloom.operators import admit, batching

M = "ord bigint, audio_filepath string, text string, duration string, language string, dataset string"


def manifest(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], M)


def test_infeasible_row_is_dropped(spark):
    rows = manifest(spark, ("a", "hi there", "2.0", "en", "d"), ("b", "word " * 200, "0.2", "en", "d"))
    assert [r["audio_filepath"] for r in admit.admitted(rows).collect()] == ["a"]


def test_each_row_counts_once(spark):
    bad = [("a", "x", d, "en", "d") for d in (None, "abc", "-1", "0")]
    other = [("a", "x", "NaN", "en", "d"), ("a", "x", "17", "en", "d"), ("a", "x", "16.0", "en", "d"), (None, "x", "1", "en", "d"), ("a", "  ", "1", "en", "d"), ("a", None, "99", "en", "d")]
    got = dict(admit.drop_report(manifest(spark, *bad, *other)).collect())
    assert got == {"bad_duration": 4, "ctc_too_long": 1, "too_long": 2, "loaded": 1, "missing": 2}


def test_defaults(spark):
    r = admit.admitted(manifest(spark, ("a", " x ", "2.5", "", None))).first()
    assert (r["text"], r["duration"], r["language"], r["dataset"]) == ("x", 2.5, "unknown", "unknown")


def items(spark, durations, language="en"):
    return spark.createDataFrame([(i, language, float(d)) for i, d in enumerate(durations)], "ord bigint, language string, duration double")


def test_packing_of_the_worked_example(spark):
    out = batching.plan(items(spark, [5, 4, 3, 9]), batching.BatchLimits(8, 2))
    assert sorted(out.select("batch", "keys").collect()) == [(0, [2, 1]), (1, [0]), (2, [3])]


def test_plan_is_a_partition_within_limits(spark):
    durations = [(i * 37 % 101) / 10 + 0.1 for i in range(500)]
    limits = batching.BatchLimits(30, 8, bucket_rows=64)
    out = batching.plan(items(spark, durations), limits, seed=3).collect()
    assert sorted(k for r in out for k in r["keys"]) == list(range(500))
    assert all(r["n"] <= 8 and (r["seconds"] <= 30 or r["n"] == 1) for r in out)
    again = batching.plan(items(spark, durations), limits, seed=3).collect()
    assert sorted(map(tuple, (r["keys"] for r in out))) == sorted(map(tuple, (r["keys"] for r in again)))
    other = batching.plan(items(spark, durations), limits, seed=3, epoch=1).collect()
    assert sorted(map(tuple, (r["keys"] for r in out))) != sorted(map(tuple, (r["keys"] for r in other)))


def test_small_batches_are_dropped(spark):
    out = batching.plan(items(spark, [5, 5, 5]), batching.BatchLimits(10, 8, min_rows=2))
    assert [r["n"] for r in out.collect()] == [2]
    assert batching.count_batches(items(spark, [5, 5, 5]), batching.BatchLimits(10, 8, min_rows=4)) == 1


def test_limits_are_positive():
    with pytest.raises(ValueError):
        batching.BatchLimits(0, 1)


def test_null_language_is_a_group(spark):
    rows = items(spark, [1, 2]).unionByName(items(spark, [3], None))
    assert {r["language"]: r["n"] for r in batching.plan(rows, batching.BatchLimits(10, 9)).collect()} == {"en": 2, None: 1}


def test_fixed_and_clean_pass(spark):
    rows = items(spark, range(1, 8))
    assert [r["n"] for r in batching.fixed(rows, 3).orderBy("batch").collect()] == [3, 3, 1]
    assert batching.fixed(rows, 3, drop_last=True).count() == 2
    many = spark.range(5000).withColumnRenamed("id", "ord")
    share = batching.clean_pass(many, 0.08).where("clean_pass").count() / 5000
    assert 0.05 < share < 0.11 and batching.clean_pass(many, 0.08, start_epoch=2, epoch=1).where("clean_pass").count() == 0


def test_collate(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0], [7]), (1, [3.0], [8, 9])], "ord bigint, audio array<double>, ids array<int>")
    r = batching.collate(batching.plan(items(spark, [2, 1]), batching.BatchLimits(10, 4)), rows).first()
    assert (r["audio"], r["audio_lengths"], r["targets"], r["target_lengths"]) == ([[3.0, 0.0], [1.0, 2.0]], [1, 2], [8, 9, 7], [2, 1])


def test_feasible(spark):
    rows = spark.createDataFrame([(3, 3), (2, 3)], "out_len int, target_len int")
    assert admit.feasible(rows).count() == 1


def test_running_total_over_blocks(spark):
    from voxloom.scale import running_total

    rows = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("g"))
    out = running_total(rows, ["g"], F.floor(F.col("k") / 7), ["k"], F.col("k"), "t").collect()
    for g in (None, "1", "2"):
        total = 0
        for r in sorted((r for r in out if r["g"] == g), key=lambda r: r["k"]):
            total += r["k"]
            assert r["t"] == total
