import random

import pytest
from pyspark.sql import functions as F

from voxloom.operators import assemble as S
from voxloom.plans import catalogue

M = "ord bigint, uid string, audio_filepath string, text string, duration double, language string, dataset string, source string"


def rows(spark, *items):
    """(ord, bucket, key[, duration])"""
    full = [(o, k, None, "t", d[0] if d else 1.0, "en", b, "s") for o, b, k, *d in items]
    return spark.createDataFrame(full, M)


def targets(spark, *items):
    return spark.createDataFrame([(n, i, t) for i, (n, t) in enumerate(items)], "name string, seq int, target int")


def fold(items, wanted, cap=None):
    """The rule, row by row."""
    seen, out, total = set(), [], 0.0
    for name, target in wanted:
        kept = 0
        for o, b, k, *d in sorted(items):
            if b != name or kept >= target:
                continue
            if not k or k in seen:
                continue
            seconds = d[0] if d and d[0] is not None else 0.0
            if cap is not None and total + seconds > cap * 3600:
                return out
            seen.add(k)
            total += seconds
            kept += 1
            out.append(o)
    return out


def kept(df):
    return [r["ord"] for r in df.orderBy("bucket_seq", "place").collect()]


@pytest.mark.parametrize(
    "items, wanted",
    [
        ([(1, "A", "x"), (2, "A", "y"), (3, "B", "y")], [("A", 1), ("B", 1)]),
        ([(1, "A", "x"), (2, "A", "x"), (3, "A", "y")], [("A", 2)]),
        ([(1, "A", "x"), (2, "B", "x"), (3, "B", "z"), (4, "C", "z"), (5, "C", "x"), (6, "C", "w")], [("A", 1), ("B", 1), ("C", 1)]),
        ([(1, "A", None), (2, "A", ""), (3, "A", "x")], [("A", 5), ("none", 3)]),
    ],
)
def test_buckets_are_filled_in_turn(spark, items, wanted):
    assert kept(S.assemble(rows(spark, *items), targets(spark, *wanted))) == fold(items, wanted)


@pytest.mark.parametrize("seed", range(3))
def test_random_buckets_equal_the_fold(spark, seed):
    rng = random.Random(seed)
    items = [(i, rng.choice("ABCD"), rng.choice([*map(str, range(40)), None]), rng.choice([600.0, 100.0, None])) for i in range(150)]
    wanted = [(b, rng.randint(1, 25)) for b in "CADB"]
    final = S.assemble(rows(spark, *items), targets(spark, *wanted))
    assert kept(final) == fold(items, wanted)
    assert kept(S.hour_cap(final, 2.0)) == fold(items, wanted, 2.0)


def test_hour_cap_stops_at_the_first_overflow(spark):
    items = [(1, "A", "x", 3000.0), (2, "A", "y", 900.0), (3, "A", "z", 100.0)]
    assert kept(S.assemble(rows(spark, *items), targets(spark, ("A", 9)), max_hours=1.0)) == [1]
    assert kept(S.assemble(rows(spark, *items), targets(spark, ("A", 9)), max_hours=0)) == [1, 2, 3]


def test_targets_and_delivery(spark):
    specs = spark.createDataFrame([("a", 0, 10), ("a", 1, 10), ("b", 2, 7), ("b", 3, 9)], "name string, seq int, samples int")
    got = {r["name"]: (r["sources"], r["target"], r["consistent"]) for r in S.bucket_targets(specs).collect()}
    assert got == {"a": (2, 10, True), "b": (2, 7, False)}
    report = S.delivery(rows(spark, (1, "A", "x")), targets(spark, ("A", 5)))
    with pytest.raises(S.Underdelivery, match="have=1 target=5"):
        S.check_delivery(report, "raise")
    with pytest.warns(UserWarning):
        S.check_delivery(report, "warn")


def test_overlap(spark):
    S.assert_no_overlap(rows(spark, (1, "A", "a")), rows(spark, (1, "A", "b")))
    with pytest.raises(ValueError, match="overlap detected"):
        S.assert_no_overlap(rows(spark, (1, "A", "a")), rows(spark, (1, "A", "a")))
    with pytest.raises(Exception, match="neither uid nor audio_filepath"):
        S.assert_no_overlap(rows(spark, (1, "A", None)), rows(spark, (1, "A", "a")))


def test_split_bucket_keeps_last_value_at_first_place(spark):
    old = spark.createDataFrame([(0, "u", "far/1", "old", 1.0, "pl", "far", "s"), (1, "v", "far/2", "v", 1.0, "pl", "far", "s")], M)
    mixed = spark.createDataFrame([(0, "w", "near/1", "w", 1.0, "pl", "m", "s"), (1, "u", "far/1", "new", 1.0, "pl", "m", "s")], M)
    rest, far = S.split_bucket(mixed, "far/", "m", "far", old)
    assert [r["uid"] for r in rest.collect()] == ["w"]
    assert [(r["uid"], r["text"], r["dataset"]) for r in far.orderBy("ord").collect()] == [("u", "new", "far"), ("v", "v", "far")]
    same, existing = S.split_bucket(mixed, "absent", "m", "far", old)
    assert same.count() == 2 and existing.count() == 2


def test_append_up_to_target(spark):
    have, new = rows(spark, (1, "A", "a")), rows(spark, (2, "A", "a"), (3, "A", "b"), (4, "A", "b"), (5, "A", "c"), (6, "A", None))
    assert [r["ord"] for r in S.append_new(have, new).orderBy("ord").collect()] == [3, 5]
    assert [r["ord"] for r in S.append_new(have, new, 2).collect()] == [3]


def test_small_helpers(spark):
    m = rows(spark, (5, "A", "a"), (3, "A", "b"))
    assert S.row_at(m, 1).first()["ord"] == 5
    with pytest.raises(IndexError):
        S.row_at(m, 2)
    states = lambda *x: spark.createDataFrame([(v,) for v in x], "exhausted boolean")
    assert not S.all_exhausted(states()) and S.all_exhausted(states(True, True)) and not S.all_exhausted(states(True, None))
    used = spark.createDataFrame([(0,), (1,), (3,)], "index bigint")
    assert [S.next_free(used, k) for k in (0, 2, 3, 9)] == [2, 2, 4, 9]
    assert spark.range(1).select(S.global_position(10, F.lit(1), F.lit(2), 4)).first()[0] == 19


def test_limits_per_source_and_failures(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], 3 if i % 2 else 2) for i in range(10)], "ord bigint, source string, samples int")
    assert sorted(r["ord"] for r in S.per_source(rows, "source", "samples").collect()) == [0, 1, 2, 3, 5]
    assert S.per_source(rows, "source", "samples", most=1).count() == 2
    status = spark.createDataFrame([("ok",), ("failed",)], "status string")
    assert S.check_failures(status, 1) == 1
    with pytest.raises(RuntimeError):
        S.check_failures(status, 0)


def test_queries_fill_buckets_to_the_whole_target(spark, tmp_path):
    """Targets of 120 (binding, of 150 keys), 200 (short, of 130) and 300 (no rows); the last rows of A are second deliveries."""
    items = [(i, "A", f"a{i % 150}") for i in range(160)] + [(i, "B", f"b{i}") for i in range(160, 290)]
    rows(spark, *items).write.parquet(str(tmp_path / "train_final.parquet"))
    specs = [("A", "train", 0, 120), ("A", "train", 1, 999), ("B", "train", 2, 200), ("C", "train", 3, 300), ("A", "val", 4, 7)]
    spark.createDataFrame(specs, "name string, phase string, seq int, samples int").write.parquet(str(tmp_path / "source_spec.parquet"))
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path))
    assert kept(run("bucket_build")) == [*range(120), *range(160, 290)]
    assert kept(run("bucket_build_hours")) == [*range(120), *range(160, 290)]
    assert {r["name"]: (r["target"], r["kept"], r["short"]) for r in run("underdelivery").collect()} == {"A": (120, 120, False), "B": (200, 130, True), "C": (300, 0, True)}
