import pytest

from voxloom.operators import reports as R

M = "ord bigint, audio_filepath string, text string, duration double, language string, dataset string"


def manifest(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], M)


def test_summary(spark):
    rows = manifest(spark, ("a", "x", 1.5, "en", "d"), ("b", "x", 2.5, "en", "e"), ("c", "x", 2.0, "en", None))
    total = R.summarize(rows).where("total").first()
    assert (total["n"], total["seconds"], total["average"]) == (3, 6.0, 2.0)
    assert R.summarize(rows).where("not total and dataset is null").first()["n"] == 1
    for wrong in (None, 0.0, -1.0):
        with pytest.raises(Exception, match="bad or missing duration"):
            R.summarize(manifest(spark, ("a", "x", wrong, "en", "d"))).collect()
    assert R.summarize(manifest(spark, ("a", "x", float("nan"), "en", "d")), strict=False).where("total").first()["n"] == 0


def test_compare_fills_with_zeros(spark):
    out = R.compare(manifest(spark, ("a", "x", 3600.0, "en", "d")), manifest(spark, ("a", "x", 7200.0, "en", None))).collect()
    assert {tuple(r) for r in out} == {("d", 1, 1.0, 0, 0.0), (None, 0, 0.0, 1, 2.0)}


def test_audit_and_repair(spark):
    rows = manifest(spark, ("a", "x", None, "en", "d"), ("b", "x", 2.0, "en", "d"), ("gone", "x", -1.0, "en", "d"), ("c", "x", 0.0, "en", "d"))
    files = spark.createDataFrame([("a", 5.0), ("b", 6.0), ("c", None)], "path string, seconds double")
    assert tuple(R.audit(rows, files).first()) == (4, 3, 1, 1)
    bad_only = {r["audio_filepath"]: (r["duration"], r["outcome"]) for r in R.repair(rows, files, rewrite_all=False).collect()}
    assert bad_only == {"a": (5.0, "fixed"), "b": (2.0, "kept"), "gone": (-1.0, "missing"), "c": (0.0, "error")}
    assert dict(R.outcomes(R.repair(rows, files)).collect()) == {"fixed": 2, "missing": 1, "error": 1}


def test_coverage(spark):
    rows = manifest(spark, ("a", " żółw ", 1.0, "pl", "d"), ("b", "żaba", 1.0, "en", "d"), ("c", "  ", 1.0, "pl", "d"))
    letters = {r["letter"]: r["count"] for r in R.letter_coverage(rows).collect()}
    assert letters["ż"] == 1 and letters["ł"] == 1 and letters["Ż"] == 0 and len(letters) == 18
    assert [tuple(r) for r in R.coverage(rows).collect()] == [("en", 1, 4), ("pl", 1, 4)]


def test_balance(spark):
    rows = spark.createDataFrame([(0, "en", "x" * 10), (1, "pl", "abcd"), (2, "pl", "abc")], "ord bigint, language string, text string")
    out = R.balance(rows).collect()
    sizes = lambda lang: [len(r["text"]) for r in out if r["language"] == lang]
    assert sizes("en") == [10] and 10 <= sum(sizes("pl")) < 14
    assert {r["cycle"] for r in out if r["language"] == "pl"} == {0, 1}
    assert R.balance(rows.where("language = 'pl'")).count() == 2


def test_parameters(spark):
    ckpt = spark.createDataFrame([(1, "w", [1.0, 2.0]), (2, "w", [3.0, 4.0]), (2, "b", [5.0])], "epoch int, name string, values array<double>")
    assert dict(R.average_parameters(ckpt).collect()) == {"w": [2.0, 3.0]}
    steps = spark.createDataFrame([(1, "n", [1.0], False), (2, "n", [9.0], False), (1, "w", [1.0], True), (2, "w", [2.0], True)], "epoch int, name string, values array<double>, floating boolean")
    assert dict(R.average_parameters(steps).collect()) == {"n": [1.0], "w": [1.5]}
    files = spark.createDataFrame([("epoch=1.ckpt",), ("epoch=10.ckpt",), ("3-x.ckpt",), ("last.ckpt",)], "name string")
    assert [r["epoch"] for r in R.last_checkpoints(files, 2).collect()] == [10, 3]
    with pytest.raises(ValueError):
        R.last_checkpoints(files.limit(1), 2)


def test_copy(spark):
    P = "name string, shape string, values int"
    target = spark.createDataFrame([("e.a", "2", 0), ("e.b", "2", 0), ("x", "1", 0)], P)
    source = spark.createDataFrame([("e.a", "2", 1), ("e.b", "3", 1), ("e.c", "1", 1), ("x", "1", 1)], P)
    got = {r["name"]: (r["values"], r["outcome"]) for r in R.copy_parameters(target, source, "e.").collect()}
    assert got == {"e.a": (1, "copied"), "e.b": (0, "skipped"), "x": (0, "kept"), "e.c": (None, "skipped")}


def test_corpus_lines(spark):
    rows = manifest(spark, ("a", "x\ny", 1.0, "en", "d"), ("b", " ", 1.0, "en", "d"), ("c", "z", 1.0, "en", "d"))
    assert [r[0] for r in R.corpus_lines(rows).collect()] == ["x y", "z"]
    assert R.corpus_lines(rows, 1).count() == 1
