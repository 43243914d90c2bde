import pytest
from pyspark.sql import functions as F

from voxloom.functions import text as X


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} {'binary' if isinstance(v, bytes) else 'bigint' if isinstance(v, int) else 'string'}" for n, v in zip(names, values))
    return spark.createDataFrame([values], schema).select(column(*map(F.col, names)).alias("r")).first()["r"]


@pytest.mark.parametrize("text", ["", " ", "\t a \n", " a b　", "\x1fa\x1c", None])
def test_strip_and_words_as_python(spark, text):
    assert one(spark, X.strip, text) == (None if text is None else text.strip())
    assert one(spark, X.words, text) == (None if text is None else text.split())


def test_key(spark):
    rows = spark.createDataFrame([("u", "p"), ("", "p"), (None, "p"), (None, ""), (None, None)], "a string, b string")
    assert [r[0] for r in rows.select(X.row_key(F.col("a"), F.col("b"))).collect()] == ["u", "p", "p", None, None]


def test_tag_slug_epoch(spark):
    assert one(spark, X.safe_tag, " a/b  cą! ") == "a_b_c_"
    assert len(one(spark, X.safe_tag, "x" * 500)) == 120
    assert one(spark, X.slug, "--Żółw, 2!--") == "żółw_2"
    assert one(spark, X.slug, "_" * 3 + "a" * 39 + " bc") == "a" * 39
    assert one(spark, X.fixed, 1234) == "1234.00"
    assert one(spark, X.slug, "!!") == "sample" and one(spark, X.slug, None) == "sample"
    assert [one(spark, X.epoch_of, n) for n in ("m-epoch=012.ckpt", "7-x.ckpt", "last.ckpt")] == [12, 7, None]


def test_uid(spark):
    make = lambda path, content: X.sample_uid(F.lit("h"), F.lit(None).cast("string"), F.lit("s"), F.lit(3), path, content)
    assert one(spark, make, "a.wav", b"x") == "h____s__path_a.wav"
    assert "sha1_" in one(spark, make, "", b"x")
    assert one(spark, make, "", b"").endswith("pos_3")


def test_suffix(spark):
    assert [one(spark, X.audio_suffix, p) for p in ("a/B.WAV", "a/b", ".wav", None)] == [".WAV", ".audio", ".audio", ".audio"]


def test_rate_limit(spark):
    assert one(spark, X.is_rate_limit, "HTTP 429") and not one(spark, X.is_rate_limit, "HTTP 500")
