import pytest

from voxloom.streaming import ingest as S

M = "ord bigint, uid string, audio_filepath string, text string"


def part(spark, folder, name, *rows):
    spark.createDataFrame([(o, k, None, t) for o, k, t in rows], M).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def keys(spark, bucket):
    return sorted(r["uid"] for r in S.ingested(spark, bucket).collect())


def test_resumes_and_keeps_each_key_once(spark, tmp_path):
    src, bucket, ck = (str(tmp_path / x) for x in ("src", "bucket", "ck"))
    part(spark, src, "1", (1, "a", "text"), (2, "b", "text"), (3, "a", "text"), (4, "c", "x"))
    stream = lambda: spark.readStream.schema(M).option("recursiveFileLookup", "true").parquet(src)
    S.ingest(stream(), bucket, ck)
    assert keys(spark, bucket) == ["a", "b"]
    part(spark, src, "2", (5, "b", "text"), (6, "d", "text"), (7, None, "text"))
    S.ingest(stream(), bucket, ck)
    S.ingest(stream(), bucket, ck)
    assert keys(spark, bucket) == ["a", "b", "d"]


def test_stops_at_the_target(spark, tmp_path):
    src, bucket, ck = (str(tmp_path / x) for x in ("src", "bucket", "ck"))
    part(spark, src, "1", *[(i, f"k{i}", "text") for i in range(20)])
    S.ingest(spark.readStream.schema(M).option("recursiveFileLookup", "true").parquet(src), bucket, ck, target=5)
    assert keys(spark, bucket) == [f"k{i}" for i in range(5)]


def test_deduplicated_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    part(spark, src, "1", (1, "a", "t"), (2, "a", "t"), (3, "b", "t"))
    stream = spark.readStream.schema(M).option("recursiveFileLookup", "true").parquet(src)
    q = S.deduplicated(stream).writeStream.format("memory").queryName("dedup").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("dedup").count() == 2


def test_cursor_rules():
    assert S.resume_cursor(10, 5, 0, True, False) == 0
    assert S.resume_cursor(60, 100, 10, True, False) == 0
    assert S.resume_cursor(50, 100, 10, True, False) == 50
    assert S.resume_cursor(50, 100, 10, False, True) == 0
    assert S.resume_cursor(50, 100, 0, False, True) == 50


def test_states(spark):
    states = spark.createDataFrame([("a", 5, False), ("b", 5, True), ("c", 5, False)], "source string, cursor int, exhausted boolean")
    runs = spark.createDataFrame([("a", True, False), ("b", True, False), ("c", True, True)], "source string, short boolean, streaming boolean")
    assert {r["source"]: r["exhausted"] for r in S.reopened(states, runs).collect()} == {"a": False, "b": False, "c": False}
    assert {r["source"]: r["exhausted"] for r in S.closed(states, runs).collect()} == {"a": True, "b": True, "c": False}


def test_retries():
    pauses, left = [], [2]

    def read():
        if left[0]:
            left[0] -= 1
            raise OSError("HTTP 429")
        return "ok"

    assert S.with_retries(read, sleep=pauses.append) == "ok" and pauses == [45.0, 90.0]
    with pytest.raises(OSError):
        S.with_retries(lambda: (_ for _ in ()).throw(OSError("429")), retries=2, sleep=pauses.append)
    assert pauses == [45.0, 90.0, 45.0, 90.0]
    with pytest.raises(KeyError):
        S.with_retries(lambda: {}["x"], sleep=pauses.append)
    try:
        try:
            raise OSError("rate limit")
        except OSError as e:
            raise ValueError("outer") from e
    except ValueError as e:
        assert S.rate_limited(e)


def test_paged_source(spark):
    import os

    from voxloom.sources.paged import PagedSource

    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(__file__), "paged_fixture.py"))
    spark.dataSource.register(PagedSource)
    df = spark.read.format("paged").schema("shard int, n int").option("pages", "paged_fixture:numbers").option("shards", 3).option("pause", 0).load()
    assert df.rdd.getNumPartitions() == 3 and sorted(r["n"] for r in df.collect()) == list(range(30))


def test_late_repeats_within_the_watermark(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "uid string, audio_filepath string, at timestamp"
    rows = spark.sql("SELECT * FROM VALUES ('a', CAST(NULL AS STRING), TIMESTAMP'2025-01-01 00:00:00'), ('a', NULL, TIMESTAMP'2025-01-01 00:05:00'), ('b', NULL, TIMESTAMP'2025-01-01 00:01:00') AS t(uid, audio_filepath, at)")
    rows.coalesce(1).write.parquet(src)
    stream = S.deduplicated_within(spark.readStream.schema(schema).parquet(src), "at", "10 minutes")
    q = stream.writeStream.format("memory").queryName("late").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["uid"] for r in spark.table("late").collect()) == ["a", "b"]


def test_rejects(spark):
    from pyspark.sql import functions as F

    good, bad = S.split_valid(spark.createDataFrame([(1,), (None,), (-1,)], "x int"), F.col("x") > 0)
    assert good.count() == 1 and bad.count() == 2


def test_each_shard_goes_on_from_its_own_cursor(spark):
    import os

    from voxloom.sources.paged import PagedSource

    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(__file__), "paged_fixture.py"))
    spark.dataSource.register(PagedSource)
    df = spark.read.format("paged").schema("shard int, n int").option("pages", "paged_fixture:numbers").option("shards", 3).option("start", 7).option("cursors", "[9, null]").option("pause", 0).load()
    assert sorted(map(tuple, df.collect())) == sorted((s, s + i * 3) for s, first in ((0, 9), (1, 7), (2, 7)) for i in range(first, 10))


def test_small_files_are_spread_over_the_cores(spark, tmp_path):
    from voxloom.scale import spread

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    one = spark.read.parquet(str(tmp_path / "t"))
    assert one.rdd.getNumPartitions() == 1 and spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(spread(one).collect()) == sorted(one.collect())
