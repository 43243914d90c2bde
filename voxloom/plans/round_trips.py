"""More queries: readers and sinks by round trip, streams, batches, features and decoding, each over whole tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import arrays as A
from voxloom.functions import text as X
from voxloom.operators import admit, assemble, batching, beam, decode, reports, signal, tokens
from voxloom.plans.catalogue import _B, _KEY, _MICRO, _USABLE, _batchable, _strip, _t, _words, query
from voxloom.scale import scratch_path
from voxloom.sources import audio, manifests, sinks
from voxloom.streaming import ingest as S
from voxloom.streaming import supervise

# --- assembly over keys that several buckets share ---------------------------------------------------------------------

#: A row's key is the digest of its text, so stock phrases stand in many buckets; each bucket takes so many rows.
_SHARED_TARGET = 60
_SHARED = f"""RECURSIVE
b AS (SELECT name, min(seq) AS seq, row_number() OVER (ORDER BY min(seq)) AS i FROM source_spec WHERE phase = 'train' GROUP BY name),
k AS (SELECT t.ord, t.dataset, t.duration, b.seq, b.i, md5(text) AS key FROM train_final t JOIN b ON t.dataset = b.name WHERE text IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY b.seq, md5(text) ORDER BY ord) = 1),
r AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS seen, CAST([] AS BIGINT[]) AS kept
  UNION ALL
  SELECT i + 1, list_concat(any_value(seen), coalesce(list(key) FILTER (WHERE fresh AND p <= {_SHARED_TARGET}), [])), coalesce(list(ord ORDER BY p) FILTER (WHERE fresh AND p <= {_SHARED_TARGET}), [])
  FROM (SELECT *, row_number() OVER (ORDER BY fresh DESC, ord) AS p
        FROM (SELECT r.i, r.seen, k.key, k.ord, coalesce(k.key IS NOT NULL AND NOT list_contains(r.seen, k.key), false) AS fresh FROM r LEFT JOIN k ON k.i = r.i + 1 WHERE r.i < (SELECT max(i) FROM b)))
  GROUP BY i),
f AS (SELECT k.ord, k.dataset, k.duration, k.seq, CAST(list_position(r.kept, k.ord) AS BIGINT) AS place FROM k JOIN r ON r.i = k.i WHERE list_contains(r.kept, k.ord))"""


def _shared(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = _t(spark, sf_dir, "train_final").where("text is not null").withColumn("uid", F.md5(F.col("text").cast("binary")))
    targets = assemble.bucket_targets(_t(spark, sf_dir, "source_spec"), "train").withColumn("target", F.lit(_SHARED_TARGET))
    return rows, targets


@query(f"WITH {_SHARED} SELECT ord, dataset, seq AS bucket_seq, place FROM f")
def bucket_build_shared(spark, sf_dir):
    return assemble.assemble(*_shared(spark, sf_dir)).select("ord", "dataset", "bucket_seq", "place")


@query(f"""
WITH {_SHARED}, s AS (SELECT *, sum(CASE WHEN duration IS NULL OR isnan(duration) THEN 0 ELSE {_MICRO} END) OVER (ORDER BY seq, place) AS upto FROM f),
x AS (SELECT min((seq, place)) AS stop FROM s WHERE upto > 3600000000)
SELECT ord, dataset, seq AS bucket_seq, place FROM s, x WHERE stop IS NULL OR (seq, place) < stop
""")
def bucket_build_shared_hours(spark, sf_dir):
    return assemble.assemble(*_shared(spark, sf_dir), max_hours=1.0).select("ord", "dataset", "bucket_seq", "place")


@query(f"WITH {_SHARED} SELECT b.name, {_SHARED_TARGET} AS target, count(f.ord) AS kept, count(f.ord) < {_SHARED_TARGET} AS short FROM b LEFT JOIN f ON f.dataset = b.name GROUP BY b.name")
def underdelivery_shared(spark, sf_dir):
    rows, targets = _shared(spark, sf_dir)
    return assemble.delivery(assemble.assemble(rows, targets), targets)


# --- readers and sinks -------------------------------------------------------------------------------------------------

_FIELDS = ("uid", "audio_filepath", "text", "duration", "language", "dataset", "source")


@query(f"SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, {', '.join(_FIELDS)} FROM val_final")
def jsonl_round_trip(spark, sf_dir):
    path = scratch_path(spark, "manifest")
    sinks.write_manifest(_t(spark, sf_dir, "val_final").select("ord", *_FIELDS), path)
    return manifests.typed(manifests.read_manifest(spark, path)).select("ord", *_FIELDS)


@query("SELECT uid, text, duration FROM val_final UNION ALL SELECT uid, text, duration FROM test_final")
def jsonl_append(spark, sf_dir):
    path = scratch_path(spark, "manifest")
    for table, mode in (("test_final", "overwrite"), ("val_final", "overwrite"), ("test_final", "append")):
        sinks.write_manifest(_t(spark, sf_dir, table).select("ord", "uid", "text", "duration"), path, mode)
    return manifests.typed(manifests.read_manifest(spark, path)).select("uid", "text", "duration")


@query("SELECT CAST(ord AS VARCHAR) AS extra_ord, source AS extra_source, uid FROM val_final")
def jsonl_extra_fields(spark, sf_dir):
    path = scratch_path(spark, "manifest")
    val = _t(spark, sf_dir, "val_final").select("uid", F.col("ord").alias("extra_ord"), F.col("source").alias("extra_source"))
    sinks.write_manifest(val, path)
    return manifests.read_manifest(spark, path, extra=True).select("uid", "extra_ord", "extra_source")


@query("SELECT coalesce(dataset, '-') AS dataset, coalesce(language, '-') AS language, CAST(count(*) AS VARCHAR) AS n FROM train_final GROUP BY dataset, language")
def csv_results(spark, sf_dir):
    path = scratch_path(spark, "results")
    sinks.write_results(_t(spark, sf_dir, "train_final").groupBy("dataset", "language").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.option("header", "true").option("nullValue", "\u0001").option("emptyValue", "").csv(path).na.fill("")


@query(f"WITH x AS (SELECT replace({_strip('text')}, chr(10), ' ') AS value FROM train_final WHERE text IS NOT NULL) SELECT value, count(*) AS n FROM x WHERE value <> '' GROUP BY value")
def corpus_text(spark, sf_dir):
    path = scratch_path(spark, "corpus")
    sinks.write_corpus(_t(spark, sf_dir, "train_final"), path)
    return spark.read.option("lineSep", "\n").text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH p AS (SELECT text, row_number() OVER (ORDER BY ord) - 1 AS i FROM train_final)
SELECT printf('%06d', i // 1000) AS shard, count(text) AS records, count(*) - count(text) AS skipped FROM p GROUP BY 1
""")
def tar_shards(spark, sf_dir):
    rows = _t(spark, sf_dir, "train_final").withColumn("content", F.col("text").cast("binary"))
    return sinks.write_shards(rows, scratch_path(spark, "shards"), 1000, missing="skip")


def _clips(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<float>").alias("samples"))


@query("SELECT vec_id, 'ok' AS status, len(embedding) / 16000.0::DOUBLE AS duration, len(embedding) / 16000.0::DOUBLE AS probed FROM embeddings")
def stored_audio(spark, sf_dir):
    folder = scratch_path(spark, "audio")
    record = F.struct(F.lit(None).cast("binary").alias("bytes"), F.lit(None).cast("string").alias("path"), F.col("samples").alias("array"), F.lit(16000).alias("sampling_rate"))
    stored = sinks.sample_outcomes(_clips(spark, sf_dir).select("vec_id", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), record.alias("audio")), folder)
    stored.write.parquet(f"{folder}/_rows")
    stored = spark.read.parquet(f"{folder}/_rows")
    found = audio.probe(audio.audio_files(spark, folder)).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("seconds").alias("probed"))
    return stored.withColumn("file", F.concat("name", F.lit(".wav"))).join(found, "file", "left").select("vec_id", "status", "duration", "probed")


@query("SELECT vec_id, 'ok' AS status, round(len(embedding) / 8000.0::DOUBLE, 9) AS duration FROM embeddings")
def resampled_audio(spark, sf_dir):
    @F.pandas_udf("binary")
    def as_wav(samples):
        return samples.map(lambda x: signal.write_wav(np.asarray(x), 8000))

    rows = _clips(spark, sf_dir).select("vec_id", F.concat(F.lit("/a/"), F.col("vec_id").cast("string")).alias("audio_filepath"), F.lit(0.0).alias("duration"), as_wav("samples").alias("content"))
    return sinks.write_resampled(rows, scratch_path(spark, "resampled")).select("vec_id", "status", F.round("duration", 9).alias("duration"))


@query("SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS id, s_name AS piece, -s_suppkey / 4.0::DOUBLE AS score FROM supplier")
def vocabulary_scan(spark, sf_dir):
    path = scratch_path(spark, "vocabulary")
    rows = _t(spark, sf_dir, "supplier").orderBy("s_suppkey").select(F.concat_ws("\t", F.col("s_name"), (-F.col("s_suppkey") / 4.0).cast("string")).alias("value"))
    rows.write.text(path)
    return manifests.vocabulary(spark, path)


@query(f"SELECT {_strip('audio_filepath')} AS path FROM test_final WHERE {_strip('audio_filepath')} <> ''")
def file_list(spark, sf_dir):
    path = scratch_path(spark, "list")
    _t(spark, sf_dir, "test_final").select(F.concat(F.lit(" "), F.coalesce("audio_filepath", F.lit("")), F.lit(" \t")).alias("value")).write.text(path)
    return manifests.path_list(spark, path)


@query("SELECT ord, text FROM train_final ORDER BY ord LIMIT 1 OFFSET 777")
def row_by_place(spark, sf_dir):
    return assemble.row_at(_t(spark, sf_dir, "train_final"), 777).select("ord", "text")


# --- streams -----------------------------------------------------------------------------------------------------------


def _event_stream(spark, sf_dir, files: int = 6) -> DataFrame:
    folder = scratch_path(spark, "stream")
    rows = _t(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("uid"), F.lit("").alias("audio_filepath"), F.col("event_type").alias("text"), F.col("ts").alias("at"))
    rows.repartitionByRange(files, "ord").write.parquet(folder)
    return manifests.source_stream(spark, folder, rows.schema, files_per_trigger=2)


@query("SELECT CAST(user_id AS VARCHAR) AS uid, count(DISTINCT user_id) AS n FROM events GROUP BY user_id")
def stream_ingest(spark, sf_dir):
    bucket = scratch_path(spark, "bucket")
    S.ingest(_event_stream(spark, sf_dir), bucket, scratch_path(spark, "checkpoint"))
    return S.ingested(spark, bucket).groupBy("uid").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT least(40, count(DISTINCT user_id)) AS n, least(40, count(DISTINCT user_id)) AS keys FROM events")
def stream_target(spark, sf_dir):
    bucket = scratch_path(spark, "bucket")
    S.ingest(_event_stream(spark, sf_dir), bucket, scratch_path(spark, "checkpoint"), target=40)
    return S.ingested(spark, bucket).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("uid").alias("keys"))


def _run_to_table(stream: DataFrame, path: str) -> DataFrame:
    spark = stream.sparkSession
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS key FROM events")
def stream_dedup(spark, sf_dir):
    return _run_to_table(S.deduplicated(_event_stream(spark, sf_dir)), scratch_path(spark, "dedup")).select("key")


@query("SELECT event_id AS ord, event_type <> 'error' AS valid FROM events")
def stream_rejects(spark, sf_dir):
    stream = _event_stream(spark, sf_dir)
    good, bad = S.split_valid(stream, F.col("text") != "error")
    parts = [_run_to_table(s.select("ord", F.lit(v).alias("valid")), scratch_path(spark, "valid")) for s, v in ((good, True), (bad, False))]
    return parts[0].unionByName(parts[1])


_STATES = "SELECT concat(CAST(seq AS VARCHAR), name) AS source, seq * 10 AS cursor, seq % 2 = 0 AS exhausted, seq % 3 = 0 AS short, coalesce(use_streaming, false) AS streaming FROM source_spec"


def _states(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    spec = _t(spark, sf_dir, "source_spec").withColumn("source", F.concat(F.col("seq").cast("string"), "name"))
    states = spec.select("source", (F.col("seq") * 10).alias("cursor"), (F.col("seq") % 2 == 0).alias("exhausted"))
    return states, spec.select("source", (F.col("seq") % 3 == 0).alias("short"), F.coalesce("use_streaming", F.lit(False)).alias("streaming"))


@query(f"WITH s AS ({_STATES}) SELECT source, cursor, exhausted AND NOT short AS reopened, exhausted OR (short AND NOT streaming) AS closed FROM s")
def source_states(spark, sf_dir):
    states, delivered = _states(spark, sf_dir)
    a = S.reopened(states, delivered).withColumnRenamed("exhausted", "reopened")
    b = S.closed(states, delivered).select("source", F.col("exhausted").alias("closed"))
    return a.join(b, "source").select("source", "cursor", "reopened", "closed")


@query("""
WITH g AS (SELECT CAST(c AS INTEGER) AS cursor, CAST(h AS INTEGER) AS have, s AS streaming FROM (SELECT unnest([0, 5, 50, 101, 600]) AS c), (SELECT unnest([0, 10, 120]) AS h), (SELECT unnest([true, false]) AS s))
SELECT cursor, have, streaming, CASE WHEN cursor > 100 OR (have > 0 AND cursor > 5 * have) OR (NOT streaming AND have > 0) THEN 0 ELSE cursor END AS resumes FROM g
""")
def resume_rules(spark, sf_dir):
    cases = [(c, h, s, S.resume_cursor(c, 100, h, s, True)) for c in (0, 5, 50, 101, 600) for h in (0, 10, 120) for s in (True, False)]
    return spark.createDataFrame(cases, "cursor int, have int, streaming boolean, resumes int")


@query("SELECT o_orderkey, 3 + o_orderkey % 4 + (o_orderkey // 4) * 4 AS position FROM orders")
def shard_positions(spark, sf_dir):
    key = F.col("o_orderkey")
    return _t(spark, sf_dir, "orders").select("o_orderkey", assemble.global_position(3, F.pmod(key, F.lit(4)), F.floor(key / 4), 4).alias("position"))


@query("SELECT min(k) AS next FROM (SELECT unnest(range(1, 1 + (SELECT max(c_custkey) + 1 FROM customer))) AS k) WHERE k >= 10 AND k NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 97 <> 0)")
def free_index(spark, sf_dir):
    used = _t(spark, sf_dir, "customer").where("c_custkey % 97 <> 0").select(F.col("c_custkey").alias("index"))
    return spark.createDataFrame([(assemble.next_free(used, 10),)], "next bigint")


@query("SELECT ord FROM train_final t JOIN (SELECT name, min(seq) AS s FROM source_spec GROUP BY name) b ON t.dataset = b.name QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY ord) <= least(5 + s, 20)")
def source_limits(spark, sf_dir):
    spec = _t(spark, sf_dir, "source_spec").groupBy(F.col("name").alias("dataset")).agg((5 + F.min("seq")).alias("wanted"))
    rows = _t(spark, sf_dir, "train_final").join(spec, "dataset")
    return assemble.per_source(rows, "dataset", "wanted", 20).select("ord")


# --- batches, tokens and coverage --------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= l_linenumber * 7")
def feasible_rows(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").withColumns({"out_len": F.col("l_quantity"), "target_len": F.col("l_linenumber") * 7})
    return admit.feasible(rows).select("l_orderkey", "l_linenumber")


_IN_ORDER = f"""RECURSIVE r AS (SELECT ord, coalesce(nullif(language, ''), 'unknown') AS language, {_MICRO} AS micro FROM train_final WHERE {_USABLE}),
s AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY ord) - 1 AS place FROM r),
q AS (SELECT language, place // 128 AS bucket, micro, row_number() OVER (PARTITION BY language, place // 128 ORDER BY micro, place) AS rn FROM s),
f AS (SELECT language, bucket, rn, 1 AS n, micro AS total, true AS first FROM q WHERE rn = 1
  UNION ALL SELECT q.language, q.bucket, q.rn, CASE WHEN f.total + q.micro > 60000000 OR f.n >= 16 THEN 1 ELSE f.n + 1 END,
    CASE WHEN f.total + q.micro > 60000000 OR f.n >= 16 THEN q.micro ELSE f.total + q.micro END, f.total + q.micro > 60000000 OR f.n >= 16
  FROM f JOIN q ON q.language = f.language AND q.bucket = f.bucket AND q.rn = f.rn + 1)"""


@query(f"WITH {_IN_ORDER} SELECT count(*) AS batches FROM f WHERE first")
def batch_count(spark, sf_dir):
    n = batching.count_batches(_batchable(spark, sf_dir), batching.BatchLimits(max_seconds=60.0, max_rows=16, bucket_rows=128))
    return spark.createDataFrame([(n,)], "batches bigint")


@query("SELECT ord, CAST(concat('0x', substring(md5('9:' || ord), 1, 8)) AS BIGINT) % 1000000 < 80000 AS clean_pass FROM train_final")
def clean_passes(spark, sf_dir):
    return batching.clean_pass(_t(spark, sf_dir, "train_final").select("ord"), 0.08, start_epoch=1, epoch=2, seed=7)


@query("""
WITH e AS (SELECT label AS language, vec_id // 8 AS batch, vec_id, 8 + vec_id % 50 AS n FROM embeddings)
SELECT CAST(language AS VARCHAR) AS language, batch, CAST(count(*) AS INTEGER) AS rows, CAST(max(n) AS INTEGER) AS longest, CAST(count(*) * max(n) AS BIGINT) AS cells, string_agg(CAST(n AS VARCHAR), ',' ORDER BY vec_id) AS lengths,
  string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) AS targets FROM e GROUP BY ALL
""")
def collated(spark, sf_dir):
    own = _t(spark, sf_dir, "embeddings").withColumn("n", (8 + F.col("vec_id") % 50).cast("int"))
    batches = own.groupBy(F.col("label").cast("string").alias("language"), F.lit(0).alias("bucket"), F.floor(F.col("vec_id") / 8).alias("batch")).agg(F.array_sort(F.collect_list("vec_id")).alias("keys"))
    rows = own.select(F.col("vec_id").alias("ord"), F.slice(F.transform("embedding", lambda v: v.cast("double")), 1, F.col("n")).alias("x"), "n", F.array("vec_id").alias("ids"))
    rows = rows.select("ord", A.pad_to(F.col("x"), F.lit(0)).alias("audio"), "ids", "n")
    rows = rows.withColumn("audio", F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.lit(1.0)))
    made = batching.collate(batches, rows.select("ord", "audio", "ids"))
    longest = F.array_max("audio_lengths")
    return made.select("language", "batch", F.size("audio").alias("rows"), longest.alias("longest"), F.aggregate("audio", F.lit(0).cast("bigint"), lambda a, x: a + F.size(x)).alias("cells"), F.array_join("audio_lengths", ",").alias("lengths"), F.array_join("targets", ",").alias("targets"))


@query(f"""
WITH x AS (SELECT coalesce(language, 'None') AS language, {_strip("coalesce(text, '')")} AS text FROM train_final), w AS (SELECT *, {_words("text")} AS w FROM x WHERE text <> '')
SELECT language, count(*) AS utterances, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(len(w)) AS BIGINT) AS tokens, CAST(sum(len(list_filter(w, lambda y: length(y) = 4))) AS BIGINT) AS unk_tokens FROM w GROUP BY language
""")
def piece_coverage(spark, sf_dir):
    return reports.coverage(_t(spark, sf_dir, "train_final"), tokens.tokenize(tokens.Words), unknown=4)


@query(f"""
WITH w AS (SELECT ord, list_transform({_words("text")}, lambda x: CAST(length(x) AS INTEGER)) AS l FROM val_final WHERE text IS NOT NULL), i AS (SELECT ord, CASE WHEN len(l) = 0 THEN [0] ELSE l END AS ids FROM w)
SELECT ord, array_to_string(ids, ',') AS ids, array_to_string(list_transform(ids, lambda n: repeat('x', n)), ' ') AS text FROM i
""")
def token_round_trip(spark, sf_dir):
    rows = _t(spark, sf_dir, "val_final").where("text is not null").select("ord", tokens.tokenize(tokens.Words)(F.col("text")).alias("ids"))
    return rows.select("ord", F.array_join("ids", ",").alias("ids"), tokens.detokenize(tokens.Words)(A.shift_ids(F.col("ids"))).alias("text"))


@query("""
SELECT l_linestatus AS kind, count(*) FILTER (WHERE l_quantity > 10) AS files_ok, count(*) FILTER (WHERE l_quantity <= 10) AS files_failed,
  CAST(sum(CASE WHEN l_quantity > 10 THEN l_linenumber ELSE 0 END) AS BIGINT) AS items, sum(CASE WHEN l_quantity > 10 THEN CAST(l_quantity * 1000000 AS BIGINT) ELSE 0 END) / 1e6 AS seconds FROM lineitem GROUP BY l_linestatus
""")
def bank_totals(spark, sf_dir):
    q = F.col("l_quantity").cast("double")
    return reports.bank_stats(_t(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("kind"), (q > 10).alias("ok"), F.col("l_linenumber").alias("items"), q.alias("seconds")))


@query(f"SELECT ord, replace(text, chr(10), ' ') AS line, contains(lower(text), '429') OR contains(lower(text), 'too many requests') OR contains(lower(text), 'rate limit') AS slow_down FROM train_final")
def text_forms(spark, sf_dir):
    return _t(spark, sf_dir, "train_final").select("ord", X.one_line(F.col("text")).alias("line"), X.is_rate_limit(F.col("text")).alias("slow_down"))


# --- waveforms and features --------------------------------------------------------------------------------------------

_LONG = "v AS (SELECT vec_id, flatten(list_transform(range(250), lambda i: list_transform(embedding, lambda x: x::DOUBLE))) AS x FROM embeddings WHERE vec_id IS NOT NULL)"


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS x FROM embeddings), p AS (SELECT *, list_max(x) AS peak FROM v)
SELECT vec_id, 250 * len(x) AS n, round(CASE WHEN peak > 0 THEN peak / (peak + 1e-6) ELSE 0 END, 6) AS top FROM p
""")
def peak_norm_long(spark, sf_dir):
    one_second = F.flatten(F.array_repeat(F.transform("embedding", lambda v: v.cast("double")), 250))
    made = _t(spark, sf_dir, "embeddings").select("vec_id", A.peak_normalise(one_second).alias("x"))
    return made.select("vec_id", F.size("x").cast("bigint").alias("n"), F.round(F.array_max(F.transform("x", F.abs)), 6).alias("top"))


@query("SELECT vec_id, CAST(generate_subscripts(range(32), 1) - 1 AS INTEGER) AS pos, round((unnest(embedding[1:32])::DOUBLE + unnest(embedding[33:64])::DOUBLE) / 2, 6) AS v FROM embeddings")
def mono_mix(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    two = _t(spark, sf_dir, "embeddings").select("vec_id", A.mono(F.array(F.slice(x, 1, 32), F.slice(x, 33, 32))).alias("m"))
    return two.select("vec_id", F.posexplode("m").alias("pos", "v")).select("vec_id", "pos", F.round("v", 6).alias("v"))


@query("SELECT vec_id, label / 32768.0::DOUBLE AS int16, label / 2147483648.0::DOUBLE AS int32, (label - 128) / 128.0::DOUBLE AS uint8 FROM embeddings")
def pcm_floats(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings")
    return rows.select("vec_id", *[A.pcm_to_float(F.array(F.col("label").cast("int")), k)[0].alias(k) for k in ("int16", "int32", "uint8")])


@query("""
WITH m AS (SELECT vec_id, list_transform(range(8), lambda r: list_transform(embedding[r * 8 + 1:r * 8 + 8], lambda x: x::DOUBLE)) AS m, label % 5 AS a FROM embeddings)
SELECT vec_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, round(CASE WHEN (c >= a AND c < a + 3) OR (r >= a + 1 AND r < a + 3) THEN 0 ELSE m[r + 1][c + 1] END, 6) + 0 AS v
FROM m, (SELECT unnest(range(8)) AS r), (SELECT unnest(range(8)) AS c)
""")
def feature_masks(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 5).cast("int").alias("a"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice(x, r * 8 + 1, 8)).alias("m"))
    masked = A.mask_frames(A.mask_bands(F.col("m"), F.col("a"), F.lit(3)), F.col("a") + 1, F.lit(2))
    each = rows.select("vec_id", F.posexplode(masked).alias("r", "row")).select("vec_id", "r", F.posexplode("row").alias("c", "v"))
    return each.select("vec_id", "r", "c", (F.round("v", 6) + 0.0).alias("v"))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS x, list_transform(embedding[33:64], lambda x: x::DOUBLE) AS n FROM embeddings),
e AS (SELECT *, list_sum(list_transform(x, lambda a: a * a)) / 32 AS px, list_sum(list_transform(n, lambda a: a * a)) / 32 AS pn FROM v)
SELECT vec_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, round(greatest(-1, least(1, unnest(x) + CASE WHEN pn > 0 THEN sqrt(px / pow(10, 1.0) / pn) ELSE 0 END * unnest(n))), 4) + 0.0 AS v FROM e
""")
def noise_mix(spark, sf_dir):
    @F.pandas_udf("array<double>")
    def mixed(x):
        return x.map(lambda v: signal.add_noise(np.asarray(v[:32], np.float64), np.asarray(v[32:], np.float64), 10.0).astype(np.float64))

    rows = _t(spark, sf_dir, "embeddings").select("vec_id", mixed(F.transform("embedding", lambda v: v.cast("double"))).alias("m"))
    return rows.select("vec_id", F.posexplode("m").alias("pos", "v")).select("vec_id", "pos", (F.round("v", 4) + 0.0).alias("v"))


@query("SELECT vec_id, CAST(8 + label AS INTEGER) AS length, CAST((SELECT 8 + max(label) FROM embeddings) AS INTEGER) AS padded, round(list_sum(list_transform(embedding[1:8 + label], lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def bank_packed(spark, sf_dir):
    clips = _clips(spark, sf_dir).select("vec_id", F.slice("samples", 1, F.col("label") + 8).alias("samples"))
    packed = audio.packed_bank(clips)
    return packed.select("vec_id", "length", F.size("samples").alias("padded"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


# --- transducer decoding with networks that only look at the frame -------------------------------------------------------

_CODES = """
f AS (SELECT vec_id, unnest(range(16)) AS t, embedding FROM embeddings),
g AS (SELECT vec_id, t, list_position(embedding[t * 4 + 1:t * 4 + 4], list_max(embedding[t * 4 + 1:t * 4 + 4])) - 1 AS token FROM f)"""


def _frames_of(spark, sf_dir) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("utt_id"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.slice(x, t * 4 + 1, 4)).alias("frames"))


@query(f"WITH {_CODES} SELECT vec_id AS utt_id, coalesce(string_agg(CAST(token AS VARCHAR), ',' ORDER BY t) FILTER (WHERE token <> 0), '') AS ids, count(*) FILTER (WHERE token = 0) AS blanks FROM g GROUP BY vec_id")
def rnnt_greedy(spark, sf_dir):
    networks = lambda: (lambda tokens: np.zeros(1), lambda frame, state: (frame, None))
    out = decode.decode(_frames_of(spark, sf_dir), networks, most_per_frame=1)
    return out.select("utt_id", F.array_join("ids", ",").alias("ids"), F.col("blanks").cast("bigint").alias("blanks"))


@query(f"WITH {_CODES} SELECT vec_id AS utt_id, coalesce(string_agg(CAST(token AS VARCHAR), ',' ORDER BY t) FILTER (WHERE token <> 0), '') AS ids FROM g WHERE t % 3 = 0 GROUP BY vec_id")
def tdt_greedy(spark, sf_dir):
    networks = lambda: (lambda tokens: np.zeros(1), lambda frame, state: (frame, np.array([0.0, 0.0, 1.0])))
    out = decode.decode(_frames_of(spark, sf_dir), networks, durations=True)
    return out.select("utt_id", F.array_join("ids", ",").alias("ids"))


@query("SELECT vec_id AS path, CAST(len(embedding) AS VARCHAR) || ' samples' AS text FROM embeddings")
def transcripts(spark, sf_dir):
    model = lambda: lambda waves: [f"{len(w)} samples" for w in waves]
    return decode.transcribe(_clips(spark, sf_dir).withColumnRenamed("vec_id", "path"), model)


_PATHS = """
p AS (SELECT vec_id, unnest(range(3)) AS t, embedding FROM embeddings),
e AS (SELECT vec_id, t, list_transform(embedding[t * 3 + 1:t * 3 + 3], lambda x: exp(4 * x::DOUBLE)) AS w FROM p),
q AS (SELECT vec_id, t, list_transform(w, lambda x: x / list_sum(w)) AS w FROM e),
f AS (SELECT vec_id, max(w) FILTER (WHERE t = 0) AS a, max(w) FILTER (WHERE t = 1) AS b, max(w) FILTER (WHERE t = 2) AS c FROM q GROUP BY vec_id),
s AS (SELECT vec_id, a[i + 1] * b[j + 1] * c[k + 1] AS v, concat(CASE WHEN i <> 0 THEN i END, CASE WHEN j <> 0 AND j <> i THEN j END, CASE WHEN k <> 0 AND k <> j THEN k END) AS ids
  FROM f, (SELECT unnest(range(3)) AS i), (SELECT unnest(range(3)) AS j), (SELECT unnest(range(3)) AS k)),
g AS (SELECT vec_id, ids, sum(v) AS v FROM s GROUP BY ALL)"""


@query(f"WITH {_PATHS} SELECT vec_id, arg_max(ids, v) AS ids FROM g GROUP BY vec_id")
def beam_decode(spark, sf_dir):
    x = F.transform("embedding", lambda v: 4 * v.cast("double"))
    frames = F.array(*[F.slice(x, 3 * t + 1, 3) for t in range(3)])
    norm = F.transform(frames, lambda r: F.transform(r, lambda v: v - F.log(F.aggregate(r, F.lit(0.0), lambda a, y: a + F.exp(y)))))
    found = beam.beam_search(_t(spark, sf_dir, "embeddings").select("vec_id", norm.alias("log_probs")), 40, "vec_id")
    return found.select("vec_id", F.array_join("ids", "").alias("ids"))


# --- watching, metrics, previews, batches ------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT user_id, event_id, event_type AS step, coalesce(event_type <> lag(event_type) OVER w, true) AS moved FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(moved::INT) OVER (PARTITION BY user_id ORDER BY rn) AS run FROM (SELECT p.*, row_number() OVER (PARTITION BY user_id ORDER BY ts, p.event_id) AS rn FROM p JOIN events e ON e.event_id = p.event_id))
SELECT user_id, any_value(step) AS step, count(*) - 1 AS looks FROM r GROUP BY user_id, run HAVING count(*) - 1 >= 3
""".replace("(PARTITION BY user_id ORDER BY ts, p.event_id) AS rn FROM p JOIN events e ON e.event_id = p.event_id", "(PARTITION BY p.user_id ORDER BY e.ts, p.event_id) AS rn FROM p JOIN events e ON e.event_id = p.event_id"))
def stuck_jobs(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("step"))
    return supervise.stuck_jobs(events, ["user_id"], ["ts", "event_id"], most_stalls=3)


@query("""
SELECT 'run' AS run, s AS step, (SELECT count(*) FROM val_final WHERE ord % 3 = s)::DOUBLE AS rows, CASE WHEN s = 1 THEN NULL ELSE (SELECT count(text) FROM val_final WHERE ord % 3 = s)::DOUBLE END AS texts
FROM (SELECT unnest([0, 1, 2]::BIGINT[]) AS s)
""")
def metric_log(spark, sf_dir):
    folder = scratch_path(spark, "metrics")
    counts = _t(spark, sf_dir, "val_final").groupBy((F.col("ord") % 3).alias("s")).agg(F.count(F.lit(1)).alias("rows"), F.count("text").alias("texts")).collect()  # three steps
    for r in counts:
        sinks.log_metrics(spark, folder, r["s"], {"rows": 0.0})
        sinks.log_metrics(spark, folder, r["s"], {"rows": r["rows"]} | ({"texts": r["texts"]} if r["s"] != 1 else {}))
    return sinks.metric_table(sinks.logged_metrics(spark, folder), ["rows", "texts"])


@query("SELECT vec_id AS clip_id, k AS kind, len(embedding) / 16000.0::DOUBLE AS seconds, len(embedding) / 16000.0::DOUBLE AS probed FROM embeddings, (SELECT unnest(['clean', 'masked', 'full']) AS k)")
def preview_files(spark, sf_dir):
    folder = scratch_path(spark, "previews")
    made = sinks.write_previews(_clips(spark, sf_dir).withColumnRenamed("vec_id", "clip_id"), folder)
    made.write.parquet(f"{folder}/_rows")
    made = spark.read.parquet(f"{folder}/_rows").withColumn("file", F.regexp_extract("path", r"([^/]+)$", 1))
    found = audio.probe(audio.audio_files(spark, folder)).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("seconds").alias("probed"))
    return made.join(found, "file", "left").select("clip_id", "kind", "seconds", "probed")


@query("""
WITH e AS (SELECT label, vec_id // 8 AS b, vec_id, 5 + vec_id % 9 AS o, 3 + vec_id % 11 AS n FROM embeddings),
g AS (SELECT label, b, string_agg(CAST(o AS VARCHAR), ',' ORDER BY vec_id) FILTER (WHERE o >= n) AS out_lens, string_agg(rtrim(repeat(vec_id || ',', n), ','), ',' ORDER BY vec_id) FILTER (WHERE o >= n) AS targets, count(*) FILTER (WHERE o >= n) = 0 AS skipped FROM e GROUP BY ALL)
SELECT label, b, coalesce(out_lens, '') AS out_lens, coalesce(targets, '') AS targets, skipped FROM g
""")
def feasible_batches(spark, sf_dir):
    own = _t(spark, sf_dir, "embeddings").select("label", F.floor(F.col("vec_id") / 8).alias("b"), "vec_id", (5 + F.col("vec_id") % 9).cast("int").alias("o"), (3 + F.col("vec_id") % 11).cast("int").alias("n"))
    lists = own.groupBy("label", "b").agg(F.array_sort(F.collect_list(F.struct("vec_id", "o", "n"))).alias("m"))
    targets = F.flatten(F.transform("m", lambda m: F.array_repeat(m["vec_id"], m["n"])))
    made = admit.feasible_batches(lists.select("label", "b", F.transform("m", lambda m: m["o"]).alias("out_lens"), F.transform("m", lambda m: m["n"]).alias("target_lens"), targets.alias("targets")))
    return made.select("label", "b", F.array_join("out_lens", ",").alias("out_lens"), F.array_join("targets", ",").alias("targets"), "skipped")


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), p AS (SELECT vec_id, x, unnest(range(58)) AS i FROM v),
q AS (SELECT vec_id, x, i, greatest(0, least(63, (i + 0.5::DOUBLE) * 64 / 58 - 0.5)) AS place FROM p)
SELECT vec_id, CAST(i AS INTEGER) AS pos, round(x[floor(place)::INT + 1] * (1 - (place - floor(place))) + x[ceil(place)::INT + 1] * (place - floor(place)), 2) + 0.0 AS v FROM q
""")
def speed_changed(spark, sf_dir):
    changed = signal.samples_udf(lambda x: signal.change_speed(x, 1.1))
    rows = _clips(spark, sf_dir).select("vec_id", F.posexplode(changed(F.col("samples"))).alias("pos", "v"))
    return rows.select("vec_id", "pos", (F.round(F.col("v").cast("double"), 2) + 0.0).alias("v"))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), p AS (SELECT vec_id, x, unnest(range(64)) AS i FROM v)
SELECT vec_id, CAST(i AS INTEGER) AS pos, round(x[i + 1] + CASE WHEN i > 0 THEN x[i] * 0.5 ELSE 0 END + CASE WHEN i > 1 THEN x[i - 1] * 0.25 ELSE 0 END, 2) + 0.0 AS v FROM p
""")
def reverberated(spark, sf_dir):
    changed = signal.samples_udf(lambda x: signal.reverberate(x, np.array([1.0, 0.5, 0.25], np.float32)))
    rows = _clips(spark, sf_dir).select("vec_id", F.posexplode(changed(F.col("samples"))).alias("pos", "v"))
    return rows.select("vec_id", "pos", (F.round(F.col("v").cast("double"), 2) + 0.0).alias("v"))


@query("SELECT vec_id, CAST(len(embedding) // 16 + 1 AS INTEGER) AS frames, 80 AS mels FROM embeddings")
def mel_shape(spark, sf_dir):
    ten = F.flatten(F.array_repeat("samples", 10))  # 640 samples, so that a hop of 160 makes frames
    made = _clips(spark, sf_dir).select("vec_id", signal.features_udf()(ten).alias("m"))
    return made.select("vec_id", F.size("m").alias("frames"), F.size(F.col("m")[0]).alias("mels"))


@query("""
WITH g AS (SELECT vec_id, unnest(range(1 + label % 8)) AS t, embedding FROM embeddings)
SELECT vec_id, CAST(t AS INTEGER) AS t, round(exp(embedding[t * 8 + 1]::DOUBLE), 6) AS first, CAST(5 AS INTEGER) AS symbols FROM g
""")
def probs_cut(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", (1 + F.col("label") % 8).cast("int").alias("n"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice(x, t * 8 + 1, 8)).alias("frames"))
    cut = rows.select("vec_id", F.posexplode(A.to_probs(F.col("frames"), F.col("n"), 5)).alias("t", "p"))
    return cut.select("vec_id", "t", F.round(F.col("p")[0], 6).alias("first"), F.size("p").alias("symbols"))


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type")
def outcome_totals(spark, sf_dir):
    return reports.outcomes(_t(spark, sf_dir, "events"), "event_type")


@query("""
SELECT vec_id AS clip_id, round(list_sum(list_transform(embedding[1:32], lambda x: abs(x::DOUBLE / greatest(1e-8, list_sum(list_transform(embedding[1:32], lambda y: abs(y::DOUBLE))))))), 6) AS energy
FROM embeddings ORDER BY md5('42:' || vec_id), vec_id LIMIT 25
""")
def bank_choice(spark, sf_dir):
    clips = _clips(spark, sf_dir).withColumnRenamed("vec_id", "clip_id").withColumn("samples", F.transform("samples", lambda v: v.cast("double")))
    made = audio.bank(clips, least_s=0.001, most_items=25, responses=True, most_s=0.002)
    return made.select("clip_id", F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("energy"))


@query("SELECT bool_and(seq % 2 = 0) AS as_they_are, true AS all_done, false AS none_there FROM source_spec")
def exhausted_flag(spark, sf_dir):
    states, _ = _states(spark, sf_dir)
    done = states.withColumn("exhausted", F.lit(True))
    return spark.createDataFrame([(assemble.all_exhausted(states), assemble.all_exhausted(done), assemble.all_exhausted(done.limit(0)))], "as_they_are boolean, all_done boolean, none_there boolean")


@query("SELECT uid, text FROM test_final")
def backup_copy(spark, sf_dir):
    path, kept = scratch_path(spark, "manifest"), scratch_path(spark, "backups")
    sinks.write_manifest(_t(spark, sf_dir, "test_final").select("ord", "uid", "text"), path)
    copy = sinks.backup(spark, path, kept)
    sinks.write_manifest(_t(spark, sf_dir, "val_final").select("ord", "uid", "text"), path)
    return manifests.read_manifest(spark, copy).select("uid", "text")
