"""All queries over the reference's operators on the test tables, each over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.functions import arrays as A
from voxloom.functions import text as X
from voxloom.operators import admit, assemble, batching, reports, scoring
from voxloom.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL building blocks ---------------------------------------------------------------------------------------------

_B = X.BLANK


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_B}]+|[{_B}]+$', '', 'g')"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{_B}]+'), lambda w: w <> '')"


def _list_distance(a: str, b: str) -> str:
    """Distance of two lists with at most 127 different elements, which become one-byte characters."""
    code = lambda x: f"array_to_string(list_transform({x}, lambda w: chr(CAST(list_position(list_distinct(list_concat({a}, {b})), w) AS INTEGER))), '')"
    return f"levenshtein({code(a)}, {code(b)})"


_KEY = "coalesce(nullif(uid, ''), nullif(audio_filepath, ''))"
_MICRO = "CAST(round(duration * 1000000) AS BIGINT)"
_USABLE = "duration > 0 AND NOT isnan(duration)"


def _scored(fold: bool = True) -> str:
    form = (lambda c: _strip(f"lower(coalesce({c}, ''))")) if fold else (lambda c: _strip(f"coalesce({c}, '')"))
    chars = lambda c: f"regexp_extract_all({c}, '(?s).')"
    return f"""
a AS (SELECT *, {form("reference")} AS r, {form("hypothesis")} AS h FROM hypotheses),
b AS (SELECT *, {_words("r")} AS rw, {_words("h")} AS hw, {chars("r")} AS rc, {chars("h")} AS hc FROM a),
e AS (SELECT *, CASE WHEN r = '' THEN 0 ELSE {_list_distance("rw", "hw")} END AS wer_num, CASE WHEN r = '' THEN 0 ELSE len(rw) END AS wer_den,
  CASE WHEN r = '' THEN 0 ELSE {_list_distance("rc", "hc")} END AS cer_num, CASE WHEN r = '' THEN 0 ELSE len(rc) END AS cer_den FROM b)"""


# --- scoring ---------------------------------------------------------------------------------------------------------

_SUMS = "CAST(sum(n) AS BIGINT) AS num_samples, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in scoring.SUMS[1:])
_ROLLUP = f"""
WITH {_scored()},
u AS (SELECT split, coalesce(nullif(language, ''), 'unknown') AS language, decode_type, beam_width, alpha, beta, 1 AS n, wer_num, wer_den, cer_num, cer_den FROM e WHERE wer_den > 0 OR cer_den > 0),
v AS (SELECT * FROM u UNION ALL SELECT * REPLACE ('all' AS language) FROM u),
m AS (SELECT split, language, decode_type, beam_width, alpha, beta, {_SUMS} FROM v GROUP BY ALL),
f AS (SELECT 'full' AS split, language, decode_type, beam_width, alpha, beta, CAST(sum(num_samples) AS BIGINT) AS num_samples, CAST(sum(wer_num) AS BIGINT) AS wer_num, CAST(sum(wer_den) AS BIGINT) AS wer_den, CAST(sum(cer_num) AS BIGINT) AS cer_num, CAST(sum(cer_den) AS BIGINT) AS cer_den
      FROM m WHERE KEEP GROUP BY ALL)
SELECT *, wer_num::DOUBLE / greatest(wer_den::DOUBLE, 1e-8) AS wer, cer_num::DOUBLE / greatest(cer_den::DOUBLE, 1e-8) AS cer FROM (SELECT * FROM m UNION ALL SELECT * FROM f)
"""


@query(_ROLLUP.replace("KEEP", "language IS NOT NULL AND decode_type IS NOT NULL AND beam_width IS NOT NULL AND alpha IS NOT NULL AND beta IS NOT NULL"))
def wer_rollup(spark, sf_dir):
    return scoring.sorted_results(scoring.rollup(scoring.split_metrics(_t(spark, sf_dir, "hypotheses"))))


@query(_ROLLUP.replace("KEEP", "true"))
def wer_rollup_all(spark, sf_dir):
    return scoring.rollup(scoring.split_metrics(_t(spark, sf_dir, "hypotheses")), include_null_keys=True)


@query(f"""
WITH {_scored(False)},
g AS (SELECT unnest(CASE WHEN language IN ('en', 'pl') THEN ['overall', language] ELSE ['overall'] END) AS g, * FROM e WHERE wer_den > 0),
s AS (SELECT g, sum(wer_num)::DOUBLE / greatest(sum(wer_den)::DOUBLE, 1e-8) AS wer, sum(cer_num)::DOUBLE / greatest(sum(cer_den)::DOUBLE, 1e-8) AS cer FROM g GROUP BY g)
SELECT 'wer/' || g AS metric, wer AS value FROM s UNION ALL SELECT 'cer/' || g, cer FROM s
""")
def wer_by_lang(spark, sf_dir):
    return scoring.by_language(_t(spark, sf_dir, "hypotheses"))


@query(f"WITH {_scored()} SELECT utt_id, decode_type, CAST(cer_num AS BIGINT) AS cer_num, CAST(cer_den AS BIGINT) AS cer_den FROM e")
def cer_char(spark, sf_dir):
    return scoring.with_errors(_t(spark, sf_dir, "hypotheses")).select("utt_id", "decode_type", "cer_num", "cer_den")


@query(f"WITH {_scored()} SELECT utt_id, decode_type, CAST(wer_num AS BIGINT) AS wer_num, CAST(wer_den AS BIGINT) AS wer_den FROM e")
def word_edit_distance(spark, sf_dir):
    return scoring.with_errors(_t(spark, sf_dir, "hypotheses")).select("utt_id", "decode_type", "wer_num", "wer_den")


_ARRIVAL = ("utt_id", "decode_type", "beam_width", "alpha", "beta", "hypothesis")
_ARRIVAL_SQL = ", ".join(f"{c} NULLS FIRST" for c in _ARRIVAL)


@query(f"""
WITH {_scored()} SELECT utt_id, dataset, language, reference, hypothesis, cer_num::DOUBLE / cer_den AS cer FROM e WHERE cer_den > 0
ORDER BY cer DESC, {_ARRIVAL_SQL} LIMIT 50
""")
def worst_k(spark, sf_dir):
    return scoring.worst(_t(spark, sf_dir, "hypotheses"), 50, _ARRIVAL).select("utt_id", "dataset", "language", "reference", "hypothesis", "cer")


@query(f"""
SELECT language, reference, hypothesis FROM hypotheses WHERE language IN ('en', 'pl')
QUALIFY row_number() OVER (PARTITION BY language ORDER BY {_ARRIVAL_SQL}) <= 2
""")
def first_k_per_lang(spark, sf_dir):
    return scoring.first_per_language(_t(spark, sf_dir, "hypotheses"), 2, arrival=_ARRIVAL).select("language", "reference", "hypothesis")


_TYPES = ["view", "click", "error", "purchase", "signup"]
_FRAMES_SQL = f"f AS (SELECT user_id AS utt_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, list_position({_TYPES}, event_type) - 1 AS token FROM events)"


def _frames(spark, sf_dir):
    token = F.array_position(F.array(*map(F.lit, _TYPES)), F.col("event_type")).cast("int") - 1
    return _t(spark, sf_dir, "events").select(F.col("user_id").alias("utt_id"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("t"), token.alias("token"))


@query(f"""
WITH {_FRAMES_SQL}, k AS (SELECT *, lag(token, 1, -1) OVER (PARTITION BY utt_id ORDER BY t) AS last FROM f)
SELECT utt_id, coalesce(string_agg(CAST(token AS VARCHAR), ',' ORDER BY t) FILTER (WHERE token <> last AND token <> 0), '') AS ids FROM k GROUP BY utt_id
""")
def ctc_collapse(spark, sf_dir):
    ids = scoring.frames_to_ids(_frames(spark, sf_dir))
    return ids.select("utt_id", F.array_join("ids", ",").alias("ids"))


@query(f"WITH {_FRAMES_SQL} SELECT utt_id, count(*) AS frames, count(*) FILTER (WHERE token = 0)::DOUBLE / greatest(count(*), 1) AS blank_fraction FROM f GROUP BY utt_id")
def blank_fraction(spark, sf_dir):
    return scoring.blank_fraction(_frames(spark, sf_dir), ["utt_id"])


@query("""
SELECT * FROM (VALUES ('greedy', NULL, NULL, NULL)) v(decode_type, beam_width, alpha, beta)
UNION ALL SELECT 'beam', w, NULL, NULL FROM unnest([4, 8, 16]) t(w)
UNION ALL SELECT 'beam_kenlm', w, a, b FROM unnest([4, 8, 16]) t(w), unnest([0.5::DOUBLE, 1.0::DOUBLE]) u(a), unnest([1.0::DOUBLE, 1.5::DOUBLE]) x(b)
""")
def param_sweep(spark, sf_dir):
    return scoring.parameter_sweep(spark, ["greedy", "beam", "beam_kenlm"], [4, 8, 16], [0.5, 1.0], [1.0, 1.5])


_PARAMETERS = "CASE l_linenumber % 4 WHEN 0 THEN 'net.joint.w' WHEN 1 THEN 'net.decoder.w' WHEN 2 THEN 'net.proj.w' ELSE 'net.encoder.w' END"


@query(f"""
WITH k AS (SELECT l_orderkey AS checkpoint, {_PARAMETERS} AS name FROM lineitem)
SELECT checkpoint, CASE WHEN bool_or(starts_with(name, 'net.joint.')) THEN 'tdt' WHEN bool_or(starts_with(name, 'net.ctc_proj.') OR starts_with(name, 'net.decoder.')) THEN 'ctc_attention'
  WHEN bool_or(starts_with(name, 'net.proj.')) THEN 'ctc' END AS model_type FROM k GROUP BY checkpoint
""")
def model_type(spark, sf_dir):
    keys = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("checkpoint"), F.expr(_PARAMETERS).alias("name"))
    return scoring.model_type(keys)


# --- reports ---------------------------------------------------------------------------------------------------------


@query(f"""
SELECT dataset, grouping(dataset) = 1 AS total, count(*) AS n, sum({_MICRO}) / 1e6 AS seconds, sum({_MICRO}) / 1e6 / 3600 AS hours, sum({_MICRO}) / 1e6 / count(*) AS average
FROM train_final WHERE {_USABLE} GROUP BY ROLLUP (dataset)
""")
def manifest_summary(spark, sf_dir):
    return reports.summarize(_t(spark, sf_dir, "train_final"), strict=False)


@query(f"""
WITH a AS (SELECT dataset, count(*) AS n, sum({_MICRO}) / 1e6 / 3600 AS h FROM train_final WHERE {_USABLE} GROUP BY ALL),
b AS (SELECT dataset, count(*) AS n, sum({_MICRO}) / 1e6 / 3600 AS h FROM val_final WHERE {_USABLE} GROUP BY ALL)
SELECT coalesce(a.dataset, b.dataset) AS dataset, coalesce(a.n, 0) AS train_n, coalesce(a.h, 0) AS train_hours, coalesce(b.n, 0) AS val_n, coalesce(b.h, 0) AS val_hours
FROM a FULL JOIN b ON a.dataset IS NOT DISTINCT FROM b.dataset
""")
def split_compare(spark, sf_dir):
    return reports.compare(_t(spark, sf_dir, "train_final"), _t(spark, sf_dir, "val_final"))


@query("""
SELECT 'language' AS kind, coalesce(language, 'None') AS value, count(*) AS n FROM train_final GROUP BY ALL
UNION ALL SELECT 'dataset', coalesce(dataset, 'None'), count(*) FROM train_final GROUP BY ALL
""")
def manifest_stats(spark, sf_dir):
    return reports.manifest_stats(_t(spark, sf_dir, "train_final"))


@query("""
SELECT count(*) AS total, count(*) FILTER (WHERE duration IS NULL OR NOT (duration > 0 OR isnan(duration))) AS bad_duration,
  count(*) FILTER (WHERE duration IS NULL) AS missing_duration_field, count(*) FILTER (WHERE v.p IS NULL) AS missing_files
FROM train_final t LEFT JOIN (SELECT DISTINCT audio_filepath AS p FROM train_final WHERE language = 'en') v ON t.audio_filepath = v.p
""")
def duration_audit(spark, sf_dir):
    train = _t(spark, sf_dir, "train_final")
    return reports.audit(train, train.where("language = 'en'").select(F.col("audio_filepath").alias("path")))


@query("""
WITH p AS (SELECT audio_filepath AS path, max(CASE WHEN length(text) > 10 THEN length(text) / 16.0::DOUBLE END) AS s FROM train_final WHERE language = 'en' GROUP BY 1),
j AS (SELECT t.ord, t.duration, p.path, p.s, coalesce(duration > 0 OR isnan(duration), false) AS good FROM train_final t LEFT JOIN p ON t.audio_filepath = p.path)
SELECT ord, CASE WHEN path IS NULL THEN 'missing' WHEN good THEN 'kept' WHEN s IS NULL THEN 'error' ELSE 'fixed' END AS outcome,
  CASE WHEN path IS NOT NULL AND NOT good AND s IS NOT NULL THEN s END AS repaired FROM j
""")
def duration_fix(spark, sf_dir):
    train = _t(spark, sf_dir, "train_final")
    probed = train.where("language = 'en'").select(F.col("audio_filepath").alias("path"), F.when(F.length("text") > 10, F.length("text") / 16.0).alias("seconds"))
    fixed = reports.repair(train, probed, rewrite_all=False)
    return fixed.select("ord", "outcome", F.when(F.col("outcome") == "fixed", F.col("duration")).alias("repaired"))


_TEXTS = f"x AS (SELECT ord, coalesce(language, 'None') AS language, {_strip("coalesce(text, '')")} AS text FROM train_final)"


@query(f"""
WITH {_TEXTS}, l AS (SELECT unnest(regexp_extract_all('{reports.POLISH_LETTERS}', '.')) AS letter)
SELECT letter, CAST(sum(length(text) - length(replace(text, letter, ''))) AS BIGINT) AS count, sum(length(text) - length(replace(text, letter, ''))) > 0 AS present
FROM x, l WHERE language = 'pl' AND text <> '' GROUP BY letter
""")
def char_coverage(spark, sf_dir):
    return reports.letter_coverage(_t(spark, sf_dir, "train_final"))


@query(f"WITH {_TEXTS} SELECT language, count(*) AS utterances, CAST(sum(length(text)) AS BIGINT) AS characters FROM x WHERE text <> '' GROUP BY language")
def coverage_report(spark, sf_dir):
    return reports.coverage(_t(spark, sf_dir, "train_final"))


@query(f"""
WITH {_TEXTS}, r AS (SELECT *, length(text) AS len, md5('7:' || ord) AS h FROM x WHERE text <> ''),
g AS (SELECT language, sum(len) AS total, max(sum(len)) OVER () AS goal FROM r GROUP BY language),
p AS (SELECT r.*, total, goal, sum(len) OVER (PARTITION BY r.language ORDER BY h, ord) AS upto FROM r JOIN g USING (language))
SELECT language, ord, CAST(floor(goal / total) + CASE WHEN upto - len < goal - floor(goal / total) * total THEN 1 ELSE 0 END AS BIGINT) AS times FROM p
""")
def balance_corpus(spark, sf_dir):
    rows = _t(spark, sf_dir, "train_final").select("ord", F.coalesce("language", F.lit("None")).alias("language"), X.strip(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''")
    return reports.balance(rows, seed=7).groupBy("language", "ord").agg(F.count(F.lit(1)).alias("times"))


@query("""
WITH e AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
SELECT CAST(label AS VARCHAR) AS name, CAST(pos - 1 AS INTEGER) AS pos, round(avg(v::DOUBLE), 6) AS value FROM e GROUP BY ALL
""")
def average_vectors(spark, sf_dir):
    epoch = F.row_number().over(W.partitionBy("label").orderBy("vec_id"))
    vectors = _t(spark, sf_dir, "embeddings").select(epoch.alias("epoch"), F.col("label").cast("string").alias("name"), F.col("embedding").alias("values"))
    return reports.average_parameters(vectors).select("name", F.posexplode("values").alias("pos", "v")).select("name", "pos", F.round("v", 6).alias("value"))


_NAMES = "CASE o_orderkey % 4 WHEN 0 THEN concat('ctc-epoch=', CAST(o_orderkey AS STRING), '-v.ckpt') WHEN 1 THEN concat(CAST(o_orderkey AS STRING), '-wer.ckpt') WHEN 2 THEN 'last.ckpt' ELSE concat('v', CAST(o_orderkey AS STRING)) END"
_EPOCH_SQL = r"CAST(coalesce(nullif(regexp_extract(name, 'epoch=(\d+)', 1), ''), nullif(regexp_extract(name, '^(\d+)-', 1), '')) AS INTEGER)"


@query(f"WITH n AS (SELECT o_orderkey, {_NAMES} AS name FROM orders) SELECT o_orderkey, name, {_EPOCH_SQL} AS epoch FROM n")
def epoch_parse(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.expr(_NAMES).alias("name")).withColumn("epoch", X.epoch_of(F.col("name")))


@query(f"WITH n AS (SELECT {_NAMES} AS name FROM orders), e AS (SELECT name, {_EPOCH_SQL} AS epoch FROM n) SELECT * FROM e WHERE name <> 'last.ckpt' AND epoch IS NOT NULL ORDER BY epoch DESC, name DESC LIMIT 5")
def last_n(spark, sf_dir):
    return reports.last_checkpoints(_t(spark, sf_dir, "orders").select(F.expr(_NAMES).alias("name")), 5)


_SOURCE = "SELECT concat(CASE WHEN vec_id % 3 = 0 THEN 'net.encoder.' ELSE 'net.proj.' END, CAST(vec_id AS STRING)) AS name, CASE WHEN vec_id % 7 = 0 THEN '8x8' ELSE '64' END AS shape, label AS value FROM embeddings"
_TARGET = "SELECT concat(CASE WHEN vec_id % 3 = 0 THEN 'net.encoder.' ELSE 'net.proj.' END, CAST(vec_id AS STRING)) AS name, '64' AS shape, -label AS value FROM embeddings WHERE vec_id % 5 <> 0"


@query(f"""
WITH s AS (SELECT * FROM ({_SOURCE}) WHERE starts_with(name, 'net.encoder.')), t AS ({_TARGET})
SELECT coalesce(t.name, s.name) AS name, coalesce(t.shape, s.shape) AS shape, CASE WHEN t.name = s.name AND t.shape = s.shape THEN s.value ELSE t.value END AS values,
  CASE WHEN t.name = s.name AND t.shape = s.shape THEN 'copied' WHEN s.name IS NULL THEN 'kept' ELSE 'skipped' END AS outcome
FROM t FULL JOIN s ON t.name = s.name
""")
def encoder_copy(spark, sf_dir):
    vectors = _t(spark, sf_dir, "embeddings")
    at = lambda sql: vectors.sparkSession.sql(sql.replace("FROM embeddings", "FROM {e}"), e=vectors).withColumnRenamed("value", "values")
    return reports.copy_parameters(at(_TARGET), at(_SOURCE), "net.encoder.")


# --- admission -------------------------------------------------------------------------------------------------------


def _cascade(speed: str) -> str:
    return f"""
a AS (SELECT *, CASE WHEN duration > 0 OR isnan(duration) THEN duration END AS d, {_strip("coalesce(text, '')")} AS t FROM MANIFEST),
b AS (SELECT *, CASE WHEN t <> '' THEN greatest(1, len({_words("t")})) END AS target_len,
  CAST(trunc(greatest(0.0::DOUBLE, CASE WHEN isnan(d) THEN 0 ELSE d END * {speed}::DOUBLE) * 16000) AS BIGINT) // 160 + 1 >> 3 AS encoder_len FROM a),
c AS (SELECT *, CASE WHEN d IS NULL THEN 'bad_duration' WHEN NOT isnan(d) AND d > 16 THEN 'too_long' WHEN coalesce(audio_filepath, '') = '' OR t = '' THEN 'missing'
  WHEN encoder_len < target_len THEN 'ctc_too_long' ELSE 'loaded' END AS reason FROM b)"""


@query(f"WITH {_cascade('0.95').replace('MANIFEST', 'train_final')} SELECT reason, count(*) AS n FROM c GROUP BY reason")
def drop_report(spark, sf_dir):
    return admit.drop_report(_t(spark, sf_dir, "train_final"))


def _admitted_sql(table: str, speed: str) -> str:
    return f"""WITH {_cascade(speed).replace("MANIFEST", table)}
SELECT ord, coalesce(nullif(language, ''), 'unknown') AS language, coalesce(nullif(dataset, ''), 'unknown') AS dataset, CAST(target_len AS INTEGER) AS target_len, encoder_len FROM c WHERE reason = 'loaded'"""


@query(_admitted_sql("train_final", "0.95"))
def admitted_train(spark, sf_dir):
    return admit.admitted(_t(spark, sf_dir, "train_final")).select("ord", "language", "dataset", "target_len", "encoder_len")


@query(_admitted_sql("val_final", "1.0"))
def admitted_val(spark, sf_dir):
    return admit.admitted(_t(spark, sf_dir, "val_final"), split="val").select("ord", "language", "dataset", "target_len", "encoder_len")


@query(f"""
WITH s AS (SELECT ord, CAST(trunc(greatest(0.0::DOUBLE, duration * 1.0::DOUBLE) * 16000) AS BIGINT) // 160 + 1 AS frames FROM train_final WHERE {_USABLE})
SELECT ord, frames, (frames - 1) // 2 + 1 AS by_2, frames >> 2 AS by_4, frames >> 3 AS by_8 FROM s
""")
def encoder_len(spark, sf_dir):
    rows = _t(spark, sf_dir, "train_final").where("duration > 0 and not isnan(duration)")
    samples = (F.greatest(F.lit(0.0), F.col("duration") * F.lit(1.0)) * F.lit(16000)).cast("bigint")
    return rows.select("ord", A.mel_frames(samples).alias("frames"), *[A.encoder_length(F.col("duration"), f).alias(f"by_{f}") for f in A.FACTORS])


# --- assembly --------------------------------------------------------------------------------------------------------

_TARGETS = "b AS (SELECT name, min(seq) AS seq, arg_min(samples, seq) // 100 AS target FROM source_spec WHERE phase = 'train' GROUP BY name)"
_BUILT = f"""{_TARGETS},
k AS (SELECT t.*, b.seq, b.target, {_KEY} AS key FROM train_final t JOIN b ON t.dataset = b.name WHERE {_KEY} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seq, key ORDER BY ord) = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY ord) AS place FROM k QUALIFY place <= target)"""


def _targets(spark, sf_dir):
    return assemble.bucket_targets(_t(spark, sf_dir, "source_spec"), "train")


@query(f"WITH {_BUILT} SELECT ord, dataset, seq AS bucket_seq, place FROM f")
def bucket_build(spark, sf_dir):
    return assemble.assemble(_t(spark, sf_dir, "train_final"), _targets(spark, sf_dir)).select("ord", "dataset", "bucket_seq", "place")


@query(f"""
WITH {_BUILT}, s AS (SELECT *, sum(CASE WHEN duration IS NULL OR isnan(duration) THEN 0 ELSE {_MICRO} END) OVER (ORDER BY seq, place) AS upto FROM f),
x AS (SELECT min((seq, place)) AS stop FROM s WHERE upto > 18000000000)
SELECT ord, dataset, seq AS bucket_seq, place FROM s, x WHERE stop IS NULL OR (seq, place) < stop
""")
def bucket_build_hours(spark, sf_dir):
    return assemble.assemble(_t(spark, sf_dir, "train_final"), _targets(spark, sf_dir), max_hours=5.0).select("ord", "dataset", "bucket_seq", "place")


@query(f"WITH {_BUILT} SELECT b.name, b.target, count(f.ord) AS kept, count(f.ord) < b.target AS short FROM b LEFT JOIN f ON f.dataset = b.name GROUP BY b.name, b.target")
def underdelivery(spark, sf_dir):
    targets = _targets(spark, sf_dir)
    return assemble.delivery(assemble.assemble(_t(spark, sf_dir, "train_final"), targets), targets)


@query("SELECT name, phase, count(*) AS sources, arg_min(samples, seq) AS target, count(DISTINCT samples) = 1 AS consistent FROM source_spec GROUP BY ALL")
def bucket_targets(spark, sf_dir):
    specs = _t(spark, sf_dir, "source_spec")
    each = [assemble.bucket_targets(specs, p).withColumn("phase", F.lit(p)) for p in ("train", "val", "test")]
    return each[0].unionByName(each[1]).unionByName(each[2]).select("name", "phase", "sources", "target", "consistent")


@query(f"SELECT {_KEY} AS key FROM train_final WHERE {_KEY} IS NOT NULL INTERSECT SELECT {_KEY} FROM val_final")
def overlap(spark, sf_dir):
    keyed = lambda t: _t(spark, sf_dir, t).where(X.row_key(F.col("uid"), F.col("audio_filepath")).isNotNull())
    return assemble.shared_keys(keyed("train_final"), keyed("val_final"))


@query(f"SELECT count(DISTINCT {_KEY}) AS n FROM train_final")
def unique_keys(spark, sf_dir):
    return assemble.unique_keys(_t(spark, sf_dir, "train_final")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT dataset, count(*) AS n FROM val_final WHERE dataset IN (SELECT name FROM source_spec WHERE phase = 'train') GROUP BY dataset")
def bad_bucket_names(spark, sf_dir):
    return assemble.bucket_names_in(_t(spark, sf_dir, "val_final"), _t(spark, sf_dir, "source_spec").where("phase = 'train'").select("name"))


@query(f"""
WITH m AS (SELECT *, {_KEY} AS key, coalesce(contains(audio_filepath, 'far-mic__'), false) AS far FROM val_final WHERE {_KEY} IS NOT NULL)
SELECT ord, 'near' AS dataset FROM m WHERE NOT far UNION ALL SELECT min(ord), 'far' FROM m WHERE far GROUP BY key
""")
def split_mixed(spark, sf_dir):
    val = _t(spark, sf_dir, "val_final").where(X.row_key(F.col("uid"), F.col("audio_filepath")).isNotNull())
    rest, far = assemble.split_bucket(val, "far-mic__", "near", "far")
    return rest.unionByName(far).select("ord", "dataset")


@query(f"""
WITH h AS (SELECT DISTINCT {_KEY} AS key FROM val_final), n AS (SELECT *, {_KEY} AS key FROM train_final WHERE {_KEY} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) = 1)
SELECT ord, key FROM n WHERE key NOT IN (SELECT key FROM h WHERE key IS NOT NULL)
""")
def dedup_append(spark, sf_dir):
    fresh = assemble.append_new(_t(spark, sf_dir, "val_final"), _t(spark, sf_dir, "train_final"))
    return fresh.select("ord", X.row_key(F.col("uid"), F.col("audio_filepath")).alias("key"))


@query(f"SELECT ord, {_strip('text')} AS text FROM train_final WHERE length({_strip('text')}) >= 2")
def ingest_text(spark, sf_dir):
    return assemble.ingest_text(_t(spark, sf_dir, "train_final").select("ord", "text"))


def _tag(x: str) -> str:
    return f"substring(regexp_replace({_strip(x)}, '[^0-9a-zA-Z._-]+', '_', 'g'), 1, 120)"


@query(f"SELECT ord, {_tag("concat_ws('__', 'hub/voices', coalesce(source, ''), 'train', CASE WHEN nullif(audio_filepath, '') IS NOT NULL THEN 'path:' || audio_filepath WHEN strlen(text) > 0 THEN 'sha1:' || sha1(text) ELSE 'pos:' || ord END)")} AS uid FROM train_final")
def uid(spark, sf_dir):
    train = _t(spark, sf_dir, "train_final")
    made = X.sample_uid(F.lit("hub/voices"), F.col("source"), F.lit("train"), F.col("ord"), F.col("audio_filepath"), F.col("text").cast("binary"))
    return train.select("ord", made.alias("uid"))


@query(f"SELECT ord, {_tag('text')} AS tag FROM train_final")
def safe_tag(spark, sf_dir):
    return _t(spark, sf_dir, "train_final").select("ord", X.safe_tag(F.col("text")).alias("tag"))


@query(r"""
WITH l AS (SELECT ord, regexp_replace(lower(text), '(\p{L})σ([^\p{L}]|$)', '\1ς\2', 'g') AS t FROM train_final),
s AS (SELECT ord, trim(substring(trim(regexp_replace(t, '[^\p{L}\p{N}]+', '_', 'g'), '_'), 1, 40), '_') AS s FROM l)
SELECT ord, CASE WHEN coalesce(s, '') = '' THEN 'sample' ELSE s END AS slug FROM s
""")
def slug(spark, sf_dir):
    return _t(spark, sf_dir, "train_final").select("ord", X.slug(F.col("text")).alias("slug"))


@query("""
SELECT ord, substring(sha1(audio_filepath), 1, 16) AS name, coalesce(nullif(regexp_extract(audio_filepath, '[^/](\\.[^./]+)$', 1), ''), '.audio') AS suffix,
  CASE WHEN starts_with(audio_filepath, '/') THEN audio_filepath ELSE '/root/' || audio_filepath END AS resolved FROM train_final
""")
def path_names(spark, sf_dir):
    p = F.col("audio_filepath")
    return _t(spark, sf_dir, "train_final").select("ord", X.stable_name(p).alias("name"), X.audio_suffix(p).alias("suffix"), X.under_root(p, "/root").alias("resolved"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, coalesce(json_extract_string(props, '$.absent'), 'none') AS absent FROM events")
def json_fields(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", X.json_get(F.col("props"), "k", "none").alias("k"), X.json_get(F.col("props"), "absent", "none").alias("absent"))


@query("SELECT * FROM (SELECT ord, text FROM train_final ORDER BY ord LIMIT 500)")
def head_limit(spark, sf_dir):
    return assemble.head(_t(spark, sf_dir, "train_final"), 500).select("ord", "text")


@query("SELECT ord FROM train_final WHERE ord >= 2000")
def skip_rows(spark, sf_dir):
    return assemble.skip(_t(spark, sf_dir, "train_final"), 2000).select("ord")


@query("SELECT ord FROM train_final ORDER BY md5('42:' || ord), ord LIMIT 300")
def seeded_sample(spark, sf_dir):
    return assemble.seeded_sample(_t(spark, sf_dir, "train_final"), "ord", 300).select("ord")


# --- batches ---------------------------------------------------------------------------------------------------------

_LIMITS = batching.BatchLimits(max_seconds=60.0, max_rows=16, bucket_rows=128)
_PLACED = f"""
r AS (SELECT ord, coalesce(nullif(language, ''), 'unknown') AS language, {_MICRO} AS micro FROM train_final WHERE {_USABLE}),
s AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY md5('8:' || ord), ord) - 1 AS place FROM r)"""


def _batchable(spark, sf_dir):
    rows = _t(spark, sf_dir, "train_final").where("duration > 0 and not isnan(duration)")
    return rows.select("ord", F.coalesce(F.nullif("language", F.lit("")), F.lit("unknown")).alias("language"), "duration")


_PLANNED = f"""RECURSIVE {_PLACED},
q AS (SELECT language, place // 128 AS bucket, ord, micro, row_number() OVER (PARTITION BY language, place // 128 ORDER BY micro, place) AS rn FROM s),
f AS (SELECT language, bucket, rn, ord, micro, 0 AS batch, 1 AS n, micro AS total FROM q WHERE rn = 1
  UNION ALL SELECT q.language, q.bucket, q.rn, q.ord, q.micro, CASE WHEN f.total + q.micro > 60000000 OR f.n >= 16 THEN f.batch + 1 ELSE f.batch END,
    CASE WHEN f.total + q.micro > 60000000 OR f.n >= 16 THEN 1 ELSE f.n + 1 END, CASE WHEN f.total + q.micro > 60000000 OR f.n >= 16 THEN q.micro ELSE f.total + q.micro END
  FROM f JOIN q ON q.language = f.language AND q.bucket = f.bucket AND q.rn = f.rn + 1),
g AS (SELECT language, bucket, batch, CAST(count(*) AS INTEGER) AS n, sum(micro) / 1e6 AS seconds, max(micro) / 1e6 AS longest, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY rn) AS keys FROM f GROUP BY ALL)"""


@query(f"WITH {_PLANNED} SELECT language, bucket, batch, n, seconds, keys FROM g")
def batch_plan(spark, sf_dir):
    planned = batching.plan(_batchable(spark, sf_dir), _LIMITS, seed=7, epoch=1)
    return planned.select("language", "bucket", "batch", "n", "seconds", F.array_join("keys", ",").alias("keys"))


@query(f"WITH {_PLANNED} SELECT language, count(*) AS batches, CAST(sum(n) AS BIGINT) AS n, max(seconds) AS most_seconds FROM g GROUP BY language")
def batch_stats(spark, sf_dir):
    planned = batching.plan(_batchable(spark, sf_dir), _LIMITS, seed=7, epoch=1)
    return planned.groupBy("language").agg(F.count(F.lit(1)).alias("batches"), F.sum("n").alias("n"), F.max("seconds").alias("most_seconds"))


@query(f"WITH {_PLACED} SELECT ord, language, place FROM s")
def epoch_shuffle(spark, sf_dir):
    return batching.shuffled(_batchable(spark, sf_dir), ["language"], seed=7, epoch=1).select("ord", "language", "place")


@query(f"""
WITH {_PLACED}, o AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS i FROM r)
SELECT i // 32 AS batch, count(*) AS n, sum(micro) / 1e6 AS seconds, max(micro) / 1e6 AS longest FROM o GROUP BY 1 HAVING count(*) = 32
""")
def fixed_batches(spark, sf_dir):
    return batching.fixed(_batchable(spark, sf_dir), 32, drop_last=True)


@query("""
WITH p AS (SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS i FROM train_final)
SELECT ord, printf('%06d', i // 1000) AS shard, printf('%09d', i) AS record FROM p
""")
def shard_plan(spark, sf_dir):
    return sinks.shard_plan(_t(spark, sf_dir, "train_final"), 1000).select("ord", "shard", "record")


# --- arrays and schedules --------------------------------------------------------------------------------------------


@query("SELECT CAST(step AS BIGINT) AS step, round(least((step + 1)::DOUBLE / 50, sqrt(50::DOUBLE / (step + 1))), 12) AS factor FROM range(500) r(step)")
def lr_noam(spark, sf_dir):
    return spark.range(500).select(F.col("id").alias("step"), F.round(A.noam(F.col("id"), 50), 12).alias("factor"))


@query("""
SELECT CAST(step AS BIGINT) AS step, round(CASE WHEN step + 1 <= 50 THEN (step + 1)::DOUBLE / 50 ELSE 0.1 + 0.9 * (0.5 * (1 + cos(pi() * least(1.0::DOUBLE, (step + 1 - 50)::DOUBLE / 350)))) END, 9) AS factor
FROM range(500) r(step)
""")
def lr_cosine(spark, sf_dir):
    return spark.range(500).select(F.col("id").alias("step"), F.round(A.cosine(F.col("id"), 50, 400, 0.1), 9).alias("factor"))


@query("""
SELECT n AS layers, k AS interval, CASE WHEN k > 0 THEN array_to_string(list_filter(range(n - 1), lambda i: (i + 1) % k = 0), ',') ELSE CAST(greatest(0, n // 2 - 1) AS VARCHAR) END AS aux
FROM (SELECT CAST(unnest(range(1, 25)) AS INTEGER) AS n), (SELECT CAST(unnest(range(0, 6)) AS INTEGER) AS k)
""")
def aux_layers(spark, sf_dir):
    grid = spark.range(1, 25).select(F.col("id").cast("int").alias("layers"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("interval"))
    return grid.select("layers", "interval", F.array_join(A.aux_layers(F.col("layers"), F.col("interval"), F.lit(None).cast("int")), ",").alias("aux"))


@query("SELECT CAST(i AS INTEGER) AS layer, round(0.1 * i / 16, 12) AS p FROM range(17) r(i)")
def drop_path(spark, sf_dir):
    return spark.range(1).select(F.posexplode(A.drop_path(17, 0.1)).alias("layer", "p")).withColumn("p", F.round("p", 12))


@query(f"""
WITH w AS (SELECT ord, list_transform({_words("text")}, lambda x: CAST(length(x) AS INTEGER)) AS ids FROM train_final WHERE text IS NOT NULL)
SELECT ord, array_to_string(list_transform(ids, lambda x: x + 1), ',') AS shifted, array_to_string(list_concat(ids, list_transform(range(greatest(80 - len(ids), 0)), lambda x: 0)), ',') AS padded,
  array_to_string(list_concat([1], ids), ',') AS started, array_to_string(list_concat(ids, [2]), ',') AS ended FROM w
""")
def shift_pad_ids(spark, sf_dir):
    ids = F.transform(X.words(F.col("text")), F.char_length)
    rows = _t(spark, sf_dir, "train_final").where("text is not null").select("ord", ids.alias("ids"))
    made = {"shifted": A.shift_ids(F.col("ids")), "padded": A.pad_to(F.col("ids"), F.lit(80)), "started": A.with_start(F.col("ids"), 1), "ended": A.with_end(F.col("ids"), 2)}
    return rows.select("ord", *[F.array_join(c, ",").alias(n) for n, c in made.items()])


def _element(spark, sf_dir, column):
    rows = _t(spark, sf_dir, "embeddings").withColumn("x", F.transform("embedding", lambda v: v.cast("double")))
    return rows.select("vec_id", F.posexplode(column(F.col("x"))).alias("pos", "v")).select("vec_id", "pos", F.round("v", 6).alias("v"))


_VECTORS = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings)"


@query(f"""
WITH {_VECTORS}, m AS (SELECT *, list_max(list_transform(x, lambda a: abs(a))) AS peak FROM v)
SELECT vec_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, round(CASE WHEN peak > 0 THEN unnest(x) / (peak + 1e-6) ELSE unnest(x) END, 6) AS v FROM m
""")
def peak_norm(spark, sf_dir):
    return _element(spark, sf_dir, A.peak_normalise)


@query(f"""
WITH {_VECTORS}, m AS (SELECT *, list_avg(x[1:48]) AS mean, greatest(list_stddev_pop(x[1:48]), 1e-5) AS dev FROM v)
SELECT vec_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, round((unnest(x) - mean) / dev, 6) AS v FROM m
""")
def mean_var_norm(spark, sf_dir):
    return _element(spark, sf_dir, lambda x: A.standardise(x, F.lit(48)))


@query(f"""
WITH {_VECTORS} SELECT vec_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, round(unnest(x) * pow(10.0, 6.0 / 20), 6) AS v FROM v
""")
def gain_6db(spark, sf_dir):
    return _element(spark, sf_dir, lambda x: A.gain(x, F.lit(6.0)))


@query(f"""
WITH {_VECTORS}, m AS (SELECT vec_id, x, list_position(list_transform(x, lambda a: abs(a)), list_max(list_transform(x, lambda a: abs(a)))) AS i FROM v)
SELECT vec_id, CAST(list_position(x, list_max(x)) - 1 AS INTEGER) AS best, len(x[i:i + 15]) AS n FROM m
""")
def argmax_and_peak(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").withColumn("x", F.transform("embedding", lambda v: v.cast("double")))
    return rows.select("vec_id", A.argmax(F.col("x")).alias("best"), F.size(A.from_peak(F.col("x"), 16)).cast("bigint").alias("n"))


@query("SELECT vec_id, CAST(generate_subscripts(range(64), 1) - 1 AS INTEGER) AS t, unnest(range(64)) < label * 6 AS valid FROM embeddings")
def length_masks(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(A.length_mask(F.size("embedding"), F.col("label") * 6)).alias("t", "valid"))
