"""Word and character error rates: distances per utterance, rollups over splits, languages and decoders, worst cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.functions.text import strip, words
from voxloom.scale import spread

DECODER = ["decode_type", "beam_width", "alpha", "beta"]
SUMS = ["num_samples", "wer_num", "wer_den", "cer_num", "cer_den"]


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of words: each different word of the pair becomes a character of its own (there
    are a million beyond the basic plane), and the built-in distance does the rest."""

    def distance(known: Column) -> Column:
        one = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.lit(0x10000) + F.array_position(known, w)), 8, "0")), "UTF-32")
        coded = lambda x: F.concat_ws("", F.transform(x, one))
        return F.levenshtein(coded(a), coded(b))

    # the list of words is bound once here; inside the inner functions it would be made again for every word
    return F.transform(F.array(F.array_distinct(F.concat(a, b))), distance)[0]


def with_errors(df: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis", fold: bool = True) -> DataFrame:
    """``df`` with wer_num, wer_den, cer_num, cer_den; texts are stripped and, if ``fold``, lower-cased. An empty or null
    reference counts nothing; a null hypothesis is an empty one."""
    form = lambda c: strip(F.lower(F.coalesce(F.col(c), F.lit(""))) if fold else F.coalesce(F.col(c), F.lit("")))
    rows = df.withColumns({"_r": form(reference), "_h": form(hypothesis)}).withColumns({"_rw": words(F.col("_r")), "_hw": words(F.col("_h"))})
    there = F.col("_r") != ""
    zero = F.lit(0).cast("bigint")
    return rows.withColumns(
        {
            "wer_num": F.when(there, edit_distance(F.col("_rw"), F.col("_hw")).cast("bigint")).otherwise(zero),
            "wer_den": F.when(there, F.size("_rw").cast("bigint")).otherwise(zero),
            "cer_num": F.when(there, F.levenshtein("_r", "_h").cast("bigint")).otherwise(zero),
            "cer_den": F.when(there, F.char_length("_r").cast("bigint")).otherwise(zero),
        }
    ).drop("_r", "_h", "_rw", "_hw")


def _rates(df: DataFrame) -> DataFrame:
    rate = lambda n, d: F.col(n).cast("double") / F.greatest(F.col(d).cast("double"), F.lit(1e-8))
    return df.withColumns({"wer": rate("wer_num", "wer_den"), "cer": rate("cer_num", "cer_den")})


def _summed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])


def split_metrics(hypotheses: DataFrame) -> DataFrame:
    """Sums per split, decoder and language, and over all languages (``all``). Utterances without reference are left out."""
    scored = with_errors(spread(hypotheses)).where("wer_den > 0 or cer_den > 0").withColumn("num_samples", F.lit(1).cast("bigint"))
    own = scored.withColumn("language", F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("unknown")))
    # one shuffle to the few combinations; the totals over languages follow from those
    per_language = _summed(own, ["split", "language", *DECODER])
    every = per_language.select("split", F.explode(F.array(F.lit("all"), F.col("language"))).alias("language"), *DECODER, *SUMS)
    return _summed(every, ["split", "language", *DECODER])


def rollup(metrics: DataFrame, include_null_keys: bool = False) -> DataFrame:
    """Rates per split, and over all splits (``full``). As in the reference, decoders with a null parameter have no
    ``full`` row unless ``include_null_keys``."""
    keyed = metrics if include_null_keys else metrics.dropna(subset=["language", *DECODER])
    full = _summed(keyed, ["language", *DECODER]).withColumn("split", F.lit("full"))
    return _rates(metrics.unionByName(full)).select("split", "language", *DECODER, *SUMS, "wer", "cer")


def sorted_results(results: DataFrame) -> DataFrame:
    return results.orderBy(*[F.col(c).asc_nulls_last() for c in ("split", "language", "decode_type", "wer")])


def by_language(hypotheses: DataFrame, languages: Sequence[str] = ("en", "pl")) -> DataFrame:
    """(metric, value): rates over all and per listed language, texts compared as they are but for outer blanks."""
    scored = with_errors(spread(hypotheses), fold=False).where("wer_den > 0")
    groups = F.when(F.col("language").isin(*languages), F.array(F.lit("overall"), F.col("language"))).otherwise(F.array(F.lit("overall")))
    sums = scored.select(F.explode(groups).alias("g"), "wer_num", "wer_den", "cer_num", "cer_den").groupBy("g").agg(*[F.sum(c).alias(c) for c in SUMS[1:]])
    rates = _rates(sums)
    return rates.select(F.explode(F.array(*[F.struct(F.concat(F.lit(f"{m}/"), "g").alias("metric"), F.col(m).alias("value")) for m in ("wer", "cer")])).alias("r")).select("r.*")


def worst(hypotheses: DataFrame, k: int = 50, arrival: Sequence[str] = ("utt_id",)) -> DataFrame:
    """The ``k`` utterances of highest character error rate, earlier ones first among equals: a partial top-k per
    partition, never a global sort."""
    scored = _rates(with_errors(spread(hypotheses)).where("cer_den > 0"))
    return scored.orderBy(F.col("cer").desc(), *[F.col(c).asc_nulls_first() for c in arrival]).limit(k)


def first_per_language(hypotheses: DataFrame, k: int = 2, languages: Sequence[str] = ("en", "pl"), arrival: Sequence[str] = ("utt_id",)) -> DataFrame:
    """The first ``k`` examples of each listed language."""
    order = W.partitionBy("language").orderBy(*[F.col(c).asc_nulls_first() for c in arrival])
    return hypotheses.where(F.col("language").isin(*languages)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def frames_to_ids(frames: DataFrame, by: Sequence[str] = ("utt_id",), blank: int = 0) -> DataFrame:
    """Best-path ids of frames (``by``, t, token): repeats dropped by comparing each frame with the one before, then blanks."""
    before = F.lag("token", 1, -1).over(W.partitionBy(*by).orderBy("t"))
    marked = frames.withColumn("_last", before)
    kept = F.when((F.col("token") != F.col("_last")) & (F.col("token") != blank), F.struct("t", "token"))
    # nulls aren't collected, so an utterance of blanks has no ids; the window's partitioning serves the grouping
    return marked.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["token"]).alias("ids"))


def blank_fraction(frames: DataFrame, by: Sequence[str] = (), blank: int = 0) -> DataFrame:
    share = F.count_if(F.col("token") == blank).cast("double") / F.greatest(F.count(F.lit(1)), F.lit(1))
    return frames.groupBy(*by).agg(F.count(F.lit(1)).alias("frames"), share.alias("blank_fraction"))


def parameter_sweep(spark, decode_types: Sequence[str], beam_widths: Sequence[int], alphas: Sequence[float], betas: Sequence[float]) -> DataFrame:
    """(decode_type, beam_width, alpha, beta) of every decoder that is run: greedy once, beams per width, beams with a
    language model per width, alpha and beta."""
    rows = []
    for kind in decode_types:
        if kind == "greedy":
            rows.append((kind, None, None, None))
        elif kind == "beam":
            rows += [(kind, w, None, None) for w in beam_widths]
        elif kind == "beam_kenlm":
            rows += [(kind, w, a, b) for w in beam_widths for a in alphas for b in betas]
        else:
            raise ValueError(f"unknown decode type {kind}")
    return spark.createDataFrame(rows, "decode_type string, beam_width int, alpha double, beta double")


def model_type(keys: DataFrame, by: Sequence[str] = ("checkpoint",), key: str = "name") -> DataFrame:
    """(``by``, model_type) from the names of parameters: a joint network first, then attention, then plain."""
    starts = lambda *p: F.max(F.col(key).startswith(p[0]) if len(p) == 1 else F.col(key).startswith(p[0]) | F.col(key).startswith(p[1]))
    kind = F.when(starts("net.joint."), "tdt").when(starts("net.ctc_proj.", "net.decoder."), "ctc_attention").when(starts("net.proj."), "ctc")
    return keys.groupBy(*by).agg(kind.alias("model_type"))


def check_split(name: str, known: Sequence[str] = ("train", "val", "test")) -> str:
    if name not in known:
        raise ValueError(f"unknown split {name!r}, expected one of {list(known)}")
    return name


def effective_decoders(model: str, wanted: Sequence[str]) -> list[str]:
    """Transducers decode greedily, whatever is asked."""
    return ["greedy"] if model == "tdt" else list(wanted)
