"""Admission to training: each row passes a cascade of rules, and counts under the first that drops it."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.arrays import encoder_length
from voxloom.functions.text import BLANKS, strip
from voxloom.scale import computed, spread

MAX_SECONDS = 16.0
TRAIN_SPEED = 0.95


def parsed_duration(value: Column) -> Column:
    """A positive number, else null; NaN stays, as it fails a later rule. Text is parsed."""
    number = value.try_cast("double")
    return F.when((number > 0) | F.isnan(number), number)


def whitespace_tokens(text: Column) -> Column:
    """Length under a stand-in tokenizer: words, at least one."""
    # blanks between the words of the stripped text, after runs of them became one
    bare = F.regexp_replace(F.translate(strip(text), BLANKS, " " * len(BLANKS)), "  +", " ")
    return F.char_length(bare) - F.char_length(F.replace(bare, F.lit(" "), F.lit(""))) + 1


def with_reason(manifest: DataFrame, split: str = "train", factor: int = 8, max_seconds: float = MAX_SECONDS, tokens: Callable[[Column], Column] = whitespace_tokens, speed: float = TRAIN_SPEED) -> DataFrame:
    """``manifest`` with reason (loaded, bad_duration, too_long, missing, ctc_too_long), target_len and encoder_len."""
    seconds = parsed_duration(F.col("duration"))
    text = F.coalesce(strip(F.col("text")), F.lit(""))
    rows = computed(spread(manifest), _d=seconds, _t=text)
    # the length of a NaN is that of nothing
    length = encoder_length(F.nanvl(F.col("_d"), F.lit(0.0)), factor, speed if split == "train" else 1.0)
    rows = computed(rows, target_len=F.when(F.col("_t") != "", tokens(F.col("_t"))), encoder_len=length)
    missing = F.coalesce(F.col("audio_filepath"), F.lit("")) == ""
    reason = (
        F.when(F.col("_d").isNull(), "bad_duration")
        .when(~F.isnan("_d") & (F.col("_d") > max_seconds), "too_long")
        .when(missing | (F.col("_t") == "") | (F.col("target_len") == 0), "missing")
        .when(F.col("encoder_len") < F.col("target_len"), "ctc_too_long")
        .otherwise("loaded")
    )
    return rows.withColumn("reason", reason).drop("_d", "_t")


def drop_report(manifest: DataFrame, **rules) -> DataFrame:
    """(reason, n) in one pass."""
    return with_reason(manifest, **rules).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def admitted(manifest: DataFrame, **rules) -> DataFrame:
    """Rows that pass all rules, with their lengths, the text stripped and language and dataset never null or empty."""
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    rows = with_reason(manifest, **rules).where("reason = 'loaded'").drop("reason")
    return rows.withColumns({"text": strip(F.col("text")), "language": known("language"), "dataset": known("dataset"), "duration": F.col("duration").try_cast("double")})


def feasible(batch: DataFrame, out_len: str = "out_len", target_len: str = "target_len") -> DataFrame:
    """Rows whose encoder output is at least as long as their target; nothing where none is, so the batch is skipped."""
    return batch.where(F.col(out_len) >= F.col(target_len))


def feasible_batches(batches: DataFrame, out_lens: str = "out_lens", targets: str = "targets", target_lens: str = "target_lens") -> DataFrame:
    """Collated batches (arrays ``out_lens`` and ``target_lens``, ``targets`` joined end to end) with only their feasible rows: the
    lengths of these and their targets joined anew. A batch without one stays, with empty arrays and ``skipped`` true."""
    ends = F.transform(F.sequence(F.lit(1), F.size(target_lens)), lambda i: F.aggregate(F.slice(target_lens, 1, i), F.lit(0), lambda a, x: a + x))
    members = F.arrays_zip(F.col(out_lens).alias("o"), F.col(target_lens).alias("n"), ends.alias("e"))
    kept = F.when(F.size(target_lens) > 0, F.filter(members, lambda m: m["o"] >= m["n"]))
    rows = batches.withColumn("_kept", F.coalesce(kept, F.array().cast("array<struct<o:int,n:int,e:int>>")))
    return rows.withColumns(
        {
            out_lens: F.transform("_kept", lambda m: m["o"]),
            targets: F.flatten(F.transform("_kept", lambda m: F.slice(targets, m["e"] - m["n"] + 1, m["n"]))),
            target_lens: F.transform("_kept", lambda m: m["n"]),
            "skipped": F.size("_kept") == 0,
        }
    ).drop("_kept")


def warn_skipped(batches: DataFrame) -> int:
    """The number of skipped batches, with a warning if there are any."""
    n = batches.where("skipped").count()
    if n:
        warnings.warn(f"{n} batches hold no row whose target fits its encoder output", stacklevel=2)
    return n
