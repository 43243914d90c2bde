"""Reports over manifests, texts and parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.functions.text import epoch_of, one_line, strip
from voxloom.scale import hex_block, running_total, spread, written

# The letters whose coverage is reported for Polish.
POLISH_LETTERS = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ"


def micro(seconds: Column) -> Column:
    """Whole microseconds: sums of them are exact, whatever the order."""
    return F.round(seconds * 1e6).cast("bigint")


def good_duration(value: Column) -> Column:
    return value.isNotNull() & (F.isnan(value) | (value > 0))


def summarize(manifest: DataFrame, strict: bool = True) -> DataFrame:
    """(dataset, n, seconds, hours, average) per dataset and over all (``total`` is true). A missing or bad duration is an
    error if ``strict``, else such rows are left out, as are lengths that are no number."""
    seconds = F.col("duration").try_cast("double")
    bad = seconds.isNull() | F.isnan(seconds) | (seconds <= 0)
    if strict:
        problem = F.concat(F.lit("line "), F.col("ord").cast("string"), F.lit(": bad or missing duration"))
        rows = manifest.select("dataset", F.when(bad, F.raise_error(problem).cast("double")).otherwise(seconds).alias("s"))
    else:
        rows = manifest.where(~bad).select("dataset", seconds.alias("s"))
    cells = rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum(micro(F.col("s"))).alias("m"), F.lit(False).alias("total"))
    # the total follows from the cells (one shuffle, reused), and is there even if no row is
    whole = cells.agg(F.lit(None).cast("string").alias("dataset"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.lit(True).alias("total"))
    sums = cells.unionByName(whole)
    return sums.select("dataset", "total", "n", (F.col("m") / 1e6).alias("seconds"), (F.col("m") / 1e6 / 3600).alias("hours"), (F.col("m") / 1e6 / F.greatest(F.col("n"), F.lit(1))).alias("average"))


def compare(train: DataFrame, val: DataFrame) -> DataFrame:
    """(dataset, train_n, train_hours, val_n, val_hours) of all datasets of either; what is missing is 0."""
    one = lambda m, s: summarize(m, strict=False).where("not total").select("dataset", F.col("n").alias(f"{s}_n"), F.col("hours").alias(f"{s}_hours"))
    a, b = one(train, "train"), one(val, "val").withColumnRenamed("dataset", "d")
    joined = a.join(b, a["dataset"].eqNullSafe(b["d"]), "full_outer")
    zero = {"train_n": 0, "train_hours": 0.0, "val_n": 0, "val_hours": 0.0}
    return joined.select(F.coalesce("dataset", "d").alias("dataset"), *zero).na.fill(zero)


def manifest_stats(manifest: DataFrame) -> DataFrame:
    """(kind, value, n): rows per language and per dataset, in one pass. A null is the text None."""
    own = manifest.select(F.coalesce("language", F.lit("None")).alias("language"), F.coalesce("dataset", F.lit("None")).alias("dataset"))
    cells = own.groupBy("language", "dataset").agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("language", "dataset")]))
    return cells.select(each.alias("e"), "n").groupBy("e.kind", "e.value").agg(F.sum("n").alias("n"))


def audit(manifest: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(total, bad_duration, missing_duration_field, missing_files); ``files`` (path) are those that exist."""
    rows = manifest.select("duration", "audio_filepath")
    if files is not None:
        known = files.select(F.col("path").alias("audio_filepath"), F.lit(True).alias("there")).distinct()
        rows = rows.join(known, "audio_filepath", "left")
    else:
        rows = rows.withColumn("there", F.lit(True))
    value = F.col("duration").try_cast("double")
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.coalesce(good_duration(value), F.lit(False))).alias("bad_duration"),
        F.count_if(F.col("duration").isNull()).alias("missing_duration_field"), F.count_if(F.col("there").isNull()).alias("missing_files"),
    )


def repair(manifest: DataFrame, probed: DataFrame, rewrite_all: bool = True) -> DataFrame:
    """``manifest`` with durations of ``probed`` (path, seconds; null where reading failed) and ``outcome``: missing (no
    such file, row as it was), error (reading failed, old value), fixed or kept."""
    files = probed.groupBy(F.col("path").alias("audio_filepath")).agg(F.max("seconds").alias("_p"), F.lit(True).alias("_there"))
    rows = manifest.join(files, "audio_filepath", "left")
    old = F.col("duration").try_cast("double")
    wanted = F.lit(rewrite_all) | ~F.coalesce(good_duration(old), F.lit(False))
    outcome = F.when(F.col("_there").isNull(), "missing").when(~wanted, "kept").when(F.col("_p").isNull(), "error").otherwise("fixed")
    fixed = rows.withColumn("outcome", outcome)
    return fixed.withColumn("duration", F.when(F.col("outcome") == "fixed", F.col("_p")).otherwise(old)).select(*manifest.columns, "outcome")


def outcomes(df: DataFrame, status: str = "outcome") -> DataFrame:
    """(status, n): totals of any job that marks its rows."""
    return df.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def _texts(manifest: DataFrame) -> DataFrame:
    rows = spread(manifest.select("language", "text"))
    rows = rows.select(F.coalesce("language", F.lit("None")).alias("language"), strip(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    return rows.where(F.col("text") != "")


def letter_coverage(manifest: DataFrame, letters: str = POLISH_LETTERS, language: str = "pl") -> DataFrame:
    """(letter, count, present) over the texts of a language, by lengths with and without the letter: no exploding."""
    text = F.col("text")
    sums = _texts(manifest).where(F.col("language") == language).agg(*[F.coalesce(F.sum(F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit("")))), F.lit(0)).alias(f"c{i}") for i, c in enumerate(letters)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("letter"), F.col(f"c{i}").alias("count")) for i, c in enumerate(letters)]))
    return sums.select(each.alias("e")).select("e.letter", F.col("e.count").alias("count"), (F.col("e.count") > 0).alias("present"))


def coverage(manifest: DataFrame, tokenize=None, unknown: int = 0) -> DataFrame:
    """(language, utterances, characters[, tokens, unk_tokens]) sorted; ``tokenize`` maps a text column to ids."""
    rows = _texts(manifest)
    aggregates = [F.count(F.lit(1)).alias("utterances"), F.sum(F.char_length("text")).alias("characters")]
    if tokenize is not None:
        rows = rows.withColumn("ids", tokenize(F.col("text")))
        aggregates += [F.sum(F.size("ids")).alias("tokens"), F.sum(F.size(F.filter("ids", lambda x: x == unknown))).alias("unk_tokens")]
    return rows.groupBy("language").agg(*aggregates).orderBy("language")


def balance(rows: DataFrame, key: str = "ord", seed: int = 0) -> DataFrame:
    """``rows`` (language, text, ...) repeated so that each language has at least as many characters as the largest: every
    row of a language the whole number of times that fits, and the first of its seeded permutation once more until the
    target is reached. ``cycle`` numbers the repeats. With fewer than two languages nothing is repeated."""
    sized = rows.withColumn("_len", F.char_length("text").cast("bigint"))
    totals = sized.groupBy("language").agg(F.sum("_len").alias("_total"))
    every = W.partitionBy()  # one row per language
    goal = totals.select(F.col("language").alias("_l"), "_total", F.max("_total").over(every).alias("_goal"), F.count(F.lit(1)).over(every).alias("_langs")).where("_total > 0")
    # rows of a language without a single character can't fill anything
    joined = sized.join(F.broadcast(goal), F.col("language").eqNullSafe(F.col("_l")))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    # written, as the running total reads its rows and their blocks
    placed = running_total(written(joined.withColumn("_h", digest), "balance"), ["language"], hex_block(F.col("_h")), ["_h", key], F.col("_len"), "_upto")
    whole = F.floor(F.col("_goal") / F.col("_total"))
    once_more = F.col("_upto") - F.col("_len") < F.col("_goal") - whole * F.col("_total")
    times = F.when(F.col("_langs") < 2, F.lit(1)).otherwise(whole + once_more.cast("bigint")).cast("int")
    out = placed.withColumn("_times", times).where("_times > 0")
    return out.select(*rows.columns, F.explode(F.sequence(F.lit(0), F.col("_times") - 1)).alias("cycle"))


def corpus_lines(manifest: DataFrame, most: int | None = None, order: bool = True) -> DataFrame:
    """(value): one line per text, in order, for a tokenizer's training."""
    rows = manifest.select("ord", one_line(strip(F.coalesce(F.col("text"), F.lit("")))).alias("value")).where("value <> ''")
    rows = rows.orderBy("ord") if order or most is not None else rows
    return (rows if most is None else rows.limit(most)).select("value")


#: Elements of a parameter that are averaged in one row.
PARAMETER_BLOCK = 1 << 16


def average_parameters(checkpoints: DataFrame, block: int = PARAMETER_BLOCK) -> DataFrame:
    """(name, values) of ``checkpoints`` (epoch, name, values[, floating]): for each name of the first epoch the mean of
    each element over the epochs that have it; what isn't ``floating`` keeps the values of the first epoch. Parameters
    are cut into blocks, each summed element by element as one row, so only the blocks of a name are put together again."""
    start = checkpoints.agg(F.min("epoch")).first()[0]
    rows = checkpoints.join(checkpoints.where(F.col("epoch") == start).select("name"), "name", "left_semi")
    if "floating" in checkpoints.columns:
        rows = rows.where(F.col("floating") | (F.col("epoch") == start))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size("values") - 1) / block).cast("int"), F.lit(0))), lambda i: F.slice("values", i * block + 1, block))
    parts = rows.select("name", "epoch", F.posexplode(blocks).alias("at", "v"))
    # as many vectors of a block as there are epochs, a few; each is bound by its position
    lists = parts.groupBy("name", "at").agg(F.collect_list(F.transform("v", lambda x: x.cast("double"))).alias("all"))
    longest = F.array_max(F.transform("all", F.size))
    sums = F.aggregate("all", F.array_repeat(F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), longest), lambda acc, v: F.zip_with(acc, v, lambda a, x: F.when(x.isNull(), a).otherwise(F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n")))))
    means = lists.select("name", "at", F.transform(sums, lambda a: a["s"] / F.when(a["n"] > 0, a["n"])).alias("v"))
    return means.groupBy("name").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"])).alias("values"))


def last_checkpoints(files: DataFrame, n: int, name: str = "name") -> DataFrame:
    """The ``n`` files of the latest epochs but ``last.ckpt``; fewer than two are an error."""
    found = files.withColumn("epoch", epoch_of(F.col(name))).where((F.col(name) != "last.ckpt") & F.col("epoch").isNotNull())
    picked = found.orderBy(F.col("epoch").desc(), F.col(name).desc()).limit(n)
    if picked.count() < 2:
        raise ValueError("averaging needs at least two checkpoints")
    return picked


def copy_parameters(target: DataFrame, source: DataFrame, prefix: str) -> DataFrame:
    """``target`` (name, shape, values) with the values of ``source`` under the prefix where name and shape match, and
    ``outcome`` (copied, kept); parameters of the source without a match come as skipped."""
    own = source.where(F.col("name").startswith(prefix)).select(F.col("name").alias("n"), F.col("shape").alias("s"), F.col("values").alias("v"))
    joined = target.join(own, F.col("name") == F.col("n"), "full_outer")
    hit = F.col("name").isNotNull() & F.col("n").isNotNull() & (F.col("shape") == F.col("s"))
    outcome = F.when(F.coalesce(hit, F.lit(False)), "copied").when(F.col("n").isNull(), "kept").otherwise("skipped")
    marked = joined.withColumn("outcome", outcome)
    return marked.select(F.coalesce("name", "n").alias("name"), F.coalesce("shape", "s").alias("shape"), F.when(F.col("outcome") == "copied", F.col("v")).otherwise(F.col("values")).alias("values"), "outcome")


def bank_stats(files: DataFrame) -> DataFrame:
    """(kind, files_ok, files_failed, items, seconds) of ``files`` (kind, ok, items, seconds)."""
    return files.groupBy("kind").agg(
        F.count_if("ok").alias("files_ok"), F.count_if(~F.col("ok")).alias("files_failed"), F.sum(F.when(F.col("ok"), F.col("items")).otherwise(0)).alias("items"),
        (F.sum(F.when(F.col("ok"), micro(F.col("seconds"))).otherwise(F.lit(0))) / 1e6).alias("seconds"),
    )
