"""Corpus assembly: ingest rules, buckets with targets and an hour cap, splits of buckets, overlap checks.

A manifest is a DataFrame (ord, uid, audio_filepath, text, duration, language, dataset, source); ``ord`` is the order of
its lines. Order decides what is kept, so every operator names its order; none relies on the order of partitions.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame

from pyspark.sql import functions as F

from voxloom.functions.text import row_key, strip
from voxloom.scale import running_total, written

#: Rows of a manifest that are ordered in one task.
ORD_BLOCK = 1 << 16


class Underdelivery(Exception):
    pass


def _keyed(manifest: DataFrame) -> DataFrame:
    return manifest.withColumn("key", row_key(F.col("uid"), F.col("audio_filepath")))


def unique_keys(manifest: DataFrame) -> DataFrame:
    """(key): the distinct keys that are there."""
    return _keyed(manifest).where("key is not null").select("key").distinct()


def ingest_text(samples: DataFrame, text: str = "text", lower: bool = False) -> DataFrame:
    """Samples whose text has at least two characters when stripped, with that text."""
    bare = strip(F.col(text))
    out = samples.withColumn(text, F.lower(bare) if lower else bare)
    return out.where(F.char_length(text) >= 2)


def bucket_targets(specs: DataFrame, phase: str | None = None) -> DataFrame:
    """(name, seq, sources, target, consistent) per bucket: the first specification decides the target."""
    own = specs if phase is None else specs.where(F.col("phase") == phase)
    return own.groupBy("name").agg(
        F.min("seq").alias("seq"), F.count(F.lit(1)).alias("sources"), F.min_by("samples", "seq").alias("target"), (F.countDistinct("samples") == 1).alias("consistent")
    )


def append_new(existing: DataFrame, incoming: DataFrame, target: int | None = None) -> DataFrame:
    """Incoming rows that are not in ``existing`` yet, the first of each key, up to the target. Rows without key are skipped."""
    fresh = _keyed(incoming).where("key is not null")
    first = fresh.groupBy("key").agg(F.min("ord").alias("ord"))
    fresh = fresh.join(first, ["key", "ord"], "left_semi").dropDuplicates(["key", "ord"]).join(unique_keys(existing), "key", "left_anti")
    if target is not None:
        fresh = fresh.orderBy("ord").limit(max(0, target - unique_keys(existing).count()))
    return fresh.drop("key")


def _contested(placed: DataFrame) -> DataFrame | None:
    """(key, seq) of rows whose key was kept in a bucket before theirs, or None. Only keys of several buckets can be, so
    the rounds see those alone. A round keeps what has its place within the target after the rows that the last round
    skipped, and skips every row whose key it keeps in an earlier bucket. What the first buckets keep is right after as many
    rounds, so the first round that changes nothing is right throughout; mostly that is the second or third."""
    shared = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    rows = written(placed.join(shared, "key", "left_semi").select("key", "seq", "ord", "pos", "target"), "contested")
    if rows.isEmpty():
        return None
    skipped, before = rows.limit(0).select("key", "seq"), (0, None)
    while True:
        marks = rows.join(skipped.withColumn("m", F.lit(1)), ["key", "seq"], "left").na.fill({"m": 0})
        counted = running_total(marks, ["seq"], F.floor(F.col("ord") / ORD_BLOCK), ["ord"], F.col("m"), "passed")
        first = counted.where("m = 0 and pos - passed <= target").groupBy("key").agg(F.min("seq").alias("first"))
        skipped = written(rows.join(first, "key").where("seq > first").select("key", "seq"), "skipped")
        now = tuple(skipped.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("key", "seq"))).first())
        if now == before:
            return skipped
        before = now


def assemble(manifests: DataFrame, targets: DataFrame, max_hours: float | None = None) -> DataFrame:
    """The final manifest of buckets filled in order of ``seq``, with ``bucket_seq`` and ``place`` in the bucket.

    ``manifests`` holds the rows of all buckets (``dataset`` names the bucket). Each bucket is read in order until it
    has its target; rows without key and rows whose key an earlier bucket (or row) kept are passed over; rows behind
    the target are never read, so their keys stay free for later buckets. The hour cap ends everything at the first
    row that would go over it. Null, NaN and missing durations count as 0 hours. ``ord`` is unique within a bucket, as
    line numbers are."""
    buckets = targets.select(F.col("name").alias("dataset"), "seq", "target")
    # targets are as many as the configuration has buckets
    rows = _keyed(manifests).where("key is not null").join(F.broadcast(buckets), "dataset")
    # keys and places only; each is read several times below, so it is written
    first = written(rows.groupBy("seq", "key").agg(F.min("ord").alias("ord"), F.max("target").alias("target")), "first")
    placed = written(running_total(first, ["seq"], F.floor(F.col("ord") / ORD_BLOCK), ["ord"], F.lit(1), "pos"), "placed")
    skipped = _contested(placed)
    if skipped is not None:
        rest = placed.join(skipped, ["key", "seq"], "left_anti")
        placed = running_total(rest.drop("pos"), ["seq"], F.floor(F.col("ord") / ORD_BLOCK), ["ord"], F.lit(1), "pos")
    kept = placed.where("pos <= target").select("seq", "key", "ord", F.col("pos").alias("place"))
    out = rows.join(kept, ["seq", "key", "ord"]).withColumnRenamed("seq", "bucket_seq").drop("key", "target")
    return hour_cap(out, max_hours) if max_hours is not None else out


def hour_stop(final: DataFrame, max_hours: float | None) -> tuple[int, int] | None:
    """(bucket_seq, place) of the first row at which the running hours would go over the cap; None if none does. Only
    lengths and places are summed, not the rows."""
    if max_hours is None or max_hours <= 0:
        return None
    seconds = F.coalesce(F.nanvl(F.col("duration"), F.lit(0.0)), F.lit(0.0))
    micro = F.round(seconds * 1e6).cast("bigint")  # whole microseconds add up alike in any grouping
    lengths = written(final.select("bucket_seq", "place", micro.alias("micro")), "lengths")
    per_bucket = F.col("bucket_seq").cast("bigint") * (1 << 40) + F.floor(F.col("place") / ORD_BLOCK)
    summed = running_total(lengths, [], per_bucket, ["place"], F.col("micro"), "upto")
    over = summed.where(F.col("upto") > F.lit(round(max_hours * 3.6e9))).agg(F.min(F.struct("bucket_seq", "place")).alias("stop")).first()["stop"]
    return None if over is None else (over["bucket_seq"], over["place"])


def before_stop(final: DataFrame, stop: tuple[int, int] | None) -> DataFrame:
    if stop is None:
        return final
    return final.where((F.col("bucket_seq") < stop[0]) | ((F.col("bucket_seq") == stop[0]) & (F.col("place") < stop[1])))


def hour_cap(final: DataFrame, max_hours: float | None) -> DataFrame:
    """The rows before the first at which the running hours would go over the cap."""
    return before_stop(final, hour_stop(final, max_hours))


def delivery(final: DataFrame, targets: DataFrame) -> DataFrame:
    """(name, target, kept, short) of every bucket."""
    kept = final.groupBy(F.col("dataset").alias("name")).agg(F.count(F.lit(1)).alias("kept"))
    return targets.join(kept, "name", "left").select("name", "target", F.coalesce("kept", F.lit(0)).alias("kept"), (F.coalesce("kept", F.lit(0)) < F.col("target")).alias("short"))


def check_delivery(report: DataFrame, policy: str = "warn") -> None:
    """Warn or raise (``policy``) for each bucket that fell short."""
    for r in report.where("short").orderBy("name").collect():  # at most one per bucket
        message = f"bucket {r['name']}: have={r['kept']} target={r['target']}"
        if policy == "raise":
            raise Underdelivery(message)
        warnings.warn(message, stacklevel=2)


def all_exhausted(states: DataFrame) -> bool:
    """Whether there are sources and all of them are exhausted."""
    r = states.agg(F.count(F.lit(1)).alias("n"), F.every(F.coalesce("exhausted", F.lit(False))).alias("all")).first()
    return bool(r["n"] and r["all"])


def shared_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key): keys in both manifests; a row without key is an error."""
    strict = lambda m: _keyed(m).select(F.coalesce("key", F.raise_error(F.lit("a row has neither uid nor audio_filepath"))).alias("key"))
    return strict(a).intersect(strict(b))


def assert_no_overlap(train: DataFrame, val: DataFrame) -> None:
    if found := shared_keys(train, val).limit(5).collect():
        raise ValueError(f"overlap detected: {[r['key'] for r in found]}")


def bucket_names_in(manifest: DataFrame, names: DataFrame) -> DataFrame:
    """(dataset, n): rows of ``manifest`` under the names of another split's buckets."""
    own = names.select(F.col("name").alias("dataset")).distinct()
    return manifest.join(F.broadcast(own), "dataset", "left_semi").groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


def last_of_key(manifest: DataFrame) -> DataFrame:
    """One row per key: the values of the last one at the place of the first (``ord``). A row without key is an error."""
    cols = manifest.columns
    keyed = _keyed(manifest).withColumn("key", F.coalesce("key", F.raise_error(F.lit("a row has neither uid nor audio_filepath"))))
    best = keyed.groupBy("key").agg(F.min("ord").alias("_first"), F.max_by(F.struct(*cols), "ord").alias("_row"))
    return best.select(*[F.col("_first").alias(c) if c == "ord" else F.col(f"_row.{c}").alias(c) for c in cols])


def split_bucket(manifest: DataFrame, marker: str, rest: str, moved: str, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A mixed bucket taken apart: rows whose path holds the marker become the bucket ``moved``, merged behind its
    existing rows with the last value of each key; the others are relabelled ``rest``. Without such rows both stay."""
    has = F.coalesce(F.col("audio_filepath").contains(marker), F.lit(False))
    if manifest.where(has).isEmpty():
        return manifest, existing if existing is not None else manifest.limit(0)
    away = manifest.where(has).withColumn("dataset", F.lit(moved))
    if existing is not None:
        top = existing.agg(F.coalesce(F.max("ord"), F.lit(0))).first()[0]
        low = away.agg(F.min("ord")).first()[0]
        away = existing.unionByName(away.withColumn("ord", F.col("ord") + F.lit(max(0, top + 1 - low))), allowMissingColumns=True)
    return manifest.where(~has).withColumn("dataset", F.lit(rest)), last_of_key(away)


def skip(manifest: DataFrame, start: int) -> DataFrame:
    return manifest.where(F.col("ord") >= start)


def row_at(manifest: DataFrame, place: int) -> DataFrame:
    """The row at a place from 0; an error past the end."""
    row = manifest.orderBy("ord").offset(place).limit(1)
    if row.isEmpty():
        raise IndexError(place)
    return row


def head(manifest: DataFrame, n: int) -> DataFrame:
    return manifest.orderBy("ord").limit(n)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement; the same seed gives the same ones."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def global_position(start: int, shard: Column, cursor: Column, shards: int) -> Column:
    """Place in the source of the record a shard has just read (its cursor counts that record already)."""
    return F.lit(start) + shard + cursor * shards


def next_free(used: DataFrame, start: int = 0) -> int:
    """The smallest index at or above ``start`` that is not in ``used`` (index)."""
    here = used.where(F.col("index") >= start).select("index").distinct()
    gap = here.select((F.col("index") + 1).alias("index")).join(here, "index", "left_anti").agg(F.min("index")).first()[0]
    return start if here.where(F.col("index") == start).isEmpty() else gap


def per_source(samples: DataFrame, by: str, requested: str, most: int | None = None) -> DataFrame:
    """The first rows of each source up to what is requested of it (a column), and to ``most``."""
    placed = running_total(samples, [by], F.floor(F.col("ord") / ORD_BLOCK), ["ord"], F.lit(1), "_place")
    limit = F.col(requested) if most is None else F.least(F.col(requested), F.lit(most))
    return placed.where(F.col("_place") <= limit).drop("_place")


def check_failures(outcomes: DataFrame, most: int, status: str = "status", failed: str = "failed") -> int:
    """The number of failed rows; more than ``most`` are an error."""
    n = outcomes.where(F.col(status) == failed).count()
    if n > most:
        raise RuntimeError(f"{n} samples failed, more than the {most} that are allowed")
    return n
