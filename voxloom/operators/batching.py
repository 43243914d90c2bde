"""Batches for training: a seeded shuffle, buckets of like length per language, greedy packing by seconds and rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.scale import hex_block, running_total


@dataclass(frozen=True)
class BatchLimits:
    max_seconds: float
    max_rows: int
    min_rows: int = 1
    bucket_rows: int = 512

    def __post_init__(self) -> None:
        if min(self.max_seconds, self.max_rows, self.min_rows, self.bucket_rows) <= 0:
            raise ValueError("all limits must be positive")


def shuffled(df: DataFrame, by: list[str], key: str = "ord", seed: int = 0, epoch: int = 0, shuffle: bool = True) -> DataFrame:
    """``df`` with ``place`` (from 0) in the seeded permutation of each group; without shuffling the epoch has no say."""
    salt = seed + (epoch if shuffle else 0)
    digest = F.md5(F.concat_ws(":", F.lit(str(salt)), F.col(key).cast("string")))
    rows = df.withColumn("_h", digest)
    placed = running_total(rows, by, hex_block(F.col("_h")), ["_h", key], F.lit(1), "place")
    return placed.withColumn("place", F.col("place") - 1).drop("_h")


def in_order(df: DataFrame, by: list[str], key: str = "ord", block: int = 1 << 16) -> DataFrame:
    """``df`` with ``place`` (from 0) in the order of ``key`` within each group."""
    placed = running_total(df, by, F.floor(F.col(key) / block), [key], F.lit(1), "place")
    return placed.withColumn("place", F.col("place") - 1)


def _packed(members: Column, limits: BatchLimits) -> Column:
    """The fold over a bucket's members in order of length: an array of batches of (n, micro, keys)."""
    most = F.lit(round(limits.max_seconds * 1e6)).cast("bigint")
    kind = "struct<done:array<struct<n:int,micro:bigint,keys:array<bigint>>>,n:int,micro:bigint,keys:array<bigint>>"
    start = F.struct(F.array().alias("done"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("micro"), F.array().alias("keys")).cast(kind)

    def close(s: Column) -> Column:
        full = F.array(F.struct(s["n"].alias("n"), s["micro"].alias("micro"), s["keys"].alias("keys")))
        return F.when(s["n"] >= limits.min_rows, F.concat(s["done"], full)).otherwise(s["done"])

    def step(s: Column, m: Column) -> Column:
        new = (s["n"] > 0) & ((s["micro"] + m["micro"] > most) | (s["n"] >= limits.max_rows))
        fresh = F.struct(close(s).alias("done"), F.lit(1).alias("n"), m["micro"].alias("micro"), F.array(m["key"]).alias("keys"))
        more = F.struct(s["done"].alias("done"), (s["n"] + 1).alias("n"), (s["micro"] + m["micro"]).alias("micro"), F.concat(s["keys"], F.array(m["key"])).alias("keys"))
        return F.when(new, fresh).otherwise(more).cast(kind)

    return F.aggregate(members, start, step, close)


def plan(df: DataFrame, limits: BatchLimits, by: list[str] = ["language"], key: str = "ord", seconds: str = "duration", placed: bool = False, **order) -> DataFrame:  # noqa: B006
    """(``by``..., bucket, batch, n, seconds, keys): packed batches. A bucket holds ``bucket_rows`` rows, so a fold over
    one is bounded. A single row longer than the limit is a batch of its own. Lengths are compared in microseconds."""
    rows = df if placed else shuffled(df, by, key, **order)
    member = F.struct(F.round(F.col(seconds) * 1e6).cast("bigint").alias("micro"), F.col("place"), F.col(key).cast("bigint").alias("key"))
    buckets = rows.withColumn("bucket", F.floor(F.col("place") / limits.bucket_rows)).groupBy(*by, "bucket").agg(F.array_sort(F.collect_list(member)).alias("m"))
    each = buckets.select(*by, "bucket", F.posexplode(_packed(F.col("m"), limits)).alias("batch", "b"))
    return each.select(*by, "bucket", "batch", "b.n", (F.col("b.micro") / 1e6).alias("seconds"), F.col("b.keys").alias("keys"))


def batch_order(batches: DataFrame, by: list[str] = ["language"], seed: int = 0, epoch: int = 0) -> DataFrame:  # noqa: B006
    """The order in which batches of all groups are read."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed + epoch)), *[F.coalesce(F.col(c), F.lit("")) for c in by], F.col("bucket").cast("string"), F.col("batch").cast("string")))
    return batches.orderBy(digest)


def count_batches(df: DataFrame, limits: BatchLimits, by: list[str] = ["language"], key: str = "ord", seconds: str = "duration") -> int:  # noqa: B006
    """The number reported before an epoch: planned over the unshuffled order, at least 1, so it can differ."""
    return max(1, plan(in_order(df, by, key), limits, by, key, seconds, placed=True).count())


def fixed(df: DataFrame, rows: int, key: str = "ord", seconds: str = "duration", drop_last: bool = False, seed: int | None = None) -> DataFrame:
    """(batch, n, seconds, longest): batches of a fixed number of rows, in order or shuffled."""
    placed = in_order(df, [], key) if seed is None else shuffled(df, [], key, seed)
    micro = F.round(F.col(seconds) * 1e6).cast("bigint")
    out = placed.withColumn("batch", F.floor(F.col("place") / rows)).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), (F.sum(micro) / 1e6).alias("seconds"), (F.max(micro) / 1e6).alias("longest"))
    return out.where(F.col("n") == rows) if drop_last else out


def collate(batches: DataFrame, rows: DataFrame, key: str = "ord", audio: str = "audio", targets: str = "ids") -> DataFrame:
    """One row per batch: waveforms padded to the longest, their lengths, targets joined end to end and their lengths."""
    members = batches.select("language", "bucket", "batch", F.posexplode("keys").alias("at", key)).join(rows.select(key, audio, targets), key)
    packed = members.groupBy("language", "bucket", "batch").agg(F.array_sort(F.collect_list(F.struct("at", F.col(audio).alias("a"), F.col(targets).alias("t")))).alias("m"), F.max(F.size(audio)).alias("longest"))
    return packed.select(
        "language", "bucket", "batch",
        F.transform("m", lambda x: F.concat(x["a"], F.array_repeat(F.lit(0.0), F.col("longest") - F.size(x["a"])))).alias("audio"),
        F.transform("m", lambda x: F.size(x["a"])).alias("audio_lengths"),
        F.flatten(F.transform("m", lambda x: x["t"])).alias("targets"),
        F.transform("m", lambda x: F.size(x["t"])).alias("target_lengths"),
    )


def clean_pass(df: DataFrame, share: float = 0.08, start_epoch: int = 0, epoch: int = 0, seed: int = 0, key: str = "ord") -> DataFrame:
    """``df`` with the seeded flag ``clean_pass``; false throughout before the start epoch. Digests draw it, as they do the
    shuffles, so any engine can repeat it."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed + epoch)), F.col(key).cast("string")))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 1_000_000 < int(share * 1_000_000)
    return df.withColumn("clean_pass", F.lit(epoch >= start_epoch) & draw)
