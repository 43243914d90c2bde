"""The pN_ queries: each problem's operator over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.budget import DIMENSIONS, cell_budget, totals, with_domain, with_tokens
from voxloom.llm.encode import encode_corpus
from voxloom.llm.mixing import Mix
from voxloom.llm.overlap import Overlaps, overlaps
from voxloom.llm.lookalike import rows_not_canonical, with_canonical
from voxloom.llm.packing import batch_fill, pack_batches
from voxloom.llm.quantiles import combine, partial_counts, percentiles
from voxloom.llm.spans import shared_coverage, shared_links, shared_pairs
from voxloom.scale import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_tokens(_table(spark, sf_dir, "train_final").select("ord", "text"))


def p1_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _table(spark, sf_dir, "train_final").select("source", "language", "dataset", "text")
    return totals(cell_budget(with_domain(train, _table(spark, sf_dir, "source_spec")), DIMENSIONS))


def p2_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = {r["profile"]: r["max_duration"] for r in _table(spark, sf_dir, "batch_profiles").collect()}  # a fixed handful
    return pack_batches(_table(spark, sf_dir, "train_final"), profiles)


def p2_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_fill(p2_batches(spark, sf_dir))


def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What packing must keep, per profile: every usable row whole or in as few pieces as it needs, no second lost, no batch
    over its length, and hardly more batches than total length asks for."""
    profiles = _table(spark, sf_dir, "batch_profiles")
    packed = written(p2_batches(spark, sf_dir), "batches")
    items = packed.groupBy("profile").agg(F.count_distinct("ord").alias("items"), F.count(F.lit(1)).alias("pieces"), F.sum("seconds").alias("s"))
    fill = batch_fill(packed).groupBy("profile").agg(F.count(F.lit(1)).alias("batches"), F.max("seconds").alias("longest"))
    both = items.join(fill, "profile").join(profiles, "profile")
    tight = F.col("batches") <= F.ceil(F.col("s") / F.col("max_duration")) * 1.05 + 2
    return both.select("profile", "items", "pieces", F.round("s", 1).alias("seconds"), (F.col("longest") <= F.col("max_duration") * (1 + 1e-9)).alias("within"), tight.alias("tight"))


def p3_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = _table(spark, sf_dir, "train_final").where("duration > 0").select(F.to_date("ingested_at").alias("day"), "dataset", "duration")
    return partial_counts(usable, "duration", ["day", "dataset"])


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = p3_partials(spark, sf_dir)
    each = combine(days, by=["dataset"]).withColumn("scope", F.lit("dataset"))
    over_all = combine(days.withColumn("dataset", F.lit(None).cast("string")), by=["dataset"]).withColumn("scope", F.lit("all"))
    found = percentiles(each.unionByName(over_all), ["scope", "dataset"], [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])
    return found.withColumn("value", F.round("value", 9))  # the engines' powers differ in the last bit


def _evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    val, test = _table(spark, sf_dir, "val_final"), _table(spark, sf_dir, "test_final")
    return val.withColumn("split", F.lit("val")).unionByName(test.withColumn("split", F.lit("test")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(_table(spark, sf_dir, "train_final"), _evaluation(spark, sf_dir))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    evaluation = _evaluation(spark, sf_dir)
    return Overlaps(_table(spark, sf_dir, "train_final"), evaluation).counts(evaluation)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_not_canonical(_table(spark, sf_dir, "train_final"))


def p5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_canonical(_table(spark, sf_dir, "train_final").select("ord", "text")).select("ord", "canonical")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(_table(spark, sf_dir, "documents"))


def p6_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = p6_ids(spark, sf_dir)
    return ids.select("doc_id", F.size("ids").alias("n_ids"), F.md5(F.array_join("ids", ",").cast("binary")).alias("digest"))


def _mix(spark: SparkSession, sf_dir: str) -> Mix:
    return Mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))


def p7_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).choice()


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).shares()


def p7_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).order()


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).kept()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_pairs(_table(spark, sf_dir, "documents"))


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_coverage(_table(spark, sf_dir, "documents"))


def p8_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_links(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_tokens": p1_tokens,
    "p1_budget": p1_budget,
    "p2_batches": p2_batches,
    "p2_fill": p2_fill,
    "p2_kept": p2_kept,
    "p3_partials": p3_partials,
    "p3_percentiles": p3_percentiles,
    "p4_found": p4_found,
    "p4_counts": p4_counts,
    "p5_found": p5_found,
    "p5_canonical": p5_canonical,
    "p6_ids": p6_ids,
    "p6_digest": p6_digest,
    "p7_choice": p7_choice,
    "p7_shares": p7_shares,
    "p7_order": p7_order,
    "p7_kept": p7_kept,
    "p8_found": p8_found,
    "p8_coverage": p8_coverage,
    "p8_links": p8_links,
}
