"""Whole jobs: filling buckets from sources, building and checking the final manifests, rebuilding them, evaluation."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators.assemble import assemble, assert_no_overlap, before_stop, bucket_names_in, bucket_targets, check_delivery, delivery, hour_stop, split_bucket
from voxloom.operators.reports import compare, manifest_stats, repair
from voxloom.operators.scoring import rollup, sorted_results, split_metrics
from voxloom.scale import written
from voxloom.sources.manifests import _exists, read_manifest, typed
from voxloom.sources.sinks import backup, write_manifest, write_results


@dataclass(frozen=True)
class Folders:
    buckets: str
    finals: str

    def bucket(self, name: str) -> str:
        return f"{self.buckets}/{name}.jsonl"

    def final(self, phase: str) -> str:
        return f"{self.finals}/{phase}_final.jsonl"


def max_hours(argument: float | None, config: dict[str, Any]) -> float | None:
    """The hour cap: the argument before the configuration."""
    return argument if argument is not None else (config.get("training") or {}).get("max_train_hours")


def read_buckets(spark: SparkSession, folders: Folders, targets: DataFrame) -> DataFrame:
    """The rows of all buckets that have a manifest, each under its bucket's name, with all their fields."""
    found = None
    for r in targets.orderBy("seq").collect():  # a configuration's buckets
        rows = typed(read_manifest(spark, folders.bucket(r["name"]), missing="empty", extra=True)).withColumn("dataset", F.lit(r["name"]))
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return found


def build_final(spark: SparkSession, folders: Folders, specs: DataFrame, phase: str, policy: str, hours: float | None = None) -> DataFrame:
    """Fill the buckets of a phase, write the final manifest, report what fell short. A bucket that the hour cap ended, or
    kept from being read, is no failure; those filled before the cap was reached are, as are all where it never was.
    Buckets without a manifest are passed over."""
    targets = bucket_targets(specs, phase)
    rows = read_buckets(spark, folders, targets)
    if rows is None:
        raise ValueError(f"no specifications for {phase}")
    filled = assemble(rows, targets)
    stop = hour_stop(filled, hours)
    final = before_stop(filled, stop)
    ordered = final.withColumn("ord", F.col("bucket_seq").cast("bigint") * (1 << 40) + F.col("place")).drop("bucket_seq", "place")
    write_manifest(ordered, folders.final(phase))
    out = spark.read.schema(ordered.schema).json(folders.final(phase))
    there = [r["name"] for r in targets.select("name").collect() if _exists(spark, folders.bucket(r["name"]))]  # a configuration's buckets
    due = targets.where(F.col("name").isin(there) & (F.lit(stop is None) | (F.col("seq") < F.lit(stop[0] if stop else 0))))
    check_delivery(delivery(out, due), policy)
    return out


def validate(train: DataFrame, val: DataFrame, specs: DataFrame) -> None:
    """No key in both manifests, no validation row under the name of a training bucket."""
    assert_no_overlap(train, val)
    if wrong := bucket_names_in(val, specs.where("phase = 'train'").select("name")).collect():
        raise ValueError(f"validation rows under training buckets: {[r['dataset'] for r in wrong]}")


def rebuild(spark: SparkSession, folders: Folders, specs: DataFrame, hours: float | None = None, backups: str | None = None, mixed: tuple[str, str, str] | None = None, probed: DataFrame | None = None) -> dict[str, DataFrame]:
    """Back up, take a mixed bucket apart (bucket, marker, new bucket), build both finals, check them, repair durations
    where ``probed`` is given, and return the finals and their statistics."""
    if backups:
        for phase in ("train", "val"):
            backup(spark, folders.final(phase), backups)
    if mixed and _exists(spark, folders.bucket(mixed[0])):
        name, marker, moved = mixed
        rest, away = split_bucket(typed(read_manifest(spark, folders.bucket(name), extra=True)), marker, name, moved, typed(read_manifest(spark, folders.bucket(moved), missing="empty", extra=True)))
        # both read the bucket that is replaced, so both are written out before
        rest, away = written(rest, "rest"), written(away, "moved")
        write_manifest(away, folders.bucket(moved))
        write_manifest(rest, folders.bucket(name))
    finals = {"train": build_final(spark, folders, specs, "train", "warn", hours), "val": build_final(spark, folders, specs, "val", "raise")}
    validate(finals["train"], finals["val"], specs)
    if probed is not None:
        finals = {k: repair(v, probed).drop("outcome") for k, v in finals.items()}
    return finals | {f"{k}_stats": manifest_stats(v) for k, v in finals.items()} | {"comparison": compare(finals["train"], finals["val"])}


def evaluate(hypotheses: DataFrame, out: str | None = None, include_null_keys: bool = False) -> DataFrame:
    """Rates by split, language and decoder, sorted; written as CSV if ``out`` is given."""
    results = sorted_results(rollup(split_metrics(hypotheses), include_null_keys))
    if out:
        write_results(results, out)
    return results
