"""The ingest job: buckets in the order of their specifications, filled source by source from where each source was left.

A source is anything that gives its records by position. What has been read is kept beside the bucket, one small file for
each source, written after every chunk of positions, so a job that is stopped repeats at most a chunk, and what it repeats
is dropped as already there.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.functions.text import row_key
from voxloom.operators.assemble import Underdelivery, append_new, bucket_targets, check_failures, ingest_text, unique_keys
from voxloom.plans.pipeline import Folders, build_final, validate
from voxloom.scale import written
from voxloom.sources.manifests import read_manifest, typed
from voxloom.sources.sinks import delete, read_text, write_manifest, write_text
from voxloom.streaming.ingest import resume_cursor


@dataclass(frozen=True)
class Options:
    """``chunk`` positions are read between two saves; ``most_failed`` rows with the status ``failed`` are borne (None: any number)."""

    skip_existing: bool = True
    sample_per_dataset: int | None = None
    chunk: int = 1 << 20
    lower: bool = False
    most_failed: int | None = None


class TableSource:
    """Records of a table by position: (position, uid, audio_filepath, text, ...)."""

    def __init__(self, table: DataFrame, position: str = "position"):
        self.table, self.position = table, position

    def size(self) -> int | None:
        last = self.table.agg(F.max(self.position)).first()[0]
        return 0 if last is None else last + 1

    def read(self, first: int, last: int) -> DataFrame:
        return self.table.where((F.col(self.position) >= first) & (F.col(self.position) < last))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a Parquet table with ``position``, by file name and place in the file; only one count per file is ordered."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_i"))
    files = rows.groupBy("_f").agg((F.max("_i") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("_f").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(files.select("_f", before.alias("_b")), "_f").withColumn("position", F.col("_b") + F.col("_i")).drop("_f", "_i", "_b")


def _state_path(folders: Folders, spec: Row) -> str:
    parts = [str(spec[c] or "") for c in ("name", "hf_id", "config_name", "split")]
    return f"{folders.buckets}/state/" + "__".join("".join(x if x.isalnum() or x in "._-" else "_" for x in p) for p in parts) + ".json"


def state_of(spark: SparkSession, folders: Folders, spec: Row) -> dict:
    """Cursor (records read behind the start offset) and whether the source is exhausted; the beginning where nothing is kept."""
    text = read_text(spark, _state_path(folders, spec))
    return {"cursor": 0, "exhausted": False} | (json.loads(text) if text else {})


def save_state(spark: SparkSession, folders: Folders, spec: Row, cursor: int, exhausted: bool) -> None:
    write_text(spark, _state_path(folders, spec), json.dumps({"cursor": cursor, "exhausted": exhausted}))


def fill_source(spark: SparkSession, folders: Folders, spec: Row, target: int, source, options: Options = Options()) -> int:
    """Append what a source has for its bucket, up to the target; returns the bucket's number of keys."""
    bucket = folders.bucket(spec["name"])
    wanted = target if options.sample_per_dataset is None else min(target, options.sample_per_dataset)
    if not options.skip_existing:
        delete(spark, bucket)
        delete(spark, _state_path(folders, spec))
    existing = lambda: typed(read_manifest(spark, bucket, missing="empty", extra=True))
    have = unique_keys(existing()).count()
    if have >= wanted:
        return have
    streamed = bool(spec["use_streaming"])
    size = None if streamed else source.size()
    cursor = resume_cursor(state_of(spark, folders, spec)["cursor"], size, have, streamed, options.skip_existing)
    offset = int(spec["start_offset"] or 0)
    ended = size is not None and offset + cursor >= size
    while have < wanted and not ended:
        first = offset + cursor
        rows = source.read(first, first + options.chunk)
        reached = rows.agg(F.max("position")).first()[0]
        if reached is None:
            ended = True
            break
        if options.most_failed is not None and "status" in rows.columns:
            check_failures(rows, options.most_failed)
        clean = ingest_text(rows.withColumn("ord", F.col("position")), lower=options.lower)
        fresh = written(append_new(existing(), clean, wanted), "fresh")
        found = fresh.agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("last")).first()
        if found["n"]:
            write_manifest(fresh.drop("position", "status"), bucket, "append", drop=["ord"])
            have += found["n"]
        # a bucket that became full leaves the rest of the chunk for another run
        cursor = (found["last"] if have >= wanted else reached) + 1 - offset
        ended = size is not None and offset + cursor >= size
        save_state(spark, folders, spec, cursor, False)
    if have < wanted and not streamed:
        save_state(spark, folders, spec, size if size is not None and offset + cursor >= size else cursor, True)
    return have


def fill_buckets(spark: SparkSession, folders: Folders, specs: DataFrame, phase: str, source_of: Callable[[Row], object], options: Options = Options()) -> dict[str, int]:
    """Fill each bucket of a phase that isn't full, in the order of its specifications; returns the keys of each. A training
    bucket whose sources are all exhausted is passed over; a bucket of another phase that stays short is an error."""
    found = {}
    for bucket in bucket_targets(specs, phase).orderBy("seq").collect():  # a configuration's buckets
        name, target = bucket["name"], bucket["target"]
        have = unique_keys(read_manifest(spark, folders.bucket(name), missing="empty")).count()
        own = specs.where((F.col("phase") == phase) & (F.col("name") == name)).orderBy("seq").collect()
        spent = phase == "train" and all(state_of(spark, folders, s)["exhausted"] for s in own)
        for spec in own if not spent else []:
            if have >= target:
                break
            have = fill_source(spark, folders, spec, target, source_of(spec), options)
        if phase != "train" and have < target:
            raise Underdelivery(f"bucket {name}: have={have} target={target}")
        found[name] = have
    return found


def run(spark: SparkSession, folders: Folders, specs: DataFrame, source_of: Callable[[Row], object], options: Options = Options(), hours: float | None = None, phases: tuple[str, ...] = ("train", "val")) -> dict[str, DataFrame]:
    """The whole job: fill, build and validate the finals of the phases."""
    finals = {}
    for phase in phases:
        fill_buckets(spark, folders, specs, phase, source_of, options)
        finals[phase] = build_final(spark, folders, specs, phase, "warn" if phase == "train" else "raise", hours if phase == "train" else None)
    if "train" in finals and "val" in finals:
        keyed = lambda m: m.where(row_key(F.col("uid"), F.col("audio_filepath")).isNotNull())
        validate(keyed(finals["train"]), keyed(finals["val"]), specs)
    return finals
