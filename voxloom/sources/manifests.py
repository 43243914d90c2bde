"""Reading manifests, lists, vocabularies and configurations."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.functions.text import BLANK, strip
from voxloom.schema import MANIFEST_RAW, SOURCE_SPEC

_FIELDS = [f.split()[0] for f in MANIFEST_RAW.split(", ")][1:]


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value): the lines of a file or folder that aren't blank, numbered from 0 by file name and place (blank ones
    count). Each block of a file numbers its own lines; only the blocks' line counts are ordered in one window."""
    meta = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    blocks = meta.groupBy("f", "b").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("f", "b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = meta.join(blocks.select("f", "b", "first", before.alias("before")), ["f", "b"]).select((F.col("before") + F.col("i") - F.col("first")).alias("ord"), "value")
    return rows.where(~F.col("value").rlike(rf"^[{BLANK}]*$"))


def fields_of(rows: DataFrame, column: str = "value") -> list[str]:
    """The names of all fields that the JSON objects of a column have: one aggregate of as many values as there are names."""
    names = rows.select(F.explode(F.json_object_keys(column)).alias("k")).distinct()
    return [r["k"] for r in names.orderBy("k").collect()]


def read_manifest(spark: SparkSession, path: str, missing: str = "error", strict: bool = False, extra: bool = False) -> DataFrame:
    """The raw manifest of a file of JSON lines; numbers come as text. Unknown fields are ignored, or with ``extra`` carried
    along as text columns of their names (nested ones as JSON), so that jobs write them back. A missing file is an error
    or an empty manifest (``missing="empty"``); a line that isn't JSON has only nulls, or is an error naming the line if
    ``strict``."""
    if missing == "empty" and not _exists(spark, path):
        return spark.createDataFrame([], MANIFEST_RAW)
    read = lines(spark, path)
    names = _FIELDS + ([k for k in fields_of(read) if k not in (*_FIELDS, "ord", "_bad")] if extra else [])
    fields = ", ".join(f"`{f}` string" for f in names)
    rows = read.select("ord", "value", F.from_json("value", fields + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    if strict:
        message = F.concat(F.lit("invalid JSON at line position "), F.col("ord").cast("string"), F.lit(": "), F.substring("value", 1, 80))
        rows = rows.withColumn("r", F.when(F.col("r._bad").isNotNull() | F.col("r").isNull(), F.raise_error(message).cast(rows.schema["r"].dataType)).otherwise(F.col("r")))
    return rows.select("ord", *[F.col(f"r.`{f}`").alias(f) for f in names])


def typed(raw: DataFrame) -> DataFrame:
    """The manifest with its duration as a number, null where it is none."""
    return raw.withColumn("duration", F.col("duration").try_cast("double"))


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """(path): the lines of a list of files."""
    return lines(spark, path).select(strip(F.col("value")).alias("path"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece, score) of a tab-separated vocabulary; pieces may hold quotes."""
    parts = lines(spark, path).select("ord", F.split("value", "\t").alias("p"))
    # a vocabulary has a fixed size, so one window over it is small
    parts = parts.select((F.row_number().over(W.orderBy("ord")) - 1).alias("i"), "p")
    return parts.select(F.col("i").cast("int").alias("id"), F.col("p")[0].alias("piece"), F.col("p")[1].cast("double").alias("score"))


# The splits a source may have.
SPLITS = ("train", "validation", "test", "dev", "other")


def check_source_split(split: str, known: tuple[str, ...] = SPLITS) -> str:
    """A split's name, which may carry a slice or a suffix behind its known name (``train[:10%]``, ``train.clean``)."""
    if not split or not split.replace("-", ".").replace("_", ".").replace("[", ".").split(".")[0] in known:
        raise ValueError(f"unknown split {split!r}, expected one of {list(known)}")
    return split


def source_table(spark: SparkSession, path: str, fmt: str = "parquet", seed: int | None = None, key: str | None = None, limit: int | None = None) -> DataFrame:
    """A source as a table; with a seed its rows come in a seeded order, as far as ``limit``."""
    rows = spark.read.format(fmt).load(path)
    if seed is not None:
        rows = rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key or rows.columns[0]).cast("string"))))
    return rows if limit is None else rows.limit(limit)


def source_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 8, bytes_per_trigger: str | None = None) -> DataFrame:
    """A source as a stream of files; what is in flight is bounded by files per trigger, or by bytes if these are given."""
    bound = ("maxFilesPerTrigger", files_per_trigger) if bytes_per_trigger is None else ("maxBytesPerTrigger", bytes_per_trigger)
    return spark.readStream.format(fmt).schema(schema).option(*bound).load(path)


def resolve_config(name: str, folders: tuple[str, ...] = (".", "configs")) -> Path:
    """The file of a configuration: as given, or in one of the folders, with or without its suffix."""
    tried = [Path(folder) / f"{name}{suffix}" for folder in folders for suffix in ("", ".yaml", ".yml")]
    for path in [Path(name), *tried]:
        if path.is_file():
            return path
    raise FileNotFoundError(f"no configuration {name!r}; tried {[str(p) for p in tried]}")


def load_config(name: str) -> dict[str, Any]:
    """A YAML (if its library is there) or JSON configuration with a mapping on top."""
    path = resolve_config(name)
    if path.suffix == ".json":
        import json

        config = json.loads(path.read_text("utf-8"))
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs the yaml library; give the configuration as JSON") from e
        config = yaml.safe_load(path.read_text("utf-8"))
    if not isinstance(config, dict):
        raise ValueError(f"{path} has no mapping on top")
    return config


def specs_of(spark: SparkSession, config: dict[str, Any], phase: str) -> DataFrame:
    """Source specifications of a configuration's phase, in their order."""
    columns = ["name", "hf_id", "config_name", "split", "lang", "samples", "text_col", "audio_col", "use_streaming", "start_offset"]
    defaults = {"text_col": "text", "audio_col": "audio", "use_streaming": False, "start_offset": 0}
    rows = [(i, phase, *[s.get(c, defaults.get(c)) for c in columns]) for i, s in enumerate((config.get("datasets") or {}).get(phase) or [])]
    return spark.createDataFrame(rows, SOURCE_SPEC)
