"""Audio files as rows; bytes are only read where a query asks for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.arrays import from_peak, unit_energy
from voxloom.operators.signal import read_wav_udf, wav_seconds

# The file types that count as audio.
AUDIO_TYPES = (".wav", ".flac", ".mp3", ".ogg", ".opus", ".m4a")


def audio_files(spark: SparkSession, *folders: str, listed: DataFrame | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of the audio files below the folders and of those of a list (path, a list
    of file names is small beside the files), each once."""
    reader = lambda: spark.read.format("binaryFile")
    parts = [reader().option("recursiveFileLookup", "true").load(list(folders))] if folders else []
    if listed is not None and (names := [r["path"] for r in listed.select("path").distinct().toLocalIterator()]):
        parts.append(reader().load(names))
    if not parts:
        raise ValueError("neither a folder nor a listed file is given")
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    is_audio = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*AUDIO_TYPES)
    return found.where(is_audio).dropDuplicates(["path"])


def probe(files: DataFrame) -> DataFrame:
    """(path, seconds): lengths by the headers, null where there is none to read. Each task opens its files and reads no
    more of them than the header; the content column of ``files`` isn't asked for, so Spark doesn't load it."""

    @F.pandas_udf("double")
    def seconds(paths):
        from voxloom.sources.store import opened

        def one(path: str) -> float | None:
            with opened(path) as f:
                return wav_seconds(f)

        return paths.map(one, na_action="ignore").astype("object")

    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path")).withColumn("seconds", seconds("path"))


def decoded(files: DataFrame) -> DataFrame:
    """(path, samples, rate), mono."""
    return files.select("path", read_wav_udf("content").alias("a")).select("path", "a.samples", "a.rate")


def sample_audio(record: Column) -> Column:
    """Samples and rate of a record (array, sampling_rate, bytes): the array first, else the decoded bytes, else an error."""
    given = F.when(record["array"].isNotNull(), F.struct(record["array"].cast("array<float>").alias("samples"), record["sampling_rate"].cast("int").alias("rate")))
    read = F.when(record["array"].isNull() & record["bytes"].isNotNull(), read_wav_udf(record["bytes"]))
    neither = F.raise_error(F.lit("a record has neither samples nor bytes")).cast("struct<samples:array<float>,rate:int>")
    return F.coalesce(given, read, neither)


def bank(clips: DataFrame, rate: int = 16000, least_s: float = 0.0, most_items: int | None = None, responses: bool = False, most_s: float | None = None, seed: int = 42, key: str = "clip_id", samples: str = "samples") -> DataFrame:
    """Clips for augmentation: long enough, room responses cut and of unit energy, a seeded choice if there are too many.
    No clips give an empty bank."""
    out = clips.where(F.size(samples) >= int(least_s * rate)).where(F.size(samples) > 0)
    if responses:
        if most_s is not None:
            out = out.withColumn(samples, F.slice(samples, 1, int(most_s * rate)))
        out = out.withColumn(samples, unit_energy(F.col(samples)))
    if most_items is not None:
        out = out.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(most_items)
    return out


def response_from_peak(samples: Column, rate: int, most_s: float) -> Column:
    return from_peak(samples, int(most_s * rate))


def load_bank(spark: SparkSession, folder: str, rate: int = 16000, key: str = "path", **limits) -> DataFrame:
    """The ``bank`` of the audio files of a folder, at one sampling rate; a folder that isn't there is an empty bank."""
    from voxloom.operators.signal import resample
    from voxloom.sources.manifests import _exists

    if not _exists(spark, folder):
        return spark.createDataFrame([], "path string, samples array<float>")

    @F.pandas_udf("array<float>")
    def at_rate(samples, rates):
        import numpy as np
        import pandas as pd

        return pd.Series([resample(np.asarray(x, np.float32), int(r), rate) for x, r in zip(samples, rates)])

    clips = decoded(audio_files(spark, folder)).select("path", at_rate("samples", "rate").alias("samples"))
    return bank(clips, rate, key=key, **limits)


def packed_bank(clips: DataFrame, samples: str = "samples") -> DataFrame:
    """Clips padded with zeros to the longest, with their lengths. One aggregate finds the longest."""
    longest = clips.agg(F.max(F.size(samples))).first()[0] or 0
    return clips.withColumn("length", F.size(samples)).withColumn(samples, F.concat(F.col(samples).cast("array<float>"), F.array_repeat(F.lit(0.0).cast("float"), F.lit(longest) - F.size(samples))))
