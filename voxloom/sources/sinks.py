"""Writing manifests, results, corpora and shards. Folders are written beside their place and moved there when whole."""

from __future__ import annotations

import io
import json
import tarfile
import uuid
import wave
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.text import stable_name
from voxloom.operators.batching import in_order
from voxloom.operators.reports import corpus_lines
from voxloom.operators.signal import add_noise, mute_gaps, read_wav, resample, wav_seconds, write_wav
from voxloom.sources.store import exists, opened, put


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace_folder(df: DataFrame, path: str, write: Callable[[DataFrame, str], None]) -> None:
    """Write to a folder beside ``path``, move what is there aside, the new one in, and only then delete the old one. A
    crash at any point leaves the old or the new folder whole, in its place or aside; ``recover_folder`` puts it back."""
    spark = df.sparkSession
    place = path.rstrip("/")
    recover_folder(spark, place)
    beside = f"{place}.tmp-{uuid.uuid4().hex}"
    write(df, beside)
    new, fs = _fs(spark, beside)
    old, _ = _fs(spark, place)
    aside, _ = _fs(spark, f"{place}.old")
    if fs.exists(old) and not fs.rename(old, aside):
        raise OSError(f"{place} could not be moved aside")
    if not fs.rename(new, old):
        recover_folder(spark, place)
        raise OSError(f"{beside} could not be moved to {place}")
    fs.delete(aside, True)


def recover_folder(spark: SparkSession, path: str) -> bool:
    """Put back the folder that a replacement which was stopped between its two moves left aside; drop it where the new
    one is in place. Says whether something was put back."""
    old, fs = _fs(spark, path.rstrip("/"))
    aside, _ = _fs(spark, f"{path.rstrip('/')}.old")
    if not fs.exists(aside):
        return False
    if fs.exists(old):
        fs.delete(aside, True)
        return False
    return fs.rename(aside, old)


def write_manifest(df: DataFrame, path: str, mode: str = "overwrite", keep_nulls: bool = True, drop: Sequence[str] = ()) -> None:
    """JSON lines in the order of ``ord``; null fields are written. ``drop`` names columns that aren't written, such as the
    order. Appended files get names that come behind those that are there, so the lines keep their order."""
    rows = (df.orderBy("ord") if "ord" in df.columns else df).drop(*drop)
    save = lambda d, p: d.write.mode("overwrite").option("ignoreNullFields", str(not keep_nulls).lower()).json(p)
    if mode == "append":
        _append(rows, path.rstrip("/"), save)
    else:
        replace_folder(rows, path, save)


def _append(df: DataFrame, path: str, save: Callable[[DataFrame, str], None]) -> None:
    spark = df.sparkSession
    beside = f"{path}.tmp-{uuid.uuid4().hex}"
    save(df, beside)
    new, fs = _fs(spark, beside)
    place, _ = _fs(spark, path)
    fs.mkdirs(place)
    names = lambda folder: sorted(f.getPath().getName() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    times = [int(n[6:14]) for n in names(place) if n.startswith("part-z")]
    at = max(times, default=0) + 1
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for k, name in enumerate(names(new)):
        if not fs.rename(target(new, name), target(place, f"part-z{at:08d}-{k:06d}.json")):
            raise OSError(f"{name} could not be moved to {path}")
    fs.delete(new, True)


def delete(spark: SparkSession, path: str) -> None:
    target, fs = _fs(spark, path)
    fs.delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: the old one stays until the new one is written."""
    target, fs = _fs(spark, path)
    beside, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    out = fs.create(beside)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(beside, target):
        raise OSError(f"{beside} could not be moved to {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if it isn't there."""
    target, fs = _fs(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream).decode()
    finally:
        stream.close()


def backup(spark: SparkSession, path: str, folder: str) -> str | None:
    """A copy of what is at ``path`` under a UTC stamp; None if there is nothing."""
    source, fs = _fs(spark, path)
    if not fs.exists(source):
        return None
    stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    target, other = _fs(spark, f"{folder.rstrip('/')}/{stamp}/{source.getName()}")
    other.mkdirs(target.getParent())
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, other, target, False, conf)
    return target.toString()


def write_results(df: DataFrame, path: str) -> None:
    """CSV with a header; nulls are ``-``. Results are few rows, so one file."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").option("nullValue", "-").option("emptyValue", "").csv(path)


def report_json(df: DataFrame) -> str:
    """A small report as indented JSON."""
    return json.dumps([json.loads(r) for r in df.toJSON().collect()], indent=2, ensure_ascii=False)


def write_corpus(manifest: DataFrame, path: str, most: int | None = None) -> int:
    """One text per line, at most ``most``; returns the number of lines (for a limit of 0 that of all texts)."""
    corpus_lines(manifest, most).write.mode("overwrite").text(path)
    n = corpus_lines(manifest, order=False).count()
    return min(n, most or n)


def train_tokenizer(corpus: DataFrame, model_prefix: str, vocab_size: int, model_type: str = "unigram") -> None:
    """The hand-over to a tokenizer's trainer, which reads lines on one machine; the lines stream through."""
    import sentencepiece

    lines = (r["value"] for r in corpus.toLocalIterator())
    sentencepiece.SentencePieceTrainer.train(sentence_iterator=lines, model_prefix=model_prefix, vocab_size=vocab_size, model_type=model_type, unk_id=0, bos_id=1, eos_id=2, pad_id=3)


def shard_plan(manifest: DataFrame, per_shard: int, max_shards: int | None = None) -> DataFrame:
    """``manifest`` with ``shard`` and ``record``: consecutive rows, numbered as in the archive."""
    placed = in_order(manifest, [], "ord")
    placed = placed.withColumn("_s", F.floor(F.col("place") / per_shard))
    if max_shards is not None:
        placed = placed.where(F.col("_s") < max_shards)
    return placed.withColumns({"shard": F.format_string("%06d", F.col("_s")), "record": F.format_string("%09d", F.col("place"))}).drop("_s", "place")


def write_shards(manifest: DataFrame, folder: str, per_shard: int, max_shards: int | None = None, missing: str = "error") -> DataFrame:
    """(shard, records, skipped) of TAR files with audio and metadata of each row (``content`` holds the bytes). A row
    without content is an error or left out (``missing="skip"``). A shard is written whole or not at all."""
    if missing not in ("error", "skip"):
        raise ValueError("missing must be error or skip")

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("record")
        shard, done, skipped = part["shard"].iloc[0], 0, 0
        archive = io.BytesIO()
        with tarfile.open(fileobj=archive, mode="w") as tar:
            for record, path, text, language, duration, content in zip(*(part[c] for c in ("record", "audio_filepath", "text", "language", "duration", "content"))):
                if content is None:
                    if missing == "error":
                        raise FileNotFoundError(path)
                    skipped += 1
                    continue
                meta = json.dumps({"text": text, "language": language, "duration": None if pd.isna(duration) else duration}, ensure_ascii=False).encode()
                suffix = "." + path.rsplit(".", 1)[-1] if path and "." in path else ".audio"
                for name, data in ((f"{record}{suffix}", bytes(content)), (f"{record}.json", meta)):
                    info = tarfile.TarInfo(name)
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
                done += 1
        put(f"{folder}/{shard}.tar", archive.getvalue())
        return pd.DataFrame({"shard": [shard], "records": [done], "skipped": [skipped]})

    planned = shard_plan(manifest, per_shard, max_shards).select("shard", "record", "audio_filepath", "text", "language", F.col("duration").cast("double").alias("duration"), "content")
    return planned.groupBy("shard").applyInPandas(pack, "shard string, records bigint, skipped bigint")


def store_samples(samples: DataFrame, folder: str, rate: int = 16000, peak: bool = True) -> DataFrame:
    """``samples`` (name, ..., audio) with audio_filepath and duration of the files written for them. Records with bytes are
    stored as they are, under their own type; records with samples are resampled, normalised and stored as WAV; the
    local path of others is taken over. Rows without audio or of no length are dropped, and leave no file; audio whose
    header can't be read (see ``sample_outcomes``) is stored and stays, without duration and with the status ``unread``."""
    return sample_outcomes(samples, folder, rate, peak).where(F.col("status").isin("ok", "unread"))


def _readable(data: bytes, kind: str) -> tuple[str, float | None]:
    """Status and length of a file's content with its suffix."""
    seconds = wav_seconds(data)
    if seconds:
        return "ok", seconds
    if seconds is not None or not data:
        return "empty", None
    marked = data[:4] in (b"RIFF", b"RF64", b"fLaC", b"OggS") or data[:3] == b"ID3" or data[4:8] == b"ftyp" or (data[0] == 0xFF and data[1:2] >= b"\xe0")
    return "unread" if marked or kind.lower() != ".wav" else "failed", None


def sample_outcomes(samples: DataFrame, folder: str, rate: int = 16000, peak: bool = True) -> DataFrame:
    """Every row of ``samples`` as ``store_samples`` stores it, with ``status``: ``ok``; ``unread`` (audio of another kind than
    PCM WAV: stored, its duration unknown); ``failed`` (called WAV but no audio file); ``empty`` (no length); ``missing``
    (no audio, or its file isn't there). The last three have no file. ``check_failures`` counts any of them."""
    columns = [f for f in samples.schema.fields if f.name != "audio"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        import numpy as np

        def one(name: str, audio) -> tuple[str | None, float | None, str]:
            if audio is None:
                return None, None, "missing"
            if audio["bytes"] is not None:
                data = bytes(audio["bytes"])
                kind = os.path.splitext(audio["path"] or "")[1] or ".audio"
                status, seconds = _readable(data, kind)
                return put(f"{folder}/{name}{kind}", data) if status in ("ok", "unread") else None, seconds, status
            if audio["array"] is not None:
                x = resample(np.asarray(audio["array"], np.float32), int(audio["sampling_rate"]), rate)
                top = float(np.abs(x).max()) if len(x) else 0.0
                x = x / (top + 1e-6) if peak and top > 0 else x
                return (put(f"{folder}/{name}.wav", write_wav(x, rate)), len(x) / rate, "ok") if len(x) else (None, None, "empty")
            if audio["path"] and exists(audio["path"]):
                with opened(audio["path"]) as f:
                    status, seconds = _readable(f.read(), os.path.splitext(audio["path"])[1])
                return audio["path"] if status in ("ok", "unread") else None, seconds, status
            return None, None, "missing"

        for part in parts:
            made = [one(n, a) for n, a in zip(part["name"], part["audio"])]
            duration = pd.Series([m[1] for m in made], part.index, object)  # null, not NaN, where it is unknown
            yield part[[c.name for c in columns]].assign(audio_filepath=[m[0] for m in made], duration=duration, status=[m[2] for m in made])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", audio_filepath string, duration double, status string"
    return samples.mapInPandas(run, schema)


def write_resampled(manifest: DataFrame, folder: str, rate: int = 16000) -> DataFrame:
    """``manifest`` (with ``content``) with its path and duration those of resampled WAV files, and ``status``; a row that
    fails keeps its values and is counted as failed."""
    columns = [c for c in manifest.columns if c != "content"]

    def one(name: str, content) -> tuple[str | None, float | None]:
        try:
            x, own = read_wav(bytes(content))
        except (wave.Error, EOFError, ValueError, TypeError, ZeroDivisionError):  # no audio that can be read
            return None, None
        return put(f"{folder}/{name}.wav", write_wav(resample(x, own, rate), rate)), len(x) / own

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [one(n, c) for n, c in zip(part["_name"], part["content"])]
            ok = pd.Series([m[0] is not None for m in made], part.index, bool)
            paths, seconds = (pd.Series([m[k] for m in made], part.index, object) for k in (0, 1))
            yield part[columns].assign(
                audio_filepath=paths.where(ok, part["audio_filepath"]), duration=seconds.where(ok, part["duration"]), status=ok.map({True: "ok", False: "failed"})
            )

    named = manifest.withColumn("_name", stable_name(F.col("audio_filepath")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in manifest.schema.fields if f.name != "content") + ", status string"
    return named.mapInPandas(run, schema)


def log_metrics(spark: SparkSession, folder: str, step: int, metrics: dict[str, float], run: str = "run") -> None:
    """Append metrics of a step to a table (run, step, metric, value). A step that is logged again replaces what it had."""
    rows = [(k, float(v)) for k, v in metrics.items()]
    spark.createDataFrame(rows, "metric string, value double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/run={run}/step={step}")


def logged_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """(run, step, metric, value) of all that was logged."""
    return spark.read.schema("metric string, value double, run string, step bigint").parquet(folder).select("run", "step", "metric", "value")


def metric_table(logged: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per run and step with a column for each metric, null where it wasn't logged."""
    return logged.groupBy("run", "step").pivot("metric", list(metrics)).agg(F.first("value"))


def write_previews(clips: DataFrame, folder: str, rate: int = 16000, snr_db: float = 15.0, seed: int = 0, key: str = "clip_id") -> DataFrame:
    """(key, kind, path, seconds, seed) of WAV files to listen to, three of each clip (key, samples): as it is, with gaps where
    time masks would be, and with these and noise at a fixed ratio. What is drawn depends on the seed and the key."""
    kind = clips.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        import numpy as np

        for part in parts:
            rows = []
            for k, x in zip(part[key], part["samples"]):
                if x is None:
                    continue
                own = zlib.crc32(f"{seed}:{k}".encode())
                clean = np.asarray(x, np.float32)
                gaps = mute_gaps(clean, own)
                noise = np.random.default_rng(own).normal(0, 1, len(clean)).astype(np.float32)
                for what, y in (("clean", clean), ("masked", gaps), ("full", add_noise(gaps, noise, snr_db))):
                    rows.append((k, what, put(f"{folder}/{k}_{what}.wav", write_wav(y, rate)), len(y) / rate, own))
            yield pd.DataFrame(rows, columns=[key, "kind", "path", "seconds", "seed"])

    return clips.select(key, "samples").mapInPandas(run, f"`{key}` {kind}, kind string, path string, seconds double, seed bigint")
