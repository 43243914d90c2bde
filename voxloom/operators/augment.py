"""Seeded augmentation of waveforms with banks of noises and room responses."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators import signal as G

#: Samples of a bank that may be sent to every executor.
BANK_SAMPLES = 64 << 20


@dataclass(frozen=True)
class Augment:
    """Probabilities and ranges; ``start_epoch`` opens everything, ``heavy_epoch`` reverberation and noise."""

    speed_prob: float = 0.5
    speed_factors: tuple[float, ...] = (0.9, 0.95, 1.05, 1.1)
    phone_prob: float = 0.0
    gain_prob: float = 0.0
    gain_db: tuple[float, float, float, float] = (0.0, 3.0, -6.0, 6.0)  # mean, deviation, least, most
    gaussian_prob: float = 0.0
    gaussian_scale: float = 0.005
    rir_prob: float = 0.1
    noise_prob: float = 0.3
    snr_db: tuple[float, float, float, float] = (15.0, 5.0, 5.0, 30.0)
    start_epoch: int = 0
    heavy_epoch: int = 0


def with_banks(config: Augment, noises: int, responses: int, noise_prob: float = 0.4, rir_prob: float = 0.3) -> Augment:
    """Raised probabilities where there is a bank and the default wasn't changed."""
    plain = Augment()
    if noises and config.noise_prob == plain.noise_prob:
        config = replace(config, noise_prob=noise_prob)
    if responses and config.rir_prob == plain.rir_prob:
        config = replace(config, rir_prob=rir_prob)
    return config


def _collected(bank: DataFrame | None, samples: str) -> list[np.ndarray]:
    """The clips of a bank, which is bounded when it is built; a larger one than may be sent is an error."""
    if bank is None:
        return []
    total = bank.selectExpr(f"coalesce(sum(size({samples})), 0) AS n").first()["n"]
    if total > BANK_SAMPLES:
        raise ValueError(f"a bank of {total} samples can't be sent to every executor; build it with fewer items")
    # in Arrow batches: four bytes a sample, no Python number for each
    clips = bank.select(F.col(samples).cast("array<float>").alias("x")).where("x is not null").toArrow().column("x")
    each = lambda c: np.split(c.flatten().to_numpy(zero_copy_only=False), (c.offsets.to_numpy() - c.offsets[0].as_py())[1:-1])
    return [clip for chunk in clips.chunks if len(chunk) for clip in each(chunk)]


def augmented(df: DataFrame, config: Augment, epoch: int, noises: DataFrame | None = None, responses: DataFrame | None = None, seed: int = 0, key: str = "ord", samples: str = "samples", rate: int = 16000) -> DataFrame:
    """``df`` with changed ``samples``. The draws of a row depend on seed, epoch and key alone. Rows with ``clean_pass``
    keep gain, noise and reverberation off; null waveforms stay null."""
    spark = df.sparkSession
    banks = spark.sparkContext.broadcast((_collected(noises, samples), _collected(responses, samples)))

    def draw(rng: np.random.Generator, spread: tuple[float, float, float, float]) -> float:
        return float(np.clip(rng.normal(spread[0], spread[1]), spread[2], spread[3]))

    def one(x: np.ndarray, rng: np.random.Generator, clean: bool) -> np.ndarray:
        noise, rooms = banks.value
        if rng.random() < config.speed_prob:
            x = G.change_speed(x, float(rng.choice(config.speed_factors)))
        if rng.random() < config.phone_prob:
            x = G.telephone(x, rate)
        if epoch < config.start_epoch:
            return x
        if not clean:
            if rng.random() < config.gain_prob:
                x = x * 10 ** (draw(rng, config.gain_db) / 20)
            if rng.random() < config.gaussian_prob:
                x = G.add_gaussian(x, config.gaussian_scale, rng)
            if epoch >= config.heavy_epoch:
                if rooms and rng.random() < config.rir_prob:
                    x = G.reverberate(x, rooms[int(rng.integers(len(rooms)))])
                if noise and rng.random() < config.noise_prob:
                    clip = noise[int(rng.integers(len(noise)))]
                    x = G.add_noise(x, clip, draw(rng, config.snr_db), int(rng.random() * max(0, len(clip) - len(x))))
        return np.clip(x, -1, 1)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for part in parts:
            clean = part["clean_pass"].fillna(False).astype(bool) if "clean_pass" in part else pd.Series(False, index=part.index)
            out = []
            for x, k, c in zip(part[samples], part[key], clean):
                rng = np.random.default_rng([seed, epoch, zlib.crc32(str(k).encode())])
                out.append(None if x is None else np.asarray(one(np.asarray(x, np.float32), rng, c), np.float32))
            part[samples] = out
            yield part

    return df.mapInPandas(run, df.schema)
