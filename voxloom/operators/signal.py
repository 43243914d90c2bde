"""Waveforms and features in Arrow batches: what array expressions can't say without being slow."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SAMPLES = T.ArrayType(T.FloatType())


def read_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] and the sampling rate of a PCM file of 8, 16, 24 or 32 bit."""
    with wave.open(io.BytesIO(content)) as f:
        width, data = f.getsampwidth(), f.readframes(f.getnframes())
        if width == 1:
            x = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
        else:
            # samples of two to four bytes are the upper bytes of 32-bit ones
            upper = np.zeros((len(data) // width, 4), np.uint8)
            upper[:, 4 - width :] = np.frombuffer(data, np.uint8).reshape(-1, width)
            x = upper.view("<i4").ravel() / 2147483648.0
        return x.reshape(-1, f.getnchannels()).mean(axis=1).astype(np.float32), f.getframerate()


def write_wav(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def wav_seconds(content) -> float | None:
    """Length by the header of bytes or of an open file, of which no more is read; None where there is no header."""
    try:
        with wave.open(io.BytesIO(content) if isinstance(content, bytes) else content) as f:
            return f.getnframes() / f.getframerate()
    except (wave.Error, EOFError, ZeroDivisionError):
        return None


def resample(x: np.ndarray, rate: int, target: int, width: int = 6, rolloff: float = 0.99) -> np.ndarray:
    """Band-limited interpolation with a Hann-windowed sinc, one filter per output phase."""
    if rate == target or not len(x):
        return x.astype(np.float32)
    g = np.gcd(rate, target)
    rate, target = rate // g, target // g
    base = min(rate, target) * rolloff
    reach = int(np.ceil(width * rate / base))
    at = np.arange(-reach, reach + rate) / rate
    phases = np.arange(target)[:, None] / -target + at[None]
    t = np.clip(phases * base, -width, width)
    kernel = np.sinc(t) * np.cos(t * np.pi / width / 2) ** 2 * base / rate
    padded = np.pad(x.astype(np.float64), (reach, reach + rate))
    frames = np.lib.stride_tricks.sliding_window_view(padded, kernel.shape[1])[::rate]
    return (frames @ kernel.T).ravel()[: -(-len(x) * target // rate)].astype(np.float32)


def mel_filters(rate: int = 16000, fft: int = 512, mels: int = 80) -> np.ndarray:
    """Triangular filters (HTK scale) of the power spectrum, [bins, mels]."""
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(to_mel(0), to_mel(rate / 2), mels + 2) / 2595) - 1)
    freqs = np.linspace(0, rate / 2, fft // 2 + 1)
    slopes = points[None] - freqs[:, None]
    return np.maximum(0, np.minimum(-slopes[:, :-2] / np.diff(points)[:-1], slopes[:, 2:] / np.diff(points)[1:]))


def log_mel(x: np.ndarray, rate: int = 16000, fft: int = 512, window: int = 400, hop: int = 160, mels: int = 80, top_db: float = 80.0) -> np.ndarray:
    """[time, mel] decibels of the power spectrum, frames centred, at most ``top_db`` below the greatest."""
    if not len(x):
        return np.zeros((0, mels), np.float32)
    padded = np.pad(x.astype(np.float64), fft // 2, mode="reflect" if len(x) > fft // 2 else "constant")
    frames = np.lib.stride_tricks.sliding_window_view(padded, fft)[::hop]
    hann = np.zeros(fft)
    hann[(fft - window) // 2 : (fft + window) // 2] = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
    power = np.abs(np.fft.rfft(frames * hann)) ** 2
    db = 10 * np.log10(np.maximum(power @ mel_filters(rate, fft, mels), 1e-10))
    return np.maximum(db, db.max() - top_db).astype(np.float32)


def change_speed(x: np.ndarray, factor: float) -> np.ndarray:
    """Linear interpolation at half-pixel centres to round(n / factor) samples, halves to even, at least one."""
    if not len(x) or factor == 1.0:
        return x
    n = max(1, round(len(x) / factor))
    return np.interp((np.arange(n) + 0.5) * len(x) / n - 0.5, np.arange(len(x)), x).astype(np.float32)


def telephone(x: np.ndarray, rate: int = 16000, band: int = 8000) -> np.ndarray:
    out = resample(resample(x, rate, band), band, rate)[: len(x)]
    return np.pad(out, (0, len(x) - len(out)))


def reverberate(x: np.ndarray, response: np.ndarray) -> np.ndarray:
    """By the spectrum where the response is long, in time in proportion to n log n."""
    if min(len(x), len(response)) < 64:
        return np.convolve(x, response)[: len(x)].astype(np.float32)
    size = 1 << (len(x) + len(response) - 2).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(response, size), size)[: len(x)].astype(np.float32)


def add_noise(x: np.ndarray, noise: np.ndarray, snr_db: float, offset: int = 0) -> np.ndarray:
    """Noise at a signal-to-noise ratio, from an offset on or tiled if it is shorter; clamped to [-1, 1]. Silence adds nothing."""
    if not len(noise) or not len(x):
        return x
    part = np.resize(noise, len(x)) if len(noise) < len(x) else noise[min(offset, len(noise) - len(x)) :][: len(x)]
    own, other = float(np.mean(np.square(x))), float(np.mean(np.square(part)))
    return np.clip(x + np.sqrt(own / 10 ** (snr_db / 10) / other) * part, -1, 1).astype(np.float32) if other > 0 else x


def add_gaussian(x: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    return (x + rng.normal(0, scale, len(x))).astype(np.float32)


def mute_gaps(x: np.ndarray, seed: int, gaps: int = 10, share: float = 0.05, hop: int = 160, level: float = 0.02) -> np.ndarray:
    """A way to listen to time masks: ``gaps`` spans of at most ``share`` of the frames are nearly muted. All are drawn at
    once, and a frame's depth is the running sum of spans that begin and end there."""
    frames = max(1, len(x) // hop)
    draws = np.random.default_rng(seed).random((2, gaps))
    width = np.floor(draws[0] * (max(1, int(frames * share)) + 1)).astype(int)
    first = np.floor(draws[1] * (np.maximum(1, frames - width) + 1)).astype(int)
    edges = np.bincount(first, minlength=2 * frames + 2)[: 2 * frames + 2] - np.bincount(first + width, minlength=2 * frames + 2)[: 2 * frames + 2]
    depth = np.cumsum(edges)[np.arange(len(x)) // hop]
    return (x * level ** depth).astype(x.dtype)


def room_response(x: np.ndarray, rate: int, least_s: float = 0.05, most_s: float = 0.5, least_rms: float = 1e-4) -> np.ndarray | None:
    """A room response from a recording: demeaned, from its peak on, cut; None if it is too short or too quiet."""
    loud = lambda y: len(y) > 0 and float(np.sqrt(np.mean(np.square(y)))) >= least_rms
    x = x - x.mean() if len(x) else x
    if len(x) < least_s * rate or not loud(x):
        return None
    x = x[int(np.argmax(np.abs(x))) :]
    x = x[: int(most_s * rate)] if int(most_s * rate) > 0 else x
    return x if loud(x) else None


def noise_segments(x: np.ndarray, rate: int, seed: int, least_s: float = 1.0, most_s: float | None = None, segment_s: float = 5.0, most: int = 8, least_rms: float = 1e-4) -> list[np.ndarray]:
    """Segments of a recording for a noise bank: demeaned, cropped, loud enough, at seeded places."""
    rng = np.random.default_rng(seed)
    x = x - x.mean() if len(x) else x
    if len(x) < least_s * rate:
        return []
    if most_s is not None and len(x) > most_s * rate:
        start = int(rng.integers(0, len(x) - int(most_s * rate) + 1))
        x = x[start : start + int(most_s * rate)]
    loud = lambda y: float(np.sqrt(np.mean(np.square(y)))) >= least_rms
    if not loud(x):
        return []
    size = int(segment_s * rate)
    if size <= 0 or len(x) <= size:
        return [x]
    starts = rng.integers(0, len(x) - size + 1, min(most, max(1, len(x) // size)))
    return [x[s : s + size] for s in starts.tolist() if loud(x[s : s + size])]


def samples_udf(change: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A column function for a change of waveforms; null stays null."""

    @F.pandas_udf(_SAMPLES)
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: None if x is None else np.asarray(change(np.asarray(x, np.float32)), np.float32))

    return run


def features_udf(rate: int = 16000, mels: int = 80) -> Callable[[Column], Column]:
    @F.pandas_udf(T.ArrayType(T.ArrayType(T.FloatType())))
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: None if x is None else list(log_mel(np.asarray(x, np.float32), rate, mels=mels)))

    return run


@F.pandas_udf(T.DoubleType())
def wav_seconds_udf(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None else wav_seconds(bytes(c)))


@F.pandas_udf(T.StructType([T.StructField("samples", _SAMPLES), T.StructField("rate", T.IntegerType())]))
def read_wav_udf(content: pd.Series) -> pd.DataFrame:
    out = [(None, None) if c is None else read_wav(bytes(c)) for c in content]
    return pd.DataFrame({"samples": [o[0] for o in out], "rate": [o[1] for o in out]})
