"""Array expressions: token ids, frames, waveforms and feature matrices as higher-order functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def shift_ids(ids: Column, by: int = 1) -> Column:
    """Ids made room for the blank."""
    return F.transform(ids, lambda x: x + F.lit(by))


def unshift_ids(ids: Column) -> Column:
    """Ids without blanks and padding, back in the tokenizer's numbering."""
    return F.transform(F.filter(ids, lambda x: x > 0), lambda x: x - F.lit(1))


def pad_to(ids: Column, size: Column, pad: int = 0) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad).cast("int"), F.greatest(size - F.size(ids), F.lit(0))))


def with_start(ids: Column, start: int) -> Column:
    """Decoder input: the start (or blank) symbol before the ids."""
    return F.concat(F.array(F.lit(start).cast("int")), ids)


def with_end(ids: Column, end: int) -> Column:
    """Decoder target: the ids and the end symbol."""
    return F.concat(ids, F.array(F.lit(end).cast("int")))


def argmax(values: Column) -> Column:
    """Place of the first greatest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def collapse(tokens: Column, length: Column | None = None, blank: int = 0) -> Column:
    """Best-path ids: repeats of the frame before are dropped, then blanks."""
    seen = tokens if length is None else F.slice(tokens, 1, F.greatest(F.least(length, F.size(tokens)), F.lit(0)))
    before = F.concat(F.array(F.lit(-1).cast("int")), seen)
    kept = F.filter(F.zip_with(seen, F.slice(before, 1, F.size(seen)), lambda now, last: F.when((now != last) & (now != blank), now)), lambda x: x.isNotNull())
    return F.when(F.size(seen) > 0, kept).otherwise(F.array().cast("array<int>"))


def greedy_ids(log_probs: Column, length: Column | None = None, blank: int = 0) -> Column:
    return collapse(F.transform(log_probs, argmax), length, blank)


def to_probs(log_probs: Column, length: Column, vocabulary: int) -> Column:
    """Probabilities for a beam decoder: cut to the length and the vocabulary."""
    return F.transform(F.slice(log_probs, 1, length), lambda row: F.transform(F.slice(row, 1, vocabulary), F.exp))


def mono(channels: Column) -> Column:
    """Mean over the channels of [channel][time], given either way round (there are fewer channels than samples)."""
    n, m = F.size(channels), F.size(channels[0])
    by_time = F.transform(channels, lambda frame: F.aggregate(frame, F.lit(0.0), lambda a, x: a + x) / F.size(frame))
    by_channel = F.transform(F.sequence(F.lit(0), m - 1), lambda t: F.aggregate(channels, F.lit(0.0), lambda a, c: a + F.get(c, t)) / n)
    return F.when(n > m, by_time).otherwise(by_channel)


def peak_normalise(samples: Column) -> Column:
    # the peak is bound once; inside the lambda over the samples it would be found again for each of them
    peak = F.array(F.array_max(F.transform(samples, F.abs)))
    return F.when(F.size(samples) > 0, F.transform(peak, lambda top: F.transform(samples, lambda x: F.when(top > 0, x / (top + F.lit(1e-6))).otherwise(x)))[0]).otherwise(samples)


def pcm_to_float(samples: Column, kind: str) -> Column:
    scale = {"int16": lambda x: x / 32768.0, "int32": lambda x: x / 2147483648.0, "uint8": lambda x: (x - 128) / 128.0, "float32": lambda x: x, "float64": lambda x: x}
    if kind not in scale:
        raise ValueError(f"unknown sample type {kind}")
    return F.transform(samples, lambda x: scale[kind](x.cast("double")))


def gain(samples: Column, db: Column) -> Column:
    return F.transform(samples, lambda x: x * F.pow(F.lit(10.0), db / 20))


def clip_to_one(samples: Column) -> Column:
    return F.transform(samples, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def standardise(values: Column, length: Column) -> Column:
    """Zero mean and unit deviation (population, at least 1e-5) of the first ``length`` values; the rest is moved alike."""
    valid = F.slice(values, 1, length)
    n = F.greatest(F.size(valid), F.lit(1))
    mean = F.aggregate(valid, F.lit(0.0), lambda a, x: a + x) / n
    return F.when(
        F.size(values) >= 0,
        F.transform(
            F.transform(F.array(F.struct(mean.alias("m"))), lambda s: F.struct(s["m"].alias("m"), F.greatest(F.sqrt(F.aggregate(valid, F.lit(0.0), lambda a, x: a + (x - s["m"]) * (x - s["m"])) / n), F.lit(1e-5)).alias("d"))),
            lambda s: F.transform(values, lambda x: (x - s["m"]) / s["d"]),
        )[0],
    )


def length_mask(size: Column, length: Column) -> Column:
    """True for the valid steps of ``size``."""
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), lambda t: t < length)).otherwise(F.array().cast("array<boolean>"))


def mask_frames(matrix: Column, first: Column, width: Column) -> Column:
    """Time mask: the rows from ``first`` on are zero."""
    masked = lambda at: F.transform(matrix, lambda row, t: F.when((t >= at["a"]) & (t < at["b"]), F.transform(row, lambda x: x * 0)).otherwise(row))
    return _bound(first, width, masked)


def mask_bands(matrix: Column, first: Column, width: Column) -> Column:
    """Frequency mask: the same columns of every row are zero."""
    masked = lambda at: F.transform(matrix, lambda row: F.transform(row, lambda x, m: F.when((m >= at["a"]) & (m < at["b"]), x * 0).otherwise(x)))
    return _bound(first, width, masked)


def _bound(first: Column, width: Column, mask) -> Column:
    """``mask`` of the span's ends, which are drawn once and not again for every element."""
    return F.transform(F.array(F.struct(first.alias("a"), (first + width).alias("b"))), mask)[0]


def spec_augment(matrix: Column, seed: Column, freq_masks: int = 2, freq_width: int = 30, time_masks: int = 10, time_share: float = 0.05) -> Column:
    """Seeded masks; offsets come from digests of the seed, so a rerun gives the same."""
    draw = lambda k, n: F.pmod(F.xxhash64(seed, F.lit(k)), F.greatest(n, F.lit(1)).cast("bigint")).cast("int")
    out = matrix
    for k in range(freq_masks):
        width = draw(4 * k, F.lit(freq_width + 1))
        out = mask_bands(out, draw(4 * k + 1, F.size(matrix[0]) - width + 1), width)
    for k in range(time_masks):
        width = draw(4 * k + 2, F.floor(F.size(matrix) * time_share) + 1)
        out = mask_frames(out, draw(4 * k + 3, F.size(matrix) - width + 1), width)
    return out


def from_peak(samples: Column, most: int) -> Column:
    """A room response from its peak on."""
    sizes = F.transform(samples, F.abs)
    return F.slice(samples, F.greatest(F.array_position(sizes, F.array_max(sizes)).cast("int"), F.lit(1)), most)


def rms(samples: Column) -> Column:
    return F.sqrt(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x) / F.greatest(F.size(samples), F.lit(1)))


def demean(samples: Column) -> Column:
    return F.transform(F.array(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(samples), F.lit(1))), lambda m: F.transform(samples, lambda x: x - m))[0]


def unit_energy(samples: Column) -> Column:
    """A room response of absolute sum 1."""
    return F.transform(F.array(F.aggregate(samples, F.lit(0.0), lambda a, x: a + F.abs(x))), lambda s: F.transform(samples, lambda x: x / F.greatest(s, F.lit(1e-8))))[0]


# Sampling rate, hop and the shifts of the three subsampling factors.
SAMPLE_RATE, HOP_MS = 16000, 10
FACTORS = (2, 4, 8)


def mel_frames(samples: Column, hop: int = SAMPLE_RATE * HOP_MS // 1000) -> Column:
    return F.floor(samples / hop).cast("bigint") + 1


def subsampled(frames: Column, factor: int) -> Column:
    """Encoder steps of so many frames."""
    if factor not in FACTORS:
        raise ValueError(f"subsampling factor must be one of {FACTORS}, not {factor}")
    if factor == 2:
        return F.floor((frames - 1) / 2).cast("bigint") + 1
    return F.shiftright(frames, int(math.log2(factor)))


def encoder_length(seconds: Column, factor: int = 8, speed: float = 1.0, rate: int = SAMPLE_RATE, hop_ms: int = HOP_MS) -> Column:
    """Encoder steps of an utterance at its least length under speed change; whole samples are cut, not rounded."""
    samples = (F.greatest(F.lit(0.0), seconds * F.lit(float(speed))) * F.lit(rate)).cast("bigint")
    return subsampled(mel_frames(samples, int(rate * hop_ms / 1000)), factor)


def noam(step: Column, warmup: int) -> Column:
    """Factor of the learning rate at ``step`` (from 0): rises to 1 in ``warmup`` steps, then falls with the root."""
    if warmup <= 0:
        raise ValueError("warmup must be positive")
    s, w = (step + 1).cast("double"), float(warmup)
    return F.least(s / w, F.sqrt(F.lit(w) / s))


def cosine(step: Column, warmup: int, total: int, least: float = 0.0) -> Column:
    """Factor that rises to 1 in ``warmup`` steps and falls along a half cosine to ``least`` at ``total``."""
    if not 0 < warmup < total or not 0 <= least <= 1:
        raise ValueError("need 0 < warmup < total and a least factor between 0 and 1")
    s = (step + 1).cast("double")
    done = F.least(F.lit(1.0), (s - warmup) / F.lit(float(total - warmup)))
    return F.when(s <= warmup, s / F.lit(float(warmup))).otherwise(F.lit(least) + F.lit(1.0 - least) * (F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * done))))


def warmup_steps(total: int, share: float) -> int:
    return max(1, int(total * share))


def schedule(kind: str, step: Column, total: int, share: float, least: float = 0.0) -> Column:
    """The factor of a scheduler by name (``noam`` or ``cosine``), its warm-up a share of all steps."""
    warmup = warmup_steps(total, share)
    if kind == "noam":
        return noam(step, warmup)
    if kind == "cosine":
        return cosine(step, warmup, total, least)
    raise ValueError(f"unknown scheduler {kind!r}")


def drop_path(layers: int, most: float) -> Column:
    """Drop probability of each layer, rising in equal steps."""
    return F.transform(F.sequence(F.lit(0), F.lit(layers - 1)), lambda i: F.lit(float(most)) * i / F.lit(float(max(1, layers - 1))))


def aux_layers(layers: Column, interval: Column, layer: Column) -> Column:
    """Layers (from 0) with an auxiliary head: every ``interval``-th but the last, else the one named, else the middle."""
    every = F.filter(F.when(layers >= 2, F.sequence(F.lit(0), layers - 2)).otherwise(F.array().cast("array<int>")), lambda i: (i + 1) % interval == 0)
    middle = F.greatest(F.lit(0), F.floor(layers / 2).cast("int") - 1)
    return F.when(interval > 0, every).otherwise(F.array(F.coalesce(layer, middle)))
