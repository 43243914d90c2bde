"""Transducer decoding with pluggable networks: the loop is imperative, so it runs in Arrow batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: (frame vector, predictor state) -> (log-probabilities of tokens, log-probabilities of durations or None)
Joint = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray | None]]
#: tokens so far, the blank first -> predictor state of the last one
Predictor = Callable[[list[int]], np.ndarray]


@dataclass
class DecodeStats:
    steps: int = 0
    blanks: int = 0

    def record(self, blank: bool) -> None:
        self.steps += 1
        self.blanks += blank


def greedy(frames: np.ndarray, predictor: Predictor, joint: Joint, blank: int = 0, most_per_frame: int = 10, durations: bool = False, stats: DecodeStats | None = None) -> list[int]:
    """Ids by the best symbol at each step. Without durations a blank, or ``most_per_frame`` symbols, moves one frame
    on. With durations every symbol and blank moves on by its predicted duration plus one (at least one)."""
    tokens = [blank]
    t, steps_left = 0, len(frames) * (1 + max(1, most_per_frame))
    while t < len(frames) and len(tokens) - 1 < steps_left:
        here, moved = 0, False
        while here < most_per_frame and t < len(frames) and len(tokens) - 1 < steps_left:
            scores, lengths = joint(frames[t], predictor(tokens))
            best = int(np.argmax(scores))
            if stats is not None:
                stats.record(best == blank)
            jump = max(1, int(np.argmax(lengths)) + 1) if durations else 0
            if best == blank:
                t += jump
                moved = durations
                break
            tokens.append(best)
            here += 1
            t += jump
            moved = moved or durations
        if not moved:
            t += 1
    return tokens[1:]


def decode(features: DataFrame, networks: Callable[[], tuple[Predictor, Joint]], key: str = "utt_id", frames: str = "frames", blank: int = 0, most_per_frame: int = 10, durations: bool = False) -> DataFrame:
    """(key, ids, steps, blanks) of utterances with ``frames`` (array of vectors). ``networks`` loads the model once per task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor, joint = networks()
        for part in parts:
            rows = []
            for k, x in zip(part[key], part[frames]):
                stats = DecodeStats()
                matrix = np.array([np.asarray(v, float) for v in x]) if x is not None and len(x) else np.zeros((0, 0))
                rows.append((k, greedy(matrix, predictor, joint, blank, most_per_frame, durations, stats), stats.steps, stats.blanks))
            yield pd.DataFrame(rows, columns=[key, "ids", "steps", "blanks"])

    kind = features.schema[key].dataType.simpleString()
    return features.select(key, frames).mapInPandas(run, f"`{key}` {kind}, ids array<int>, steps int, blanks int")


def transcribe(audio: DataFrame, model: Callable[[], Callable[[list], list[str]]], key: str = "path", samples: str = "samples", batch: int = 16) -> DataFrame:
    """(key, text): a model that maps lists of waveforms to texts, over all rows in batches; loaded once per task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recognise = model()
        for part in parts:
            texts: list[str] = []
            for at in range(0, len(part), batch):
                texts += recognise(list(part[samples].iloc[at : at + batch]))
            yield pd.DataFrame({key: part[key], "text": texts})

    kind = audio.schema[key].dataType.simpleString()
    return audio.select(key, samples).mapInPandas(run, f"`{key}` {kind}, text string")


def transcribe_files(spark, paths: list[str], model: Callable[[], Callable[[list], list[str]]], batch: int = 16) -> DataFrame:
    """(path, text) of audio files."""
    from voxloom.sources.audio import audio_files, decoded

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return transcribe(decoded(audio_files(spark, listed=listed)), model, batch=batch)
