"""Prefix beam search over the frames of a CTC model, with an optional language model, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: (ids so far, next id) -> log-probability of a language model
LanguageModel = Callable[[tuple[int, ...], int], float]


def prefix_beam(log_probs: np.ndarray, width: int, blank: int = 0, model: LanguageModel | None = None, alpha: float = 0.0, beta: float = 0.0) -> list[int]:
    """The ids of greatest probability, summed over all paths of frames that collapse to them, as far as the ``width`` best
    beginnings of each frame show. A language model adds ``alpha`` times its log-probability and ``beta`` for each id.
    Among equals the smaller ids come first. No frames give no ids."""
    if width < 1:
        raise ValueError("the width of the beam must be positive")
    frames = np.asarray(log_probs, np.float64)
    # per beginning: log-probability of its paths that end in a blank, of those that don't, and what the model adds
    beams: dict[tuple[int, ...], tuple[float, float, float]] = {(): (0.0, -np.inf, 0.0)}
    for frame in frames:
        grown: dict[tuple[int, ...], list[float]] = {}

        def add(ids: tuple[int, ...], kind: int, value: float, bonus: float) -> None:
            own = grown.setdefault(ids, [-np.inf, -np.inf, bonus])
            own[kind] = float(np.logaddexp(own[kind], value))

        for ids, (closed, open_, bonus) in beams.items():
            total = float(np.logaddexp(closed, open_))
            add(ids, 0, total + frame[blank], bonus)
            if ids:
                add(ids, 1, open_ + frame[ids[-1]], bonus)
            for c in range(len(frame)):
                if c == blank:
                    continue
                more = bonus + beta + (alpha * model(ids, c) if model else 0.0)
                # a repeat is a new id only behind a blank
                add((*ids, c), 1, (closed if ids and ids[-1] == c else total) + frame[c], more)
        ranked = sorted(grown.items(), key=lambda x: (-(np.logaddexp(x[1][0], x[1][1]) + x[1][2]), x[0]))
        beams = {ids: tuple(v) for ids, v in ranked[:width]}
    return list(next(iter(beams)))


def beam_search(features: DataFrame, width: int, key: str = "utt_id", frames: str = "log_probs", blank: int = 0, load_model: Callable[[], LanguageModel] | None = None, alpha: float = 0.0, beta: float = 0.0) -> DataFrame:
    """(key, ids) of utterances with ``frames`` of log-probabilities; the language model is loaded once per task. Null frames
    have null ids."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model() if load_model else None
        for part in parts:
            ids = [None if x is None else prefix_beam(np.array([np.asarray(r, float) for r in x]), width, blank, model, alpha, beta) for x in part[frames]]
            yield pd.DataFrame({key: part[key], "ids": ids})

    kind = features.schema[key].dataType.simpleString()
    return features.select(key, frames).mapInPandas(run, f"`{key}` {kind}, ids array<int>")
