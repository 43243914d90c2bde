"""Tokenizers as column functions: any object with ``encode`` and ``decode``, loaded once per worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.functions.arrays import unshift_ids


class Words:
    """A stand-in tokenizer: one id per word, at least one."""

    def encode(self, text: str) -> list[int]:
        return [len(w) for w in text.split()] or [0]

    def decode(self, ids: list[int]) -> str:
        return " ".join("x" * i for i in ids)


def sentencepiece_model(path: str) -> Callable[[], Any]:
    def load():
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)

    return load


def tokenize(load: Callable[[], Any]) -> Callable[[Column], Column]:
    """Ids of a text; null for null."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load()
        for texts in batches:
            yield texts.map(lambda t: None if t is None else [int(i) for i in tokenizer.encode(t)])

    return run


def detokenize(load: Callable[[], Any]) -> Callable[[Column], Column]:
    """Text of shifted ids: blanks and padding are dropped first; no ids are an empty text."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load()
        for ids in batches:
            yield ids.map(lambda x: None if x is None else tokenizer.decode([int(i) for i in x]) if len(x) else "")

    return lambda ids: run(unshift_ids(ids))
