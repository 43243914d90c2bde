"""Problem 6: token ids of whole texts, by a tree reduction over the halves of each text.

A text is a monoid product of its pieces: the encoding of ``left + right`` follows from the encodings of both by
re-encoding a window around the joint. Every text longer than a leaf is halved down to leaves of ``LEAF_CHARS``
characters; the tree lives inside one row, so no shuffle is needed and memory stays in proportion to one text.

What a joint can change lies between two certain cuts: places where the splitting pattern ends a piece whatever stands
around them, as no alternative spans them, looks back over them or, ending there, ahead. These are the ends of runs of letters, of
runs of digits, and of runs of other signs before white space or digits. A joint that is one changes nothing. Where
one piece spans the joint, a window of tokens grows from it, one, two, four to each side: its bytes are encoded again
and the result stands as soon as its outer tokens and their neighbours outside are compatible, that is, encode to
just these two when joined. A sequence whose neighbours are all compatible is the encoding of its bytes, so the
tokens outside are proved to stay. Anything else between the cuts (white space, contractions) is encoded as a whole.

Defined results: null and empty texts have the empty list; repeated rows each give their row; blank texts are encoded
as they stand; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.tokenizers import TOKENIZER_DIR, WHITE, encoding, ranks

LEAF_CHARS = 256
OUT_ROWS = 512
_SIGN = rf"[^\p{{L}}\p{{N}}{WHITE}]"
_CERTAIN = rf"(?<=\p{{L}})(?=\P{{L}})|(?<=\p{{N}})(?=\P{{N}})|(?<={_SIGN})(?=[{WHITE}\p{{N}}])"
_CUT, _CUT_BACK = regex.compile(_CERTAIN), regex.compile("(?r)" + _CERTAIN)
_ONE_PIECE = regex.compile(rf" ?\p{{L}}+| ?\p{{N}}+| ?{_SIGN}+")


class Encoder:
    """A byte-level BPE tokenizer that encodes pieces and joins encodings."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR):
        enc = encoding(name, folder)
        self.encode, self.piece = enc.encode_ordinary, enc._encode_single_piece
        self.bytes = {rank: token for token, rank in ranks(name, folder).items()}
        self.known: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        pair = (left, right)
        if (known := self.known.get(pair)) is None:
            known = self.known[pair] = self.piece(self.bytes[left] + self.bytes[right]) == [left, right]
        return known

    def _within(self, ids: Iterable[int], size: int) -> int:
        """How many of ``ids`` make up ``size`` bytes."""
        n = 0
        for i in ids:
            if size <= 0:
                break
            size -= len(self.bytes[i])
            n += 1
        return n

    def join(self, left: list[int], right: list[int], text: str, low: int, mid: int, high: int) -> list[int]:
        """The encoding of ``text[low:high]`` from those of both its parts."""
        if _CUT.match(text, mid):
            return left + right
        start, end = _cut_before(text, low, mid), _cut_behind(text, mid, high)
        n_left = self._within(reversed(left), len(text[start:mid].encode()))
        n_right = self._within(right, len(text[mid:end].encode()))
        if not _ONE_PIECE.fullmatch(text, start, end):
            return left[: len(left) - n_left] + self.encode(text[start:end]) + right[n_right:]
        reach = 1
        while True:
            a, b = min(reach, n_left), min(reach, n_right)
            window = self.piece(b"".join(self.bytes[i] for i in left[len(left) - a :] + right[:b]))
            if (a == n_left or self.compatible(left[-a - 1], window[0])) and (b == n_right or self.compatible(window[-1], right[b])):
                return left[: len(left) - a] + window + right[b:]
            reach *= 2


def _cut_before(text: str, low: int, mid: int) -> int:
    """The last certain cut before ``mid``, or ``low``; the search runs backwards."""
    found = _CUT_BACK.search(text, low + 1, mid)
    return found.start() if found else low


def _cut_behind(text: str, mid: int, high: int) -> int:
    """The first certain cut behind ``mid``, or ``high``."""
    found = _CUT.search(text, mid + 1, high)
    return found.start() if found else high


def encode_tree(text: str, encoder: Encoder, leaf: int = LEAF_CHARS) -> np.ndarray:
    """Ids of ``text``."""

    def ids(low: int, high: int) -> list[int]:
        if high - low <= leaf:
            return encoder.encode(text[low:high])
        mid = (low + high) // 2
        return encoder.join(ids(low, mid), ids(mid, high), text, low, mid, high)

    return np.asarray(ids(0, len(text)), np.int32)


def decode_tree(ids: np.ndarray, decode, leaf: int = LEAF_CHARS) -> bytes:
    """Bytes of ``ids``: concatenation up the same tree."""
    if len(ids) <= leaf:
        return decode(ids.tolist())
    mid = len(ids) // 2
    return decode_tree(ids[:mid], decode, leaf) + decode_tree(ids[mid:], decode, leaf)


def _encoder(name: str, folder: str) -> Encoder:
    return Encoder(name, folder)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, leaf: int = LEAF_CHARS) -> DataFrame:
    """``key`` and ``ids`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer, folder)
        for whole in batches:
            for at in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(at, OUT_ROWS)
                parts = [encode_tree(t, encode, leaf) if t else np.empty(0, np.int32) for t in batch.column(1).to_pylist()]
                offsets = np.zeros(len(parts) + 1, np.int32)
                np.cumsum([len(p) for p in parts], out=offsets[1:])
                values = np.concatenate(parts) if parts else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", out: str = "n_tokens", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """The columns ``keep`` and the number of tokens of ``text`` (0 for null), by the tokenizer at once: no ids are kept."""

    @F.pandas_udf(T.IntegerType())
    def size(texts):
        enc = encoding(tokenizer, folder)
        return texts.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int32")

    return df.select(*keep, size(F.col(text).cast("string")).alias(out))
