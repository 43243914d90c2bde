"""Problem 1: tokens per row, and the totals per source, language, dataset and domain and per combination of these.

Texts are cut into pieces by the tokenizer's own splitting pattern, in SQL. Distinct pieces (their number grows far
more slowly than the corpus) are laid out by their first characters and sorted, so that each partition is a prefix
trie walked depth first: a piece starts from the states of the prefix that it shares with the one before. The state of
a prefix is the last token of its exact encoding and the number of its tokens; one byte more gives the one token that
ends there and is compatible with the state at its start, two neighbours being compatible if the tokenizer encodes their
joint bytes as just the two. Terminal counts are joined back to the pieces of each row: those of a fixed number of most
frequent pieces are sent to the rows, at every size of the data; only the occurrences of rare pieces are shuffled, so no
piece is a hot key. Totals don't need rows: pieces are counted per combination of source, language, dataset and domain
before they are joined.

Defined results: null and empty texts hold 0 tokens; blank ones what the tokenizer makes of them; repeated rows count
each; rows without source, language, dataset or domain come under null.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.tokenizers import JAVA_SPLIT_PATTERN, TOKENIZER_DIR, encoding, ranks
from voxloom.scale import HEAD_KEYS, head_and_tail, written

class PrefixTrie:
    """Token counts of pieces given in sorted order; keeps the states of the current path only."""

    def __init__(self, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR):
        self.ranks = ranks(tokenizer, folder)
        self.encode = encoding(tokenizer, folder)._encode_single_piece
        self.longest = max(map(len, self.ranks))
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.path = b""
        self.last, self.count = [-1], [0]

    def _compatible(self, left: int, right: int) -> bool:
        pair = (left, right)
        if (known := self.pairs.get(pair)) is None:
            known = self.pairs[pair] = self.encode(self.bytes[left] + self.bytes[right]) == [left, right]
        return known

    def size(self, piece: bytes) -> int:
        """Tokens of ``piece``."""
        path, last, count, longest = self.path, self.last, self.count, self.longest
        shared = 0
        for a, b in zip(path, piece):
            if a != b:
                break
            shared += 1
        del last[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(piece) + 1):
            for start in range(max(0, end - longest), end):
                token = self.ranks.get(piece[start:end])
                if token is not None and (start == 0 or self._compatible(last[start], token)):
                    last.append(token)
                    count.append(count[start] + 1)
                    break
        self.path = piece
        return count[-1]


def piece_sizes(pieces: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(piece, n, size) of distinct ``pieces`` (piece, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PrefixTrie(tokenizer, folder)
        for batch in batches:
            sizes = [trie.size(p.encode()) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32())], names=["piece", "n", "size"])

    tries = pieces.select("piece", "n").repartition(F.substring("piece", 1, 4)).sortWithinPartitions("piece")
    return tries.mapInArrow(run, "piece string, n bigint, size int")


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(JAVA_SPLIT_PATTERN), F.lit(0))


def with_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, head_pieces: int = HEAD_KEYS) -> DataFrame:
    """All rows of ``df``, its columns but ``text``, and their number of tokens as ``out`` (which replaces a column of
    that name). The columns travel with every piece, so select the ones needed."""
    cols = [c for c in df.columns if c not in (out, text)]
    found = df.select(F.explode(_pieces(F.col(text))).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    sizes = written(piece_sizes(found, tokenizer, folder), "pieces")
    head, tail = (t.select("piece", "size") for t in head_and_tail(sizes, "piece", keys=head_pieces))
    row = F.struct(*[F.col(f"`{c}`") for c in cols], F.lit(0).alias("_no_column"))
    cut = df.select(row.alias("_row"), F.monotonically_increasing_id().alias("_rid"), F.col(text).alias("_text")).select("_row", "_rid", F.explode_outer(_pieces(F.col("_text"))).alias("piece"))
    sized = cut.join(F.broadcast(head), "piece", "left")
    # one record per row for its frequent pieces and one for each rare piece in it; all of a row's pieces are in one
    # partition, so the partial sums leave no more than that to shuffle
    rare = F.col("piece").isNotNull() & F.col("size").isNull()
    parts = sized.groupBy("_rid", "_row", F.when(rare, F.col("piece")).alias("piece")).agg(F.sum(F.coalesce("size", F.lit(0))).alias("common"), F.count_if(rare).alias("times"))
    # both branches read the one shuffle below: conditions on sums aren't pushed beneath it, and an outer join adds none
    here = parts.where("times = 0").select("_rid", "_row", "common")
    there = parts.where("times > 0").join(tail.hint("merge"), "piece", "left").select("_rid", "_row", (F.col("common") + F.col("times") * F.col("size")).alias("common"))
    rows = here.unionByName(there).groupBy("_rid", "_row").agg(F.sum("common").alias("_n"))
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in cols], F.col("_n").alias(out))


def cell_budget(df: DataFrame, dims: Sequence[str], text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(``dims``..., r, t): rows and tokens of every combination of ``dims``, nulls included. Pieces are counted per
    combination first, so a piece has at most as many rows to join as there are combinations."""
    counted = written(df.select(*dims, F.explode(_pieces(F.col(text))).alias("piece")).groupBy(*dims, "piece").agg(F.count(F.lit(1)).alias("times")), "cells")
    sizes = piece_sizes(counted.groupBy("piece").agg(F.sum("times").alias("n")), tokenizer, folder).select("piece", "size")
    tokens = counted.join(sizes.hint("merge"), "piece").groupBy(*dims).agg(F.lit(0).cast("bigint").alias("r"), F.sum(F.col("times") * F.col("size")).alias("t"))
    rows = df.groupBy(*dims).agg(F.count(F.lit(1)).alias("r"), F.lit(0).cast("bigint").alias("t"))
    return rows.unionByName(tokens).groupBy(*dims).agg(F.sum("r").alias("r"), F.sum("t").alias("t"))


def with_domain(df: DataFrame, spec: DataFrame) -> DataFrame:
    """``domain_tag`` of each row by dataset and source; null where the specification has none. The table of
    specifications has a fixed size."""
    tags = spec.groupBy(F.col("name").alias("dataset"), F.concat("config_name", F.lit("__"), "split").alias("source")).agg(F.min("domain_tag").alias("domain_tag"))
    return df.join(tags, ["dataset", "source"], "left")


DIMENSIONS = ("source", "language", "dataset", "domain_tag")


def token_budget(tokens: DataFrame) -> DataFrame:
    """``totals`` of rows that have their number of tokens (``n_tokens``) already."""
    return totals(tokens.groupBy(*DIMENSIONS).agg(F.count(F.lit(1)).alias("r"), F.sum("n_tokens").alias("t")))


def totals(cells: DataFrame) -> DataFrame:
    """(dimension, value, n_rows, n_tokens, source, language, dataset, domain_tag): totals per source, per language, per
    dataset, per domain, over all, and (dimension ``cell``) per combination of the four, which the last columns name;
    they are null in the other totals, as ``value`` is in cells."""
    dims = DIMENSIONS
    none = F.lit(None).cast("string")
    total = lambda d, value, own=False: F.struct(F.lit(d).alias("dimension"), value.alias("value"), *[(F.col(c) if own else none).alias(c) for c in dims])
    each = F.explode(F.array(*[total(d, F.col(d)) for d in dims], total("all", none), total("cell", none, True)))
    sums = cells.select(each.alias("d"), "r", "t").select("d.*", "r", "t").groupBy("dimension", "value", *dims).agg(F.sum("r").alias("n_rows"), F.sum("t").alias("n_tokens"))
    return sums.select("dimension", "value", "n_rows", "n_tokens", *dims)
