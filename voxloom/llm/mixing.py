"""Problem 7: a mix of sources in which each has its target share of the wanted tokens.

Documents of a source lie in permuted blocks of some 256. A source whose wanted tokens are w and whose documents hold t
has a quota of blocks: all of them floor(w / t) times (at most its cap), and those at the beginning of the permutation
that hold what is left. A splitting tree halves the output shards and draws, with the multivariate hypergeometric
distribution, how many blocks of each source go to the left half: exact quotas that add up at every node. The top of the
tree is split on the driver (at most ``DRIVER_LEAVES`` nodes), the subtrees on the executors. Each leaf owns a range of
positions per source; a permutation of the positions makes the ranges disjoint random draws. The choice, the shares and
the order are all read from the drawn blocks: a document comes as often as its block was drawn, but that of the block
in which the quota ends only the documents up to the wanted tokens count, to within half a document. Each shard is
shuffled by itself.

The running sums behind the quotas are taken over blocks, over blocks of blocks, and over those, so no source is ever
ordered in one task.

Defined results: sources of a mix without documents, or whose documents hold no tokens, have 0 actual tokens; where
the cap keeps a source below its target the report shows it; documents without source, of other sources or without a
token are in no mix (the last could fill no share); rows are documents, equal doc_ids are told apart; empty tables give
no choice and a report of zeros.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.llm.encode import count_tokens
from voxloom.scale import written

BLOCK_DOCS = 256
#: Blocks per block of blocks.
SUPER = 4096
SHARD_BLOCKS = 64
DRIVER_LEAVES = 256


def _wanted(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Per mix and source: tokens there, tokens wanted, whole repeats and the rest to fill. As large as ``targets``."""
    t = targets.join(F.broadcast(sources), "source", "left").na.fill({"tokens": 0, "docs": 0})
    mix = W.partitionBy("mix_name")
    t = t.withColumn("wanted", F.col("target_share") * F.col("total_ratio") * F.sum("tokens").over(mix))
    whole = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("wanted") / F.col("tokens")), F.col("max_repeats").cast("bigint"))).otherwise(F.lit(0))
    t = t.withColumn("whole", whole.cast("bigint"))
    rest = F.when((F.col("whole") < F.col("max_repeats")) & (F.col("tokens") > 0), F.col("wanted") - F.col("whole") * F.col("tokens")).otherwise(F.lit(0.0))
    return t.withColumn("rest", rest).withColumn("blocks", F.ceil(F.col("docs") / BLOCK_DOCS).cast("bigint"))


def _starts(docs: DataFrame) -> DataFrame:
    """(source, block, start): the tokens before each block in its source's permutation."""
    blocks = docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("t")).withColumn("super", F.floor(F.col("block") / SUPER))
    upto = blocks.withColumn("b", F.coalesce(F.sum("t").over(W.partitionBy("source", "super").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    supers = blocks.groupBy("source", "super").agg(F.sum("t").alias("t"))
    supers = supers.select("source", "super", F.coalesce(F.sum("t").over(W.partitionBy("source").orderBy("super").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("s"))
    return upto.join(supers, ["source", "super"]).select("source", "block", (F.col("b") + F.col("s")).alias("start"))


def split(counts: np.ndarray, low: np.ndarray, shards: int, node: int, seed: list[int], depth: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(node, shards, low, counts) of the nodes ``depth`` levels down, or of the leaves above that."""
    if shards == 1 or depth == 0:
        yield node, shards, low, counts
        return
    half = shards // 2
    total = int(counts.sum())
    left = np.random.default_rng([*seed, node]).multivariate_hypergeometric(counts, total * half // shards) if total else counts
    yield from split(left, low, half, 2 * node, seed, depth - 1)
    yield from split(counts - left, low + left, shards - half, 2 * node + 1, seed, depth - 1)


def _leaves(quotas: list[tuple[str, list[str], np.ndarray]], spark, seed: int) -> DataFrame:
    """(mix_name, shard, source, low, high): the range of positions of each source in each output shard."""
    rows = []
    for k, (mix, sources, counts) in enumerate(quotas):
        shards = max(1, math.ceil(counts.sum() / SHARD_BLOCKS))
        for node, n, low, have in split(counts, np.zeros_like(counts), shards, 1, [seed, k], DRIVER_LEAVES.bit_length() - 1):
            rows.append((mix, k, node, n, sources, low.tolist(), have.tolist()))

    def grow(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples():
                for node, _, low, have in split(np.array(r.have, np.int64), np.array(r.low, np.int64), r.n, r.node, [seed, r.k], 64):
                    out += [(r.mix_name, node, s, int(a), int(a + c)) for s, a, c in zip(r.sources, low, have) if c]
            yield pd.DataFrame(out, columns=["mix_name", "shard", "source", "low", "high"])

    nodes = spark.createDataFrame(rows, "mix_name string, k int, node bigint, n bigint, sources array<string>, low array<bigint>, have array<bigint>")
    return nodes.mapInPandas(grow, "mix_name string, shard bigint, source string, low bigint, high bigint")


def _coprime_step(n: int) -> int:
    """A number near the golden section of n without a common factor: its multiples permute 0 .. n - 1."""
    step = max(1, int(n * 0.6180339887))
    while math.gcd(step, n) > 1:
        step += 1
    return step


class Mix:
    """A choice of ``documents`` for all mixes of ``targets``; ``choice``, ``order`` and ``shares`` read it."""

    def __init__(self, documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 20250301, **tokenizer: str):
        self.spark, self.seed = documents.sparkSession, seed
        self.targets = targets
        listed = targets.select("source").distinct()
        docs = documents.select(F.col(key).alias("doc_id"), "source", F.col(text).alias("text")).join(F.broadcast(listed), "source", "left_semi")
        self.docs = written(count_tokens(docs, ["doc_id", "source"], **tokenizer).where("n_tokens > 0"), "tokens")
        sources = self.docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
        self.plan = written(_wanted(targets, sources), "plan")
        # tables as large as the targets travel to the rows
        sized = self.docs.withColumn("rid", F.monotonically_increasing_id()).join(F.broadcast(self.plan.select("source", "blocks").distinct()), "source")
        sized = sized.withColumn("at", F.xxhash64(F.lit(seed), "doc_id"))
        placed = sized.withColumn("block", F.pmod(F.col("at"), F.col("blocks"))).drop("blocks")
        self.starts = written(_starts(placed), "starts")
        inside = W.partitionBy("source", "block").orderBy("at", "rid").rowsBetween(W.unboundedPreceding, -1)
        run = placed.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        self.run = run.join(self.starts, ["source", "block"]).withColumn("before", F.col("start") + F.col("inside")).drop("start", "inside")
        self.draws = written(self._drawn(), "draws")

    def _drawn(self) -> DataFrame:
        """(mix_name, source, shard, copy, block, whole, rest): the blocks of each quota, dealt to the shards."""
        plan = self.plan.select("mix_name", "source", "whole", "rest", "blocks")
        cut = F.count_if(F.col("start") < F.col("rest"))  # blocks that the last, partial copy reaches into
        used = self.starts.join(F.broadcast(plan), "source").groupBy("mix_name", "source").agg(cut.alias("n_cut"))
        used = used.join(plan, ["mix_name", "source"]).withColumn("n", F.col("whole") * F.col("blocks") + F.col("n_cut")).where("n > 0")
        totals = used.orderBy("mix_name", "source").collect()  # as many as targets
        schema = "mix_name string, source string, shard bigint, copy bigint, block bigint, whole bigint, rest double"
        if not totals:
            return self.spark.createDataFrame([], schema)
        quotas = []
        for mix in sorted({r["mix_name"] for r in totals}):
            own = [r for r in totals if r["mix_name"] == mix]
            quotas.append((mix, [r["source"] for r in own], np.array([r["n"] for r in own], np.int64)))
        sizes = self.spark.createDataFrame(
            [(r["mix_name"], r["source"], r["n"], _coprime_step(r["n"]), r["blocks"], r["whole"], r["rest"]) for r in totals],
            "mix_name string, source string, n bigint, step bigint, blocks bigint, whole bigint, rest double",
        )
        ranges = _leaves(quotas, self.spark, self.seed).join(F.broadcast(sizes), ["mix_name", "source"])
        places = ranges.select("*", F.explode(F.expr("sequence(low, high - 1)")).alias("pos"))
        index = F.pmod(F.col("pos") * F.col("step") + F.lit(self.seed), F.col("n"))
        # the quota counts all blocks of the first copy, then of the second, and so on
        return places.select("mix_name", "source", "shard", F.floor(index / F.col("blocks")).alias("copy"), F.pmod(index, F.col("blocks")).alias("block"), "whole", "rest")

    def choice(self) -> DataFrame:
        """(mix_name, source, doc_id, n_tokens, repeats)."""
        drawn = self.draws.groupBy("mix_name", "source", "block", "rest").agg(F.count_if(F.col("copy") < F.col("whole")).alias("full"), F.count_if(F.col("copy") == F.col("whole")).alias("cut"))
        repeats = F.col("full") + F.col("cut") * self._within().cast("bigint")
        chosen = self.run.join(drawn, ["source", "block"]).withColumn("repeats", repeats).where("repeats > 0")
        return chosen.select("mix_name", "source", "doc_id", "n_tokens", F.col("repeats").cast("int").alias("repeats"))

    @staticmethod
    def _within() -> Column:
        """Whether a document of the partial copy counts: its middle lies before the end of the quota."""
        return F.col("before") + F.col("n_tokens") / 2 < F.col("rest")

    def shares(self) -> DataFrame:
        """(mix_name, source, target_share, wanted_tokens, actual_tokens, actual_share, share_of_wanted, documents, copies)."""
        got = self.choice().groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("actual_tokens"), F.count(F.lit(1)).alias("documents"), F.sum("repeats").alias("copies"))
        all_ = self.plan.join(got, ["mix_name", "source"], "left").na.fill({"actual_tokens": 0, "documents": 0, "copies": 0})
        mix = W.partitionBy("mix_name")
        ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
        return all_.select(
            "mix_name", "source", "target_share", F.col("wanted").alias("wanted_tokens"), "actual_tokens",
            ratio(F.col("actual_tokens"), F.sum("actual_tokens").over(mix)).alias("actual_share"),
            ratio(F.col("actual_tokens"), F.sum("wanted").over(mix)).alias("share_of_wanted"), "documents", "copies",
        )

    def order(self) -> DataFrame:
        """(mix_name, shard, position, source, doc_id, copy): the mix as it is read, shard by shard."""
        placed = self.run.join(self.draws, ["source", "block"]).where((F.col("copy") < F.col("whole")) | self._within())
        local = W.partitionBy("mix_name", "shard").orderBy(F.xxhash64(F.lit(self.seed), "doc_id", "copy"), "doc_id", "rid", "copy")
        return placed.select("mix_name", "shard", (F.row_number().over(local) - 1).alias("position"), "source", "doc_id", F.col("copy").cast("int").alias("copy"))

    def kept(self) -> DataFrame:
        """(mix_name, source, near_target, within_cap, dealt_once) of every target: whether its tokens are within half of its
        longest document of what its target and cap allow, no document is used more often than allowed, and the shards
        hold each chosen copy exactly once."""
        longest = self.docs.groupBy("source").agg(F.max("n_tokens").alias("longest"), F.sum("n_tokens").alias("there"))
        got = self.choice().groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("actual"), F.max("repeats").alias("most"), F.sum("repeats").alias("copies"))
        dealt = self.order().groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("dealt"), F.count_distinct("shard", "position").alias("places"))
        both = self.plan.select("mix_name", "source", "wanted", "max_repeats").join(longest, "source", "left").join(got, ["mix_name", "source"], "left").join(dealt, ["mix_name", "source"], "left").na.fill(0)
        allowed = F.least(F.col("wanted"), F.col("max_repeats") * F.col("there"))
        return both.select(
            "mix_name", "source", (F.abs(F.col("actual") - allowed) <= F.col("longest") / 2 + 1e-6 * allowed).alias("near_target"),
            (F.col("most") <= F.col("max_repeats")).alias("within_cap"), ((F.col("dealt") == F.col("copies")) & (F.col("places") == F.col("copies"))).alias("dealt_once"),
        )
