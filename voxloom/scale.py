"""Physical helpers shared by the operators: written tables, size-checked broadcasts, salted joins."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows and bytes of a side that may be broadcast; beyond either the join shuffles.
BROADCAST_ROWS = 300_000
BROADCAST_BYTES = 32 << 20


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Only where all of Spark is one process on this machine a
    temporary one does, if none is named; elsewhere that is an error, as each machine would have its own."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="voxloom-"))
    return _own_folder[0]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the context may be gone already; the folder is the cluster's scratch space
        pass


_tables: list[tuple[SparkSession, str]] = []
_scopes: list[list[tuple[SparkSession, str]]] = [_tables]


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are ``written`` inside are removed at the end of the block, so a long session doesn't pile them up:
    results have to be stored before. Outside of any block they stay until the interpreter ends."""
    own: list[tuple[SparkSession, str]] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.remove(own)
        for spark, path in own:
            _remove(spark, path)


@atexit.register
def _remove_all() -> None:
    for spark, path in _tables:
        _remove(spark, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder that is removed with the tables of the current scope."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _scopes[-1].append((spark, path))
    return path


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as a table in the shared folder: computed once, survives the loss of executors, its size known to the planner.
    The job runs here, while a query is put together."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(table: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a written table may be broadcast: its rows and the bytes of its strings, both measured."""
    text = [f.name for f in table.schema.fields if f.dataType.typeName() in ("string", "binary")]
    total = sum((F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`").cast("binary"))), F.lit(0)) for c in text), F.lit(0))
    n, of_text = table.agg(F.count(F.lit(1)), total).first()
    return n <= rows and of_text + 16 * n <= size


#: Keys of a lookup table that always travel to the rows: the most frequent ones, of at most so many bytes each.
HEAD_KEYS, HEAD_KEY_BYTES = 1 << 16, 64


def _least_count(table: DataFrame, count: str, keys: int) -> int:
    """The least count from which on at most ``keys`` rows of ``table`` have it, in classes of counts (exact up to 64, then
    sixteen to each power of two)."""
    n = F.col(count)
    classes = table.groupBy(F.when(n <= 64, n).otherwise(64 + F.floor((F.log2(n) - 6) * 16)).alias("c")).agg(F.count(F.lit(1)).alias("rows"), F.min(n).alias("least"))
    total, least = 0, 1 << 62
    for r in sorted(classes.collect(), key=lambda r: -r["c"]):  # at most 64 + 16 * 57 classes
        total += r["rows"]
        if total > keys:
            break
        least = r["least"]
    return least


def head_and_tail(table: DataFrame, key: str, count: str = "n", keys: int = HEAD_KEYS) -> tuple[DataFrame, DataFrame]:
    """A written lookup table in two: the most frequent keys, at most ``keys`` of ``HEAD_KEY_BYTES``, which may be sent to
    every task whatever the size of the data, and the rest, none of which is the key of more than one row in ``keys``
    (but for longer keys, whose rows have to be long)."""
    head = (F.col(count) >= _least_count(table, count, keys)) & (F.octet_length(F.col(key)) <= HEAD_KEY_BYTES)
    return table.where(head), table.where(~head)


def split_join(big: DataFrame, table: DataFrame, key: str, count: str = "n", keys: int = HEAD_KEYS) -> DataFrame:
    """Left join of ``big`` with a written lookup table of unique keys. The frequent keys are joined where the rows are and
    only rows of rare keys are shuffled, so there is no hot key, and the plan is the same at every size. ``big`` is read
    twice, so it is a written table, or cheap."""
    head, tail = (t.withColumn("_hit", F.lit(True)).drop(count) for t in head_and_tail(table, key, count, keys))
    first = big.join(F.broadcast(head), key, "left")
    new = [c for c in tail.columns if c not in (key, "_hit")]
    rest = first.where("_hit is null").drop("_hit", *new).join(tail.hint("merge"), key, "left")
    return first.where("_hit").unionByName(rest).drop("_hit")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where a small file would give a CPU-heavy step fewer tasks; larger inputs stay as they are. The
    size is the planner's estimate, so nothing is run to find it."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * (4 << 20) else df


#: Blocks summed in one window; three levels of them cover BLOCK_FAN ** 2 blocks of any size.
BLOCK_FAN = 4096


def running_total(df: DataFrame, by: Sequence[str], block: Column, order: Sequence[str | Column], value: Column, out: str) -> DataFrame:
    """``df`` with the inclusive running total of ``value`` per ``by`` in the order of (block, order) as ``out``.

    A plain ordered window puts each group into one task. Here ``block`` (a bigint that rises with the order) cuts
    the groups into pieces that are ordered each in its own task; the totals of the pieces, and of ``BLOCK_FAN`` pieces
    each, are small tables. Null group values are groups. ``order`` must be total within a block."""
    keys = [f"_g{i}" for i in range(len(by))]
    rows = df.withColumns({"_b": block, "_v": value} | {k: F.col(c) for k, c in zip(keys, by)})
    inside = W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = lambda group, sort: W.partitionBy(*group).orderBy(sort).rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t")).withColumn("_s", F.floor(F.col("_b") / BLOCK_FAN))
    upto = blocks.withColumn("_p", F.coalesce(F.sum("_t").over(before([*keys, "_s"], "_b")), F.lit(0)))
    supers = blocks.groupBy(*keys, "_s").agg(F.sum("_t").alias("_t")).withColumn("_q", F.coalesce(F.sum("_t").over(before(keys, "_s")), F.lit(0)))
    starts = _same(upto, supers.drop("_t"), [*keys, "_s"]).select(*keys, "_b", (F.col("_p") + F.col("_q")).alias("_start"))
    summed = rows.withColumn("_in", F.sum("_v").over(inside))
    return _same(summed, starts, [*keys, "_b"]).withColumn(out, F.col("_start") + F.col("_in")).drop(*keys, "_b", "_v", "_in", "_start")


def _same(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join in which nulls match nulls."""
    other = b.withColumnsRenamed({c: f"{c}_" for c in on})
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return a.join(other, condition).drop(*[f"{c}_" for c in on])


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are evaluated once per row: a filter on them isn't pushed below, nor are they copied into
    later expressions. For costly ones that are used more than once."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def hex_block(digest: Column, digits: int = 4) -> Column:
    """Block number of a hexadecimal digest: its first digits."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")
