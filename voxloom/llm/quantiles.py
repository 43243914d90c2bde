"""Problem 3: percentiles with a guaranteed relative error from partial results that can be combined.

A value falls into the bucket of the sign of the value and of ceil(ln|v| / ln g), g = (1 + e) / (1 - e); zero has a
bucket of its own. A partial result is the count of each bucket; two of them are combined by adding matching counts, in
any order. The value reported for a percentile is 2 g^i / (g + 1) of the bucket that holds its rank, which is within the
relative error e of every value of that bucket, so of the true percentile. There are as many buckets as the span of the
data in powers of g, whatever the number of rows, so everything behind the first aggregation is small; that one combines
on the map side, so hot groups don't matter. All of it is built-in expressions.

The percentile q of n values is the value of rank floor(q (n - 1)) from 0, so the 0.5 of an even number is the lower
middle one. Defined results: null and NaN values count for nothing; infinite ones have the outermost buckets and come
out infinite; null groups and null days are groups of their own; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RELATIVE_ERROR = 0.01
#: Above every index: buckets of positive values are numbered from here up, of negative ones from minus it down.
ZERO_AT = 1 << 24
INFINITE = 1 << 23


def gamma(error: float) -> float:
    return (1 + error) / (1 - error)


def bucket_of(value: Column, error: float = RELATIVE_ERROR) -> Column:
    """The bucket's number, in the order of the values; null for null and NaN."""
    size = F.abs(value)
    index = F.when(size == float("inf"), F.lit(INFINITE)).otherwise(F.ceil(F.ln(size) / F.lit(math.log(gamma(error)))))
    number = F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("long") * (index.cast("long") + ZERO_AT))
    return F.when(value.isNotNull() & ~F.isnan(value), number.cast("long"))


def value_of(bucket: Column, error: float = RELATIVE_ERROR) -> Column:
    """The value that stands for a bucket."""
    g = gamma(error)
    index = F.abs(bucket) - ZERO_AT
    size = F.when(index == INFINITE, F.lit(float("inf"))).otherwise(F.lit(2 / (g + 1)) * F.pow(F.lit(g), index.cast("double")))
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket.cast("double")) * size)


def partial_counts(df: DataFrame, value: str, by: Sequence[str], error: float = RELATIVE_ERROR) -> DataFrame:
    """(``by``..., bucket, n): the partial results."""
    counted = df.select(*by, bucket_of(F.col(value), error).alias("bucket")).where("bucket is not null")
    return counted.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n"))


def combine(*partials: DataFrame, by: Sequence[str]) -> DataFrame:
    """One partial result of several, over the columns ``by`` only."""
    first, *more = partials
    for other in more:
        first = first.unionByName(other)
    return first.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, by: Sequence[str], at: Sequence[float], error: float = RELATIVE_ERROR) -> DataFrame:
    """(``by``..., percentile, n, value, max_relative_error) of combined counts."""
    group = W.partitionBy(*by)
    upto = group.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counts.select(*by, "bucket", F.col("n").alias("here"), F.sum("n").over(upto).alias("upto"), F.sum("n").over(group).alias("n"))
    wanted = ranked.select("*", F.explode(F.array(*[F.lit(float(q)) for q in at])).alias("percentile"))
    rank = F.floor(F.col("percentile") * (F.col("n") - 1))
    hit = wanted.where((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("here")))
    return hit.select(*by, "percentile", "n", value_of(F.col("bucket"), error).alias("value"), F.lit(float(error)).alias("max_relative_error"))
