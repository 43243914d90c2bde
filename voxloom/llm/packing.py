"""Problem 2: items of varying length into containers of fixed capacity, for several profiles at once.

Rows are dealt at random to shards of a bounded number of items. Each shard is packed for every profile by best fit in
order of falling length: an item goes into the open bin that it leaves the least space in; where none holds it, the
permitted bin length of least cost is opened, cost being a fixed part per bin plus its length, spread over what is still
there to fill it. At last each bin is given the smallest permitted length that holds its contents. Lengths and the
fixed part are parameters: without a fixed part the shortest bin that holds an item is opened, which wastes least space
but makes many bins; the one used puts few bins before little space. What a shard can't fill well, its
few loosest bins, is handed on and packed again together with that of ``FAN_IN`` other shards, until one group is
left, so the loss of dealing to shards doesn't add up.

An item longer than the capacity is cut into pieces of the full capacity and a rest; the full pieces are bins of their
own and never reach Python. All other items stay whole.

Defined results: null, NaN, zero, negative and infinite lengths are not usable and give no row; rows without key and
repeated rows are items like any other; other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.scale import written

SHARD_ITEMS = 1 << 16
FAN_IN = 256
#: The emptiest bins of a shard that are filled to less than that share, with about so many items, are packed again.
LOOSE_ITEMS, LOOSE_FILL = 1024, 0.98
#: Permitted lengths where none are given, as shares of the capacity, and the fixed cost of a bin as such a share: so high
#: that few bins come before little unused space, and a shorter one is opened only for what is left at the end.
SIZES = (0.25, 0.5, 0.75, 1.0)
BIN_COST = 100.0
#: Space left free in each bin, as a share, so that sums in another order don't exceed the capacity.
_SLACK = 1e-12


def permitted_lengths(capacity: float, lengths: Sequence[float] | None = None) -> list[float]:
    """The bin lengths of a capacity, rising; the capacity is always one, longer or unusable ones are an error."""
    given = [capacity * s for s in SIZES] if lengths is None else [*map(float, lengths), float(capacity)]
    if not all(0 < s <= capacity for s in given):
        raise ValueError(f"permitted lengths must be above 0 and at most {capacity}")
    return sorted(set(given))


def pack(lengths: np.ndarray, capacity: float, permitted: Sequence[float] | None = None, bin_cost: float = BIN_COST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin of each item; the fill and the permitted length of each bin. ``bin_cost`` is in capacities."""
    order = np.argsort(-lengths, kind="stable")
    left = np.cumsum(lengths[order][::-1])[::-1]  # what is still to be placed, from each item on
    permitted = permitted_lengths(capacity, permitted)
    slack = capacity * _SLACK
    bins = np.empty(len(lengths), np.int64)
    space: list[tuple[float, int]] = []
    n_bins = 0
    out = [0] * len(order)
    for k, (length, rest) in enumerate(zip(lengths[order].tolist(), left.tolist())):
        at = bisect_left(space, (length + slack, -1))
        if at < len(space):
            free, b = space.pop(at)
        else:
            # the size that costs least per second of what can still fill it; the full one where nothing else holds the item
            fitting = [s for s in permitted if s >= length + slack] or permitted[-1:]
            free, b = min(fitting, key=lambda s: (capacity * bin_cost + s) / min(s, rest)), n_bins
            n_bins += 1
        out[k] = b
        insort(space, (free - length, b))
    bins[order] = out
    fill = np.bincount(bins, lengths, n_bins) if n_bins else np.zeros(0)
    size = np.array(permitted)[np.minimum(np.searchsorted(permitted, fill - 2 * slack), len(permitted) - 1)]
    return bins, fill, size


def _packer(capacities: dict[str, float], level: int, last: bool, permitted: dict[str, Sequence[float]], bin_cost: float):
    """Packs one group of items; flags the items of the loosest bins unless this is the last level."""

    def one(part: pd.DataFrame, profile: str, group: int) -> pd.DataFrame:
        capacity = capacities[profile]
        bins, fill, size = pack(part["seconds"].to_numpy(), capacity, permitted.get(profile), bin_cost)
        loose = np.zeros(len(fill), bool)
        if not last:
            emptiest = np.argsort(fill, kind="stable")
            emptiest = emptiest[: 1 + np.searchsorted(np.cumsum(np.bincount(bins)[emptiest]), LOOSE_ITEMS)]
            loose[emptiest[fill[emptiest] < LOOSE_FILL * capacity]] = True
        return part.assign(profile=profile, batch=(level << 56) + (group << 24) + bins, fill=fill[bins], size=size[bins], loose=loose[bins])

    return one


def _repacker(*how):
    packer = _packer(*how)

    def again(ids, part: pd.DataFrame) -> pd.DataFrame:
        return packer(part, ids[0], int(ids[1]))[_OUT]

    return again


_OUT = ["profile", "key", "piece", "seconds", "batch", "fill", "size", "loose"]


def pack_batches(df: DataFrame, capacities: dict[str, float], key: str = "ord", length: str = "duration", permitted: dict[str, Sequence[float]] | None = None, bin_cost: float = BIN_COST) -> DataFrame:
    """(profile, key, piece, seconds, batch, batch_seconds, batch_size) of every usable item and profile.
    ``capacities`` has the capacity of each profile, a handful of them; ``permitted`` the bin lengths of those profiles
    that have their own."""
    own = {p: permitted_lengths(c, (permitted or {}).get(p)) for p, c in capacities.items()}
    kind = df.schema[key].dataType.simpleString()
    schema = f"profile string, key {kind}, piece bigint, seconds double, batch bigint, fill double, size double, loose boolean"
    usable = df.select(F.col(key).alias("key"), F.col(length).cast("double").alias("d")).where("d > 0 and not isnan(d) and d < double('infinity')")
    shards = max(1, -(-usable.count() // SHARD_ITEMS))
    items = usable.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))

    first = _packer(capacities, 1, shards == 1, own, bin_cost)

    def pack_shard(ids, part: pd.DataFrame) -> pd.DataFrame:
        d, group = part["d"].to_numpy(), int(part["group"].iloc[0])
        out = []
        for profile, capacity in capacities.items():
            full = np.maximum(np.ceil(d / capacity) - 1, 0)  # pieces of the full capacity
            rest = pd.DataFrame({"key": part["key"], "piece": full.astype(np.int64), "seconds": np.minimum(d - full * capacity, capacity)})
            out.append(first(rest[rest["seconds"] > 0], profile, group))
        return pd.concat(out)[_OUT]

    packed = written(items.groupBy("group").applyInPandas(pack_shard, schema), "packed")
    done, level, groups = [packed.where("not loose")], 1, shards
    while groups > 1:
        level, groups = level + 1, -(-groups // FAN_IN)
        again = _repacker(capacities, level, groups == 1, own, bin_cost)
        loose = packed.where("loose").withColumn("group", F.floor((F.col("batch").bitwiseAND((1 << 56) - 1) / (1 << 24)) / FAN_IN).cast("int"))
        packed = written(loose.groupBy("profile", "group").applyInPandas(again, schema), "packed")
        done.append(packed.where("not loose"))

    sizes = F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(float(c)).alias("c")) for p, c in capacities.items()]))
    whole = usable.select("key", "d", sizes.alias("p")).where("d > p.c").select("p.profile", "key", F.explode(F.expr("sequence(0L, cast(ceil(d / p.c) as bigint) - 2L)")).alias("piece"), F.col("p.c").alias("seconds"))
    result = whole.select("profile", "key", "piece", "seconds", (-1 - F.monotonically_increasing_id()).alias("batch"), F.col("seconds").alias("fill"), F.col("seconds").alias("size"))
    for part in done:
        result = result.unionByName(part.drop("loose"))
    return result.select("profile", F.col("key").alias(key), "piece", "seconds", "batch", F.col("fill").alias("batch_seconds"), F.col("size").alias("batch_size"))


def batch_fill(batches: DataFrame) -> DataFrame:
    """(profile, batch, n_items, seconds, size, unused) of each batch."""
    each = batches.groupBy("profile", "batch").agg(F.count(F.lit(1)).alias("n_items"), F.max("batch_seconds").alias("seconds"), F.max("batch_size").alias("size"))
    return each.withColumn("unused", F.col("size") - F.col("seconds"))
