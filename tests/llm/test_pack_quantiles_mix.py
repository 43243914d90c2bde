import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import mixing as X
from voxloom.llm import packing as P
from voxloom.llm import quantiles as Q
from voxloom.llm.tokenizers import TOKENIZER_DIR

CAPS = {"small": 10.0, "large": 60.0}


def items(spark, durations):
    return spark.createDataFrame([(i, d, 0) for i, d in enumerate(durations)], "ord bigint, duration double, batch int")


def checked(spark, durations, caps=CAPS):
    out = P.pack_batches(items(spark, durations), caps)
    rows = out.collect()
    usable = [d for d in durations if d is not None and d == d and 0 < d < math.inf]
    for profile, cap in caps.items():
        own = [r for r in rows if r["profile"] == profile]
        assert math.isclose(sum(r["seconds"] for r in own), sum(usable), rel_tol=1e-9, abs_tol=1e-9)
        pieces, fill = {}, {}
        for r in own:
            pieces.setdefault(r["ord"], []).append((r["piece"], r["seconds"]))
            fill.setdefault(r["batch"], []).append(r)
        for k, found in pieces.items():
            assert math.isclose(sum(s for _, s in found), durations[k]) and sorted(p for p, _ in found) == list(range(len(found)))
            assert len(found) == max(1, math.ceil(durations[k] / cap))
        for found in fill.values():
            total = sum(r["seconds"] for r in found)
            assert total <= cap and math.isclose(total, found[0]["batch_seconds"]) and total <= found[0]["batch_size"] * (1 + 1e-9) and found[0]["batch_size"] <= cap
        yield profile, len(fill), sum(usable) / cap


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(0)
    durations = [round(rng.expovariate(1 / 5) + 0.1, 3) for _ in range(3000)] + [None, float("nan"), 0.0, -1.0, math.inf, 10.0, 60.0, 125.5, 5.0, 5.0]
    for _, n, bound in checked(spark, durations):
        assert n <= math.ceil(bound) + 3


def test_many_shards_lose_little(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_ITEMS", 500)
    monkeypatch.setattr(P, "FAN_IN", 4)
    rng = random.Random(1)
    durations = [rng.uniform(0.2, 9) for _ in range(4000)]
    for profile, n, _ in checked(spark, durations):
        at_once = len(P.pack(np.array(durations), CAPS[profile])[1])
        assert n <= at_once * 1.02 + 1


def test_packing_edge_cases(spark):
    assert P.pack_batches(items(spark, [1.0]).limit(0), CAPS).count() == 0
    assert P.pack_batches(items(spark, [None, 0.0]), CAPS).count() == 0
    rows = spark.createDataFrame([(None, 3.0), (1, 3.0), (1, 3.0)], "ord bigint, duration double")
    out = P.pack_batches(rows, {"one": 10.0})
    assert out.count() == 3 and P.batch_fill(out).collect()[0]["n_items"] == 3


def test_bins_are_downsized():
    bins, fill, size = P.pack(np.array([4.0, 4.0, 4.0]), 10.0)
    assert sorted(size.tolist()) == [5.0, 10.0] and sorted(fill.tolist()) == [4.0, 8.0]


@pytest.mark.parametrize("error", [0.01, 0.05])
def test_percentiles_within_the_bound(spark, error):
    rng = random.Random(2)
    values = [rng.lognormvariate(0, 3) for _ in range(2000)] + [-rng.lognormvariate(0, 2) for _ in range(700)] + [0.0] * 90 + [5.0] * 300
    rows = spark.createDataFrame([(i % 5, "g", v) for i, v in enumerate(values)] + [(None, None, 7.0), (0, "g", None), (0, "g", float("nan"))], "day int, g string, v double")
    at = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    days = Q.partial_counts(rows, "v", ["day", "g"], error)
    parts = [days.where(F.col("day").eqNullSafe(F.lit(d))) for d in (0, 1, 2, 3, 4, None)]
    got = {(r["g"], r["percentile"]): r for r in Q.percentiles(Q.combine(*parts, by=["g"]), ["g"], at, error).collect()}
    ordered = sorted(values)
    for q in at:
        true = ordered[math.floor(q * (len(ordered) - 1))]
        assert abs(got[("g", q)]["value"] - true) <= abs(true) * error * (1 + 1e-9) and got[("g", q)]["n"] == len(values)
    assert got[(None, 0.5)]["n"] == 1


def test_percentile_edge_cases(spark):
    rows = spark.createDataFrame([("a", float("inf")), ("a", float("-inf")), ("a", 1e-300), ("a", 5e-324)], "g string, v double")
    got = {r["percentile"]: r["value"] for r in Q.percentiles(Q.partial_counts(rows, "v", ["g"]), ["g"], [0.0, 0.67, 1.0]).collect()}
    assert got[0.0] == -math.inf and got[1.0] == math.inf and abs(got[0.67] - 1e-300) <= 1.01e-302
    assert Q.percentiles(Q.partial_counts(rows.limit(0), "v", ["g"]), ["g"], [0.5]).count() == 0


def test_splitting_tree_keeps_every_quota():
    counts = np.array([100, 0, 7, 55])
    leaves = list(X.split(counts, np.zeros_like(counts), 11, 1, [3], 64))
    assert len(leaves) == 11
    totals = [int(c.sum()) for *_, c in leaves]
    assert max(totals) - min(totals) <= 1 and np.array_equal(sum(c for *_, c in leaves), counts)
    for s in range(4):
        spans = sorted((int(low[s]), int(low[s] + c[s])) for _, _, low, c in leaves)
        assert [a for a, _ in spans] == [0, *[b for _, b in spans[:-1]]] and spans[-1][1] == counts[s]


@pytest.mark.skipif(not __import__("os").path.isdir(TOKENIZER_DIR), reason="no tokenizers here")
def test_mix(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_DOCS", 4)
    monkeypatch.setattr(X, "SUPER", 3)
    monkeypatch.setattr(X, "SHARD_BLOCKS", 8)
    monkeypatch.setattr(X, "DRIVER_LEAVES", 2)
    rng = random.Random(4)
    docs = [(i, "abc"[i % 3], " ".join(["word"] * rng.randint(1, 30))) for i in range(300)] + [(1000, None, "x"), (1001, "a", None), (1002, "a", ""), (1003, "z", "x"), (5, "b", "again")]
    documents = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    T = "mix_name string, source string, target_share double, max_repeats int, total_ratio double"
    targets = spark.createDataFrame([("m", "a", 0.5, 3, 1.2), ("m", "b", 0.3, 1, 1.2), ("m", "c", 0.2, 1, 1.2), ("n", "a", 0.5, 1, 2.0), ("n", "none", 0.5, 9, 2.0)], T)
    mix = X.Mix(documents, targets)
    tokens = {}
    for r in mix.docs.collect():
        tokens.setdefault(r["source"], []).append(r["n_tokens"])
    shares = {(r["mix_name"], r["source"]): r for r in mix.shares().collect()}
    caps = {(r["mix_name"], r["source"]): r for r in targets.collect()}
    for k, r in shares.items():
        own = tokens.get(k[1], [])
        most = caps[k]["max_repeats"] * sum(own)
        want = min(r["wanted_tokens"], most)
        assert abs(r["actual_tokens"] - want) <= max(own, default=0)
    assert shares[("n", "none")]["actual_tokens"] == 0 and len(shares) == 5
    choice = mix.choice().collect()
    assert all(1 <= r["repeats"] <= caps[(r["mix_name"], r["source"])]["max_repeats"] for r in choice)
    assert not {1000, 1001, 1002, 1003} & {r["doc_id"] for r in choice}
    order = mix.order().collect()
    assert len(order) == sum(r["repeats"] for r in choice)
    places = {}
    for r in order:
        places.setdefault((r["mix_name"], r["shard"]), []).append(r["position"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and len(places) > 3
    again = X.Mix(documents, targets).choice().collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, choice))
    empty = X.Mix(documents.limit(0), targets)
    assert empty.choice().count() == 0 and empty.order().count() == 0 and empty.shares().count() == 5


def test_lengths_are_chosen_by_cost():
    lengths = np.array([3.9, 3.9, 3.9, 1.9, 1.9, 1.4])
    few = P.pack(lengths, 10.0, [2.0, 4.0, 5.0])
    tight = P.pack(lengths, 10.0, [2.0, 4.0, 5.0], bin_cost=0.0)
    assert len(few[1]) == 2 and len(tight[1]) == 6
    assert set(tight[2]) == {2.0, 4.0} and set(few[2]) <= {2.0, 4.0, 5.0, 10.0}
    assert (tight[2] - tight[1]).sum() <= (few[2] - few[1]).sum()
    assert P.permitted_lengths(10.0, [3]) == [3.0, 10.0]
    for wrong in ([11.0], [0.0], [float("nan")]):
        with pytest.raises(ValueError):
            P.permitted_lengths(10.0, wrong)


def test_profiles_with_their_own_lengths(spark):
    rows = spark.createDataFrame([(i, float(1 + i % 7)) for i in range(200)], "ord bigint, duration double")
    out = P.pack_batches(rows, {"a": 10.0, "b": 9.0}, permitted={"a": [3.0, 7.0]}, bin_cost=0.0).collect()
    assert len(out) == 400 and {r["batch_size"] for r in out if r["profile"] == "a"} <= {3.0, 7.0, 10.0}
    assert all(r["batch_seconds"] <= r["batch_size"] * (1 + 1e-9) for r in out)
