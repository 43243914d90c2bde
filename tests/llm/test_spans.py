import random

import pytest

from voxloom.llm import spans as S

D = "doc_id bigint, text string, doc int, fp int"


def brute(docs):
    where = {}
    for d, t in docs:
        for i in range(len(t or "") - S.SPAN + 1):
            where.setdefault(t[i : i + S.SPAN], set()).add(d)
    pairs = {(a, b) for ds in where.values() for a in ds for b in ds if a < b}
    covered = {}
    for d, t in docs:
        t, end, n = t or "", 0, 0
        for i in range(len(t) - S.SPAN + 1):
            if len(where[t[i : i + S.SPAN]]) > 1:
                n += i + S.SPAN - max(end, i)
                end = i + S.SPAN
        covered[d] = n
    return pairs, covered


def check(spark, docs, **how):
    shared = S.SharedSpans(spark.createDataFrame([(d, t, 0, 0) for d, t in docs], D), **how)
    pairs, covered = brute(docs)
    got = [tuple(r) for r in shared.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    assert {r["doc_id"]: r["shared_chars"] for r in shared.coverage().collect()} == covered
    return pairs


def random_docs(seed, n=40):
    rng = random.Random(seed)
    noise = lambda k: "".join(rng.choices("abc ąę\U0001f680\n", k=k))
    spans = [noise(rng.choice([150, 199, 200, 201, 400])) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = [noise(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(spans), noise(rng.randint(0, 60))]
        docs.append((i, "".join(parts)))
    head = noise(160)
    docs += [(100 + i, head + noise(300)) for i in range(12)]
    return docs + [(200, None), (201, ""), (202, docs[3][1]), (203, docs[3][1]), (204, "a" * 700), (205, "b" + "a" * 300), (206, "ab" * 300), (207, noise(300) * 2)]


@pytest.mark.parametrize("seed, group", [(0, 64), (1, 64), (0, 1), (2, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, group):
    monkeypatch.setattr(S, "SMALL_GROUP", group)
    assert check(spark, random_docs(seed))


@pytest.mark.parametrize("cells, width", [(1, 2), (8, 4), (64, 6)])
def test_a_sketch_of_any_width_loses_nothing(spark, monkeypatch, cells, width):
    monkeypatch.setattr(S, "CELLS_PER_WINDOW", cells)
    assert check(spark, random_docs(5), width=width)


def test_windows_known_in_parts_of_a_partition(spark):
    texts = spark.createDataFrame([(d, t) for d, t in random_docs(6) if t and len(t) >= S.SPAN], "doc bigint, text string")
    every = lambda chunk: {(r["fp"], r["doc"]) for r in S.window_keys(texts, chunk).collect()}
    assert every(3) == every(S.CHUNK)


def test_blocks_follow_the_windows():
    cells = lambda n: S.CELLS_PER_WINDOW * n / (1 << S.block_bits(n))
    assert S.block_bits(0) == S.block_bits(1) == 0
    assert all((1 << S.BLOCK_BITS - 1) <= cells(n) <= 1 << S.BLOCK_BITS for n in (10**5, 3 * 10**9, 2 * 10**12))


def test_the_sketch_passes_every_repeated_window(spark):
    texts = spark.createDataFrame([(d, t) for d, t in random_docs(8) if t and len(t) >= S.SPAN], "doc bigint, text string").repartition(7)
    keys = S.window_keys(texts).cache()
    everywhere = {}
    for r in keys.collect():
        everywhere.setdefault(r["fp"], set()).add(r["doc"])
    passed = {(r["fp"], r["doc"]) for r in S.estimated_repeated(keys, 3).collect()} | {(r["fp"], r["doc"]) for r in keys.where("known").collect()}
    assert {(f, d) for f, ds in everywhere.items() if len(ds) > 1 for d in ds} <= passed


def test_links_count_what_pairs_expand(spark):
    docs = random_docs(11) + [(300, None), (301, "short"), (302, "short")]
    pairs, _ = brute(docs)
    first = {}
    for d, t in sorted(docs):
        if t and len(t) >= S.SPAN:
            first.setdefault(t, d)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in S.shared_links(spark.createDataFrame([(d, t, 0, 0) for d, t in docs], D)).collect()}
    assert got == {d: (first.get(t, d), sum(d in p for p in pairs)) for d, t in docs}


def test_segments_of_long_texts(spark, monkeypatch):
    import numpy as np

    text = "".join(random.Random(7).choices("abcdefgh ", k=5000))
    whole = {(int(a), int(h)) for _, at, hs in S.chosen_windows([text]) for a, h in zip(at, hs)}
    monkeypatch.setattr(S, "SEGMENT", 700)
    parts = {(int(a), int(h)) for _, at, hs in S.chosen_windows([text]) for a, h in zip(at, hs)}
    assert whole == parts
    starts = np.array(sorted(a for a, _ in whole))
    assert all(((starts >= i) & (starts <= i + S.SIDE)).any() for i in range(len(text) - S.SPAN + 1))


def test_repeated_rows_and_a_passage_in_many(spark, monkeypatch):
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh", k=900))
    docs = [(i, "".join(rng.choices("xyz", k=50)) + passage[i % 3 :] + "".join(rng.choices("xyz", k=50))) for i in range(30)]
    monkeypatch.setattr(S, "SMALL_GROUP", 8)
    assert len(check(spark, docs)) == 30 * 29 // 2
    twice = spark.createDataFrame([(d, t, 0, 0) for d, t in docs[:2] * 2], D)
    assert S.shared_pairs(twice).count() == 1 and S.shared_coverage(twice).count() == 2


def test_empty_and_single(spark):
    none = spark.createDataFrame([], D)
    assert S.shared_links(none).count() == 0 and S.shared_pairs(none).count() == 0 and S.shared_coverage(none).count() == 0
    assert check(spark, [(1, "x" * 500), (2, "short")]) == set()
