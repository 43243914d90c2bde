import random
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voxloom.llm import overlap as O
from voxloom.llm.lookalike import plain_form

M = "ord bigint, text string, audio_filepath string, side int"
# the table of look-alike letters is read through a session
pytestmark = pytest.mark.usefixtures("spark")


@pytest.mark.parametrize(
    "path, key",
    [
        (" /mnt/a/B/tmp/../c/d.e.wav ", "b/c/d.e"), ("file:///x/me%5Fads/main%5F%5Ftrain/seg%5F1.opus", "me_ads/main__train/seg_1"), ("../a/b/C.flac", "a/b/c"), ("D:\\c\\a\\B\\c.x", "a/b/c"),
        ("/r//a/./b//c.wav", "a/b/c"), ("a/b", None), ("", None), (None, None), ("100%/b/c+d.wav", "100%/b/c+d"), ("x/../../a/b/c", "a/b/c"), ("a/b/c", "a/b/c"), ("A/B/.C", "a/b/.c"), ("./a/b", None), ("a/b/c/.", "a/b/c"), ("/a/b", None), ("//a/b/c.x/", "a/b/c"),
    ],
)
def test_recording_key(spark, path, key):
    assert spark.createDataFrame([(path,)], "p string").select(O.recording_key(F.col("p"))).first()[0] == key


def words(t):
    return () if t is None else tuple("".join(c for c in plain_form(t).lower() if not unicodedata.category(c).startswith("P")).split())


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(train, evaluation):
    out = set()
    for i, a, _ in train:
        for j, b, _ in evaluation:
            x, y = words(a), words(b)
            if min(len(x), len(y)) >= 8 and sum((Counter(x) & Counter(y)).values()) * 5 >= 4 * max(len(x), len(y)) and lev(x, y) * 5 <= max(len(x), len(y)):
                out.add((i, j))
    return out


def run(spark, train, evaluation):
    T = "ord bigint, text string, audio_filepath string"
    got = O.overlaps(spark.createDataFrame(train, T), spark.createDataFrame(evaluation, T)).collect()
    assert len(got) == len(set(map(tuple, got)))
    return {tuple(r) for r in got}


def changed(rng, w, vocabulary):
    w = list(w)
    for _ in range(rng.randint(0, max(1, len(w) // 4))):
        at = rng.randrange(len(w))
        kind = rng.random()
        if kind < 0.4:
            w[at] = rng.choice(vocabulary)
        elif kind < 0.7 and len(w) > 5:
            del w[at]
        else:
            w.insert(at, rng.choice(vocabulary))
    return w


@pytest.mark.parametrize("seed, lengths, size", [(0, (6, 20), 200), (1, (40, 90), 60), (2, (8, 12), 12)])
def test_equals_brute_force(spark, seed, lengths, size):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(size)]
    base = [rng.choices(vocabulary, k=rng.randint(*lengths)) for _ in range(60)]
    style = lambda w: rng.choice([str.upper, str.lower, lambda s: s.replace(" ", ", ") + "."])(rng.choice([" ", "  "]).join(w))
    train = [(i, style(w), None) for i, w in enumerate(base)] + [(100 + i, style(w), None) for i, w in enumerate(base[:5])]
    evaluation = [(1000 + i, style(changed(rng, rng.choice(base), vocabulary)), None) for i in range(150)]
    want = brute(train, evaluation)
    assert run(spark, train, evaluation) == want and want


def test_recordings_copies_and_dirt(spark):
    long = "one two three four five six seven eight"
    train = [(1, long, "/r/a/b/c.wav"), (2, None, "A\\B\\C.flac"), (3, "short text", None), (4, "", ""), (5, long.upper(), "x"), (6, " ", None)]
    evaluation = [(11, "Оne twо, three four five six seven eight!", None), (12, "other", "q/../a/b/c"), (13, "short text", None), (14, None, None), (14, None, None)]
    assert run(spark, train, evaluation) == {(1, 11), (5, 11), (1, 12), (2, 12)}
    assert run(spark, train, evaluation[:0] or [(11, None, None)]) == set()


def test_threshold_is_exact(spark):
    w = [f"w{i}" for i in range(10)]
    at = lambda n: " ".join(["x"] * n + w[n:])
    assert run(spark, [(1, " ".join(w), None)], [(11, at(2), None), (12, at(3), None)]) == {(1, 11)}


def test_empty_tables_and_counts(spark):
    T = "ord bigint, text string, audio_filepath string, dataset string, source string, split string"
    none = spark.createDataFrame([], T)
    assert O.overlaps(none, none).count() == 0
    pairs = spark.createDataFrame([(1, 11), (2, 11), (1, 12)], "train_ord bigint, eval_ord bigint")
    evaluation = spark.createDataFrame([(11, "", "", "d", None, "val"), (12, "", "", "d", None, "val"), (13, "", "", "e", "s", "test")], T)
    assert [tuple(r) for r in O.overlap_counts(pairs, evaluation).collect()] == [("val", "d", None, 3, 2)]


def test_words_rare_and_frequent_lose_no_pair(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(50)]
    base = [rng.choices(vocabulary, k=rng.randint(8, 16)) for _ in range(30)]
    train = [(i, " ".join(w), None) for i, w in enumerate(base)]
    evaluation = [(1000 + i, " ".join(changed(rng, rng.choice(base), vocabulary)), None) for i in range(60)]
    want = brute(train, evaluation)
    T = "ord bigint, text string, audio_filepath string"
    for head in (0, 20):
        found = O.Overlaps(spark.createDataFrame(train, T), spark.createDataFrame(evaluation, T), head_words=head)
        assert {tuple(r) for r in found.pairs().collect()} == want


@pytest.mark.parametrize("longest", [0, 3, 10**9])
def test_lists_of_one_and_of_two_terms(monkeypatch, longest):
    """The postings of any two texts within the bound meet, on a key at which both reach the bounds of both."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(O, "LONG_LIST", longest)
    rng = random.Random(longest)
    vocabulary = [f"w{int(i ** 1.5)}" for i in range(40)]
    base = [rng.choices(vocabulary, k=rng.randint(8, 30)) for _ in range(80)]
    sides = [(w, 1) for w in base] + [(changed(rng, w, vocabulary), 2) for w in base for _ in range(3)]
    sides = [(w, s) for w, s in sides if len(w) >= 8]
    known = {}
    for w, s in sides:
        for x in set(w):
            n, both = known.get(x, (0, 0))
            known[x] = (n + 1, both | s)
    words = pa.array([" ".join(w) for w, _ in sides])
    rare = pa.array([[]] * len(sides), pa.list_(pa.struct([("w", pa.string()), ("n", pa.int64()), ("sides", pa.int32())])))
    t = O._Terms(words, rare, known, len(sides))
    lists = {}
    for side in (1, 2):
        key, text, reach, least = O._postings(t, 3 - side)
        for k, i, r in zip(key.tolist(), text.tolist(), reach.tolist()):
            if sides[i][1] == side:
                lists.setdefault(k, ([], []))[side - 1].append((i, r))
    met = {(i, j) for a, b in lists.values() for i, r in a for j, q in b if min(r, q) >= max(least[i], least[j])}
    want = {(i, j) for i, (x, s) in enumerate(sides) if s == 1 for j, (y, u) in enumerate(sides) if u == 2 and lev(x, y) * 5 <= max(len(x), len(y))}
    assert want <= met and want
    assert len(met) < sum(s == 1 for _, s in sides) * sum(s == 2 for _, s in sides)


def test_counts_equal_the_pairs(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(30)]
    base = [" ".join(rng.choices(vocabulary, k=10)) for _ in range(12)]
    paths = [None, "", *[f"/r/a/b/{i}.wav" for i in range(6)]]
    train = [(i, rng.choice([*base, None, "short"]), rng.choice(paths)) for i in range(60)]
    evaluation = [(100 + i, rng.choice([*base, None]), rng.choice(paths), rng.choice("vt"), rng.choice(["d", None]), "s") for i in range(40)]
    T = "ord bigint, text string, audio_filepath string"
    df = spark.createDataFrame(evaluation + evaluation[:2], T + ", split string, dataset string, source string")
    found = O.Overlaps(spark.createDataFrame(train + train[:3], T), df)
    want = sorted(map(repr, O.overlap_counts(found.pairs(), df).collect()))
    assert sorted(map(repr, found.counts(df).collect())) == want and want
