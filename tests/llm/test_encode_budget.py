import random

import pytest
from pyspark.sql import functions as F

from voxloom.llm import budget as B
from voxloom.llm import encode as E
from voxloom.llm.tokenizers import TOKENIZER_DIR, encoding

pytestmark = pytest.mark.skipif(not __import__("os").path.isdir(TOKENIZER_DIR), reason="no tokenizers here")
ALPHABET = ["a", "b", "'", "s", " ", "  ", "\n", "1", "22", "é", "!", "\u00a0", "\u3000", "\x1c", "ł", "'ll", "\U0001f680", ".", "<|endoftext|>", "word", " Word"]


def texts(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 200))) for _ in range(n)]


def test_tree_equals_the_whole():
    enc = E._encoder("byte_bpe_50k", TOKENIZER_DIR)
    whole = encoding()
    for i, t in enumerate([*texts(1500), "a" * 3000, " " * 3000, "\n" * 999 + "x", "ab " * 4000, ""]):
        ids = E.encode_tree(t, enc, leaf=1 + i % 17)
        assert ids.tolist() == whole.encode_ordinary(t)
        assert E.decode_tree(ids, whole.decode_bytes, leaf=5).decode() == t


def test_equals_the_other_library(spark, sf_dir):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{TOKENIZER_DIR}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in E.encode_corpus(docs, leaf=500).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["doc_id"]] == (other.encode(r["text"], add_special_tokens=False).ids if r["text"] else [])


def test_encode_edge_cases(spark):
    rows = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, " ", 0), (4, "x", 0), (4, "x", 0), (None, "y", 0)], "doc_id bigint, text string, ids int")
    got = E.encode_corpus(rows).collect()
    assert len(got) == 6 and sum(r["doc_id"] == 4 for r in got) == 2
    assert {r["doc_id"]: len(r["ids"]) for r in got} == {1: 0, 2: 0, 3: 1, 4: 1, None: 1}
    assert E.encode_corpus(rows.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_trie_counts_equal_the_tokenizer(name):
    enc = encoding(name)
    rng = random.Random(1)
    pieces = {"".join(rng.choices("abcdeflnorstżółćąęw 12'.-", k=rng.randint(1, 14))).encode() for _ in range(3000)} | {b"a" * 500, "ż".encode() * 99, bytes(range(256))}
    trie = B.PrefixTrie(name)
    for p in sorted(pieces):
        assert trie.size(p) == len(enc._encode_single_piece(p))


def test_tokens_equal_the_tokenizer(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/train_final.parquet").select("ord", "text", F.col("text").alias("copy"))
    extra = spark.createDataFrame([(-i, t, t) for i, t in enumerate([*texts(300, 2), None, ""], 1)], "ord bigint, text string, copy string")
    enc = encoding()
    got = B.with_tokens(rows.unionByName(extra)).collect()
    assert len(got) == rows.count() + 302
    assert all(r["n_tokens"] == len(enc.encode_ordinary(r["copy"] or "")) for r in got)


def test_rare_pieces_give_the_same(spark):
    rows = spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts(50, 3))], "ord bigint, text string")
    enc = encoding()
    want = sorted((r["ord"], len(enc.encode_ordinary(r["text"]))) for r in rows.collect())
    for head in (0, 5, 1 << 16):
        assert sorted(map(tuple, B.with_tokens(rows, head_pieces=head).collect())) == want and len(want) == 50


def test_rare_pieces_are_shuffled_once(spark):
    """Frequent pieces meet the rows in a broadcast; both branches read one shuffle."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts(50, 3))], "ord bigint, text string")
    df = B.with_tokens(rows, head_pieces=5)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan and "ReusedExchange" in plan


def test_cells_equal_the_rows(spark):
    rows = [("s" if i % 3 else None, "en", f"d{i % 2}", t) for i, t in enumerate([*texts(40, 5), None, ""])]
    df = spark.createDataFrame(rows, "source string, language string, dataset string, text string")
    spec = spark.createDataFrame([("d0", "s", "s1", "news")], "name string, config_name string, split string, domain_tag string")
    joined = B.with_domain(df, spec)
    want = sorted(map(repr, B.token_budget(B.with_tokens(joined)).collect()))
    assert sorted(map(repr, B.totals(B.cell_budget(joined, B.DIMENSIONS)).collect())) == want
    assert B.totals(B.cell_budget(joined.limit(0), B.DIMENSIONS)).count() == 0


def test_budget(spark):
    rows = spark.createDataFrame([("s", "en", "d", "hello"), ("s", None, "d", "hello"), (None, "en", "e", None)], "source string, language string, dataset string, text string")
    spec = spark.createDataFrame([("d", "s0", "s1", "news")], "name string, config_name string, split string, domain_tag string")
    got = {(r["dimension"], r["value"]): (r["n_rows"], r["n_tokens"]) for r in B.token_budget(B.with_tokens(B.with_domain(rows, spec))).collect()}
    one = len(encoding().encode_ordinary("hello"))
    assert got[("all", None)] == (3, 2 * one) and got[("source", None)] == (1, 0) and got[("language", "en")] == (2, one) and got[("domain_tag", None)] == (3, 2 * one)
    assert B.with_tokens(rows.limit(0)).count() == 0


def test_budget_per_combination(spark):
    rows = [("s", "en", "d", "n", 3), ("s", "pl", "d", "n", 5), ("s", "en", "d", "n", 4), ("r", "pl", "d", None, 7), ("r", "pl", "e", None, 1), (None, None, None, None, 2)]
    out = B.token_budget(spark.createDataFrame(rows, "source string, language string, dataset string, domain_tag string, n_tokens bigint")).collect()
    cells = {(r["source"], r["language"], r["dataset"], r["domain_tag"]): (r["n_rows"], r["n_tokens"]) for r in out if r["dimension"] == "cell"}
    assert cells == {("s", "en", "d", "n"): (2, 7), ("s", "pl", "d", "n"): (1, 5), ("r", "pl", "d", None): (1, 7), ("r", "pl", "e", None): (1, 1), (None,) * 4: (1, 2)}
    totals = {(r["dimension"], r["value"]): (r["n_rows"], r["n_tokens"]) for r in out if r["dimension"] != "cell"}
    assert totals[("all", None)] == (6, 22) and totals[("source", "s")] == (3, 12) and totals[("language", "pl")] == (3, 13) and totals[("domain_tag", None)] == (3, 10)
    assert len(out) == 5 + 3 + 3 + 3 + 2 + 1


def test_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a b", 2, 3, 4, 5)], "_rid int, text string, piece int, size int, _row int, n_tokens int")
    r = B.with_tokens(rows).first()
    assert (r["_rid"], r["piece"], r["size"], r["_row"], r["n_tokens"]) == (1, 2, 3, 4, 2)
