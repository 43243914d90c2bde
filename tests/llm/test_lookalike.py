import re

import pytest

from voxloom.llm.lookalike import SUSPECT, canonical_values, letter_tables, plain_form, rows_not_canonical, with_canonical

SUSPECT_PYTHON = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), SUSPECT))
# the table of look-alike letters is read through a session
pytestmark = pytest.mark.usefixtures("spark")

PLAIN = [
    "zażółć gęślą jaźń", "café naïve ça", "журнал", "ПРИВЕТ", "φωνή", "λόγος", "שלום", "東京", "ありがとう", "x² 10³ ½ ¾", "„cudzysłów” ’ “x”", "a – b — c…",
    "5 € 20 ° № ™", "\U0001f468\u200d\U0001f469\u200d\U0001f467", "❤\ufe0f", "\U0001f680", "1\ufe0f\u20e3", "a  b", "ŁÓDŹ", "ł\u0301", "", " ", "tab\there",
]
MAPPED = {
    "Ｈａｌｏ": "Halo", "e\u0301": "é", "z\u0307o\u0301": "żó", "a\u200bb": "ab", "a\u200db": "ab", "so\u00adft": "soft", "\ufeffx": "x", "a\u00a0b": "a b", "a\u3000b": "a b", "a\u2011b": "a-b", "a\u2010b": "a-b",
    "ﬁn": "fin", "oﬃce": "office", "ⅿix": "mix", "Ⅰt": "It", "\u212aot": "Kot", "wіll": "will", "ѕо": "so", "јеј": "jej", "sοme": "some", "eνery": "every", "օraz": "oraz", "jeɡo": "jego", "ԛuick": "quick",
    "ΤΟ": "TO", "jegό": "jegó", "e\u200b\u0301": "é", "ＰＯＬ－ＥＮ": "POL-EN",
}


@pytest.mark.parametrize("text", PLAIN)
def test_stays(text):
    assert plain_form(text) == text


@pytest.mark.parametrize("text", MAPPED)
def test_mapped(text):
    assert plain_form(text) == MAPPED[text] and plain_form(MAPPED[text]) == MAPPED[text]


STRANGERS = {"пpивeт": "привет", "Жyк": "Жук", "журнaл": "журнал", "λόγoς": "λόγος", "пpивeт wіll": "привет will", "жw": "жw", "жλ": "жλ", "Googleж": "Googleж"}


@pytest.mark.parametrize("text", STRANGERS)
def test_strangers_in_a_word_of_another_script(text):
    assert plain_form(text) == STRANGERS[text] and plain_form(STRANGERS[text]) == STRANGERS[text]


def test_the_tables_come_from_the_library():
    letters = letter_tables()
    assert len(letters.whole) > 100 and not set(letters.whole) & set(letters.near)
    assert {c: letters.whole[c] for c in "аеорсхіјοΟΑԛ"} == dict(zip("аеорсхіјοΟΑԛ", "aeopcxijoOAq"))
    assert all(c.isascii() and c.isalpha() for t in (letters.whole, letters.near) for c in t.values())
    assert not any(c in letters.whole or c in letters.near for c in "łøđıßæœþąжи")
    assert all(re.search("[\u0080-\U0001ffff]", c) and SUSPECT_PYTHON.search(c) for c in letters.whole | letters.near)


def test_canonical_is_a_member_that_occurs(spark):
    values = spark.createDataFrame([("wіll", 3), ("ѕо", 1)], "value string, n bigint")
    plain = spark.createDataFrame([("will",), ("other",)], "value string")
    got = {r["value"]: (r["n"], r["canonical"]) for r in canonical_values(values, plain).collect()}
    assert got == {"wіll": (3, "will"), "ѕо": (1, "so")}


def table(spark, texts):
    return spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "ord bigint, text string, canonical string")


def test_operator_equals_the_form(spark):
    texts = [*PLAIN, *MAPPED, None, "był wіll a\u00a0b", "wіll", "wіll", "x" * 5000 + "\u200b"]
    rows = table(spark, texts)
    wrong = {r["ord"] for r in rows_not_canonical(rows).collect()}
    assert wrong == {i for i, t in enumerate(texts) if t is not None and plain_form(t) != t}
    got = {r["ord"]: r["canonical"] for r in with_canonical(rows).collect()}
    assert got == {i: None if t is None else plain_form(t) for i, t in enumerate(texts)}


def test_repeated_rows_and_empty(spark):
    rows = spark.createDataFrame([(1, "wіll")] * 2, "ord bigint, text string")
    assert rows_not_canonical(rows).count() == 2 and with_canonical(rows).count() == 2
    assert rows_not_canonical(rows.limit(0)).count() == 0 and with_canonical(rows.limit(0)).count() == 0


def test_joined_emoji_are_not_parted(spark):
    family = "\U0001f468\u200d\U0001f469\u200d\U0001f467"
    values = spark.createDataFrame([(family,), (family.replace("\u200d", ""),)], "value string")
    assert all(r["value"] == r["canonical"] for r in canonical_values(values).collect())


def test_against_the_form_on_the_tables(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/train_final.parquet").select("ord", "text")
    want = {r["ord"] for r in rows.collect() if r["text"] is not None and plain_form(r["text"]) != r["text"]}
    assert {r["ord"] for r in rows_not_canonical(rows).collect()} == want and want


def test_clashing_and_odd_names(spark):
    rows = spark.createDataFrame([(1, "wіll", 2, 3, 4)], "_rid int, text string, value int, _row int, `a.b` int")
    r = with_canonical(rows).first()
    assert (r["_rid"], r["value"], r["_row"], r["a.b"], r["canonical"]) == (1, 2, 3, 4, "will")
