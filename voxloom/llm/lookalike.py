"""Problem 5: text in one consistent form, in which what looks the same is the same.

Values are the stretches between ordinary spaces. Each distinct value that holds a character outside a plain set has its
characters mapped to their plain look-alikes; the mapped values and the plain values that occur are grouped under Spark's
accent-sensitive Unicode collation in SQL. The canonical member of a class is one that occurs and is plain, the shortest
and then smallest of these; only where no plain member occurs it is the mapped form. The choice is joined back to the
values and to the rows: the most frequent values are sent to the rows, at every size of the data, the others shuffled.

What is mapped (see ``plain_form``): full-width forms, joined letters, numeral and letter signs, decomposed letters,
invisible characters outside emoji, other spaces, other hyphens, and letters of other scripts or phonetic signs in words
that can be read as Latin ones throughout. A word with a letter that no other script has is of that letter's script, and
look-alikes of other scripts in it are mapped to that one. Words truly written in another script, emoji with their
joiners, quotes, dashes, ellipsis, superscripts, fractions and signs stay. Which letters look alike is read from the
table of confusable characters of the Unicode library that Spark ships (``letter_tables``); only what that table has
otherwise, and letters that pass for a Latin one only beside Latin letters, are listed here.

Defined results: null stays null, empty and blank texts are canonical, repeated rows each keep their result, and other
columns are carried through whatever their names are (temporary columns are packed away from them).
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.scale import split_join, written

# What the table of confusables has otherwise, or only by the look of upper-case letters.
CORRECTED = dict(zip("κτχωӏʋԚ", "ktxwlvQ"))
# Letters that pass for the Latin one only beside Latin letters, since ordinary words of their own script
# consist of them and their like.
BESIDE_LATIN = "αγικρστυχωϱϜϺУгктмнвүьЬѡҽագռքՏყჿ"

_HYPHENS = "\u2010\u2011\u2043\ufe63\uff0d"
_SPACES = "\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u0085"
_COMPAT = "\u0132\u0133\u01c4-\u01cc\u01f1-\u01f3\u2160-\u217f\ufb00-\ufb06\uff01-\uff5e\uffe0-\uffe6"
_FONT = "\u2100-\u214f\U0001d400-\U0001d7ff"
_EMOJI = "\u00a9\u00ae\u203c\u2049\u2122\u2139\u2190-\u2bff\u3030\u303d\u3297\u3299\U0001f000-\U0001faff"
_VISIBLE_FORMAT = "\u0600-\u0605\u06dd\u070f\u08e2\U000110bd\U000110cd"

#: Java regular expression of a character that needs a look; everything else is plain already.
SUSPECT = (
    r"[^\t-\r\x20-\x7E\u00a1-\u00ac\u00ae-\u0131\u0134-\u0148\u014a-\u017e\u0180-\u01c3\u01cd-\u01f0\u01f4-\u024f"
    r"\u2012-\u2027\u2030-\u2042\u2044-\u205e\u2070-\u20cf\u2150-\u215f\u2190-\u2bff\u3041-\u30ff\u4e00-\u9fff"
    r"\uac00-\ud7a3\x{1F000}-\x{1FAFF}]"
)


def _hidden_class() -> str:
    """Character class of what shows nothing: control and format characters, fillers, variation selectors."""
    chars = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) in ("Cc", "Cf") and chr(c) not in "\t\n\v\f\r\u0085"]
    chars = [c for c in chars if not re.match(f"[{_VISIBLE_FORMAT}]", c)]
    chars += [chr(c) for c in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0)]
    return "".join(map(re.escape, chars)) + "\ufe00-\ufe0f\U000e0100-\U000e01ef"


@lru_cache(maxsize=1)
def _patterns() -> dict[str, re.Pattern]:
    hidden = _hidden_class()
    return {
        "hidden": re.compile(f"[{hidden}]"),
        # emoji with selectors, skin tones, joiners and tags, and keycaps: kept as they are
        "emoji": re.compile(
            f"(?:[{_EMOJI}][\ufe0e\ufe0f\U0001f3fb-\U0001f3ff]*(?:[\U000e0020-\U000e007e]+\U000e007f)?)"
            f"(?:\u200d[{_EMOJI}][\ufe0e\ufe0f\U0001f3fb-\U0001f3ff]*)*|[0-9#*]\ufe0f?\u20e3"
        ),
        "space": re.compile(f"[{_SPACES}]"),
        "hyphen": re.compile(f"[{_HYPHENS}]"),
        "compat": re.compile(f"[{_COMPAT}]"),
        "font": re.compile(f"[{_FONT}]"),
        "word": re.compile("[^\\W\\d_](?:[^\\W\\d_]|[\u0300-\u036f])*"),
    }


def _letter(found: re.Match) -> str:
    """A letter or digit written as a letter-like or mathematical sign; other signs stay."""
    plain = unicodedata.normalize("NFKC", found[0])
    return plain if plain.isascii() and plain.isalnum() and unicodedata.decomposition(found[0]).startswith(("<font>", "004", "005", "006", "007")) else found[0]


class Letters(NamedTuple):
    """Letters beside the Latin one each looks like: ``whole`` in any word, ``near`` only beside Latin letters; and for
    each script the letter that a Latin one looks like."""

    whole: dict[str, str]
    near: dict[str, str]
    back: dict[str, dict[str, str]]


def script_of(c: str) -> str:
    """The script of a letter, by the first word of its name."""
    return unicodedata.name(c, "").split(" ")[0]


def _small_capital(c: str) -> str | None:
    found = re.fullmatch("LATIN LETTER SMALL CAPITAL ([A-Z])", unicodedata.name(c, ""))
    return found[1].lower() if found else None


def _phonetic(c: str) -> bool:
    return "\u0250" <= c <= "\u02af" or "\u1d00" <= c <= "\u1dbf" or _small_capital(c) is not None


#: Letters that a stranger in a word may stand for: those of the scripts' ordinary alphabets.
_ORDINARY = "[\u0370-\u03ff\u0400-\u045f\u0531-\u0586]"
#: Scripts with case, of which whole words may read as Latin; letters of others pass only beside Latin letters.
_CASED = ("GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE", "COPTIC", "DESERET", "OSAGE", "ELBASAN")


def letter_tables() -> Letters:
    """The look-alike letters by the skeletons of the Unicode library beside Spark, read once through the driver."""
    return _letter_tables(id(SparkContext._active_spark_context))


@lru_cache(maxsize=1)
def _letter_tables(_context: int) -> Letters:
    latin = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B))]
    letters = [chr(c) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lo")]
    letters = [c for c in letters if not unicodedata.decomposition(c) and script_of(c) not in ("CJK", "HANGUL", "HIRAGANA", "KATAKANA") and (script_of(c) != "LATIN" or _phonetic(c))]
    checker = SparkContext._active_spark_context._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    skeletons = checker.getSkeleton("\n".join([*latin, *letters])).split("\n")  # one call for all
    looks: dict[str, list[str]] = {}
    for c, skeleton in zip(latin, skeletons):
        looks.setdefault(skeleton, []).append(c)
    whole, near = {}, {}
    for c, skeleton in zip(letters, skeletons[len(latin) :]):
        # where an upper-case and a lower-case letter look the same, case decides
        plain = CORRECTED.get(c) or _small_capital(c) or _small_capital(skeleton) if len(skeleton) == 1 or c in CORRECTED else None
        if plain is None and (alike := looks.get(skeleton)):
            plain = next((a for a in alike if a.isupper() == c.isupper()), alike[-1])
        if plain is not None:
            only_near = c in BESIDE_LATIN or (script_of(c) not in _CASED and not (script_of(c) == "LATIN" and (_small_capital(c) or ord(c) in (0x251, 0x261))))
            (near if only_near else whole)[c] = plain
    back: dict[str, dict[str, str]] = {}
    for c, plain in sorted({**near, **whole}.items()):
        if re.match(_ORDINARY, c):
            back.setdefault(script_of(c), {}).setdefault(plain, c)
    return Letters(whole, near, back)


def _in_one_script(word: str, letters: Letters) -> str:
    """The word in Latin letters if all of its letters are Latin or look like Latin ones; in the script of its other letters
    if these are of one script and all the rest look like letters of that script; else as it is."""
    if word.isascii():
        return word
    parts = unicodedata.normalize("NFD", word)
    beside = any(c.isascii() and c.isalpha() for c in parts)
    own, out = set(), []
    for c in parts:
        if c in letters.whole or (beside and c in letters.near):
            out.append(letters.whole.get(c) or letters.near[c])
        elif c.isascii() or unicodedata.combining(c) or (script := script_of(c)) == "LATIN":
            out.append(c)
        else:
            own.add(script)
    if not own:
        return unicodedata.normalize("NFC", "".join(out))
    if len(own) > 1 or not (back := letters.back.get(script := own.pop())):
        return word
    out = []
    for c in parts:
        if script_of(c) == script or unicodedata.combining(c):
            out.append(c)
        elif (plain := letters.whole.get(c) or letters.near.get(c) or c) in back:
            out.append(back[plain])
        else:
            return word
    return unicodedata.normalize("NFC", "".join(out))


def _plain_piece(text: str, letters: Letters) -> str:
    p = _patterns()
    text = p["hidden"].sub("", text)
    text = p["space"].sub(" ", text)
    text = p["hyphen"].sub("-", text)
    text = p["compat"].sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    text = p["font"].sub(_letter, text)
    text = unicodedata.normalize("NFC", text)
    return p["word"].sub(lambda m: _in_one_script(m[0], letters), text)


def plain_form(text: str, letters: Letters | None = None) -> str:
    """``text`` with every character written as its plain look-alike; idempotent."""
    if text.isascii() and text.isprintable():
        return text
    letters = letters or letter_tables()
    out, at = [], 0
    for emoji in _patterns()["emoji"].finditer(text):
        out += _plain_piece(text[at : emoji.start()], letters), emoji[0]
        at = emoji.end()
    out.append(_plain_piece(text[at:], letters))
    # marks and letters may only meet once what stood between them is gone
    return unicodedata.normalize("NFC", "".join(out))


def plain_form_udf(text: Column) -> Column:
    """``plain_form`` of a column; the table of letters, of a fixed size, travels with the function."""
    letters = letter_tables()

    @F.pandas_udf(T.StringType())
    def run(texts):
        return texts.map(lambda t: plain_form(t, letters), na_action="ignore")

    return run(text)


def suspect(text: Column) -> Column:
    return text.rlike(SUSPECT)


def _keyed(values: DataFrame, form: str) -> DataFrame:
    """``values`` with the key of its class: the form under the collation (case- and accent-sensitive; canonical equivalents
    are equal). What that collation ignores but the eye sees, the joiners inside emoji, is a key of its own."""
    return values.withColumns({"_class": F.collate(F.col(form), "UNICODE"), "_joiners": F.regexp_replace(F.col(form), r"[^\u200d\ufe0e\ufe0f]", "")})


def canonical_values(values: DataFrame, plain: DataFrame | None = None, value: str = "value") -> DataFrame:
    """``value``, ``n`` (its rows, if ``values`` counts them) and ``canonical`` of every distinct suspect value; ``plain``
    (``value``) are the values that occur and need no look."""
    counted = values if "n" in values.columns else values.withColumn("n", F.lit(1).cast("bigint"))
    counted = counted.groupBy(value).agg(F.sum("n").alias("n"))
    mapped = written(counted.select(value, "n", plain_form_udf(F.col(value)).alias("_mapped")), "lookalike")
    keyed = _keyed(mapped, "_mapped")
    # the members of a class that a row may be written as: those that occur and are plain, then the mapped forms
    members = keyed.select("_class", "_joiners", (F.col("_mapped") != F.col(value)).alias("made"), F.col("_mapped").alias("text"))
    if plain is not None:
        occurring = _keyed(plain.select(F.col(value).alias("text")), "text").select("_class", "_joiners", F.lit(False).alias("made"), "text")
        members = members.unionByName(occurring)
    # the choice is an aggregate, joined back, and no list, so a class may have any number of members
    best = F.min(F.struct("made", F.char_length("text").alias("n"), "text"))
    classes = members.groupBy("_class", "_joiners").agg(best.alias("_best"))
    return keyed.join(classes, ["_class", "_joiners"]).select(value, "n", F.col("_best.text").alias("canonical"))


def _plain_values(df: DataFrame, text: str) -> DataFrame:
    """(value): the distinct values of ``df`` that need no look."""
    return df.select(F.explode(F.split(F.col(text), " ", -1)).alias("value")).where(~suspect(F.col("value"))).distinct()


def _spread(df: DataFrame, text: str) -> DataFrame:
    """Suspect rows as (_row: all columns, _rid, _at, value), one per stretch between ordinary spaces."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.monotonically_increasing_id().alias("_rid")).where(suspect(F.col(f"_row.`{text}`")))
    return rows.select("_row", "_rid", F.posexplode(F.split(F.col(f"_row.`{text}`"), " ", -1)).alias("_at", "value"))


def with_canonical(df: DataFrame, text: str = "text", out: str = "canonical") -> DataFrame:
    """All rows and columns of ``df`` and the canonical form of ``text`` as ``out`` (which replaces a column of that name)."""
    cols = [c for c in df.columns if c != out]
    parts = written(_spread(df, text), "parts")
    values = parts.where(suspect(F.col("value"))).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    canonical = written(canonical_values(values, _plain_values(df, text)), "canonical")
    plain = df.where(F.col(text).isNull() | ~suspect(F.col(text))).select(*[F.col(f"`{c}`") for c in cols], F.col(text).alias(out))
    fixed = split_join(parts, canonical, "value").groupBy("_rid").agg(
        F.first("_row").alias("_row"),
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("canonical", "value").alias("v")))), lambda x: x["v"])).alias("_text"),
    )
    return plain.unionByName(fixed.select(*[F.col(f"_row.`{c}`").alias(c) for c in cols], F.col("_text").alias(out)))


def rows_not_canonical(df: DataFrame, key: str = "ord", text: str = "text") -> DataFrame:
    """``key`` of each row whose text isn't in canonical form (one row per row of ``df``)."""
    parts = df.select(F.col(key), F.monotonically_increasing_id().alias("_rid"), F.col(text).alias("_text")).where(suspect(F.col("_text")))
    parts = parts.select(key, "_rid", F.explode(F.array_distinct(F.split("_text", " ", -1))).alias("value")).where(suspect(F.col("value")))
    tokens = written(parts, "tokens")
    values = tokens.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    canonical = canonical_values(values, _plain_values(df, text))
    wrong = written(canonical.where(~F.col("canonical").eqNullSafe(F.col("value"))).select("value", "n", F.lit(True).alias("wrong")), "wrong")
    return split_join(tokens, wrong, "value").where("wrong").groupBy("_rid").agg(F.first(key).alias(key)).select(key)
