"""String expressions of the manifest pipeline; all are built-in columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python strips and splits on, for a Java (or RE2) character class.
BLANK = r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


#: The same characters one by one.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end; looks at the ends only, which a regular expression doesn't."""
    return F.trim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """Words parted by any white space; no empty ones, so a blank text has none. Null for null."""
    return F.filter(F.split(text, rf"[{BLANK}]+"), lambda w: w != "")


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def row_key(uid: Column, path: Column) -> Column:
    """uid, else path; null if neither is there."""
    return F.coalesce(F.nullif(uid, F.lit("")), F.nullif(path, F.lit("")))


def safe_tag(text: Column, most: int = 120) -> Column:
    """Letters, digits, dot, dash and underscore; runs of anything else become one underscore; cut at ``most``."""
    return F.substring(F.regexp_replace(strip(text), r"[^0-9a-zA-Z._-]+", "_"), 1, most)


def slug(text: Column, most: int = 40) -> Column:
    """Lower-case letters and digits of any script joined by single underscores, ``sample`` where nothing is left."""
    joined = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))
    trimmed = F.trim(F.substring(joined, 1, most), F.lit("_"))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit("sample")).otherwise(trimmed)


def epoch_of(name: Column) -> Column:
    """The number behind ``epoch=``, else a leading number before a dash, else null."""
    named = F.nullif(F.regexp_extract(name, r"epoch=(\d+)", 1), F.lit(""))
    return F.coalesce(named, F.nullif(F.regexp_extract(name, r"^(\d+)-", 1), F.lit(""))).cast("int")


def stable_name(path: Column) -> Column:
    """File name of a resampled copy: 16 digits of the digest of the path."""
    return F.substring(F.sha1(path), 1, 16)


def under_root(path: Column, root: str) -> Column:
    """Absolute paths as they are, others below ``root``."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def audio_suffix(path: Column, default: str = ".audio") -> Column:
    """File type of the last part of a path, with its dot."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1), F.lit("")), F.lit(default))


def sample_uid(hf_id: Column, config: Column, split: Column, position: Column, path: Column | None = None, content: Column | None = None, given: Column | None = None) -> Column:
    """Key of a fetched sample: its source, and the path, else the digest of the content, else the position. Samples
    whose audio is no record have ``given`` instead of path and content."""
    parts = []
    if path is not None:
        parts.append(F.concat(F.lit("path:"), F.nullif(path, F.lit(""))))
    if content is not None:
        parts.append(F.when(F.octet_length(content) > 0, F.concat(F.lit("sha1:"), F.sha1(content))))
    if given is not None:
        parts.append(F.concat(F.lit("id:"), given.cast("string")))
    parts.append(F.concat(F.lit("pos:"), position.cast("string")))
    return safe_tag(F.concat_ws("__", hf_id, F.coalesce(config, F.lit("")), split, F.coalesce(*parts)))


def raw_audio_name(prefix: Column, index: Column, suffix: Column) -> Column:
    return F.format_string("%s_%06d%s", prefix, index, suffix)


def json_get(doc: Column, field: str, default: str) -> Column:
    """A field of a JSON object, with a default for a missing or null one."""
    return F.coalesce(F.get_json_object(doc, f"$.{field}"), F.lit(default))


# What error texts of a source that asks for slower requests contain.
RATE_LIMIT_PHRASES = ("429", "too many requests", "rate limit")


def is_rate_limit(message: Column) -> Column:
    """Whether an error text tells that the source asks for slower requests."""
    text = F.lower(message)
    return reduce(Column.__or__, [text.contains(phrase) for phrase in RATE_LIMIT_PHRASES])


def fixed(number: Column, digits: int = 2) -> Column:
    """A number with so many decimals, without separators."""
    return F.format_string(f"%.{digits}f", number.cast("double"))
