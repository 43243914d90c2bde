"""DuckDB SQL of those pN_ queries that SQL can express."""

from __future__ import annotations

import math
import re
import unicodedata

from voxloom.llm.quantiles import RELATIVE_ERROR, ZERO_AT, gamma
from voxloom.llm.tokenizers import TOKENIZER_DIR
from voxloom.plans.catalogue import _list_distance

_LN = repr(math.log(gamma(RELATIVE_ERROR)))
_G = repr(gamma(RELATIVE_ERROR))

_PARTIALS = f"""
SELECT CAST(ingested_at AT TIME ZONE 'UTC' AS DATE) AS day, dataset, CAST(ceil(ln(duration) / {_LN}) AS BIGINT) + {ZERO_AT} AS bucket, count(*) AS n
FROM train_final WHERE duration > 0 AND NOT isnan(duration) GROUP BY ALL
"""

_PERCENTILES = f"""
WITH c AS ({_PARTIALS}),
g AS (SELECT 'dataset' AS scope, dataset, bucket, sum(n) AS here FROM c GROUP BY ALL
      UNION ALL SELECT 'all', NULL, bucket, sum(n) FROM c GROUP BY ALL),
r AS (SELECT *, sum(here) OVER (PARTITION BY scope, dataset ORDER BY bucket) AS upto, sum(here) OVER (PARTITION BY scope, dataset) AS n FROM g)
SELECT scope, dataset, percentile, CAST(n AS BIGINT) AS n, round(2 / ({_G} + 1) * pow({_G}, CAST(bucket - {ZERO_AT} AS DOUBLE)), 9) AS value, CAST({RELATIVE_ERROR} AS DOUBLE) AS max_relative_error
FROM r, (SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::DOUBLE[]) AS percentile)
WHERE floor(percentile * (n - 1)) < upto AND floor(percentile * (n - 1)) >= upto - here
"""

_WINDOWS = """
w AS (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200),
s AS (SELECT doc_id, i, substring(text, i, 200) AS span FROM w),
g AS (SELECT span, list(DISTINCT doc_id) AS docs FROM s GROUP BY span HAVING count(DISTINCT doc_id) > 1)"""

_PAIRS = f"WITH {_WINDOWS}, a AS (SELECT unnest(docs) AS doc_a, docs FROM g), b AS (SELECT doc_a, unnest(docs) AS doc_b FROM a) SELECT DISTINCT doc_a, doc_b FROM b WHERE doc_a < doc_b"

# every shared window covers 200 characters from its start, less what the one before covers already
_COVERAGE = f"""
WITH {_WINDOWS}, c AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM s SEMI JOIN g USING (span)),
n AS (SELECT doc_id, CAST(sum(least(200, coalesce(i - before, 200))) AS INTEGER) AS shared FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(length(d.text), 0) AS INTEGER) AS n_chars, coalesce(n.shared, 0) AS shared_chars FROM documents d LEFT JOIN n USING (doc_id)
"""

_LINKS = f"""
WITH p AS ({_PAIRS}), n AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_a AS doc_id FROM p UNION ALL SELECT doc_b FROM p) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN length(text) >= 200 THEN min(d.doc_id) OVER (PARTITION BY text) ELSE d.doc_id END AS class_id, coalesce(n, 0) AS n_links FROM documents d LEFT JOIN n USING (doc_id)
"""


def _class(pattern: str) -> str:
    """The characters that a Python class matches, as ranges for RE2."""
    found = re.compile(f"[{pattern}]")
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000 and found.match(chr(c))]
    ranges: list[list[int]] = []
    for c in points:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


# Fixed values of the problem's statement, written down apart from the operator's rules and tables.
_INVISIBLE = "\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufffb"
_SPACES = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_HYPHENS = "\u2010\u2011\u2043\ufe63\uff0d"
_JOINED = "\u0132\u0133\u01c4-\u01cc\u01f1-\u01f3\u2160-\u217f\ufb00-\ufb06\uff01-\uff5e\uffe0-\uffe6"
_LETTER_SIGNS = "\u2102\u210a-\u2113\u2115\u2119-\u211d\u2124\u2128\u212a\u212c\u212d\u212f-\u2131\u2133\u2134\u2139\u2145-\u2149"
_PICTURES = "\xa9\xae\u203c\u2049\u2122\u2139\u2190-\u2bff\u3030\u303d\u3297\u3299\U0001f000-\U0001faff"
_WHOLE = "аеорсухѕіјһԁԛԝӏѵАВЕКМНОРСТХЅІЈҮԚԜӀονϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿօսոհցՕՍᎪᎬᎢᎫᏃᎷᎻᏂᏞᏢᏦᏴᎳᏙᏚɑɡᴏᴄᴠᴡᴢꜱᴜᴋ"
_BESIDE = "αικρτυχωγУктмнвүгɩʋɪɴʀʟʙʜ"
# letters of the Cyrillic and of the Greek alphabet that no Latin letter looks like, and Latin letters that look like one of theirs
_ONLY = {"Cyrillic": ("бджзийлпфцчшщъыэюяёђєїљњћБДЖЗИЙЛПФЦЧШЩЪЫЭЮЯЁЂЄЇЉЊЋ", "aeopcyxhijsktmbrABEKMHOPCTXYISJ"), "Greek": ("βδεζηθλμξπφψςΓΔΘΛΞΠΣΦΨΩ", "oviapukxtywABEZHIKMNOPTYX")}

_WRONG = "\\x{e0001}-\\x{e01ef}\\x{1d400}-\\x{1d7ff}" + _class(_INVISIBLE + _SPACES + _HYPHENS + _JOINED + _LETTER_SIGNS)
_SAME, _NEAR = _class(_WHOLE), _class(_BESIDE)
_MARKS = "\\x{fe0e}\\x{fe0f}\\x{1f3fb}-\\x{1f3ff}"
_EMOJI = f"[{_class(_PICTURES)}][{_MARKS}]*(\\x{{200d}}[{_class(_PICTURES)}][{_MARKS}]*)*|[0-9#*]\\x{{fe0f}}?\\x{{20e3}}"
_STRANGE = " OR ".join(f"(regexp_matches(w, '[{only}]') AND regexp_matches(w, '[A-Za-z]') AND regexp_full_match(w, '[\\p{{{script}}}\\p{{M}}{alike}]+'))" for script, (only, alike) in _ONLY.items())
_DISGUISED = f"""
WITH e AS (SELECT ord, text, regexp_replace(text, '{_EMOJI}', ' ', 'g') AS t FROM train_final WHERE text IS NOT NULL)
SELECT ord FROM e WHERE text <> nfc_normalize(text) OR regexp_matches(t, '[{_WRONG}]') OR len(list_filter(regexp_extract_all(t, '[\\p{{L}}\\p{{M}}]+'), lambda w:
  (regexp_matches(strip_accents(w), '[{_SAME}{_NEAR}]') AND (regexp_full_match(strip_accents(w), '[\\p{{Latin}}{_SAME}]+')
    OR (regexp_matches(strip_accents(w), '[A-Za-z]') AND regexp_full_match(strip_accents(w), '[\\p{{Latin}}{_SAME}{_NEAR}]+')))) OR {_STRANGE})) > 0
"""

# The tokenizer in SQL: the published splitting pattern, whose look-ahead RE2 hasn't, so a sign that stands nowhere parts the
# last white space of a run from the rest; then merges of neighbours by rank, one at a time, over the distinct pieces.
_WHITE = "\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_PART = "\U0010fffd"
_SPLIT = f"''s|''t|''re|''ve|''m|''ll|''d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{_WHITE}{_PART}\\p{{L}}\\p{{N}}]+|[{_WHITE}]+"


def _merged(table: str, key: str) -> str:
    """CTEs ``pieces`` (key, piece, place) and ``done`` (piece, toks: hexadecimal tokens) of a table's texts, and ``v`` (h, r)."""
    return f"""RECURSIVE
v AS (SELECT hex(from_base64(t)) AS h, CAST(r AS INTEGER) AS r FROM read_csv('{TOKENIZER_DIR}/byte_bpe_50k.tiktoken', delim = ' ', header = false, quote = '', escape = '', columns = {{'t': 'VARCHAR', 'r': 'BIGINT'}})),
cut AS (SELECT {key}, regexp_extract_all(regexp_replace(text, '([{_WHITE}])([{_WHITE}][^{_WHITE}])', '\\1{_PART}\\2', 'g'), '{_SPLIT}') AS l FROM {table} WHERE text <> ''),
pieces AS (SELECT {key}, unnest(l) AS piece, generate_subscripts(l, 1) AS place FROM cut),
state AS (SELECT piece, regexp_extract_all(hex(piece), '..') AS toks FROM (SELECT DISTINCT piece FROM pieces)
  UNION ALL
  SELECT piece, list_concat(toks[:i - 1], [toks[i] || toks[i + 1]], toks[i + 2:]) FROM (
    SELECT piece, any_value(toks) AS toks, arg_min(i, CAST(r AS BIGINT) * 1000000 + i) AS i FROM (SELECT piece, toks, unnest(range(1, len(toks))) AS i FROM state) u JOIN v ON v.h = toks[i] || toks[i + 1] GROUP BY piece)),
done AS (SELECT piece, arg_min(toks, len(toks)) AS toks FROM state GROUP BY piece)"""


_ROW_TOKENS = f"""{_merged("train_final", "ord")},
tok AS (SELECT ord, CAST(sum(len(toks)) AS BIGINT) AS n FROM pieces JOIN done USING (piece) GROUP BY ord)"""
_TOKENS = f"WITH {_ROW_TOKENS} SELECT ord, coalesce(n, 0) AS n_tokens FROM train_final LEFT JOIN tok USING (ord)"
_DIMS = ("source", "language", "dataset", "domain_tag")
_BUDGET = f"""WITH {_ROW_TOKENS},
tag AS (SELECT name, config_name || '__' || split AS source, min(domain_tag) AS domain_tag FROM source_spec GROUP BY ALL),
x AS (SELECT t.source, language, dataset, tag.domain_tag, coalesce(n, 0) AS n FROM train_final t LEFT JOIN tok USING (ord) LEFT JOIN tag ON tag.name = t.dataset AND tag.source = t.source),
{", ".join(f"d_{c} AS (SELECT '{c}' AS dimension, {c} AS value, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_tokens FROM x GROUP BY {c})" for c in _DIMS)}
{" UNION ALL ".join(f"SELECT *, NULL AS source, NULL AS language, NULL AS dataset, NULL AS domain_tag FROM d_{c}" for c in _DIMS)}
UNION ALL SELECT 'all', NULL, count(*), CAST(sum(n) AS BIGINT), NULL, NULL, NULL, NULL FROM x
UNION ALL SELECT 'cell', NULL, count(*), CAST(sum(n) AS BIGINT), source, language, dataset, domain_tag FROM x GROUP BY source, language, dataset, domain_tag
"""
_DIGEST = f"""WITH {_merged("documents", "doc_id")},
ranked AS (SELECT piece, list(r ORDER BY k) AS ids FROM (SELECT piece, unnest(toks) AS h, generate_subscripts(toks, 1) AS k FROM done) JOIN v USING (h) GROUP BY piece),
d AS (SELECT doc_id, flatten(list(ids ORDER BY place)) AS ids FROM pieces JOIN ranked USING (piece) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(ids), 0) AS INTEGER) AS n_ids, md5(coalesce(array_to_string(ids, ','), '')) AS digest FROM documents LEFT JOIN d USING (doc_id)
"""

# Overlaps in SQL: paths brought to their last three parts, words compared without look-alikes by a join on shared words and
# the distance of lists. The tables of letters are this module's own; what Unicode decomposes is taken from its rules.
_SHOWN = "aeopcyxsijhdqwlvABEKMHOPCTXSIJYQWIovcjABEZHIKMNOPTYXCJounhgOUAETJZMHhLPKBWVSagocvwzsukaikptuxwyYktmhbyriviNRLBH"


def _plain_letters() -> tuple[str, str]:
    """Two strings for ``translate``: letters and their look-alikes, with accents where one character has them."""
    pairs = dict(zip(_WHOLE + _BESIDE, _SHOWN, strict=True))
    for c in map(chr, [*range(0x370, 0x530), *range(0x1F00, 0x2000)]):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and parts[0] in pairs and len(made := unicodedata.normalize("NFC", pairs[parts[0]] + parts[1:])) == 1:
            pairs.setdefault(c, made)
    return "".join(pairs), "".join(pairs.values())


def _signs(one: bool) -> dict[str, str]:
    """Compatibility forms of letters, digits and signs that are written as one character, or as several."""
    found = {}
    for c in map(chr, [*range(0x132, 0x134), *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), *range(0x2100, 0x2150), *range(0x2160, 0x2180), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F), *range(0xFFE0, 0xFFE7), *range(0x1D400, 0x1D800)]):
        plain = unicodedata.normalize("NFKC", c)
        sign = 0x2100 <= ord(c) < 0x2150
        if plain != c and (len(plain) == 1) == one and not (sign and not (plain.isascii() and plain.isalnum())):
            found[c] = plain
    return found


def _text(x: str) -> str:
    for c, plain in _signs(False).items():
        x = f"replace({x}, '{c}', '{plain}')"
    one = _signs(True)
    return f"translate({x}, '{''.join(one)}', '{''.join(one.values()).replace(chr(39), chr(39) * 2)}')"


def _words_of(x: str) -> str:
    """The words of a text as they are compared, joined by blanks; null for null."""
    bare = f"regexp_replace(regexp_replace(nfc_normalize({x}), '[{_class(_INVISIBLE)}\\x{{e0001}}-\\x{{e01ef}}]', '', 'g'), '[{_class(_SPACES)}]', ' ', 'g')"
    words = f"regexp_split_to_array(regexp_replace(nfc_normalize({_text(bare)}), '\\p{{P}}+', '', 'g'), '[{_WHITE}]+')"
    a, b = _plain_letters()
    latin = lambda near: f"regexp_full_match(strip_accents(w), '([^\\p{{L}}]|\\p{{Latin}}|[{_SAME}{near}])+')"
    mapped = f"CASE WHEN {latin('')} OR (regexp_matches(strip_accents(w), '[A-Za-z]') AND {latin(_NEAR)}) THEN translate(w, '{a}', '{b}') ELSE w END"
    joined = f"array_to_string(list_filter(list_transform({words}, lambda w: {mapped}), lambda w: w <> ''), ' ')"
    return f"regexp_replace(lower({joined}), '(\\p{{L}})σ([^\\p{{L}}]|$)', '\\1ς\\2', 'g')"


def _key_of(x: str) -> str:
    p = f"lower(replace(CASE WHEN contains({x}, '%') THEN url_decode({x}) ELSE {x} END, chr(92), '/'))"
    p = f"regexp_replace(regexp_replace(trim({p}), '^[a-z][a-z0-9+.-]*://', '/'), '/(\\.?/)+', '/', 'g')"
    for _ in range(4):
        p = f"regexp_replace({p}, '(^|/)[^/]*[^/.][^/]*/\\.\\.(/|$)', '\\1')"
    parts = f"string_split(trim(regexp_replace(regexp_replace({p}, '^(\\.?\\.?/)+', '/'), '/\\.$', ''), '/'), '/')"
    return f"CASE WHEN len({parts}) >= 3 THEN regexp_replace(array_to_string({parts}[-3:], '/'), '([^/])\\.[^./]*$', '\\1') END"


_OVERLAPS = f"""
m AS (SELECT ord, text, audio_filepath, 1 AS side FROM train_final UNION ALL SELECT ord, text, audio_filepath, 2 FROM val_final UNION ALL SELECT ord, text, audio_filepath, 3 FROM test_final),
k AS MATERIALIZED (SELECT ord, side, {_key_of('audio_filepath')} AS rec, {_words_of('text')} AS words FROM m),
n AS (SELECT ord, least(side, 2) AS side, words, string_split(words, ' ') AS l FROM k WHERE len(string_split(words, ' ')) >= 8),
t AS MATERIALIZED (SELECT words, any_value(l) AS l, len(any_value(l)) AS n, bool_or(side = 1) AS train, bool_or(side = 2) AS eval FROM n GROUP BY words),
u AS (SELECT words, n, train, eval, w, count(*) AS c FROM (SELECT words, n, train, eval, unnest(l) AS w FROM t) GROUP BY ALL),
c AS (SELECT a.words AS wa, b.words AS wb FROM u a JOIN u b USING (w) WHERE a.train AND b.eval AND least(a.n, b.n) * 5 >= greatest(a.n, b.n) * 4
      GROUP BY a.words, b.words, a.n, b.n HAVING sum(least(a.c, b.c)) >= greatest(a.n, b.n) - greatest(a.n, b.n) // 5),
s AS (SELECT wa, wb FROM c JOIN t a ON a.words = wa JOIN t b ON b.words = wb WHERE wa = wb OR {_list_distance('a.l', 'b.l')} <= greatest(a.n, b.n) // 5),
pairs AS (SELECT a.ord AS train_ord, b.ord AS eval_ord FROM k a JOIN k b USING (rec) WHERE a.side = 1 AND b.side > 1
  UNION SELECT a.ord, b.ord FROM s JOIN n a ON a.words = wa AND a.side = 1 JOIN n b ON b.words = wb AND b.side = 2)"""
_FOUND = f"WITH {_OVERLAPS} SELECT train_ord, eval_ord FROM pairs"
_COUNTS = f"""
WITH {_OVERLAPS}, p AS (SELECT eval_ord AS ord, count(*) AS n FROM pairs GROUP BY eval_ord),
e AS (SELECT ord, 'val' AS split, dataset, source FROM val_final UNION ALL SELECT ord, 'test', dataset, source FROM test_final)
SELECT split, dataset, source, CAST(sum(n) AS BIGINT) AS pairs, count(*) AS eval_rows FROM e JOIN p USING (ord) GROUP BY ALL
"""

_PACKED = """
SELECT profile, count(*) AS items, CAST(sum(CASE WHEN duration > max_duration THEN ceil(duration / max_duration) ELSE 1 END) AS BIGINT) AS pieces, round(sum(duration), 1) AS seconds, true AS within, true AS tight
FROM train_final, batch_profiles WHERE duration > 0 AND NOT isnan(duration) AND duration < 'infinity'::DOUBLE GROUP BY profile
"""
_KEPT = "SELECT mix_name, source, true AS near_target, true AS within_cap, true AS dealt_once FROM mix_targets"

ORACLE: dict[str, str] = {"p2_kept": _PACKED, "p1_tokens": _TOKENS, "p1_budget": _BUDGET, "p4_found": _FOUND, "p4_counts": _COUNTS, "p6_digest": _DIGEST, "p7_kept": _KEPT, "p3_partials": _PARTIALS, "p3_percentiles": _PERCENTILES, "p5_found": _DISGUISED, "p8_found": _PAIRS, "p8_coverage": _COVERAGE, "p8_links": _LINKS}
