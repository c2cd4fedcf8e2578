"""Column functions over texts and lines, all of them inside the JVM but for NFKC."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ravelin.functions.payloads import BASE64, ESCAPES, FROM_HEX, HEX_BLOCK, HEX_ESCAPES, INVISIBLE, MAX_DECODED, MIN_LENGTH, PERCENT, SPACES


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unix(text: Column | str) -> Column:
    """Line ends as \\n."""
    return F.regexp_replace(_c(text), "\r\n?", "\n")


def lines(text: Column | str) -> Column:
    """Lines by \\n, the empty last one too."""
    return F.split(unix(text), "\n", -1)


def all_lines(text: Column | str) -> Column:
    """Lines by every sign that ends one, without an empty last one."""
    parts = F.split(_c(text), "\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def visible(text: Column | str) -> Column:
    return F.translate(_c(text), INVISIBLE, "")


def plain_spaces(text: Column | str) -> Column:
    return F.regexp_replace(F.translate(_c(text), SPACES, " " * len(SPACES)), " {2,}", " ")


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def normalized(text: Column | str) -> Column:
    """NFKC, then no invisible signs and plain blanks; Python sees only texts that aren't ASCII."""
    wide = F.when(_c(text).rlike("[^\\x00-\\x7F]"), _c(text))
    return plain_spaces(visible(F.coalesce(_nfkc(wide), _c(text))))


def noqa_ids(line: Column | str) -> Column:
    """Upper-case ids of a noqa comment outside of string literals; null where there is none."""
    bare = F.regexp_replace(_c(line), r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'""", "")
    ids = F.regexp_extract(bare, r"(?i)#\s*noqa:\s*([\w-]+(?:\s*,\s*[\w-]+)*)", 1)
    return F.when(ids != "", F.transform(F.split(ids, ","), lambda x: F.upper(F.trim(F.regexp_replace(x, r"\s", "")))))


KINDS = (("base64", BASE64, (1, 2)), ("hex", FROM_HEX, (1,)), ("hex", HEX_ESCAPES, (1,)), ("hex", HEX_BLOCK, (1,)), ("url", PERCENT, (1,)), ("unicode_escape", ESCAPES, (1,)))


def encoded(line: Column | str) -> Column:
    """array<struct<kind, encoded>> of a line. Images in data URIs aren't payloads. A line without a run that could be one meets one regular expression."""
    found = []
    for kind, pattern, groups in KINDS:
        texts = F.regexp_extract_all(_c(line), F.lit(pattern), F.lit(groups[0]))
        if len(groups) == 2:
            texts = F.zip_with(texts, F.regexp_extract_all(_c(line), F.lit(pattern), F.lit(groups[1])), lambda a, b: F.when(a != "", a).otherwise(b))
        if kind == "hex":
            texts = F.transform(texts, lambda t: F.replace(t, F.lit("\\x"), F.lit("")))
            texts = F.filter(texts, lambda t: F.length(F.replace(t, F.lit(" "), F.lit(""))) >= MIN_LENGTH)
        if kind == "base64":
            # what stands before a match: the line, split at the matches
            before = F.when(_c(line).rlike(IMAGE), F.split(_c(line), pattern, -1))
            texts = F.filter(texts, lambda t, i: (F.length(t) >= MIN_LENGTH) & ~F.coalesce(F.get(before, i).rlike(IMAGE + "$"), F.lit(False)))
        found.append(_named(kind, texts))
    none = F.expr("cast(array() AS array<struct<kind: string, encoded: string>>)")
    return F.when(_c(line).rlike(r"[0-9A-Za-z+/]{17}|[0-9A-Fa-f]{2}\s[0-9A-Fa-f]{2}|%[0-9A-Fa-f]{2}%|\\[uUx][0-9A-Fa-f]{2}"), F.concat(*found)).otherwise(none)


IMAGE = "(?i)data:image/[^;]*;base64,"


def _named(kind: str, texts: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("encoded")))


def decoded(kind: Column | str, text: Column | str) -> Column:
    """What was encoded; null where it isn't UTF-8, is longer than MAX_DECODED bytes or names no sign."""
    t = _c(text)
    bare = F.regexp_replace(t, "=+$", "")
    padded = F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), "=")
    short = lambda share: F.floor(F.length(t) * share) <= MAX_DECODED
    valid = lambda b: F.when(F.is_valid_utf8(b.cast("string")) & (F.octet_length(b) <= MAX_DECODED), b.cast("string"))
    units = F.regexp_extract_all(t, F.lit(r"\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})"), F.lit(0))
    points = F.transform(units, lambda u: F.conv(F.substring(u, 3, 8), 16, 10).cast("bigint"))
    sign = lambda p: F.when((p >= 0xD800) & (p <= 0xDFFF), "").otherwise(F.decode(F.unhex(F.lpad(F.hex(p), 8, "0")), "UTF-32"))
    return (
        F.when(_c(kind) == "base64", F.when(short(0.75), valid(F.try_to_binary(padded, F.lit("base64")))))
        .when(_c(kind) == "hex", F.when(short(0.5), valid(F.unhex(F.regexp_replace(t, r"\s", "")))))
        .when(_c(kind) == "url", F.replace(F.try_url_decode(t), F.lit("\0"), F.lit("")))
        .when(F.forall(points, lambda p: p <= 0x10FFFF), F.array_join(F.transform(points, sign), ""))
    )
