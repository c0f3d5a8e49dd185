"""Scalar text expressions. All are Catalyst built-ins."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeweave.constants import WHITESPACE


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace, Unicode spaces included."""
    return F.trim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.length(strip(text)) == 0


def slugify(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit(" "), F.lit("_"))


def model_slug(name: Column) -> Column:
    return F.translate(name, "/-", "__")


def or_default(value: Column, default: Column | str) -> Column:
    """The value unless it is null or empty."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(value, F.lit("")), fallback)


def padded_id(pattern: str, *parts: Column) -> Column:
    """``format_string`` keeps numbers wider than the padding whole; ``lpad`` would cut them."""
    return F.format_string(pattern, *parts)


def filled(template: str, **parts: Column) -> Column:
    """A text with ``{name}`` places taken by columns; what a column holds is never read as a place."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[parts[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def preview(text: Column, length: int = 200) -> Column:
    return F.translate(F.substring(text, 1, length), "\n", " ")


def mask_key(key: Column) -> Column:
    return F.when(F.length(key) > 4, F.concat(F.lit("..."), F.right(key, F.lit(4)))).otherwise("***")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def token_estimate(text: Column) -> Column:
    """Four characters to a token, rounded up; the stand-in for a byte-pair vocabulary."""
    return F.ceil(F.length(text) / 4).cast("bigint")


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits: the analyser of the full-text leg."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def content_hash(text: Column) -> Column:
    return F.md5(text)


def lines(text: Column, separator: str = "\n") -> Column:
    """Stripped, non-empty parts of a text."""
    return F.filter(F.transform(F.split(text, separator), strip), lambda p: F.length(p) > 0)


_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"),
]


def html_to_text(html: Column) -> Column:
    """Visible text of a page, joined by single spaces; comments, scripts and styles are dropped."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?is)<script[^>]*>.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in _ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))
