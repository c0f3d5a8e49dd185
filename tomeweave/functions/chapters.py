"""Chapter header detection as prioritised Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeweave.constants import (
    NOT_A_TITLE,
    NUMBERED_HEADERS,
    PLAIN_HEADER,
    POV_HEADERS,
    POV_NAMES,
    UNKNOWN,
    WORDED_HEADERS,
)
from tomeweave.functions.text import strip

# d: only "\n" ends a line, U: \s and \d are Unicode-aware, i: no case.
_FLAGS = "(?diU)"
_MULTILINE = "(?dimU)"
_NOT_A_TITLE = _FLAGS + "^(?:" + "|".join(NOT_A_TITLE) + ")"


def is_false_title(title: Column) -> Column:
    return strip(title).rlike(_NOT_A_TITLE)


def is_pov_name(name: Column) -> Column:
    return F.upper(strip(name)).isin(POV_NAMES)


def _chapter(number: Column | str, title: Column | str) -> Column:
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(as_column(number).alias("number"), as_column(title).alias("title"))


def _group(text: Column, pattern: str, index: int, flags: str = _FLAGS) -> Column:
    return F.regexp_extract(text, flags + pattern, index)


def _numbered(text: Column, pattern: str) -> Column:
    """One pattern of the numbered layout; null lets the next pattern try."""
    captures = pattern.replace("(?:", "").count("(")
    if captures == 2:
        first, second = (strip(_group(text, pattern, i)) for i in (1, 2))
        special = F.upper(first).isin("PROLOGUE", "EPILOGUE")
        found = (_group(text, pattern, 1) != "") & ~is_false_title(second)
        return F.when(found, _chapter(F.when(special, F.upper(first)).otherwise(first), second))
    if captures == 1:
        value = strip(_group(text, pattern, 1))
        found = _group(text, pattern, 1) != ""
        return (
            F.when(found & value.rlike(r"(?U)^\d+$"), _chapter(value, UNKNOWN))
            .when(found & F.upper(value).isin("PROLOGUE", "EPILOGUE"), _chapter(F.upper(value), UNKNOWN))
            .when(found & ~is_false_title(value), _chapter(UNKNOWN, value))
        )
    marker = F.upper(_group(text, pattern, 0))
    return F.when(marker.contains("PROLOGUE"), _chapter("PROLOGUE", UNKNOWN)).when(
        marker.contains("EPILOGUE"), _chapter("EPILOGUE", UNKNOWN)
    )


def numbered_chapter(text: Column) -> Column:
    tried = F.coalesce(*[_numbered(text, p) for p in NUMBERED_HEADERS])
    # Most chunks hold no header at all: one cheap test spares them ten searches.
    return F.when(text.rlike(_FLAGS + "CHAPTER|PROLOGUE|EPILOGUE"), tried)


def worded_chapter(text: Column) -> Column:
    titled, bare = WORDED_HEADERS
    title = strip(_group(text, titled, 2))
    number = _group(text, titled, 1)
    lone = _group(text, bare, 1)
    return F.when((number != "") & ~is_false_title(title), _chapter(number, title)).when(
        lone != "", _chapter(lone, UNKNOWN)
    )


def pov_chapter(text: Column) -> Column:
    names = [F.upper(strip(_group(text, p, 1, _MULTILINE))) for p in POV_HEADERS]
    return F.coalesce(*[F.when(is_pov_name(n), _chapter("POV", n)) for n in names])


def plain_chapter(text: Column) -> Column:
    number = _group(text, PLAIN_HEADER, 1)
    return F.when(number != "", _chapter(number, UNKNOWN))


DETECTORS: dict[str, Callable[[Column], Column]] = {
    "wheel of time": numbered_chapter,
    "song of ice and fire": pov_chapter,
    "harry potter": worded_chapter,
}


def detect_chapter(text: Column, universe: str) -> Column:
    """struct(number, title) of a chunk's header, or null when it has none."""
    return DETECTORS.get(universe.lower(), plain_chapter)(text)
