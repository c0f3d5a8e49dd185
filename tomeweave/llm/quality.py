"""Document quality by base counts and by divergence from a language's reference.

A document's histogram of character classes and its histogram of common words
are compared with those of its language by Jensen-Shannon distance (base 2, so
from 0 to 1). The references are taken from all documents. Short documents,
whose histograms say little, are judged by the base rules alone. How far a text
may be from the common words is a share of the distance that a text without any
of them has, so the test fires for every coverage the common words reach.
DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeweave.scale import once
from tomeweave.session import cut_lineage

SPACE = " \t\n\x0b\x0c\r"
SPLIT = "[\\x20\\x09-\\x0D]+"
WINDOW = 8
#: Classes by what is not in them. Bytes beyond one a character are a class too, and what is in none is the rest.
CLASSES = {"symbol": "[^#*$%&|<>]+", "upper": "[^A-Z]+", "digit": "[^0-9]+"}
CLASS_NAMES = (*CLASSES, "beyond_ascii", "rest")


@dataclass(frozen=True)
class Limits:
    min_words: int = 20
    max_repeat_percent: int = 30
    common_words: int = 16  # per language
    common_length: int = 4  # characters of a common word at most: such words are short
    languages: int = 256  # with a reference of their own, most documents first; others use that of all documents
    min_chars: int = 200  # for the character histogram
    min_words_compared: int = 60  # for the word histogram
    max_char_distance: float = 0.31
    max_word_distance: float = 0.42
    # Of the distance of a text without common words; None leaves the fixed limit alone, which no such text reaches.
    max_word_share: float | None = 0.6
    word_deviations: float = 4.5  # standard deviations by which a sample of a text's length may be farther
    full_word_share: float = 0.95  # beyond this share a text has next to no common words and goes at any length
    min_common_expected: float = 8.0  # common words a text of its length should have for the share to be asked for


@dataclass(frozen=True)
class Reference:
    chars: dict[str, list[float]] = field(default_factory=dict)
    words: dict[str, list[tuple[str, float]]] = field(default_factory=dict)


ALL = ""  # key of the reference over all documents


def _text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))


def _class_counts(text: Column, symbols: Column | None = None) -> Column:
    """Counts by ``CLASS_NAMES``, as an array."""
    each = [F.char_length(F.regexp_replace(text, keep, "")) for keep in CLASSES.values()]
    if symbols is not None:
        each[0] = symbols
    each.append(F.octet_length(text) - F.char_length(text))
    inside = each[0] + each[1] + each[2] + each[3]
    return F.array(*each, F.greatest(F.lit(0), F.char_length(text) - inside)).cast("array<bigint>")


def _pairs(array: str, step: int) -> Column:
    """Hashes of each item with the one ``step`` later."""
    n = F.greatest(F.lit(0), F.size(array) - step)
    return F.zip_with(F.slice(array, F.lit(1), n), F.slice(array, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def base_counts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, ``_t`` (the text), ``_w`` (its words) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Windows are compared by 64-bit hashes, made of those of half their words. Texts
    in which no two half windows agree need no windows, and only texts in which
    two windows agree are sorted to find which.
    """
    step = docs.select(*keep, _text(text_col).alias("_t"))
    step = step.select("*", _words(F.col("_t")).alias("_w"))
    has_word = lambda line: F.btrim(line, F.lit(SPACE)) != ""
    counts = [*keep, "_t", "_w", "n_words", "word_chars", "n_symbols"]
    step = step.select(
        *keep, "_t", "_w",
        F.size("_w").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        F.char_length(F.regexp_replace("_t", CLASSES["symbol"], "")).cast("bigint").alias("n_symbols"),
        F.filter(F.split("_t", "\n"), has_word).alias("_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    counts.append("n_dup_lines")
    step = step.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"))
    step = step.select(*counts, _pairs("_h", 1).alias("_h"))
    step = step.select(*counts, _pairs("_h", 2).alias("_h"))
    agree = F.size(F.array_distinct("_h")) < F.size("_h")
    step = step.select(*counts, F.when(agree, _pairs("_h", 4)).alias("_h"))
    placed = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.select(*counts, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), placed).alias("_h"))
    beside = lambda k: F.get("_h", k)["h"]
    twice = F.filter("_h", lambda x, k: (beside(k - 1) == x["h"]) | (beside(k + 1) == x["h"]))
    step = step.withColumn("_h", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.transform("_h", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_h", k + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0), lambda a, x: a + x)
    return step.select(*counts, F.coalesce(total, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def reference(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text", lang_col: str = "lang") -> Reference:
    """Histograms of every language over all documents.

    Counts fold together in each task before they are shuffled. What reaches the
    driver is ``common_words`` words and a share for each class, for at most
    ``languages`` languages.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), _text(text_col).alias("t"))
    k = len(CLASS_NAMES)
    split = rows.select("lang", _class_counts(F.col("t")).alias("c"), F.size(_words(F.col("t"))).cast("bigint").alias("w"))
    sums = split.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("w").alias("w"), *[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(k)])
    sums = cut_lineage(sums, "language-sums")
    every = sums.agg(F.sum("w").alias("w"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]).first()
    top = sums.where("lang is not null").orderBy(F.desc("docs"), "lang").limit(limits.languages).collect()

    def shares(row) -> list[float]:
        found = [row[f"c{i}"] or 0 for i in range(k)]
        return [x / max(1, sum(found)) for x in found]

    chars = {ALL: shares(every)} | {r["lang"]: shares(r) for r in top}
    totals = {ALL: every["w"] or 0} | {r["lang"]: r["w"] for r in top}
    short = F.filter(_words(F.col("t")), lambda w: F.char_length(w) <= limits.common_length)
    counts = rows.select("lang", F.explode(once(short)).alias("w")).groupBy("lang", "w").count()
    # Both uses below would split every text anew.
    counts = cut_lineage(counts.where(F.col("w").rlike("^\\p{L}+$")), "short-words")
    named = counts.where(F.col("lang").isin([r["lang"] for r in top]))
    both = named.unionByName(counts.groupBy("w").agg(F.sum("count").alias("count")).withColumn("lang", F.lit(ALL)))
    place = Window.partitionBy("lang").orderBy(F.desc("count"), "w")
    best = both.withColumn("r", F.row_number().over(place)).where(F.col("r") <= limits.common_words).collect()
    words: dict[str, list[tuple[str, float]]] = {}
    for r in sorted(best, key=lambda r: (r["lang"], r["r"])):
        words.setdefault(r["lang"], []).append((r["w"], r["count"] / totals[r["lang"]]))
    return Reference(chars, words)


def js_distance(counts: Column, total: Column, shares: Column) -> Column:
    """Jensen-Shannon distance between counts of a given total and shares, both arrays of one length."""

    def part(n: Column, q: Column) -> Column:
        p = n / F.greatest(F.lit(1), total)
        m = (p + q) / 2
        term = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        return (term(p) + term(q)) / 2

    divergence = F.aggregate(F.zip_with(counts, shares, part), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(F.lit(0.0), divergence))


def without_common(words: list[tuple[str, float]]) -> float:
    """Squared distance of a text without any of the common words."""
    covered = min(1.0, sum(share for _, share in words))
    return (covered + math.log2(2 / (2 - covered)) + (1 - covered) * math.log2(2 * (1 - covered) / (2 - covered) or 1)) / 2


def _word_limit(n: Column, lacking: Column, covered: Column, bins: Column, limits: Limits) -> Column:
    """The word distance a text of ``n`` words may have.

    The divergence of a sample of n words from its own source is about
    chi-square with a degree of freedom for each common word, over 8 n ln 2.
    """
    fixed = F.lit(limits.max_word_distance)
    if limits.max_word_share is None:
        return fixed
    sampled = (bins + limits.word_deviations * F.sqrt(2 * bins)) / (8 * math.log(2) * n)
    allowed = F.least(limits.full_word_share**2 * lacking, F.greatest(limits.max_word_share**2 * lacking, sampled))
    return F.when(n * covered >= limits.min_common_expected, F.least(fixed, F.sqrt(allowed))).otherwise(fixed)


def assess(
    docs: DataFrame, ref: Reference | None = None, limits: Limits = Limits(), keep: tuple[str, ...] = ("doc_id",),
    text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """``keep`` columns, the base counts, base_failed, char_distance, word_distance and kept, for every row.

    A null text is an empty one and has no words, so it fails. A null or rare
    language is compared with the reference over all documents. Distances are
    null where the text is too short for them. Repeated rows are judged alike.
    """
    ref = ref or reference(docs, limits, text_col, lang_col)
    rows = docs.select(*keep, F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"))
    counted = base_counts(rows, [*keep, "_lang"], "_text")
    listed = lambda values, kind: F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")

    def looked_up(table: dict[str, Column]) -> Column:
        if not table:
            return F.lit(None)
        names = F.create_map(*[x for lang, value in table.items() for x in (F.lit(lang), value)])
        return F.coalesce(F.try_element_at(names, F.coalesce("_lang", F.lit(ALL))), F.try_element_at(names, F.lit(ALL)))

    common = sorted({w for ws in ref.words.values() for w, _ in ws})
    rest = lambda shares: [*shares, max(0.0, 1 - sum(shares))]
    step = counted.select(
        *[c for c in counted.columns if c not in ("_t", "_w")],
        F.char_length("_t").alias("_n"),
        _class_counts(F.col("_t"), F.col("n_symbols")).alias("_classes"),
        (F.filter("_w", lambda w: w.isin(common)) if common else F.array().cast("array<string>")).alias("_common"),
        looked_up({k: listed(v, "double") for k, v in ref.chars.items()}).cast("array<double>").alias("_char_ref"),
        looked_up({k: listed([w for w, _ in v], "string") for k, v in ref.words.items()}).cast("array<string>").alias("_words"),
        looked_up({k: listed(rest([s for _, s in v]), "double") for k, v in ref.words.items()}).cast("array<double>").alias("_word_ref"),
        looked_up({k: listed([without_common(v), sum(s for _, s in v), len(v)], "double") for k, v in ref.words.items()}).cast("array<double>").alias("_lacking"),
    )
    add = lambda array: F.aggregate(array, F.lit(0).cast("bigint"), lambda a, x: a + x)
    step = step.withColumn(
        "_seen", F.transform("_words", lambda w: F.size(F.filter("_common", lambda t: t == w)).cast("bigint"))
    )
    step = step.withColumn("_seen", F.concat("_seen", F.array(F.col("n_words") - add(F.col("_seen")))))
    step = step.withColumn("_chars", add(F.col("_classes")))
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    step = step.withColumns({
        "base_failed": failed,
        "char_distance": F.when(F.col("_n") >= limits.min_chars, js_distance(F.col("_classes"), F.col("_chars"), F.col("_char_ref"))),
        "word_distance": F.when(F.col("n_words") >= limits.min_words_compared, js_distance(F.col("_seen"), F.col("n_words"), F.col("_word_ref"))),
    })
    near = (F.coalesce("char_distance", F.lit(0.0)) <= limits.max_char_distance) & (
        F.coalesce("word_distance", F.lit(0.0)) <= F.coalesce(_word_limit(F.col("n_words"), *[F.get("_lacking", F.lit(k)) for k in range(3)], limits), F.lit(1.0))
    )
    return step.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "char_distance", "word_distance", (~F.col("base_failed") & near).alias("kept"),
    )


def kept_rows(docs: DataFrame, ref: Reference | None = None, limits: Limits = Limits(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Catalyst would push a filter on the verdict below the steps that compute it,
    and so write out every step within the next. Nothing is pushed below an
    explode of an expression, and one or no copy of the row is what is wanted.
    """
    ref = ref or reference(docs, limits, text_col, lang_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_of"))
    judged = assess(rows, ref, limits, ("_row",), "_text", "_of").select("_row", "kept")
    one = F.filter(F.array("_row"), lambda _: F.col("kept"))
    return judged.select(F.explode(once(one)).alias("_row")).select("_row.*")
