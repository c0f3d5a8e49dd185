"""Texts without their language's common words go, however little those words cover."""

import math
import random

from tomeweave.llm import quality

COMMON = {
    "en": "the of and to in is that was for with as on by at from are".split(),
    "de": "der die und das den ist mit von zu im auf für ein dem des als".split(),
}


def text(lang, n, seed, share=0.3):
    at = random.Random(seed)
    word = lambda: "".join(at.choice("abcdefghijklmnoprstuvw") for _ in range(7))
    return " ".join(at.choice(COMMON[lang]) if at.random() < share else word() for _ in range(n))


def test_foreign_and_random_texts_go(spark):
    lengths = (60, 90, 150, 400, 1500)
    good = [(1000 * k + n, text(lang, n, f"{k}{n}{lang}"), lang) for k in range(40) for n in lengths for lang in COMMON]
    foreign = [(-n, text("de", n, f"foreign{n}"), "en") for n in lengths]
    rand = [(-10_000 - n, text("en", n, f"random{n}", 0.0), "en") for n in lengths]
    other = [(-20_000 - n, text("en", n, f"none{n}", 0.0), None) for n in lengths]
    docs = spark.createDataFrame(good + foreign + rand + other, "doc_id bigint, text string, lang string")
    kept = [r.doc_id for r in quality.kept_rows(docs).collect()]
    assert not [k for k in kept if k < 0]
    assert len(kept) >= 0.99 * len(good)
    fixed = {r.doc_id for r in quality.kept_rows(docs, limits=quality.Limits(max_word_share=None)).collect()}
    assert all(k in fixed for k, _, _ in good)


def test_a_language_of_few_common_words_is_not_asked_for_them(spark):
    docs = spark.createDataFrame([(k, text("en", 80, f"few{k}", 0.02), "en") for k in range(60)], "doc_id bigint, text string, lang string")
    assert quality.kept_rows(docs).count() == 60


def test_distance_without_common_words():
    assert quality.without_common([]) == 0 and math.isclose(quality.without_common([("a", 1.0)]), 1.0)
    assert abs(math.sqrt(quality.without_common([("a", 0.1), ("b", 0.083)])) - 0.314) < 0.002
