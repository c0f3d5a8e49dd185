"""Which chunks contain which evidence quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeweave.scale import BROADCAST_LIMIT_BYTES, once
from tomeweave.session import cut_lineage

ANCHOR_WORDS = 6
LONGEST_WINDOW = 16  # characters of the anchor of a quote without an inner word
FILTER_BITS = 1 << 20


def quotes_in_sources(qa: DataFrame, chunks: DataFrame, qa_id: str, quote: str, source_ids: str, chunk_id: str, text: str) -> DataFrame:
    """(qa_id, grounded): whether the quote stands in one of the pair's own source chunks."""
    cited = qa.select(qa_id, quote, F.explode_outer(source_ids).alias(chunk_id))
    checked = cited.join(chunks.select(chunk_id, text), chunk_id, "left")
    return checked.groupBy(qa_id).agg(
        F.coalesce(F.bool_or(F.contains(F.col(text), F.col(quote))), F.lit(False)).alias("grounded")
    )


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _grams(toks: Column, n: int) -> Column:
    return F.when(
        F.size(toks) >= n,
        F.transform(
            F.sequence(F.lit(1), F.size(toks) - n + 1), lambda i: _key(n, F.array_join(F.slice(toks, i, n), " "))
        ),
    )


def _windows(text: Column, width: int) -> Column:
    return F.when(
        F.length(text) >= width,
        F.transform(
            F.sequence(F.lit(1), F.length(text) - width + 1), lambda i: _key(-width, F.substring(text, i, F.lit(width)))
        ),
    )


def _key(kind: int, anchor: Column) -> Column:
    """Hash of an anchor; anchors of another kind (words, or minus the characters) have other hashes."""
    return F.xxhash64(F.lit(kind), anchor)


def _slots(key: Column) -> tuple[Column, Column]:
    """The two bits that a key sets."""
    return F.pmod(key, F.lit(FILTER_BITS)), F.pmod(F.shiftright(key, 24), F.lit(FILTER_BITS))


def _possible(keyed: DataFrame):
    """A test that no key of ``keyed`` fails and few others pass: a bit map, whatever the number of keys.

    Tasks set the bits and only the map's words come to the driver; it is a
    constant of the plan then, consulted inside the scan.
    """
    bits = keyed.select(F.explode(F.array(*_slots(F.col("_key")))).alias("b"))
    one = F.expr("shiftleft(1L, cast(pmod(b, 64) as int))")
    words = bits.groupBy(F.floor(F.col("b") / 64).cast("int").alias("w")).agg(F.bit_or(one).alias("v"))
    table = [0] * (FILTER_BITS // 64)
    for row in words.collect():  # at most FILTER_BITS / 64 numbers
        table[row["w"]] = row["v"]
    stored = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")

    def holds(slot: Column) -> Column:
        return F.getbit(F.get(stored, F.floor(slot / 64).cast("int")), F.pmod(slot, F.lit(64)).cast("int")) == 1

    def test(key: Column) -> Column:
        first, second = _slots(key)
        return holds(first) & holds(second)

    return test


def _anchored(quotes: DataFrame, quote_id: str, quote: str, anchor_words: int) -> DataFrame:
    """(quote, _quote, _kind, _key): the anchor of every quote that is not empty."""
    words = F.size(_tokens(F.col(quote))) - 2
    rows = quotes.select(quote_id, F.col(quote).alias("_quote"), F.least(F.lit(anchor_words), words).alias("_n")).where(F.length("_quote") > 0)
    # Without an inner word: its first characters, of a power of two that it has at least.
    width = F.least(F.lit(LONGEST_WINDOW), F.pow(F.lit(2), F.floor(F.log2(F.length("_quote")))).cast("int"))
    kinds = F.when(F.col("_n") > 0, F.col("_n")).otherwise(-width)
    inner = F.array_join(F.slice(_tokens(F.col("_quote")), F.lit(2), F.greatest(F.col("_n"), F.lit(0))), " ")
    rows = rows.withColumn("_kind", kinds)
    anchor = F.when(F.col("_kind") > 0, inner).otherwise(F.substring(F.col("_quote"), F.lit(1), -F.col("_kind")))
    return rows.select(quote_id, "_quote", "_kind", F.xxhash64("_kind", anchor).alias("_key"))


def find_quotes(docs: DataFrame, quotes: DataFrame, doc_id: str, text: str, quote_id: str, quote: str, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """All (quote, doc) pairs where the text contains the quote exactly.

    The inner words of a quote, those between its first and its last, must stand
    as whole consecutive words in every text that contains it. Up to
    ``anchor_words`` of them are its anchor; a quote without an inner word has its
    first characters instead, in one of a few lengths. One scan of the texts makes the
    anchors of all kinds, drops those that no quote can have by a bit map, and compares
    what meets a quote's anchor in full, however many quotes there are and
    however short they are.
    """
    keyed = cut_lineage(_anchored(quotes, quote_id, quote, anchor_words), "quotes")
    kinds = sorted(r[0] for r in keyed.select("_kind").distinct().collect())  # a few lengths
    if not kinds:
        none = T.StructType([quotes.schema[quote_id], docs.schema[doc_id]])
        return docs.sparkSession.createDataFrame([], none)
    possible = _possible(keyed)
    # The token list is its own column: inside a lambda it would be split anew per word.
    rows = docs.select(doc_id, F.col(text).alias("_text"), *([_tokens(F.col(text)).alias("_t")] if kinds[-1] > 0 else []))
    none = F.array().cast("array<bigint>")
    made = [_grams(F.col("_t"), k) if k > 0 else _windows(F.col("_text"), -k) for k in kinds]
    kept = [F.filter(F.coalesce(m, none), possible) for m in made]
    met = rows.select(doc_id, "_text", F.explode(once(F.array_distinct(F.concat(*kept)))).alias("_key"))
    wanted = keyed.select(quote_id, "_quote", "_key")
    size = wanted.agg(F.sum(F.octet_length("_quote") + 64)).first()[0]
    found = met.join(F.broadcast(wanted) if size <= BROADCAST_LIMIT_BYTES else wanted, "_key")
    return found.where(F.contains(F.col("_text"), F.col("_quote"))).select(quote_id, doc_id).distinct()
