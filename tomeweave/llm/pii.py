"""Personal data: patterns, and terms that give protected entities away.

Patterns find e-mail and IP addresses, card and phone numbers. Each such value is
a protected entity, however it is written, and so are the classes it belongs to: its
mail domain and name part, network, area, issuer, and its kind. From the corpus it
is estimated how much of an entity's information a term near it discloses:
pointwise mutual information over the entity's information content, weighed by the
number of different texts that show it. Terms beyond a threshold are personal data
too, wherever they stand, and are generalised or, beyond a higher one, removed.
DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave.llm.base import broadcast_counted, with_matches
from tomeweave.scale import once
from tomeweave.session import cut_lineage

# The base patterns, written so that no text takes longer than its length: runs are taken whole, and a match
# starts where a run starts or where the last match ended (\G).
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = f"(?:(?<!{LOCAL})|\\G){LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "[0-9](?:[\\x20-]?[0-9])++"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
REMOVED = "removed"
WORD = "[\\p{L}][\\p{L}'-]{2,}"  # two letters name nothing
SPANS = "array<struct<start: int, kind: int, end: int>>"


@dataclass(frozen=True)
class Settings:
    generalise: float = 0.9  # share of an entity's information that a term may disclose
    remove: float = 0.97
    evidence: float = 0.6  # of that share times n / (n + 1), for n different texts in which the term stands near the entity
    near: int = 96  # characters on either side of an entity in which terms are looked for


# -------------------------------------------------------------- base patterns
def _valid_ip(hit: Column) -> Column:
    small = lambda p: F.when(F.length(p) <= 3, p.cast("int")).otherwise(999) <= 255
    return F.forall(F.split(hit, "\\."), lambda part: small(F.regexp_replace(part, "^0+(?=[0-9])", "")))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]+", "")


def _luhn(hit: Column) -> Column:
    turned = F.reverse(_digits(hit))
    each = F.transform(
        F.filter(F.split(turned, ""), lambda d: d != ""),
        lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise(F.floor(d.cast("int") * 2 / 10) + (d.cast("int") * 2) % 10).cast("int"),
    )
    return F.aggregate(each, F.lit(0), lambda t, x: t + x) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return _valid_ip(hit)
    if kind == "card":
        return F.when(F.length(_digits(hit)).between(14, 19), _luhn(hit)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    return F.lit(True)


def _spans_of(kind: str, number: int) -> Column:
    def span(hit: Column, start: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + F.char_length(hit)).alias("end"))

    each = F.zip_with(f"_{kind}_hits", f"_{kind}_starts", lambda h, s: F.when(_valid(kind, h), span(h, s)))
    return F.array_compact(each).cast(SPANS)


def with_base(docs: DataFrame, text: str) -> DataFrame:
    """Add ``_base``, the valid matches of all kinds in order, and the gaps and hits of each kind."""
    t = F.col(text)
    tests = {
        "email": (EMAIL, F.contains(t, F.lit("@"))),
        "ip": (IP, t.rlike("[0-9]\\.[0-9]")),
        "card": (CARD, t.rlike("[0-9](?:[\\x20-]?[0-9]){13}")),
        "phone": (PHONE, F.contains(t, F.lit("+"))),
    }
    for kind, (pattern, possible) in tests.items():
        docs = with_matches(docs, text, pattern, f"_{kind}", possible)
    found = [_spans_of(kind, number) for number, kind in enumerate(KINDS)]
    return docs.withColumn("_base", F.sort_array(F.concat(*found)))


# ------------------------------------------------------------ disclosing terms
def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"(?<![\\p{{L}}])({WORD})(?![\\p{{L}}'-])"), F.lit(1))


def _text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def _entities(kind: str, hit: Column) -> Column:
    """The entity in one way of writing, and the classes that it shares with others."""
    if kind == "email":
        low = F.lower(hit)
        names = F.regexp_extract_all(F.substring_index(low, "@", 1), F.lit(f"({WORD})"), F.lit(1))
        classes = F.concat(F.array(F.concat(F.lit("domain:"), F.substring_index(low, "@", -1))), F.transform(names, lambda n: F.concat(F.lit("name:"), n)))
    elif kind == "ip":
        low = hit
        classes = F.array(F.concat(F.lit("net:"), F.substring_index(hit, ".", 3)))
    else:
        low = _digits(hit)
        classes = F.array(F.concat(F.lit("area:"), F.left(low, F.lit(4)))) if kind == "phone" else F.array(F.concat(F.lit("issuer:"), F.left(low, F.lit(6))))
    return F.concat(F.array(F.lit(kind), F.concat_ws(":", F.lit(kind), low)), classes)


def _near(kind: str, width: int) -> Column:
    """Every match of a kind with the terms around it."""

    def entity(k: Column) -> Column:
        hit = F.get(f"_{kind}_hits", k)
        before = F.regexp_replace(F.right(F.get(f"_{kind}_gaps", k), F.lit(width)), "^\\S*", "")
        after = F.regexp_replace(F.left(F.get(f"_{kind}_gaps", k + 1), F.lit(width)), "\\S*$", "")
        terms = F.array_distinct(_terms(F.concat(before, F.lit(" "), after)))
        return F.struct(_entities(kind, hit).alias("entities"), terms.alias("terms"), _valid(kind, hit).alias("ok"))

    order = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(f"_{kind}_hits") - 1))
    return F.when(F.size(f"_{kind}_hits") > 0, F.transform(order, entity))


def disclosing_terms(docs: DataFrame, settings: Settings = Settings(), text_col: str = "text") -> DataFrame | None:
    """(term, disclosure) of all terms at or above ``generalise`` with ``evidence`` enough; None if there is none near any entity.

    Entities, their classes and terms are counted over all documents. Evidence is
    counted in different texts, so copies of one text are none.
    """
    rows = with_base(docs.select(_text(text_col).alias("_t"), F.xxhash64(_text(text_col)).alias("key")), "_t")
    near = [_near(kind, settings.near) for kind in KINDS]
    empty = F.array().cast("array<struct<entities: array<string>, terms: array<string>, ok: boolean>>")
    rows = rows.where(F.size("_base") > 0).select("key", F.concat(*[F.coalesce(n, empty) for n in near]).alias("near"))
    # One row for each different text, with the number of documents that have it.
    texts = rows.groupBy("key").agg(F.count("*").alias("docs"), F.first("near").alias("near"))
    found = cut_lineage(
        texts.select("key", "docs", F.explode("near").alias("n")).where("n.ok").select("key", "docs", F.explode("n.entities").alias("entity"), "n.terms"), "entities"
    )
    each = found.select("key", "docs", "entity", F.explode("terms").alias("term")).distinct()
    with_entity = found.select("key", "docs", "entity").distinct().groupBy("entity").agg(F.sum("docs").alias("with_entity"))
    near_any = each.select("key", "docs", "term").distinct().groupBy("term").agg(F.sum("docs").alias("near_any"))
    both = each.groupBy("entity", "term").agg(F.sum("docs").alias("both"), F.count("*").alias("texts"))
    n = docs.count()

    def disclosed(of: str) -> Column:
        """log(P(e|t) / P(e)) / -log P(e); an entity that is everywhere has no information to disclose."""
        information = -F.log2(F.col("with_entity") / n)
        gained = F.log2(F.least(F.lit(1.0), F.col("both") / F.col(of))) + information
        return F.when(information > 0, gained / F.when(information > 0, information)).otherwise(0.0)

    shown = F.col("texts") / (F.col("texts") + 1)

    def enough(share: Column) -> Column:
        return (share >= settings.generalise) & (share * shown >= settings.evidence)

    # No share is above one, which leaves out the pairs of too few texts before anything is joined. And a term is in
    # at least as many documents as it is near an entity in: most other pairs fall below the threshold by that
    # alone, and the corpus is only searched for the terms of the rest.
    pairs = cut_lineage(
        both.where(shown >= settings.evidence).join(with_entity, "entity").join(near_any, "term").where(enough(disclosed("near_any"))),
        "pairs",
    )
    terms = cut_lineage(pairs.select("term").distinct(), "terms")
    if not terms.head(1):
        return None
    seen = docs.select(F.explode(once(F.array_distinct(_terms(_text(text_col))))).alias("term"))
    with_term = seen.join(broadcast_counted(terms), "term").groupBy("term").agg(F.count("*").alias("with_term"))
    scored = pairs.join(with_term, "term")
    share = disclosed("with_term")
    flagged = scored.where(enough(share)).groupBy("term").agg(F.max(share).alias("disclosure"))
    return cut_lineage(flagged, "disclosing")


def find(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, base, terms) for every row: places of pattern matches and of disclosing terms, as code points.

    ``kind`` numbers ``KINDS``; a term to generalise has the next number and one to
    remove the one after. A null text is an empty one. Repeated rows, also with a null id, are answered alike; other
    columns are ignored. The base matches do not depend on the corpus.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), _text(text_col).alias("_t"))
    flagged = disclosing_terms(docs, settings, text_col)
    number = len(KINDS)
    if flagged is None:
        rows = rows.withColumns({"_terms": F.lit(None).cast("array<string>"), "_strong": F.lit(None).cast("array<string>")})
    else:
        key = F.xxhash64("_t").alias("_key")
        words = rows.select(key, F.explode(once(F.array_distinct(_terms(F.col("_t"))))).alias("term"))
        # A text has each term once here, so the set per text is bounded by the text.
        here = words.join(broadcast_counted(flagged), "term").groupBy("_key").agg(
            F.sort_array(F.collect_set("term")).alias("_terms"), F.collect_set(F.when(F.col("disclosure") >= settings.remove, F.col("term"))).alias("_strong")
        )
        here = broadcast_counted(cut_lineage(here, "here"), 20_000)
        rows = rows.withColumn("_key", key).join(here, "_key", "left").drop("_key")
    rows = with_base(rows, "_t")
    pattern = F.concat(F.lit("(?iu)(?<![\\p{L}])(?:"), F.array_join("_terms", "|"), F.lit(")(?![\\p{L}'-])"))
    rows = rows.withColumn("_pattern", F.coalesce(pattern, F.lit("(?!)")))
    rows = with_matches(rows, "_t", F.col("_pattern"), "_term", F.size("_terms") > 0)
    kind_of = lambda h: F.when(F.coalesce(F.array_contains("_strong", F.lower(h)), F.lit(False)), number + 1).otherwise(number)
    spans = F.zip_with("_term_starts", "_term_hits", lambda s, h: F.struct(s.alias("start"), kind_of(h).alias("kind"), (s + F.char_length(h)).alias("end")))
    return rows.select("doc_id", F.col("_base").alias("base"), spans.cast(SPANS).alias("terms"), *(["_t"] if keep_text else []))


def number_of(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def written(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined, in order of start and kind."""
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM, REMOVED)])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def sanitised(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): matches become their kind in brackets, disclosing terms [TERM] or, from ``remove`` on, nothing.

    Overlaps go to the earlier span.
    """
    rows = find(docs, settings, id_col, text_col, keep_text=True)
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, TERM)], F.lit(""))
    spans = F.sort_array(F.concat("base", "terms"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(
        s["end"].alias("at"), F.concat(a["out"], F.substring(F.col("_t"), a["at"] + 1, s["start"] - a["at"]), F.get(labels, s["kind"])).alias("out")
    ))
    end = rows.withColumn("_a", F.aggregate(spans, start, step))
    return end.select("doc_id", F.concat("_a.out", F.expr("substring(_t, _a.at + 1)")).alias("text"))
