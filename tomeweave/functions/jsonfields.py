"""Fields that hold either an object or a string that only looks like one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave.functions.text import strip

# JSON as Spark writes it, in pieces: the colon and string of a field whose text may be an object, and whatever stands between these.
# An object opens with a brace and a quote or another brace, which a failing parse of other text would find at a higher cost.
_SPACE = r'(?:\x20|\\[tnr]|\\u00(?:09|20|0[aAdD]))*+'
_OPENS = rf'"{_SPACE}\{{{_SPACE}(?:\\"|\}})'
_REST = r'[^"\\]*+(?:\\.[^"\\]*+)*+"'
_PIECE = f'(?s):{_OPENS}{_REST}|(?:[^":]++|"{_REST}|:(?!{_OPENS}))++'


def looks_like_object(text: Column) -> Column:
    return F.startswith(strip(text), F.lit("{"))


def parsed_object(text: Column) -> Column:
    """The value as a variant when it is a valid object, else null."""
    return F.when(looks_like_object(text), F.try_parse_json(text))


def parse_status(text: Column) -> Column:
    return (
        F.when(text.isNull(), "null")
        .when(~looks_like_object(text), "string")
        .when(F.try_parse_json(text).isNotNull(), "object")
        .otherwise("invalid")
    )


def parse_nested(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value VARIANT, n_parsed): every object field that is a string holding an object becomes that object.

    Fields are looked for at any depth, in objects inside arrays too; a string that
    stands in an array itself, one that does not parse, and whatever is inside a
    parsed string stay as they are. Rows with a null value stay null.

    A row is written as JSON once and cut into strings and what stands between them. A string
    behind a colon is a field's value at whatever depth, so nothing is taken apart level by
    level, nothing is shuffled, and the plan does not grow with the depth.
    """
    pieces = F.regexp_extract_all(F.to_json("value"), F.lit(_PIECE), F.lit(0))
    # A field's string that parses is an object, as nothing else opens like one.
    text = lambda p: F.when(F.startswith(p, F.lit(":")), F.get_json_object(F.concat(F.lit('{"v"'), p, F.lit("}")), "$.v"))
    read = F.transform("_pieces", lambda p: F.struct(p.alias("p"), F.to_json(F.try_parse_json(text(p))).alias("new")))
    rows = df.select(key, F.col(value).alias("value")).withColumn("_pieces", pieces).withColumn("_read", read)
    rows = rows.withColumn("n_parsed", F.coalesce(F.size(F.filter("_read", lambda r: r["new"].isNotNull())), F.lit(0)))
    whole = F.array_join(F.transform("_read", lambda r: F.coalesce(F.concat(F.lit(":"), r["new"]), r["p"])), "")
    return rows.select(key, F.when(F.col("n_parsed") > 0, F.parse_json(whole)).otherwise(F.col("value")).alias("value"), "n_parsed")
