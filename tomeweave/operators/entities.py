"""Merging extracted entities: co-reference over aliases, and what the merged ones carry as rows.

Statements about entities come with an id, a type, a name, aliases, an attribute
object and mentions. Ids that share a name or an alias, directly or through
others, are one entity. Its aliases, mentions and attributes stay rows, so an
entity with a third of all statements never becomes one long value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave.operators.graph import components
from tomeweave.scale import once, row_index
from tomeweave.session import cut_lineage


@dataclass(frozen=True)
class Merged:
    """The merged graph's vertices; ``members`` names the entity that each statement's id went into."""

    members: DataFrame  # id, entity
    entities: DataFrame  # entity, type, name, score, n_ids, n_statements, n_conflicts, attributes
    aliases: DataFrame  # entity, alias, n
    mentions: DataFrame  # entity, position, file_name, chunk_id, n
    attributes: DataFrame  # entity, key, value, n_values, n_statements


def alias_key(text: Column) -> Column:
    """What two spellings of an alias have in common: lower case, single spaces; null if nothing is left."""
    key = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.when(F.length(key) > 0, key)


def _names(statements: DataFrame) -> DataFrame:
    """(id, alias) for the name and every alias of every statement."""
    every = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return statements.select("id", F.explode(once(every)).alias("alias")).where(alias_key(F.col("alias")).isNotNull())


def coreference(names: DataFrame, max_ids: int | None = None) -> DataFrame:
    """(id, root): the smallest id that each id is connected to by shared aliases.

    ``names`` has columns (id, alias). All ids with an alias are linked to the
    smallest of them, so an alias of m ids adds m - 1 edges whatever m is. With
    ``max_ids`` an alias of more ids than that is taken for ambiguous and links none.
    """
    links = names.select("id", alias_key(F.col("alias")).alias("_key")).where("id is not null and _key is not null").distinct()
    links = cut_lineage(links, "alias-links")
    first = links.groupBy("_key").agg(F.min("id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    if max_ids:
        first = first.where(F.col("_n") <= max_ids)
    edges = links.join(first, "_key").where(F.col("id") != F.col("_first")).select(F.col("id").alias("src"), F.col("_first").alias("dst"))
    found = components(cut_lineage(edges.distinct(), "alias-edges"))
    return links.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("root"))


def merge(statements: DataFrame, max_ids: int | None = None) -> Merged:
    """Merge statements (id, type, name, aliases, attributes VARIANT, mentions, score).

    The entity takes the id with most statements, then the best score, then the
    smallest id. Type, name and each attribute take the value with the best score, then
    the one stated most often, then the smallest. A missing score is the lowest.
    Mentions are a set in the order of file and chunk. Statements without an id are left out.
    """
    rows = statements.where(F.col("id").isNotNull()).withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))))
    names = _names(rows)
    roots = rows.select("id").distinct().join(coreference(names, max_ids), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    per_id = rows.groupBy("id").agg(F.count("*").alias("_n"), F.max("score").alias("_s")).join(roots, "id")
    per_id = cut_lineage(per_id, "entity-ids")
    chosen = per_id.groupBy("root").agg(F.min_by("id", F.struct(-F.col("_n"), -F.col("_s"), F.col("id"))).alias("entity"))
    members = cut_lineage(per_id.join(chosen, "root").select("id", "entity"), "entity-members")

    def of_entity(df: DataFrame) -> DataFrame:
        return df.join(members, "id")

    def best_value(values: DataFrame, *keys: str) -> DataFrame:
        """One ``value`` for each of ``keys``: best score, then most statements, then smallest."""
        stated = values.groupBy(*keys, "value").agg(F.count("*").alias("_n"), F.max("score").alias("_s"))
        return stated.groupBy(*keys).agg(
            F.min_by("value", F.struct(-F.col("_s"), -F.col("_n"), F.col("value"))).alias("value"),
            F.count("*").alias("n_values"), F.sum("_n").alias("n_statements"),
        )

    def best_field(name: str) -> DataFrame:
        stated = of_entity(rows.select("id", F.col(name).alias("value"), "score").where(F.col(name).isNotNull()))
        return best_value(stated, "entity").select("entity", F.col("value").alias(name))

    aliases = of_entity(names.select("id", F.trim("alias").alias("alias"))).groupBy("entity", "alias").agg(F.count("*").alias("n"))

    places = rows.select("id", F.explode(once(F.col("mentions"))).alias("m")).select("id", "m.file_name", "m.chunk_id")
    placed = of_entity(places).groupBy("entity", "file_name", "chunk_id").agg(F.count("*").alias("n"))
    at = F.concat_ws("\x01", F.coalesce("file_name", F.lit("")), F.coalesce("chunk_id", F.lit("")))
    placed = cut_lineage(placed.withColumn("_at", at), "entity-mentions")
    mentions = row_index(placed, ["entity"], ["_at"], "position").select("entity", "position", "file_name", "chunk_id", "n")

    spark = rows.sparkSession
    stated = rows.select("id", "score", "attributes").lateralJoin(spark.tvf.variant_explode(F.col("attributes").outer()))
    stated = stated.select("id", "score", "key", F.to_json("value").alias("value")).where("key is not null and value is not null")
    attributes = cut_lineage(best_value(of_entity(stated), "entity", "key"), "entity-attributes")
    # An ontology bounds the attributes of a type, so an entity's object is small.
    objects = attributes.groupBy("entity").agg(
        F.array_sort(F.collect_list(F.struct("key", "value"))).alias("_kv"), F.count_if(F.col("n_values") > 1).alias("n_conflicts")
    )
    as_object = F.to_variant_object(F.transform_values(F.map_from_entries("_kv"), lambda _, v: F.parse_json(v)))
    totals = per_id.join(members, "id").groupBy("entity").agg(F.max("_s").alias("score"), F.count("*").alias("n_ids"), F.sum("_n").alias("n_statements"))
    entities = (
        totals.join(best_field("type"), "entity", "left")
        .join(best_field("name"), "entity", "left")
        .join(objects, "entity", "left")
        .select(
            "entity", "type", "name", F.when(F.col("score") > float("-inf"), F.col("score")).alias("score"), "n_ids", "n_statements",
            F.coalesce("n_conflicts", F.lit(0).cast("bigint")).alias("n_conflicts"), as_object.alias("attributes"),
        )
    )
    return Merged(members, entities, aliases, mentions, attributes)


def merge_relationships(relationships: DataFrame, members: DataFrame) -> DataFrame:
    """(source_id, type, target_id, description, evidence, score, n_statements, n_sources) between merged entities.

    Endpoints are replaced by their entity, statements of one triple are one row,
    and the best-scored of them (then the smallest description and evidence) tells
    what is said. A relationship of an entity with itself is what is left of an
    alias and goes. Endpoints that are no entity stay as they are, to be found by ``graph.dangling``.
    """
    named = relationships
    for end in ("source_id", "target_id"):
        lookup = members.select(F.col("id").alias(end), F.col("entity").alias(f"_{end}"))
        named = named.join(lookup, end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    first = F.struct(F.col("score").isNull(), -F.col("score"), F.col("description"), F.col("evidence"))
    stated = named.where(~F.col("source_id").eqNullSafe(F.col("target_id"))).groupBy("source_id", "type", "target_id").agg(
        F.min_by(F.struct("description", "evidence", "score"), first).alias("_b"), F.count("*").alias("n_statements"),
        F.count_distinct(F.struct("source_ref.file_name", "source_ref.chunk_id")).alias("n_sources"),
    )
    return stated.select("source_id", "type", "target_id", "_b.description", "_b.evidence", "_b.score", "n_statements", "n_sources")
