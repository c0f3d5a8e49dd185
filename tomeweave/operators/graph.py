"""Entity-relationship graphs: flatten, merge, check, measure and walk."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave.constants import PROPOSAL_TYPES
from tomeweave.scale import broadcast_if_small, once
from tomeweave.session import cut_lineage


# --------------------------------------------------------- extraction results
def stamp_provenance(extracts: DataFrame, file_name: Column, chunk_id: Column) -> DataFrame:
    """Append the source reference to every mention list, set it on relationships, default confidences."""
    ref = F.struct(file_name.alias("file_name"), chunk_id.alias("chunk_id"))
    sure = F.struct(
        F.lit(1.0).alias("score"), F.lit(False).alias("needs_review"), F.lit(None).cast("string").alias("review_reason")
    )
    no_mentions = F.array().cast("array<struct<file_name:string,chunk_id:string>>")
    return extracts.withColumns(
        {
            "entities": F.transform(
                "entities",
                lambda e: e.withField(
                    "mentions", F.concat(F.coalesce(e["mentions"], no_mentions), F.array(ref))
                ).withField("confidence", F.coalesce(e["confidence"], sure)),
            ),
            "relationships": F.transform(
                "relationships",
                lambda r: r.withField("source_ref", ref).withField("confidence", F.coalesce(r["confidence"], sure)),
            ),
        }
    )


def vertices(extracts: DataFrame, *carry: str) -> DataFrame:
    """One row per extracted entity."""
    return extracts.select(*carry, F.explode(once(F.col("entities"))).alias("_e")).select(*carry, "_e.*")


def edges(extracts: DataFrame, *carry: str) -> DataFrame:
    """One row per extracted relationship."""
    return extracts.select(*carry, F.explode(once(F.col("relationships"))).alias("_r")).select(*carry, "_r.*")


def proposal_tally(extracts: DataFrame) -> DataFrame:
    rows = extracts.select(F.explode("schema_proposals").alias("_p")).select("_p.*")
    return tally_proposals(rows)


def tally_proposals(proposals: DataFrame) -> DataFrame:
    return proposals.groupBy("proposal_type", "name").agg(
        F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence")
    )


def extraction_faults(extracts: DataFrame, *carry: str) -> DataFrame:
    """(carry, part, position, fault): what breaks the rules of an extraction result, a row for each fault.

    Entities and relationships need their names and a confidence, if one is given, from 0 to 1;
    proposals a known type and a confidence from 0 to 1.
    """
    outside = lambda score: ~F.coalesce(score.between(0.0, 1.0), F.lit(False))
    missing = lambda item, names: [F.when(F.coalesce(F.length(item[n]), F.lit(0)) < 1, n) for n in names]
    given = lambda item: F.when(item["confidence"].isNotNull() & outside(item["confidence"]["score"]), "score")
    rules = {
        "entities": lambda e: [*missing(e, ("id", "type", "name")), given(e)],
        "relationships": lambda r: [*missing(r, ("source_id", "target_id", "type")), given(r)],
        "schema_proposals": lambda p: [
            F.when(~F.coalesce(p["proposal_type"].isin(PROPOSAL_TYPES), F.lit(False)), "proposal_type"), F.when(outside(p["confidence"]), "confidence"),
        ],
    }
    found = []
    for part, rule in rules.items():
        items = extracts.select(*carry, F.posexplode(once(F.col(part))).alias("position", "_i"))
        faults = F.array_compact(F.array(*rule(F.col("_i"))))
        found.append(items.select(*carry, F.lit(part).alias("part"), "position", F.explode(once(faults)).alias("fault")))
    return reduce(DataFrame.unionByName, found)


# --------------------------------------------------------------------- merging
def rename_canonical(name: Column, rules: Mapping[str, str]) -> Column:
    """Canonical name of an alias; names without a rule stay."""
    if not rules:
        return name
    table = F.create_map(*[x for k, v in rules.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, name), name)


def rename_by_table(df: DataFrame, name: str, rules: DataFrame, alias: str, canonical: str) -> DataFrame:
    """The same with rules kept as rows."""
    small = broadcast_if_small(rules.select(F.col(alias).alias("_alias"), F.col(canonical).alias("_canonical")))
    joined = df.join(small, F.col(name) == F.col("_alias"), "left")
    return joined.withColumn(name, F.coalesce("_canonical", name)).drop("_alias", "_canonical")


def _best_first(score: Column, tie: str) -> Column:
    """Order of statements: higher scores first, none last, then the smaller tie key, of any type."""
    return F.struct(score.isNull().alias("n"), (-score).alias("s"), F.col(tie).alias("t"))


def merge_entities(mentions: DataFrame, entity: str, name: str, score: Column, tie: str) -> DataFrame:
    """One row per entity: mention count, distinct names, and the best-scored name.

    Names are counted first per (entity, name), so an entity with a third of all
    mentions is spread out, and its names stay rows (see ``entity_names``) instead
    of growing into one list.
    """
    best = _best_first(score, tie)
    named = mentions.groupBy(entity, name).agg(
        F.count("*").alias("_n"), F.min(best).alias("_best"), F.min(tie).alias("_first")
    )
    return named.groupBy(entity).agg(
        F.sum("_n").alias("n_mentions"),
        F.count("*").alias("n_names"),
        F.min_by(name, "_best").alias("canonical_name"),
        F.min("_first").alias("first_mention"),
    )


def entity_names(mentions: DataFrame, entity: str, name: str) -> DataFrame:
    """(entity, name, n): the aliases of each entity as rows."""
    return mentions.groupBy(entity, name).agg(F.count("*").alias("n"))


def resolve_edges(edges_df: DataFrame, src: str, kind: str, dst: str, score: Column, tie: str, keep: Sequence[str]) -> DataFrame:
    """The best-scored statement of each (src, kind, dst), the smallest ``tie`` among equals."""
    best = _best_first(score, tie)
    return edges_df.groupBy(src, kind, dst).agg(
        F.count("*").alias("n_statements"),
        *[F.min_by(F.struct(c), best)[c].alias(c) for c in keep],
    )


# -------------------------------------------------------------------- checking
def dangling(edges_df: DataFrame, vertices_df: DataFrame, src: str = "src", dst: str = "dst", vid: str = "id") -> DataFrame:
    """(endpoint, n_edges) of endpoints without a vertex.

    Endpoints are counted before the join, so a hub vertex is one row of it.
    """
    ends = edges_df.select(F.explode(F.array(src, dst)).alias("endpoint")).groupBy("endpoint").agg(
        F.count("*").alias("n_edges")
    )
    return ends.join(vertices_df.select(F.col(vid).alias("endpoint")), "endpoint", "left_anti")


def nonconforming(
    edges_df: DataFrame,
    vertices_df: DataFrame,
    ontology: DataFrame,
    src: str = "src",
    dst: str = "dst",
    kind: str = "type",
    vid: str = "id",
    vtype: str = "type",
) -> DataFrame:
    """Edges whose (source type, kind, target type) the ontology does not list.

    ``ontology`` has columns (type, source_type, target_type). A vertex may be
    listed several times and with several types: an edge conforms if any of them
    does, and one that does not is one row, with all types joined by ``|``.
    """
    types = vertices_df.select(F.col(vid).alias("_id"), F.col(vtype).alias("_vtype")).distinct()
    allowed = ontology.select(
        F.col("type").alias(kind), F.col("source_type").alias("_a"), F.col("target_type").alias("_b")
    ).distinct()
    keys = [src, kind, dst]
    conforming = (
        edges_df.select(*keys)
        .distinct()
        .join(broadcast_if_small(allowed), kind)
        .join(types.select(F.col("_id").alias(src), F.col("_vtype").alias("_a")), [src, "_a"], "left_semi")
        .join(types.select(F.col("_id").alias(dst), F.col("_vtype").alias("_b")), [dst, "_b"], "left_semi")
        .select(*keys)
        .distinct()
    )
    # An ontology bounds the types a vertex can have, so the set per vertex is small.
    named = types.groupBy("_id").agg(F.array_join(F.array_sort(F.collect_set("_vtype")), "|").alias("_types"))
    return (
        edges_df.join(conforming, keys, "left_anti")
        .join(named.select(F.col("_id").alias(src), F.col("_types").alias("source_type")), src, "left")
        .join(named.select(F.col("_id").alias(dst), F.col("_types").alias("target_type")), dst, "left")
        .select(*edges_df.columns, "source_type", "target_type")
    )


def unknown_types(vertices_df: DataFrame, entity_types: DataFrame, vtype: str = "type") -> DataFrame:
    known = entity_types.select(F.col("name").alias(vtype))
    return vertices_df.join(broadcast_if_small(known), vtype, "left_anti")


# ------------------------------------------------------------------- measuring
def graph_stats(vertices_df: DataFrame, edges_df: DataFrame, vtype: str = "type", etype: str = "type") -> DataFrame:
    """(metric, name, value): vertices and edges by type and the density."""
    by_vertex = vertices_df.groupBy(F.col(vtype).alias("name")).agg(F.count("*").cast("double").alias("value"))
    by_edge = edges_df.groupBy(F.col(etype).alias("name")).agg(F.count("*").cast("double").alias("value"))
    counts = by_vertex.select(F.lit("vertices").alias("metric"), "name", "value").unionByName(
        by_edge.select(F.lit("edges").alias("metric"), "name", "value")
    )
    v = F.sum(F.when(F.col("metric") == "vertices", F.col("value")))
    e = F.coalesce(F.sum(F.when(F.col("metric") == "edges", F.col("value"))), F.lit(0.0))
    density = counts.agg(
        F.lit("density").alias("metric"),
        F.lit("all").alias("name"),
        F.round(F.when(v > 1, e / (v * (v - 1))), 12).alias("value"),
    )
    return counts.unionByName(density)


def coverage(sections: DataFrame, processed: DataFrame, book: str, section: str) -> DataFrame:
    """Sections, processed sections and their share per book."""
    marked = sections.join(processed.select(section).distinct().withColumn("_done", F.lit(1)), section, "left")
    return marked.groupBy(book).agg(
        F.count("*").alias("sections"),
        F.count("_done").alias("processed"),
        F.round(F.count("_done") * 100.0 / F.count("*"), 1).alias("percentage"),
    )


def components(edges_df: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest vertex id each vertex is connected to.

    Every round points each vertex to the first of its neighbours and itself, and the
    edges between what is pointed to are the next round's: vertices and edges that are
    finished leave. First is the smallest in the first round, later the first in an order
    that is new each round, so chains shrink by a share too. The first neighbour is a map-side
    combined aggregate, never a hub's list. At the end the pointers are followed
    back from the last round and the smallest id of each class is taken. Lineage is cut every round.
    """
    pairs = cut_lineage(edges_df.select(F.col(src).alias("a"), F.col(dst).alias("b")), "pairs")
    rounds = []
    for turn in range(max_rounds):
        rank = lambda v: F.struct(*([F.xxhash64(v, F.lit(turn)).alias("r")] if turn else []), F.col(v).alias("v"))  # noqa: B023, E731
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # A vertex beside a null stands alone; a null has no component.
        known = F.when(F.col("b").isNotNull(), rank("b"))
        first = both.groupBy("a").agg(F.min(known).alias("m"))
        up = F.when(F.col("a").isNotNull(), F.least("m", rank("a"))["v"])
        rounds.append(cut_lineage(first.select(F.col("a").alias("id"), up.alias("up")), "pointers"))
        ends = [rounds[-1].select(F.col("id").alias(end), F.col("up").alias(f"_{end}")) for end in ("a", "b")]
        moved = pairs.join(ends[0], "a").join(ends[1], "b").where("_a <> _b")
        pairs = cut_lineage(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "pairs")
        if pairs.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    found = rounds.pop()
    while rounds:
        above = found.select(F.col("id").alias("up"), F.col("up").alias("_top"))
        found = cut_lineage(rounds.pop().join(above, "up", "left").select("id", F.coalesce("_top", "up").alias("up")), "pointers")
    least = found.groupBy("up").agg(F.min("id").alias("component"))
    return found.join(least, "up", "left").select("id", "component")


# --------------------------------------------------------------------- walking
def within_hops(edges_df: DataFrame, start: DataFrame, hops: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, hop): vertices reachable from ``start`` (column ``id``) over undirected edges, by least hops.

    Every round joins the new frontier only. The frontier is made distinct before
    the next round, and vertices already reached are taken out by an anti-join.
    """
    forth = edges_df.select(F.col(src).alias("_from"), F.col(dst).alias("id"))
    both = forth.unionByName(forth.select(F.col("id").alias("_from"), F.col("_from").alias("id")))
    reached = cut_lineage(start.select("id").distinct().withColumn("hop", F.lit(0)), "reached")
    frontier = reached
    for hop in range(1, hops + 1):
        step = (
            both.join(broadcast_if_small(frontier.select(F.col("id").alias("_from"))), "_from")
            .select("id")
            .distinct()
            .join(reached.select("id"), "id", "left_anti")
            .withColumn("hop", F.lit(hop))
        )
        frontier = cut_lineage(step, "reached")
        reached = reached.unionByName(frontier)
    return reached


def composed_edges(edges_df: DataFrame, first: str, second: str, inferred: str, src: str = "src", dst: str = "dst", kind: str = "type") -> DataFrame:
    """Inferred edges a -> c where a -first-> b and b -second-> c, e.g. a parent's parent."""
    left = edges_df.where(F.col(kind) == first).select(F.col(src).alias("src"), F.col(dst).alias("_mid")).distinct()
    right = edges_df.where(F.col(kind) == second).select(F.col(src).alias("_mid"), F.col(dst).alias("dst")).distinct()
    return left.join(right, "_mid").select("src", F.lit(inferred).alias("type"), "dst").distinct()


def graph_context(reached: DataFrame, mentions: DataFrame, chunks: DataFrame, entity: str, chunk_id: str) -> DataFrame:
    """Chunks that mention a reached vertex, nearest first: the context of a graph question."""
    near = mentions.join(broadcast_if_small(reached.select(F.col("id").alias(entity), "hop")), entity)
    ranked = near.groupBy(chunk_id).agg(F.min("hop").alias("hop"), F.count_distinct(entity).alias("n_entities"))
    return ranked.join(chunks, chunk_id).orderBy("hop", F.desc("n_entities"), chunk_id)
