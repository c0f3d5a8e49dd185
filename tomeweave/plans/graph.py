"""Graphs built from the given tables: regions, nations, customers, suppliers and their links."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeweave.functions.text import content_hash
from tomeweave.operators import graph
from tomeweave.plans.base import Catalogue, table

catalogue = Catalogue()


def _named(kind, key):
    return F.concat(F.lit(f"{kind}_"), F.col(key).cast("string"))


def _vertices(spark, sf):
    parts = [
        table(spark, sf, t).select(_named(t, k).alias("id"), F.lit(t).alias("type"))
        for t, k in (
            ("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"),
        )
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _link(df, src, kind, dst):
    return df.select(src.alias("src"), F.lit(kind).alias("type"), dst.alias("dst"))


def _edges(spark, sf, orders=True):
    out = (
        _link(table(spark, sf, "nation"), _named("nation", "n_nationkey"), "in_region", _named("region", "n_regionkey"))
        .unionByName(
            _link(table(spark, sf, "customer"), _named("customer", "c_custkey"), "lives_in", _named("nation", "c_nationkey"))
        )
        .unionByName(
            _link(table(spark, sf, "supplier"), _named("supplier", "s_suppkey"), "based_in", _named("nation", "s_nationkey"))
        )
    )
    if orders:
        out = out.unionByName(
            _link(table(spark, sf, "orders"), _named("customer", "o_custkey"), "placed", _named("order", "o_orderkey"))
        )
    return out


_GRAPH = """
v AS (SELECT 'region_' || r_regionkey AS id, 'region' AS type FROM region
      UNION ALL SELECT 'nation_' || n_nationkey, 'nation' FROM nation
      UNION ALL SELECT 'customer_' || c_custkey, 'customer' FROM customer
      UNION ALL SELECT 'supplier_' || s_suppkey, 'supplier' FROM supplier),
e0 AS (SELECT 'nation_' || n_nationkey AS src, 'in_region' AS type, 'region_' || n_regionkey AS dst FROM nation
      UNION ALL SELECT 'customer_' || c_custkey, 'lives_in', 'nation_' || c_nationkey FROM customer
      UNION ALL SELECT 'supplier_' || s_suppkey, 'based_in', 'nation_' || s_nationkey FROM supplier),
e AS (SELECT * FROM e0 UNION ALL SELECT 'customer_' || o_custkey, 'placed', 'order_' || o_orderkey FROM orders)
"""


@catalogue.add(
    "q45_graph_vertices_edges",
    f"""
WITH {_GRAPH}
SELECT 'vertices' AS metric, type AS name, CAST(count(*) AS DOUBLE) AS value FROM v GROUP BY type
UNION ALL SELECT 'edges', type, CAST(count(*) AS DOUBLE) FROM e GROUP BY type
UNION ALL SELECT 'density', 'all', round((SELECT count(*) FROM e)
     / (CAST((SELECT count(*) FROM v) AS DOUBLE) * ((SELECT count(*) FROM v) - 1)), 12)
""",
)
def graph_vertices_edges(spark, sf):
    return graph.graph_stats(_vertices(spark, sf), _edges(spark, sf))


@catalogue.add(
    "q46_graph_k_hop",
    f"""
WITH RECURSIVE {_GRAPH},
b AS (SELECT src AS f, dst AS t FROM e UNION ALL SELECT dst, src FROM e),
h AS (SELECT 'region_0' AS id, 0 AS hop UNION SELECT b.t, h.hop + 1 FROM h JOIN b ON b.f = h.id WHERE h.hop < 3)
SELECT id, CAST(min(hop) AS INTEGER) AS hop FROM h GROUP BY id
""",
)
def graph_k_hop(spark, sf):
    start = table(spark, sf, "region").orderBy("r_regionkey").limit(1).select(_named("region", "r_regionkey").alias("id"))
    return graph.within_hops(_edges(spark, sf), start, 3)


@catalogue.add(
    "q47_entity_merge",
    """
SELECT md5(text) AS entity, count(*) AS n_mentions, count(DISTINCT source) AS n_names,
       (array_agg(source ORDER BY n_chars DESC, doc_id))[1] AS canonical_name, min(doc_id) AS first_mention
FROM documents GROUP BY 1
""",
)
def entity_merge(spark, sf):
    mentions = table(spark, sf, "documents").select(
        content_hash(F.col("text")).alias("entity"), "source", "n_chars", "doc_id"
    )
    return graph.merge_entities(mentions, "entity", "source", F.col("n_chars"), "doc_id")


@catalogue.add(
    "q48_canonical_rename",
    """
SELECT CASE n_name WHEN 'NATION_5' THEN 'NATION_0' WHEN 'NATION_10' THEN 'NATION_0' WHEN 'NATION_7' THEN 'SEVEN' ELSE n_name END
         AS nation, count(*) AS n_customers
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
""",
)
def canonical_rename(spark, sf):
    rules = {"NATION_5": "NATION_0", "NATION_10": "NATION_0", "NATION_7": "SEVEN"}
    nations = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), graph.rename_canonical(F.col("n_name"), rules).alias("nation")
    )
    # Customers are counted per nation key first; 25 rows meet the names.
    counted = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return counted.join(nations, "c_nationkey").groupBy("nation").agg(F.sum("n").alias("n_customers"))


@catalogue.add(
    "q53_connected_components",
    """
WITH m AS (
  SELECT 'region_' || r_regionkey AS id, r_regionkey AS r FROM region
  UNION ALL SELECT 'nation_' || n_nationkey, n_regionkey FROM nation
  UNION ALL SELECT 'customer_' || c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier_' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'order_' || o_orderkey, n_regionkey
            FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT id, min(id) OVER (PARTITION BY r) AS component FROM m
""",
)
def connected_components(spark, sf):
    return graph.components(_edges(spark, sf))


@catalogue.add(
    "q54_inferred_edges",
    """
SELECT 'customer_' || c_custkey AS src, 'lives_in_region' AS type, 'region_' || n_regionkey AS dst
FROM customer JOIN nation ON c_nationkey = n_nationkey
""",
)
def inferred_edges(spark, sf):
    return graph.composed_edges(_edges(spark, sf), "lives_in", "in_region", "lives_in_region")


@catalogue.add(
    "q55_ontology_conformance",
    f"""
WITH {_GRAPH}
SELECT e.src, e.type, e.dst, s.type AS source_type, d.type AS target_type
FROM e LEFT JOIN v s ON s.id = e.src LEFT JOIN v d ON d.id = e.dst
WHERE NOT coalesce((e.type = 'in_region' AND s.type = 'nation' AND d.type = 'region')
      OR (e.type = 'lives_in' AND s.type = 'customer' AND d.type = 'nation'), false)
""",
)
def ontology_conformance(spark, sf):
    allowed = spark.createDataFrame(
        [("in_region", "nation", "region"), ("lives_in", "customer", "nation"), ("placed", "customer", "order")],
        "type string, source_type string, target_type string",
    )
    return graph.nonconforming(_edges(spark, sf), _vertices(spark, sf), allowed)


@catalogue.add(
    "q56_proposal_tally",
    """
SELECT event_type AS proposal_type, CAST(user_id AS VARCHAR) AS name, count(*) AS n, round(avg(value / 1000), 6) AS avg_confidence
FROM events GROUP BY ALL
""",
)
def proposal_tally(spark, sf):
    proposals = table(spark, sf, "events").select(
        F.col("event_type").alias("proposal_type"),
        F.col("user_id").cast("string").alias("name"),
        (F.col("value") / 1000).alias("confidence"),
    )
    return graph.tally_proposals(proposals)


@catalogue.add(
    "q70_dangling_endpoints",
    "SELECT 'order_' || o_orderkey AS endpoint, count(*) AS n_edges FROM orders GROUP BY 1",
)
def dangling_endpoints(spark, sf):
    return graph.dangling(_edges(spark, sf), _vertices(spark, sf))


@catalogue.add(
    "q71_resolve_edges",
    """
SELECT 'customer_' || o_custkey AS src, o_orderstatus AS type, o_orderpriority AS dst, count(*) AS n_statements,
       arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice
FROM orders GROUP BY 1, 2, 3
""",
)
def resolve_edges(spark, sf):
    statements = table(spark, sf, "orders").select(
        _named("customer", "o_custkey").alias("src"),
        F.col("o_orderstatus").alias("type"),
        F.col("o_orderpriority").alias("dst"),
        "o_orderkey",
        "o_totalprice",
    )
    return graph.resolve_edges(
        statements, "src", "type", "dst", F.col("o_totalprice"), "o_orderkey", ["o_orderkey", "o_totalprice"]
    )


@catalogue.add(
    "q72_provenance_stamp",
    """
SELECT event_id, 'e' || user_id AS id, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS n_mentions,
       event_type || '.txt' AS last_file, CASE WHEN event_type = 'view' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS score
FROM events
""",
)
def provenance_stamp(spark, sf):
    """Each event as an extraction with one entity; some mentions and confidences are there already."""
    kind = F.col("event_type")
    ref = F.struct(F.lit("old.txt").alias("file_name"), F.lit("old").alias("chunk_id"))
    sure = F.struct(
        F.lit(0.5).alias("score"), F.lit(False).alias("needs_review"), F.lit(None).cast("string").alias("review_reason")
    )
    entity = F.struct(
        F.concat(F.lit("e"), F.col("user_id").cast("string")).alias("id"),
        F.when(kind == "error", F.array(ref)).alias("mentions"),
        F.when(kind == "view", sure).alias("confidence"),
    )
    edge = F.struct(
        F.lit("a").alias("source_id"),
        F.lit(None).cast("struct<file_name:string,chunk_id:string>").alias("source_ref"),
        F.when(kind == "view", sure).alias("confidence"),
    )
    extracts = table(spark, sf, "events").select(
        "event_id", "event_type", F.array(entity).alias("entities"), F.array(edge).alias("relationships")
    )
    stamped = graph.stamp_provenance(
        extracts, F.concat(kind, F.lit(".txt")), F.col("event_id").cast("string")
    )
    return graph.vertices(stamped, "event_id").select(
        "event_id",
        "id",
        F.size("mentions").alias("n_mentions"),
        F.element_at("mentions", -1)["file_name"].alias("last_file"),
        F.col("confidence.score").alias("score"),
    )


@catalogue.add(
    "q73_graph_context",
    f"""
WITH RECURSIVE {_GRAPH},
b AS (SELECT src AS f, dst AS t FROM e UNION ALL SELECT dst, src FROM e),
h AS (SELECT 'region_0' AS id, 0 AS hop UNION SELECT b.t, h.hop + 1 FROM h JOIN b ON b.f = h.id WHERE h.hop < 3),
r AS (SELECT id, min(hop) AS hop FROM h GROUP BY id)
SELECT 'order_' || o_orderkey AS chunk_id, CAST(min(hop) AS INTEGER) AS hop, count(DISTINCT id) AS n_entities,
       any_value(o_orderpriority) AS o_orderpriority
FROM orders JOIN r ON r.id = 'customer_' || o_custkey GROUP BY 1
""",
)
def graph_context(spark, sf):
    reached = graph_k_hop(spark, sf)
    orders = table(spark, sf, "orders").select(
        _named("order", "o_orderkey").alias("chunk_id"), _named("customer", "o_custkey").alias("entity"), "o_orderpriority"
    )
    return graph.graph_context(
        reached, orders.select("chunk_id", "entity"), orders.select("chunk_id", "o_orderpriority"), "entity", "chunk_id"
    )


@catalogue.add(
    "q77_extraction_coverage",
    """
SELECT source, count(*) AS sections, count(l.doc_id) AS processed, round(count(l.doc_id) * 100.0 / count(*), 1) AS percentage
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source
""",
)
def extraction_coverage(spark, sf):
    sections = table(spark, sf, "documents").select("doc_id", "source")
    return graph.coverage(sections, table(spark, sf, "labels"), "source", "doc_id")
