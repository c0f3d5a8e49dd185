"""Tables by key bucket, joins with a stored side, a ledger that resumes, and nested JSON fields."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tomeweave.functions import jsonfields
from tomeweave.operators import layout
from tomeweave.plans.base import Catalogue, event_tokens, table
from tomeweave.session import scratch_path
from tomeweave.streaming import jobs

catalogue = Catalogue()

_CUSTOMERS = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, created_at TIMESTAMP, updated_at TIMESTAMP"


def _merged(spark, sf):
    """Customers as stored; orders set the balance, later ones win; suppliers come in as new customers; one nation goes."""
    stored = layout.KeyedTable(spark, scratch_path(spark, "customers"), _CUSTOMERS, ["c_custkey"], 16)
    loaded = stored.merge(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"))
    paid = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.lit(None).cast("string").alias("c_name"), F.lit(None).cast("int").alias("c_nationkey"),
        F.col("o_totalprice").alias("c_acctbal"), F.array(F.lit("c_acctbal")).alias("__set"), F.col("o_orderkey").alias("__seq"),
    )
    new = table(spark, sf, "supplier").select(
        (-1 - F.col("s_suppkey")).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"),
        F.col("s_acctbal").alias("c_acctbal"), F.array(F.lit("c_name"), F.lit("c_nationkey"), F.lit("c_acctbal")).alias("__set"), F.lit(0).cast("bigint").alias("__seq"),
    )
    changed = stored.merge(paid.unionByName(new))
    gone = stored.delete(F.col("c_nationkey") == 3)
    return stored, loaded, changed, gone


_TABLE = """
paid AS (SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) AS bal FROM orders GROUP BY 1),
every AS (SELECT c_custkey AS k, c_name AS name, c_nationkey AS n, coalesce(bal, c_acctbal) AS bal FROM customer LEFT JOIN paid ON k = c_custkey
          UNION ALL SELECT k, NULL, NULL, bal FROM paid WHERE k NOT IN (SELECT c_custkey FROM customer)
          UNION ALL SELECT -1 - s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier)
"""


@catalogue.add(
    "q85_merge_counts",
    f"""
WITH {_TABLE}
SELECT (SELECT count(*) FROM customer) AS loaded,
       (SELECT count(*) FROM supplier) + (SELECT count(*) FROM paid WHERE k NOT IN (SELECT c_custkey FROM customer)) AS inserted,
       (SELECT count(*) FROM paid WHERE k IN (SELECT c_custkey FROM customer)) AS modified,
       (SELECT count(*) FROM every WHERE n = 3) AS deleted
""",
)
def merge_counts(spark, sf):
    _, loaded, changed, gone = _merged(spark, sf)
    numbers = {"loaded": loaded.inserted, "inserted": changed.inserted, "modified": changed.modified, "deleted": gone.deleted}
    return spark.range(1).select(*[F.lit(v).cast("bigint").alias(k) for k, v in numbers.items()])


@catalogue.add(
    "q86_merged_table",
    f"WITH {_TABLE} SELECT k AS c_custkey, name AS c_name, n AS c_nationkey, bal AS c_acctbal FROM every WHERE n IS DISTINCT FROM 3",
)
def merged_table(spark, sf):
    return _merged(spark, sf)[0].read().select("c_custkey", "c_name", "c_nationkey", "c_acctbal")


@catalogue.add(
    "q87_cache_by_hash_and_model",
    """
WITH cache AS (SELECT md5(text) AS text_hash, source AS model, min(doc_id) AS vector_id FROM documents GROUP BY ALL)
SELECT d.doc_id, vector_id, vector_id IS NOT NULL AS cached
FROM documents d LEFT JOIN cache ON text_hash = md5(d.text) AND model = 'src' || (d.doc_id % 20)
""",
)
def cache_by_hash_and_model(spark, sf):
    docs = table(spark, sf, "documents")
    cache = docs.groupBy(F.md5("text").alias("text_hash"), F.col("source").alias("model")).agg(F.min("doc_id").alias("vector_id"))
    stored = layout.sorted_buckets(cache, f"cache_{uuid.uuid4().hex}", scratch_path(spark, "cache"), ["text_hash", "model"], 16)
    asked = docs.select("doc_id", F.md5("text").alias("text_hash"), F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("model"))
    found = layout.join_stored(asked, stored, ["text_hash", "model"])
    return found.select("doc_id", "vector_id", F.col("vector_id").isNotNull().alias("cached"))


@catalogue.add(
    "q88_resumed_ledger",
    """
SELECT coalesce(event_type, 'unknown') AS model, count(*) AS requests, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens
FROM events GROUP BY 1
UNION ALL SELECT '(all)', count(*), CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) FROM events
""",
)
def resumed_ledger(spark, sf):
    """Events arrive in two loads; each is drained by a stream of its own over the same output and checkpoint."""
    events = table(spark, sf, "events").select("event_id", "event_type", "props", "value")
    source, out, state = (scratch_path(spark, f"ledger-{n}") for n in ("in", "out", "state"))
    for load in (F.col("value") < 50, ~F.coalesce(F.col("value") < 50, F.lit(False))):
        events.where(load).write.mode("append").parquet(source)
        ledger = jobs.accumulate_usage(jobs.file_stream(spark, source, events, files_per_trigger=2), F.col("event_type"), event_tokens(), out, state)
    return ledger


@catalogue.add(
    "q89_nested_json_fields",
    """
SELECT event_id, '{"bad":"{k ' || event_type || '","list":[{"props":' || replace(props, ' ', '') || '},' || to_json(props) || '],"props":' || replace(props, ' ', '') || '}' AS value,
       2 AS n_parsed
FROM events
""",
)
def nested_json_fields(spark, sf):
    quoted = lambda text: F.expr(f"substr(to_json(array({text})), 2, length(to_json(array({text}))) - 2)")
    props = quoted("props")
    # The list holds an object with the field, and the bare string.
    whole = F.concat(
        F.lit('{"props":'), props, F.lit(',"bad":'), quoted("concat('{k ', event_type)"), F.lit(',"list":[{"props":'), props, F.lit("},"), props, F.lit("]}"),
    )
    rows = table(spark, sf, "events").select("event_id", F.parse_json(whole).alias("value"))
    return jsonfields.parse_nested(rows, "event_id", "value").select("event_id", F.to_json("value").alias("value"), "n_parsed")
