"""The usage ledger, request quotas and retry rules over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeweave.functions import times
from tomeweave.functions.policy import backoff_seconds, error_class
from tomeweave.operators import limits
from tomeweave.plans.base import Catalogue, event_micros, event_tokens, table
from tomeweave.streaming import jobs

catalogue = Catalogue()

_USAGE = """
WITH u AS (SELECT coalesce(nullif(event_type, 'view'), 'unknown') AS model,
                  CAST(json_extract_string(props, '$.k') AS BIGINT) AS t FROM events)
SELECT model, count(*) AS requests, CAST(sum(t) AS BIGINT) AS tokens FROM u GROUP BY model
UNION ALL SELECT '(all)', count(*), CAST(sum(t) AS BIGINT) FROM u
"""


def _model():
    return F.nullif(F.col("event_type"), F.lit("view"))


@catalogue.add("q39_usage_rollup", _USAGE)
def usage_rollup(spark, sf):
    return limits.usage_summary(table(spark, sf, "events"), _model(), event_tokens())


_WINDOWS = """
w AS (
  SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS t, epoch_us(ts) AS us FROM events),
a AS (
  SELECT event_id, event_type, t,
         count(*) OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS minute_requests,
         count(*) OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS day_requests,
         CAST(sum(t) OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS BIGINT)
           AS minute_tokens
  FROM w)
"""


@catalogue.add(
    "q40_rate_window_audit",
    f"""
WITH {_WINDOWS}
SELECT event_id, event_type, minute_requests, day_requests, minute_tokens,
       CASE WHEN day_requests - 1 >= 80 THEN 'refuse' WHEN minute_requests - 1 >= 1 THEN 'wait_requests'
            WHEN minute_tokens > 90 THEN 'wait_tokens' ELSE 'admit' END AS decision
FROM a
""",
)
def rate_window_audit(spark, sf):
    requests = table(spark, sf, "events").select(
        "event_id", "event_type", event_micros().alias("micros"), event_tokens().alias("tokens")
    )
    audit = limits.quota_audit(
        requests, "event_type", "micros", "event_id", F.col("tokens"), rpm=1, rpd=80, tpm=90
    )
    return audit.drop("micros", "tokens")


@catalogue.add(
    "q42_error_backoff",
    """
WITH m AS (
  SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'HTTP ' || (405 + CAST(json_extract_string(props, '$.k') AS BIGINT))
           WHEN 1 THEN 'Resource Exhausted' WHEN 2 THEN 'Deadline passed' ELSE event_type END AS message,
         user_id % 5 + 1 AS attempt FROM events),
k AS (SELECT *, CASE WHEN contains(message, '429') OR contains(message, 'Exhausted') THEN 'rate_limit'
              WHEN contains(message, '503') OR contains(message, 'Deadline') THEN 'transient' ELSE 'other' END AS kind FROM m)
SELECT event_id, kind, CASE WHEN kind = 'rate_limit' THEN greatest(2.0 * pow(2, attempt - 1), 60.0)
       ELSE 2.0 * pow(2, attempt - 1) END AS backoff FROM k
""",
)
def error_backoff(spark, sf):
    kind = F.col("user_id") % 4
    message = (
        F.when(kind == 0, F.concat(F.lit("HTTP "), (405 + event_tokens()).cast("string")))
        .when(kind == 1, "Resource Exhausted")
        .when(kind == 2, "Deadline passed")
        .otherwise(F.col("event_type"))
    )
    rows = table(spark, sf, "events").select(
        "event_id", error_class(message).alias("kind"), (F.col("user_id") % 5 + 1).alias("attempt")
    )
    return rows.select("event_id", "kind", backoff_seconds(F.col("kind"), F.col("attempt")).alias("backoff"))


@catalogue.add("q49_usage_stream", _USAGE)
def usage_stream(spark, sf):
    arrived = jobs.file_stream(spark, sf, table(spark, sf, "events"), "events.parquet")
    return jobs.accumulate_usage(arrived, _model(), event_tokens())


@catalogue.add(
    "q50_limiter_stream",
    f"""
WITH {_WINDOWS}
SELECT event_id, event_type, CASE WHEN minute_requests - 1 >= 1 THEN 'wait_requests'
       WHEN minute_tokens > 90 THEN 'wait_tokens' ELSE 'admit' END AS decision
FROM a
""",
)
def limiter_stream(spark, sf):
    arrived = jobs.file_stream(spark, sf, table(spark, sf, "events"), "events.parquet")
    requests = arrived.select(
        "event_id", "event_type", event_micros().alias("micros"), event_tokens().alias("tokens")
    )
    decided = jobs.limit_requests(
        requests, "event_type", "event_id", "micros", "tokens", jobs.Quota(rpm=1, rpd=1_000_000, tpm=90)
    )
    return jobs.run_to_table(decided, "limiter").select("event_id", "event_type", "decision")


@catalogue.add(
    "q61_capable_models",
    """
SELECT p_partkey, p_name FROM part
WHERE list_contains(string_split(p_type || ' ' || p_brand, ' '), 'ECONOMY') AND contains(p_name, 'ring') ORDER BY p_name
""",
)
def capable_models(spark, sf):
    models = table(spark, sf, "part").select(
        "p_partkey", "p_name", F.split(F.concat_ws(" ", "p_type", "p_brand"), " ").alias("actions")
    )
    return limits.capable_models(models, "p_name", "actions", "ECONOMY", "ring").drop("actions")


@catalogue.add(
    "q76_time_formats",
    """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso, round(epoch_us(ts) / 1000000.0, 6) AS epoch,
       true AS round_trip, round((epoch_us(ts) - 1704067200000000) / 1000000.0, 6) AS elapsed
FROM events
""",
)
def time_formats(spark, sf):
    ts = F.col("ts").cast("timestamp")
    iso = times.to_iso(ts)
    start = F.timestamp_micros(F.lit(1_704_067_200_000_000))
    return table(spark, sf, "events").select(
        "event_id",
        iso.alias("iso"),
        F.round(times.to_epoch(ts), 6).alias("epoch"),
        ((times.from_iso(iso) == ts) & (F.unix_micros(times.from_epoch(F.lit(5))) == 5_000_000)).alias("round_trip"),
        F.round(times.elapsed_seconds(start, ts), 6).alias("elapsed"),
    )
