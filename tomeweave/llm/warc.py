"""A content-addressed web archive.

Two tables make an archive. ``payloads`` holds the bytes of every distinct
payload once, under its SHA-256. ``headers`` holds the exact header block of
every record. Original records come back by joining the two on the digest,
which is computed anew from the stored bytes and compared on every read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"  # digits of base 32 as conv() writes them
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # RFC 4648


def sha1_base32(payload: Column) -> Column:
    """Upper-case base-32 SHA-1: 40 bits, so 10 hex digits, make 8 letters at a time."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), BASE32_HEX, BASE32)


def write_archive(
    pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
    id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
) -> None:
    """Write one record per row of ``pages`` below ``path``.

    Of the records with equal payloads of at least ``min_bytes`` bytes the one
    with the smallest id is a response, the others are revisits of it; smaller
    payloads are all responses. A null payload is an empty one, a null URL gives
    no target header, rows that share both the smallest id and the payload are
    all responses, and a null id is larger than any other. Other columns are ignored.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")
    ).withColumn("address", F.sha2("payload", 256))
    # Copies fold together before the shuffle: a payload leaves each task once.
    rows.groupBy("address").agg(F.min("id").alias("first_id"), F.first("payload").alias("payload")).write.parquet(
        f"{path}/payloads"
    )
    stored = pages.sparkSession.read.parquet(f"{path}/payloads").select("address", "first_id")
    records = rows.select(
        "id", "url", "address", F.octet_length("payload").alias("n"), sha1_base32(F.col("payload")).alias("sha1")
    ).join(stored, "address")
    is_first = F.col("id").eqNullSafe(F.col("first_id")) | (F.col("n") < min_bytes)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    safe_url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [
        F.lit(VERSION),
        line("WARC-Type", F.when(is_first, "response").otherwise("revisit")),
        line("WARC-Record-ID", urn("id")),
        F.lit(f"WARC-Date: {date}"),
        line("WARC-Target-URI", safe_url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        line("X-Payload-Address", F.concat(F.lit("sha256:"), "address")),
        line("X-Payload-Length", F.col("n").cast("string")),
        F.when(~is_first, line("WARC-Refers-To", urn("first_id"))),
        F.when(~is_first, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        line("Content-Length", F.when(is_first, F.col("n")).otherwise(0).cast("string")),
    ]
    header = F.concat(F.array_join(F.array_compact(F.array(*lines)), "\r\n"), F.lit("\r\n\r\n"))
    records.select(header.alias("header")).write.parquet(f"{path}/headers")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The records' headers, exact and taken apart."""
    field = lambda name, value: F.nullif(
        F.regexp_extract("header", f"(?dm)^{name}: {value}\\r$", 1), F.lit("")
    )
    return spark.read.schema("header string").parquet(f"{path}/headers").select(
        "header",
        field("WARC-Type", "(\\w+)").alias("record_type"),
        field("WARC-Record-ID", "<urn:page:(-?\\d*)>").cast("bigint").alias("page_id"),
        field("WARC-Refers-To", "<urn:page:(-?\\d*)>").cast("bigint").alias("refers_to"),
        field("WARC-Payload-Digest", "sha1:(\\w+)").alias("sha1"),
        field("X-Payload-Address", "sha256:(\\w+)").alias("address"),
        field("X-Payload-Length", "(\\d+)").cast("bigint").alias("n_bytes"),
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads; reading one whose bytes do not give its address fails."""
    stored = spark.read.schema("address string, payload string").parquet(f"{path}/payloads")
    same = F.sha2("payload", 256) == F.col("address")
    wrong = F.raise_error(F.concat(F.lit("payload does not match its digest "), "address")).cast("string")
    return stored.select("address", F.when(same, F.col("payload")).otherwise(wrong).alias("payload"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, checked against the stored bytes without moving them."""
    stored = read_payloads(spark, path).select(
        "address", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        sha1_base32(F.col("payload")).alias("payload_digest"),
    )
    found = read_headers(spark, path).join(stored, "address", "left")
    agrees = (F.col("payload_digest") == F.col("sha1")) & (F.col("payload_bytes") == F.col("n_bytes"))
    wrong = F.raise_error(F.concat(F.lit("no such payload for "), "header")).cast("string")
    return found.select(
        "page_id", "payload_bytes", F.when(agrees, F.col("payload_digest")).otherwise(wrong).alias("payload_digest"),
        "record_type", "refers_to",
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every record as it would stand in an archive file, and the full payload it stands for."""
    found = read_headers(spark, path).join(read_payloads(spark, path), "address", "left")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise("")
    return found.select(
        "page_id", "record_type", "refers_to", "header", "payload",
        F.concat("header", block, F.lit("\r\n\r\n")).alias("record"),
    )
