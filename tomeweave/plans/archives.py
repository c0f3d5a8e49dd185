"""Section files and book archives, written from the given tables and read back."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from tomeweave.operators import packing
from tomeweave.plans.base import Catalogue, table
from tomeweave.session import scratch_path
from tomeweave.sources import files
from tomeweave.sources.named_files import write_files

catalogue = Catalogue()


@catalogue.add(
    "q90_section_files",
    """
WITH d AS (SELECT source AS series, doc_id, text, length(text) // 4 + CASE WHEN length(text) % 4 > 0 THEN 1 ELSE 0 END AS tokens FROM documents WHERE length(text) > 0)
SELECT series, count(*) AS n_documents, sum(length(text))::BIGINT AS characters, 'ok' AS status FROM d GROUP BY 1
""",
)
def section_files(spark, sf):
    """Documents packed into sections, each a text and a metadata file, read back and counted by what was put in."""
    docs = table(spark, sf, "documents").select(F.col("source").alias("series"), "doc_id", "text", F.col("doc_id").cast("string").alias("book"))
    # No document is above this budget, so a section is its documents with blank lines between.
    packed = packing.sections(docs, "series", "doc_id", "book", 200_000)
    folder = scratch_path(spark, "section-files")
    files.write_section_files(packed, folder, 222_222, 0.1)
    found = files.section_files(spark, folder, "*")
    whole = F.length("text_content") - 2 * (F.size("included_books") - 1)
    return found.groupBy("series", "status").agg(F.sum(F.size("included_books")).cast("bigint").alias("n_documents"), F.sum(whole).cast("bigint").alias("characters")).select(
        "series", "n_documents", "characters", "status"
    )


def _archive(rows: pa.Table) -> pa.Table:
    """One book: its pages in a zip, in the order of their ids; a host's pages bound it."""
    rows = rows.sort_by("page_id")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for page, html in zip(rows["page_id"].to_pylist(), rows["html"].to_pylist(), strict=True):
            book.writestr(f"page{page}.xhtml", html or "")
    return pa.table({"name": [f"{rows['book'][0].as_py()}.epub"], "content": pa.array([out.getvalue()], pa.binary())})


@catalogue.add(
    "q91_archive_scan",
    """
WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, html FROM pages)
SELECT host || '/' || (page_id // 50) AS book, 'page' || page_id || '.xhtml' AS entry, (row_number() OVER (PARTITION BY host, page_id // 50 ORDER BY page_id) - 1)::INT AS at,
       md5(coalesce(html, '')) AS html_md5
FROM p
""",
)
def archive_scan(spark, sf):
    """Pages bound into archives by host, fifty ids a book; read back entry by entry."""
    pages = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), "html")
    pages = pages.withColumn("book", F.concat(F.col("host"), F.lit("~"), F.floor(F.col("page_id") / 50).cast("string")))
    books = pages.groupBy("book").applyInArrow(_archive, "name string, content binary")
    folder = scratch_path(spark, "books")
    write_files(books, folder)
    entries = files.book_entries(files.book_listing(spark, folder))
    name = F.replace(F.regexp_extract(F.url_decode("path"), "([^/]+)[.]epub$", 1), F.lit("~"), F.lit("/"))
    return entries.select(name.alias("book"), "entry", "at", F.md5("html").alias("html_md5"))
