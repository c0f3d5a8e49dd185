"""Readers and writers of books, sections, extracts and ontologies."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tomeweave import schemas
from tomeweave.constants import SERIES_FOLDERS, SERIES_ONTOLOGY
from tomeweave.functions.text import is_blank, slugify
from tomeweave.scale import broadcast_if_small, once, row_index
from tomeweave.sources.named_files import write_files

BOOK_FILES = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


# ----------------------------------------------------------------------- books
class _VisibleText(HTMLParser):
    """Collects text nodes; script and style bodies are not text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self._hidden = 0
        self._open = ""

    def _settle(self) -> None:
        if self._open.strip():
            self.parts.append(self._open.strip())
        self._open = ""

    def handle_starttag(self, tag, attrs):
        self._settle()
        self._hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self._settle()
        if tag in ("script", "style"):
            self._hidden = max(0, self._hidden - 1)

    def handle_comment(self, data):
        self._settle()

    def handle_decl(self, decl):
        self._settle()

    def handle_data(self, data):
        if not self._hidden:
            self._open += data

    def close(self):
        super().close()
        self._settle()


def page_text(html: str) -> str:
    parser = _VisibleText()
    parser.feed(html)
    parser.close()
    return " ".join(parser.parts)


def _document_names(book: zipfile.ZipFile) -> list[str]:
    """XHTML items in manifest order; archives without a manifest give their names in order."""
    names = book.namelist()
    package = next((n for n in names if n.endswith(".opf")), None)
    if package is None:
        return [n for n in names if n.lower().endswith((".xhtml", ".html", ".htm"))]
    base = posixpath.dirname(package)
    items = [e for e in ElementTree.fromstring(book.read(package)).iter() if e.tag.endswith("}item") or e.tag == "item"]
    hrefs = [unquote(e.get("href", "")) for e in items if e.get("media-type") == "application/xhtml+xml"]
    return [posixpath.normpath(posixpath.join(base, h)) for h in hrefs]


def book_text(content: bytes) -> str | None:
    """Text of an e-book archive, its items joined by blank lines; None when it cannot be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            texts = [page_text(book.read(n).decode("utf-8", "replace")) for n in _document_names(book)]
        return "\n\n".join(t for t in texts if t)
    except Exception:
        return None


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def book_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """The ``.epub`` files of a folder; an absent folder has none."""
    if not _path_exists(spark, folder):
        return spark.createDataFrame([], BOOK_FILES)
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.epub")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(folder)
    )


def book_listing(spark: SparkSession, folder: str, nested: bool = False) -> DataFrame:
    """The ``.epub`` files of exactly one level: ``folder/*.epub``, or with ``nested`` ``folder/*/*.epub`` and no other.

    An absent folder, and one without such files, has none.
    """
    pattern = f"{folder.rstrip('/')}/{'*/' if nested else ''}*.epub"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(target)
    if found is None or not any(status.isFile() for status in found):
        return spark.createDataFrame([], BOOK_FILES)
    return spark.read.format("binaryFile").load(pattern)


def series_files(spark: SparkSession, root: str, series: str) -> DataFrame:
    """All books of a series below its folder."""
    folder = SERIES_FOLDERS.get(series.lower())
    if folder is None:
        raise ValueError(f"no folder is known for the series {series!r}; there are {sorted(SERIES_FOLDERS)}")
    path = f"{root.rstrip('/')}/{folder}"
    if not _path_exists(spark, path):
        raise FileNotFoundError(f"the books of {series!r} should be in {path}, which does not exist")
    return book_files(spark, path)


def books(files: DataFrame, nested: bool = False) -> DataFrame:
    """(path, book_name, text). Nested scans name a book ``{folder}_{file}`` and keep the suffix.

    An archive that cannot be read has a null text; ``unreadable`` lists these.
    """

    @F.pandas_udf(T.StringType())
    def extract(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in contents:
            yield batch.map(book_text)

    file_name = F.regexp_extract("path", r"([^/]+)$", 1)
    name = (
        F.concat_ws("_", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), file_name)
        if nested
        else F.replace(file_name, F.lit(".epub"), F.lit(""))
    )
    return files.select("path", name.alias("book_name"), extract("content").alias("text"))


_KINDS = {"path": T.StringType(), "at": T.IntegerType(), "entry": T.StringType(), "html": T.BinaryType(), "error": T.StringType()}
ENTRY = T.StructType([T.StructField(name, kind) for name, kind in _KINDS.items()])


def book_entries(files: DataFrame) -> DataFrame:
    """(path, at, entry, html, error): the documents of every archive as rows, in reading order.

    An archive is opened once and gives its documents one by one, so what follows
    can be spread over tasks however large one book is. One that cannot be opened, and a
    document that cannot be read, is a row with the error instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in _entries(path, content.as_buffer()):
                    yield pa.RecordBatch.from_pylist([row], schema=to_arrow_schema(ENTRY))

    return files.select("path", "content").mapInArrow(run, ENTRY)


def _entries(path: str, content) -> Iterator[dict]:
    row = {"path": path, "at": None, "entry": None, "html": None, "error": None}
    try:
        book = zipfile.ZipFile(pa.BufferReader(content))
        names = _document_names(book)
    except Exception as error:
        yield row | {"error": f"{type(error).__name__}: {error}"}
        return
    for at, name in enumerate(names):
        try:
            yield row | {"at": at, "entry": name, "html": book.read(name)}
        except Exception as error:
            yield row | {"at": at, "entry": name, "error": f"{type(error).__name__}: {error}"}


def entry_texts(entries: DataFrame) -> DataFrame:
    """(path, at, entry, text): visible text of every document that could be read."""

    @F.pandas_udf(T.StringType())
    def visible(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield batch.map(lambda html: page_text(bytes(html).decode("utf-8", "replace")))

    good = entries.where(F.col("error").isNull())
    return good.repartition("path", "at").select("path", "at", "entry", visible("html").alias("text"))


def rejected(entries: DataFrame) -> DataFrame:
    """(path, entry, error) of archives and documents that could not be read."""
    return entries.where(F.col("error").isNotNull()).select("path", "entry", "error")


def unreadable(found: DataFrame) -> DataFrame:
    """(path, book_name) of books whose archive could not be read."""
    return found.where(F.col("text").isNull()).select("path", "book_name")


def ordered_books(files: DataFrame, nested: bool = False) -> DataFrame:
    """Books with ``book_order``, their 0-based place in path order; paths are listed, not contents."""
    order = row_index(files.select("path"), [], ["path"], "book_order")
    return books(files, nested).join(broadcast_if_small(order), "path")


# --------------------------------------------------------- sections and extracts
def section_texts(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """(path, section_id, text) of ``{prefix}_section_*.txt``, whole files, by path."""
    rows = spark.read.option("pathGlobFilter", f"{prefix}_section_*.txt").text(folder, wholetext=True)
    return rows.select(
        F.col("_metadata.file_path").alias("path"),
        F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("section_id"),
        F.col("value").alias("text"),
    ).orderBy("path")


def write_sections(sections: DataFrame, folder: str) -> None:
    """Sections as JSON rows, partitioned by series; blank sections are already gone."""
    sections.write.mode("overwrite").partitionBy("series").json(folder)


def write_section_files(sections: DataFrame, folder: str, context_window: int, safety_margin: float) -> None:
    """A text file and a metadata file for every section that is not blank, all or none of them.

    ``sections`` are rows of ``packing.sections``; the metadata has what a row of the
    ``graph_chunks`` table needs.
    """
    kept = sections.where(~is_blank(F.col("text_content")))
    meta = F.to_json(
        F.struct(
            "chunk_id", "series", "text_content", "token_count", "character_count", F.lit(context_window).cast("bigint").alias("context_window_used"),
            F.lit(safety_margin).alias("safety_margin"), "included_books", F.current_timestamp().alias("created_at"),
        )
    )
    file = lambda suffix, text: F.struct(F.concat("chunk_id", F.lit(suffix)).alias("name"), F.encode(text, "UTF-8").alias("content"))
    both = F.array(file(".txt", F.col("text_content")), file(".meta.json", meta))
    write_files(kept.select(F.explode(once(both)).alias("f")).select("f.name", "f.content"), folder)


def section_files(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """Rows of ``graph_chunks`` from section files, with ``status``: ``ok``, or what is missing or differs.

    The text is that of the text file where there is one.
    """
    texts = section_texts(spark, folder, prefix).select(F.col("section_id").alias("chunk_id"), F.col("text").alias("_text"))
    shape = T.StructType([f for f in schemas.struct_of("graph_chunks").fields if f.name != "updated_at"])
    meta = spark.read.schema(shape).option("multiLine", True).option("pathGlobFilter", f"{prefix}_section_*.meta.json").json(folder)
    joined = meta.join(texts, "chunk_id", "full_outer")
    status = (
        F.when(F.col("_text").isNull(), "no text file").when(F.col("series").isNull(), "no metadata file")
        .when(F.col("_text") != F.col("text_content"), "texts differ").otherwise("ok")
    )
    return joined.withColumn("status", status).withColumn("text_content", F.coalesce("_text", "text_content")).drop("_text")


def extracts(spark: SparkSession, folder: str) -> DataFrame:
    """Extraction result files, one row per file, with ``file_name`` and ``section_id``."""
    rows = spark.read.schema(T.StructType.fromDDL(schemas.EXTRACTION_FILE)).option("multiLine", True).option(
        "pathGlobFilter", "*.json"
    ).json(folder)
    return rows.select(
        F.col("_metadata.file_name").alias("file_name"),
        F.regexp_replace(F.col("_metadata.file_name"), r"_extracted\.json$", "").alias("section_id"),
        "*",
    )


def ontologies(spark: SparkSession, folder: str) -> DataFrame:
    return (
        spark.read.schema(T.StructType.fromDDL(schemas.ONTOLOGY_FILE))
        .option("multiLine", True)
        .option("pathGlobFilter", "*.json")
        .json(folder)
        .withColumn("file_name", F.col("_metadata.file_name"))
    )


def series_settings(spark: SparkSession) -> DataFrame:
    """(series, ontology, prefix): fixed rows."""
    rows = [(k, *v) for k, v in SERIES_ONTOLOGY.items()]
    return spark.createDataFrame(rows, "series string, ontology string, prefix string")


def with_settings(df: DataFrame, series: str) -> DataFrame:
    """Ontology file and section prefix of each row's series; unlisted series get both from their own name."""
    known = series_settings(df.sparkSession).withColumnRenamed("series", "_series")
    own = F.col(series)
    return (
        df.join(F.broadcast(known), own == F.col("_series"), "left")
        .withColumn("ontology_file", F.concat(slugify(F.coalesce("ontology", own)), F.lit("_schema.json")))
        .withColumn("prefix", F.coalesce("prefix", slugify(own)))
        .drop("_series", "ontology")
    )


def pending_sections(sections: DataFrame, done: DataFrame) -> DataFrame:
    """Sections without an extraction file."""
    return sections.join(done.select("section_id").distinct(), "section_id", "left_anti")
