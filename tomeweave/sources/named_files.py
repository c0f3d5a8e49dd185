"""A data source that writes every row as a file of its own, all of them or none.

Tasks write into a hidden folder beside the target and report the names in their
commit messages. Only when all tasks have ended does the driver move the files to
their names; a job that fails leaves nothing but the hidden folder, and removes that.
The folder is one that driver and executors share, as ``spark.checkpoint.dir`` is.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "name STRING, content BINARY"
FORMAT = "named_files"


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: (staged path, name)."""

    files: list[tuple[str, str]]


def local_path(path: str) -> str:
    """A path that Python can open; file: URIs lose their scheme."""
    for scheme in ("file://", "file:"):
        if path.startswith(scheme):
            return path[len(scheme) :]
    if "://" in path:
        raise ValueError(f"{path}: only a mounted folder can take single files")
    return path


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder
        self.staging = os.path.join(folder, f".staging-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        place = os.path.join(self.staging, uuid.uuid4().hex)  # a repeated task writes beside its first attempt
        os.makedirs(place, exist_ok=True)
        files = []
        for row in iterator:
            name = row["name"]
            if not name or name in (".", "..") or "/" in name or name.startswith(".staging-"):
                raise ValueError(f"not a file name: {name!r}")
            staged = os.path.join(place, str(len(files)))
            with open(staged, "wb") as file:
                file.write(row["content"] or b"")
            files.append((staged, name))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            shutil.rmtree(self.staging, ignore_errors=True)
            raise ValueError("two rows have one name")
        os.makedirs(self.folder, exist_ok=True)
        for staged, name in files:
            os.replace(staged, os.path.join(self.folder, name))
        shutil.rmtree(self.staging, ignore_errors=True)
        with open(os.path.join(self.folder, "_SUCCESS"), "wb"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class NamedFiles(DataSource):
    """Rows (name, content) as files of the folder in the option ``path``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(local_path(self.options["path"]))


def write_files(rows: DataFrame, folder: str) -> None:
    """Write (name, content) rows; files of the same names are replaced, others stay."""
    register(rows.sparkSession)
    rows.selectExpr("name", "content").write.format(FORMAT).mode("append").option("path", folder).save()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NamedFiles)
