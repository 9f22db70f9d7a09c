"""A Spark sink of files by name: images, arrays, documents, multipart streams.

Rows are (name, content).  Rows of one name that follow one another in a task are
pieces of one file, so a file may be larger than a row; ``write`` deals them so.  Tasks
write below a folder of the job; only when all have ended do the files take
their places, and a job that fails leaves nothing.  A task that is run again writes anew, and
only what the attempts that Spark accepts have reported is moved.  Paths are URIs that Arrow's
file systems know (local or shared folders, object stores, HDFS).
"""

from __future__ import annotations

import posixpath
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "name string, content binary"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def checked(name: str | None) -> str:
    """The name, which has to be a relative path that stays within its folder."""
    if not name or name.startswith("/") or posixpath.normpath(name) != name or name.startswith("..") or name.startswith("_temporary"):
        raise ValueError(f"not a name of a file: {name!r}")
    return name


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.path)
        mine = f"{root}/{self.job}/{uuid.uuid4().hex}"  # one for each attempt
        store.create_dir(mine, recursive=True)
        done, name, out = [], None, None
        try:
            for batch in iterator:
                for key, piece in zip(batch.column(0), batch.column(1)):
                    if key.as_py() != name or out is None:
                        if out is not None:
                            out.close()
                        name = checked(key.as_py())
                        done.append((f"{mine}/{len(done)}", name))
                        out = store.open_output_stream(done[-1][0])
                    if piece.is_valid:
                        out.write(piece.as_buffer())
        finally:
            if out is not None:
                out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        files = [f for m in messages if m for f in m.files]
        twice = [name for name, n in Counter(name for _, name in files).items() if n > 1]
        if twice:
            self.abort(messages)
            raise ValueError(f"rows of one file lie apart: {twice[0]}")
        if self.overwrite:
            for found in store.get_file_info(fs.FileSelector(root)):
                if not found.base_name.startswith("_temporary-"):
                    store.delete_dir(found.path) if found.type == fs.FileType.Directory else store.delete_file(found.path)
        for made in {posixpath.dirname(f"{root}/{name}") for _, name in files}:
            store.create_dir(made, recursive=True)
        for begun, name in files:
            store.move(begun, f"{root}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = opened(self.path)
        if store.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.job}")


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite)


def write(files: DataFrame, path: str, mode: str = "append", order: list[str] | None = None) -> None:
    """Writes (name, content) as files below ``path``; pieces of one file are taken in ``order``.

    ``overwrite`` drops what was there; ``append`` replaces files of the same names only.
    """
    files.sparkSession.dataSource.register(NamedFiles)
    if order:
        files = files.repartition("name").sortWithinPartitions("name", *order)
    files.select("name", F.col("content").cast("binary").alias("content")).write.format("named_files").mode(mode).save(path)
