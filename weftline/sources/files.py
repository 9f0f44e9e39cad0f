"""Whole files of ordered parts: a data source whose writer puts the rows of a file, in order, into one file, and which leaves
either all files or none."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def file_system(path: str):  # noqa: ANN201
    """Arrow's file system for a path or address, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + unquote(path.removeprefix("file:")).lstrip("/")
    return fs.FileSystem.from_uri(path)


class Written(WriterCommitMessage):
    """What a task has written: temporary names and names to be."""

    def __init__(self, files: list[tuple[str, str]]) -> None:
        self.files = files


class FilesWriter(DataSourceArrowWriter):
    """Rows ``(file, value)`` to files of a folder; a task's rows of a file stand together, in order. Each task writes under hidden names
    of its own; only when all have ended are they given their names, and when one fails all are deleted."""

    def __init__(self, folder: str) -> None:
        self.folder, self.run = folder, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, top = file_system(self.folder)
        store.create_dir(top, recursive=True)
        task = TaskContext.get()
        own = f"{task.partitionId()}-{task.taskAttemptId()}" if task else uuid.uuid4().hex
        done: list[tuple[str, str]] = []
        out, current = None, None
        try:
            for batch in iterator:
                names, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for name, value in zip(names, values, strict=True):
                    if out is None or name != current:
                        if out is not None:
                            out.close()
                        if name is None or "/" in name or name.startswith(".") or any(f"{top}/{name}" == final for _, final in done):
                            raise ValueError(f"{name} is no name for a file, or its rows do not stand together")
                        current = name
                        done.append((f"{top}/.{self.run}.{own}.{len(done)}", f"{top}/{name}"))
                        out = store.open_output_stream(done[-1][0])
                    if value is not None:
                        out.write(value)
        except BaseException:
            if out is not None:
                out.close()
            for temporary, _ in done:
                store.delete_file(temporary)
            raise
        if out is not None:
            out.close()
        return Written(done)

    def commit(self, messages: list) -> None:
        files = [f for m in messages if m for f in m.files]
        names = [final for _, final in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two tasks have rows of one file")
        store, _ = file_system(self.folder)
        for temporary, final in files:
            store.move(temporary, final)

    def abort(self, messages: list) -> None:
        store, top = file_system(self.folder)
        from pyarrow import fs

        for m in messages:
            for temporary, _ in m.files if m else []:
                if store.get_file_info(temporary).type != fs.FileType.NotFound:
                    store.delete_file(temporary)


class WholeFiles(DataSource):
    """``whole_files``: rows ``(file string, value binary)`` written to the folder that ``path`` names."""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "file string, value binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:  # noqa: ANN001
        return FilesWriter(self.options["path"])


class Part(NamedTuple):
    """What ``write_whole`` asks of its rows."""

    file: str = "file"
    order: tuple[str, ...] = ("ord",)
    value: str = "value"


def write_whole(rows: DataFrame, folder: str, part: Part = Part(), lines: bool | None = None) -> None:
    """Write ``rows``, each a part ``value`` of ``file``, in ``order``: one file for each name in ``folder``. Text parts are lines (``lines``: an end of line
    goes behind each), binary ones stand as they are; a null part is nothing. Files of these names are replaced.

    The rows of a file are sorted on the way to its task, which streams them: a file, being one, is one task's work, and a task holds one batch
    of it. If a task fails no file is there; a task that is done again replaces what it wrote."""
    value = F.col(part.value)
    text = rows.schema[part.value].dataType.typeName() == "string"
    if text if lines is None else lines:
        value = F.concat(value.cast("string"), F.lit("\n"))
    rows = rows.select(F.col(part.file).cast("string").alias("file"), *(F.col(c).alias(f"_o{k}") for k, c in enumerate(part.order)), value.cast("binary").alias("value"))
    spark = rows.sparkSession
    spark.dataSource.register(WholeFiles)
    order = [f"_o{k}" for k in range(len(part.order))]
    rows.repartition("file").sortWithinPartitions("file", *order).select("file", "value").write.format("whole_files").option("path", folder).mode("append").save()
