"""A sink of text files: one Markdown file for each row, through Spark's data source interface.

    rows.write.format("markdown").mode("overwrite" or "append").save(path)        # rows (name, text)

A task writes below path/_staging, in folders by the names' hashes. The commit moves each task's folder to its place, one
move for a task; a task that fails removes its own, an aborted job all, and readers, who pass over names that start with
an underscore, see a job's files only then. With overwrite, files of earlier jobs go once the new ones are in place.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..plans.scratch import filesystem

#: Bytes of a file's name without its ending; a longer one ends in its hash.
LONGEST = 180


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


def file_name(name: str) -> str:
    """A name that every store takes: other than letters, digits and _.-~ as %XX; a long one is cut and told by its hash."""
    safe = quote(name, safe="")
    safe = "%2E" + safe[1:] if safe.startswith(".") else "%5F" + safe[1:] if safe.startswith("_") else safe
    return safe if len(safe) <= LONGEST else f"{safe[:100]}-{hashlib.sha256(name.encode()).hexdigest()}"


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        filesystem(path)[0].create_dir(self._staging(), recursive=True)  # tasks don't: one that is late finds it gone

    def _staging(self) -> str:
        return posixpath.join(filesystem(self.path)[1], "_staging", self.job)

    def write(self, iterator: Iterator) -> Written:
        store, _ = filesystem(self.path)
        folder = f"task-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}"
        own, made, n = posixpath.join(self._staging(), folder), set(), 0
        try:
            store.create_dir(own, recursive=False)
            for batch in iterator:
                for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if name is None:
                        raise ValueError("a row has no name")
                    into = posixpath.join(own, hashlib.sha256(name.encode()).hexdigest()[:2])
                    if into not in made:
                        store.create_dir(into, recursive=False)
                        made.add(into)
                    with store.open_output_stream(posixpath.join(into, f"{file_name(name)}.md")) as f:
                        f.write((text or "").encode())
                    n += 1
        except BaseException:
            with suppress(OSError):  # the job was aborted
                store.delete_dir(own)
            raise
        return Written(folder, n)

    def _drop_staging(self) -> None:
        from pyarrow import fs

        store, path = filesystem(self.path)
        top = posixpath.join(path, "_staging")
        if store.get_file_info(self._staging()).type == fs.FileType.Directory:
            store.delete_dir(self._staging())
        if store.get_file_info(top).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(top)):
            store.delete_dir(top)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, path = filesystem(self.path)
        store.create_dir(path, recursive=True)
        old = [x.path for x in store.get_file_info(fs.FileSelector(path)) if x.base_name.startswith("task-")] if self.overwrite else []
        for m in messages:
            if m is not None and m.files:
                store.move(posixpath.join(self._staging(), m.folder), posixpath.join(path, f"{m.folder}-{self.job[:8]}"))
        for x in old:
            store.delete_dir(x)
        self._drop_staging()

    def abort(self, messages: list) -> None:
        self._drop_staging()


class MarkdownSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "markdown"

    def writer(self, schema, overwrite: bool) -> Writer:
        if not {"name", "text"} <= set(schema.fieldNames()):
            raise ValueError("rows need the columns name and text")
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(MarkdownSink)
