"""Folders for tables that outlive one plan."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_MADE: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new place below spark.checkpoint.dir, a folder or URI that the driver and all executors see. Where that is unset, a
    local master gets a temporary folder, once for each session, and a cluster an error. Deleted at the driver's end."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spindrift-")
        spark.conf.set("spark.checkpoint.dir", root)
    _MADE.append(f"{root.rstrip('/')}/spindrift-{uuid.uuid4().hex}")
    return _MADE[-1]


def filesystem(uri: str):
    """The store of a URI or path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("/", "file:")) else os.path.abspath(uri))


@atexit.register
def clear() -> None:
    while _MADE:
        try:
            store, path = filesystem(_MADE.pop())
            store.delete_dir(path)
        except OSError:
            pass  # never written, or gone with its store
