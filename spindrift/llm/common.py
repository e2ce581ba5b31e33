"""Helpers that the operators of this subpackage share: scratch tables, size-checked broadcasts, shared array files."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z and nothing else.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def text_of(name: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only, in the JVM."""
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors see.

    Where the setting is absent (local tests) a temporary folder is made once and set for the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spindrift-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/spindrift/{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


_SCRATCH: list[str] = []


@atexit.register
def clear_scratch() -> None:
    """Deletes the folders that this driver has made, at its end or when its results are written: lazy results read them."""
    while _SCRATCH:
        try:
            fs, path = filesystem(_SCRATCH.pop())
            fs.delete_dir(path)
        except OSError:
            pass  # never written, or gone with its store


def local_dir(prefix: str) -> str:
    """A folder of this worker process alone, deleted at its end."""
    path = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage so that a lost executor costs one re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit: int = 64 << 20) -> DataFrame:
    """Marks df for broadcast only when rows * row_bytes, counted by the caller, is within limit; else a shuffle join serves."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def fresh(df: DataFrame, base: str) -> str:
    """A column name like base that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name, n = base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}{n}"
    return name


def column(df: DataFrame, name: str) -> Column:
    """A column by its name, which may hold dots and backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(docs: DataFrame, lost: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is not in lost (one column of ids), all columns as they were; rows with a null id stay."""
    name = fresh(docs, "_gone")
    gone = materialize(lost.toDF(name).filter(F.col(name).isNotNull()).distinct(), "lost")
    return docs.join(broadcast_if_small(gone, gone.count(), 16), column(docs, id_col) == F.col(name), "left_anti")


def row_keyed(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """docs with a number for each row, and the name of this column: the id, where it is one row's alone. Rows that share an id,
    or have none, get numbers above all ids, and are written once, so that every later reading sees the same numbers."""
    key, mark = fresh(docs, "_row"), fresh(docs, "_shared")
    own = column(docs, id_col)
    shared = materialize(docs.select(own.alias(mark)).groupBy(mark).agg(F.count(F.lit(1)).alias("n")).filter(F.col(mark).isNull() | (F.col("n") > 1)).select(mark), "shared-ids")
    n = shared.count()
    if not n:
        return docs.withColumn(key, own.cast("long")), key
    small = broadcast_if_small(shared, n, 16)
    most = docs.agg(F.max(own.cast("long"))).first()[0] or 0
    alone = docs.join(small, own == F.col(mark), "left_anti").filter(own.isNotNull()).withColumn(key, own.cast("long"))
    rest = docs.join(small, own.eqNullSafe(F.col(mark)), "left_semi").withColumn(key, F.monotonically_increasing_id() + F.lit(most + 1))
    return alone.unionByName(materialize(rest, "shared-rows")), key


def task_count(spark: SparkSession, units: float, per_task: float) -> int:
    """Partitions so that each holds about per_task units; grows with the input, never below the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(units / per_task) + 1)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts, which says how many shards an index needs."""
    return int(docs.agg(F.sum(F.octet_length(text_of(text_col)))).first()[0] or 0)


def by_bytes(batch, column: str, budget: int):
    """Slices of an Arrow batch whose texts hold about budget bytes; a longer text is a slice of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lo, total = 0, 0
    for hi, size in enumerate(sizes.tolist()):
        if total + size > budget and hi > lo:
            yield batch.slice(lo, hi - lo)
            lo, total = hi, 0
        total += size
    if batch.num_rows > lo:
        yield batch.slice(lo)


def runs_of(values: np.ndarray):
    """(value, begin, end) of each run of equal values in a sorted array."""
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    bounds = [0, *cuts.tolist(), len(values)] if len(values) else [0]
    for lo, hi in zip(bounds, bounds[1:]):
        yield int(values[lo]), lo, hi


def write_file(uri: str, data: bytes) -> None:
    """Writes a file of the shared folder from a task or the driver, under a temporary name first, so retries are safe."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, path)


def exists(uri: str) -> bool:
    from pyarrow.fs import FileType

    fs, path = filesystem(uri)
    return fs.get_file_info(path).type != FileType.NotFound


def delete_file(uri: str) -> None:
    """Deletes a file of the shared folder that nothing needs any more; one that is gone already is no error."""
    if exists(uri):
        fs, path = filesystem(uri)
        fs.delete_file(path)


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("/", "file:")) else os.path.abspath(uri))


def release() -> None:
    """Gives memory that this process has freed back to the system, where its allocators can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


_RESIDENT: dict[tuple, object] = {}


def resident(key: tuple, make):
    """The one object of this worker process that holds tables for an operator: the next operator's takes its place, so
    that a worker which serves one stage after the other does not hold the tables, mapped files and freed memory of all."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _MAPPED.clear()
        release()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


_MAPPED: dict[str, np.ndarray] = {}


def map_file(uri: str, dtype=np.uint8) -> np.ndarray:
    """A shared file as a read-only memory-mapped array; a store that is no mounted folder is copied once per worker."""
    if uri not in _MAPPED:
        fs, path = filesystem(uri)
        if fs.type_name != "local":
            local = os.path.join(local_dir("spindrift-map-"), os.path.basename(path))
            with fs.open_input_stream(path) as src, open(local, "wb") as dst:
                while chunk := src.read(1 << 22):
                    dst.write(chunk)
            path = local
        if len(_MAPPED) > 4096:
            _MAPPED.clear()
        _MAPPED[uri] = np.memmap(path, dtype=np.uint8, mode="r").view(np.ndarray) if os.path.getsize(path) else np.zeros(0, np.uint8)
    return _MAPPED[uri].view(dtype)
