"""Exact de-duplication with a log-structured merge index of text digests.

Each task keeps a memtable of digests; when full it is flushed as a sorted run with a Bloom filter, cut by digest range
into shards. Compaction merges the runs of a shard by size, asks the larger run's filter first, and keeps one identifier
and the count of every digest. Digests found more than once are hits; their texts are compared byte by byte, and texts
that differ under one digest are told apart.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ascii_lower, broadcast_if_small, column, fresh, materialize, runs_of, table, text_of

BITS_PER_KEY, PROBES = 12, 4


class Bloom:
    def __init__(self, capacity: int):
        self.capacity = max(64, capacity)
        self.size = 1 << max(10, (self.capacity * BITS_PER_KEY - 1).bit_length())
        self.bits = np.zeros(self.size >> 3, np.uint8)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        raw = keys.astype("S16").view(np.uint64).reshape(-1, 2)  # digests are uniform: their bytes serve as hashes
        with np.errstate(over="ignore"):
            return (raw[:, :1] + raw[:, 1:] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(self.size - 1)

    def add(self, keys: np.ndarray) -> None:
        at = self._places(keys).ravel()
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        at = self._places(keys)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)


@dataclass
class Run:
    keys: np.ndarray  # sorted, distinct
    ids: np.ndarray
    counts: np.ndarray
    filter: Bloom


def memtable_run(keys: np.ndarray, ids: np.ndarray, largest: bool) -> Run:
    """A sorted run of rows: each digest once, with the identifier to keep and its number of rows."""
    order = np.lexsort((~ids if largest else ids, keys))  # ~ turns the order round without overflow
    keys, ids = keys[order], ids[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(keys)))
    return _run(keys[at], ids[at], counts)


def _run(keys, ids, counts) -> Run:
    bloom = Bloom(2 * len(keys))
    bloom.add(keys)
    return Run(keys, ids, counts, bloom)


def merge_runs(a: Run, b: Run, largest: bool) -> Run:
    if len(a.keys) < len(b.keys):
        a, b = b, a
    if not len(b.keys):
        return a
    better = np.maximum if largest else np.minimum
    maybe = np.flatnonzero(a.filter.may_hold(b.keys))
    at = np.minimum(np.searchsorted(a.keys, b.keys[maybe]), len(a.keys) - 1)
    hit = a.keys[at] == b.keys[maybe]
    own, at = maybe[hit], at[hit]
    a.ids[at] = better(a.ids[at], b.ids[own])
    a.counts[at] += b.counts[own]
    new = np.ones(len(b.keys), bool)
    new[own] = False
    where = np.searchsorted(a.keys, b.keys[new])
    keys, ids, counts = (np.insert(x, where, y[new]) for x, y in ((a.keys, b.keys), (a.ids, b.ids), (a.counts, b.counts)))
    if len(keys) > a.filter.capacity:
        return _run(keys, ids, counts)
    a.filter.add(b.keys[new])
    return Run(keys, ids, counts, a.filter)


def compact(runs: list[Run], largest: bool) -> Run:
    """Merges runs of like size first, so every entry is moved about log(runs) times."""
    levels: list[Run] = []
    for run in sorted(runs, key=lambda r: len(r.keys)):
        levels.append(run)
        while len(levels) > 1 and len(levels[-2].keys) <= 2 * len(levels[-1].keys):
            b, a = levels.pop(), levels.pop()
            levels.append(merge_runs(a, b, largest))
    while len(levels) > 1:
        b, a = levels.pop(), levels.pop()
        levels.append(merge_runs(a, b, largest))
    return levels[0]


def _digests(docs: DataFrame, id_col: str, text_col: str, width: int, with_text: bool) -> DataFrame:
    """id, digest, key (the digest's first bytes) and, if asked for, the normalised text."""

    def run(batches):
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            for lo in range(0, b.num_rows, 1000):
                low = [t.translate(ASCII_LOWER) for t in texts.slice(lo, 1000).to_pylist()]
                sha = [hashlib.sha256(t).digest() for t in low]
                cols = [b.column("id").slice(lo, 1000), pa.array(sha, pa.binary()), pa.array([s[:width] for s in sha], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(low, pa.binary())] * with_text, names=["id", "digest", "key"] + ["norm"] * with_text)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, digest binary, key binary" + ", norm binary" * with_text)


def exact_duplicates(
    docs: DataFrame,
    keep: str = "largest",
    id_col: str = "doc_id",
    text_col: str = "text",
    memtable_rows: int = 500_000,
    shard_rows: int = 1_000_000,
    digest_bytes: int = 32,
) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts the row with the
    largest (or smallest) identifier stays; rows that repeat this identifier stay with it. Null identifiers lose to all
    others; if a group has no other, keep_id is null and its rows stay. An empty table gives an empty result.
    digest_bytes below 32 cuts the index keys, which only tests need: it makes digests collide.

    A group of copies enters a shard's compaction once per run, whatever its size; copies are counted before the shuffle.
    """
    spark, largest = docs.sparkSession, keep == "largest"
    none = np.iinfo(np.int64).min if largest else np.iinfo(np.int64).max
    width = digest_bytes
    rows = materialize(_digests(docs, id_col, text_col, width, False), "digests")
    n = rows.count()
    shards = int(n / shard_rows) + 1

    def flush(batches):
        def runs(keys, ids):
            run = memtable_run(np.array(keys, f"S{width}"), np.concatenate(ids), largest)
            head = run.keys.astype("S4").view(">u4").astype(np.int64) * shards >> 32
            for s, lo, hi in runs_of(head):
                own = slice(lo, hi)
                bloom = Bloom(hi - lo)
                bloom.add(run.keys[own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (run.keys[own], run.ids[own], run.counts[own], bloom.bits))],
                    names=["shard", "keys", "ids", "counts", "filter"],
                )

        keys: list[bytes] = []
        ids: list[np.ndarray] = []
        for b in batches:
            keys += b.column("key").to_pylist()
            ids.append(b.column("id").fill_null(int(none)).to_numpy(zero_copy_only=False))
            if len(keys) >= memtable_rows:
                yield from runs(keys, ids)
                keys, ids = [], []
        if keys:
            yield from runs(keys, ids)

    def compact_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = []
        for x in pdf.itertuples():
            keys = np.frombuffer(x.keys, f"S{width}").copy()
            bloom = Bloom(len(keys))
            bloom.bits = np.frombuffer(x.filter, np.uint8).copy()
            runs.append(Run(keys, np.frombuffer(x.ids, np.int64).copy(), np.frombuffer(x.counts, np.int64).copy(), bloom))
        done = compact(runs, largest)
        hit = done.counts > 1
        ids = pd.Series(done.ids[hit], dtype="Int64").mask(done.ids[hit] == none)
        return pd.DataFrame({"key": [k.ljust(width, b"\0") for k in done.keys[hit].tolist()], "keep_id": ids, "group_size": done.counts[hit]})

    runs = rows.select("id", "key").mapInArrow(flush, "shard int, keys binary, ids binary, counts binary, filter binary")
    hits = materialize(runs.groupBy("shard").applyInPandas(compact_shard, "key binary, keep_id long, group_size long"), "hits")
    n_hits = hits.count()

    # Byte verification: every text of a hit against the others of its digest.
    texts = _digests(docs, id_col, text_col, width, True)
    small = lambda df: broadcast_if_small(df, n_hits, 96)
    spread = texts.join(small(hits.select("key")), "key").groupBy("key").agg(F.min("norm").alias("a"), F.max("norm").alias("b"))
    bad = materialize(spread.filter("a <> b").select("key"), "collisions")
    out = rows.join(small(hits), "key", "left").select("id", "key", "digest", "keep_id", F.coalesce("group_size", F.lit(1)).alias("group_size"))
    out = out.withColumn("keep_id", F.when(F.col("group_size") == 1, F.col("id")).otherwise(F.col("keep_id")))
    if bad.count():
        best = F.max("id") if largest else F.min("id")
        own = texts.join(bad, "key", "left_semi")
        groups = own.groupBy("key", "norm").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        told = own.join(groups, ["key", "norm"]).select("id", "key", "digest", "keep_id", "group_size")
        out = out.join(bad, "key", "left_anti").unionByName(told)
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, the one that exact_duplicates keeps; all columns as they were.

    Rows are told apart by id and text, so an id with several texts loses only those that others repeat. Of rows that share
    both, one stays. Rows without an id are compared among themselves, and one of each text stays: they never go for a row
    that has an id. Columns of any name are allowed.
    """
    gone, sha, many = (fresh(docs, x) for x in ("_gone", "_sha", "_many"))
    found = exact_duplicates(docs, keep, id_col, text_col).filter("group_size > 1").select(F.col(id_col).alias(gone), F.col("text_sha256").alias(sha), (F.col("kept") | F.col(id_col).isNull()).alias("kept"))
    marks = materialize(found.groupBy(gone, sha).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias(many)).filter(~F.col("kept") | (F.col(many) > 1)), "lost")
    n = marks.count()
    digest = fresh(docs, "_digest")
    rows = docs.withColumn(digest, F.sha2(ascii_lower(F.coalesce(column(docs, text_col).cast("string"), F.lit(""))), 256))

    def of(part: DataFrame):
        return broadcast_if_small(part.select(gone, sha), n, 96), column(docs, id_col).eqNullSafe(F.col(gone)) & (F.col(digest) == F.col(sha))

    rest = rows.join(*of(marks), "left_anti").drop(digest)
    again = rows.join(*of(marks.filter("kept")), "left_semi").dropDuplicates([id_col, digest]).drop(digest)
    return rest.unionByName(again)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = """
with d as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.t) as text_sha256 from d join g using (t)
"""
