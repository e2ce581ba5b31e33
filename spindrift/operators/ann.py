"""Vector search by an inverted file of cells with 8-bit codes, built and searched by Spark jobs.

Build: k-means on a bounded sample gives the centres of the cells; every vector goes to the cell of its nearest centre. A cell's
vectors, at unit length, are stored as blocks of codes (one byte for each dimension, scaled for each vector) with the length of
what rounding left out, so a code bounds the cosine from both sides. A cell of many vectors is many blocks.

Search: a query meets the cells nearest to it first, whose codes give a lower bound of its k-th best score. It goes on to the
cells that can hold a better vector, by the angle between query and centre and the widest angle in the cell, and, where
`probes` is given, only to that many cells. Cosines are computed for the vectors whose upper bound reaches the k-th best lower
bound. Without `probes` the hits are exactly those of a search of all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import clamp, cosine
from .bm25 import DIGITS, top

#: Cells at most; more vectors than this squared make larger cells, which are more blocks.
MOST_CELLS = 1 << 13
#: Sampled vectors for each cell that k-means sees, and its rounds.
SAMPLE, ROUNDS = 64, 8
#: Vectors of a block and queries that meet it at once.
BLOCK, QUERIES = 4096, 256
#: Rounding of cosines in single precision, and of scores.
SLACK = 2e-6
#: Cells that every query meets first.
FIRST = 2


@dataclass(frozen=True)
class VectorIndex:
    """centres (cell, centre, narrowest, n), blocks (cell, block, ids, codes, scales, errors), vectors (id, vector), and counts."""

    centres: DataFrame
    blocks: DataFrame
    vectors: DataFrame
    n: int

    def matrix(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, centres and the smallest cosine of a member with its centre, of all cells: at most MOST_CELLS rows."""
        rows = self.centres.orderBy("cell").collect()
        return np.array([r.cell for r in rows], np.int64), np.array([r.centre for r in rows], np.float64), np.array([r.narrowest for r in rows])


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(1))
    return rows / np.where(length > 0, length, 1)[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def _centres(unit: DataFrame, n: int, cells: int, seed: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sample = unit.filter(F.exists("u", lambda x: x != 0)).sample(min(1.0, SAMPLE * cells / max(1, n)), seed).select(array_to_vector("u").alias("features"))
    if sample.isEmpty():
        return np.zeros((0, 0))
    model = KMeans(k=max(2, cells), seed=seed, maxIter=ROUNDS, distanceMeasure="cosine").fit(sample)
    return _unit(np.array(model.clusterCenters()))


def encode(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of one byte for each value, a scale for each row, and the length of what the codes leave out."""
    scale = np.abs(rows).max(1, initial=0) / 127
    codes = np.rint(rows / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((rows - codes * scale[:, None]) ** 2).sum(1))


def build(vectors: DataFrame, path: str, id_col: str = "id", vector_col: str = "embedding", cells: int | None = None, seed: int = 1) -> VectorIndex:
    """Writes an index of vectors of one length below a folder. Null vectors are left out; zero vectors have a score of 0."""
    spark = vectors.sparkSession
    own = vectors.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    own.write.parquet(f"{path}/vectors")
    stored = spark.read.parquet(f"{path}/vectors")
    n = stored.count()

    def units(batches):
        for b in batches:
            rows = _unit(_matrix(b.column("vector")))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(rows), pa.list_(pa.float64()))], names=["id", "u"])

    kind = stored.schema["id"].dataType.simpleString()
    unit = stored.mapInArrow(units, f"id {kind}, u array<double>")
    centres = _centres(unit, n, min(MOST_CELLS, cells or max(1, round(n**0.5))), seed)
    numbers = np.arange(max(1, len(centres)))

    def assign(batches):
        for b in batches:
            rows = _unit(_matrix(b.column("vector")))
            near = rows @ centres.T if len(centres) else np.zeros((len(rows), 1))
            cell = near.argmax(1)
            codes, scale, error = encode(rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(numbers[cell]), pa.array(near[np.arange(len(rows)), cell]), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(error)],
                names=["id", "cell", "near", "code", "scale", "error"],
            )

    stored.mapInArrow(assign, f"id {kind}, cell long, near double, code binary, scale double, error double").write.parquet(f"{path}/assigned")
    assigned = spark.read.parquet(f"{path}/assigned")
    sizes = assigned.groupBy("cell").agg(F.min("near").alias("narrowest"), F.count(F.lit(1)).alias("n"))
    held = spark.createDataFrame([(int(i), [float(x) for x in c]) for i, c in zip(numbers, centres if len(centres) else [[]], strict=True)], "cell long, centre array<double>")
    held.join(sizes, "cell").select("cell", "centre", "narrowest", "n").coalesce(1).write.parquet(f"{path}/centres")
    dealt = assigned.join(F.broadcast(spark.read.parquet(f"{path}/centres").select("cell", "n")), "cell")  # at most MOST_CELLS rows
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK))
    packed = dealt.groupBy("cell", block.alias("block")).agg(F.collect_list(F.struct("id", "code", "scale", "error")).alias("m"))  # about BLOCK members
    parts = packed.select("cell", "block", F.col("m.id").alias("ids"), F.col("m.code").alias("codes"), F.col("m.scale").alias("scales"), F.col("m.error").alias("errors"))
    parts.repartitionByRange("cell").sortWithinPartitions("cell", "block").write.parquet(f"{path}/blocks")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    centres, blocks, vectors = (spark.read.parquet(f"{path}/{t}") for t in ("centres", "blocks", "vectors"))
    return VectorIndex(centres, blocks, vectors, vectors.count())


def reach(near: np.ndarray, narrowest: np.ndarray) -> np.ndarray:
    """The most that the cosine of a query and a member of a cell can be: near is the query's with the centre."""
    angle = np.arccos(np.clip(near, -1, 1)) - np.arccos(np.clip(narrowest, -1, 1))
    return np.cos(np.maximum(angle, 0)) + SLACK


def _probe(queries: DataFrame, index: VectorIndex, lo: int, hi: int | None) -> DataFrame:
    """query_id, cell, u, least for each query (query_id, qvec, least) and the cells at places lo to hi of its order that may
    reach least."""
    numbers, centres, narrowest = index.matrix()

    def run(batches):
        for b in batches:
            u = _unit(_matrix(b.column("qvec")))
            near = u @ centres.T if centres.shape[1] else np.zeros((len(u), len(numbers)))
            order = np.argsort(-near, axis=1, kind="stable")[:, lo:hi]
            least = np.nan_to_num(b.column("least").to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf)
            able = np.maximum(reach(np.take_along_axis(near, order, 1), narrowest[order]), 0) >= np.maximum(least, 0)[:, None]  # clamped
            q, place = np.nonzero(able)
            yield pa.RecordBatch.from_arrays([b.column("query_id").take(pa.array(q)), pa.array(numbers[order[q, place]]), b.column("qvec").take(pa.array(q)), pa.array(least[q])], names=["query_id", "cell", "qvec", "least"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", F.col("qvec").cast("array<double>").alias("qvec"), "least").mapInArrow(run, f"query_id {kind}, cell long, qvec array<double>, least double")


def _scan(index: VectorIndex, probes: DataFrame, k: int, n_queries: int) -> DataFrame:
    """query_id, id, lower, upper of the members that may be among the k best of their block. A block meets up to about QUERIES
    queries at once."""
    chunks = -(-n_queries // QUERIES) or 1
    asked = probes.groupBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("query_id", "qvec", "least")).alias("asked"))
    met = index.blocks.join(asked.drop("chunk"), "cell").select("ids", "codes", "scales", "errors", F.col("asked.query_id").alias("query_ids"), F.col("asked.qvec").alias("qvecs"), F.col("asked.least").alias("least"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids, query_ids = b.column("ids")[i].values, b.column("query_ids")[i].values
                scales, errors, least = (b.column(c)[i].values.to_numpy() for c in ("scales", "errors", "least"))
                codes = np.frombuffer(b"".join(b.column("codes")[i].as_py()), np.int8).reshape(len(ids), -1)
                u = _unit(_matrix(b.column("qvecs")[i].values))
                about = (u.astype(np.float32) @ codes.T.astype(np.float32)).astype(np.float64) * scales
                lower, upper = about - errors - SLACK, about + errors + SLACK
                if len(ids) > k:
                    least = np.maximum(least, np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k])
                q, m = np.nonzero(np.maximum(upper, 0) >= np.maximum(least, 0)[:, None])
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(q)), ids.take(pa.array(m)), pa.array(lower[q, m]), pa.array(upper[q, m])], names=["query_id", "id", "lower", "upper"])

    fields = met.schema
    kind, own = (fields[c].dataType.elementType.simpleString() for c in ("query_ids", "ids"))
    return met.mapInArrow(run, f"query_id {kind}, id {own}, lower double, upper double")


def _limits(found: DataFrame, k: int) -> DataFrame:
    """query_id, least: the k-th best lower bound; none for queries that met fewer."""
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lower")))
    return found.withColumn("_nth", nth).filter(F.col("_nth") == k).select("query_id", F.col("lower").alias("least"))


def candidates(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, n_queries: int | None = None) -> DataFrame:
    """query_id, id: the vectors whose cosine has to be computed. Scores are clamped to 0, so all that may lie below 0 tie."""
    n = queries.count() if n_queries is None else n_queries
    start = queries.select("query_id", "qvec", F.lit(None).cast("double").alias("least"))
    first = min(FIRST, probes or FIRST)
    near = _scan(index, _probe(start, index, 0, first), k, n)
    told = queries.select("query_id", "qvec").join(_limits(near, k), "query_id", "left")
    rest = _scan(index, _probe(told, index, first, probes), k, n)
    both = near.unionByName(rest)
    judged = both.join(_limits(both, k), "query_id", "left")
    return judged.filter(F.greatest("upper", F.lit(0.0)) >= F.greatest(F.coalesce("least", F.lit(-1.0)), F.lit(0.0))).select("query_id", "id")


def search(index: VectorIndex, queries: DataFrame, k: int = 30, probes: int | None = None, n_queries: int | None = None) -> DataFrame:
    """query_id, id, score, rank: the k best vectors of each query (query_id, qvec) by cosine, clamped to 0 .. 1; ties to the smaller id."""
    wanted = candidates(index, queries, k, probes, n_queries).join(queries.select("query_id", "qvec"), "query_id")
    scored = wanted.join(index.vectors, "id").select("query_id", "id", F.round(clamp(cosine(F.col("vector"), F.col("qvec"))), DIGITS).alias("score"))
    return top(scored, k, tie="id")
