"""Exact top-k search by inner product: columnar branch-and-bound.

Vectors become integers; equal vectors form one class, which is searched once. A task holds blocks of classes in vertical
layout (dimension by dimension, those of most mass first) and streams the queries past them. Scores are accumulated
dimension block by dimension block; after each, a candidate whose score so far plus the most that the remaining mass of both
vectors can add (their norms over the dimensions to come) stays below the query's threshold is dropped, and the survivors are
compacted: columns that no query of the slice needs first, single pairs once few are left.

Candidates come in three rounds (a 64th, 7 64ths, the rest, by a hash of the class), so that a query's threshold, the
k-th best score of the rounds before, lets through about as many pairs for each query whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, materialize, shared_dir, table, task_count

#: Bytes of a block of candidates, queries of a slice, candidates beside which a slice is scored at once.
BLOCK_BYTES, QUERY_SLICE, STRIPE = 32 << 20, 256, 4096
#: Dimensions whose scores are added between two prunings.
STEP = 8
#: Share of pairs below which survivors are followed one by one, and of columns below which these are compacted.
SPARSE, COLUMNS = 0.01, 0.7
#: Rounds of candidates: class hashes modulo 64 below these limits.
ROUNDS = (1, 8, 64)
#: Norms are computed in floating point and widened by this share, so that a bound is never too low.
SLACK = 1 + 1e-5
LONG = np.iinfo(np.int64)


def exact_type(left: np.ndarray, right: np.ndarray) -> type:
    """The narrowest type in which all partial sums of inner products of rows of both are exact integers."""
    most = lambda m: float(np.sqrt((m.astype(np.float64) ** 2).sum(1)).max()) if m.size else 0.0
    bound = most(left) * most(right) * 1.001
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object


class Block:
    """Candidates in vertical layout: one row for each dimension, in order of falling mass."""

    def __init__(self, vectors: np.ndarray, numbers: np.ndarray, firsts: np.ndarray):
        self.numbers, self.firsts = numbers, firsts
        self.order = np.argsort(-(vectors.astype(np.float64) ** 2).sum(0), kind="stable")
        self.vectors = vectors[:, self.order]
        self.columns: dict[type, np.ndarray] = {}
        self.cuts = list(range(0, vectors.shape[1], STEP))

    def vertical(self, kind: type) -> np.ndarray:
        if kind not in self.columns:
            self.columns.clear()
            self.columns[kind] = np.ascontiguousarray(self.vectors.T.astype(kind))
        return self.columns[kind]

    def rest(self, vectors: np.ndarray) -> np.ndarray:
        """Norms of the vectors over the dimensions from each cut on: one row for each cut, and zeros at the end."""
        squares = vectors.astype(np.float64) ** 2
        sums = np.add.reduceat(squares, self.cuts, axis=1) if self.cuts else np.zeros((len(vectors), 0))
        back = np.sqrt(np.cumsum(sums[:, ::-1], axis=1)[:, ::-1]) * SLACK
        return np.concatenate([back.T, np.zeros((1, len(vectors)))])

    def above(self, queries: np.ndarray, thresholds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query places, candidate places and exact scores of all pairs whose score is at least the query's threshold."""
        queries = queries[:, self.order]
        kind = exact_type(queries, self.vectors)
        if kind is object:
            yield from self._wide(queries, thresholds)
            return
        columns, own = self.vertical(kind), queries.astype(kind)
        mine, theirs = self.rest(queries).astype(kind), self._rests(kind)
        least = thresholds.astype(kind)  # -inf stays so
        for lo in range(0, columns.shape[1], STRIPE):
            places = np.arange(lo, min(lo + STRIPE, columns.shape[1]))
            part, bound = columns[:, lo : lo + STRIPE], theirs[:, lo : lo + STRIPE]
            score = np.zeros((len(own), len(places)), kind)
            pairs = None
            for k, at in enumerate(self.cuts):
                if pairs is None:
                    score += own[:, at : at + STEP] @ part[at : at + STEP]
                    alive = score + mine[k + 1][:, None] * bound[k + 1] >= least[:, None]
                    n = int(np.count_nonzero(alive))
                    if n <= SPARSE * alive.size or k + 1 == len(self.cuts):
                        pairs = np.nonzero(alive)
                        sums = score[pairs]
                    elif k % 2 and (needed := alive.any(0)).mean() < COLUMNS:
                        places, part, bound, score = places[needed], np.ascontiguousarray(part[:, needed]), bound[:, needed], score[:, needed]
                else:
                    q, c = pairs
                    sums = sums + np.einsum("ij,ji->i", own[q, at : at + STEP], part[at : at + STEP, c])
                    stays = sums + mine[k + 1][q] * bound[k + 1][c] >= least[q]
                    pairs, sums = (q[stays], c[stays]), sums[stays]
                if pairs is not None and not len(sums):
                    break
            if pairs is None:  # no dimensions: every score is 0
                pairs = np.nonzero(np.broadcast_to(least[:, None] <= 0, score.shape))
                sums = score[pairs]
            if len(sums):
                yield pairs[0], places[pairs[1]], sums.astype(np.int64)

    def _rests(self, kind: type) -> np.ndarray:
        if not hasattr(self, "own_rest") or self.own_rest.dtype != kind:
            self.own_rest = self.rest(self.vectors).astype(kind)
        return self.own_rest

    def _wide(self, queries: np.ndarray, thresholds: np.ndarray):
        """Numbers that no floating point type adds exactly: one query at a time in integers of any size. Scores beyond 64 bits
        are returned as the nearest 64-bit number."""
        theirs = self.vectors.astype(object)
        for i, query in enumerate(queries.astype(object)):
            sums = theirs @ query if theirs.shape[1] else np.zeros(len(theirs), object)
            sums = np.array([min(max(x, LONG.min), LONG.max) for x in sums.tolist()], np.int64)
            c = np.flatnonzero(sums >= thresholds[i]) if np.isfinite(thresholds[i]) else np.arange(len(sums))
            yield np.full(len(c), i), c, sums[c]


def best_of(query: np.ndarray, place: np.ndarray, score: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each query: highest score, then smallest first."""
    order = np.lexsort((place, first, ~score, query))
    own = query[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own, "left") < k]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows; shorter lists end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def stored_batches(uri: str, rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a written table, in batches, read in a task."""
    from pyarrow import fs as pafs
    from pyarrow import parquet

    fs, path = filesystem(uri)
    for info in sorted(fs.get_file_info(pafs.FileSelector(path)), key=lambda x: x.path):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                yield from parquet.ParquetFile(f).iter_batches(batch_size=rows)


def _search(candidates: DataFrame, queries_uri: str, k: int, width: int, block_bytes: int) -> DataFrame:
    """qn, cn, first, score: the candidates of each block that reach a query's threshold, the k best of these."""
    block_rows = max(STRIPE, block_bytes // (8 * max(1, width)))

    def scored(block: Block):
        for batch in stored_batches(queries_uri, QUERY_SLICE):
            numbers = batch.column("qn").to_numpy()
            least = batch.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
            least = np.where(np.isnan(least), -np.inf, least)
            found = list(block.above(matrix(batch.column("vec"), width), least))
            if found:
                q, c, s = (np.concatenate(x) for x in zip(*found, strict=True))
                keep = best_of(q, c, s, block.firsts[c], k)
                q, c, s = q[keep], c[keep], s[keep]
                yield pa.RecordBatch.from_arrays([pa.array(numbers[q]), pa.array(block.numbers[c]), pa.array(block.firsts[c]), pa.array(s)], names=["qn", "cn", "first", "score"])

    def run(batches):
        held, rows = [], 0

        def block():
            parts = pa.Table.from_batches(held)
            return Block(matrix(parts.column("vec"), width), parts.column("cn").to_numpy(), parts.column("first").to_numpy())

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= block_rows:
                yield from scored(block())
                held, rows = [], 0
        if rows:
            yield from scored(block())

    return candidates.select("cn", "first", "vec").mapInArrow(run, "qn long, cn long, first long, score long")


def top_k(
    vectors: DataFrame,
    k: int = 20,
    scale: int = 64,
    query_modulus: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """query_id, rank, <id_col>, score: the k rows of highest inner product with each query, all if fewer; ties to smaller ids.

    Components become floor(scale * x). Queries are the rows whose id is divisible by query_modulus, candidates all rows but the
    query's own. Rows with a null vector, or with a null or non-finite component, take no part; shorter vectors count as ended
    by zeros. Rows with a null id are candidates behind all others of their score. Of repeated rows each is a query and a
    candidate for the others: a query leaves out one row with its id and vector. Scores beyond 64 bits become the
    nearest 64-bit number. An empty table gives no rows; other columns of any name are not read.

    A class keeps its k + 1 smallest ids, as no list needs more of them; a hot vector is cut to these before it is shuffled.
    Tasks stream the written query classes past blocks of candidates: nothing is broadcast, and neither side is held whole.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col)
    whole = F.coalesce(~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    rows = vectors.filter(x.isNotNull()).select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias(vector_col)).filter(whole)
    rows = rows.select("id", F.transform(x, lambda v: F.floor(v * scale)).alias("vec"))
    keyed = rows.withColumn("key", F.unhex(F.sha2(F.array_join(F.col("vec"), ","), 256)))
    # A null id stands behind all others.
    order = Window.partitionBy("key").orderBy(F.asc_nulls_last("id"))
    members = keyed.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)
    members = materialize(members, "members")
    numbered = members.filter("nth = 1").withColumn("first", F.coalesce("id", F.lit(LONG.max)))
    sizes = numbered.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
    width = sizes.width or 0
    tasks = task_count(spark, sizes.n, max(STRIPE, block_bytes // (8 * max(1, width))))
    classes = materialize(numbered.select("key", "first", "vec").repartition(tasks, "key").withColumn("cn", F.monotonically_increasing_id()), "classes")
    asked = keyed.filter((F.col("id") % query_modulus) == 0)
    wanted = asked.groupBy("key").agg(F.first("vec").alias("vec"))
    queries = materialize(wanted.withColumn("qn", F.monotonically_increasing_id()), "queries")

    found, lower = None, 0
    for number, upper in enumerate(ROUNDS):
        if found is None:
            known = queries.select("qn", "vec", F.lit(None).cast("double").alias("least"))
        else:
            limits = found.filter(F.col("place") == k + 1).select("qn", F.col("score").cast("double").alias("least"))
            known = queries.select("qn", "vec").join(limits, "qn", "left")
        place = F.pmod(F.xxhash64("key"), F.lit(ROUNDS[-1]))
        part = classes.filter((place >= lower) & (place < upper))
        uri = f"{shared_dir(spark)}/asked-{number}"
        known.write.parquet(uri)
        new = _search(part, uri, k + 1, width, block_bytes)
        both = new if found is None else found.drop("place").unionByName(new)
        best = Window.partitionBy("qn").orderBy(F.desc("score"), "first", "cn")
        found = materialize(both.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1), f"found-{number}")
        lower = upper

    # From classes to rows: the first k + 1 of a query class are among the members of its k + 1 best classes.
    named = found.select("qn", "cn", "score").join(classes.select("cn", "key"), "cn").drop("cn")
    listed = named.join(members.select("key", "id"), "key")
    before = Window.partitionBy("qn").orderBy(F.desc("score"), F.asc_nulls_last("id"), "key")
    ranked = listed.withColumn("place", F.row_number().over(before)).filter(F.col("place") <= k + 1)
    entry = F.struct("place", F.col("id").alias("member"), "score", F.col("key").alias("of"))
    lists = ranked.groupBy("qn").agg(F.array_sort(F.collect_list(entry)).alias("list"))  # k + 1 entries
    lists = lists.join(queries.select("qn", "key"), "qn").select("key", "list")
    own = F.filter(F.col("list"), lambda e: (e["member"] == F.col("id")) & (e["of"] == F.col("key")))
    at = F.coalesce(F.get(own, F.lit(0))["place"], F.lit(k + 1))
    rest = F.slice(F.filter(F.col("list"), lambda e: e["place"] != F.col("at")), 1, k)
    answers = asked.select("id", "key").join(lists, "key").withColumn("at", at).select(F.col("id").alias("query_id"), F.posexplode(rest).alias("i", "e"))
    return answers.select("query_id", (F.col("i") + 1).alias("rank"), F.col("e.member").alias(id_col), F.col("e.score").alias("score"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""
