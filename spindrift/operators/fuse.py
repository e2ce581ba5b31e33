"""Vector candidates, reciprocal rank fusion, demotion, de-duplication, relative scores and bands."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .best import SCORES, Best, blocks, column
from .bm25 import DIGITS, top

# Fixed values.
RRF_K = 60
STRONG, USABLE, WEAK = 0.025, 0.015, 0.012


#: Queries that travel to the vectors at once.
QUERY_BLOCK = 4096


def _matrices(lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places of the vectors of that length, and these; vectors that are null or hold nulls are left out."""
    lists = lists.cast(pa.list_(pa.float64()))
    sizes = pc.list_value_length(lists).fill_null(-1).to_numpy(zero_copy_only=False).copy()
    if lists.flatten().null_count:
        parents = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
        sizes[np.unique(parents[pc.is_null(lists.flatten()).to_numpy(zero_copy_only=False)])] = -1
    out = {}
    for d in np.unique(sizes[sizes > 0]).tolist():
        places = np.flatnonzero(sizes == d)
        out[d] = places, lists.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return out


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows of a with rows of b, each added up in the order of the places as functions.vectors.dot does."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        total += x * y
    return total


def _clamped(products: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """functions.vectors.clamp of cosine: 0 where a length is 0; what is no number counts as the greatest."""
    x = np.divide(products, lengths, out=np.zeros_like(products), where=lengths != 0)
    return np.where(np.isnan(x), 1.0, np.clip(x, 0.0, 1.0))


def cosine_topk(vectors: DataFrame, queries: DataFrame, limit: int = 30, id_col: str = "id", vector: str = "embedding", n_queries: int | None = None) -> DataFrame:
    """query_id, id, score, rank: exact search of query vectors (query_id, qvec) against all vectors.

    The queries are counted, unless the caller knows their number, and travel to the vectors in blocks of bounded size. A task
    multiplies matrices to find what may be among the best of its own rows, adds up these products exactly, and hands on only
    those.
    """
    n = queries.count() if n_queries is None else n_queries
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    kind = {"id": own.schema["id"].dataType.simpleString(), "query_id": queries.schema["query_id"].dataType.simpleString()}

    def scan(load):
        def run(batches):
            asked = load()
            names = column(asked, "query_id")
            given = {d: (at, q, np.sqrt(_dots(q, q))) for d, (at, q) in _matrices(column(asked, "qvec")).items()}
            found = Best(len(names), limit)
            step = max(1, SCORES // max(1, len(names)))
            for whole in batches:
                for lo in range(0, whole.num_rows if len(names) else 0, step):
                    b = whole.slice(lo, step)
                    scores = np.zeros((b.num_rows, len(names)))
                    exact = {}
                    with np.errstate(all="ignore"):
                        for d, (rows, v) in _matrices(b.column("v")).items():
                            if d not in given:
                                continue
                            at, q, q_norms = given[d]
                            norms = np.sqrt(_dots(v, v))
                            near = _clamped(v @ q.T, norms[:, None] * q_norms)
                            for r in np.flatnonzero(~((norms > 1e-140) & (norms < 1e140))):  # too far from 1 for estimates
                                near[r] = _clamped(_dots(np.broadcast_to(v[r], q.shape), q), norms[r] * q_norms)
                            scores[np.ix_(rows, at)] = near
                            exact[d] = rows, v, norms, at, q, q_norms
                        row, query = found.near(scores)
                        values = scores[row, query]
                        for rows, v, norms, at, q, q_norms in exact.values():
                            place, turn = np.full(b.num_rows, -1), np.full(len(names), -1)
                            place[rows], turn[at] = np.arange(len(rows)), np.arange(len(at))
                            mine = np.flatnonzero((place[row] >= 0) & (turn[query] >= 0))
                            for i in range(0, len(mine), SCORES // 32):
                                part = mine[i : i + SCORES // 32]
                                i_v, i_q = place[row[part]], turn[query[part]]
                                values[part] = _clamped(_dots(v[i_v], q[i_q]), norms[i_v] * q_norms[i_q])
                    found.add(row, query, values, b.column("id"))
            yield from found.rows(names)

        return own.mapInArrow(run, f"query_id {kind['query_id']}, id {kind['id']}, score double")

    pairs = reduce(DataFrame.unionByName, (scan(load) for load in blocks(queries.select("query_id", F.col("qvec").cast("array<double>").alias("qvec")), n, QUERY_BLOCK)))
    return top(pairs.select("query_id", "id", F.round("score", DIGITS).alias("score")), limit, tie="id")


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """query_id, id, raw: sum of 1 / (k + rank) over ranked lists (query_id, id, rank)."""
    both = None
    for ranked in lists:
        own = ranked.select("query_id", "id", (1 / (k + F.col("rank"))).alias("r"))
        both = own if both is None else both.unionByName(own)
    return both.groupBy("query_id", "id").agg(F.round(F.sum("r"), 12).alias("raw"))


def finish(fused: DataFrame, chunks: DataFrame, top_k: int, demote_frontmatter: bool = False, dedup: bool = True) -> DataFrame:
    """Hits: query_id, id, source, heading, type, score, raw_score, rank, text.

    Fused ids (query_id, id, raw) without a chunk are skipped. The order is raw descending, then id; with
    demote_frontmatter, front matter stands behind all else. Of one (source, heading) the first stays. score is raw over that
    of the first in this order, so a demoted hit may exceed 1. top_k of 0 or less gives no hits.
    """
    meta = fused.join(chunks.select("id", "source", "heading", F.coalesce("type", F.lit("content")).alias("type")), "id")
    behind = (F.col("type") == "frontmatter").cast("int") if demote_frontmatter else F.lit(0)
    order = [behind, F.desc("raw"), F.col("id")]
    each = Window.partitionBy("query_id")
    placed = meta.withColumn("best", F.first("raw").over(each.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    if dedup:
        same = Window.partitionBy("query_id", "source", "heading").orderBy(*order)
        placed = placed.withColumn("nth", F.row_number().over(same)).filter("nth = 1")
    ranked = placed.withColumn("rank", F.row_number().over(each.orderBy(*order))).filter(F.col("rank") <= top_k)
    hits = ranked.select("query_id", "id", "source", "heading", "type", F.round(F.col("raw") / F.col("best"), 4).alias("score"), F.round("raw", 4).alias("raw_score"), "rank")
    return hits.join(chunks.select("id", "text"), "id")  # texts are fetched for hits only


def band(raw):
    """Confidence of a fused score, as documented for clients."""
    return F.when(raw >= STRONG, "strong").when(raw >= USABLE, "usable").when(raw < WEAK, "weak").otherwise("unlabelled")
