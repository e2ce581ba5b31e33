import math
import random

import numpy as np
import pytest

from spindrift.llm import topk

from .helpers import SMALL

SCHEMA = "vec_id long, embedding array<float>, label int, id long, key string, score double, first long, vec string"


def vectors(spark, rows):
    """Rows (vec_id, embedding) with columns whose names clash with the operator's own."""
    return spark.createDataFrame([(i, v, 0, 1, "k", 2.0, 3, "v") for i, v in rows], SCHEMA)


def brute(rows, k=20, modulus=20):
    good = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(good):
        if i is None or i % modulus:
            continue
        scored = [(-sum(a * b for a, b in zip(q, c)), j is None, j or 0) for m, (j, c) in enumerate(good) if m != n]
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()), key=str)


def some(n, d, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    return [[float(v) for v in row] for row in (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)]


def test_hot_vectors_ties_and_gaps(spark):
    rows = list(enumerate(some(150, 12)))
    rows += [(i, rows[7][1]) for i in range(150, 260)]  # one vector in many rows
    rows += [(i, [0.0] * 12) for i in range(260, 300)]
    rows += [(300, None), (301, [None] * 12), (302, [float("nan")] * 12), (320, [float("inf")] + [0.0] * 11), (340, []), (341, [0.5, -0.5])]
    rows += [(None, rows[3][1]), (40, rows[40][1]), (40, rows[41][1]), (60, rows[60][1])]  # no id, a repeated row, an id with two vectors
    random.Random(2).shuffle(rows)
    assert found(topk.top_k(vectors(spark, rows), k=20)) == brute(rows)
    assert found(topk.top_k(vectors(spark, rows), k=3, query_modulus=7)) == brute(rows, 3, 7)


def test_fewer_rows_than_asked(spark):
    rows = list(enumerate(some(5, 3)))
    assert found(topk.top_k(vectors(spark, rows), k=20)) == brute(rows)
    assert found(topk.top_k(vectors(spark, rows[:1]))) == []
    assert topk.top_k(vectors(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1e4, 1e7, 1e12])
def test_large_numbers_stay_exact(spark, scale):
    rows = [(i, [float(np.float32(x * scale)) for x in v]) for i, v in enumerate(some(60, 5))]
    want = [(q, r, v, max(min(s, 2**63 - 1), -(2**63))) for q, r, v, s in brute(rows, 4)]
    got = found(topk.top_k(vectors(spark, rows), k=4))
    assert len(got) == len(want) and sorted((q, r, s) for q, r, _, s in got) == sorted((q, r, s) for q, r, _, s in want)
    if scale < 1e8:
        assert got == want


def test_blocks_prune_nothing_that_counts():
    """Small stripes and blocks, mass in few dimensions: pairs above the threshold are those of the whole product."""
    rng = np.random.default_rng(5)
    c = np.floor(64 * rng.normal(size=(9000, 40)) * np.linspace(2, 0.05, 40)).astype(np.int64)
    q = c[:300]
    block = topk.Block(c, np.arange(9000), np.arange(9000))
    full = q @ c.T
    least = np.sort(full, axis=1)[:, -20].astype(float)
    least[5] = -np.inf
    pairs = {(int(a), int(b)): int(s) for x in block.above(q, least) for a, b, s in zip(*x)}
    assert pairs == {(int(a), int(b)): int(full[a, b]) for a, b in zip(*np.nonzero(full >= least[:, None]))}


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert found(topk.op12_exact_topk(spark, SMALL)) == brute(rows)
