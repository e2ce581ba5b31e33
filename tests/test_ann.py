import numpy as np
import pytest

from spindrift.operators import ann, fuse


def table(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, embedding array<float>")


def asked(spark, rows):
    return spark.createDataFrame([(f"q{i}", [float(x) for x in v]) for i, v in enumerate(rows)], "query_id string, qvec array<float>")


def clustered(n, d, seed, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    return (centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, d))).astype(np.float32)


def rows_of(df):
    return sorted((r.query_id, r.rank, r.id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rows = list(enumerate(clustered(1500, 16, 1)))
    rows += [(2000 + i, rows[3][1]) for i in range(60)] + [(3000, np.zeros(16, np.float32))]
    frame = table(spark, rows)
    return frame, ann.build(frame, str(tmp_path_factory.mktemp("ann") / "index"))


def test_all_probes_give_the_rows_of_the_exact_search(spark, data):
    frame, index = data
    queries = asked(spark, [*clustered(8, 16, 2, 0.4), clustered(1500, 16, 1)[3], np.zeros(16)])
    assert rows_of(ann.search(index, queries, 30)) == rows_of(fuse.cosine_topk(frame, queries, 30))
    assert rows_of(ann.search(index, queries, 3)) == rows_of(fuse.cosine_topk(frame, queries, 3))


def test_bounds_leave_few_vectors_to_score(spark, data):
    frame, index = data
    queries = asked(spark, clustered(5, 16, 7))
    assert ann.candidates(index, queries, 10).count() < 5 * 0.1 * frame.count()


def test_few_probes_find_most(spark, data):
    frame, index = data
    queries = asked(spark, clustered(20, 16, 3))
    exact = {(r[0], r[2]) for r in rows_of(fuse.cosine_topk(frame, queries, 10))}
    near = {(r[0], r[2]) for r in rows_of(ann.search(index, queries, 10, probes=6))}
    assert len(exact & near) >= 0.9 * len(exact)


def test_small_tables(spark, tmp_path):
    queries = asked(spark, [[1, 0], [-1, -1]])
    for n, rows in enumerate(([(1, [1, 2])], [(1, [0, 0]), (2, [0, 0])], [(i, [i, 1]) for i in range(5)])):
        frame = table(spark, rows)
        assert rows_of(ann.search(ann.build(frame, f"{tmp_path}/{n}"), queries, 30)) == rows_of(fuse.cosine_topk(frame, queries, 30))


def test_codes_bound_the_cosine():
    rows = ann._unit(np.random.default_rng(1).normal(size=(200, 24)))
    codes, scale, error = ann.encode(rows)
    q = ann._unit(np.random.default_rng(2).normal(size=(10, 24)))
    assert (np.abs(q @ rows.T - (q @ codes.T) * scale) <= error + 1e-12).all()
