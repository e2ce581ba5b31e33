import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions.text import terms
from spindrift.plans import models
from spindrift.plans.index import Index
from spindrift.plans.store import ModelUnavailable


@pytest.fixture(scope="module")
def fitted(spark, tmp_path_factory):
    topics = ["walk floor step stride", "sound audio noise tone", "light shader colour lamp"]
    rows = [(i, " ".join((topics[i % 3].split() * 3)[: 4 + i % 8]) + f" extra{i}") for i in range(150)] + [(900, ""), (901, None)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(4)
    path = str(tmp_path_factory.mktemp("model"))
    models.fit(docs, path, buckets=64, dimension=6)
    return docs, path


def test_vectors_are_those_of_the_matrix(spark, fitted):
    docs, path = fitted
    own = models.ProjectionEmbedder(path, batch=7)
    got = docs.select("id", own.embed(F.col("text")).alias("v"), F.transform(terms(F.coalesce("text", F.lit(""))), lambda w: models.bucket_of(w, 64)).alias("b")).collect()
    model = np.load(f"{path}/model.npz")
    assert len(got) == 152
    for r in got:
        counts = np.bincount(r.b, minlength=64) if r.b else np.zeros(64)
        x = np.log1p(counts) * model["rarity"] @ model["directions"]
        assert np.allclose(r.v, x / (np.linalg.norm(x) or 1))
    by = {r.id: np.array(r.v) for r in got}
    near = [by[0] @ by[i] for i in range(3, 60, 3)]
    far = [by[0] @ by[i] for i in range(1, 60, 3)]
    assert min(near) > max(far)  # texts of one topic are closer


def test_a_worker_loads_the_model_once(spark, fitted):
    docs, path = fitted
    own = models.ProjectionEmbedder(path)
    for _ in range(3):
        docs.select(own.embed(F.col("text"))).write.format("noop").mode("overwrite").save()
    pids = [f.split("-")[0] for f in os.listdir(f"{path}/loads")]
    assert 1 <= len(pids) == len(set(pids))


def test_an_index_of_the_model(spark, fitted, tmp_path):
    _, path = fitted
    index = Index(spark, str(tmp_path / "index"), embedder=models.ProjectionEmbedder(path))
    docs = spark.createDataFrame([("a.md", "# A\n\nwalk floor step"), ("b.md", "# B\n\nsound audio noise"), ("c.md", "# C\n\nlight lamp")], "source string, text string")
    index.build_documents(docs, "docs", lambda: "1")
    assert index.search("audio tone noise", 1, profile="vector").first().source == "b.md"
    with pytest.raises(ModelUnavailable):
        models.ProjectionEmbedder(str(tmp_path / "none"))
