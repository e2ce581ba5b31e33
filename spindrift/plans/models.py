"""Embedding by a model that lies in a shared file: fitted on a corpus by Spark, loaded once by each worker.

The model is a small one of its own: words are counted in buckets by their hash, counts are damped and weighted by how rare a
bucket is, and the principal directions of these rows turn a text into a vector. Any other model with the same two methods
serves as well.
"""

from __future__ import annotations

import io
import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import terms
from .scratch import filesystem
from .store import ModelUnavailable

#: Texts that the model takes at once, whatever Spark's batches hold.
BATCH = 64


def bucket_of(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def fit(docs: DataFrame, path: str, text: str = "text", buckets: int = 512, dimension: int = 32, seed: int = 1, sample: int = 20_000) -> None:
    """Writes a model below a folder. Rarity is counted over all rows; the directions come from about `sample` of them, as their
    covariance is a table of bounded size (buckets x buckets)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    words = docs.select(F.transform(terms(F.coalesce(F.col(text), F.lit(""))), lambda w: bucket_of(w, buckets)).alias("b"))
    n = words.count()
    if not n:
        raise ModelUnavailable("a model needs documents to be fitted on")
    df = words.select(F.explode(F.array_distinct("b")).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()  # `buckets` rows
    rarity = np.full(buckets, np.log(1.0 + n))
    for r in df:
        rarity[r.b] = np.log((1.0 + n) / (1.0 + r.n))
    weights = F.array(*(F.lit(float(x)) for x in rarity))
    places = F.sequence(F.lit(0), F.lit(buckets - 1))
    count = lambda i: F.size(F.filter("b", lambda x: x == i))
    row = F.transform(places, lambda i: F.log1p(count(i).cast("double")) * F.element_at(weights, i + 1))
    picked = words.sample(min(1.0, sample / n), seed).select(array_to_vector(row).alias("features"))
    model = PCA(k=min(dimension, buckets), inputCol="features", outputCol="out").fit(picked)
    out = io.BytesIO()
    np.savez(out, rarity=rarity, directions=model.pc.toArray())
    store, folder = filesystem(path)
    store.create_dir(folder, recursive=True)
    part = posixpath.join(folder, f"{uuid.uuid4().hex}.part")
    with store.open_output_stream(part) as f:
        f.write(out.getvalue())
    store.move(part, posixpath.join(folder, "model.npz"))


@dataclass
class Projection:
    rarity: np.ndarray
    directions: np.ndarray

    def encode(self, rows: list[np.ndarray]) -> np.ndarray:
        """Unit vectors of lists of buckets; zeros for an empty one."""
        counts = np.zeros((len(rows), len(self.rarity)))
        for i, b in enumerate(rows):
            np.add.at(counts[i], np.asarray(b, np.int64), 1)
        found = np.log1p(counts) * self.rarity @ self.directions
        length = np.sqrt((found * found).sum(1, keepdims=True))
        return found / np.where(length > 0, length, 1)


_LOADED: dict[str, Projection] = {}


def load(path: str) -> Projection:
    """The model of a folder, read once by each worker process, which leaves a mark below the folder's `loads`."""
    if path not in _LOADED:
        store, folder = filesystem(path)
        try:
            with store.open_input_stream(posixpath.join(folder, "model.npz")) as f:
                found = np.load(io.BytesIO(f.read()))
        except OSError as e:
            raise ModelUnavailable(f"no model in {path}") from e
        _LOADED[path] = Projection(found["rarity"], found["directions"])
        store.create_dir(posixpath.join(folder, "loads"), recursive=True)
        with store.open_output_stream(posixpath.join(folder, "loads", f"{os.getpid()}-{uuid.uuid4().hex}")) as f:
            f.write(b"")
    return _LOADED[path]


@dataclass
class ProjectionEmbedder:
    """An embedder of Index: the model travels as a path, and a worker meets texts in batches that reach over Spark's own."""

    path: str
    name: str = "projection"
    revision: str | None = "1"
    batch: int = BATCH

    def __post_init__(self):
        found = load(self.path)
        self.buckets, self.dimension = len(found.rarity), found.directions.shape[1]

    def embed(self, text: Column) -> Column:
        path, size = self.path, self.batch

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model, held = load(path), []
            for rows in batches:
                held += list(rows)
                ready = len(held) // size * size
                if ready:
                    yield pd.Series([v for lo in range(0, ready, size) for v in model.encode(held[lo : lo + size])])
                    held = held[ready:]
            if held:
                yield pd.Series(list(model.encode(held)))

        words = F.transform(terms(F.coalesce(text, F.lit(""))), lambda w: bucket_of(w, self.buckets))
        return F.pandas_udf(run, "array<double>")(words)
