"""Vector functions on array columns, in double precision."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words whose buckets a batch of texts remembers.
KNOWN = 1 << 18


def bind(value: Column, use) -> Column:
    """use(value), with the value computed once: inside a lambda an expression is else computed for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def clamp(x: Column) -> Column:
    """Into 0 .. 1; null gives 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    scaled = lambda v, length: F.transform(v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))
    return bind(a, lambda v: bind(norm(v), lambda length: scaled(v, length)))


def bucket_of(word: Column, dimension: int = 64) -> Column:
    return F.conv(F.substring(F.md5(word), 1, 2), 16, 10).cast("int") % dimension


def hash_embedding_entries(docs: DataFrame, key: str, words: Column, dimension: int = 64) -> DataFrame:
    """key, bucket, x: the entries above 0 of hash_embedding, by counting; a whole table in one pass."""
    counts = docs.select(key, F.explode(words).alias("_w")).groupBy(key, bucket_of(F.col("_w"), dimension).alias("bucket")).agg(F.count(F.lit(1)).alias("_c"))
    norms = counts.groupBy(key).agg(F.sqrt(F.sum((F.col("_c") * F.col("_c")).cast("double"))).alias("_n"))
    return counts.join(norms, key).select(key, "bucket", (F.col("_c") / F.col("_n")).alias("x"))


def hash_embedding(words: Column, dimension: int = 64) -> Column:
    """Counts of words in buckets by the first byte of their MD5, at unit length. Needs no model.

    The buckets are sorted together with one entry for each place, so that every place has a run: counts are the distances of
    the runs' starts, found in one pass.
    """
    places = F.sequence(F.lit(0), F.lit(dimension - 1))

    def count(found: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(found)), lambda i: (i == 0) | (i == F.size(found)) | (F.get(found, i) != F.get(found, i - 1)))
        return bind(starts, lambda at: F.transform(places, lambda i: (F.get(at, i + 1) - F.get(at, i) - 1).cast("double")))

    return l2_normalize(bind(F.sort_array(F.concat(F.transform(words, lambda w: bucket_of(w, dimension)), places)), count))


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        found = self[word] = hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[0]
        return found


def hash_embedding_batches(text: Column, dimension: int = 64, single: str | None = None) -> Column:
    """hash_embedding of the words between the white space of a column (what functions.text.SPACE matches), for tables: a batch
    of texts hashes each word once. Characters that the pattern `single` matches are words of their own."""
    alone = re.compile(f"({single})") if single else None

    def run(texts: pd.Series) -> pd.Series:
        known, out = _Buckets(), []
        for text in texts:
            text = text or ""
            words = (alone.sub(r" \1 ", text) if alone and not text.isascii() else text).split()
            if len(known) > KNOWN:
                known.clear()
            counts = np.bincount(np.fromiter(map(known.__getitem__, words), np.int64, len(words)) % dimension, minlength=dimension).astype(np.float64)
            length = np.sqrt((counts * counts).sum())
            out.append(counts / length if length > 0 else counts)
        return pd.Series(out, index=texts.index)

    return F.pandas_udf(run, "array<double>")(text)
