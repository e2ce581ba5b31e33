"""Differences between snapshots and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """One row: added, removed, unchanged (distinct keys)."""
    sides = old.select(key).distinct().withColumn("o", F.lit(1)).join(new.select(key).distinct().withColumn("n", F.lit(1)), key, "full")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return sides.agg(count(F.col("o").isNull()).alias("added"), count(F.col("n").isNull()).alias("removed"), count(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("unchanged"))


def manifest_diff(expected: DataFrame, found: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """key, state: missing (not found), stale (another value) or extra (not expected)."""
    both = expected.select(key, F.col(value).alias("e")).join(found.select(key, F.col(value).alias("f")), key, "full")
    state = F.when(F.col("f").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("e") != F.col("f"), "stale")
    return both.select(key, state.alias("state")).filter("state is not null")


def manifest_summary(expected: DataFrame, found: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """One row: missing, stale, extra and their sum, differences."""
    states = manifest_diff(expected, found, key, value)
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return states.agg(n("missing"), n("stale"), n("extra"), F.count(F.lit(1)).alias("differences"))


def new_rows(candidates: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Candidates whose key is not known."""
    return candidates.join(known.select(key), key, "left_anti")
