"""Retrieval metrics: recall, passage recall, reciprocal rank, exclusive quantiles, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_relevant(hits: DataFrame, relevant: Column, queries: DataFrame, depth: int) -> DataFrame:
    """query_id, first: the best rank up to depth of a relevant hit, null without."""
    best = hits.filter((F.col("rank") <= depth) & relevant).groupBy("query_id").agg(F.min("rank").alias("first"))
    return queries.select("query_id").join(best, "query_id", "left")


def recall_at_k(found: DataFrame, k: int = 3) -> DataFrame:
    """Share of queries whose first relevant rank is at most k; null without queries."""
    return found.agg(F.avg((F.coalesce("first", F.lit(1 << 30)) <= k).cast("double")).alias("recall"))


def mrr_at_k(found: DataFrame, k: int = 5) -> DataFrame:
    """Mean reciprocal rank; queries without a relevant hit up to k count 0."""
    return found.agg(F.avg(F.when(F.col("first") <= k, 1 / F.col("first")).otherwise(0.0)).alias("mrr"))


def passage_recall(hits: DataFrame, labels: DataFrame, k: int = 3) -> DataFrame:
    """Share of labelled queries with an expected (source, heading) among the first k; queries without labels don't count."""
    hit = hits.filter(F.col("rank") <= k).join(labels, ["query_id", "source", "heading"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1.0))
    return labels.select("query_id").distinct().join(hit, "query_id", "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("passage_recall"))


def split_stats(found: DataFrame, by: list[str], k: int = 3, depth: int = 5) -> DataFrame:
    """Queries, recall and MRR for each group of `by`."""
    return found.groupBy(*by).agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg((F.coalesce("first", F.lit(1 << 30)) <= k).cast("double")).alias("recall"),
        F.avg(F.when(F.col("first") <= depth, 1 / F.col("first")).otherwise(0.0)).alias("mrr"),
    )


def grouped_stats(found: DataFrame, by: list[str], sets: list[list[str]], k: int = 3, depth: int = 5) -> DataFrame:
    """Queries, recall and MRR for several groupings at once (split, profile, both, all, ...): the columns of `by`, null where a
    grouping leaves them out, and level, in which each left-out column has its bit, the last of `by` the lowest. Rows are
    (query, profile) pairs with `first`; each is expanded to the groupings after it is read, and summed before it is shuffled."""
    return found.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in by)).agg(
        F.grouping_id().cast("int").alias("level"),
        F.count(F.lit(1)).alias("queries"),
        F.avg((F.coalesce("first", F.lit(1 << 30)) <= k).cast("double")).alias("recall"),
        F.avg(F.when(F.col("first") <= depth, 1 / F.col("first")).otherwise(0.0)).alias("mrr"),
    )


def exclusive_quantile(values: DataFrame, column: str, q: float, by: list[str] | None = None) -> DataFrame:
    """Quantile by exclusive interpolation (position q * (n + 1)), for all rows or each group.

    Only the two order statistics around the position are kept. Distinct values are counted and dealt by ranges; a range
    starts to count where the ranges before it end, so neither a large group nor a table without groups is one task's work.
    """
    by = by or []
    rows = values.filter(F.col(column).isNotNull())
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
    counted = rows.groupBy(*by, column).agg(F.count(F.lit(1)).alias("c"))
    ranges = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counted.repartitionByRange(ranges, *by, column).withColumn("_range", F.spark_partition_id())
    ends = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = dealt.groupBy(*by, "_range").agg(F.sum("c").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(ends), F.lit(0))).drop("_n")
    within = F.sum("c").over(Window.partitionBy(*by, "_range").orderBy(column))
    upto = dealt.withColumn("_upto", within).join(starts, [*by, "_range"]).withColumn("upto", F.col("_upto") + F.col("_before"))
    joined = upto.join(n, by) if by else upto.crossJoin(F.broadcast(n))  # one row
    at = F.lit(q) * (F.col("n") + 1)
    place = F.greatest(F.lit(1), F.least(F.floor(at), F.col("n") - 1))
    holds = lambda p: (F.col("upto") >= p) & (F.col("upto") - F.col("c") < p)
    out = joined.groupBy(*by).agg(F.max(F.when(holds(place), F.col(column))).alias("a"), F.max(F.when(holds(place + 1), F.col(column))).alias("b"), F.max(at - place).alias("f"), F.max("lo").alias("lo"))
    return out.select(*by, F.coalesce(F.col("a") + (F.col("b") - F.col("a")) * F.col("f"), F.col("lo")).alias("quantile"))


#: Bounds that a release of a knowledge base must keep: rates of retrieval, seconds, bytes, tokens (fixed values). Gains and
#: losses are differences against the vector profile.
RELEASE_GATES: dict[str, tuple[str, float]] = {
    "heldout_zh_recall_at_3": (">=", 0.80),
    "zh_gain": (">=", 0.20),
    "heldout_en_recall_at_3": (">=", 0.90),
    "en_gain": (">=", -0.02),
    "mrr_at_5_gain": (">=", 0.0),
    "heldout_passage_recall_at_3": (">=", 0.80),
    "natural_zh_recall_at_3": (">=", 0.40),
    "hot_query_p95_s": ("<", 1.0),
    "cold_query_s": ("<", 15.0),
    "model_bytes_least": (">=", 80 << 20),
    "model_bytes_most": ("<=", 150 << 20),
    "index_bytes": ("<=", 20 << 20),
    "max_chunk_tokens": ("<=", 384),
    "unbalanced_fences": ("<=", 0),
}


def gates(metrics: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """gate, value, passed for one row of metrics; limits: (">=" or "<=" or "<", bound) by column."""
    checks = {"≥": lambda c, x: c >= x, ">=": lambda c, x: c >= x, "<=": lambda c, x: c <= x, "<": lambda c, x: c < x}
    each = [F.struct(F.lit(g).alias("gate"), F.col(g).cast("double").alias("value"), F.coalesce(checks[op](F.col(g), bound), F.lit(False)).alias("passed")) for g, (op, bound) in limits.items()]
    return metrics.select(F.explode(F.array(*each)).alias("g")).select("g.*")
