"""Hash trees over keyed tables, for differences that read only what differs.

Keys are dealt to leaves by a hash; a leaf's digest is that of its sorted (key, value) pairs, a node's that of its children's
digests, and the root is the fingerprint of the table. The tree is written with its entries, which lie in folders by the upper
part of the leaf and sorted by leaf within, so a leaf can be read without the rest.

Two trees of one shape are compared from the root: a level reads the children of the nodes that differ, and in the end only
the entries of differing leaves are joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .diff import manifest_diff

#: Children of a node, as a power of two; levels below the root at most; entries of a leaf, about.
BITS, MOST_LEVELS, LEAF = 4, 6, 256
#: Folders of entries at most (a power of two of BITS), and differing nodes that are named in filters; more are joined.
FOLDERS, NAMED = 8, 1024


@dataclass(frozen=True)
class Tree:
    """nodes (level, node, parent, digest, n), the root at level 0 and leaves at level `levels`; entries (key, value, leaf, folder)."""

    path: str
    levels: int
    nodes: DataFrame
    entries: DataFrame

    def root(self) -> str | None:
        """The fingerprint; None for an empty table."""
        found = self.nodes.filter("level = 0").first()
        return found.digest if found else None


def _digest(pairs: Column) -> Column:
    """Of an array of (number or key, text), in its order; parts are told apart by their lengths."""
    part = lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)
    return F.sha2(F.array_join(F.transform(pairs, lambda p: F.concat(part(p["k"]), part(p["v"]))), ""), 256)


def build(rows: DataFrame, path: str, key: str = "path", value: str = "hash", like: Tree | None = None) -> Tree:
    """Writes the tree of a table below a folder: keys unique and not null, a null value being one of its own. The number of
    levels follows from the number of rows, or is that of the tree that it will be compared with."""
    spark = rows.sparkSession
    own = rows.select(F.col(key).alias("key"), F.col(value).cast("string").alias("value"))
    levels = like.levels if like else 1
    if like is None:
        n = own.count()
        while levels < MOST_LEVELS and n > LEAF << (BITS * levels):
            levels += 1
    width = BITS * levels
    leaf = F.shiftrightunsigned(F.xxhash64(F.col("key").cast("string")), 64 - width)
    dealt = own.withColumn("leaf", leaf).withColumn("folder", F.shiftright("leaf", max(0, width - FOLDERS)))
    dealt.limit(0).write.parquet(f"{path}/shape")
    dealt.repartition("folder").sortWithinPartitions("folder", "leaf", "key").write.partitionBy("folder").option("parquet.page.row.count.limit", str(LEAF)).parquet(f"{path}/entries")
    entries = spark.read.schema(dealt.schema).parquet(f"{path}/entries")
    pair = F.struct(F.col("key").cast("string").alias("k"), F.coalesce(F.concat(F.lit("="), "value"), F.lit("-")).alias("v"))
    level = entries.groupBy("leaf").agg(F.sort_array(F.collect_list(pair)).alias("p"), F.count(F.lit(1)).alias("n"))  # about LEAF entries
    level = level.select(F.lit(levels).alias("level"), F.col("leaf").alias("node"), F.shiftright("leaf", BITS).alias("parent"), _digest(F.col("p")).alias("digest"), "n")
    for depth in range(levels, -1, -1):
        level.write.parquet(f"{path}/nodes/at={depth}")
        if depth:
            written = spark.read.parquet(f"{path}/nodes/at={depth}")
            child = F.struct(F.lpad(F.conv(F.col("node").cast("string"), 10, 16), 16, "0").alias("k"), F.col("digest").alias("v"))
            joined = written.groupBy("parent").agg(F.sort_array(F.collect_list(child)).alias("p"), F.sum("n").alias("n"))  # at most 2^BITS children
            level = joined.select(F.lit(depth - 1).alias("level"), F.col("parent").alias("node"), F.shiftright("parent", BITS).alias("parent"), _digest(F.col("p")).alias("digest"), "n")
    return open_tree(spark, path)


def open_tree(spark: SparkSession, path: str) -> Tree:
    nodes = spark.read.parquet(f"{path}/nodes")
    levels = nodes.agg(F.max("at")).first()[0] or 0
    shape = spark.read.parquet(f"{path}/shape").schema
    return Tree(path, levels, nodes, spark.read.schema(shape).parquet(f"{path}/entries"))


def _children(tree: Tree, depth: int, parents: list[int] | None) -> DataFrame:
    found = tree.nodes.filter(F.col("at") == depth)
    return found if parents is None else found.filter(F.col("parent").isin(parents))


def differing(old: Tree, new: Tree) -> list[int] | None:
    """The leaves whose digests differ, in ascending order; None where more than NAMED nodes of a level do."""
    if old.levels != new.levels:
        raise ValueError("the trees have different shapes; build one like the other")
    nodes: list[int] = [0]
    for depth in range(old.levels + 1):
        parents = None if depth == 0 else nodes
        a = _children(old, depth, parents).select("node", F.col("digest").alias("a"))
        b = _children(new, depth, parents).select("node", F.col("digest").alias("b"))
        unlike = a.join(b, "node", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("node")
        nodes = sorted(r.node for r in unlike.limit(NAMED + 1).collect())
        if not nodes:
            return []
        if len(nodes) > NAMED:
            return None
    return nodes


def leaves(tree: Tree, numbers: list[int]) -> DataFrame:
    """The entries of some leaves: their folders are read, and in these the row groups that hold them."""
    shift = max(0, BITS * tree.levels - FOLDERS)
    folders = sorted({x >> shift for x in numbers})
    return tree.entries.filter(F.col("folder").isin(folders) & F.col("leaf").isin(numbers))


def tree_diff(old: Tree, new: Tree, key: str = "path") -> DataFrame:
    """key, state: missing (not in new), extra (not in old) or stale (another value), as manifest_diff of the two tables. Where
    more than NAMED leaves differ, whole entries are joined."""
    unlike = differing(old, new)
    a, b = (t.entries if unlike is None else leaves(t, unlike) for t in (old, new))
    mark = F.coalesce(F.concat(F.lit("="), "value"), F.lit("-"))  # a null value is a value
    side = lambda d: d.select(F.col("key").alias(key), mark.alias("hash"))
    return manifest_diff(side(a), side(b), key, "hash")
