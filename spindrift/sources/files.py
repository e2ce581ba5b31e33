"""File sources: Markdown trees, C++ headers, dictionaries and labelled queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GLOSSARY = "topic string, canonical string, aliases array<string>, identifiers array<string>"
QUERIES = "topic string, queries array<struct<language string, split string, text string>>"
LABELS = "query string, topic string, expected array<struct<source string, heading string>>"


def relative(path: Column, root: str) -> Column:
    """A file's path below root, decoded, with forward slashes."""
    plain = F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    base = root.removeprefix("file://").rstrip("/") + "/"
    return F.substr(plain, F.locate(base, plain) + len(base)) if base else plain


def read_texts(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """source, text of all files below root whose name matches, read as whole files; \\r\\n and \\r become \\n. Empty files give no row."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return rows.select(relative(F.col("_metadata.file_path"), root).alias("source"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """source, text of all *.md files below root."""
    return read_texts(spark, root, "*.md")


def read_headers(spark: SparkSession, root: str) -> DataFrame:
    """path, text of all *.h files below root, without generated and intermediate ones."""
    rows = read_texts(spark, root, "*.h").withColumnRenamed("source", "path")
    return rows.filter(~F.element_at(F.split("path", "/"), -1).contains(".generated.") & ~F.col("path").contains("Intermediate"))


def read_bytes(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """source, content, length: raw bytes, for fingerprints."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return rows.select(relative(F.col("path"), root).alias("source"), "content", "length")


def file_hashes(files: DataFrame) -> DataFrame:
    """source, length, hash of each file: the rows that a fingerprint is made of."""
    return files.select("source", "length", F.sha2("content", 256).alias("hash"))


def fingerprint(hashes: DataFrame) -> DataFrame:
    """One row, fingerprint: a digest of (source, length, hash) rows in any order.

    Rows are digested in groups by the first four hexadecimal digits of the source's SHA-256, each group in order of its
    rows' digests, groups then by two digits and at last all: no task or driver sees more than a small share of the files.
    """
    rows = hashes.select(F.sha2("source", 256).alias("g"), F.sha2(F.concat_ws("\0", "source", F.col("length").cast("string"), "hash"), 256).alias("d"))
    for digits in (4, 2, 0):
        joined = F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ""), 256)
        rows = rows.groupBy(F.substring("g", 1, digits).alias("g")).agg(joined.alias("d")) if digits else rows.agg(joined.alias("fingerprint"))
    return rows


def read_queries(spark: SparkSession, golden: str, labels: str | None = None, natural: str | None = None) -> DataFrame:
    """query_id, topic, language, split, text, expected of labelled query files. Natural queries are Chinese and a split of
    their own; a query with two label rows keeps the last."""
    flat = lambda p: spark.read.schema(QUERIES).json(p, multiLine=True).select("topic", F.explode("queries").alias("q")).select("topic", "q.*")
    rows = flat(golden)
    if natural:
        rows = rows.unionByName(flat(natural).withColumns({"language": F.lit("zh"), "split": F.lit("natural_zh")}))
    if labels:
        found = spark.read.schema(LABELS).json(labels, multiLine=True).withColumn("_n", F.monotonically_increasing_id())
        found = found.groupBy("query").agg(F.max_by("expected", "_n").alias("expected"))
        rows = rows.join(found, rows["text"] == found["query"], "left").drop("query")
    else:
        rows = rows.withColumn("expected", F.lit(None).cast("array<struct<source:string,heading:string>>"))
    return rows.select(F.sha2("text", 256).alias("query_id"), "topic", "language", "split", "text", "expected")
