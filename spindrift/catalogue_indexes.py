"""Queries over written indexes of the given tables: cells of vectors, postings by impact, automata, hash trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import MANY, NEAR, _norm, _scores, _values, asked, first_vectors, query, read, saved, vectors
from .functions import text as T
from .operators import ann, impact, ingest, merkle, names, patterns
from .plans.scratch import scratch

_WRITTEN: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make):
    """What make() writes, written once for each session."""
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _WRITTEN:
        _WRITTEN[key] = make()
    return _WRITTEN[key]


def vector_index(spark: SparkSession, sf_dir: str) -> ann.VectorIndex:
    return once(spark, sf_dir, "vectors", lambda: ann.build(vectors(spark, sf_dir), scratch(spark), "vec_id"))


@query("ann_search", f"with {NEAR} select query_id, vec_id, round(score, 6) as score, rank from near")
def ann_search(spark, sf_dir):
    """The 30 nearest vectors of each label's first, by cells and codes; bounds make them those of a search of all vectors."""
    found = ann.search(vector_index(spark, sf_dir), first_vectors(spark, sf_dir), 30)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


PRUNED = MANY | {"q5": "the the of einkeit", "q6": "the"}


def impact_index(spark: SparkSession, sf_dir: str) -> impact.Impacts:
    return once(spark, sf_dir, "impacts", lambda: impact.save_impacts(saved(spark, sf_dir), scratch(spark)))


@query("bm25_pruned", f"with {_scores(_values(PRUNED))} select query_id, pos, id, score, rank from lexical")
def bm25_pruned(spark, sf_dir):
    """Exact BM25 top 30 that reads only postings whose impact can matter."""
    return impact.search(impact_index(spark, sf_dir), asked(spark, PRUNED))


#: Ten passages of every document, every second one of them with an ending that texts hardly have.
PIECES, LENGTH, STEP = 10, 19, 41
_PIECE = f"substr(text, 1 + i * {STEP}, {LENGTH}) || case when (doc_id + i) % 2 = 1 then 'zq' else '' end"


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("i"))
    piece = F.col("text").substr(1 + F.col("i") * STEP, F.lit(LENGTH))
    return docs.select(F.concat(piece, F.when((F.col("doc_id") + F.col("i")) % 2 == 1, "zq").otherwise("")).alias("concept"))


@query(
    "dictionary_grounding_many",
    f"""with d as (select distinct {_norm('text')} as t from documents), c as (select distinct {_PIECE} as concept from documents, range({PIECES}) r(i)),
    n as (select concept, {_norm('concept')} as p from c)
    select concept, exists (select 1 from d where contains(t, p)) as grounded from n""",
)
def dictionary_grounding_many(spark, sf_dir):
    """Ten times as many concepts as documents, in one pass over the texts for each block of concepts."""
    return ingest.grounded(read(spark, sf_dir, "documents"), concepts(spark, sf_dir), scratch(spark))


@query(
    "contamination_exact",
    """select doc_id, item_id, ((length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text))::bigint as n
    from documents d join benchmark b on b.text <> '' and contains(d.text, b.text)""",
)
def contamination_exact(spark, sf_dir):
    """Which documents hold which benchmark texts word for word, and how often."""
    items = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("pattern"))
    matcher = patterns.build(items, scratch(spark))
    found = patterns.occurrences(read(spark, sf_dir, "documents"), matcher, "doc_id")
    return found.join(items, "pattern").select("doc_id", "item_id", "n")


#: A hundred names of every document, of 9 to 18 characters.
NAMES = 100
_NAMED = f"""named as (select doc_id * {NAMES} + i as number, {_norm("substr(text, 1 + i * 23, 9 + (doc_id + i) % 10)")} as name, ['c' || doc_id, 'x' || i] as gives from documents, range({NAMES}) r(i)),
asked as (select item_id, {_norm('text')} as t from benchmark)"""


def many_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = read(spark, sf_dir, "documents").select("doc_id", F.col("text").substr(1, NAMES * 23 + 18).alias("text")).repartition("doc_id")  # one file may be one task
    # A row of a piece holds no text: rows wait in the executors' queues of Python functions.
    piece = lambda i: F.col("text").substr(1 + i * 23, (9 + (F.col("doc_id") + i) % 10).cast("int"))
    docs = dealt.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(NAMES - 1)), lambda i: F.struct(i.alias("i"), piece(i).alias("piece")))).alias("at")).select("doc_id", "at.i", "at.piece")
    gives = F.array(F.concat(F.lit("c"), F.col("doc_id").cast("string")), F.concat(F.lit("x"), F.col("i").cast("string")))
    return docs.select((F.col("doc_id") * NAMES + F.col("i")).alias("number"), F.lit(0).alias("kind"), T.normalize(F.col("piece")).alias("name"), gives.alias("gives"))


@query(
    "expand_many_names",
    f"""with recursive {_NAMED},
    cand as materialized (select item_id, length(name) as size, gives, row_number() over (partition by item_id order by length(name) desc, number) as k,
      list_filter(range(1, length(t) - length(name) + 2), lambda i: substr(t, i, length(name)) = name) as places from asked join named on name <> '' and contains(t, name)),
    step(item_id, k, taken, added) as (
      select item_id, 0::bigint, []::bigint[], []::varchar[] from asked
      union all
      select s.item_id, c.k, case when p.at is null then s.taken else list_concat(s.taken, range(p.at, p.at + c.size)) end, case when p.at is null then s.added else list_concat(s.added, c.gives) end
      from step s join cand c on c.item_id = s.item_id and c.k = s.k + 1,
        lateral (select list_filter(c.places, lambda i: not list_has_any(s.taken, range(i, i + c.size)))[1] as at) p),
    last as (select item_id, max_by(added, k) as added from step group by item_id),
    firsts as (select item_id, g, min(i) as i from (select item_id, unnest(added) as g, generate_subscripts(added, 1) as i from last) group by all),
    listed as (select item_id, string_agg(g, ' ' order by i) as more from (select *, row_number() over (partition by item_id order by i) as n from firsts) where n <= 12 group by item_id)
    select item_id, trim(concat_ws(' ', t, more)) as text from asked left join listed using (item_id)""",
)
def expand_many_names(spark, sf_dir):
    """Benchmark texts, expanded by a hundred times as many names as there are documents."""
    asked_ = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return names.expand(asked_, many_names(spark, sf_dir), scratch(spark)).withColumnRenamed("query_id", "item_id")


VERSIONS = """old as (select doc_id as path, md5(text) as hash from documents),
new as (select doc_id as path, case when doc_id % 101 = 0 then 'other' else md5(text) end as hash from documents where doc_id % 97 <> 0
  union all select doc_id + 1000000000, md5(text) from documents where doc_id % 103 = 0)"""


@query(
    "merkle_diff",
    f"""with {VERSIONS} select * from (select coalesce(o.path, n.path) as path, case when n.path is null then 'missing' when o.path is null then 'extra' when o.hash <> n.hash then 'stale' end as state
    from old o full join new n on o.path = n.path) where state is not null""",
)
def merkle_diff(spark, sf_dir):
    """Two versions of the documents' hashes, compared by their hash trees."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"))
    changed = docs.filter("path % 97 <> 0").withColumn("hash", F.when(F.col("path") % 101 == 0, "other").otherwise(F.col("hash")))
    new = changed.unionByName(docs.filter("path % 103 = 0").withColumn("path", F.col("path") + 1_000_000_000))
    old = merkle.build(docs, scratch(spark))
    return merkle.tree_diff(old, merkle.build(new, scratch(spark), like=old))
