"""Queries over the given tables, by name, with the DuckDB SQL that gives the same rows.

The corpus view takes each document as one chunk: pos = doc_id, source = source/doc_id.md, heading = lang, id = hash of
these and the text; every seventh counts as front matter. Vectors belong to the document of the same number.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions.vectors import hash_embedding, hash_embedding_entries
from .operators import bm25, chunk, diff, evaluate, fuse, ingest
from .plans.scratch import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Small stated inputs, used on both sides.
QUERY = "the onthe and thering of enon"
MANY = {"q1": "the onthe and thering", "q2": "la de les ouvi", "q3": "der einkeit und sch sch", "q4": "nothingmatches"}
GLOSSARY = (
    {"topic": "src0", "canonical": "first source", "aliases": ["Primary feed", "primary"], "identifiers": ["FeedZero", "src_zero"]},
    {"topic": "src1", "canonical": "second source", "aliases": ["Other feed"], "identifiers": ["FeedOne"]},
    {"topic": "src2", "canonical": "third source", "aliases": ["feed"], "identifiers": []},
)
EXPANDED = {"e1": "Primary feed/other_feed", "e2": "getPrimaryFeed", "e3": "no names here", "e4": "feed primary feed"}
CONCEPTS = ("the", "onthe thering", "einkeit", "no such phrase at all", "la_de")
EMAIL, NUMBER = r"[a-z0-9.]+@[a-z0-9.]+", r"[0-9]{12,}"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, topic: bool = False) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    source = F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".md"))
    kind = F.when(F.col("doc_id") % 7 == 0, "frontmatter").otherwise("content")
    rows = docs.select(F.col("doc_id").alias("pos"), source.alias("source"), F.col("lang").alias("heading"), "text", kind.alias("type"))
    rows = rows.withColumn("id", T.chunk_id(F.col("source"), F.col("heading"), F.col("text")))
    glossary = spark.createDataFrame(list(GLOSSARY), "topic string, canonical string, aliases array<string>, identifiers array<string>")
    return bm25.topic_text(F.col("source"), glossary, rows) if topic else rows


def folder(spark: SparkSession) -> Path:
    """A new scratch folder, as a path of a mounted store."""
    path = Path(scratch(spark).removeprefix("file://").removeprefix("file:"))
    path.mkdir(parents=True)
    return path


_SAVED: dict[tuple[str, str], bm25.Postings] = {}


def saved(spark: SparkSession, sf_dir: str) -> bm25.Postings:
    """The documents' terms of the corpus view, written once for each session; searches read them."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _SAVED:
        _SAVED[key] = bm25.save_postings(corpus(spark, sf_dir, topic=True), scratch(spark), lists=False)
    return _SAVED[key]


def asked(spark: SparkSession, many: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(many.items()), "query_id string, text string")


# SQL of the corpus view and the text functions. RE2 has no look-behind; the camel rule is the same with two groups.
def _norm(c: str) -> str:
    camel = f"regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    return f"trim(regexp_replace(lower(regexp_replace({camel}, '::|[_/]', ' ', 'g')), '\\s+', ' ', 'g'))"


def _terms(c: str) -> str:
    return f"regexp_extract_all({_norm(c)}, '[a-z0-9ı]+|[\\x{{3400}}-\\x{{9fff}}]')"


TOKEN_RE = r"[A-Za-z0-9_]+|[\x{3400}-\x{9fff}]|[^\s]"
_GLOSSARY_SQL = ", ".join(f"('{g['topic']}', '{' '.join([g['canonical'], *g['aliases'], *g['identifiers']])}')" for g in GLOSSARY)
VIEW = f"""
glossary(topic, names) as (values {_GLOSSARY_SQL}),
corpus as (
  select doc_id as pos, source || '/' || lpad(doc_id::varchar, 8, '0') || '.md' as source, lang as heading, text,
         case when doc_id % 7 = 0 then 'frontmatter' else 'content' end as type,
         sha256(source || '/' || lpad(doc_id::varchar, 8, '0') || '.md' || chr(0) || lang || chr(0) || text) as id,
         concat_ws(' ', source, names) as topic_text
  from documents left join glossary on source = topic)"""
TF = f"""{VIEW},
words as (
  select pos, 3 as w, unnest({_terms('heading')}) as term from corpus
  union all select pos, 2, unnest({_terms('topic_text')}) from corpus
  union all select pos, 1, unnest({_terms('text')}) from corpus),
tf as (select pos, term, sum(w)::double as freq from words group by pos, term),
len as (select pos, sum(freq) as length from tf group by pos),
stats as (select c.pos, c.id, coalesce(l.length, 1.0) as length from corpus c left join len l using (pos)),
corp as (select count(*) as n_docs, avg(length) as avg_length from stats),
dfs as (select term, count(*) as df from tf group by term)"""


def _scores(queries: str) -> str:
    return f"""{TF},
q as (select query_id, term, count(*) as qf from (select query_id, unnest({_terms('text')}) as term from {queries}) group by all),
scored as (
  select query_id, pos, round(sum(qf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * freq * 2.5 / (freq + 1.5 * (0.25 + 0.75 * length / avg_length))), 9) as score
  from q join tf using (term) join dfs using (term) join stats using (pos), corp group by query_id, pos),
lexical as (
  select query_id, pos, id, score, rank::int as rank from (
    select query_id, pos, id, score, row_number() over (partition by query_id order by score desc, pos) as rank from scored join stats using (pos))
  where rank <= 30)"""


def _values(many: dict[str, str]) -> str:
    return "(values " + ", ".join(f"('{k}', '{v}')" for k, v in many.items()) + ") t(query_id, text)"


@query("normalize_text", f"select doc_id, {_norm('text')} as normalized from documents")
def normalize_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("normalized"))


@query("term_counts", f"select term, count(*)::bigint as n from (select unnest({_terms('text')}) as term from documents) group by term")
def term_counts(spark, sf_dir):
    terms = T.terms(F.col("text"))
    return read(spark, sf_dir, "documents").select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("token_count_docs", f"select doc_id, len(regexp_extract_all(text, '{TOKEN_RE}'))::int as n_tokens from documents")
def token_count_docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


WINDOWS = f"""
t as (select doc_id, len(regexp_extract_all(text, '{TOKEN_RE}'))::int as n_tokens from documents),
w as (select doc_id, n_tokens, unnest(range(0, case when n_tokens <= 384 then 1 else ceil((n_tokens - 384) / 336.0)::int + 1 end))::int as "window" from t where n_tokens > 0),
windows as (select doc_id, "window", ("window" * 336)::int as first, least("window" * 336 + 384, n_tokens)::int as last, n_tokens from w)"""


@query("fixed_token_windows", f"with {WINDOWS} select * from windows")
def fixed_token_windows(spark, sf_dir):
    return chunk.fixed_windows(read(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    "window_coverage_check",
    f"""with {WINDOWS}, g as (select *, max(last) over (partition by doc_id order by first rows between unbounded preceding and 1 preceding) as upto from windows)
    select doc_id, bool_and(first <= coalesce(upto, 0)) and max(last) = max(n_tokens) as covered from g group by doc_id""",
)
def window_coverage_check(spark, sf_dir):
    before = Window.partitionBy("doc_id").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    rows = fixed_token_windows(spark, sf_dir).withColumn("upto", F.coalesce(F.max("last").over(before), F.lit(0)))
    return rows.groupBy("doc_id").agg((F.bool_and(F.col("first") <= F.col("upto")) & (F.max("last") == F.max("n_tokens"))).alias("covered"))


@query("chunk_ids", f"with {VIEW} select pos, id, type from corpus")
def chunk_ids(spark, sf_dir):
    return corpus(spark, sf_dir).select("pos", "id", "type")


@query("topic_fields", f"with {VIEW} select pos, topic_text from corpus")
def topic_fields(spark, sf_dir):
    return corpus(spark, sf_dir, topic=True).select("pos", "topic_text")


@query("weighted_term_freq", f"with {TF} select pos, term, freq from tf")
def weighted_term_freq(spark, sf_dir):
    return bm25.weighted_terms(corpus(spark, sf_dir, topic=True))


@query("postings", f"with {TF} select term, pos, freq, length from tf join stats using (pos)")
def postings(spark, sf_dir):
    return bm25.build_postings(corpus(spark, sf_dir, topic=True)).postings.select("term", "pos", "freq", "length")


@query("doc_lengths", f"with {TF} select pos, id, length from stats")
def doc_lengths(spark, sf_dir):
    return bm25.build_postings(corpus(spark, sf_dir, topic=True)).stats


@query("avg_length", f"with {TF} select n_docs::bigint as n_docs, round(avg_length, 6) as avg_length from corp")
def avg_length(spark, sf_dir):
    return bm25.build_postings(corpus(spark, sf_dir, topic=True)).corpus.select("n_docs", F.round("avg_length", 6).alias("avg_length"))


@query("doc_freq_idf", f"with {TF} select term, df::bigint as df, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 9) as idf from dfs, corp")
def doc_freq_idf(spark, sf_dir):
    found = bm25.document_frequencies(bm25.build_postings(corpus(spark, sf_dir, topic=True)))
    return found.select("term", "df", F.round("idf", 9).alias("idf"))


@query("bm25_topk", f"with {_scores(_values({'q': QUERY}))} select pos, id, score, rank from lexical")
def bm25_topk(spark, sf_dir):
    return bm25.search(saved(spark, sf_dir), asked(spark, {"q": QUERY})).drop("query_id")


@query("bm25_multi_query", f"with {_scores(_values(MANY))} select query_id, pos, id, score, rank from lexical")
def bm25_multi_query(spark, sf_dir):
    return bm25.search(saved(spark, sf_dir), asked(spark, MANY))


@query("contamination_search", f"with {_scores('(select item_id::varchar as query_id, text from benchmark)')} select query_id, pos, score, rank from lexical where rank <= 5")
def contamination_search(spark, sf_dir):
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")
    return bm25.search(saved(spark, sf_dir), queries, 5).select("query_id", "pos", "score", "rank")


CONVERSATION = f"""
words as (select conv_id * 1000 + turn as pos, unnest({_terms('text')}) as term from conversations),
tf as (select pos, term, count(*)::double as freq from words group by pos, term),
stats as (select c.conv_id * 1000 + c.turn as pos, coalesce(l.length, 1.0) as length from conversations c left join (select pos, sum(freq) as length from tf group by pos) l on l.pos = c.conv_id * 1000 + c.turn),
corp as (select count(*) as n_docs, avg(length) as avg_length from stats),
dfs as (select term, count(*) as df from tf group by term),
q as (select term, count(*) as qf from (select unnest({_terms(f"'{QUERY}'")}) as term) group by term),
scored as (select pos, round(sum(qf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * freq * 2.5 / (freq + 1.5 * (0.25 + 0.75 * length / avg_length))), 9) as score
  from q join tf using (term) join dfs using (term) join stats using (pos), corp group by pos)"""


@query("conversation_search", f"with {CONVERSATION} select pos, score, rank::int as rank from (select pos, score, row_number() over (order by score desc, pos) as rank from scored) where rank <= 30")
def conversation_search(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "text")
    empty = F.lit("")
    index = bm25.build_postings(rows.select("pos", F.col("pos").cast("string").alias("id"), empty.alias("heading"), empty.alias("topic_text"), "text"))
    return bm25.search(index, asked(spark, {"q": QUERY})).select("pos", "score", "rank")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings")


def first_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query for each label: its first vector. There are as many labels as classes, so few."""
    first = vectors(spark, sf_dir).groupBy("label").agg(F.min_by("embedding", "vec_id").alias("qvec"), F.min("vec_id").alias("own"))
    return first.select(F.col("label").cast("string").alias("query_id"), "qvec", "own")


COS = "greatest(0.0, least(1.0, list_dot_product(v.embedding::double[], q.embedding::double[]) / (sqrt(list_dot_product(v.embedding::double[], v.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])))))"
NEAR = f"""
first as (select label::varchar as query_id, min(vec_id) as own from embeddings group by label),
qv as (select f.query_id, e.embedding, f.own from first f join embeddings e on e.vec_id = f.own),
near as (select query_id, vec_id, label, score, rank::int as rank from (
  select q.query_id, v.vec_id, v.label, round({COS}, 9) as score, row_number() over (partition by q.query_id order by round({COS}, 9) desc, v.vec_id) as rank from embeddings v, qv q)
  where rank <= 30)"""


@query("cosine_topk", f"with {NEAR} select vec_id, round(score, 6) as score, rank from near where query_id = (select min(query_id) from first)")
def cosine_topk(spark, sf_dir):
    queries = first_vectors(spark, sf_dir)
    one = queries.orderBy("query_id").limit(1)  # the feature: one query
    return fuse.cosine_topk(vectors(spark, sf_dir), one, 30, "vec_id").select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query("vector_profile", f"with {NEAR} select query_id, vec_id, round(score, 6) as score, rank from near where rank <= 5")
def vector_profile(spark, sf_dir):
    found = fuse.cosine_topk(vectors(spark, sf_dir), first_vectors(spark, sf_dir), 5, "vec_id")
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


BUCKETS = f"""
hashed as (select doc_id, ('0x' || substr(md5(w), 1, 2))::int % 64 as b from (select doc_id, unnest({_terms('text')}) as w from documents)),
counts as (select doc_id, b, count(*)::double as c from hashed group by doc_id, b),
norms as (select doc_id, sqrt(sum(c * c)) as n from counts group by doc_id),
embedded as (select doc_id, b, c / n as x from counts join norms using (doc_id))"""


@query("hash_embed_docs", f"with {BUCKETS} select doc_id, b as bucket, round(x, 6) as x from embedded")
def hash_embed_docs(spark, sf_dir):
    found = hash_embedding_entries(read(spark, sf_dir, "documents"), "doc_id", T.terms(F.col("text"), False))
    return found.select("doc_id", "bucket", F.round("x", 6).alias("x"))


@query(
    "hash_embed_search",
    f"""with {BUCKETS}, q as (select * from embedded where doc_id = 0),
    s as (select e.doc_id, round(sum(e.x * q.x), 9) as score from embedded e join q using (b) group by e.doc_id)
    select doc_id, round(score, 6) as score, rank::int as rank from (select doc_id, score, row_number() over (order by score desc, doc_id) as rank from s) where rank <= 30""",
)
def hash_embed_search(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", hash_embedding(T.terms(F.col("text"), False)).alias("embedding"))
    one = rows.filter("doc_id = 0").select(F.lit("q").alias("query_id"), F.col("embedding").alias("qvec"))
    return fuse.cosine_topk(rows, one, 30, "doc_id").select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


# Hybrid search: one query with a text and a vector.
HYBRID = f"""{_scores(_values({'q': QUERY}))},
own as (select e.* from embeddings e where vec_id in (select doc_id from documents)),
qv as (select embedding from embeddings order by vec_id limit 1),
cosines as (select v.vec_id, round({COS}, 9) as score from own v, qv q),
nearest as (select 'q' as query_id, c.id, row_number() over (order by score desc, c.id) as rank from cosines join corpus c on c.pos = vec_id qualify rank <= 30),
ranked as (select query_id, id, rank from nearest union all select query_id, id, rank from lexical),
fused as (select query_id, id, round(sum(1.0 / (60 + rank)), 12)::double as raw from ranked group by query_id, id)"""


def _fused(spark, sf_dir):
    chunks = corpus(spark, sf_dir, topic=True)
    lexical = bm25.search(saved(spark, sf_dir), asked(spark, {"q": QUERY}))
    rows = vectors(spark, sf_dir)
    one = rows.orderBy("vec_id").limit(1).select(F.lit("q").alias("query_id"), F.col("embedding").alias("qvec"))
    own = rows.join(chunks.select(F.col("pos").alias("vec_id"), "id"), "vec_id")
    return chunks, [fuse.cosine_topk(own, one, 30), lexical]


@query("rrf_fusion", f"with {HYBRID} select id, round(raw, 9) as raw from fused")
def rrf_fusion(spark, sf_dir):
    _, lists = _fused(spark, sf_dir)
    return fuse.rrf(lists).select("id", F.round("raw", 9).alias("raw"))


@query("rrf_full_outer", f"with {HYBRID} select id, round(raw, 9) as raw from fused")
def rrf_full_outer(spark, sf_dir):
    _, (near, lexical) = _fused(spark, sf_dir)
    both = near.select("id", F.col("rank").alias("a")).join(lexical.select("id", F.col("rank").alias("b")), "id", "full")
    part = lambda c: F.coalesce(1 / (fuse.RRF_K + F.col(c)), F.lit(0.0))
    return both.select("id", F.round(part("a") + part("b"), 9).alias("raw"))


def _hits(source: str, order: str, top: int = 10) -> str:
    return f"""with {HYBRID},
meta as (select f.id, {source} as source, heading, type, raw from fused f join corpus using (id) join documents on doc_id = pos),
best as (select *, first_value(raw) over (order by {order}) as best, row_number() over (partition by source, heading order by {order}) as nth from meta),
hits as (select *, row_number() over (order by {order}) as rank from best where nth = 1)
select id, source, heading, type, round(raw / best, 4) as score, round(raw, 4) as raw_score, rank::int as rank from hits where rank <= {top}"""


def _finished(spark, sf_dir, **options):
    chunks, lists = _fused(spark, sf_dir)
    return fuse.finish(fuse.rrf(lists), chunks, 10, **options).select("id", "source", "heading", "type", "score", "raw_score", "rank")


@query("hybrid_search", _hits("corpus.source", "raw desc, id"))
def hybrid_search(spark, sf_dir):
    return _finished(spark, sf_dir)


@query("hybrid_demoted", _hits("corpus.source", "(type = 'frontmatter')::int, raw desc, id"))
def hybrid_demoted(spark, sf_dir):
    return _finished(spark, sf_dir, demote_frontmatter=True)


@query("dedup_first", _hits("documents.source", "raw desc, id"))
def dedup_first(spark, sf_dir):
    chunks, lists = _fused(spark, sf_dir)
    chunks = chunks.withColumn("source", T.topic_of(F.col("source")))
    return fuse.finish(fuse.rrf(lists), chunks, 10).select("id", "source", "heading", "type", "score", "raw_score", "rank")


@query("relative_score", f"with {HYBRID} select id, round(raw / max(raw) over (), 4) as score from fused")
def relative_score(spark, sf_dir):
    _, lists = _fused(spark, sf_dir)
    fused = fuse.rrf(lists)
    best = fused.groupBy("query_id").agg(F.max("raw").alias("best"))
    return fused.join(best, "query_id").select("id", F.round(F.col("raw") / F.col("best"), 4).alias("score"))


@query("confidence_bands", f"with {HYBRID} select id, case when raw >= 0.025 then 'strong' when raw >= 0.015 then 'usable' when raw < 0.012 then 'weak' else 'unlabelled' end as band from fused")
def confidence_bands(spark, sf_dir):
    _, lists = _fused(spark, sf_dir)
    return fuse.rrf(lists).select("id", fuse.band(F.col("raw")).alias("band"))


@query(
    "snapshot_diff",
    """with o as (select sha256(text) as id from documents where doc_id % 5 <> 0), n as (select sha256(text) as id from documents where doc_id % 5 <> 1),
    f as (select o.id as o, n.id as n from (select distinct id from o) o full join (select distinct id from n) n on o.id = n.id)
    select count(*) filter (o is null) as added, count(*) filter (n is null) as removed, count(*) filter (o is not null and n is not null) as unchanged from f""",
)
def snapshot_diff(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("id"))
    return diff.snapshot_diff(rows.filter("doc_id % 5 <> 0"), rows.filter("doc_id % 5 <> 1"))


MANIFESTS = """e as (select doc_id as path, md5(text) as hash from documents where doc_id % 11 <> 0),
f as (select doc_id as path, case when doc_id % 13 = 0 then 'other' else md5(text) end as hash from documents where doc_id % 7 <> 0)"""


@query(
    "manifest_diff",
    f"""with {MANIFESTS} select * from (select coalesce(e.path, f.path) as path,
    case when f.path is null then 'missing' when e.path is null then 'extra' when e.hash <> f.hash then 'stale' end as state from e full join f on e.path = f.path) where state is not null""",
)
def manifest_diff(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"))
    found = docs.filter("path % 7 <> 0").withColumn("hash", F.when(F.col("path") % 13 == 0, "other").otherwise(F.col("hash")))
    return diff.manifest_diff(docs.filter("path % 11 <> 0"), found)


@query("new_docs_anti", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def new_docs_anti(spark, sf_dir):
    return diff.new_rows(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id")


def _clean(c: str) -> str:
    return f"trim(regexp_replace(replace(replace(replace(replace(regexp_replace({c}, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '\\s+', ' ', 'g'))"


BLOCKS = f"""
a as (select page_id, url, html, case when instr(html, '<article') > 0 then split_part(substr(html, instr(html, '<article')), '</article>', 1) else '' end as article from pages),
p as (select page_id, list_filter(list_transform(regexp_extract_all(article, '(?s)<p[^>]*>(.*?)</p>', 1), lambda x: {_clean('x')}), lambda x: length(x) > 40) as ps,
      list_filter(list_transform(regexp_extract_all(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), lambda x: {_clean('x')}), lambda x: length(x) > 5) as hs, url from a),
b as (select page_id, url, list_concat(ps, list_transform(hs, lambda x: chr(10) || '## ' || x || chr(10))) as blocks from p)"""


@query("html_blocks", f"with {BLOCKS} select page_id, len(blocks)::int as n_blocks, array_to_string(blocks, chr(10)) as body from b")
def html_blocks(spark, sf_dir):
    blocks = ingest.html_blocks(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", F.size(blocks).alias("n_blocks"), F.array_join(blocks, "\n").alias("body"))


@query("html_headings", f"with {BLOCKS} select page_id, array_to_string(hs, '|') as headings from p")
def html_headings(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(ingest.headings(F.col("html")), "|").alias("headings"))


@query(
    "page_markdown",
    f"""with {BLOCKS}, t as (select page_id, url, trim(array_to_string(blocks, chr(10)), ' ' || chr(10)) as body from b)
    select page_id, case when length(body) > 0 then '# page ' || page_id || chr(10) || chr(10) || '> Crawled locally from ' || url || chr(10) || chr(10) || body else '' end as markdown from t""",
)
def page_markdown(spark, sf_dir):
    title = F.concat(F.lit("page "), F.col("page_id").cast("string"))
    return read(spark, sf_dir, "pages").select("page_id", ingest.page_markdown(F.col("html"), title, F.col("url")).alias("markdown"))


@query(
    "crawl_stats",
    f"""with {BLOCKS} select count(*) as pages, count(html) as fetched, count(*) - count(html) as failed, count(*) filter (len(blocks) > 0) as written,
    sum(len(blocks))::bigint as blocks, sum(length(array_to_string(blocks, chr(10))))::bigint as chars from b join pages using (page_id)""",
)
def crawl_stats(spark, sf_dir):
    return ingest.crawl_stats(read(spark, sf_dir, "pages"))


@query(
    "privacy_scan",
    f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as line from documents),
    m as (select doc_id, line::int as line, unnest([case when regexp_matches(content, '{EMAIL}') then 'email' end, case when regexp_matches(content, '{NUMBER}') then 'number' end]) as label, substr(trim(content), 1, 200) as content from l)
    select * from m where label is not null""",
)
def privacy_scan(spark, sf_dir):
    return ingest.privacy_scan(read(spark, sf_dir, "documents"), "doc_id", patterns=(("email", EMAIL), ("number", NUMBER)))


@query(
    "sanitize_lines",
    """select doc_id, regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: not regexp_matches(x, '(?i)^(You are an? .*expert.*|Ask the developer.*|Ask which area.*|Ask the user.*)$') and not contains(x, '.agents/')), chr(10)), '\\n+$', '') || chr(10) as text from documents""",
)
def sanitize_lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", ingest.sanitized(F.col("text")).alias("text"))


@query(
    "dictionary_grounding",
    f"with d as (select {_norm('text')} as t from documents), c as (select unnest({list(CONCEPTS)!r}) as concept) select concept, bool_or(contains(t, {_norm('concept')})) as grounded from c, d group by concept",
)
def dictionary_grounding(spark, sf_dir):
    return ingest.dictionary_grounding(read(spark, sf_dir, "documents"), spark.createDataFrame([(c,) for c in CONCEPTS], "concept string"))


# Evaluation: the first vector of each label asks, vectors of its label are relevant.
RANKED = f"{NEAR}, first_hit as (select f.query_id, min(n.rank) as first from first f left join near n on n.query_id = f.query_id and n.label::varchar = f.query_id and n.vec_id <> f.own and n.rank <= 30 group by f.query_id)"


def _ranked(spark, sf_dir):
    queries = first_vectors(spark, sf_dir)
    found = fuse.cosine_topk(vectors(spark, sf_dir), queries, 30, "vec_id").withColumnRenamed("id", "vec_id")
    full = found.join(vectors(spark, sf_dir).select("vec_id", "label"), "vec_id").join(queries.select("query_id", "own"), "query_id")
    relevant = (F.col("label").cast("string") == F.col("query_id")) & (F.col("vec_id") != F.col("own"))
    return evaluate.first_relevant(full, relevant, queries, 30)


@query("recall_at_k", f"with {RANKED} select round(avg((coalesce(first, 1000) <= 3)::int), 6) as recall from first_hit")
def recall_at_k(spark, sf_dir):
    return evaluate.recall_at_k(_ranked(spark, sf_dir)).select(F.round("recall", 6).alias("recall"))


@query("mrr_at_k", f"with {RANKED} select round(avg(case when first <= 5 then 1.0 / first else 0 end), 6) as mrr from first_hit")
def mrr_at_k(spark, sf_dir):
    return evaluate.mrr_at_k(_ranked(spark, sf_dir)).select(F.round("mrr", 6).alias("mrr"))


@query("split_stats", f"with {RANKED} select query_id::int % 2 as split, count(*) as queries, round(avg((coalesce(first, 1000) <= 3)::int), 6) as recall, round(avg(case when first <= 5 then 1.0 / first else 0 end), 6) as mrr from first_hit group by 1")
def split_stats(spark, sf_dir):
    found = evaluate.split_stats(_ranked(spark, sf_dir).withColumn("split", F.col("query_id").cast("int") % 2), ["split"])
    return found.select("split", "queries", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


PASSAGES = f"{_scores('(select item_id::varchar as query_id, text from benchmark)')}, labels_ as (select query_id, min_by(source, pos) as source, min_by(heading, pos) as heading from (select l.query_id, l.pos, c.source, c.heading from lexical l join corpus c using (pos) where query_id::int % 3 <> 0) group by query_id)"


@query("passage_recall", f"with {PASSAGES}, hit as (select distinct l.query_id from lexical l join corpus c using (pos) join labels_ x on x.query_id = l.query_id and x.source = c.source and x.heading = c.heading where l.rank <= 3) select round(count(h.query_id) * 1.0 / count(*), 6) as passage_recall from labels_ left join hit h using (query_id)")
def passage_recall(spark, sf_dir):
    """Labels: of each benchmark item's hits, the document with the least number; a third of the items have none."""
    chunks = corpus(spark, sf_dir, topic=True)
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")
    hits = bm25.search(saved(spark, sf_dir), queries).join(chunks.select("pos", "source", "heading"), "pos")
    labels = hits.filter("cast(query_id as int) % 3 <> 0").groupBy("query_id").agg(F.min_by("source", "pos").alias("source"), F.min_by("heading", "pos").alias("heading"))
    return evaluate.passage_recall(hits, labels).select(F.round("passage_recall", 6).alias("passage_recall"))


@query(
    "p95_exclusive",
    """with r as (select event_type, value, row_number() over (partition by event_type order by value) as i, count(*) over (partition by event_type) as n from events where value is not null),
    a as (select event_type, n, 0.95 * (n + 1) as place, greatest(1, least(floor(0.95 * (n + 1)), n - 1)) as k from r group by event_type, n)
    select a.event_type, round(lo.value + (hi.value - lo.value) * (place - k), 6) as quantile from a join r lo on lo.event_type = a.event_type and lo.i = k join r hi on hi.event_type = a.event_type and hi.i = k + 1""",
)
def p95_exclusive(spark, sf_dir):
    found = evaluate.exclusive_quantile(read(spark, sf_dir, "events"), "value", 0.95, ["event_type"])
    return found.select("event_type", F.round("quantile", 6).alias("quantile"))


@query(
    "gates",
    f"""with {RANKED}, m as (select avg((coalesce(first, 1000) <= 3)::int) as recall, avg(case when first <= 5 then 1.0 / first else 0 end) as mrr from first_hit)
    select 'recall' as gate, round(recall, 6) as value, recall >= 0.8 as passed from m union all select 'mrr', round(mrr, 6), mrr >= 0.5 from m""",
)
def gates(spark, sf_dir):
    found = _ranked(spark, sf_dir)
    metrics = evaluate.recall_at_k(found).crossJoin(evaluate.mrr_at_k(found))  # one row each
    return evaluate.gates(metrics, {"recall": (">=", 0.8), "mrr": (">=", 0.5)}).select("gate", F.round("value", 6).alias("value"), "passed")


from . import catalogue_indexes, catalogue_inputs  # noqa: E402,F401  register their queries here
