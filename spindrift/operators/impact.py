"""BM25 over postings in order of impact: exact top-k that reads only the postings that can matter.

A posting's impact is its share of a score before the term's weight; postings lie sorted by term and falling impact, so the
statistics of Parquet's row groups and pages are maxima of impact, and a filter `term = t and impact >= x` skips the rest.
A search runs in three steps, as for a top-k over distributed lists with one threshold for each list:

1. The best postings of each query term give partial scores, and the k-th best of these a lower bound of the k-th score.
2. The bound is divided among the terms: a document that reaches it contributes at least one term's share. Terms of long
   lists and small contributions get shares above all that they can add, so none of their postings is read. Postings from the
   shares upwards give partial scores again; what is unread of a term adds less than its share, so partial scores bound
   scores from above, and the better k-th partial score drops most documents.
3. The rest are looked up in the term frequencies by document, and scored in full.

A stop word contributes little for all its postings, so of its list hardly anything is read but by lookups.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.local import local
from .bm25 import CANDIDATES, DIGITS, SHORT_PAGES, Postings, any_of, exploded, impact, nearest, query_terms, spans, top, weight

#: Postings of each term that the first step reads.
HEAD = 64
#: Query terms, and documents, that are named in filters; more meet the postings by joins.
MOST_TERMS, MOST_DOCUMENTS = 256, 2048
#: Sums in another order differ by less.
SLACK = 1e-8


@dataclass(frozen=True)
class Impacts:
    """impacts (term, impact, pos) sorted by term and falling impact; levels (term, df, top, cut), cut being the HEAD-th
    impact; documents (pos, length, terms, freqs), those of the postings; n_docs and avg_length."""

    impacts: DataFrame
    levels: DataFrame
    documents: DataFrame
    postings: Postings
    n_docs: int
    avg_length: float


def save_impacts(index: Postings, path: str) -> Impacts:
    """Writes impacts and levels below a folder. A term's postings may lie in many files: they are dealt by term and impact.
    The postings are shuffled once; documents are looked up in the table that the index has."""
    spark = index.documents.sparkSession
    rows = exploded(index.documents).crossJoin(F.broadcast(index.corpus)).select("term", impact(F.col("avg_length")).alias("impact"), "pos")  # one row
    rows.repartitionByRange("term", F.desc("impact")).sortWithinPartitions("term", F.desc("impact"), "pos").write.options(**SHORT_PAGES).parquet(f"{path}/impacts")
    written = spark.read.parquet(f"{path}/impacts")
    best = Window.partitionBy("term").orderBy(F.desc("impact"))  # cut to HEAD rows of each term before it is shuffled
    heads = written.select("term", "impact").withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= HEAD)
    levels = heads.groupBy("term").agg(F.max("impact").alias("top"), F.min("impact").alias("cut")).join(index.terms, "term").select("term", "df", "top", "cut")
    levels.repartitionByRange("term").sortWithinPartitions("term").write.options(**SHORT_PAGES).parquet(f"{path}/levels")
    return open_impacts(index, path)


def open_impacts(index: Postings, path: str) -> Impacts:
    spark: SparkSession = index.documents.sparkSession
    impacts, levels = (spark.read.parquet(f"{path}/{t}") for t in ("impacts", "levels"))
    sizes = index.corpus.first()
    return Impacts(impacts, levels, index.documents, index, sizes.n_docs, sizes.avg_length)


@dataclass(frozen=True)
class Plan:
    """Of a search: weights and greatest contributions by (query, term), floors of impact for its second step, the documents
    to score (a table, and the list of their numbers where it is short)."""

    weights: dict
    floors: dict
    documents: DataFrame | None
    numbers: list[int] | None
    read: list[Column]


def _partial(index: Impacts, wanted: Column, rows: list[tuple]) -> DataFrame:
    """query_id, pos, got, seen for the postings that `wanted` names and that reach their query's own floor. rows: query_id,
    term, weight, floor of impact, share: what a document that lacks the posting here may gain by it."""
    spark = index.impacts.sparkSession
    asked = local(spark, rows, "query_id string, term string, weight double, floor double, share double")
    met = index.impacts.filter(wanted).join(F.broadcast(asked), "term").filter(F.col("impact") >= F.col("floor"))  # MOST_TERMS rows for each query at most
    return met.groupBy("query_id", "pos").agg(F.sum(F.col("weight") * F.col("impact")).alias("got"), F.sum("share").alias("seen"))


def _nth(partial: DataFrame, k: int) -> dict[str, float]:
    """The k-th best partial score of each query that has so many."""
    best = Window.partitionBy("query_id").orderBy(F.desc("got"))
    found = partial.select("query_id", "got").withColumn("nth", F.row_number().over(best)).filter(F.col("nth") == k)
    return {r.query_id: r.got for r in found.collect()}


def shares(most: dict[str, float], df: dict[str, int], bound: float) -> dict[str, float]:
    """Divides a bound among terms by their greatest contributions and the lengths of their lists. The terms that save most
    postings for their share get all that they can add, while the bound lasts; the others divide the rest."""
    out, left = {}, max(0.0, bound)
    for t in sorted(most, key=lambda t: (-df[t] / max(most[t], SLACK), t)):
        whole = most[t] * (1 + 1e-9) + SLACK
        if whole <= left:
            out[t] = whole
            left -= whole
    rest = sum(x for t, x in most.items() if t not in out)
    return {t: out[t] if t in out else left * x / rest if rest > 0 else 0.0 for t, x in most.items()}


def plan(index: Impacts, terms: list, limit: int) -> Plan:
    """Steps 1 and 2 for query terms (query_id, term, qf) that the driver knows."""
    by_term = sorted({r.term for r in terms})
    levels = {r.term: r for r in index.levels.filter(any_of([F.col("term") == t for t in by_term])).collect()}
    weights = {(r.query_id, r.term): weight(r.qf, index.n_docs, levels[r.term].df) for r in terms if r.term in levels}
    if not weights:
        return Plan({}, {}, None, [], [])
    named = {t: levels[t] for _, t in weights}
    heads = any_of([(F.col("term") == t) & (F.col("impact") >= x.cut) for t, x in named.items()])
    first = _nth(_partial(index, heads, [(q, t, w, 0.0, 0.0) for (q, t), w in weights.items()]), limit)
    own: dict[str, dict[str, float]] = defaultdict(dict)
    for (q, t), w in weights.items():
        own[q][t] = w * named[t].top
    floors = {(q, t): x / weights[q, t] for q, most in own.items() for t, x in shares(most, {t: named[t].df for t in most}, first.get(q, 0.0) - SLACK).items()}
    least: dict[str, float] = {}
    for (_, t), x in floors.items():
        least[t] = min(x, least.get(t, x))
    second = any_of([(F.col("term") == t) & (F.col("impact") >= x) for t, x in least.items()])
    partial = _partial(index, second, [(q, t, w, floors[q, t], w * floors[q, t]) for (q, t), w in weights.items()]).persist()
    bound = _nth(partial, limit)
    spark = index.impacts.sparkSession
    unseen: dict[str, float] = defaultdict(float)
    for (q, t), w in weights.items():
        unseen[q] += w * floors[q, t]
    limits = local(spark, [(q, x, bound.get(q, 0.0) - SLACK) for q, x in unseen.items()], "query_id string, unseen double, bound double")
    chosen = partial.join(F.broadcast(limits), "query_id").filter(F.col("got") + F.col("unseen") - F.col("seen") >= F.col("bound")).select("query_id", "pos")
    some = chosen.select("query_id", "pos").limit(MOST_DOCUMENTS + 1).collect()
    if len(some) <= MOST_DOCUMENTS:
        partial.unpersist()
        kind = index.documents.schema["pos"].dataType.simpleString()
        chosen = local(spark, [(r.query_id, r.pos) for r in some], f"query_id string, pos {kind}")
        return Plan(weights, floors, chosen, sorted({r.pos for r in some}), [heads, second])
    return Plan(weights, floors, chosen, None, [heads, second])


def search(index: Impacts, queries: DataFrame, limit: int = CANDIDATES, compatibility: bool = True) -> DataFrame:
    """query_id, pos, id, score, rank: the rows of bm25.search. Queries (query_id, text) of more than MOST_TERMS terms in all
    meet all documents, as there."""
    asked = query_terms(queries.select(F.col("query_id").cast("string").alias("query_id"), "text"), compatibility)
    terms = asked.limit(MOST_TERMS + 1).collect()
    if len(terms) > MOST_TERMS:
        best = top(nearest(index.postings, queries, limit, compatibility), limit)
    else:
        best = top(_scored(index, plan(index, terms, limit)), limit)
        best = best.withColumn("query_id", F.col("query_id").cast(queries.schema["query_id"].dataType))
    return best.join(index.postings.stats.select("pos", "id"), "pos").select("query_id", "pos", "id", "score", "rank")


def _scored(index: Impacts, made: Plan) -> DataFrame:
    """query_id, pos, score of a plan's documents, from their own term frequencies."""
    spark = index.impacts.sparkSession
    kind = index.documents.schema["pos"].dataType.simpleString()
    if not made.weights:
        return local(spark, [], f"query_id string, pos {kind}, score double")
    documents = index.documents
    if made.numbers is not None:
        documents = documents.filter(any_of([F.col("pos").between(a, b) for a, b in spans(made.numbers)]) & F.col("pos").isin(made.numbers))
    own = exploded(documents).filter(any_of([F.col("term") == t for t in sorted({t for _, t in made.weights})]))
    weights = local(spark, [(q, t, w) for (q, t), w in made.weights.items()], "query_id string, term string, weight double")
    met = own.join(F.broadcast(weights), "term").join(made.documents, ["query_id", "pos"])
    part = F.col("weight") * impact(F.lit(float(index.avg_length)))
    return met.groupBy("query_id", "pos").agg(F.round(F.sum(part), DIGITS).alias("score"))


def postings_read(index: Impacts, queries: DataFrame, limit: int = CANDIDATES, compatibility: bool = True) -> dict[str, int]:
    """How many postings a search reads in its steps, and how many the index and the query terms' lists have."""
    terms = query_terms(queries.select(F.col("query_id").cast("string").alias("query_id"), "text"), compatibility).collect()
    made = plan(index, terms, limit)
    lists = index.impacts.filter(any_of([F.col("term") == t for t in sorted({t for _, t in made.weights})])).count()
    steps = [index.impacts.filter(c).count() for c in made.read]
    looked = exploded(index.documents.filter(F.col("pos").isin(made.numbers or []))).filter(F.col("term").isin(sorted({t for _, t in made.weights}))).count()
    return {"first": steps[0] if steps else 0, "second": steps[1] if steps else 0, "lookups": looked, "lists": lists, "index": index.impacts.count()}
