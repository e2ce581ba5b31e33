"""Build, search, info and doctor of a hybrid document index."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import __version__
from ..functions.local import local
from ..functions.text import collapse, normalized_source, terms
from ..functions.vectors import hash_embedding, hash_embedding_batches
from ..operators import bm25, chunk, diff, expand, fuse
from ..sources import files
from .store import SCHEMA_VERSION, CorpusNotFound, IndexProblem, ModelUnavailable, SchemaMismatch, Store, require_ascii

CHUNKER_VERSION = "2"
PROFILES = ("hybrid", "vector")
#: Query terms that a search names in filters; with more it joins them.
MOST_NAMED = 256
# Fixed texts of results.
HEADLINE, NOTHING_FOUND = "🔍 检索：", "没有找到相关结果。"


class Embedder(Protocol):
    """Turns a column of texts into unit vectors. name and revision identify it; spans, if any, are its tokenizer's."""

    name: str
    revision: str | None
    dimension: int

    def embed(self, text: Column) -> Column: ...


@dataclass(frozen=True)
class HashingEmbedder:
    """Needs no model: words (CJK characters singly) in buckets by hash, as expressions."""

    dimension: int = 64
    name: str = "hashing"
    revision: str | None = "1"

    def _spaced(self, text: Column) -> Column:
        return collapse(F.regexp_replace(F.lower(text), r"([\x{3400}-\x{9fff}])", " $1 "))

    def embed(self, text: Column) -> Column:
        return hash_embedding(F.filter(F.split(self._spaced(text), " "), lambda w: w != ""), self.dimension)

    def embed_table(self, text: Column) -> Column:
        """The same vectors for whole tables, by Arrow batches."""
        return hash_embedding_batches(F.lower(text), self.dimension, "[\u3400-\u9fff]")


def embed_table(embedder: Embedder, text: Column) -> Column:
    """An embedder's vectors of a table's texts, by its way for tables if it has one."""
    return getattr(embedder, "embed_table", embedder.embed)(text)


@dataclass
class BatchEmbedder:
    """A model: encode takes up to `batch` texts and gives a vector for each. It travels to the tasks, which call it on Arrow
    batches. Without a dimension, one text is encoded on the driver to learn it; vectors get unit length."""

    encode: Callable[[list[str]], Iterable]
    name: str
    revision: str | None = None
    dimension: int = 0
    batch: int = 64

    def __post_init__(self):
        self.dimension = self.dimension or len(self._vectors(["x"])[0])

    def _vectors(self, texts: list[str]) -> list[np.ndarray]:
        found = [np.asarray(v, np.float64) for lo in range(0, len(texts), self.batch) for v in self.encode(texts[lo : lo + self.batch])]
        sizes = {len(v) for v in found}
        if len(found) != len(texts) or len(sizes) > 1 or (self.dimension and sizes and sizes != {self.dimension}):
            raise ModelUnavailable(f"{self.name} gave {len(found)} vectors of {sorted(sizes)} values for {len(texts)} texts")
        return [v / n if (n := np.linalg.norm(v)) > 0 else v for v in found]

    def embed(self, text: Column) -> Column:
        return F.pandas_udf(lambda s: pd.Series(self._vectors(s.fillna("").tolist()), index=s.index), "array<double>")(text)


@dataclass
class Index:
    spark: SparkSession
    root: str
    embedder: Embedder = field(default_factory=HashingEmbedder)
    glossary: Iterable[dict] = ()
    phrases: Iterable[tuple[str, Iterable[str]]] = ()
    topic_prefix: str = ""

    def __post_init__(self):
        self.store = Store(self.root)
        self.glossary, self.phrases = list(self.glossary), list(self.phrases)
        self.expander = expand.Expander(self.glossary, self.phrases)
        self._opened: tuple[str, tuple] | None = None

    # Building
    def fingerprint(self, corpus_dir: str) -> str:
        return files.fingerprint(files.file_hashes(files.read_bytes(self.spark, corpus_dir))).first().fingerprint

    def placed(self, docs: DataFrame, spans: chunk.Spans = chunk.regex_spans) -> DataFrame:
        """Chunks with ids and places: pos orders them by source and place in it."""
        # Documents are dealt in ranges of their sources before they are cut: few large files keep all tasks busy, no text is
        # cut twice to find the ranges, and the ids that Spark gives grow with (source, place), without one sort.
        dealt = docs.select(normalized_source(F.col("source")).alias("source"), "text").repartitionByRange("source")
        rows = chunk.chunk_documents(dealt, spans=spans)
        rows = rows.sortWithinPartitions("source", "pos").withColumn("pos", F.monotonically_increasing_id())
        known = self.spark.createDataFrame(self.glossary, files.GLOSSARY) if self.glossary else None
        return bm25.topic_text(F.col("source"), known, rows, self.topic_prefix)

    def chunks(self, docs: DataFrame, spans: chunk.Spans = chunk.regex_spans) -> DataFrame:
        """Chunks with ids, vectors and places."""
        return self.placed(docs, spans).withColumn("embedding", embed_table(self.embedder, F.col("text")))

    def build(self, corpus_dir: str, force: bool = False, append: bool = False, progress: Callable[[str], None] | None = None) -> dict:
        """Builds a snapshot of a folder's Markdown files and makes it the active one. append takes over a changed corpus and
        reports the difference; an index that exists is else only replaced with force. A failed build leaves the active
        snapshot as it is."""
        require_ascii(self.root)
        if "://" not in corpus_dir and not Path(corpus_dir).is_dir():
            raise CorpusNotFound(f"no folder {corpus_dir}")
        docs = files.read_markdown(self.spark, corpus_dir)
        return self.build_documents(docs, str(corpus_dir), lambda: self.fingerprint(corpus_dir), force, append, progress)

    def build_documents(self, docs: DataFrame, source: str, fingerprint: Callable[[], str], force: bool = False, append: bool = False, progress: Callable[[str], None] | None = None, repeats: str = "fail") -> dict:
        """The same for documents (source, text) from anywhere; `source` names where they come from. Chunks of one document that
        are equal have one id: repeats tells whether the build fails then, or takes the "first" of them."""
        say = progress or (lambda _: None)
        require_ascii(self.root)
        old = None
        try:
            old = self.store.current()
        except SchemaMismatch:
            if not force:
                raise
        except IndexProblem:
            pass
        if old is not None and not (force or append):
            raise IndexProblem("an index exists; build with force or append")
        with self.store.lock():
            n_files = docs.count()
            if not n_files:
                raise CorpusNotFound(f"no documents in {source}")
            self.store.sweep()
            snapshot = self.store.create()
            try:
                say(f"{n_files} files")
                path = str(snapshot)
                found = self.placed(docs)
                if repeats == "first":
                    found = found.withColumn("_nth", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).filter("_nth = 1").drop("_nth")
                found.withColumn("embedding", embed_table(self.embedder, F.col("text"))).write.parquet(f"{path}/chunks")
                written = self.spark.read.parquet(f"{path}/chunks")
                sizes = written.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids")).first()
                if not sizes.n:
                    raise CorpusNotFound("the corpus gives no chunks")
                if sizes.n != sizes.ids:
                    raise IndexProblem(f"{sizes.n - sizes.ids} chunk ids occur twice")
                say(f"{sizes.n} chunks")
                bm25.save_postings(written, path)
                previous = self.spark.read.parquet(f"{old}/chunks") if old else written.limit(0)
                change = diff.snapshot_diff(previous, written).first().asDict()
                manifest = {
                    "schema_version": SCHEMA_VERSION,
                    "built_at": datetime.now(timezone.utc).isoformat(),
                    "embedding": {"model": self.embedder.name, "revision": self.embedder.revision, "dimension": self.embedder.dimension, "normalization": "l2"},
                    "chunker": {"version": CHUNKER_VERSION, "max_tokens": 384, "overlap_tokens": 48},
                    "corpus": {"sha256": fingerprint(), "source": source, "documents": n_files, "chunks": sizes.n},
                }
                self.store.write_manifest(snapshot, manifest)
                self.store.activate(snapshot)
                self.store.retain()
            except BaseException:
                self.store.discard(snapshot)
                raise
        return {"files": n_files, "chunks": sizes.n, **change, "generation": snapshot.name, "schema_version": SCHEMA_VERSION, "root": self.root}

    # Searching
    def open(self) -> tuple[DataFrame, bm25.Postings, dict]:
        """The active snapshot, resolved once: chunks, postings, manifest. The embedder must be the one it was built with."""
        generation = self.store.current()
        manifest = self.store.manifest(generation)
        own = manifest["embedding"]
        if own["model"] != self.embedder.name or own["dimension"] != self.embedder.dimension or (own["revision"] is not None and own["revision"] != self.embedder.revision):
            raise ModelUnavailable(f"the index was built with {own['model']}, {own['dimension']} dimensions, revision {own['revision']}")
        if self._opened is None or self._opened[0] != str(generation):  # a generation never changes
            postings = bm25.open_postings(self.spark, str(generation))
            postings = replace(postings, corpus=local(self.spark, [tuple(r) for r in postings.corpus.collect()], postings.corpus.schema.simpleString()[7:-1].replace(":", " ")))  # one row
            self._opened = str(generation), (self.spark.read.parquet(f"{generation}/chunks"), postings, manifest)
        return self._opened[1]

    def search_many(self, queries: DataFrame, top_k: int = 5, profile: str = "hybrid", demote_frontmatter: bool = False, n_queries: int | None = None) -> DataFrame:
        """Hits of all queries (query_id, text) in one plan, n_queries of them if that is known: query_id, id, source, heading, type, score, raw_score, rank, text."""
        if profile not in PROFILES:
            raise ValueError(f"profile must be one of {', '.join(PROFILES)}")
        chunks, postings, _ = self.open()
        asked = queries.select("query_id", (self.expander.column(F.col("text")) if profile == "hybrid" else F.col("text")).alias("text"))
        vectors = asked.select("query_id", self.embedder.embed(F.col("text")).alias("qvec"))
        if profile == "vector":
            near = fuse.cosine_topk(chunks, vectors, max(0, top_k), n_queries=n_queries)
            own = chunks.select("id", "source", "heading", F.coalesce("type", F.lit("content")).alias("type"), "text")
            return near.join(own, "id").select("query_id", "id", "source", "heading", "type", "score", F.col("score").alias("raw_score"), "rank", "text")
        near = fuse.cosine_topk(chunks, vectors, bm25.CANDIDATES, n_queries=n_queries)
        lexical = bm25.search(postings, asked, bm25.CANDIDATES, n_queries=n_queries)
        return fuse.finish(fuse.rrf([near, lexical]), chunks, top_k, demote_frontmatter).select("query_id", "id", "source", "heading", "type", "score", "raw_score", "rank", "text")

    def search_texts(self, texts: dict[str, str], top_k: int = 5, profile: str = "hybrid", demote_frontmatter: bool = False) -> DataFrame:
        """The same for a few queries that the driver has, by query_id. Filters name their terms and, in the end, the places of
        the chunks that both lists give: of postings and chunks, what holds these is read."""
        asked = local(self.spark, list(texts.items()), "query_id string, text string")
        if profile not in PROFILES or profile == "vector":
            return self.search_many(asked, top_k, profile, demote_frontmatter, len(texts))
        chunks, postings, _ = self.open()
        expanded = {q: self.expander(t) for q, t in texts.items()}
        composed = local(self.spark, [(q, unicodedata.normalize("NFKC", t)) for q, t in expanded.items()], "query_id string, text string")
        lists = composed.select("query_id", terms(F.col("text"), False).alias("terms")).collect()
        named = [(r.query_id, t, n) for r in lists for t, n in Counter(r.terms).items()]
        if len(named) > MOST_NAMED:
            return self.search_many(asked, top_k, profile, demote_frontmatter, len(texts))
        sizes = postings.corpus.first()
        lexical = bm25.top(bm25.named_scores(postings, named, sizes.n_docs, sizes.avg_length), bm25.CANDIDATES)
        vectors = local(self.spark, list(expanded.items()), "query_id string, text string").select("query_id", self.embedder.embed(F.col("text")).alias("qvec"))
        keyed = chunks.select(F.struct("id", "pos").alias("key"), "embedding")  # in the order of the ids
        near = fuse.cosine_topk(keyed, vectors, bm25.CANDIDATES, "key", n_queries=len(texts)).select("query_id", F.col("id.pos").alias("id"), "rank")
        raw = fuse.rrf([near, lexical.select("query_id", F.col("pos").alias("id"), "rank")]).collect()  # two lists of CANDIDATES for each query
        places = sorted({r.id for r in raw})
        wanted = bm25.any_of([F.col("pos").between(a, b) for a, b in bm25.spans(places)])  # for the scan; the list is exact
        columns = ["pos", "id", "source", "heading", "type", "text"]
        hits = chunks.select(*columns).filter(wanted & F.col("pos").isin(places))
        rows = [tuple(r[c] for c in columns) for r in hits.collect()]
        at = {r[0]: r[1] for r in rows}
        found = local(self.spark, [(r.query_id, at[r.id], r.raw) for r in raw], "query_id string, id string, raw double")
        own = local(self.spark, [r[1:] for r in rows], "id string, source string, heading string, type string, text string")
        return fuse.finish(found, own, top_k, demote_frontmatter).select("query_id", "id", "source", "heading", "type", "score", "raw_score", "rank", "text")

    def search(self, text: str, top_k: int = 5, profile: str = "hybrid", demote_frontmatter: bool = False) -> DataFrame:
        """Hits of one query, best first."""
        return self.search_texts({"q": text}, top_k, profile, demote_frontmatter).drop("query_id", "id").orderBy("rank")

    # Health
    def package(self) -> dict:
        """What answers: the package's version and place, the embedder, the number of topics."""
        return {"package_version": __version__, "module_path": str(Path(__file__).resolve().parents[1]), "model_name": self.embedder.name, "topic_count": len(self.glossary), "root": self.root}

    def info(self, corpus_dir: str | None = None) -> dict:
        """Generation, manifest, stale (the corpus differs; None without its folder) and whether the embedder matches."""
        generation = self.store.current()
        manifest = self.store.manifest(generation)
        where = corpus_dir or manifest["corpus"]["source"]
        stale = self.fingerprint(where) != manifest["corpus"]["sha256"] if Path(where).is_dir() else None
        own = manifest["embedding"]
        matches = (own["model"], own["dimension"]) == (self.embedder.name, self.embedder.dimension)
        return {"generation": generation.name, "manifest": manifest, "stale": stale, "model_matches": matches, **self.package()}

    def doctor(self, corpus_dir: str | None = None) -> dict:
        try:
            found = self.info(corpus_dir)
        except IndexProblem as e:
            return {"ok": False, "ready": False, "error": e.as_dict(), **self.package()}
        return {"ok": found["model_matches"] and found["stale"] is False, "ready": True, **found}


def format_results(hits: Iterable, query: str = "") -> str:
    """A headline with the query, then hits as numbered text with the first 200 characters."""
    blocks = []
    for number, hit in enumerate(hits, 1):
        start = hit["text"][:200].replace("\n", " ")
        blocks.append(f"[{number}] {hit['source']} › {hit['heading']} (匹配度: {hit['score']:.1%})\n    {start}...\n")
    return "\n".join([f"{HEADLINE}{query}", "", *blocks]) if blocks else NOTHING_FOUND


__all__ = ["BatchEmbedder", "Embedder", "HashingEmbedder", "Index", "format_results"]
