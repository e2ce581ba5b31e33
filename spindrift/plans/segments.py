"""A hybrid index that grows: segments, tombstones and merges.

An update compares the corpus with the documents it knows by their hashes, chunks the changed ones alone, and writes the
chunks that are not there yet as a new segment: only these are embedded. Chunks that are gone are marked by tombstones.
Searches take all segments together; counts of documents, lengths and document frequencies are those of the living chunks, so
the hits are those of an index built anew. Segments of one size are merged when there are several, without chunking,
tokenizing or embedding again, and tombstones go with them.

A generation is a JSON file that names segments and tombstones; it is written last, so a failed update changes nothing.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.local import local
from ..functions.text import normalized_source
from ..operators import bm25, chunk, diff, expand, fuse
from ..sources import files
from .index import Embedder, HashingEmbedder, embed_table
from .scratch import filesystem
from .store import IndexNotFound, IndexProblem

#: A chunk's number is that of its segment, shifted, plus its place there.
SHIFT = 50
#: Segments of one size (within a factor of FACTOR) that are merged, and the share of dead chunks from which all are.
TIER, FACTOR, MOST_DEAD = 4, 4, 0.25
#: Tombstones that travel to the tasks; more are joined by a shuffle.
MOST_SENT = 1 << 20
CHUNK = ("pos", "place", "id", "source", "heading", "type", "text", "embedding")


@dataclass
class Segments:
    spark: SparkSession
    root: str
    embedder: Embedder = field(default_factory=HashingEmbedder)
    glossary: Iterable[dict] = ()
    phrases: Iterable[tuple[str, Iterable[str]]] = ()
    topic_prefix: str = ""

    def __post_init__(self):
        self.glossary = list(self.glossary)
        self.expander = expand.Expander(self.glossary, list(self.phrases))

    # Generations
    def _numbers(self) -> list[int]:
        from pyarrow import fs

        store, folder = filesystem(self.root)
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(int(x.base_name[4:-5]) for x in found if x.base_name.startswith("gen-") and x.base_name.endswith(".json"))

    def state(self) -> dict:
        """The newest generation; one without segments, if there is none."""
        numbers = self._numbers()
        if not numbers:
            return {"generation": 0, "segments": [], "documents": [], "dead": None}
        store, folder = filesystem(self.root)
        with store.open_input_stream(posixpath.join(folder, f"gen-{numbers[-1]:08d}.json")) as f:
            return json.loads(f.read())

    def _activate(self, state: dict) -> None:
        store, folder = filesystem(self.root)
        part = posixpath.join(folder, f"{uuid.uuid4().hex}.part")
        with store.open_output_stream(part) as f:
            f.write(json.dumps(state).encode())
        store.move(part, posixpath.join(folder, f"gen-{state['generation']:08d}.json"))

    # Reading
    def _each(self, state: dict, table: str, names: list[str] | None = None) -> DataFrame:
        return reduce(DataFrame.unionByName, (self.spark.read.parquet(f"{self.root}/{s}/{table}") for s in names or [s["name"] for s in state["segments"]]))

    def _living(self, state: dict, rows: DataFrame) -> DataFrame:
        if not state["dead"]:
            return rows
        dead = self.spark.read.parquet(f"{self.root}/{state['dead']}/chunks").select("pos")
        return rows.join(F.broadcast(dead) if state["dead_chunks"] <= MOST_SENT else dead, "pos", "left_anti")

    def chunks(self, state: dict | None = None) -> DataFrame:
        """The living chunks: pos, place (in the document), id, source, heading, type, text, embedding."""
        state = state or self.state()
        if not state["segments"]:
            raise IndexNotFound(f"no index in {self.root}")
        return self._living(state, self._each(state, "chunks"))

    def _known(self, state: dict) -> DataFrame:
        """source, hash of the documents: the last entry of each source, if it is not a removal."""
        if not state["documents"]:
            return self.spark.createDataFrame([], "source string, hash string")
        log = reduce(DataFrame.unionByName, (self.spark.read.parquet(f"{self.root}/{d}") for d in state["documents"]))
        return log.groupBy("source").agg(F.max_by("hash", "seq").alias("hash")).filter("hash is not null")

    def postings(self, state: dict | None = None) -> bm25.Postings:
        """Postings of the living chunks, and counts without the dead."""
        state = state or self.state()
        terms = self._each(state, "terms").select("term", "df")
        n, length = sum(s["chunks"] for s in state["segments"]), sum(s["length"] for s in state["segments"])
        if state["dead"]:
            terms = terms.unionByName(self.spark.read.parquet(f"{self.root}/{state['dead']}/terms").select("term", (-F.col("df")).alias("df")))
            n, length = n - state["dead_chunks"], length - state["dead_length"]
        terms = terms.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        corpus = local(self.spark, [(n, length / n if n else 0.0)], "n_docs long, avg_length double")
        documents = self._living(state, self._each(state, "documents"))
        return bm25.Postings(bm25.exploded(documents), self._living(state, self._each(state, "stats")), corpus, terms, documents)

    # Updating
    def update(self, docs: DataFrame, repeats: str = "first") -> dict:
        """Takes over the corpus (source, text) as it now is. Returns documents and chunks added, removed and embedded. Equal
        chunks of one document count once, or fail the update with repeats="fail"."""
        state = self.state()
        seq = state["generation"] + 1
        here = docs.filter("text is not null and source is not null").select(normalized_source(F.col("source")).alias("source"), "text")
        hashed = here.select("source", F.sha2("text", 256).alias("hash"))
        log, name = f"docs-{seq}-{uuid.uuid4().hex[:8]}", f"seg-{seq}-{uuid.uuid4().hex[:8]}"
        entries = hashed
        if state["documents"]:
            states = diff.manifest_diff(self._known(state), hashed, "source", "hash")
            entries = states.join(hashed, "source", "left").select("source", F.when(F.col("state") != "missing", F.col("hash")).alias("hash"))
        entries.withColumn("seq", F.lit(seq)).write.parquet(f"{self.root}/{log}")
        touched = self.spark.read.parquet(f"{self.root}/{log}")
        if touched.isEmpty():
            return {"generation": state["generation"], "documents": 0, "added": 0, "removed": 0, "embedded": 0}
        if state["documents"]:
            here = here.join(touched.filter("hash is not null").select("source"), "source", "left_semi")
        found = chunk.chunk_documents(here.repartition("source"))  # one file may be one task
        known = self.spark.createDataFrame(self.glossary, files.GLOSSARY) if self.glossary else None
        found = bm25.topic_text(F.col("source"), known, found, self.topic_prefix).withColumnRenamed("pos", "place").drop("section")
        first = Window.partitionBy("id").orderBy("place")
        found.withColumn("_nth", F.row_number().over(first)).write.parquet(f"{self.root}/{name}/found")
        found = self.spark.read.parquet(f"{self.root}/{name}/found")
        if repeats == "fail" and not found.filter("_nth > 1").isEmpty():
            raise IndexProblem("chunk ids occur twice")
        found = found.filter("_nth = 1").drop("_nth")
        gone = None
        if state["segments"]:
            old = self.chunks(state).select("pos", "id", "place", "source").join(touched.select("source"), "source", "left_semi")
            gone = old.join(found.select("id", "place"), ["id", "place"], "left_anti").select("pos")
            found = found.join(old.select("id", "place"), ["id", "place"], "left_anti")
        dead = self._bury(state, gone, seq)
        placed = found.repartitionByRange("source").sortWithinPartitions("source", "place").withColumn("pos", F.lit(seq << SHIFT) + F.monotonically_increasing_id())
        placed.withColumn("embedding", embed_table(self.embedder, F.col("text"))).write.parquet(f"{self.root}/{name}/chunks")
        keyed = self.spark.read.parquet(f"{self.root}/{name}/chunks").withColumn("pos", F.struct("pos", "source", "place"))
        bm25.document_terms(keyed).select("pos.*", "length", "terms", "freqs").write.parquet(f"{self.root}/{name}/documents")
        segment = self._measured(name)
        removed = dead.get("dead_chunks", 0) - state.get("dead_chunks", 0)
        new = {"generation": seq, "segments": [*state["segments"], *([segment] if segment["chunks"] else [])], "documents": [*state["documents"], log], "dead": None, **dead}
        self._activate(self._merged(new, seq))
        return {"generation": seq, "documents": touched.count(), "added": segment["chunks"], "removed": removed, "embedded": segment["chunks"]}

    def _measured(self, name: str) -> dict:
        """A segment whose chunks and documents are written: writes its other tables. Searches take tables of queries to the
        documents' terms, so postings are not written beside these."""
        path = f"{self.root}/{name}"
        chunks, documents = (self.spark.read.parquet(f"{path}/{t}") for t in ("chunks", "documents"))
        bm25.term_counts(documents).write.parquet(f"{path}/terms")
        bm25.stats_of(chunks, documents.select("pos", "length")).write.parquet(f"{path}/stats")
        sizes = self.spark.read.parquet(f"{path}/stats").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("length")).first()
        return {"name": name, "chunks": sizes.n, "length": sizes.length}

    def _bury(self, state: dict, gone: DataFrame | None, seq: int) -> dict:
        """Writes the tombstones: those there are and the new ones, with what they take from the counts."""
        if gone is None:
            return {}
        name = f"dead-{seq}-{uuid.uuid4().hex[:8]}"
        every = gone.unionByName(self.spark.read.parquet(f"{self.root}/{state['dead']}/chunks").select("pos")) if state["dead"] else gone
        return self._tombstones(state, every, name)

    def _tombstones(self, state: dict, every: DataFrame, name: str) -> dict:
        self._each(state, "stats").join(every, "pos", "left_semi").select("pos", "length").write.parquet(f"{self.root}/{name}/chunks")
        written = self.spark.read.parquet(f"{self.root}/{name}/chunks")
        bm25.term_counts(self._each(state, "documents").join(written.select("pos"), "pos", "left_semi")).write.parquet(f"{self.root}/{name}/terms")
        sizes = written.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("length")).first()
        return {"dead": name, "dead_chunks": sizes.n, "dead_length": sizes.length} if sizes.n else {}

    def _merged(self, state: dict, seq: int) -> dict:
        """The state with segments of one size, or, with many dead chunks, all segments, in one."""
        total = sum(s["chunks"] for s in state["segments"])
        chosen = state["segments"]
        if state.get("dead_chunks", 0) <= MOST_DEAD * total:
            tiers: dict[int, list[dict]] = {}
            for s in state["segments"]:
                tiers.setdefault(next(t for t in range(64) if s["chunks"] < FACTOR ** (t + 1)), []).append(s)
            chosen = next((t for _, t in sorted(tiers.items()) if len(t) >= TIER), [])
        if not chosen or (len(chosen) == 1 and not state["dead"]):
            return state
        names, name = [s["name"] for s in chosen], f"seg-{seq}-{uuid.uuid4().hex[:8]}"
        rows = self._living(state, self._each(state, "chunks", names))
        rows.repartitionByRange("pos").sortWithinPartitions("pos").write.parquet(f"{self.root}/{name}/chunks")
        self._living(state, self._each(state, "documents", names)).write.parquet(f"{self.root}/{name}/documents")
        one = self._measured(name)
        rest = [s for s in state["segments"] if s not in chosen]
        new = state | {"segments": [*rest, *([one] if one["chunks"] else [])], "dead": None, "dead_chunks": 0, "dead_length": 0.0}
        if state["dead"] and rest:  # tombstones of the others stay
            every = self.spark.read.parquet(f"{self.root}/{state['dead']}/chunks").select("pos")
            new |= self._tombstones(new, every, f"dead-{seq}-{uuid.uuid4().hex[:8]}")
        return new

    # Searching
    def search_many(self, queries: DataFrame, top_k: int = 5, demote_frontmatter: bool = False, n_queries: int | None = None) -> DataFrame:
        """Hits of queries (query_id, text) as Index.search_many; equal scores of terms stand in the order of source and place."""
        state = self.state()
        chunks = self.chunks(state)
        asked = queries.select("query_id", self.expander.column(F.col("text")).alias("text"))
        vectors = asked.select("query_id", self.embedder.embed(F.col("text")).alias("qvec"))
        near = fuse.cosine_topk(chunks, vectors, bm25.CANDIDATES, n_queries=n_queries)
        lexical = self._lexical(state, chunks, asked, n_queries)
        return fuse.finish(fuse.rrf([near, lexical]), chunks, top_k, demote_frontmatter).select("query_id", "id", "source", "heading", "type", "score", "raw_score", "rank", "text")

    def _lexical(self, state: dict, chunks: DataFrame, asked: DataFrame, n_queries: int | None) -> DataFrame:
        """query_id, id, rank: the best by BM25, equal scores in the order of source and place."""
        index = self.postings(state)
        keyed = replace(index, documents=index.documents.withColumn("pos", F.struct("source", "place", "pos")))
        best = bm25.top(bm25.nearest(keyed, asked, bm25.CANDIDATES, n_queries=n_queries), bm25.CANDIDATES)
        return best.select("query_id", "rank", F.col("pos.pos").alias("pos")).join(chunks.select("pos", "id"), "pos").select("query_id", "id", "rank")
