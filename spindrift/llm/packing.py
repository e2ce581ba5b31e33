"""Lexical retrieval packing: a sharded BM25 inverted index returns unused neighbours for each seed, which fill its window.

Documents become token ids once. They are range-partitioned by the least hash of their words, so documents that share
words tend to meet; a run of them in this order, of bounded size, is a shard with an inverted index of its own, whatever
the size of a group of copies. Document frequencies and the average length are those of all documents. In a shard the
first unused document is the seed; the index scores all others with BM25, and the best unused ones fill its window. The one
that doesn't fit is cut, and what is left of it stays in the index. A window that a shard leaves open is filled by the
next; what a task leaves open at last is cut into sequences whose lengths are powers of two, so nothing is padded.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, map_file, materialize, resident, runs_of, shared_dir, table, text_of, write_file
from .elias_fano import pack, unpack
from .lm_score import Counter, shard_of, summed
from .near_dedup import M1, mix

K1, B = 1.5, 0.75
#: Tokens of a word at most; what follows stands in a script without spaces.
LONG_WORD = 12
#: Words that a task counts before it hands them on: adding them up takes some 60 bytes for each.
COUNTED = 600_000
#: The split pattern of byte-level pre-tokenizers (a fixed value of the format).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokens:
    """Ids of a tokenizers file, and word hashes for the index."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        if size > 1 << 16:
            raise ValueError(f"{path} has {size} ids; packing holds ids in 16 bits")
        strings = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.starts = np.array([s.startswith("Ġ") for s in strings])
        word = np.array([any(c.isalnum() for c in s.replace("Ġ", "").replace("Ċ", "").replace("ĉ", "")) for s in strings])
        #: Behind a token of white space or punctuation alone, and behind a line feed or tab, a new word starts.
        self.parts = np.array([s[-1:] in ("Ċ", "ĉ") for s in strings]) | ~word
        #: A word's hash adds its tokens' hashes by place; punctuation adds nothing.
        plain = np.array([self.tokenizer.token_to_id(s[1:]) if s.startswith("Ġ") and self.tokenizer.token_to_id(s[1:]) is not None else i for i, s in enumerate(strings)], np.uint64)
        self.hash = np.where(word, mix(plain + np.uint64(1)), np.uint64(0))  # with and without a space before it alike
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(64, M1, np.uint64), dtype=np.uint64)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._same_by_ranks(path)

    @staticmethod
    def _same_by_ranks(path: str):
        """For byte-level BPE whose merges are in the order of their ids, the same ids by a faster library; else None."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, vocab = spec.get("pre_tokenizer") or {}, spec["model"].get("vocab") or {}
        merges = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"].get("merges") or []]
        plain = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if spec["model"].get("type") != "BPE" or not plain or merges != sorted(merges):
            return None
        shown = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
        char = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)).difference(shown)))}
        special = {t["content"] for t in spec.get("added_tokens") or []}
        ranks = {bytes(char[c] for c in t): i for t, i in vocab.items() if t not in special}
        return tiktoken.Encoding("same", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def terms(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """Hashes of the words of each document's ids, one after the other; 0 where there is only punctuation."""
        sizes = np.array([len(x) for x in docs], np.int64)
        ids = np.concatenate([np.zeros(0, np.uint16), *docs])
        if not len(ids):
            return [np.zeros(0, np.uint64)] * len(docs)
        begin = self.starts[ids]
        begin[1:] |= self.parts[ids[:-1]]
        begin[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        first = np.flatnonzero(begin)
        place = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
        far = place >= LONG_WORD  # no word of a language with spaces: each further token counts as one
        if far.any():
            first = np.flatnonzero(begin | far)
            place = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
        with np.errstate(over="ignore"):
            words = np.add.reduceat(self.hash[ids] * self.power[place & 63], first)
        return np.split(words, np.searchsorted(first, np.cumsum(sizes))[:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text, without the end. Texts that hold special strings are the tokenizer's own matter."""
        found: list[np.ndarray | None] = [None if self.fast is None or any(s in t for s in self.special) else self._by_ranks(t) for t in texts]
        other = [i for i, x in enumerate(found) if x is None]
        for i, e in zip(other, self.tokenizer.encode_batch([texts[i] for i in other], add_special_tokens=False), strict=True):
            found[i] = np.array(e.ids, np.int64)
        return [x.astype(np.uint16) for x in found]

    def _by_ranks(self, text: str) -> np.ndarray | None:
        """None where the library gives up: it goes back character by character on white space, up to a million of them."""
        try:
            return self.fast(text)
        except ValueError:
            return None


def tokens(path: str) -> Tokens:
    return resident(("tokens", path), lambda: Tokens(path))


def _distinct(words: np.ndarray) -> np.ndarray:
    """Sorted distinct words, without 0."""
    w = np.sort(words)
    return w[np.concatenate([w[:1] != 0, w[1:] != w[:-1]])]


def _tokenised(docs: DataFrame, path: str, end: int, id_col: str, text_col: str) -> DataFrame:
    """kind 0: a document's id, key (least hash of its words), ids as 16-bit integers with the end, and number of words;
    kind 1: words and how many documents of the task hold them."""

    def run(batches):
        coder = tokens(path)
        counter = Counter(COUNTED)
        names = ["kind", "id", "key", "ids", "counts", "words"]

        def counted():
            keys, counts = counter.take()
            return pa.RecordBatch.from_arrays(
                [pa.array([1], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([keys.tobytes()], pa.binary()), pa.array([counts.astype(np.uint32).tobytes()], pa.binary()), pa.array([0], pa.int64())],
                names=names,
            )

        for b in batches:
            for part in by_bytes(b, "text", 2 << 20):
                ids = coder.encode(part.column("text").to_pylist())
                words = coder.terms(ids)
                own = [_distinct(w) for w in words]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.zeros(len(ids), np.int32)),
                        part.column("id"),
                        pa.array([int(mix(w).min() >> np.uint64(1)) if len(w) else 0 for w in own], pa.int64()),
                        pa.array([x.astype("<u2").tobytes() + end.to_bytes(2, "little") for x in ids], pa.binary()),
                        pa.nulls(len(ids), pa.binary()),
                        pa.array([int((w != 0).sum()) for w in words], pa.int64()),
                    ],
                    names=names,
                )
                if counter.add(np.concatenate(own) if own else np.zeros(0, np.uint64)):
                    yield counted()
        yield counted()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "kind int, id long, key long, ids binary, counts binary, words long")


def _document_frequencies(counted: DataFrame, shards: int) -> str:
    """Writes the words' document frequencies in shards, which are ranges of the hash; returns their folder."""
    root = shared_dir(counted.sparkSession)

    def cut(batches):
        for b in batches:
            for keys, counts in zip(b.column("ids").to_pylist(), b.column("counts").to_pylist(), strict=True):
                k, c = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.uint32)
                own = list(runs_of(shard_of(k, shards)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _, _ in own], pa.int32()), *(pa.array([x[lo:hi].tobytes() for _, lo, hi in own], pa.binary()) for x in (k, c))],
                    names=["shard", "keys", "counts"],
                )

    def write(pdf):
        s = int(pdf["shard"].iloc[0])
        keys, counts = summed(np.concatenate([np.frombuffer(k, np.uint64) for k in pdf["keys"]]), np.concatenate([np.frombuffer(c, np.uint32) for c in pdf["counts"]]).astype(np.int64))
        often = counts > 1  # words of one document find no neighbour
        write_file(f"{root}/df-{s}.bin", pack({"keys": keys[often], "counts": counts[often].astype(np.uint32)}))
        return pd.DataFrame({"shard": [s]})

    counted.select("ids", "counts").mapInArrow(cut, "shard int, keys binary, counts binary").groupBy("shard").applyInPandas(write, "shard int").write.format("noop").mode("overwrite").save()
    return root


class Shard:
    """An inverted index of some documents: postings of the words that two of them hold at least, with BM25 weights."""

    def __init__(self, words: list[np.ndarray], df_of, n_docs: int, mean_words: float):
        sizes = np.array([len(w) for w in words])
        self.docs = len(words)
        doc = np.repeat(np.arange(self.docs), sizes)
        flat = np.concatenate(words) if self.docs else np.zeros(0, np.uint64)
        doc, flat = doc[flat != 0], flat[flat != 0]
        found, term = np.unique(flat, return_inverse=True)
        pair, tf = np.unique(term.astype(np.int64) * self.docs + doc, return_counts=True)
        term, doc = pair // max(1, self.docs), pair % max(1, self.docs)
        held = np.bincount(term, minlength=len(found))
        keep = held[term] > 1
        term, doc, tf = term[keep], doc[keep], tf[keep]
        used, term = np.unique(term, return_inverse=True)
        df = df_of(found[used]).astype(np.float64)
        idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
        length = np.bincount(np.repeat(np.arange(self.docs), sizes), minlength=self.docs)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / max(mean_words, 1e-9)))
        # Postings by word, and the words of each document.
        self.post_doc, self.post_weight = doc, weight
        self.post_at = np.searchsorted(term, np.arange(len(used) + 1))
        order = np.argsort(doc, kind="stable")
        self.own_term, self.own_at = term[order], np.searchsorted(doc[order], np.arange(self.docs + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all documents for the words of a seed."""
        terms = self.own_term[self.own_at[seed] : self.own_at[seed + 1]]
        first, n = self.post_at[terms], self.post_at[terms + 1] - self.post_at[terms]
        ends = np.cumsum(n)
        at = np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.post_doc[at], self.post_weight[at], self.docs)


class Windows:
    """Fills windows of `size` ids; gives rows (document, start, ids, sequence, offset) of windows that are full."""

    def __init__(self, size: int, first_sequence: int):
        self.size, self.sequence = size, first_sequence
        self.open: list[tuple] = []
        self.left = size

    def add(self, doc, start: int, ids: np.ndarray) -> list[tuple]:
        self.open.append((doc, start, ids))
        self.left -= len(ids)
        if self.left:
            return []
        done, self.open, self.left = self._rows(self.open), [], self.size
        return done

    def _rows(self, pieces: list[tuple]) -> list[tuple]:
        rows, offset = [], 0
        for doc, start, ids in pieces:
            rows.append((doc, start, ids, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1
        return rows

    def close(self) -> list[tuple]:
        """Cuts the open window into sequences whose lengths are powers of two."""
        rows, total = [], self.size - self.left
        pieces = self.open[::-1]
        while total:
            want = 1 << (total.bit_length() - 1)
            total -= want
            own = []
            while want:
                doc, start, ids = pieces.pop()
                own.append((doc, start, ids[:want]))
                if len(ids) > want:
                    pieces.append((doc, start + want, ids[want:]))
                want -= min(want, len(ids))
            rows += self._rows(own)
        return rows


def fill_shard(names: list, ids: list[np.ndarray], windows: Windows, index: Shard):
    """Rows of a shard's documents as they get into full windows."""
    size = windows.size
    start, unused = [], []
    for d, x in enumerate(ids):
        whole = len(x) - len(x) % size
        if whole:  # full windows of a document alone; an open window stays open meanwhile
            alone = Windows(size, 0)
            for lo in range(0, whole, size):
                alone.sequence = windows.sequence
                windows.sequence += 1
                yield from alone.add(names[d], lo, x[lo : lo + size])
        start.append(whole)
        unused.append(len(x) > whole)
    free = np.array(unused, bool)

    def take(d: int):
        n = min(windows.left, len(ids[d]) - start[d])
        rows = windows.add(names[d], start[d], ids[d][start[d] : start[d] + n])
        start[d] += n
        free[d] = start[d] < len(ids[d])
        return rows

    seed = 0
    while True:
        while seed < len(ids) and not free[seed]:
            seed += 1
        if seed == len(ids):
            return
        fits = len(ids[seed]) - start[seed] < windows.left
        yield from take(seed)
        if not fits or not free.any():
            continue
        score = index.scores(seed)
        near = np.flatnonzero(free & (score > 0))
        for d in near[np.argsort(-score[near], kind="stable")].tolist():
            rows = take(d)
            yield from rows
            if rows:  # the window is full
                break


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    size: int = 2048,
    end: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
    shard_ids: int = 700_000,
    task_bytes: int = 16 << 20,
    df_shard_bytes: int = 16 << 20,
) -> DataFrame:
    """Pieces of all documents in sequences of at most size ids: id_col, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, with_ids, the ids.

    A document is its text's ids and the end; a null or empty text is the end alone. Every id is in one piece. Rows that
    repeat, and null ids, are documents of their own. Sequences are full, but at most log2(size) of each task, whose lengths
    are powers of two. Ties of BM25 go to the document that comes first by (least word hash, id). An empty table gives an
    empty result. Vocabularies of up to 65,536 ids are supported.
    """
    spark = docs.sparkSession
    rows = materialize(_tokenised(docs, tokenizer, end, id_col, text_col), "tokens", "lz4")
    whole = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"), F.sum(F.octet_length("ids")).alias("bytes")).collect()
    stats = {r.kind: r for r in whole}
    n_docs, n_words, n_bytes = (stats[0].n, stats[0].words, stats[0].bytes) if 0 in stats else (0, 0, 0)
    shards = int((stats[1].bytes if 1 in stats else 0) / df_shard_bytes) + 1
    root = _document_frequencies(rows.filter("kind = 1"), shards)
    mean_words = n_words / max(1, n_docs)

    def run(batches):
        coder = tokens(tokenizer)
        windows = Windows(size, TaskContext.get().partitionId() << 40)

        def df_of(words: np.ndarray) -> np.ndarray:
            out = np.ones(len(words), np.int64)
            for s, lo, hi in runs_of(shard_of(words, shards)):
                a = unpack(map_file(f"{root}/df-{s}.bin"))
                if len(a["keys"]):
                    at = np.minimum(np.searchsorted(a["keys"], words[lo:hi]), len(a["keys"]) - 1)
                    out[lo:hi] = np.where(a["keys"][at] == words[lo:hi], a["counts"][at], 1)
            return out

        def batch(found: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, sequence, offset = zip(*found, strict=True)
            wide = [x.astype("<u4") for x in ids]
            cols = [
                pa.array([d[0] for d in doc], pa.int64()),
                pa.array(start, pa.int64()),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([zlib.crc32(x.tobytes()) for x in wide], pa.int64()),
                pa.array([d[1] for d in doc], pa.int64()),
                pa.array(sequence, pa.int64()),
                pa.array(offset, pa.int64()),
                pa.array([x.astype(np.int32) for x in wide] if with_ids else [None] * len(wide), pa.list_(pa.int32())),
            ]
            return pa.RecordBatch.from_arrays(cols, names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        for b in batches:
            for part in by_bytes(b, "ids", 2 * shard_ids):
                ids = [np.frombuffer(x, "<u2") for x in part.column("ids").to_pylist()]
                names = list(zip(part.column("id").to_pylist(), map(len, ids), strict=True))
                index = Shard(coder.terms([x[:-1] for x in ids]), df_of, n_docs, mean_words)
                if found := list(fill_shard(names, ids, windows, index)):
                    yield batch(found)
        if found := windows.close():
            yield batch(found)

    n = max(1, int(n_bytes / task_bytes) + 1)
    dealt = rows.filter("kind = 0").select("key", "id", "ids").repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id")
    out = dealt.select("id", "ids").mapInArrow(run, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>")
    return (out if with_ids else out.drop("ids")).withColumnRenamed("id", id_col)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
