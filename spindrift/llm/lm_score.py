"""Language-model scoring with an Elias-Fano n-gram trie.

The model is an interpolated bigram model with three discounts over words and document ends, learnt from all training
documents. Its trie has two levels in shards of memory-mapped files. The first holds the sorted word hashes, exact counts,
quantised interpolation weights and monotone pointers to the children; a word's id is its rank in its shard behind the
shard's number, so no list of shards travels to the driver or with the tasks. The second holds each word's successors: an
id is stored relative to its context (context * ids + id, which makes the level one monotone sequence) and found by
successor search within the context's pointers; its discounted probability is quantised to 8 bits.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, by_bytes, delete_file, exists, map_file, resident, runs_of, shared_dir, table, text_bytes, text_of, write_file
from .elias_fano import EliasFano, of_prefix, pack, prefixed, unpack

#: Stands for the end of a document, and for the context of its first word; no word holds a line feed.
END = b"\n"
LEVELS = 256


def held_out(id_col: str, parts: int = 7, part: int = 2) -> Column:
    """Documents that the model doesn't learn from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts == part


def tokens_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All texts' tokens in a row, each text's end as END, and the number of tokens of each text."""
    docs = [t.translate(ASCII_LOWER).split() for t in texts]
    for d in docs:
        d.append(END)
    return list(chain.from_iterable(docs)), np.array([len(d) for d in docs], np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], (np.add.reduceat(counts, at) if len(at) else counts)


class Counter:
    """Counts keys of many batches; add() tells when to take what there is, which stays below about `most` entries."""

    def __init__(self, most: int = 2_500_000):
        self.most, self.parts, self.size = most, [], 0

    def add(self, keys: np.ndarray) -> bool:
        k, c = np.unique(keys, return_counts=True)
        self.parts.append((k, c.astype(np.int64)))
        self.size += len(k)
        if self.size <= self.most:
            return False
        merged = self.take()
        self.parts, self.size = [merged], len(merged[0])
        return self.size > self.most // 2

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        parts, self.parts, self.size = self.parts, [], 0
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))


def coded(values: np.ndarray) -> dict[str, np.ndarray]:
    """Integers as a table of the distinct ones and a code each."""
    found, code = np.unique(values, return_inverse=True)
    kind = np.uint8 if len(found) <= 1 << 8 else np.uint16 if len(found) <= 1 << 16 else np.uint32
    return {"table": found.astype(np.int64), "code": code.astype(kind)}


def quantised(values: np.ndarray) -> dict[str, np.ndarray]:
    """Positive floats as codes of at most LEVELS levels, evenly spaced in the logarithm; each stands for its values' mean."""
    found, code = np.unique(values, return_inverse=True)
    if len(found) <= LEVELS:
        return {"table": found.astype(np.float64), "code": code.astype(np.uint8)}
    logs = np.log(found)
    level = np.minimum(((logs - logs[0]) / (logs[-1] - logs[0]) * LEVELS).astype(np.int64), LEVELS - 1)
    level = np.unique(level, return_inverse=True)[1]
    weight = np.bincount(code)
    mean = np.bincount(level, found * weight) / np.bincount(level, weight)
    return {"table": mean, "code": level[code].astype(np.uint8)}


class Model:
    """Reads the trie below `root`: v words in shards with room for `width` ids each, n training tokens."""

    def __init__(self, root: str, shards: int, width: int, v: int, n: int, cache_words: int = 700_000):
        self.root, self.shards, self.width, self.v, self.n = root, shards, width, v, n
        self.open: dict[str, dict | None] = {}
        self.cache_words = cache_words
        self._clear()

    def _clear(self):
        self.slots: dict[bytes, int] = {}
        self.ids, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def level(self, kind: str, shard: int) -> dict | None:
        """A shard's arrays and sequences; None if no word fell into it."""
        name = f"{kind}-{shard}"
        if name not in self.open:
            uri = f"{self.root}/{name}.bin"
            found = None
            if exists(uri):
                arrays = unpack(map_file(uri))
                found = {"arrays": arrays}
                for sequence in ("key", "ptr", "kid"):
                    if f"{sequence}.head" in arrays:
                        found[sequence] = EliasFano.of_parts(of_prefix(sequence, arrays))
            self.open[name] = found
        return self.open[name]

    def _find_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        order = np.argsort(h)
        for s, lo, hi in runs_of(shard_of(h[order], self.shards)):
            own, level = order[lo:hi], self.level("words", s)
            if level:
                at, same = level["key"].successor(h[own] - np.uint64(first_hash(s, self.shards)))
                hit, at = own[same], at[same]
                ids[hit] = s * self.width + at
                counts[hit] = level["arrays"]["count.table"][level["arrays"]["count.code"][at]]
        return ids, counts

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and training counts of tokens; known tokens come from a bounded table of this process."""
        if new := set(words).difference(self.slots):
            if len(self.slots) + len(new) > self.cache_words:
                self._clear()
                new = set(words)
            fresh = sorted(new)
            self.slots.update(zip(fresh, range(len(self.slots), len(self.slots) + len(fresh)), strict=True))
            ids, counts = self._find_words(fresh)
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        at = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        return self.ids[at], self.counts[at]

    def pairs(self, ctx: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Discounted probability of word after ctx (0: never seen) and the weight of the lower order, for known ids."""
        key, back = np.unique(ctx.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64), return_inverse=True)
        own, wanted = (key >> np.uint64(32)).astype(np.int64), key & np.uint64(0xFFFFFFFF)
        prob, weight = np.zeros(len(key)), np.ones(len(key))
        for s, lo, hi in runs_of(own // max(1, self.width)):
            level = self.level("pairs", s)
            local = own[lo:hi] - s * self.width
            at, same = level["kid"].successor(local.astype(np.uint64) * np.uint64(self.shards * self.width) + wanted[lo:hi])
            there, where = np.unique(local, return_inverse=True)
            begin, end = level["ptr"].access(there)[where], level["ptr"].access(there + 1)[where]
            same &= (at >= begin.astype(np.int64)) & (at < end.astype(np.int64))
            a = level["arrays"]
            got = np.flatnonzero(same)
            prob[lo + got] = a["prob.table"][a["prob.code"][at[got]]]
            weight[lo:hi] = a["weight.table"][a["weight.code"][local]]
        return prob[back], weight[back]

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens, base score and model score of every text."""
        words, sizes = tokens_of(texts)
        ids, counts = self.look_up(words)
        end = self.look_up([END])[0]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        ctx = np.concatenate([end, ids[:-1]])
        ctx[starts] = end[0]
        low = (counts + 1) / (self.n + self.v + 1)
        p = low.copy()
        known = np.flatnonzero(ctx >= 0)  # an unknown context tells nothing
        prob, weight = np.zeros(len(known)), np.ones(len(known))
        both = ids[known] >= 0
        if both.any():
            prob[both], weight[both] = self.pairs(ctx[known][both], ids[known][both])
        if not both.all():
            weight[~both] = self.weights(ctx[known][~both])
        p[known] = prob + weight * low[known]
        return sizes, np.add.reduceat((counts > 0).astype(np.int64), starts), np.add.reduceat(np.log10(low), starts), np.add.reduceat(np.log10(p), starts)

    def weights(self, ctx: np.ndarray) -> np.ndarray:
        """Weights of the lower order behind known words."""
        out = np.ones(len(ctx))
        order = np.argsort(ctx)
        for s, lo, hi in runs_of(ctx[order] // max(1, self.width)):
            a = self.level("pairs", s)["arrays"]
            out[order[lo:hi]] = a["weight.table"][a["weight.code"][ctx[order[lo:hi]] - s * self.width]]
        return out


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash, so shard after shard the words are sorted."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def first_hash(s: int, shards: int) -> int:
    return -(-(s << 32) // shards) << 32


def model(root: str, *args) -> Model:
    return resident(("trie", root), lambda: Model(root, *args))


def _counted(docs: DataFrame, id_col: str, text_col: str, keys_of, cut) -> DataFrame:
    """shard, keys, counts: what each task counts, cut into shards. keys_of: keys of a list of texts; cut: shard bounds of sorted keys."""

    def run(batches):
        counter = Counter()

        def rows():
            keys, counts = counter.take()
            for s, lo, hi in cut(keys):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([keys[lo:hi].tobytes()], pa.binary()), pa.array([counts[lo:hi].astype(np.uint32).tobytes()], pa.binary())], names=["shard", "keys", "counts"])

        for b in batches:
            for part in by_bytes(b, "text", 4 << 20):
                if counter.add(keys_of(part.column("text").cast(pa.binary()).to_pylist())):
                    yield from rows()
        yield from rows()

    return docs.select(text_of(text_col).alias("text")).mapInArrow(run, "shard int, keys binary, counts binary")


def _merged(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.frombuffer(k, np.uint64) for k in pdf["keys"]])
    counts = np.concatenate([np.frombuffer(c, np.uint32) for c in pdf["counts"]]).astype(np.int64)
    return summed(keys, counts)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 40 << 20) -> tuple:
    """Builds the trie of all rows of docs below the shared folder; returns the arguments of model()."""
    spark = docs.sparkSession
    root = shared_dir(spark)
    shards = text_bytes(docs, text_col) // shard_bytes + 1

    def words(texts):
        tokens = tokens_of(texts)[0]
        return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))

    def word_cut(keys):
        return runs_of(shard_of(keys, shards))

    def write_words(pdf):
        s = int(pdf["shard"].iloc[0])
        keys, counts = _merged(pdf)
        base = first_hash(s, shards)
        sequence = EliasFano.encode(keys - np.uint64(base), (1 << 64) // shards + (1 << 33))
        write_file(f"{root}/words-{s}.bin", pack({**prefixed("key", sequence.parts()), **prefixed("count", coded(counts))}))
        return pd.DataFrame({"shard": [s], "v": [len(keys)], "n": [int(counts.sum())]})

    found = _counted(docs, id_col, text_col, words, word_cut).groupBy("shard").applyInPandas(write_words, "shard int, v long, n long")
    v, n, width = (x or 0 for x in found.agg(F.sum("v"), F.sum("n"), F.max("v")).first())
    if shards * width >= 1 << 32:
        raise ValueError("word ids need more than 32 bits")
    args = (root, shards, width, v, n)

    def pairs(texts):
        m = model(*args)
        tokens, lens = tokens_of(texts)
        ids = m.look_up(tokens)[0]
        ctx = np.concatenate([ids[-1:], ids[:-1]])
        return ctx.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)

    def pair_cut(keys):
        return runs_of((keys >> np.uint64(32)).astype(np.int64) // max(1, width))

    def write_pairs(pdf):
        s = int(pdf["shard"].iloc[0])
        keys, counts = _merged(pdf)
        ctx = (keys >> np.uint64(32)).astype(np.int64) - s * width
        ids, own = shards * width, int(ctx[-1]) + 1  # every word is followed by another or the end
        kid = EliasFano.encode(ctx.astype(np.uint64) * np.uint64(ids) + (keys & np.uint64(0xFFFFFFFF)), own * ids)
        ptr = np.searchsorted(ctx, np.arange(own + 1)).astype(np.uint64)
        pointers = EliasFano.encode(ptr, len(keys) + 1)
        write_file(f"{root}/counted-{s}.bin", pack({**prefixed("kid", kid.parts()), **prefixed("ptr", pointers.parts()), **prefixed("count", coded(counts))}))
        seen = np.bincount(np.minimum(counts, 5), minlength=6)
        return pd.DataFrame({"shard": [s], **{f"n{i}": [int(seen[i])] for i in (1, 2, 3, 4)}})

    grouped = _counted(docs, id_col, text_col, pairs, pair_cut).groupBy("shard").applyInPandas(write_pairs, "shard int, n1 long, n2 long, n3 long, n4 long")
    discounts = discounts_of(*(x or 0 for x in grouped.agg(*(F.sum(f"n{i}") for i in (1, 2, 3, 4))).first()))

    def finish(batches):
        for pdf in batches:
            for s in pdf["id"].tolist():
                # Else a former attempt has done it, or the shard has no words.
                if not exists(f"{root}/pairs-{s}.bin") and exists(f"{root}/counted-{s}.bin"):
                    quantise(f"{root}/counted-{s}.bin", f"{root}/pairs-{s}.bin", discounts)
            yield pdf

    spark.range(0, shards, 1, min(shards, 10_000)).mapInPandas(finish, "id long").write.format("noop").mode("overwrite").save()
    return args


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Discounts of counts 1, 2 and from 3 on, by the counts of counts; kept inside (0, count) when those are few."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3), strict=True)]


def quantise(source: str, target: str, discounts: list[float]) -> None:
    """Turns a shard's counts into quantised probabilities and weights."""
    arrays = unpack(map_file(source))
    counts = arrays["count.table"][arrays["count.code"]]
    pointers = EliasFano.of_parts(of_prefix("ptr", arrays))
    ptr = pointers.access(np.arange(pointers.n)).astype(np.int64)
    own = len(ptr) - 1
    cut = np.array([0.0, *discounts])[np.minimum(counts, 3)]
    ctx = np.repeat(np.arange(own), np.diff(ptr))
    total = np.bincount(ctx, counts, own)
    weight = np.where(total > 0, np.bincount(ctx, cut, own) / np.maximum(total, 1), 1.0)
    keep = {k: a for k, a in arrays.items() if not k.startswith("count.")}
    write_file(target, pack({**keep, **prefixed("prob", quantised((counts - cut) / total[ctx])), **prefixed("weight", quantised(weight))}))
    delete_file(source)


def score_texts(docs: DataFrame, args: tuple, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score of every row by a model that train() made.

    Map-only; null counts as the empty text, which is its end alone. Null ids and repeated rows are kept row by row.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    n = args[-1]

    def run(batches):
        m = model(*args)
        for b in batches:
            for part in by_bytes(b, "text", 4 << 20):
                sizes, known, base, score = m.score(part.column("text").cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("held_out"), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), n, np.int64)), pa.array(base), pa.array(score)],
                    names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    rows = docs.select(F.col(id_col).alias("id"), (F.lit(False) if held is None else held).alias("held_out"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out("doc_id")
    return score_texts(docs, train(docs.filter(~held)), held=held)
