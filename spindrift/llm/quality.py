"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, perplexities, quantile thresholds.

The model gives a word's characters by the up to order - 1 characters before them in the word, one model for each language.
Its counts, continuation counts, discounts and probabilities are joins and aggregates over n-gram tables; the result is
cut by hash into shards of sorted arrays. A scoring task joins the n-grams of its new words with the shards and adds up a
document's words. Thresholds are quantiles, by language, of the perplexities of trusted documents that the model has not
seen: text that is less likely than these (symbols, tables, shouting) goes, and so does text that is too likely (the same
common words over and over).
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, by_bytes, map_file, materialize, resident, shared_dir, table, text_of, write_file
from .elias_fano import pack, unpack
from .near_dedup import M1, mix

#: Bytes of text that are scored, or whose words are counted, at once.
SLICE = 1 << 20
#: Probability of a character that the model of a language has never seen.
UNSEEN = 1e-3


def gram_keys(lang: np.ndarray, codes: list[np.ndarray]) -> np.ndarray:
    """64-bit keys of n-grams: codes has an array for each place, lang a hash for each n-gram."""
    with np.errstate(over="ignore"):
        x = lang + np.uint64(len(codes))
        for c in codes:
            x = x * M1 + mix(c.astype(np.uint64) + np.uint64(1))
    return mix(x)


def lang_hash(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


@dataclass(frozen=True)
class Store:
    """Where a model's shards are; key ranges of equal width."""

    root: str
    shards: int
    order: int


class Scorer:
    """Scores words with the shards of a model; what it has scored stays in a bounded table."""

    def __init__(self, store: Store, most: int = 200_000):
        self.store, self.most = store, most
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[tuple[str, str] | str, int] = {}
        self.logs, self.sizes = np.zeros(0), np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability (nan: not in the model) and weight of the lower order (1: no context of the model)."""
        order = np.argsort(keys)
        ordered = keys[order]
        p, w = np.full(len(keys), np.nan), np.ones(len(keys))
        cuts = np.searchsorted(ordered >> np.uint64(32), (np.arange(self.store.shards + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(self.store.shards))
        for s in range(self.store.shards):
            lo, hi = cuts[s], cuts[s + 1]
            a = unpack(map_file(f"{self.store.root}/kn-{s}.bin"))
            if lo == hi or not len(a["key"]):
                continue
            at = np.minimum(np.searchsorted(a["key"], ordered[lo:hi]), len(a["key"]) - 1)
            same = a["key"][at] == ordered[lo:hi]
            p[order[lo:hi]] = np.where(same, a["p"][at], np.nan)
            w[order[lo:hi]] = np.where(same, a["weight"][at], 1.0)
        return p, w

    def words(self, lang: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of every word with its end, and its characters with the end."""
        text = " " + "\n ".join(words) + "\n"
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        first = np.zeros(len(codes), bool)
        sizes = np.array([len(w) + 2 for w in words])
        begin = np.cumsum(sizes) - sizes
        first[begin] = True
        at = np.flatnonzero(~first)
        place = at - np.repeat(begin, sizes)[at]  # characters before it in its word
        own = np.full(len(at), lang_hash(lang), np.uint64)
        p, rest = np.full(len(at), UNSEEN), np.ones(len(at))
        todo = np.arange(len(at))
        for n in range(self.store.order, 0, -1):
            here = todo[place[todo] >= n - 1]
            if not len(here):
                continue
            grams = [codes[at[here] - n + 1 + i] for i in range(n)]
            both = np.concatenate([gram_keys(own[here], grams), gram_keys(own[here], grams[:-1])])
            uniq, back = np.unique(both, return_inverse=True)
            found, weight = self.find(uniq)
            prob, weight = found[back[: len(here)]], weight[back[len(here) :]]
            hit = ~np.isnan(prob)
            p[here[hit]] = prob[hit] * rest[here[hit]]
            rest[here[~hit]] *= weight[~hit]
            todo = np.setdiff1d(todo, here[hit], assume_unique=True)
        p[todo] = UNSEEN * rest[todo]
        starts = np.cumsum(sizes - 1) - (sizes - 1)
        return np.add.reduceat(np.log10(p), starts), sizes - 1

    def texts(self, langs: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability and characters of every text; words are what stands between white space."""
        cut = [t.split() for t in texts]
        by_lang: dict[str, list[int]] = {}
        for i, lang in enumerate(langs):
            by_lang.setdefault(lang, []).append(i)
        logs, sizes = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for lang, own in by_lang.items():
            key = "\n" + lang  # no word holds a line feed
            flat = list(chain.from_iterable(cut[i] for i in own))
            tagged = [w + key for w in flat]
            new = set(tagged).difference(self.slots)
            if len(self.slots) + len(new) > self.most:
                self._clear()
                new = set(tagged)
            if new:
                fresh = sorted(new)
                self.slots.update(zip(fresh, range(len(self.slots), len(self.slots) + len(fresh)), strict=True))
                a, b = self.words(lang, [w[: -len(key)] for w in fresh])
                self.logs, self.sizes = np.concatenate([self.logs, a]), np.concatenate([self.sizes, b])
            at = np.fromiter(map(self.slots.__getitem__, tagged), np.int64, len(tagged))
            n = np.array([len(cut[i]) for i in own])
            ends = np.concatenate([[0], np.cumsum(n)])
            for values, out in ((self.logs, logs), (self.sizes, sizes)):
                total = np.concatenate([[0], np.cumsum(values[at])])
                out[own] = total[ends[1:]] - total[ends[:-1]]
        return logs, sizes


def scorer(store: Store) -> Scorer:
    return resident(("kneser-ney", store.root), lambda: Scorer(store))


def kneser_ney(words: DataFrame, order: int = 4) -> DataFrame:
    """lang, gram, p, weight of all n-grams of words (lang, w, k: how often); weight is that of the lower order after gram.

    Interpolated, with three discounts for each language and order. Below the highest order, n-grams count by how many
    different characters stand before them, but those at a word's start by how often they stand there.
    """
    spelled = words.select("lang", "k", F.concat(F.lit(" "), "w", F.lit("\n")).alias("s"))
    grams = None
    for n in range(1, order + 1):
        ends = F.when(F.length("s") >= max(n, 2), F.sequence(F.lit(max(n, 2)), F.length("s"))).otherwise(F.array().cast("array<int>"))
        own = spelled.select("lang", "k", "s", F.explode(ends).alias("e")).select("lang", "k", F.lit(n).alias("n"), F.expr(f"substring(s, e - {n - 1}, {n})").alias("gram"))
        grams = own if grams is None else grams.unionByName(own)
    raw = materialize(grams.groupBy("lang", "n", "gram").agg(F.sum("k").alias("c")), "grams")
    before = raw.filter("n > 1").groupBy("lang", (F.col("n") - 1).alias("n"), F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("kinds"))
    keeps = (F.col("n") == order) | F.col("gram").startswith(" ")
    counts = raw.join(before, ["lang", "n", "gram"], "left").select("lang", "n", "gram", F.when(keeps, F.col("c")).otherwise(F.coalesce("kinds", "c")).alias("a"))
    counts = materialize(counts, "counts")
    seen = counts.groupBy("lang", "n").agg(*(F.sum((F.col("a") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)))
    y = F.when(F.col("n1") + F.col("n2") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2")))
    ratio = lambda up, low: F.when(F.col(low) > 0, F.col(up) / F.col(low))
    cut = {
        "d1": F.coalesce(1 - 2 * y * ratio("n2", "n1"), F.lit(0.5)),
        "d2": F.coalesce(2 - 3 * y * ratio("n3", "n2"), F.lit(1.0)),
        "d3": F.coalesce(3 - 4 * y * ratio("n4", "n3"), F.lit(1.5)),
    }
    discounts = seen.select("lang", "n", *(F.greatest(F.lit(0.1), F.least(c, F.lit(i - 0.1))).alias(f"d{i}") for i, c in enumerate(cut.values(), 1)))
    cut_of = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
    counts = counts.join(discounts, ["lang", "n"]).withColumns({"cut": cut_of, "h": F.expr("substring(gram, 1, n - 1)")})
    contexts = counts.groupBy("lang", "n", "h").agg(F.sum("a").alias("total"), F.sum("cut").alias("spare"))
    counts = counts.join(contexts, ["lang", "n", "h"]).select("lang", "n", "gram", ((F.col("a") - F.col("cut")) / F.col("total")).alias("own"), (F.col("spare") / F.col("total")).alias("lower"))
    counts = materialize(counts, "shares")
    done = counts.filter("n = 1").select("lang", "gram", (F.col("own") + F.col("lower") * UNSEEN).alias("p"))
    levels = [done]
    for n in range(2, order + 1):
        low = done.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("low"))
        here = counts.filter(F.col("n") == n).withColumn("suffix", F.expr("substring(gram, 2)")).join(low, ["lang", "suffix"], "left")
        # A lower n-gram that is no prediction (a word's first space alone) is missing: it can't follow anything.
        done = here.select("lang", "gram", (F.col("own") + F.col("lower") * F.coalesce("low", F.lit(UNSEEN))).alias("p"))
        levels.append(done)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    weights = contexts.select("lang", F.col("h").alias("gram"), (F.col("spare") / F.col("total")).alias("weight"))
    return every.join(weights, ["lang", "gram"], "full").select("lang", "gram", "p", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def train(trusted: DataFrame, order: int = 4, lang_col: str = "lang", text_col: str = "text", shard_rows: int = 1_000_000) -> Store:
    """A model of all rows of trusted, in shards below the shared folder."""
    spark = trusted.sparkSession

    def count(batches):
        for b in batches:
            for part in by_bytes(b, "text", 4 * SLICE):
                found: dict[tuple[str, str], int] = {}
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    for w in text.split():
                        found[lang, w] = found.get((lang, w), 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "w", "k"])

    rows = trusted.select(_lang(lang_col).alias("lang"), text_of(text_col).alias("text"))
    words = rows.mapInArrow(count, "lang string, w string, k long").groupBy("lang", "w").agg(F.sum("k").alias("k"))
    model = materialize(kneser_ney(words, order), "kneser-ney")
    store = Store(shared_dir(spark), int(model.count() / shard_rows) + 1, order)

    def keyed(batches):
        for b in batches:
            grams, langs = b.column("gram").to_pylist(), b.column("lang").to_pylist()
            hashes = {x: lang_hash(x) for x in set(langs)}
            key = np.zeros(len(grams), np.uint64)
            n = np.array([len(g) for g in grams])
            for size in np.unique(n).tolist():
                own = np.flatnonzero(n == size)
                codes = np.frombuffer("".join(grams[i] for i in own).encode("utf-32-le"), np.uint32).reshape(len(own), size)
                key[own] = gram_keys(np.array([hashes[langs[i]] for i in own], np.uint64), [codes[:, i] for i in range(size)])
            shard = ((key >> np.uint64(32)) * np.uint64(store.shards) >> np.uint64(32)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(key.view(np.int64)), b.column("p"), b.column("weight")], names=["shard", "key", "p", "weight"])

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["key"].to_numpy().view(np.uint64)
        order_ = np.argsort(key)
        s = int(pdf["shard"].iloc[0])
        write_file(f"{store.root}/kn-{s}.bin", pack({"key": key[order_], "p": pdf["p"].to_numpy(np.float64, na_value=np.nan)[order_], "weight": pdf["weight"].to_numpy(np.float64)[order_]}))
        return pdf[["shard"]].head(1)

    model.mapInArrow(keyed, "shard int, key long, p double, weight double").groupBy("shard").applyInPandas(write, "shard int").write.format("noop").mode("overwrite").save()
    empty = pack({"key": np.zeros(0, np.uint64), "p": np.zeros(0), "weight": np.zeros(0)})
    for s in range(store.shards) if model.isEmpty() else ():
        write_file(f"{store.root}/kn-{s}.bin", empty)
    return store


def _lang(lang_col: str):
    return F.coalesce(F.col(lang_col).cast("string"), F.lit(""))


def perplexities(docs: DataFrame, store: Store, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """docs with the columns _chars (characters and ends of words) and _log10 (their log10 probability) added. Map-only."""
    names = [*docs.columns, "_chars", "_log10", "_lang"]
    k = len(docs.columns)

    def run(batches):
        score = scorer(store)
        for b in batches:
            for part in by_bytes(b, text_col, SLICE):
                langs = part.column("_lang").to_pylist()
                logs, sizes = score.texts(langs, [t or "" for t in part.column(text_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(sizes), pa.array(logs), part.column("_lang")], names=names)

    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns), _lang(lang_col).alias("_lang"))
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", _chars bigint, _log10 double, _lang string"
    return rows.mapInArrow(run, typed)


def quantiles(values: DataFrame, shares: dict[str, float]) -> DataFrame:
    """_lang, n and, under their names, exact quantiles of v by linear interpolation, of rows (_lang, v).

    Distinct values are counted and dealt by ranges, and a range starts to count where the ranges before it end, so a language's
    values need not meet in one task.
    """
    counted = values.groupBy("_lang", "v").agg(F.count(F.lit(1)).alias("c"))
    dealt = materialize(counted.repartitionByRange("_lang", "v").withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("_lang").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = dealt.groupBy("_lang", "_range").agg(F.sum("c").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    n = dealt.groupBy("_lang").agg(F.sum("c").alias("n"))
    within = F.sum("c").over(Window.partitionBy("_lang", "_range").orderBy("v"))
    placed = dealt.withColumn("_upto", within).join(starts, ["_lang", "_range"]).withColumn("upto", F.col("_upto") + F.col("_before")).join(n, "_lang")
    holds = lambda at: (F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)
    columns = []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("n") - 1)
        columns += [F.max(F.when(holds(f(place)), F.col("v"))).alias(f"{name}{i}") for i, f in enumerate((F.floor, F.ceil))]
    found = placed.groupBy("_lang", "n").agg(*columns)

    def between(name: str, share: float):
        place = F.lit(share) * (F.col("n") - 1)
        lo, hi = F.col(f"{name}0"), F.col(f"{name}1")
        return F.when(F.floor(place) == F.ceil(place), lo).otherwise((F.ceil(place) - place) * lo + (place - F.floor(place)) * hi).alias(name)

    return found.select("_lang", "n", *(between(name, share) for name, share in shares.items()))


@dataclass(frozen=True)
class Quality:
    """A model and its thresholds: _lang, low, middle, high of -log10 probability for each character."""

    store: Store
    limits: DataFrame
    languages: int


def fit(
    docs: DataFrame,
    labels: DataFrame,
    order: int = 4,
    train_docs: int | None = None,
    threshold_docs: int | None = None,
    tail: float = 0.001,
    widen: float = 4.0,
    id_col: str = "doc_id",
    lang_col: str = "lang",
    text_col: str = "text",
    least_held: int = 10,
) -> Quality:
    """Fits on trusted documents: quality 1 and not toxic.

    By hash of the id, seven tenths of these are for training and the others for thresholds: all of them, unless train_docs or
    threshold_docs says how many of each language, about, are taken by their hashes. A language's limits are the quantiles tail and 1 - tail of its n held-out
    documents, moved away from the median by widen / sqrt(n) of their distance from it: what so many values leave uncertain.

    Quantiles of n < least_held held-out documents tell little: such a language's distances are at least those of all
    languages together, before they are moved. For all together, values count as shares of their language's median, and their
    distance from it times sqrt(n / (n - 1)) because it was taken from them. If these are fewer than least_held too, there
    are no limits.
    """
    trusted = labels.filter("quality = 1 and toxic = 0").select(F.col(id_col).alias("_id")).distinct()
    rows = docs.select(F.col(id_col).alias("_id"), _lang(lang_col).alias("lang"), F.col(text_col).alias("text"))
    found = rows.select("_id", "lang").join(trusted, "_id", "left_semi").distinct().withColumn("_h", F.xxhash64(F.col("_id").cast("string")))
    found = materialize(found.withColumn("_train", F.pmod("_h", F.lit(10)) < 7), "trusted-ids")
    sizes = materialize(found.groupBy("lang", "_train").agg(F.count(F.lit(1)).alias("_n")), "trusted-sizes")
    most = F.when(F.col("_train"), F.lit(train_docs)).otherwise(F.lit(threshold_docs))
    least = F.coalesce(F.shiftrightunsigned("_h", 11) / F.lit(float(1 << 53)) < most / F.col("_n"), F.lit(True))
    picked = materialize(found.join(broadcast_if_small(sizes, sizes.count(), 64), ["lang", "_train"]).filter(least).select("_id", "lang", "_train"), "picked")

    def chosen(part: DataFrame) -> DataFrame:
        return rows.join(broadcast_if_small(part, part.count(), 64), ["_id", "lang"], "left_semi").select("lang", "text")

    store = train(chosen(picked.filter("_train")), order)
    held = perplexities(chosen(picked.filter("not _train")), store).filter("_chars > 0").select("_lang", (-F.col("_log10") / F.col("_chars")).alias("v"))
    held = materialize(held, "held-out")
    q = materialize(quantiles(held, {"least": tail, "middle": 0.5, "most": 1 - tail}), "quantiles")
    languages = q.count()
    off = (F.col("v") / F.col("middle") - 1) * F.sqrt(F.col("n") / (F.col("n") - 1))
    every = held.join(broadcast_if_small(q, languages, 64), "_lang").filter("n > 1").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(off, [tail, 1 - tail], 10_000).alias("q")).first()
    pooled = [abs(x) * (1 + widen / every.n**0.5) for x in every.q] if every.n >= least_held else [None, None]
    own = (F.col("middle") - F.col("least"), F.col("most") - F.col("middle"))
    wide = [F.lit(x).cast("double") * F.col("middle") for x in pooled]
    few = [F.when(w.isNotNull(), F.greatest(o, w)) for o, w in zip(own, wide, strict=True)]
    below, above = (F.when(F.col("n") >= least_held, o).otherwise(f) * (1 + widen / F.sqrt("n")) for o, f in zip(own, few, strict=True))
    limits = q.select("_lang", (F.col("middle") - below).alias("low"), "middle", (F.col("middle") + above).alias("high"))
    return Quality(store, materialize(limits.filter("low is not null"), "limits"), languages)


ADDED = ("_chars", "_log10", "_lang", "low", "middle", "high", "_kept")


def _judged(docs: DataFrame, model: Quality, prior_chars: int, lang_col: str, text_col: str) -> DataFrame:
    """As judged, with the columns of docs renamed by their places: they cannot clash with those that are added."""
    places = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*places.values())
    out = perplexities(rows, model.store, places[lang_col], places[text_col]).join(broadcast_if_small(model.limits, model.languages, 64), "_lang", "left")
    value = (prior_chars * F.col("middle") - F.col("_log10")) / (prior_chars + F.col("_chars"))
    return out.withColumn("_kept", F.coalesce(value.between(F.col("low"), F.col("high")), F.lit(True)) | (F.col("_chars") == 0))


def judged(docs: DataFrame, model: Quality, prior_chars: int = 40, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """docs with _chars, _log10, _lang, low, middle, high and _kept added; one row per input row. Columns of docs that have one
    of these names give way.

    A document's value is -log10 probability for each character, with prior_chars characters of its language's median
    added, so that a short text is not judged by chance. Kept: values within the language's limits. A text without words
    (null, empty) and a language without held-out trusted documents (null is a language of its own), or without limits,
    give no reason to go.
    """
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in ADDED]
    return _judged(docs, model, prior_chars, lang_col, text_col).select(*own, *ADDED)


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that judged() keeps by a model that is fitted on docs and labels; all columns, of any name, as they were."""
    kept = _judged(docs, fit(docs, labels), 40, "lang", "text").filter("_kept")
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = judged(docs.select("doc_id", "lang", "text"), fit(docs, table(spark, sf_dir, "labels")))
    perplexity = F.when(F.col("_chars") > 0, F.pow(F.lit(10.0), -F.col("_log10") / F.col("_chars")))
    return out.select("doc_id", "lang", F.col("_chars").alias("n_chars"), F.col("_log10").alias("log10_prob"), perplexity.alias("perplexity"), F.col("_kept").alias("kept"))
