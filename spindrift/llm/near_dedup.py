"""Near-duplicates by bottom-k sketches: inverted lists of the retained values, union-sketch estimates, exact Jaccard.

A document's set holds the hashes of its distinct word shingles. One hash function orders all sets; the k smallest values
are the sketch. Equal sets become one class before anything else, so a group of copies counts once. An inverted list
names the classes that retain a value. A likely pair shares many values, so classes with few values in lists of two or more
drop out. Each list has a hub, the member whose lists are the longest; every class is checked against the hub that it
shares most lists with, which joins most of a group of near copies at the cost of one pair for each. What is left are pairs
in different components: short lists give theirs by a join, long ones count overlaps of their members' sketches, block
against block, in tasks of bounded size, and give only pairs that share enough. No pair is capped away.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, broadcast_if_small, materialize, resident, row_keyed, table, text_of, without

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Flipping this bit of unsigned values gives signed ones of the same order.
TOP = np.uint64(1 << 63)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M2
        x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class Words:
    """64-bit hashes of words, remembered in a bounded table."""

    def __init__(self, entries: int = 500_000):
        self.seen: dict[bytes, int] = {}
        self.entries = entries

    def hashes(self, words: list[bytes]) -> np.ndarray:
        seen = self.seen
        if new := set(words).difference(seen):
            if len(seen) + len(new) > self.entries:
                seen.clear()
                new = set(words)
            seen.update((w, xxhash.xxh64_intdigest(w)) for w in new)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def shingle_set(h: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct hashes of a word sequence's shingles; fewer words than width make one shingle, none an empty set."""
    n = len(h)
    if not n:
        return h
    take = min(width, n)
    with np.errstate(over="ignore"):
        x = np.full(n - take + 1, np.uint64(take), np.uint64)
        for i in range(take):
            x = x * M1 + mix(h[i : n - take + 1 + i] + np.uint64(1))
    return np.unique(mix(x))


def sets_of(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Shingle sets of whole texts: A-Z lower-cased, words between ASCII white space."""
    table_ = resident(("words",), Words)
    return [shingle_set(table_.hashes(t.translate(ASCII_LOWER).split()), width) for t in texts]


def _sketches(docs: DataFrame, id_col: str, text_col: str, width: int, k: int, wide: int) -> DataFrame:
    """id, n (set size), digest of the set (null if empty), sketch of k values, and the high halves of `wide` values."""

    def run(batches):
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            for lo in range(0, b.num_rows, 500):
                sets = sets_of(texts.slice(lo, 500).to_pylist(), width)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("id").slice(lo, 500),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([(s[:k] ^ TOP).view(np.int64) for s in sets], pa.list_(pa.int64())),
                        pa.array([(s[:wide] >> np.uint64(32)).astype(np.uint32).tobytes() for s in sets], pa.binary()),
                    ],
                    names=["id", "n", "digest", "sketch", "wide"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n long, digest binary, sketch array<long>, wide binary")


def _full_sets(texts: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for b in batches:
            raw = b.column("text").cast(pa.binary())
            for lo in range(0, b.num_rows, 500):
                sets = sets_of(raw.slice(lo, 500).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([b.column("c").slice(lo, 500), pa.array([s.tobytes() for s in sets], pa.binary())], names=["c", "members"])

    return texts.mapInArrow(run, "c long, members binary")


def components(links: DataFrame) -> DataFrame:
    """c, comp (the smallest id reachable) for all ends of links (a, b), a <> b; a link may occur more than once.

    Alternates large-star and small-star steps; each writes its links to the shared folder, until nothing changes.
    """
    spark = links.sparkSession
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hop = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = materialize(hop.filter("u <> v").distinct(), "small")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
    ends = edges.select(F.col("u").alias("c"), F.col("v").alias("comp"))
    return ends.unionByName(edges.select(F.col("v").alias("c"), F.col("v").alias("comp"))).groupBy("c").agg(F.min("comp").alias("comp"))


def likely(shared, sample, both, percent: int, deviations: float):
    """Whether a sample of a union, both being the sizes' sum, shares enough: at most so many standard deviations (of a
    sample without replacement) less than what links."""
    least = percent / 100
    spread = np.sqrt(least * (1 - least) / np.maximum(sample, 1) * np.clip(1 - sample * (1 + least) / both, 0, 1))
    return shared >= (least - deviations * spread - 1e-6) * sample


def overlaps(members: list[np.ndarray], few: int = 64, columns: int = 2048) -> np.ndarray:
    """For every two members the number of values that both hold; memory grows with the square of the members alone.

    A value that few members hold adds to each of their pairs; the others are multiplied as columns, some at a time.
    """
    n = len(members)
    own = np.repeat(np.arange(n), [len(m) for m in members])
    flat = np.concatenate(members)
    order = np.argsort(flat, kind="stable")
    own, flat = own[order], flat[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    often = np.diff(np.append(first, len(flat)))
    out = np.zeros((n, n), np.float32)
    for m in np.unique(often[(often > 1) & (often <= few)]).tolist():
        x, y = np.triu_indices(m, 1)
        starts = first[often == m]
        step = max(1, (1 << 22) // len(x))
        for lo in range(0, len(starts), step):
            rows = own[starts[lo : lo + step, None] + np.arange(m)]
            np.add.at(out.reshape(-1), (rows[:, x].astype(np.int64) * n + rows[:, y]).ravel(), np.float32(1))
    out += out.T
    np.fill_diagonal(out, 0)
    wide = np.flatnonzero(often > few)
    for lo in range(0, len(wide), columns):
        part = wide[lo : lo + columns]
        grid = np.zeros((n, len(part)), np.float32)
        for column, (at, m) in enumerate(zip(first[part].tolist(), often[part].tolist(), strict=True)):
            grid[own[at : at + m], column] = 1
        out += grid @ grid.T
    return out


def likely_pairs(
    members: list[np.ndarray], sizes: np.ndarray, comps: np.ndarray, ids: np.ndarray, key: int, first: int, k: int, percent: int, deviations: float
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) of different components that may be linked by the estimate of their sketches of k values, of the list
    of `key`: only those that have no smaller value in common among their first ones, so each pair comes from one list.

    The values up to the smaller of two sketches' last values are a sample of the union.
    """
    every = overlaps(members)
    last = np.array([m[-1] if n > k else 0xFFFFFFFF for m, n in zip(members, sizes, strict=True)], np.uint32)
    upto = np.array([np.searchsorted(m, last, "right") for m in members], np.float32)  # of a row's values, those up to a column's last
    head = np.stack([np.pad(m[:first], (0, max(0, first - len(m))), constant_values=0) for m in members])
    head = np.where(np.arange(first) < np.minimum(sizes, first)[:, None], head.astype(np.int64), -1 - np.arange(len(members))[:, None])
    out_a, out_b = [], []
    for lo in range(0, len(members), 512):
        rows = slice(lo, lo + 512)
        shared = every[rows]
        sample = upto[rows] + upto[:, rows].T - shared
        both = (sizes[rows, None] + sizes[None, :]).astype(np.float32)
        less = np.minimum(sizes[rows, None], sizes[None, :])
        good = likely(shared, sample, both, percent, deviations) & (100 * less >= percent * (both - less))
        good &= (comps[rows, None] != comps[None, :]) & (ids[rows, None] < ids[None, :])
        x, y = np.nonzero(good)
        for at in range(0, len(x), 1 << 14):
            i, j = lo + x[at : at + (1 << 14)], y[at : at + (1 << 14)]
            common = head[i][:, :, None] == head[j][:, None, :]
            mine = np.where(common.any(axis=2), head[i], 1 << 40).min(axis=1) == key
            out_a.append(ids[i[mine]])
            out_b.append(ids[j[mine]])
    if not out_a:
        return ids[:0], ids[:0]
    return np.concatenate(out_a), np.concatenate(out_b)


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    k: int = 32,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_estimate: float = 0.4,
    list_values: int = 12,
    short_list: int = 48,
    wide: int = 256,
    deviations: float = 4.5,
    block: int = 2500,
) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id, kept.

    Sets are linked if 100 * intersection >= percent * union. component_id is the smallest id reachable by links, kept
    tells whether it is the row's own id. Null and empty texts have an empty set and are linked with nothing. Rows that
    share an id are one node. A null id never stands for others: such a row gets the component of an equal set that has an
    id, else null, and then is kept. An empty table gives an empty result.

    least_estimate: pairs whose union sketch of k values estimates less are no candidates; list_values: so many of the
    smallest values make the lists that give pairs of components; deviations: how far below the bound an estimate from
    `wide` values may lie where lists of more than short_list members are compared. At a Jaccard of exactly 0.8 each of
    these passes over about one pair in a hundred thousand or fewer, at higher ones far less. Lists of more than `block`
    members are compared block by block.
    """
    spark = docs.sparkSession
    rows = materialize(_sketches(docs, id_col, text_col, width, k, wide), "sketches")
    # Classes of equal sets; c, the smallest id, names the class.
    first = (F.min("id").alias("c"), *(F.first(x).alias(x) for x in ("n", "sketch")))
    classes = materialize(rows.filter("digest is not null and id is not null").groupBy("digest").agg(*first), "classes")

    def of_wanted(table_: DataFrame, key: str, wanted: DataFrame, label: str) -> DataFrame:
        """Rows of table_ whose key is in wanted (c): the ids travel to the rows as long as they are few."""
        ids = materialize(wanted.distinct(), f"{label}-wanted")
        return table_.join(broadcast_if_small(ids, ids.count(), 16), table_[key] == ids["c"], "left_semi")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("c")).distinct().unionByName(pairs.select(F.col("b").alias("c")).distinct())

    def checked(pairs: DataFrame, label: str) -> DataFrame:
        """The linked ones of candidate pairs (a, b)."""
        pairs = pairs.select("a", "b")
        own = of_wanted(rows, "id", ends(pairs), f"{label}-sketches").select("id", "n", "wide")
        one = pairs.join(own.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("wide").alias("wa")), "a")
        two = one.join(own.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("wb")), "b")
        two = two.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

        def estimate(batches):
            for b in batches:
                keep = []
                sizes = zip(b.column("na").to_pylist(), b.column("nb").to_pylist(), strict=True)
                for x, y, (na, nb) in zip(b.column("wa"), b.column("wb"), sizes, strict=True):
                    p, q = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                    upto = min(p[-1] if na > wide else 0xFFFFFFFF, q[-1] if nb > wide else 0xFFFFFFFF)
                    p, q = p[: np.searchsorted(p, upto, "right")], q[: np.searchsorted(q, upto, "right")]
                    shared = int((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).sum()) if len(p) else 0
                    keep.append(bool(likely(shared, len(p) + len(q) - shared, na + nb, percent, deviations)))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        good = materialize(two.select("a", "b", "na", "nb", "wa", "wb").mapInArrow(estimate, "a long, b long"), f"{label}-likely")
        # Texts of the classes that take part: the rows that name the classes.
        texts = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("text"))
        texts = of_wanted(texts, "_id", ends(good), label).select(F.col("_id").alias("c"), "text")
        sets = materialize(_full_sets(texts, width), f"{label}-sets")
        both = good.join(sets.select(F.col("c").alias("a"), F.col("members").alias("ma")), "a").join(sets.select(F.col("c").alias("b"), F.col("members").alias("mb")), "b")

        def exact(batches):
            for b in batches:
                keep = []
                for x, y in zip(b.column("ma"), b.column("mb"), strict=True):
                    p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    at = np.minimum(np.searchsorted(p, q), len(p) - 1)
                    both = int((p[at] == q).sum())
                    keep.append(100 * both >= percent * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return materialize(both.select("a", "b", "ma", "mb").mapInArrow(exact, "a long, b long"), f"{label}-links")

    def alive(lists: DataFrame, comp: Column, label: str) -> DataFrame:
        """Entries of lists that hold two components, of classes that have enough of these to be in a likely pair."""
        for turn in range(2):
            mixed = lists.groupBy("key").agg(F.min(comp).alias("lo"), F.max(comp).alias("hi")).filter("lo < hi").select("key")
            lists = lists.join(mixed, "key", "left_semi")
            enough = lists.groupBy("c").agg(F.count(F.lit(1)).alias("m"), F.first("need").alias("least")).filter("m >= least").select("c")
            lists = materialize(lists.join(enough, "c", "left_semi"), f"{label}-{turn}")
        return lists

    # First round: a likely pair shares so many values that classes with fewer values in lists of two are out of the question.
    entries = classes.select("c", F.ceil(least_estimate * F.size("sketch")).cast("int").alias("need"), F.posexplode("sketch").alias("at", "key"))
    entries = alive(entries, F.col("c"), "entries")
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    weight = entries.join(sizes, "key").groupBy("c").agg(F.sum("size").alias("weight"))
    hubs = entries.join(weight, "c").groupBy("key").agg(F.max(F.struct("weight", -F.col("c"))).alias("m")).select("key", (-F.col("m.col2")).alias("hub"))
    star = entries.join(hubs, "key").filter("hub <> c").groupBy("c", "hub").agg(F.count(F.lit(1)).alias("shared"))
    best = star.groupBy("c").agg(F.max(F.struct("shared", -F.col("hub"))).alias("m")).select(F.col("c").alias("a"), (-F.col("m.col2")).alias("b"))
    links = checked(best, "first")
    known = materialize(components(links), "first-components")

    # Second round: pairs of one list that are in two components.
    lists = entries.join(known, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    lists = alive(lists, F.col("comp"), "mixed").filter(F.col("at") < list_values).select("key", "c", "comp").join(classes.select("c", "n"), "c")
    sizes = lists.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key", "size")
    lists = materialize(lists.join(sizes, "key"), "lists")
    short = lists.filter(F.col("size") <= short_list)
    x, y = (short.select("key", *(F.col(c).alias(c + s) for c in ("c", "n", "comp"))) for s in "xy")
    pairs = x.join(y, "key").filter("cx < cy and compx <> compy").filter(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
    pairs = pairs.select(F.col("cx").alias("a"), F.col("cy").alias("b"))

    # Long lists: a task for each pair of blocks.
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("c"), blocks).cast("int")
    long = lists.filter(F.col("size") > short_list)
    long = long.join(of_wanted(rows, "id", long.select("c"), "long").select(F.col("id").alias("c"), "wide"), "c").withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    long = long.withColumn("other", other).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "c", "n", "comp", "wide")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        members = [np.frombuffer(w, np.uint32) for w in pdf["wide"]]
        key = (int(pdf["key"].iloc[0]) ^ -(1 << 63)) % (1 << 64) >> 32
        a, b = likely_pairs(members, pdf["n"].to_numpy(), pdf["comp"].to_numpy(), pdf["c"].to_numpy(), key, list_values, wide, percent, deviations)
        return pd.DataFrame({"a": a, "b": b})

    pairs = pairs.unionByName(long.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long"))
    more_links = checked(materialize(pairs.distinct(), "pairs"), "second")
    joined = links.select("a", "b").unionByName(more_links)
    comp = components(joined)
    named = classes.select("digest", "c").join(comp, "c", "left").select("digest", F.coalesce("comp", "c").alias("comp"))
    # Rows that share an id but differ in their set are one node: the smallest component of its sets.
    out = rows.select("id", "n", "digest").join(named, "digest", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("comp", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("comp", "id"), F.col("comp").isNull()).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group that near_duplicates links, the one with the smallest id; all columns as they were.

    Every row is a node of its own: rows that share an id, or have none, are told apart by numbers above all ids, so that none
    goes for what another one holds. Columns of any name are allowed.
    """
    keyed, key = row_keyed(docs, id_col)
    lost = near_duplicates(keyed, width, percent, id_col=key, text_col=text_col).filter(~F.col("kept")).select(key)
    return without(keyed, lost, key).drop(key)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


#: Brute force: all pairs of different sets by their shingles, then everything reachable by links.
OP8_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
e as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0)),
sets as (select doc_id, list(hash(s) order by hash(s)) as s, count(*) as n from e group by doc_id),
classes as (select s, min(doc_id) as c, any_value(n) as n from sets group by s),
x as (select c, n, unnest(s) as h from classes),
links as (
  select a, b from (select x.c as a, y.c as b, x.n as na, y.n as nb, count(*) as m from x join x y on x.h = y.h and x.c < y.c and 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) group by all)
  where 100 * m >= 80 * (na + nb - m)),
ends as (select a, b from links union all select b, a from links),
reach(c, r) as (select c, c from classes union select ends.b, reach.r from reach join ends on ends.a = reach.c where reach.r < ends.b),
comp as (select c, min(r) as component_id from reach group by c)
select d.doc_id, coalesce(sets.n, 0)::bigint as n_shingles, coalesce(component_id, d.doc_id) as component_id, d.doc_id = coalesce(component_id, d.doc_id) as kept
from d left join sets using (doc_id) left join classes using (s) left join comp using (c)
"""
