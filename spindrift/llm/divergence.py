"""Source divergence audit: how far the sources of a language stand from each other and from the language, term by term.

A byte-level tokenizer looks every byte of a batch's concatenated UTF-8 buffer up in a numpy table, and the boundaries of
terms are where membership changes. xxhash groups the slices, and each slice is compared with its group's first, byte for
byte. Counts are summed by Spark, kept terms are dealt into shards, and a shard is a sparse matrix of terms and sources in
rows (CSR), whose divergences are added up with reduceat. All arithmetic is in integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, by_bytes, materialize, table

#: A byte is part of a term: letters, and all bytes of characters beyond ASCII.
IN_TERM = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
LOWER = np.frombuffer(ASCII_LOWER, np.uint8)
#: Bytes of text that are tokenized at once; a longer text is a slice of its own.
SLICE = 2 << 20
SCALE = 1_000_000_000
#: Numbers up to which SCALE times the number fits into 64 bits.
WIDE = (1 << 63) // SCALE - 1
#: Terms of a (language, source) that are listed, and kept terms of a shard.
LISTED, SHARD_ROWS = 200, 200_000
#: Pairs of entries that are expanded at once, slices whose digests are computed at once.
PAIRS, HASHED = 1 << 20, 1 << 16


def boundaries(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of the terms in a buffer; none reaches over a text's start."""
    member = IN_TERM[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[starts], cut[-1] = True, True
    opens, closes = member.copy(), member.copy()
    opens[1:] &= ~member[:-1] | cut[1:-1]
    closes[:-1] &= ~member[1:] | cut[1:-1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def _flat(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all slices, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def group_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """For each slice the number of its group of equal slices, and for each group the place of a member.

    Slices of one digest are compared with the first of them byte for byte; where any differs, the group is divided by bytes.
    """
    raw = data.tobytes()
    hashes = np.empty(len(starts), np.uint64)
    for lo in range(0, len(starts), HASHED):
        a, b = starts[lo : lo + HASHED].tolist(), ends[lo : lo + HASHED].tolist()
        hashes[lo : lo + HASHED] = [digest(raw[x:y]) for x, y in zip(a, b, strict=True)]
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    lengths, lead = ends - starts, first[group]
    odd = lengths != lengths[lead]
    step = max(1, len(starts) * (1 << 20) // max(1, len(data)))  # slices of about 1 MB
    for lo in range(0, len(starts), step):
        part = np.arange(lo, min(lo + step, len(starts)))
        part = part[~odd[part]]
        if len(part):
            same = data[_flat(starts[part], lengths[part])] == data[_flat(starts[lead[part]], lengths[part])]
            odd[part] |= ~np.logical_and.reduceat(same, np.cumsum(lengths[part]) - lengths[part])
    if odd.any():
        mixed = np.flatnonzero(np.isin(group, group[odd]))
        known: dict[bytes, int] = {}
        firsts = first.tolist()
        for i in mixed.tolist():
            word = raw[starts[i] : ends[i]]
            if word not in known:
                known[word] = int(group[i]) if firsts[group[i]] == i else len(firsts)
                if known[word] == len(firsts):
                    firsts.append(i)
            group[i] = known[word]
        first = np.array(firsts)
    return group, first


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n, docs: occurrences of each term in each group, and the rows that hold it."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE):
                texts = part.column("text").cast(pa.binary())
                at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
                data = LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]]
                at -= at[0]
                starts, ends = boundaries(data, at[:-1])
                if not len(starts):
                    continue
                term, first = group_slices(data, starts, ends)
                doc = np.searchsorted(at, starts, "right") - 1
                names: dict[tuple, int] = {}
                group = np.array([names.setdefault(x, len(names)) for x in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)])
                width = len(first)
                cells, n = np.unique(group[doc] * width + term, return_counts=True)
                held, places = np.unique(doc * width + term, return_index=True)
                in_docs = np.unique(group[doc[places]] * width + term[places], return_counts=True)[1]  # the same cells, in the same order
                raw = data.tobytes()
                words = pa.array([raw[starts[i] : ends[i]] for i in first.tolist()], pa.binary()).cast(pa.string())
                of, which = np.divmod(cells, width)
                keys = list(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keys], pa.string()).take(pa.array(of)), pa.array([k[1] for k in keys], pa.string()).take(pa.array(of)), words.take(pa.array(which)), pa.array(n, pa.int64()), pa.array(in_docs, pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )

    rows = docs.select(_empty(lang_col).alias("lang"), _empty(source_col).alias("source"), _empty(text_col).cast("binary").alias("text"))
    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _empty(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / total), exactly, whatever the size of n."""
    if not len(n) or n.max() < WIDE:
        return 1 + SCALE * (n + 1) // total
    return np.array([1 + SCALE * (a + 1) // b for a, b in zip(n.tolist(), np.broadcast_to(total, n.shape).tolist(), strict=True)], np.int64)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def pair_sums(term: np.ndarray, source: np.ndarray, p: np.ndarray, base: np.ndarray, terms: int) -> np.ndarray:
    """sums[g, h]: the divergence of source g's shares from h's, over `terms` terms, most of them absent from most sources.

    term, source, p: the entries of the sparse matrix, sorted by term; base: a source's share of a term that it lacks. A sum
    over all terms is terms times that of the two bases; each entry changes it against the other side's base, and each pair of
    entries of one term changes it once more. So only pairs of sources that share a term are expanded.
    """
    n = len(base)
    g, h = base[:, None], base[None, :]
    sums = terms * divergence(g, h)
    if not len(p):
        return sums
    order = np.lexsort((p, source))
    s, x = source[order], p[order]
    lead = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (x[1:] != x[:-1]))))
    weight = np.diff(np.append(lead, len(s)))
    s, x = s[lead], x[lead]  # the different shares of each source with their frequency
    bounds = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    for lo, hi in zip(bounds.tolist(), np.append(bounds[1:], len(s)).tolist(), strict=True):
        own, times, i = x[lo:hi, None], weight[lo:hi, None], s[lo]
        sums[i, :] += (times * (divergence(own, h) - divergence(base[i], h))).sum(0)
        sums[:, i] += (times * (divergence(h, own) - divergence(h, base[i]))).sum(0)
    row = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
    size = np.diff(np.append(row, len(term)))
    of = np.repeat(np.arange(len(row)), size)
    width = size[of]  # entries that each entry meets
    upto = np.cumsum(width)
    lo = 0
    while lo < len(term):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
        left = np.repeat(np.arange(lo, hi), width[lo:hi])
        right = _flat(row[of[lo:hi]], width[lo:hi])
        a, b, pa_, pb = source[left], source[right], p[left], p[right]
        change = divergence(pa_, pb) - divergence(pa_, base[b]) - divergence(base[a], pb) + divergence(base[a], base[b])
        key = a * n + b
        order = np.argsort(key, kind="stable")
        key = key[order]
        cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sums.reshape(-1)[key[cuts]] += np.add.reduceat(change[order], cuts)
        lo = hi
    return sums


PARTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def shard_parts(entries: pa.Table, groups: pa.Table, listed: int) -> pa.Table:
    """A shard's part of every pair's sum, and its best terms of every source. entries: term, source, n, total; groups: lang,
    source, own_n, lang_n, kept, one for each source of the language."""
    names = groups.column("source").to_pylist()
    sizes, lang_n, kept = (groups.column(c).to_numpy() for c in ("own_n", "lang_n", "kept"))
    lang = groups.column("lang")[0].as_py()
    number = {x: i for i, x in enumerate(names)}
    if kept[0] and entries.num_rows:
        words = entries.column("term").cast(pa.binary()).combine_chunks()
        unique = words.unique()
        unique = unique.take(pc.sort_indices(unique))  # so that numbers of terms are in the order of their bytes
        term = pc.index_in(words, unique).to_numpy(zero_copy_only=False).astype(np.int64)
        source = np.array([number[x] for x in entries.column("source").to_pylist()], np.int64)
        order = np.lexsort((source, term))
        term, source = term[order], source[order]
        n, total = (entries.column(c).to_numpy()[order] for c in ("n", "total"))
        base = 1 + SCALE // (sizes + kept)
        p, q = share(n, (sizes + kept)[source]), share(total, lang_n[0] + kept[0])
        sums = pair_sums(term, source, p, base, len(unique))
        over = np.flatnonzero(p > q)
        value = divergence(p[over], q[over])
        order = np.lexsort((term[over], -value, source[over]))
        own = source[over][order]
        first = np.searchsorted(own, own, "left")
        order = order[np.arange(len(own)) - first < listed]
        best = over[order]
        texts = unique.cast(pa.string())
        top = [source[best], texts.take(pa.array(term[best])), value[order]]
    else:
        sums = np.zeros((len(names), len(names)), np.int64)
        top = [np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64)]
    a, b = np.nonzero(~np.eye(len(names), dtype=bool))
    all_names = pa.array(names, pa.string())
    columns = [
        pa.array([lang] * (len(a) + len(top[0])), pa.string()),
        pa.concat_arrays([all_names.take(pa.array(a)), all_names.take(pa.array(top[0]))]),
        pa.array(["pair"] * len(a) + ["term"] * len(top[0]), pa.string()),
        pa.concat_arrays([all_names.take(pa.array(b)), top[1]]),
        pa.concat_arrays([pa.array(sums[a, b], pa.int64()), pa.array(top[2], pa.int64())]),
    ]
    return pa.Table.from_arrays(columns, schema=PARTS)


def audit(docs: DataFrame, least_docs: int = 3, listed: int = LISTED, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """lang, source, part, item, value, rank: the pairs of sources of each language and the terms that mark each source.

    Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased; a language keeps those in at least least_docs of
    its rows. Null lang, source and text count as empty texts. Repeated rows and ids count each. Languages without kept terms
    give pairs of value 0; a language with one source gives no pairs; an empty table gives no rows. Equal values are ordered by the
    item's bytes. Other columns of any name are not read.

    Counts are summed before every shuffle but that of the texts' own counts. A shard holds about shard_rows entries of a
    language (a term's entries stay together: as many as it has sources), or the square of the number of its sources, as it
    emits that many rows. Sums beyond 64 bits cannot occur below a billion kept terms.
    """
    spark = docs.sparkSession
    counted = term_counts(docs, lang_col, source_col, text_col)
    each = Window.partitionBy("lang", "term")  # as many rows as the language has sources
    kept = counted.withColumn("total", F.sum("n").over(each)).withColumn("held", F.sum("docs").over(each)).filter(F.col("held") >= least_docs)
    entries = materialize(kept.select("lang", "source", "term", "n", "total"), "entries")
    own = entries.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    langs = entries.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = docs.select(_empty(lang_col).alias("lang"), _empty(source_col).alias("source")).distinct()
    groups = materialize(groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("own_n"), zero("lang_n"), zero("kept")), "groups")
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    shards = entries.count() // max(shard_rows, most * most) + 1
    dealt = entries.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)))
    copies = groups.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def parts(left: pa.Table, right: pa.Table) -> pa.Table:
        return shard_parts(left, right, listed) if right.num_rows else PARTS.empty_table()

    found = dealt.groupBy("lang", "shard").cogroup(copies.groupBy("lang", "shard")).applyInArrow(parts, "lang string, source string, part string, item string, value long")
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")  # listed terms of each shard, or the sources
    ranked = summed.withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= listed))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = """
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
w as (select r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
kept as (select lang, term, count(*) as total from w group by all having count(distinct r) >= 3),
langs as (select lang, count(term) as v, coalesce(sum(total), 0)::bigint as n from (select distinct lang from d) left join kept using (lang) group by lang),
c as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by all),
groups as (select lang, source, coalesce(sum(n), 0)::bigint as n from (select distinct lang, source from d) left join c using (lang, source) group by all),
grid as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.n + l.v) as p, 1 + (1000000000 * (k.total + 1)) // (l.n + l.v) as q
  from groups g join langs l using (lang) join kept k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (select a.lang, a.source, b.source as item from groups a join groups b on a.lang = b.lang and a.source <> b.source),
sums as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::bigint as value from grid a join grid b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
parts as (
  select lang, source, 'pair' as part, item, coalesce(value, 0) as value from pairs left join sums using (lang, source, item)
  union all select lang, source, 'term', term, ((p - q) * (p - q)) // q from grid where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from parts)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 200
"""
