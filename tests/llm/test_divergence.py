import random
import re
from collections import Counter, defaultdict

import numpy as np

from spindrift.llm import divergence

from .helpers import LOW, SMALL

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, shard long, value double"


def table(spark, rows):
    """Rows (text, lang, source) with columns whose names clash with the operator's own."""
    return spark.createDataFrame([(1, t, a, s, 1, "x", 2, 3.0) for t, a, s in rows], SCHEMA)


def brute(rows, least=3, listed=200):
    rows = [(t or "", a or "", s or "") for t, a, s in rows]
    held, total, own, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for t, a, s in rows:
        terms = [x.translate(LOW) for x in TERM.findall(t)]
        sources[a].add(s)
        held[a].update(set(terms))
        total[a].update(terms)
        own[a, s].update(terms)
    out = []
    f = lambda p, q: (p - q) ** 2 // q
    for a, names in sources.items():
        kept = [t for t, n in held[a].items() if n >= least]
        v = len(kept)
        p = {}
        for s in names:
            n = sum(own[a, s][t] for t in kept)
            p[s] = {t: 1 + 10**9 * (own[a, s][t] + 1) // (n + v) for t in kept}
        n = sum(total[a][t] for t in kept)
        q = {t: 1 + 10**9 * (total[a][t] + 1) // (n + v) for t in kept}
        for s in names:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in names if o != s))
            marks = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if own[a, s][t] and p[s][t] > q[t])[:listed]
            for part, found in (("pair", pairs), ("term", marks)):
                out += [(a, s, part, item, -value, rank + 1) for rank, (value, _, item) in enumerate(found)]
    return sorted(out)


def found(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


def texts(n, seed):
    r = random.Random(seed)
    words = ["the", "The", "über", "漢字", "x", "don't", "a1b", "É", "é", "zeta", "[y]", "\0q", "𝄞"] + [f"w{chr(97 + i)}" for i in range(20)]
    pick = lambda: " ".join(r.choices(words, weights=[9] * 13 + [1] * 20, k=r.randint(0, 30)))
    return [(pick(), r.choice(["en", "de", None, ""]), r.choice(["s0", "s1", "s1", "s1", "Sé", None, "s9"])) for _ in range(n)]


def test_audit_equals_brute_force(spark):
    rows = texts(300, 1) + [(None, None, None), ("", "fr", "one"), ("alone", "fr", "one"), ("once", "it", "a"), ("twice", "it", "b"), ("x" * 50_000 + " the", "en", "s0")]
    rows += [("the same row", "en", "s0")] * 5
    assert found(divergence.audit(table(spark, rows))) == brute(rows)
    assert found(divergence.audit(table(spark, rows), least_docs=1, listed=3, shard_rows=1)) == brute(rows, 1, 3)


def test_empty_table(spark):
    assert divergence.audit(table(spark, []).limit(0)).count() == 0


def test_colliding_digests_are_told_apart_by_bytes():
    data = np.frombuffer(b"abcabdxabcyzabdabc", np.uint8)
    starts = np.array([0, 3, 6, 7, 10, 12, 15])
    ends = np.array([3, 6, 7, 10, 12, 15, 18])
    for digest in (lambda b: 7, len, lambda b: b[0]):
        group, first = divergence.group_slices(data, starts, ends, digest)
        words = [data[a:b].tobytes() for a, b in zip(starts, ends)]
        assert [words[first[g]] for g in group] == words
        assert len(set(group.tolist())) == len(set(words))


def test_no_term_reaches_over_a_text(spark):
    rows = [("ab", "en", "s"), ("cd", "en", "s"), ("", "en", "s"), ("ef", "en", "t")] * 3
    assert found(divergence.audit(table(spark, rows))) == brute(rows)


def test_counts_beyond_64_bits_of_product():
    n = np.array([5, 30_000_000_000], np.int64)
    total = np.array([9, 40_000_000_000], np.int64)
    assert divergence.share(n, total).tolist() == [1 + 10**9 * (a + 1) // b for a, b in zip(n.tolist(), total.tolist())]


def test_query(spark):
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert found(divergence.op13_source_divergence(spark, SMALL)) == brute(rows)
