import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import lm_score, quality
from spindrift.llm.elias_fano import EliasFano, pack, unpack

from .helpers import ODD, SMALL, documents, words


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 1 << 40), max_size=400), st.integers(0, 24), st.lists(st.integers(0, 1 << 40), max_size=50))
def test_elias_fano(values, shift, asked):
    v = np.array(sorted({x >> shift for x in values}), np.uint64)
    universe = (1 << 40 >> shift) + 1
    e = EliasFano.of_parts(unpack(np.frombuffer(pack(EliasFano.encode(v, universe).parts()), np.uint8)))
    assert (e.access(np.arange(len(v))) == v).all()
    x = np.array([*(a >> shift for a in asked), *v.tolist()], np.uint64)
    at, same = e.successor(x)
    assert (at == np.searchsorted(v, x)).all() and (same == np.isin(x, v)).all()


@pytest.mark.parametrize("shard_bytes", [40 << 20, 20_000])
def test_scores_are_those_of_the_model(spark, shard_bytes):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(documents(spark, [(i and i + 10**6, t) for i, t in ODD]).select("doc_id", "text"))
    held = lm_score.held_out("doc_id")
    got = lm_score.score_texts(docs, lm_score.train(docs.filter(~held), shard_bytes=shard_bytes), held=held).collect()
    rows = [(r.doc_id, [*words(r.text), "\n"]) for r in docs.collect()]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c, b = Counter(), Counter()
    for i, w in rows:
        if not out(i):
            c.update(w)
            b.update(zip(["\n", *w[:-1]], w))
    n, v = sum(c.values()), len(c)
    often = Counter(min(x, 5) for x in b.values())
    cut = [0, *lm_score.discounts_of(*(often[i] for i in (1, 2, 3, 4)))]
    total, spare = Counter(), defaultdict(float)
    for (x, _), k in b.items():
        total[x] += k
        spare[x] += cut[min(k, 3)]
    by_key = defaultdict(list)
    for i, w in rows:
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for x, y in zip(["\n", *w[:-1]], w):
            p = (c[y] + 1) / (n + v + 1)
            if total[x]:
                k = b.get((x, y), 0)
                p = max(k - cut[min(k, 3)], 0) / total[x] + spare[x] / total[x] * p
            score += math.log10(p)
        by_key[i, len(w)].append((base, score, sum(c[x] > 0 for x in w)))
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == out(r.doc_id) and r.train_tokens == n
        assert any(math.isclose(r.base_score, base, rel_tol=1e-9) and r.n_known == known and abs(r.score - score) <= 0.03 * abs(score) + 0.05 for base, score, known in by_key[r.doc_id, r.n_tokens])


def test_scores_without_training_text(spark):
    rows = documents(spark, [(1, "a b"), (2, None)])
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.score) for r in lm_score.score_texts(rows, lm_score.train(rows.limit(0))).collect()}
    assert got == {1: (3, 0, 0, 0.0), 2: (1, 0, 0, 0.0)}


def plain_kneser_ney(counts, order):
    """p(gram) by the textbook recursion over a word table."""
    raw = Counter()
    for w, k in counts.items():
        s = f" {w}\n"
        for n in range(1, order + 1):
            for e in range(max(n, 2), len(s) + 1):
                raw[s[e - n : e]] += k
    kinds = Counter(g[1:] for g in raw if len(g) > 1)
    a = {g: k if len(g) == order or g[0] == " " else kinds[g] or k for g, k in raw.items()}
    cut = {}
    for n in range(1, order + 1):
        m = Counter(x for g, x in a.items() if len(g) == n)
        y = m[1] / (m[1] + 2 * m[2]) if m[1] + m[2] else None
        d = [1 - 2 * y * m[2] / m[1] if m[1] else 0.5, 2 - 3 * y * m[3] / m[2] if m[2] else 1.0, 3 - 4 * y * m[4] / m[3] if m[3] and y is not None else 1.5]
        cut[n] = [0, *(max(0.1, min(i - 0.1, x)) for i, x in enumerate(d, 1))]
    total, spare = Counter(), defaultdict(float)
    for g, x in a.items():
        total[g[:-1], len(g)] += x
        spare[g[:-1], len(g)] += cut[len(g)][min(3, x)]

    def p(g):
        if not g:
            return quality.UNSEEN
        h = g[:-1], len(g)
        if not total[h]:
            return p(g[1:])
        x = a.get(g, 0)
        return (x - cut[len(g)][min(3, x)]) / total[h] + spare[h] / total[h] * p(g[1:])

    return p


def test_word_scores_are_those_of_kneser_ney(spark):
    text = "the onthe thering of of of the the enon and andthe then one on no the ing ring thing things and"
    rows = spark.createDataFrame([("en", text), ("fr", "la le la les la")], "lang string, text string")
    scorer = quality.Scorer(quality.train(rows, order=3))
    p = plain_kneser_ney(Counter(text.split()), 3)
    asked = ["the", "onthering", "zzz", "o", "é!"]
    got, sizes = scorer.words("en", asked)
    for w, log, n in zip(asked, got, sizes):
        s = f" {w}\n"
        expected = sum(math.log10(p(s[max(0, i - 2) : i + 1])) for i in range(1, len(s)))
        assert n == len(w) + 1 and math.isclose(log, expected, rel_tol=1e-9)
    assert scorer.words("fr", ["la"])[0][0] > scorer.words("en", ["la"])[0][0]


def test_quality_tells_labelled_documents_apart(spark):
    sf = SMALL.replace("0.001", "0.01")
    rows = quality.op4_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.5


def test_quality_edges(spark):
    rows = documents(spark, ODD)
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.drop_low_quality(rows, labels)
    assert kept.columns == rows.columns and {1, 2, 3} <= {r.doc_id for r in kept.collect()}
    assert quality.drop_low_quality(rows, labels.limit(0)).count() == len(ODD)
    assert quality.drop_low_quality(rows.limit(0), labels).count() == 0
