import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from spindrift.llm import quality


def texts(syllables, n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    return [" ".join(word() for _ in range(r.randint(60, 200))) for _ in range(n)]


def folds(spark, n):
    """Ids below n whose documents train, and those that are held out."""
    rows = spark.range(n).select("id", (F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(10)) < 7).alias("train")).collect()
    return [r.id for r in rows if r.train], [r.id for r in rows if not r.train]


EN, ES = ["the", "ing", "on", "er", "st", "and", "wa", "ou"], ["la", "os", "que", "ción", "ar", "do", "mi", "ez"]


def test_a_language_with_one_held_out_document_keeps_clean_ones(spark):
    train, held = folds(spark, 400)
    en = list(zip(train[:100] + held[:60], texts(EN, 160, 1)))
    clean = list(zip(range(1000, 1040), texts(ES, 40, 3)))
    junk = [(2000 + i, " ".join(["#%&/$" * 3, "0x9@@!"] * 60)) for i in range(5)]
    for n in (1, 2, 3):
        es = list(zip(train[100:104] + held[60 : 60 + n], texts(ES, 4 + n, 2)))
        rows = [(i, t, "en") for i, t in en] + [(i, t, "es") for i, t in es + clean + junk]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        labels = spark.createDataFrame([(i, 1, 0) for i, _ in en + es], "doc_id long, quality int, toxic int")
        kept = {r.doc_id for r in quality.drop_low_quality(docs, labels).collect()}
        assert np.mean([i in kept for i, _ in clean]) >= 0.9 and not kept & {i for i, _ in junk}


def test_samples_are_taken_by_language(spark):
    train, held = folds(spark, 1500)
    common, rare = train[:800] + held[:300], train[800:812] + held[300:312]
    rows = [(i, "the thing then", "en") for i in common] + [(i, "la lo las", "es") for i in rare]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = quality.fit(docs, docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")), train_docs=12, threshold_docs=12)
    assert {r._lang for r in model.limits.collect()} == {"en", "es"}


def test_no_limits_from_one_document(spark):
    _, held = folds(spark, 50)
    docs = spark.createDataFrame([(i, t, "en") for i, t in zip([held[0], *range(100, 110)], texts(EN, 11, 4))], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(held[0], 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.drop_low_quality(docs, labels).count() == 11


def test_perplexity_and_verdict_of_documents_by_brute_force(spark):
    """The whole query again in plain Python: folds, model, quantiles, verdicts."""
    from .helpers import SMALL
    from .test_models import plain_kneser_ney

    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    trusted = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if r.quality == 1 and r.toxic == 0 and r.doc_id in docs}
    ids = spark.createDataFrame([(i,) for i in trusted], "id long")
    train = {r.id for r in ids.filter(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(10)) < 7).collect()}
    models = {}
    for lang in {docs[i].lang for i in train}:
        counts = Counter(w for i in train if docs[i].lang == lang for w in (docs[i].text or "").split())
        models[lang] = plain_kneser_ney(counts, 4)
    known = {}

    def word(lang, w):
        if (lang, w) not in known:
            s = f" {w}\n"
            known[lang, w] = sum(math.log10(models[lang](s[max(0, k - 3) : k + 1])) for k in range(1, len(s)))
        return known[lang, w]

    logs = {i: sum(word(r.lang, w) for w in (r.text or "").split()) for i, r in docs.items() if r.lang in models}
    chars = {i: sum(len(w) + 1 for w in (r.text or "").split()) for i, r in docs.items()}
    held = {}
    for i in trusted - train:
        if i in logs and chars[i]:
            held.setdefault(docs[i].lang, []).append(-logs[i] / chars[i])
    assert any(len(v) >= 10 for v in held.values())
    got = {r.doc_id: r for r in quality.op4_quality(spark, SMALL).collect()}
    assert set(got) == set(docs)
    judged = 0
    for i in logs:
        assert got[i].n_chars == chars[i] and math.isclose(got[i].log10_prob, logs[i], rel_tol=1e-9, abs_tol=1e-9)
        v = held.get(docs[i].lang, [])
        if len(v) >= 10 and chars[i]:
            low, middle, high = np.quantile(v, [0.001, 0.5, 0.999])
            far = 1 + 4 / math.sqrt(len(v))
            value = (40 * middle - logs[i]) / (40 + chars[i])
            assert got[i].kept == (middle - (middle - low) * far <= value <= middle + (high - middle) * far)
            judged += 1
    assert judged > 50


def test_quantiles_are_exact(spark):
    r = np.random.default_rng(3)
    values = {"a": r.normal(size=3000).round(2), "b": r.normal(size=11), "c": np.array([2.5])}
    frame = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v], "_lang string, v double").repartition(5)
    for row in quality.quantiles(frame, {"least": 0.001, "middle": 0.5, "most": 0.999}).collect():
        want = np.quantile(values[row._lang], [0.001, 0.5, 0.999])
        assert row.n == len(values[row._lang]) and np.allclose([row.least, row.middle, row.most], want, rtol=1e-12, atol=0)


def test_all_trusted_documents_are_used(spark, monkeypatch):
    """Over ten thousand trusted documents of one language: none is left out of the counts or of the thresholds."""
    train, held = folds(spark, 45_000)
    docs = spark.range(45_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.col("id").cast("string"), F.lit("word")).alias("text"), F.lit("en").alias("lang"))
    seen = {}
    real, quant = quality.train, quality.quantiles
    monkeypatch.setattr(quality, "train", lambda rows, *a: seen.setdefault("train", rows.count()) and real(rows.limit(100), *a))
    monkeypatch.setattr(quality, "quantiles", lambda rows, shares: seen.setdefault("held", rows.count()) and quant(rows, shares))
    quality.fit(docs, docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")))
    assert seen == {"train": len(train), "held": len(held)} and len(held) > 10_000
