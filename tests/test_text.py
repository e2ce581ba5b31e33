import unicodedata

import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.functions import vectors as V
from spindrift.operators.chunk import regex_spans
from spindrift.operators.expand import normalize_text


def values(spark, texts, column):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", column.alias("x")).orderBy("i").select("x").collect()]


ODD = ["getUWorld::Tick_fast/run", "ﬁne １２ Ａb", "a b c\x1cd\x85e", "", "ıi Café", "行为树abc", "  x  ", None]


def test_normalize_is_the_same_on_driver_and_executors(spark):
    got = values(spark, ODD, T.normalize(F.col("t")))
    assert got == [None if t is None else normalize_text(t) for t in ODD]
    assert got[0] == "get uworld tick fast run" and got[1] == "fine 12 ab"


def test_terms_split_at_accents_and_take_cjk_singly(spark):
    assert values(spark, ["Café 行为 x1", "ı"], T.terms(F.col("t"))) == [["caf", "行", "为", "x1"], ["ı"]]


def test_token_count_matches_the_spans_of_the_chunker(spark):
    texts = ["a_b c-d 行为 ...", "x y\x1cz", "", "fünf"]
    assert values(spark, texts, T.token_count(F.col("t"))) == [len(regex_spans(t)) for t in texts]


def test_sources_ids_and_html(spark):
    assert values(spark, ["a\\b//c/./d.md", "./x/y"], T.normalized_source(F.col("t"))) == ["a/b/c/d.md", "x/y"]
    assert values(spark, ["&amp;lt; a&nbsp; \n b"], T.clean_html(F.col("t"))) == ["< a b"]
    import hashlib

    assert values(spark, ["t"], T.chunk_id(F.lit("s"), F.lit("h"), F.col("t"))) == [hashlib.sha256(b"s\0h\0t").hexdigest()]
    assert unicodedata.normalize("NFKC", "ﬁ") == values(spark, ["ﬁ"], T.nfkc(F.col("t")))[0]


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    got = row.select(V.cosine(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("z")), V.clamp(V.cosine(F.col("a"), F.col("z"))), V.l2_normalize(F.col("z")), V.l2_normalize(F.col("a"))).first()
    assert abs(got[0] - 0.96) < 1e-9 and got[1] is None and got[2] == 0.0 and got[3] == [0.0, 0.0] and abs(got[4][0] - 0.6) < 1e-9


def test_hash_embedding_is_a_unit_vector(spark):
    import hashlib

    v = values(spark, ["b a b"], V.hash_embedding(F.split("t", " ")))[0]
    at = {w: hashlib.md5(w.encode()).digest()[0] % 64 for w in "ab"}
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and abs(v[at["b"]] - 2 * v[at["a"]]) < 1e-9


def test_tables_are_embedded_as_single_texts(spark):
    from spindrift.plans.index import HashingEmbedder

    spaces = "".join(map(chr, (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
    texts = [(i, t) for i, t in enumerate(["Foo foo　BAR", "漢字 and漢more", "x".join(spaces), "​x ᠎y ﻿z", "ÉCOLE ΣΑΣ", "", None])]
    e = HashingEmbedder()
    docs = spark.createDataFrame(texts, "i int, text string")
    for r in docs.select("i", e.embed(F.col("text")).alias("a"), e.embed_table(F.col("text")).alias("b")).collect():
        assert (r.a or [0.0] * 64) == pytest.approx(r.b), texts[r.i]
