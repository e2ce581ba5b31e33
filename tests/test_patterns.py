import random

import numpy as np

from spindrift.operators import ingest, patterns


def brute(texts, words):
    out = {}
    for i, t in texts:
        for w in {w for w in words if w}:
            n = sum((t or "").startswith(w, at) for at in range(len(t or "")))
            if n:
                out[i, w] = n
    return out


def test_occurrences_equal_brute_force(spark, tmp_path):
    r = random.Random(1)
    texts = [(i, "".join(r.choices("ab é漢", k=r.randint(0, 60)))) for i in range(80)] + [(90, None), (91, ""), (92, "\0ab\0")]
    words = ["".join(r.choices("ab é漢", k=r.randint(0, 5))) for _ in range(150)] + [None, "\0", "ab", "ab"]
    docs = spark.createDataFrame(texts, "key long, text string")
    frame = spark.createDataFrame([(w,) for w in words], "pattern string")
    for chars in (1 << 20, 40):  # one automaton, and more than a worker holds
        matcher = patterns.build(frame, f"{tmp_path}/{chars}", block_chars=chars)
        assert (matcher.blocks > patterns.HELD) == (chars == 40)
        found = {(x.key, x.pattern): x.n for x in patterns.occurrences(docs, matcher, "key").collect()}
        assert found == brute(texts, words)
        assert {x.pattern for x in patterns.present(docs, matcher).collect()} == {w for _, w in found}


def test_no_patterns_and_no_texts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x")], "key long, text string")
    none = patterns.build(spark.createDataFrame([("",), (None,)], "pattern string"), f"{tmp_path}/a")
    assert patterns.present(docs, none).count() == 0
    some = patterns.build(spark.createDataFrame([("x",)], "pattern string"), f"{tmp_path}/b")
    assert patterns.occurrences(docs.limit(0), some, "key").count() == 0


def test_grounded_is_dictionary_grounding(spark, tmp_path):
    docs = spark.createDataFrame([("FooBar baz_qux",), ("The ｆｕｌｌ width",), (None,)], "text string")
    concepts = spark.createDataFrame([("foo bar",), ("BazQux",), ("full",), ("absent",), ("  ",), ("foo bar",)], "concept string")
    got = {r.concept: r.grounded for r in ingest.grounded(docs, concepts, str(tmp_path / "g")).collect()}
    assert got == {"foo bar": True, "BazQux": True, "full": True, "absent": False, "  ": True}
    assert got == {r.concept: r.grounded for r in ingest.dictionary_grounding(docs, concepts).collect()}


def test_windows_find_what_automata_find(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(patterns, "PLACES", 64)  # texts reach over several rounds of hashing
    r = random.Random(2)
    texts = [(i, "".join(r.choices("ab é漢\U0001f600", k=r.randint(0, 90)))) for i in range(60)] + [(90, None), (91, ""), (92, "\0ab\0"), (93, "a" * 300)]
    words = ["".join(r.choices("ab é漢\U0001f600", k=r.randint(0, 7))) for _ in range(200)] + [None, "\0", "ab", "a" * 40]
    docs = spark.createDataFrame(texts, "key long, text string")
    frame = spark.createDataFrame([(w,) for w in words], "pattern string")
    want = {w for _, w in brute(texts, words)}
    for chars, shard in ((0, 1 << 21), (0, 4), (60, 1 << 21)):  # all lengths by tables, in several files, some by automata
        monkeypatch.setattr(patterns, "SHARD", shard)
        matcher = patterns.build(frame, f"{tmp_path}/{chars}-{shard}", block_chars=max(1, chars), windows=True)
        assert len(matcher.lengths) > 2 and any(power for _, power in matcher.lengths) == (shard == 4)
        assert {x.pattern for x in patterns.present(docs, matcher).collect()} & set(words) == want
        here = {w.decode("utf-32-le") for w in patterns.windows_held(matcher, [t for _, t in texts if t])}
        assert here & set(words) == {w for w in want if len(w) in dict(matcher.lengths)}


def test_a_text_is_passed_once_for_each_length(spark, tmp_path):
    """Four times as many patterns of a length take no more passes: the work is not texts times patterns."""
    passes = []
    for n in (400, 1600):
        frame = spark.createDataFrame([(f"word{i:06d}",) for i in range(n)], "pattern string")
        matcher = patterns.build(frame, f"{tmp_path}/{n}", block_chars=1000, windows=True)
        passes.append(matcher.blocks + len(matcher.lengths))
    assert passes == [2, 2]


def test_hashes_of_windows():
    found = patterns.Windows(patterns.codes_of(["abcab", "b", "", "ab"]))
    h = found.hashes(2)
    assert h[0] == h[3] == h[9] == patterns.hash_of(["xy", "ab"], 2)[1]
    assert found.inside(np.arange(len(h)), 2).tolist() == [0, 1, 2, 3, 9]
