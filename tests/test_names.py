import random

from spindrift.catalogue_indexes import many_names
from spindrift.operators import expand, names

WORDS = ["walk", "run", "sound", "floor", "of", "the", "声音", "地面", "a"]


def test_expansion_is_that_of_the_expander(spark, tmp_path):
    r = random.Random(3)
    pick = lambda k: " ".join(r.choices(WORDS, k=k))
    glossary = [{"topic": f"t{i}", "canonical": f"canonical {i}", "aliases": [pick(r.randint(1, 3)) for _ in range(r.randint(0, 3))] + [""], "identifiers": [f"Id{i}", f"id{i % 4}"][: r.randint(0, 2)] or None} for i in range(40)]
    phrases = [(p, [f"concept {p}", "shared"]) for p in ("声音", "地面 声音", "the 声音")]
    queries = [(f"q{i}", pick(r.randint(0, 12))) for i in range(60)] + [("null", None), ("empty", ""), ("none", "nothing known"), ("camel", "getWalk_RunSound")]
    frame = spark.createDataFrame(glossary, "topic string, canonical string, aliases array<string>, identifiers array<string>").coalesce(1)
    own = names.entries(frame, spark.createDataFrame(phrases, "phrase string, concepts array<string>").coalesce(1))
    got = {x.query_id: x.text for x in names.expand(spark.createDataFrame(queries, "query_id string, text string"), own, str(tmp_path / "names")).collect()}
    expander = expand.Expander(glossary, phrases)
    assert got == {q: None if t is None else expander(t) for q, t in queries}


def test_claims():
    found = [((0, 1), "ab", [0, 3]), ((0, 2), "abc", [0]), ((0, 3), "ab", [0, 3]), ((1, 1), "abcab", [0])]
    assert names.claim("abcab", found) == [(0, 2), (0, 1)]


def test_only_names_that_queries_can_hold_are_written(spark, tmp_path):
    asked = spark.createDataFrame([(1, "the walking speed of it"), (2, None), (3, "ab")], "query_id long, text string")
    rows = [(i, 0, f"other name {i:05}", ["x"]) for i in range(2000)] + [(5000, 0, "walking speed", ["w"]), (5001, 0, "ab", ["short"]), (5002, 0, "walking speed at", ["no"])]
    table = spark.createDataFrame(rows, "number long, kind int, name string, gives array<string>")
    got = {r.query_id: r.text for r in names.expand(asked, table, str(tmp_path / "x")).collect()}
    assert got == {1: "the walking speed of it w", 2: None, 3: "ab short"}
    assert spark.read.parquet(str(tmp_path / "x" / "names")).count() == 3


def test_names_wait_for_functions_without_the_texts_they_are_cut_from(spark):
    node = many_names(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "ArrowEvalPython":
        node = node.children().head()
    columns = [node.output().apply(i).name() for i in range(node.output().size())]
    assert "doc_id" in columns and "text" not in columns


def test_a_query_that_holds_a_name_very_often(spark, tmp_path):
    """Every entry of a name claims a place of its own, as long as there are places."""
    table = spark.createDataFrame([(i, 0, "a", ["late" if i == 4199 else "never" if i == 4200 else "x"]) for i in range(4250)], "number long, kind int, name string, gives array<string>")
    asked = spark.createDataFrame([(1, "a " * 4200), (2, "a b a")], "query_id long, text string")
    got = {r.query_id: r.text for r in names.expand(asked, table, str(tmp_path / "x")).collect()}
    assert got == {1: "a " * 4200 + "x late", 2: "a b a x"}
