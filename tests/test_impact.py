import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import bm25, impact


def corpus(spark, n=900):
    r = random.Random(4)
    rare = [f"rare{i}" for i in range(300)]
    rows = []
    for i in range(n):
        words = ["the"] * r.randint(1, 12) + r.choices(["of", "and", "walk", "run"], k=r.randint(0, 9)) + r.choices(rare, k=r.randint(0, 6))
        r.shuffle(words)
        rows.append((i * 3, f"id{i}", "heading the" if i % 5 == 0 else "", "", " ".join(words) if i % 50 else ""))
    return spark.createDataFrame(rows, "pos long, id string, heading string, topic_text string, text string")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("impact"))
    postings = bm25.save_postings(corpus(spark), f"{path}/postings")
    return impact.save_impacts(postings, f"{path}/impacts")


QUERIES = {"one": "rare7", "stop": "the", "both": "the rare7 rare8 rare9", "all": "the of and walk run rare1 rare2", "twice": "walk walk the", "none": "absent words", "empty": ""}


@pytest.mark.parametrize("limit", [1, 5, 30, 2000])
def test_rows_are_those_of_the_full_search(spark, index, limit):
    queries = spark.createDataFrame(list(QUERIES.items()), "query_id string, text string")
    rows = lambda df: sorted((r.query_id, r["rank"], r.pos, r.id, r.score) for r in df.collect())
    want, got = rows(bm25.search(index.postings, queries, limit)), rows(impact.search(index, queries, limit))
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert all(abs(a[4] - b[4]) < 1e-8 for a, b in zip(got, want, strict=True))


def test_many_terms_meet_the_postings_by_joins(spark, index, monkeypatch):
    monkeypatch.setattr(impact, "MOST_TERMS", 3)
    queries = spark.createDataFrame(list(QUERIES.items()), "query_id string, text string")
    ids = lambda df: sorted((r.query_id, r["rank"], r.pos) for r in df.collect())
    assert ids(impact.search(index, queries, 5)) == ids(bm25.search(index.postings, queries, 5))


def test_many_candidates_are_joined(spark, index, monkeypatch):
    monkeypatch.setattr(impact, "MOST_DOCUMENTS", 2)
    queries = spark.createDataFrame(list(QUERIES.items()), "query_id string, text string")
    ids = lambda df: sorted((r.query_id, r["rank"], r.pos) for r in df.collect())
    assert ids(impact.search(index, queries, 7)) == ids(bm25.search(index.postings, queries, 7))


def test_a_stop_word_is_hardly_read(spark, index):
    queries = spark.createDataFrame([("q", "the rare7 rare8")], "query_id string, text string")
    read = impact.postings_read(index, queries, 5)
    assert read["lists"] > 800
    assert read["first"] + read["second"] + read["lookups"] < 0.25 * read["lists"]


def test_filters_reach_the_scan(spark, index):
    plan = index.impacts.filter(impact.any_of([(F.col("term") == t) & (F.col("impact") >= x) for t, x in (("the", 1.0), ("walk", 0.5))]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(And(EqualTo(term,the),GreaterThanOrEqual(impact,1.0))" in plan


def test_spans():
    assert bm25.spans([]) == []
    assert bm25.spans([1, 2, 3, 50, 51, 90], 2) == [(1, 3), (50, 90)] or bm25.spans([1, 2, 3, 50, 51, 90], 2) == [(1, 51), (90, 90)]
    covered = bm25.spans(list(range(0, 1000, 7)), 10)
    assert len(covered) == 10 and covered[0][0] == 0 and covered[-1][1] == 994


def test_the_index_has_no_lists_beside_those_by_impact(spark, tmp_path):
    postings = bm25.save_postings(corpus(spark, 60), f"{tmp_path}/p", lists=False)
    made = impact.save_impacts(postings, f"{tmp_path}/i")
    assert sorted(x.name for x in tmp_path.glob("*/*")) == ["corpus", "documents", "impacts", "levels", "stats", "terms"]
    queries = spark.createDataFrame(list(QUERIES.items()), "query_id string, text string")
    rows = lambda df: sorted((r.query_id, r["rank"], r.pos, r.id) for r in df.collect())
    assert rows(impact.search(made, queries, 9)) == rows(bm25.search(postings, queries, 9))
