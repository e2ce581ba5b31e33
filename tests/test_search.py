import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions.vectors import clamp, cosine
from spindrift.operators import bm25, diff, evaluate, fuse
from spindrift.operators.expand import Expander
from spindrift.plans.index import HashingEmbedder, Index, format_results
from spindrift.plans.store import CorpusNotFound, IndexNotFound, IndexProblem, InvalidPath, ModelUnavailable, SchemaMismatch, Store, require_ascii


def write(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")


CORPUS = {
    "ue-movement/SKILL.md": "---\nname: movement\n---\n# Movement\nCharacter movement and braking deceleration.\n",
    "ue-movement/references/walk.md": "# Walking\nWalking speed and floors.\n## Floors\nFloor checks for walking characters.\n",
    "ue-audio/SKILL.md": "# Audio\nSound attenuation and music.\n",
}


def test_build_search_sync_and_failures(spark, tmp_path):
    corpus, root = tmp_path / "corpus", tmp_path / "index"
    write(corpus, CORPUS)
    index = Index(spark, str(root), glossary=[{"topic": "ue-audio", "canonical": "audio", "aliases": ["声音"], "identifiers": ["MetaSound"]}], topic_prefix="ue-")
    with pytest.raises(IndexNotFound):
        index.store.current()
    assert index.doctor()["ok"] is False
    built = index.build(str(corpus))
    assert (built["files"], built["chunks"], built["added"], built["removed"]) == (3, 5, 5, 0)
    hits = index.search("walking floors").collect()
    assert hits[0].source == "ue-movement/references/walk.md" and hits[0]["score"] == 1.0 and [h["rank"] for h in hits] == list(range(1, len(hits) + 1))
    assert len({(h.source, h.heading) for h in hits}) == len(hits)
    assert index.search("声音").first().source == "ue-audio/SKILL.md"
    assert index.search("walking", profile="vector", top_k=2).count() == 2 and index.search("walking", top_k=0).count() == 0
    assert "匹配度" in format_results(hits) and format_results([]) == "没有找到相关结果。"
    with pytest.raises(ValueError):
        index.search("x", profile="other")
    with pytest.raises(IndexProblem):
        index.build(str(corpus))
    assert index.doctor()["ok"] is True
    write(corpus, {"ue-audio/SKILL.md": "# Audio\nSomething else now.\n", "ue-new/SKILL.md": "# New\nnew text\n"})
    assert index.info()["stale"] is True
    before = index.store.current()
    again = index.build(str(corpus), append=True)
    assert (again["added"], again["removed"], again["unchanged"]) == (2, 1, 4) and index.store.current() != before
    demoted = index.search("movement", 10, demote_frontmatter=True).collect()
    plain = index.search("movement", 10).collect()
    assert {h.heading for h in demoted} == {h.heading for h in plain} and demoted[-1].type == "frontmatter"
    with pytest.raises(ModelUnavailable):
        Index(spark, str(root), embedder=HashingEmbedder(32)).search("x")
    empty = tmp_path / "empty"
    empty.mkdir()
    active = index.store.current()
    with pytest.raises(CorpusNotFound):
        index.build(str(empty), force=True)
    with pytest.raises(CorpusNotFound):
        index.build(str(tmp_path / "none"), force=True)
    assert index.store.current() == active


def test_store_lifecycle(tmp_path):
    import os
    import time

    store = Store(tmp_path / "i")
    made = [store.create() for _ in range(3)]
    for g in made:
        store.write_manifest(g, {"schema_version": 2})
        store.activate(g)
        time.sleep(0.002)
    assert store.current() == made[-1] and store.retain(2) == [made[0].name]
    bad = store.create()
    assert store.sweep() == []
    for f in bad.iterdir():
        os.utime(f, (0, 0))
    assert store.sweep() == [bad.name]
    store.write_manifest(made[-1], {"schema_version": 1})
    with pytest.raises(SchemaMismatch):
        store.current()
    with store.lock():
        with pytest.raises(IndexProblem), store.lock():
            pass
        assert (store.root / "lock").exists()
        os.utime(store.root / "lock", (0, 0))
        with store.lock():
            pass
    assert not (store.root / "lock").exists()
    with pytest.raises(InvalidPath):
        require_ascii("/tmp/索引")


def test_bm25_by_hand(spark):
    import math

    rows = spark.createDataFrame([(0, "a", "h", "t", "x y"), (1, "b", "x", "t", "z"), (2, "c", "", "", "")], "pos long, id string, heading string, topic_text string, text string")
    index = bm25.build_postings(rows)
    length = {r.pos: r.length for r in index.stats.collect()}
    assert length == {0: 7.0, 1: 6.0, 2: 1.0}
    queries = spark.createDataFrame([("q", "x x nothing"), ("r", "")], "query_id string, text string")
    got = [(r.pos, r.score, r["rank"]) for r in bm25.search(index, queries).orderBy("rank").collect()]
    mean, idf = 14 / 3, math.log(1 + (3 - 2 + 0.5) / 2.5)
    one = lambda tf, n: 2 * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))
    assert got == [(1, round(one(3, 6), 9), 1), (0, round(one(1, 7), 9), 2)]


def test_fusion_is_symmetric_and_demotion_may_exceed_one(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, id string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "query_id string, id string, rank int")
    get = lambda lists: {r.id: r.raw for r in fuse.rrf(lists).collect()}
    assert get([a, b]) == get([b, a]) and abs(get([a, b])["y"] - (1 / 62 + 1 / 61)) < 1e-9
    chunks = spark.createDataFrame([("x", "s", "h1", "content", "tx"), ("y", "s", "h2", "frontmatter", "ty"), ("z", "s", "h1", None, "tz")], "id string, source string, heading string, type string, text string")
    got = fuse.finish(fuse.rrf([a, b]), chunks, 5, demote_frontmatter=True).orderBy("rank").collect()
    assert [(h.id, h["rank"]) for h in got] == [("x", 1), ("y", 2)] and got[1].score > 1
    assert [r[0] for r in spark.createDataFrame([(0.03,), (0.02,), (0.013,), (0.011,)], "r double").select(fuse.band(F.col("r"))).collect()] == ["strong", "usable", "unlabelled", "weak"]


def test_expansion_takes_longest_names_once_and_at_most_twelve():
    many = Expander([{"canonical": f"c{i}", "aliases": [f"n{i}"], "identifiers": []} for i in range(20)])
    assert len(many(" ".join(f"n{i}" for i in range(20))).split()) == 20 + 12
    e = Expander([{"canonical": "tree", "aliases": ["行为树"], "identifiers": ["BT"]}, {"canonical": "act", "aliases": ["行为"]}], [("行", ["step"]), ("走路", ["walk", "move"])])
    assert e("行为树") == "行为树 tree BT" and e("行为 走路") == "行为 走路 act walk move" and e("plain English") == "plain english"


def test_diffs_and_metrics(spark):
    old, new = (spark.createDataFrame([(x,) for x in xs], "id string") for xs in ("abb", "bcd"))
    assert diff.snapshot_diff(old, new).first().asDict() == {"added": 2, "removed": 1, "unchanged": 1}
    assert diff.snapshot_diff(old.limit(0), new.limit(0)).first().asDict() == {"added": 0, "removed": 0, "unchanged": 0}
    e = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    f = spark.createDataFrame([("b", "2"), ("c", "1"), ("d", "1")], "path string, hash string")
    assert {tuple(r) for r in diff.manifest_diff(e, f).collect()} == {("a", "missing"), ("b", "stale"), ("d", "extra")}
    ms = spark.createDataFrame([(float(i),) for i in range(1, 31)], "ms double")
    assert evaluate.exclusive_quantile(ms, "ms", 0.95).first()[0] == pytest.approx(29.45)
    first = spark.createDataFrame([("a", 1), ("b", 4), ("c", None)], "query_id string, first int")
    assert evaluate.recall_at_k(first).first()[0] == pytest.approx(1 / 3) and evaluate.mrr_at_k(first).first()[0] == pytest.approx((1 + 0.25) / 3)
    assert evaluate.recall_at_k(first.limit(0)).first()[0] is None


def test_searches_hand_on_only_the_best_of_each_task(spark, tmp_path):
    """Of 3000 documents that all share a term with every query, few scores leave the tasks; ranks and ties are those of all scores."""
    rows = [(i, f"id{i}", "", "", " ".join(["common", "w%d" % (i % 7), *(["rare"] if i % 50 == 0 else [])])) for i in range(3000)]
    chunks = spark.createDataFrame(rows, "pos long, id string, heading string, topic_text string, text string").repartition(3)
    index = bm25.save_postings(chunks, str(tmp_path / "index"))
    queries = spark.createDataFrame([("a", "common"), ("b", "common w3 w3 rare"), ("c", "none")], "query_id string, text string")
    few = bm25.nearest(index, queries, 5)
    assert few.count() <= 5 * 2 * 3 * few.rdd.getNumPartitions()
    want = bm25.top(bm25.scores(index, queries), 5)
    key = lambda df: sorted((r.query_id, r["rank"], r.pos, r.score) for r in df.collect())
    assert key(bm25.search(index, queries, 5)) == key(want)
    assert key(bm25.search(index, queries, 5, n_queries=10**5)) == key(want)  # several blocks of queries


def test_cosine_search_by_matrices_gives_the_rows_of_the_expression(spark):
    rng = np.random.default_rng(5)
    v = [x.tolist() for x in rng.normal(size=(300, 8))]
    v += [v[3]] * 40 + [[0.0] * 8, None, [1.0] * 7, [None, *[1.0] * 7], [float("nan")] * 8, [1e-170] * 8, [1e160] * 8]
    frame = spark.createDataFrame([(f"i{i:03}", x) for i, x in enumerate(v)], "id string, embedding array<double>").repartition(3)
    asked = [v[3], v[7], [0.0] * 8, [1.0] * 8, [1.0] * 7, None]
    queries = spark.createDataFrame([(f"q{i}", x) for i, x in enumerate(asked)], "query_id string, qvec array<double>")
    pairs = frame.crossJoin(queries).select("query_id", "id", F.round(clamp(cosine(F.col("embedding"), F.col("qvec"))), 9).alias("score"))
    key = lambda df: sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())
    for limit in (1, 10, 50, 1000):
        assert key(fuse.cosine_topk(frame, queries, limit)) == key(bm25.top(pairs, limit, tie="id"))
    assert key(fuse.cosine_topk(frame, queries, 10, n_queries=10**4)) == key(bm25.top(pairs, 10, tie="id"))
    assert fuse.cosine_topk(frame, queries, 0).count() == 0


def test_vectors_of_tables_are_those_of_the_expression(spark):
    e = HashingEmbedder()
    rows = spark.createDataFrame([("The THE the 走路 ab",), ("",), (None,), ("ünder x  \ty",)], "text string")
    for r in rows.select(e.embed(F.col("text")).alias("a"), e.embed_table(F.col("text")).alias("b"), "text").collect():
        assert r.a == r.b or r.text is None


def test_documents_of_one_file_are_cut_by_several_tasks(spark, tmp_path):
    docs = spark.createDataFrame([(f"s/{i}.md", " ".join(map(str, words))) for i, words in enumerate(np.random.default_rng(1).integers(0, 1 << 40, (400, 800)).tolist())], "source string, text string").coalesce(1)
    placed = Index(spark, str(tmp_path)).placed(docs)
    rows = placed.orderBy("pos").select("source", F.shiftright("pos", 33).alias("task")).collect()
    assert len({r.task for r in rows}) > 1 and [r.source for r in rows] == sorted(r.source for r in rows)
