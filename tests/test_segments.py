import pytest

from spindrift.plans import segments
from spindrift.plans.store import IndexNotFound

WORDS = "walk run sound floor light the of and river stone".split()


def corpus(spark, rows):
    return spark.createDataFrame(rows, "source string, text string")


def text(i, more=""):
    return f"# Part {i % 7}\n\n" + " ".join(WORDS[(i * k + k) % len(WORDS)] for k in range(1, 40 + i)) + f" unique{i} {more}\n\n## End\n\nthe last words of {i}\n"


BASE = [(f"topic{i % 3}/doc{i}.md", text(i)) for i in range(24)]
QUERIES = [("q1", "walk the unique5"), ("q2", "river stone"), ("q3", "last words of 7"), ("q4", "nothing matches xyz")]


def hits(spark, index):
    found = index.search_many(spark.createDataFrame(QUERIES, "query_id string, text string"), 10)
    return sorted((r.query_id, r["rank"], r.id, r.raw_score, r.text) for r in found.collect())


def test_updates_give_the_hits_of_a_new_index(spark, tmp_path):
    index = segments.Segments(spark, str(tmp_path / "grown"))
    with pytest.raises(IndexNotFound):
        index.chunks()
    first = index.update(corpus(spark, BASE))
    assert first["documents"] == 24 and first["embedded"] == first["added"] > 24 and first["removed"] == 0
    assert index.update(corpus(spark, BASE))["documents"] == 0  # nothing changed
    changed = [(s, t) if i not in (3, 4) else (s, text(i, "new ending")) for i, (s, t) in enumerate(BASE) if i != 6] + [("topic9/new.md", text(40))]
    second = index.update(corpus(spark, changed))
    assert second["documents"] == 4 and 0 < second["embedded"] < 12 and second["removed"] > 0
    fresh = segments.Segments(spark, str(tmp_path / "fresh"))
    fresh.update(corpus(spark, changed))
    assert hits(spark, index) == hits(spark, fresh)
    back = index.update(corpus(spark, BASE))  # what was removed comes back
    assert back["documents"] == 4
    again = segments.Segments(spark, str(tmp_path / "again"))
    again.update(corpus(spark, BASE))
    assert hits(spark, index) == hits(spark, again)


def test_merges_keep_hits_and_embed_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "TIER", 2)
    index = segments.Segments(spark, str(tmp_path / "merged"))
    for n in (8, 14, 20):
        index.update(corpus(spark, BASE[:n]))
    state = index.state()
    assert len(state["segments"]) < 3
    fresh = segments.Segments(spark, str(tmp_path / "fresh"))
    fresh.update(corpus(spark, BASE[:20]))
    assert hits(spark, index) == hits(spark, fresh)
    index.update(corpus(spark, BASE[:3]))  # most is dead: one segment without tombstones
    state = index.state()
    assert len(state["segments"]) == 1 and state["dead"] is None
    few = segments.Segments(spark, str(tmp_path / "few"))
    few.update(corpus(spark, BASE[:3]))
    assert hits(spark, index) == hits(spark, few)


def test_a_failed_update_changes_nothing(spark, tmp_path):
    index = segments.Segments(spark, str(tmp_path / "index"))
    index.update(corpus(spark, BASE[:4]))
    before = hits(spark, index)
    index.embedder = type("Broken", (), {"embed": lambda self, c: 1 / 0})()
    with pytest.raises(ZeroDivisionError):
        index.update(corpus(spark, BASE[:9]))
    index.embedder = segments.HashingEmbedder()
    assert index.state()["generation"] == 1 and hits(spark, index) == before


def test_equal_scores_stand_in_the_order_of_sources_after_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "TIER", 2)
    index = segments.Segments(spark, str(tmp_path / "index"))
    rows = [(f"topic/{chr(122 - i // 26)}{chr(122 - i % 26)}.md", f"walk the same words {i:02d}") for i in range(60)]
    index.update(corpus(spark, rows[:30]))
    index.update(corpus(spark, rows))  # later sources come first
    (name,) = [s["name"] for s in index.state()["segments"]]
    asked = spark.createDataFrame([("q", "walk")], "query_id string, text string")
    found = index._lexical(index.state(), index.chunks(), asked, 1).join(index.chunks().select("id", "source"), "id")
    assert [r.source for r in found.orderBy("rank").collect()] == sorted(s for s, _ in rows)[:30]
    assert not (tmp_path / "index" / name / "postings").exists()  # no list of postings is sorted and written for an update


def test_whole_tables_are_embedded_by_batches(spark, tmp_path):
    index = segments.Segments(spark, str(tmp_path / "index"))
    asked_for = []

    class Tables(segments.HashingEmbedder):
        def embed_table(self, text):
            asked_for.append("table")
            return super().embed_table(text)

    index.embedder = Tables()
    index.update(corpus(spark, BASE[:4]))
    assert asked_for == ["table"]
