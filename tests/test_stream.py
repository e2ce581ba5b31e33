import json

from spindrift.operators import evaluate
from spindrift.plans import stream
from spindrift.plans.index import Index


def write_lines(folder, number, rows):
    folder.mkdir(exist_ok=True)
    part = folder / f".{number}"
    part.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    part.rename(folder / f"{number}.json")


def test_batches_answer_from_the_active_snapshot(spark, tmp_path):
    docs = spark.createDataFrame([("a/x.md", "# One\n\nwalking on floors\n"), ("b/y.md", "# Two\n\nrunning water\n")], "source string, text string")
    index = Index(spark, str(tmp_path / "index"))
    index.build_documents(docs, "first", lambda: "1")
    places = [str(tmp_path / n) for n in ("lines", "hits", "state")]
    write_lines(tmp_path / "lines", 1, [{"query_id": "q1", "text": "walking"}, "no json", {"query_id": "q2", "text": None}, {"query_id": "q1", "text": "walking"}])
    stream.search_stream(index, *places).awaitTermination()
    one = spark.read.parquet(places[1]).collect()
    assert {r.query_id for r in one} == {"q1"} and one[0].generation == index.store.current().name
    more = docs.union(spark.createDataFrame([("c/z.md", "# Three\n\nwalking walking\n")], docs.schema))
    index.build_documents(more, "second", lambda: "2", force=True)
    write_lines(tmp_path / "lines", 2, [{"query_id": "q3", "text": "walking"}])
    stream.search_stream(index, *places).awaitTermination()
    found = spark.read.parquet(places[1]).collect()
    generations = {r.query_id: r.generation for r in found}
    assert generations["q3"] == index.store.current().name != generations["q1"]
    assert "c/z.md" in {r.source for r in found if r.query_id == "q3"} and "c/z.md" not in {r.source for r in found if r.query_id == "q1"}
    stream.search_stream(index, *places).awaitTermination()  # nothing new: nothing is answered twice
    assert len(spark.read.parquet(places[1]).collect()) == len(found)


def test_groupings_are_those_of_each_group_by(spark):
    rows = [(i, "ab"[i % 2], "xyz"[i % 3], None if i % 4 == 0 else i % 6 + 1) for i in range(40)]
    found = spark.createDataFrame(rows, "query_id int, split string, profile string, first int")
    got = {(r.split, r.profile, r.level): (r.queries, round(r.recall, 9), round(r.mrr, 9)) for r in evaluate.grouped_stats(found, ["split", "profile"], [[], ["split"], ["split", "profile"]]).collect()}
    want = {}
    for by, level in ((["split"], 1), (["split", "profile"], 0)):
        for r in evaluate.split_stats(found, by).collect():
            want[r.split, r.asDict().get("profile"), level] = (r.queries, round(r.recall, 9), round(r.mrr, 9))
    whole = evaluate.split_stats(found, []).first()
    want[None, None, 3] = (whole.queries, round(whole.recall, 9), round(whole.mrr, 9))
    assert got == want
