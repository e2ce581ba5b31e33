import corpus_pipeline
from spindrift.llm import exact_dedup, near_dedup, quality

from .helpers import SMALL


def test_stages_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    names = docs.columns
    one, two, three = [f for _, f in corpus_pipeline.STAGES[:3]]
    good = one(spark, docs, SMALL)
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    assert good.columns == names and ids(good) == ids(quality.drop_low_quality(docs, labels)) and ids(good) < ids(docs)
    unique = two(spark, docs, SMALL)
    assert unique.columns == names and ids(unique) == ids(exact_dedup.exact_duplicates(docs).filter("kept"))
    single = three(spark, unique, SMALL)
    assert single.columns == names and ids(single) == ids(near_dedup.near_duplicates(unique, width=5).filter("kept"))


def test_run_packs_what_the_stages_keep(spark):
    out = corpus_pipeline.run(spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert 0 < len({r.doc_id for r in out}) < docs.count() and all(len(r.ids) == r.length for r in out)
    assert all(s[1].__doc__ for s in corpus_pipeline.STAGES)


CLASHING = "doc_id long, text string, lang string, source string, low double, middle double, high double, _chars long, _lang string, _kept boolean, _gone long, _row long, _sha string, _digest string, c0 long"


def clashing(spark, rows):
    """Rows (doc_id, text) with columns named like those that the stages add."""
    return spark.createDataFrame([(i, t, "en", "s", 1.0, 2.0, 3.0, 4, "x", False, i, 9, "y", "z", 5) for i, t in rows], CLASHING)


SHARED = [(5, "a b c"), (9, "A b c"), (5, "b"), (7, "c"), (7, "c"), (None, "d"), (None, "d"), (None, "e"), (8, None), (6, ""), (3, "f")]


def test_exact_stage_tells_rows_apart(spark):
    docs = clashing(spark, SHARED)
    kept = corpus_pipeline.drop_copies(spark, docs, SMALL)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(9, "A b c"), (5, "b"), (7, "c"), (None, "d"), (None, "e"), (8, None), (3, "f")], key=str)


def test_near_stage_tells_rows_apart(spark):
    long = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"term{i}" for i in range(60))
    rows = [(5, long), (5, other), (3, long + " end"), (None, other + " end"), (None, "short text here"), (7, "short text here"), (8, "alone"), (8, "single")]
    docs = clashing(spark, rows)
    kept = corpus_pipeline.drop_near_copies(spark, docs, SMALL)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert sorted(texts) == sorted([long + " end", next(t for t in texts if t.startswith(other)), "short text here", "alone", "single"])
    assert 7 in [r.doc_id for r in kept.collect()]  # an id of its own goes before rows that share one


def test_quality_stage_keeps_clashing_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.filter("lang = 'en'").select("doc_id", "text").collect()]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    plain = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    kept = quality.drop_low_quality(clashing(spark, rows), labels)
    assert kept.columns == clashing(spark, rows[:1]).columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.drop_low_quality(plain, labels).collect()}
    judged = quality.judged(clashing(spark, rows[:3]), quality.fit(plain, labels))
    assert judged.count() == 3 and judged.columns.count("low") == 1


def test_stages_of_empty_tables(spark):
    none = clashing(spark, SHARED).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SMALL).count() == 0
