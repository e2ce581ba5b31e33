from pyspark.sql import functions as F

from spindrift.operators import ingest
from spindrift.sources import files

HTML = (
    '<meta name="d" description="A description that is long enough to count here"><h1>Long title</h1><p>outside the article, long enough to be a paragraph</p>'
    '<article><h2>Inner <b>heading</b></h2><p class="x">This paragraph has &amp;lt; more than forty characters in it.</p><p>short</p></article>'
    '<div class="block-callout-content">A callout of more than thirty characters</div></div></block-callout>'
)


def test_html_blocks_come_by_kind(spark):
    row = spark.createDataFrame([(HTML,), ("",), ("<article><p>" + "x" * 41 + "</p>",)], "h string")
    got = [r[0] for r in row.select(ingest.html_blocks(F.col("h"))).collect()]
    assert got[0] == ["This paragraph has < more than forty characters in it.", "A description that is long enough to count here", "[Note] A callout of more than thirty characters", "\n## Long title\n", "\n## Inner heading\n"]
    assert got[1] == [] and got[2] == ["x" * 41]
    pages = [r[0] for r in row.select(ingest.page_markdown(F.col("h"), F.lit("T"), F.lit("u"))).collect()]
    assert pages[0].startswith("# T\n\n> Crawled locally from u\n\nThis") and pages[1] == ""


def test_api_docs():
    text = """/** A class with a comment that is long enough. */
UCLASS(meta=(a=(b)))
class AThing : public AActor { };
/** short */ class B {
/** Does a thing with some words.
 * And more. */
UFUNCTION()
public: void Run(int x);
/** """ + "system words " * 60 + """*/
int x;
/** nothing follows this comment of twenty */
"""
    got = list(ingest.api_docs("m/a.h", text))
    assert [d["doc_type"] for d in got] == ["class", "function", "overview"]
    assert got[0]["text"] == "[class AThing]\nBase: : public AActor\n\nA class with a comment that is long enough." and got[0]["id"] == "gas:m/a.h:AThing:0"
    assert got[1]["text"] == "[function] void Run()\n\nDoes a thing with some words. And more." and got[1]["heading"] == "Run()"
    assert len(got[2]["heading"]) == 60


def test_publishing(spark):
    skill = '---\r\nname: Title\r\ndescription: "Use this skill when working on maps"\r\nmetadata:\r\n  tags: [a, b]\r\n---\r\nYou are an expert of x\r\nkeep\r\nsee .agents/x\r\n\r\n'
    folded = "---\nname: T\ndescription: >-\n  one\n  two\n---\nbody"
    rows = spark.createDataFrame([("a/SKILL.md", skill), ("b/SKILL.md", folded), ("a/r.md", "x\nAsk the user now\n.agents/y\n\n"), ("gone/x.md", "z")], "source string, text string")
    got = {r.source: r.text for r in ingest.publish(rows, excluded=["gone"], keep_agents=["b"]).collect()}
    assert got["a/SKILL.md"] == "---\ntitle: Title\ndescription: Covers working on maps\ntags: [a, b]\n---\nkeep\n"
    assert got["b/SKILL.md"] == "---\ntitle: T\ndescription: one two\n---\nbody\n" and got["a/r.md"] == "x\n" and "gone/x.md" not in got


def test_scans_and_gates(spark):
    rows = spark.createDataFrame([(1, "ok\n  C:\\Users\\me and /home/me\nYou are an expert\n~/Library/Application Support C:/x"), (2, "see .agents/x")], "k int, text string")
    got = {(r.k, r.line, r.label) for r in ingest.privacy_scan(rows, "k").collect()}
    assert (1, 2, "windows user profile path") in got and (1, 2, "unix absolute path") in got and (2, 1, "internal .agents read") in got and not any(x[1] == 4 for x in got)
    assert (1, 3, "agent persona line") in got
    assert not ingest.privacy_scan(rows, "k", exempt=F.col("k") == 2).filter("k = 2").count()
    fences = [r[0] for r in spark.createDataFrame([("```a\nx\n````\n",), ("```\n~~~\n",), ("~~~~\n~~~\n",), ("",)], "t string").select(ingest.unbalanced_fences(F.col("t"))).collect()]
    assert fences == [False, True, True, False]
    ground = {r.concept: r.grounded for r in ingest.dictionary_grounding(rows, spark.createDataFrame([("Expert",), ("nope",)], "concept string")).collect()}
    assert ground == {"Expert": True, "nope": False}


def test_sources(spark, tmp_path):
    import json

    for name, text in {"a/b c.md": "x\r\ny", "a/z.txt": "no", "r.md": "r", "S/Public/x.h": "h", "S/Intermediate/y.h": "n", "S/x.generated.h": "n"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode())
    assert {r.source: r.text for r in files.read_markdown(spark, str(tmp_path)).collect()} == {"a/b c.md": "x\ny", "r.md": "r"}
    assert [r.path for r in files.read_headers(spark, str(tmp_path)).collect()] == ["S/Public/x.h"]
    assert {r.source: r.length for r in files.file_hashes(files.read_bytes(spark, str(tmp_path))).collect()} == {"a/b c.md": 4, "r.md": 1}
    (tmp_path / "q.json").write_text(json.dumps([{"topic": "t", "queries": [{"language": "en", "split": "tune", "text": "one"}, {"language": "zh", "split": "heldout", "text": "二"}]}]))
    (tmp_path / "l.json").write_text(json.dumps([{"query": "one", "topic": "t", "expected": [{"source": "s", "heading": "h"}]}]))
    (tmp_path / "n.json").write_text(json.dumps([{"topic": "t", "queries": [{"text": "三"}]}]))
    got = {r.text: (r.language, r.split, r.expected and r.expected[0].source) for r in files.read_queries(spark, *(str(tmp_path / f"{x}.json") for x in "qln")).collect()}
    assert got == {"one": ("en", "tune", "s"), "二": ("zh", "heldout", None), "三": ("zh", "natural_zh", None)}
