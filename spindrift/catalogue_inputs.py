"""Queries over small written inputs: what the given tables do not hold (fences, headings, front matter, headers, JSON files,
snapshots). Expected rows are worked out by hand from the operators' descriptions, or computed in SQL from the same inputs."""

from __future__ import annotations

import json
import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import _GLOSSARY_SQL, EXPANDED, GLOSSARY, MANY, ORACLE_SQL, TOKEN_RE, _norm, _terms, _values, asked, folder, page_markdown, query, read
from .functions import text as T
from .operators import bm25, chunk, diff, evaluate, expand, fuse, ingest, patterns
from .plans.index import BatchEmbedder, HashingEmbedder, Index, format_results
from .plans.scratch import scratch
from .plans.segments import SHIFT, Segments
from .plans.server import Server
from .plans import stream
from .plans.store import IndexProblem, Store, require_ascii
from .sources import files, sink


def sql(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    return repr(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """SELECT of rows; columns: name and type of each."""
    named = [c.split() for c in columns.split(", ")]
    casts = ", ".join(f'c{i}::{t} as "{n}"' for i, (n, t) in enumerate(named))
    names = ", ".join(f"c{i}" for i in range(len(named)))
    return f"select {casts} from (values {', '.join('(' + ', '.join(map(sql, r)) + ')' for r in rows)}) t({names})"


def written(spark: SparkSession, given: dict[str, str]) -> str:
    root = folder(spark)
    for name, text in given.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text.encode())
    return str(root)


# Files
TREE = {
    "walk/SKILL.md": "# Walk\r\nSpeed and floors.\r",
    "walk/references/floor.md": "## Floor\nFloor checks.\n",
    "swim/SKILL.md": "# Swim\nWater über alles.\n",
    "swim/empty.md": "",
    "swim/notes.txt": "no Markdown",
    "src/Walk.h": "/** Moves a character along floors, step by step. */\nclass UWalk : public UMove {\n",
    "src/Walk.generated.h": "generated",
    "Intermediate/Swim.h": "intermediate",
}


@query("markdown_tree", values([("walk/SKILL.md", "# Walk\nSpeed and floors.\n"), ("walk/references/floor.md", "## Floor\nFloor checks.\n"), ("swim/SKILL.md", "# Swim\nWater über alles.\n")], "source varchar, text varchar"))
def markdown_tree(spark, sf_dir):
    return files.read_markdown(spark, written(spark, TREE))


@query("file_bytes", f"select source, octet_length(encode(text))::bigint as length, sha256(text) as hash from ({values([(k, v) for k, v in TREE.items() if k.endswith('.md') and v], 'source varchar, text varchar')})")
def file_bytes(spark, sf_dir):
    return files.file_hashes(files.read_bytes(spark, written(spark, TREE)))


@query("header_files", values([("src/Walk.h", 2)], "path varchar, lines int"))
def header_files(spark, sf_dir):
    return files.read_headers(spark, written(spark, TREE)).select("path", (F.size(F.split("text", "\n")) - 1).alias("lines"))


@query(
    "corpus_fingerprint",
    """with r as (select sha256(source || '/' || doc_id) as g, sha256(concat_ws(chr(0), source || '/' || doc_id, octet_length(encode(text))::varchar, sha256(text))) as d from documents),
    a as (select substr(g, 1, 4) as g, sha256(string_agg(d, '' order by d)) as d from r group by 1),
    b as (select substr(g, 1, 2) as g, sha256(string_agg(d, '' order by d)) as d from a group by 1)
    select sha256(string_agg(d, '' order by d)) as fingerprint from b""",
)
def corpus_fingerprint(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source"), F.encode("text", "UTF-8").alias("content"))
    return files.fingerprint(files.file_hashes(docs.withColumn("length", F.octet_length("content"))))


GOLDEN = [
    {"topic": "walk", "queries": [{"language": "en", "split": "tune", "text": "walking speed"}, {"language": "zh", "split": "heldout", "text": "走路"}]},
    {"topic": "swim", "queries": [{"language": "en", "split": "heldout", "text": "water"}]},
]
NATURAL = [{"topic": "swim", "queries": [{"text": "怎么游泳"}]}]
EXPECTED = [
    {"query": "water", "topic": "swim", "expected": [{"source": "swim/SKILL.md", "heading": "Swim"}]},
    {"query": "water", "topic": "swim", "expected": [{"source": "swim/SKILL.md", "heading": "Swim"}, {"source": "walk/SKILL.md", "heading": "Walk"}]},
]


@query(
    "golden_queries",
    values([("walk", "en", "tune", "walking speed", None), ("walk", "zh", "heldout", "走路", None), ("swim", "en", "heldout", "water", 2), ("swim", "zh", "natural_zh", "怎么游泳", None)], "topic varchar, language varchar, split varchar, text varchar, expected int"),
)
def golden_queries(spark, sf_dir):
    root = written(spark, {"golden.json": json.dumps(GOLDEN), "natural.json": json.dumps(NATURAL), "labels.json": json.dumps(EXPECTED)})
    rows = files.read_queries(spark, f"{root}/golden.json", f"{root}/labels.json", f"{root}/natural.json")
    return rows.select("topic", "language", "split", "text", F.when(F.col("expected").isNotNull(), F.size("expected")).alias("expected"))


# Text functions
STRINGS = ("plain ASCII", "café", "走路 walk", "", "ﬁne ＡＢＣ ①", "naïve étude", "getHTTPValue::a_b/c", "tab\tand space")


@query("text_predicates", f"select x, regexp_matches(x, '[\\x{{3400}}-\\x{{9fff}}]') as cjk, not regexp_matches(x, '[^\\x00-\\x7f]') as ascii from ({values([(x,) for x in STRINGS], 'x varchar')})")
def text_predicates(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in STRINGS], "x string")
    return rows.select("x", T.has_cjk(F.col("x")).alias("cjk"), T.is_ascii(F.col("x")).alias("ascii"))


@query(
    "normalized_strings",
    values([("plain ASCII", "plain ascii"), ("café", "café"), ("走路 walk", "走路 walk"), ("", ""), ("ﬁne ＡＢＣ ①", "fine abc 1"), ("naïve étude", "naïve étude"), ("getHTTPValue::a_b/c", "get httpvalue a b c"), ("tab\tand space", "tab and space")], "x varchar, normalized varchar"),
)
def normalized_strings(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in STRINGS], "x string").select("x", T.normalize(F.col("x")).alias("normalized"))


PATHS = (("a\\b\\c.md", "a/b/c.md"), ("./a//b.md", "a/b.md"), ("a/./b.md", "a/b.md"), ("a/b/", "a/b"), ("a.md", "a.md"))


@query("normalized_sources", values(list(PATHS), "path varchar, source varchar"))
def normalized_sources(spark, sf_dir):
    return spark.createDataFrame([(a,) for a, _ in PATHS], "path string").select("path", T.normalized_source(F.col("path")).alias("source"))


# Chunks
MARKED = {
    "a/one.md": "---\nname: one\n---\n# Top\nfirst body\n### Deep ##\ndeep body\n## Second\n## Empty\n",
    "a/long.md": "# L\n" + " ".join(f"w{i}" for i in range(20)) + "\n",
}
FENCED = {
    "b/code.md": "intro words\n# Code\n```py\n# no heading\nx = 1\n```\nafter\n",
    "b/fits.md": "# F\none two\n```\na b c\nd e f\ng h i\n```\n",
    "b/open.md": "# O\n~~~\na b\n```\nc\n# still inside\n",
}
CHUNKS = [
    ("a/one.md", 0, "frontmatter", "前言", "---\nname: one\n---"),
    ("a/one.md", 1, "content", "Top", "# Top\nfirst body"),
    ("a/one.md", 2, "content", "Top / Deep", "### Deep ##\ndeep body"),
    ("a/long.md", 0, "content", "L", "# L\nw0 w1 w2 w3 w4 w5 w6 w7"),
    ("a/long.md", 1, "content", "L", "w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"),
    ("a/long.md", 2, "content", "L", "w14 w15 w16 w17 w18 w19"),
    ("b/code.md", 0, "content", "前言", "intro words"),
    ("b/code.md", 1, "content", "Code", "# Code\n```py\n# no heading\nx = 1\n```\nafter"),
    ("b/fits.md", 0, "content", "F", "# F\none two"),
    ("b/fits.md", 1, "content", "F", "```\na b c\nd e f\ng h i\n```"),
    ("b/open.md", 0, "content", "O", "# O\n~~~\na b\n```\nc\n# still inside\n~~~"),
]


def literal_docs(spark, given: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(given.items()), "source string, text string")


@query("chunk_literals", values(CHUNKS, "source varchar, pos int, type varchar, heading varchar, text varchar"))
def chunk_literals(spark, sf_dir):
    """Headings, front matter and windows of ten tokens that share two; fences in windows of eighteen that share none."""
    parts = [chunk.chunk_documents(literal_docs(spark, given), max_tokens=n, overlap=o) for given, n, o in ((MARKED, 10, 2), (FENCED, 18, 0))]
    return parts[0].unionByName(parts[1]).select("source", "pos", "type", "heading", "text")


@query("chunk_least_chars", values([("a/one.md", "Top / Deep"), ("a/one.md", "前言"), ("a/long.md", "L")], "source varchar, heading varchar"))
def chunk_least_chars(spark, sf_dir):
    """Sections whose text without its heading has eleven characters at least ("first body" has ten)."""
    docs = literal_docs(spark, MARKED | {"a/one.md": MARKED["a/one.md"].replace("deep body", "deeper body")})
    return chunk.chunk_documents(docs, min_chars=11).select("source", "heading")


# Texts cut in front of each token: piece i is token i and what follows it; a window's text is its pieces, trimmed.
def _pieces(text: str) -> str:
    return f"string_split(regexp_replace({text}, '({TOKEN_RE})', chr(1) || '\\1', 'g'), chr(1))[2:]"


SPACE_SET = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
DOC_CHUNKS = f"""
d as (select source || '/' || doc_id || '.md' as source, trim(text, {SPACE_SET}) as text from documents),
t as (select source, {_pieces('text')} as p from d where text <> ''),
w as (select source, p, len(p) as n, unnest(range(0, case when len(p) <= 384 then 1 else ceil((len(p) - 384) / 336.0)::int + 1 end)) as pos from t where len(p) > 0),
chunks as (select source, pos::int as pos, trim(array_to_string(p[pos * 336 + 1:least(pos * 336 + 384, n)], ''), {SPACE_SET}) as text from w)"""


def doc_sources(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source"), "text")


@query("chunk_documents", f"with {DOC_CHUNKS} select source, pos, '前言' as heading, 'content' as type, 0 as section, text, sha256(source || chr(0) || '前言' || chr(0) || text) as id from chunks")
def chunk_documents(spark, sf_dir):
    return chunk.chunk_documents(doc_sources(spark, sf_dir)).select("source", "pos", "heading", "type", "section", "text", "id")


# Fences, quality, publishing
FENCE_TEXTS = [("f1", "```\ncode\n```\n`py\n`\n"), ("f2", "~~~~\n```\n~~~\n"), ("f3", "You are an expert in walking.\nread .agents/x.md\n```py\n"), ("f4", "```\n````\n  ~~~ x\n"), ("f5", "plain")]
PATTERNS = {"broken_fences": r"^`[A-Za-z]+\s*$", "lone_backticks": r"^`\s*$", "agent_reads": r"\.agents/", "persona_lines": r"(?i)^\s*You are an? .*expert", "fences": r"^\s*(```|~~~)"}
FENCE_INPUT = f"select 'd' || doc_id as key, text from documents union all ({values(FENCE_TEXTS, 'key varchar, text varchar')})"


def fence_docs(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), "text")
    return docs.unionByName(spark.createDataFrame(FENCE_TEXTS, "key string, text string"))


@query("fence_gates", "select key, " + ", ".join(f"len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{p}')))::bigint as {n}" for n, p in PATTERNS.items()) + f" from ({FENCE_INPUT})")
def fence_gates(spark, sf_dir):
    return ingest.fence_gates(fence_docs(spark, sf_dir), "key")


#: The open fence, as a fold over the marks of a text's fence lines: '' is none.
OPEN_FENCE = "list_reduce(list_prepend('', list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*(`{3,}|~{3,})')), lambda x: regexp_extract(x, '^\\s*(`{3,}|~{3,})', 1))), lambda a, m: case when a = '' then m when a[1] = m[1] and length(m) >= length(a) then '' else a end)"


@query(
    "chunk_quality",
    f"""with t as (select md5(key) as id, len(regexp_extract_all(text, '{TOKEN_RE}')) as n, {OPEN_FENCE} <> '' as u from ({FENCE_INPUT}))
    select count(*) as chunks, count(distinct id) as ids, max(n)::bigint as max_tokens, count(*) filter (n > 384) as over_limit, count(*) filter (u) as unbalanced from t""",
)
def chunk_quality(spark, sf_dir):
    return ingest.chunk_quality(fence_docs(spark, sf_dir).withColumn("id", F.md5("key")))


@query("fence_parity", values([("b", 3, 2, "different"), ("c", 1, None, "extra"), ("d", None, 0, "missing")], "path varchar, published bigint, source bigint, state varchar"))
def fence_parity(spark, sf_dir):
    made = lambda rows: spark.createDataFrame(rows, "path string, text string")
    published = made([("a", "```\nx\n```"), ("b", "```\n```\n```"), ("c", "~~~")])
    return ingest.fence_parity(published, made([("a", "x\n```\n```"), ("b", "```\n```"), ("d", "x")]))


@query("manifest_summary", "select 1::bigint as missing, 1::bigint as stale, 2::bigint as extra, 4::bigint as differences")
def manifest_summary(spark, sf_dir):
    made = lambda rows: spark.createDataFrame(rows, "path string, hash string")
    return diff.manifest_summary(made([("a", "1"), ("b", "1"), ("c", "1")]), made([("b", "2"), ("c", "1"), ("d", "1"), ("e", "1")]))


PRIVATE = [(1, "see Project Falcon\nand falcons"), (2, "run ~/.tool/x.sh\nC:\\Users\\me"), (3, "/home/someone/x\n~/Library/Application Support /home/a"), (4, "Ask the developer first\nread .agents/a.md")]


@query(
    "privacy_names",
    values(
        [(1, 1, "private project name"), (2, 1, "author tooling path"), (2, 2, "windows user profile path"), (2, 2, "drive-letter absolute path"), (3, 1, "unix absolute path"), (4, 1, "agent prompt line"), (4, 2, "internal .agents read")],
        "doc_id bigint, line int, label varchar",
    ),
)
def privacy_names(spark, sf_dir):
    docs = spark.createDataFrame(PRIVATE, "doc_id long, text string")
    return ingest.privacy_scan(docs, "doc_id", patterns=ingest.privacy_patterns(["project falcon"], ["~/.tool/"])).select("doc_id", "line", "label")


@query("dictionary_empties", values([("b",), ("c",), ("d",)], "phrase varchar"))
def dictionary_empties(spark, sf_dir):
    return ingest.dictionary_empties(spark.createDataFrame([("a", ["x"]), ("b", []), ("c", None), ("d", [" "])], "phrase string, concepts array<string>"))


PUBLISHED = {
    "walk/SKILL.md": '---\nname: walk\ndescription: "Use this skill when working with walking."\nmetadata:\n  tags: [a, b]\n---\nYou are an expert in walking.\n# Walk\nread .agents/x.md\nbody\n\n',
    "walk/references/floor.md": "Ask the user for floors.\r\nFloors.\r\n",
    "swim/SKILL.md": "---\nname: swim\ndescription: >-\n  Use this skill when\n  swimming.\n---\nWater\n",
    "old/SKILL.md": "gone\n",
}


@query(
    "publish_documents",
    values(
        [
            ("walk/SKILL.md", "---\ntitle: walk\ndescription: Covers walking.\ntags: [a, b]\n---\n# Walk\nbody\n"),
            ("walk/references/floor.md", "Floors.\n"),
            ("swim/SKILL.md", "---\ntitle: swim\ndescription: Covers swimming.\n---\nWater\n"),
        ],
        "source varchar, text varchar",
    ),
)
def publish_documents(spark, sf_dir):
    return ingest.publish(literal_docs(spark, PUBLISHED), excluded=["old"])


HEADER = """/** Moves a character along floors, step by step. */
UCLASS(Blueprintable, meta=(A="(x)"))
class UWalk : public UMove {
public:
/** Sets the walking speed of a character. */
UFUNCTION(BlueprintCallable)
void SetSpeed(float Speed);
/** short */
float Speed;
/** Kinds of floors that a character meets. */
UENUM()
enum class EFloor : uint8 {
};
"""


@query(
    "api_comments",
    values(
        [
            ("gas:W.h:UWalk:0", "UWalk", "class", "[class UWalk]\nBase: : public UMove\n\nMoves a character along floors, step by step."),
            ("gas:W.h:func:SetSpeed:1", "SetSpeed()", "function", "[function] void SetSpeed()\n\nSets the walking speed of a character."),
            ("gas:W.h:EFloor:3", "EFloor", "enum class", "[enum class EFloor]\nBase: : uint8\n\nKinds of floors that a character meets."),
        ],
        "id varchar, heading varchar, doc_type varchar, text varchar",
    ),
)
def api_comments(spark, sf_dir):
    return ingest.extract_api_docs(spark.createDataFrame([("W.h", HEADER)], "path string, text string")).select("id", "heading", "doc_type", "text")


# Expansion: names by length; each takes its first place that no longer name has taken (chr(1) marks what is taken).
_NAMES = sorted(((expand.normalize_text(a), i, j, [g["canonical"], *g["identifiers"]]) for i, g in enumerate(GLOSSARY) for j, a in enumerate(g["aliases"])), key=lambda n: -len(n[0]))
_NAME_ROWS = ", ".join(f"({k}, '{n}', {gives!r})" for k, (n, _, _, gives) in enumerate(_NAMES, 1))


@query(
    "expand_queries",
    f"""with recursive names(k, name, gives) as (values {_NAME_ROWS}),
    q as (select query_id, {_norm('text')} as text from (values {", ".join(f"('{k}', '{v}')" for k, v in EXPANDED.items())}) t(query_id, text)),
    step(query_id, text, k, left_, added) as (
      select query_id, text, 0, text, []::varchar[] from q
      union all
      select query_id, text, n.k, case when instr(left_, name) > 0 then left_[:instr(left_, name) - 1] || repeat(chr(1), length(name)) || left_[instr(left_, name) + length(name):] else left_ end,
             case when instr(left_, name) > 0 then list_concat(added, gives) else added end
      from step join names n on n.k = step.k + 1),
    done as (select query_id, text, list_filter(added, lambda x, i: list_position(added, x) = i)[:12] as added from step where k = (select max(k) from names))
    select query_id, trim(array_to_string(list_prepend(text, added), ' ')) as expanded from done""",
)
def expand_queries(spark, sf_dir):
    return asked(spark, EXPANDED).select("query_id", expand.Expander(GLOSSARY).column(F.col("text")).alias("expanded"))


ZH = {"z1": "怎么让角色走路", "z2": "角色", "z3": "plain walk"}


@query("expand_phrases", values([("z1", "怎么让角色走路 character pawn walk move"), ("z2", "角色 character pawn"), ("z3", "plain walk")], "query_id varchar, expanded varchar"))
def expand_phrases(spark, sf_dir):
    """Phrases serve queries with CJK characters; a longer phrase takes the place of a shorter one in it."""
    e = expand.Expander([{"topic": "c", "canonical": "character", "aliases": ["角色"], "identifiers": ["pawn"]}], [("走", ["step"]), ("走路", ["walk", "move"])])
    return asked(spark, ZH).select("query_id", e.column(F.col("text")).alias("expanded"))


# Release gates
METRICS = {"heldout_zh_recall_at_3": 0.9, "zh_gain": 0.25, "heldout_en_recall_at_3": 0.89, "en_gain": -0.01, "mrr_at_5_gain": 0.0, "heldout_passage_recall_at_3": 0.98, "natural_zh_recall_at_3": None, "hot_query_p95_s": 1.0, "cold_query_s": 14.9, "model_bytes_least": 90e6, "model_bytes_most": 90e6, "index_bytes": 3e7, "max_chunk_tokens": 384.0, "unbalanced_fences": 0.0}
FAILED = ("heldout_en_recall_at_3", "natural_zh_recall_at_3", "hot_query_p95_s", "index_bytes")


@query("release_gates", values([(g, v, g not in FAILED) for g, v in METRICS.items()], "gate varchar, value double, passed boolean"))
def release_gates(spark, sf_dir):
    return evaluate.gates(spark.createDataFrame([tuple(METRICS.values())], ", ".join(f"{g} double" for g in METRICS)), evaluate.RELEASE_GATES)


@query(
    "p95_of_all",
    """with r as (select value, row_number() over (order by value) as i, count(*) over () as n from events where value is not null),
    a as (select distinct 0.95 * (n + 1) as place, greatest(1, least(floor(0.95 * (n + 1)), n - 1)) as k from r)
    select round(lo.value + (hi.value - lo.value) * (place - k), 6) as quantile from a join r lo on lo.i = k join r hi on hi.i = k + 1""",
)
def p95_of_all(spark, sf_dir):
    return evaluate.exclusive_quantile(read(spark, sf_dir, "events"), "value", 0.95).select(F.round("quantile", 6).alias("quantile"))


def letters(texts: list[str]) -> list[list[float]]:
    """A stand-in for a model: how often e, a and n occur."""
    return [[float(t.count(c)) for c in "ean"] for t in texts]


@query(
    "model_embedding",
    """with c as (select doc_id, list_transform(['e', 'a', 'n'], lambda x: (length(text) - length(replace(text, x, '')))::double) as v from documents)
    select doc_id, list_transform(v, lambda x: round(x / greatest(sqrt(list_dot_product(v, v)), 1e-300), 6)) as v from c""",
)
def model_embedding(spark, sf_dir):
    """A model by Arrow batches; its dimension is found by asking it."""
    model = BatchEmbedder(letters, "letters")
    v = model.embed(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.transform(v, lambda x: F.round(x, 6)).alias("v"))


# Chunks of pages: sections of two levels, then windows.
@query(
    "chunk_pages",
    f"""with md as ({ORACLE_SQL['page_markdown']}),
    l as (select page_id, unnest(string_split(markdown, chr(10))) as line, generate_subscripts(string_split(markdown, chr(10)), 1) as n from md where markdown <> ''),
    h as (select *, regexp_extract(line, '^ {{0,3}}(#{{1,6}})[ \\t]+(.+?)[ \\t]*#*[ \\t]*$', 1) as marks, regexp_extract(line, '^ {{0,3}}(#{{1,6}})[ \\t]+(.+?)[ \\t]*#*[ \\t]*$', 2) as name from l),
    g as (select *, count(*) filter (marks <> '') over (partition by page_id order by n) - 1 as section from h),
    sec as (select page_id, section, min_by(marks, n) as marks, min_by(name, n) as name, trim(string_agg(line, chr(10) order by n), {SPACE_SET}) as body, trim(string_agg(case when marks = '' then line else '' end, '' order by n), {SPACE_SET}) <> '' as own from g group by page_id, section),
    path as (select *, case when length(marks) = 1 then name else first_value(name) over (partition by page_id order by section) || ' / ' || name end as heading, {_pieces('body')} as p from sec),
    w as (select *, len(p) as n, unnest(range(0, case when len(p) <= 384 then 1 else ceil((len(p) - 384) / 336.0)::int + 1 end)) as i from path where own),
    t as (select 'page/' || page_id || '.md' as source, heading, section, i, trim(array_to_string(p[i * 336 + 1:least(i * 336 + 384, n)], ''), {SPACE_SET}) as text from w)
    select sha256(source || chr(0) || heading || chr(0) || text) as id, text, source, heading, 'content' as type, section::int as section, (row_number() over (partition by source order by section, i) - 1)::int as pos from t""",
)
def chunk_pages(spark, sf_dir):
    pages = page_markdown(spark, sf_dir).filter("markdown <> ''")
    docs = pages.select(F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".md")).alias("source"), F.col("markdown").alias("text"))
    return chunk.chunk_documents(docs)


# A built index over the documents table
_BUILT: dict[tuple[str, str], Index] = {}


def built(spark: SparkSession, sf_dir: str) -> Index:
    """The index of a documents table, built once for each session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _BUILT:
        index = Index(spark, str(folder(spark) / "index"), glossary=GLOSSARY)
        docs = doc_sources(spark, sf_dir)
        hashes = docs.select("source", F.octet_length("text").alias("length"), F.sha2("text", 256).alias("hash"))
        index.build_documents(docs, sf_dir, lambda: files.fingerprint(hashes).first().fingerprint, repeats="first")
        _BUILT[key] = index
    return _BUILT[key]


def _buckets(rows: str, key: str) -> str:
    """Unit vectors of texts as (key, b, x): words between white space, in buckets by their MD5."""
    return f"""(select {key}, b, c / sqrt(sum(c * c) over (partition by {key})) as x from (
      select {key}, ('0x' || substr(md5(w), 1, 2))::int % 64 as b, count(*)::double as c from (select {key}, unnest(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ')) as w from {rows}) where w <> '' group by all))"""


def _index_hits(queries: str, profile: str, top: int) -> str:
    fused = {
        "hybrid": "select query_id, id, round(sum(1.0 / (60 + rank)), 12)::double as raw from (select query_id, id, rank from near where rank <= 30 union all select query_id, id, rank from lexical where rank <= 30) group by all",
        "vector": f"select query_id, id, score as raw from near where rank <= {top}",
    }[profile]
    head = f"""with {DOC_CHUNKS},
    glossary(topic, names) as (values {_GLOSSARY_SQL}),
    corpus as (select row_number() over (order by source, pos) as gpos, source, '前言' as heading, 'content' as type, text, sha256(source || chr(0) || '前言' || chr(0) || text) as id, concat_ws(' ', split_part(source, '/', 1), names) as topic_text
      from (select source, min(pos) as pos, text from chunks group by source, text) left join glossary on topic = split_part(source, '/', 1)),
    q0 as (select query_id, {_norm('text')} as text from {queries}),
    words as (select gpos, 3 as w, unnest({_terms('heading')}) as term from corpus union all select gpos, 2, unnest({_terms('topic_text')}) from corpus union all select gpos, 1, unnest({_terms('text')}) from corpus),
    tf as (select gpos, term, sum(w)::double as freq from words group by all),
    stats as (select gpos, sum(freq) as length from tf group by all),
    corp as (select count(*) as n_docs, avg(length) as avg_length from stats),
    dfs as (select term, count(*) as df from tf group by all),
    q as (select query_id, term, count(*) as qf from (select query_id, unnest({_terms('text')}) as term from q0) group by all),
    scored as (select query_id, gpos, round(sum(qf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * freq * 2.5 / (freq + 1.5 * (0.25 + 0.75 * length / avg_length))), 9) as score
      from q join tf using (term) join dfs using (term) join stats using (gpos), corp group by all),
    lexical as (select query_id, id, row_number() over (partition by query_id order by score desc, gpos) as rank from scored join corpus using (gpos)),
    cosines as (select b.query_id, a.id, round(greatest(0.0, least(1.0, sum(a.x * b.x))), 9) as score from {_buckets('corpus', 'id')} a join {_buckets('q0', 'query_id')} b using (b) group by all),
    near as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from cosines),
    fused as ({fused})"""
    if profile == "vector":
        return f"{head} select query_id, id, source, heading, type, round(raw, 6) as score, rank::int as rank from fused join corpus using (id) join near using (query_id, id)"
    return f"""{head},
    meta as (select f.query_id, f.id, source, heading, type, raw from fused f join corpus using (id)),
    first_ as (select *, first_value(raw) over (partition by query_id order by raw desc, id) as best, row_number() over (partition by query_id, source, heading order by raw desc, id) as nth from meta),
    hits as (select *, row_number() over (partition by query_id order by raw desc, id) as rank from first_ where nth = 1)
    select query_id, id, source, heading, type, round(raw / best, 4) as score, round(raw, 4) as raw_score, rank::int as rank from hits where rank <= {top}"""


ONE = {"q": "Primary feed of the onthe"}
ONE_EXPANDED = _values({"q": "primary feed of the onthe first source FeedZero src_zero"})


@query("index_search", _index_hits(ONE_EXPANDED, "hybrid", 5).replace(f"select query_id, {_norm('text')} as text from {ONE_EXPANDED}", f"select * from {ONE_EXPANDED}"))
def index_search(spark, sf_dir):
    """One query against the built index, as a client asks it: expanded, hybrid, best first."""
    return built(spark, sf_dir).search_texts(ONE, 5).drop("text")


@query("index_search_many", _index_hits(_values(MANY), "hybrid", 10))
def index_search_many(spark, sf_dir):
    return built(spark, sf_dir).search_texts(MANY, 10).drop("text")


@query("index_search_benchmark", _index_hits("(select item_id::varchar as query_id, text from benchmark)", "hybrid", 3))
def index_search_benchmark(spark, sf_dir):
    """All benchmark items against the built index in one plan."""
    return built(spark, sf_dir).search_many(read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text"), 3).drop("text")


@query("index_search_vector", _index_hits(_values({k: v for k, v in MANY.items() if k != "q4"}), "vector", 5))
def index_search_vector(spark, sf_dir):
    found = built(spark, sf_dir).search_many(asked(spark, {k: v for k, v in MANY.items() if k != "q4"}), 5, profile="vector")
    return found.select("query_id", "id", "source", "heading", "type", F.round("score", 6).alias("score"), "rank")


@query("index_tables", f"""with {DOC_CHUNKS} select (select count(*) from documents) as documents, (select count(distinct (source, text)) from chunks) as chunks, (select count(distinct source) from chunks) as sources, 64::bigint as dimension, true as current""")
def index_tables(spark, sf_dir):
    index = built(spark, sf_dir)
    chunks, postings, manifest = index.open()
    counted = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("source").alias("sources"), F.max(F.size("embedding")).cast("long").alias("dimension"))
    current = manifest["corpus"]["sha256"] == corpus_hash(spark, sf_dir)
    return counted.select(F.lit(manifest["corpus"]["documents"]).cast("long").alias("documents"), "chunks", "sources", "dimension", F.lit(current).alias("current"))


def corpus_hash(spark, sf_dir) -> str:
    docs = doc_sources(spark, sf_dir)
    return files.fingerprint(docs.select("source", F.octet_length("text").alias("length"), F.sha2("text", 256).alias("hash"))).first().fingerprint


#: Groupings of the evaluation: every combination that a report shows.
BY = ["split", "profile", "language"]
SETS = [[], ["split"], ["profile"], ["split", "profile"], ["profile", "language"], BY]
_ITEMS = "(select item_id::varchar as query_id, text from benchmark)"


@query(
    "profile_stats",
    f"""with h as (select 'hybrid' as profile, query_id, source, rank from ({_index_hits(_ITEMS, 'hybrid', 5)}) union all select 'vector', query_id, source, rank from ({_index_hits(_ITEMS, 'vector', 5)})),
    labels as (select b.item_id::varchar as query_id, d.source || '/' || d.doc_id || '.md' as source from documents d join benchmark b on b.text <> '' and contains(d.text, b.text)),
    asked as (select item_id::varchar as query_id, item_id % 2 as split, case when regexp_matches(text, '[^\\x00-\\x7f]') then 'other' else 'ascii' end as language, profile from benchmark, (values ('hybrid'), ('vector')) p(profile)),
    firsts as (select a.*, (select min(h.rank) from h join labels l using (query_id, source) where h.query_id = a.query_id and h.profile = a.profile) as first from asked a)
    select split, profile, language, grouping_id(split, profile, language)::int as level, count(*) as queries, round(avg((coalesce(first, 1000) <= 3)::int), 6) as recall,
      round(avg(case when first <= 5 then 1.0 / first else 0 end), 6) as mrr from firsts
    group by grouping sets ((), (split), (profile), (split, profile), (profile, language), (split, profile, language))""",
)
def profile_stats(spark, sf_dir):
    """Benchmark texts as queries in both profiles; relevant are chunks of documents that hold the text."""
    items = read(spark, sf_dir, "benchmark")
    queries = items.select(F.col("item_id").cast("string").alias("query_id"), "text")
    hits = [built(spark, sf_dir).search_many(queries, 5, profile=p).select(F.lit(p).alias("profile"), "query_id", "source", "rank") for p in ("hybrid", "vector")]
    matcher = patterns.build(items.select(F.col("text").alias("pattern")), scratch(spark))
    held = patterns.occurrences(read(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source"), "text"), matcher, "source")
    labels = held.join(queries.withColumnRenamed("text", "pattern"), "pattern").select("query_id", "source")
    firsts = hits[0].unionByName(hits[1]).join(labels, ["query_id", "source"], "left_semi").groupBy("query_id", "profile").agg(F.min("rank").alias("first"))
    language = F.when(T.is_ascii(F.col("text")), "ascii").otherwise("other")
    asked_ = items.select(F.col("item_id").cast("string").alias("query_id"), (F.col("item_id") % 2).alias("split"), language.alias("language"), F.explode(F.array(F.lit("hybrid"), F.lit("vector"))).alias("profile"))
    found = evaluate.grouped_stats(asked_.join(firsts, ["query_id", "profile"], "left"), BY, SETS)
    return found.select(*BY, "level", "queries", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


def _copied(index: Index) -> None:
    """The active snapshot once more, as a new one, and active."""
    old, new = index.store.current(), index.store.create()
    for table in ("chunks", *bm25.TABLES):
        shutil.copytree(old / table, new / table)
    index.store.write_manifest(new, index.store.manifest(old))
    index.store.activate(new)


@query("index_search_stream", _index_hits(_ITEMS, "hybrid", 3))
def index_search_stream(spark, sf_dir):
    """The hits of index_search_benchmark from a stream of three files of queries; another snapshot is active for the third."""
    served = Index(spark, built(spark, sf_dir).root, glossary=GLOSSARY)
    root = folder(spark)
    lines = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text", (F.col("item_id") % 3).alias("part"))
    for part in range(3):
        if part == 2:
            _copied(served)
        lines.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").json(str(root / "lines"))
        stream.search_stream(served, str(root / "lines"), str(root / "hits"), str(root / "state"), 3).awaitTermination()
    return spark.read.parquet(str(root / "hits")).drop("text", "batch", "generation")


_MARKDOWN = ORACLE_SQL["page_markdown"]


@query("markdown_sink", f"select page_id, sha256(markdown) as digest from ({_MARKDOWN}) where markdown <> ''")
def markdown_sink(spark, sf_dir):
    """One file for each page with a body, read back as files."""
    root = scratch(spark)
    sink.register(spark)
    pages = page_markdown(spark, sf_dir).filter("markdown <> ''")
    pages.select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("name"), F.col("markdown").alias("text")).write.format("markdown").mode("append").save(root)
    back = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_name").alias("name"), F.col("value"))
    return back.select(F.regexp_extract("name", r"(\d+)\.md$", 1).cast("long").alias("page_id"), F.sha2("value", 256).alias("digest"))


# An index that grows: an update of one that lacks a hundredth of the documents and has as many that are gone
_GROWN: dict[tuple[str, str], tuple[Segments, dict]] = {}


def grown(spark: SparkSession, sf_dir: str) -> tuple[Segments, dict]:
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _GROWN:
        docs, index = doc_sources(spark, sf_dir), Segments(spark, scratch(spark), glossary=GLOSSARY)
        number = F.regexp_extract("source", r"(\d+)\.md$", 1).cast("long")
        index.update(docs.filter(number % 100 != 7).unionByName(docs.filter(number % 100 == 9).withColumn("source", F.concat(F.lit("ghost/"), "source"))))
        _GROWN[key] = index, index.update(docs)
    return _GROWN[key]


@query("segments_search", _index_hits(_values(MANY), "hybrid", 10))
def segments_search(spark, sf_dir):
    """The hits of index_search_many, from an index that an update has brought to the same corpus."""
    return grown(spark, sf_dir)[0].search_many(asked(spark, MANY), 10).drop("text")


_OF = "regexp_extract(source, '(\\d+)\\.md$', 1)::bigint % 100"


@query(
    "segments_update",
    f"""with {DOC_CHUNKS}, n as (select {_OF} as of, count(distinct (source, text)) as n from chunks group by all)
    select (select count(*) from documents where text is not null and doc_id % 100 in (7, 9)) as documents,
      (select coalesce(sum(n), 0)::bigint from n where of = 7) as added, (select coalesce(sum(n), 0)::bigint from n where of = 9) as removed,
      (select coalesce(sum(n), 0)::bigint from n where of = 7) as embedded""",
)
def segments_update(spark, sf_dir):
    """What the update did, with the chunks that the new segments hold: no other chunk was embedded."""
    index, told = grown(spark, sf_dir)
    newest = [s["name"] for s in index.state()["segments"] if s["name"].startswith(f"seg-{told['generation']}-")]
    held = index._each(index.state(), "chunks", newest).filter(F.shiftright("pos", SHIFT) == told["generation"]).agg(F.count(F.lit(1)).alias("embedded"))
    return held.select(*(F.lit(told[c]).cast("long").alias(c) for c in ("documents", "added", "removed")), "embedded")


# Snapshots and server
LIFE = [
    (1, "no index", "INDEX_NOT_FOUND"),
    (2, "another file in the folder", "INDEX_SCHEMA_MISMATCH"),
    (3, "a path that is not ASCII", "INVALID_INDEX_PATH"),
    (4, "named but not complete", "INDEX_CORRUPT"),
    (5, "complete", "third"),
    (6, "kept", "second third"),
    (7, "a second lock", "INDEX_ERROR"),
    (8, "a stale lock", "replaced"),
    (9, "swept", "1"),
    (10, "an unreadable manifest", "INDEX_SCHEMA_MISMATCH"),
    (11, "another schema", "INDEX_SCHEMA_MISMATCH"),
    (12, "another embedder", "MODEL_UNAVAILABLE"),
]


def code_of(act) -> str:
    try:
        return act() or ""
    except IndexProblem as e:
        return e.code


@query("snapshot_lifecycle", values(LIFE, "step int, event varchar, outcome varchar"))
def snapshot_lifecycle(spark, sf_dir):
    """What an index folder answers in each state (driver-side: a few small files)."""
    root = folder(spark)
    store = Store(root / "index")
    out = [code_of(lambda: store.current().name)]
    (root / "other").mkdir()
    (root / "other" / "x").touch()
    out.append(code_of(lambda: Store(root / "other").current().name))
    out.append(code_of(lambda: require_ascii("/索引")))
    made = {}
    for name in ("first", "second", "third"):
        made[name] = store.create()
        store.write_manifest(made[name], {"schema_version": 2, "embedding": {"model": "other", "revision": None, "dimension": 64}})
        if name == "first":
            (store.root / "active").write_text(made[name].name)
            out.append(code_of(lambda: store.current().name))
        store.activate(made[name])
    names = {p.name: n for n, p in made.items()}
    out.append(names[store.current().name])
    store.retain(2)
    out.append(" ".join(names[p.name] for p in sorted(store.snapshots.iterdir())))
    with store.lock():
        out.append(code_of(lambda: store.lock().__enter__()))
        os.utime(store.root / "lock", (0, 0))
        with store.lock():
            out.append("replaced")
    bad = store.create()
    os.utime(bad / "state", (0, 0))
    out.append(str(len(store.sweep())))
    search = Index(spark, str(store.root), embedder=HashingEmbedder(32))
    other = code_of(lambda: search.open() and "")
    manifest = made["third"] / "manifest.json"
    manifest.write_text("{")
    out.append(code_of(lambda: store.current().name))
    manifest.write_text('{"schema_version": 1}')
    out.append(code_of(lambda: store.current().name))
    out.append(other)
    return spark.createDataFrame([(n, event, x) for (n, event, _), x in zip(LIFE, out, strict=True)], "step int, event string, outcome string")


CALLS = [
    ("initialize", {}, "protocolVersion", '"2024-11-05"'),
    ("ping", {}, None, "{}"),
    ("tools/list", {}, None, '["search", "info", "list_topics", "glossary"]'),
    ("tools/call", {"name": "list_topics"}, "structuredContent", '[{"topic": "swim", "canonical": "swimming", "aliases": ["游泳"]}]'),
    ("tools/call", {"name": "glossary", "arguments": {"topic": "none"}}, "isError", "true"),
    ("tools/call", {"name": "search", "arguments": {"query": "怎么游泳", "top_k": 1}}, "structuredContent", '["swim/SKILL.md"]'),
    ("tools/call", {"name": "search", "arguments": {"query": ""}}, "isError", "true"),
    ("tools/call", {"name": "info"}, "isError", "false"),
    ("resources/list", {}, "resources", '[{"uri": "spindrift://topic/swim", "name": "swimming", "mimeType": "text/markdown"}]'),
    ("resources/read", {"uri": "spindrift://topic/swim"}, "contents", '"# Swim\\nWater über alles.\\n"'),
    ("resources/read", {"uri": "spindrift://topic/../walk"}, "code", "-32602"),
    ("nothing", {}, "code", "-32601"),
]


@query("server_answers", values([(n, m, x) for n, (m, _, _, x) in enumerate(CALLS)], "call int, method varchar, answer varchar"))
def server_answers(spark, sf_dir):
    root = written(spark, TREE)
    index = Index(spark, str(folder(spark) / "index"), glossary=[{"topic": "swim", "canonical": "swimming", "aliases": ["游泳"], "identifiers": ["water"]}])
    index.build(root)
    server, rows = Server(index), []
    for n, (method, params, part, _) in enumerate(CALLS):
        answer = json.loads(server.answer(json.dumps({"jsonrpc": "2.0", "id": n, "method": method, "params": params})))
        found = answer.get("result", answer.get("error"))
        found = [t["name"] for t in found["tools"]] if method == "tools/list" else found if part is None else found[part]
        if part == "structuredContent" and params["name"] == "search":
            found = [h["source"] for h in found]
        if part == "contents":
            found = found[0]["text"]
        rows.append((n, method, json.dumps(found, ensure_ascii=False)))
    return spark.createDataFrame(rows, "call int, method string, answer string")


@query(
    "result_text",
    values([(1, "🔍 检索：walk"), (2, ""), (3, "[1] a.md › A / B (匹配度: 100.0%)"), (4, "    one two..."), (5, ""), (6, "[2] b.md › 前言 (匹配度: 51.2%)"), (7, f"    {'x' * 200}..."), (8, "")], "line int, text varchar"),
)
def result_text(spark, sf_dir):
    hits = [{"source": "a.md", "heading": "A / B", "score": 1.0, "text": "one\ntwo"}, {"source": "b.md", "heading": "前言", "score": 0.5124, "text": "x" * 300}]
    return spark.createDataFrame(list(enumerate(format_results(hits, "walk").split("\n"), 1)), "line int, text string")
