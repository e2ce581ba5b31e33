"""Corpus preparation: HTML blocks, Markdown pages, API comments, front matter, sanitising, privacy and quality gates."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_html, normalize, strip_tags, token_count
from . import patterns

# What the privacy scan and the publisher look for.
PRIVACY_PATTERNS: tuple[tuple[str, str], ...] = (
    ("windows user profile path", r"[A-Za-z]:[\\/]Users[\\/]"),
    ("drive-letter absolute path", r"\b[A-Za-z]:[\\/]"),
    ("unix absolute path", r"/(?:home|Users)/[^/]+"),
    ("agent persona line", r"(?i)^\s*You are an? .*expert.*$"),
    ("agent prompt line", r"(?i)^\s*Ask (?:which|the) .*$"),
    ("internal .agents read", r"\.agents/"),
)
GENERIC_EXAMPLES = ("~/Library/Application Support",)
DROP_LINES = (r"(?i)^You are an? .*expert.*$", r"(?i)^Ask the developer.*$", r"(?i)^Ask which area.*$", r"(?i)^Ask the user.*$")
DESCRIPTION_STARTS = (
    ("Use this skill when working with ", "Covers "),
    ("Use this skill when working on ", "Covers working on "),
    ("Use this skill when implementing ", "Covers implementing "),
    ("Use this skill when ", "Covers "),
)


def article(html: Column) -> Column:
    """From the first <article to the first </article> behind it, or to the end; empty without one."""
    at = F.locate("<article", html)
    rest = F.when(at > 0, F.substring(html, at, F.length(html))).otherwise("")
    return F.split_part(rest, F.lit("</article>"), F.lit(1))


def _blocks(html: Column, pattern: str, group: int, most: int) -> Column:
    found = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(group)), lambda x: clean_html(strip_tags(x)))
    return F.filter(found, lambda x: F.length(x) > most)


def paragraphs(html: Column) -> Column:
    return _blocks(article(html), r"(?s)<p[^>]*>(.*?)</p>", 1, 40)


def headings(html: Column) -> Column:
    return _blocks(html, r"(?s)<(h[1-6])[^>]*>(.*?)</\1>", 2, 5)


def html_blocks(html: Column) -> Column:
    """Paragraphs of the article, then descriptions, notes and headings of the page, each kind in page order."""
    described = F.filter(F.transform(F.regexp_extract_all(html, F.lit(r'description="([^"]+)"'), F.lit(1)), clean_html), lambda x: F.length(x) > 30)
    notes = F.transform(_blocks(html, r"(?s)block-callout-content[^>]*>(.*?)</div></div></block-callout>", 1, 30), lambda x: F.concat(F.lit("[Note] "), x))
    return F.concat(paragraphs(html), described, notes, F.transform(headings(html), lambda x: F.concat(F.lit("\n## "), x, F.lit("\n"))))


def page_markdown(html: Column, title: Column, url: Column) -> Column:
    """A Markdown document with title and origin; empty where the page has no blocks. No clock time, so it is reproducible."""
    body = F.regexp_replace(F.array_join(html_blocks(html), "\n"), r"^\s+|\s+$", "")
    return F.when(F.length(body) > 0, F.concat_ws("\n", F.concat(F.lit("# "), title), F.lit(""), F.concat(F.lit("> Crawled locally from "), url), F.lit(""), body)).otherwise("")


def crawl_stats(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages, fetched, failed (no HTML), written (some block), blocks, chars."""
    blocks = html_blocks(F.col(html))
    each = pages.select(F.col(html).isNotNull().alias("ok"), F.size(F.coalesce(blocks, F.array())).alias("n"), F.coalesce(F.length(F.array_join(blocks, "\n")), F.lit(0)).alias("c"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
    return each.agg(F.count(F.lit(1)).alias("pages"), n(F.col("ok"))("fetched"), n(~F.col("ok"))("failed"), n(F.col("n") > 0)("written"), n(F.col("n"))("blocks"), n(F.col("c"))("chars"))


def privacy_patterns(project_names: Iterable[str] = (), tool_paths: Iterable[str] = ()) -> tuple[tuple[str, str], ...]:
    """PRIVACY_PATTERNS and, of a user's own, names of private projects (whole words, any case) and paths of authors' tools."""
    own = (("private project name", [rf"\b{re.escape(n)}\b" for n in project_names]), ("author tooling path", [re.escape(p) for p in tool_paths]))
    return (*PRIVACY_PATTERNS, *((label, "(?i)" + "|".join(found)) for label, found in own if found))


def privacy_scan(docs: DataFrame, key: str, text: str = "text", patterns: Iterable[tuple[str, str]] = PRIVACY_PATTERNS, allowed: Iterable[str] = GENERIC_EXAMPLES, exempt: Column | None = None) -> DataFrame:
    """key, line, label, content (trimmed, 200 characters): a row for each line and pattern that it matches.

    Lines with an allowed example are passed over, and so are lines of documents that `exempt` marks and that name .agents/.
    """
    rows = docs.withColumn("_exempt", exempt if exempt is not None else F.lit(False))
    split = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n")
    lines = rows.select(key, "_exempt", F.posexplode(split).alias("line", "content"))
    for example in allowed:
        lines = lines.filter(~F.col("content").contains(example))
    lines = lines.filter(~(F.col("_exempt") & F.col("content").contains(".agents/")))
    labels = F.array(*(F.when(F.col("content").rlike(p), F.lit(label)) for label, p in patterns))
    found = lines.select(key, (F.col("line") + 1).alias("line"), F.explode(F.array_compact(labels)).alias("label"), "content")
    return found.select(key, "line", "label", F.substring(F.trim("content"), 1, 200).alias("content"))


def sanitized(text: Column, keep_agents: Column | bool = False) -> Column:
    """Without the lines of DROP_LINES and, unless kept, those that name .agents/; one line feed at the end."""
    keep = keep_agents if isinstance(keep_agents, Column) else F.lit(keep_agents)
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")
    body = F.array_join(F.filter(lines, lambda x: _good(x, keep)), "\n")
    return F.concat(F.regexp_replace(body, "\n+$", ""), F.lit("\n"))


def _good(x: Column, keep: Column) -> Column:
    out = keep | ~x.contains(".agents/")
    for p in DROP_LINES:
        out = out & ~x.rlike(p)
    return out


def front_matter(text: str) -> tuple[dict[str, str | None], str]:
    """title, description and tags of a leading block between --- lines, and the text behind it."""
    fields: dict[str, str | None] = {"title": None, "description": None, "tags": None}
    lines = text.replace("\r\n", "\n").split("\n")
    if lines[0].strip() != "---":
        return fields, "\n".join(lines)
    last = next((i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), None)
    block = lines[1:last] if last else lines[1:]
    # Keys of the first column own the indented lines below them.
    owned: list[tuple[str, list[str]]] = []
    for line in block:
        if line[:1] in (" ", "\t") and owned:
            owned[-1][1].append(line)
        else:
            owned.append((line.strip(), []))
    for head, inner in owned:
        if head.startswith("name:"):
            fields["title"] = head.removeprefix("name:").strip()
        elif head == "description: >-":
            fields["description"] = " ".join(x.strip() for x in inner)
        elif head.startswith("description:"):
            fields["description"] = head.removeprefix("description:").strip()
        elif head == "metadata:":
            tags = (re.fullmatch(r"\s+tags:\s*(\[.*\])", x) for x in inner)
            fields["tags"] = next((m[1] for m in tags if m), fields["tags"])
    return fields, "\n".join(lines[last + 1 :] if last else lines[1:])


def rewritten_description(text: str) -> str:
    x = text[1:-1] if len(text) > 1 and text[0] == text[-1] == '"' else text
    return next((new + x[len(old) :] for old, new in DESCRIPTION_STARTS if x.startswith(old)), x)


def published_head(text: str) -> str:
    fields, _ = front_matter(text)
    own = [("title", fields["title"]), ("description", rewritten_description(fields["description"]) if fields["description"] else None), ("tags", fields["tags"])]
    return "\n".join(["---", *(f"{k}: {v}" for k, v in own if v), "---"])


def publish(docs: DataFrame, excluded: Iterable[str] = (), topics: Iterable[str] | None = None, keep_agents: Iterable[str] = ()) -> DataFrame:
    """source, text of documents (source, text) as published: SKILL.md files with a rebuilt head, others sanitised alone.

    Excluded topics, and topics outside `topics` if given, are left out.
    """
    topic = F.split_part("source", F.lit("/"), F.lit(1))
    rows = docs.filter(~topic.isin(*excluded)) if (excluded := list(excluded)) else docs
    rows = rows.filter(topic.isin(*topics)) if topics else rows

    def heads(batches):
        for b in batches:
            text = b.column("text").to_pylist()
            both = [(published_head(t), front_matter(t)[1]) if s.split("/")[-1] == "SKILL.md" else (None, t) for s, t in zip(b.column("source").to_pylist(), text, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("source"), pa.array([h for h, _ in both], pa.string()), pa.array([t for _, t in both], pa.string())], names=["source", "head", "body"])

    keep = topic.isin(*keep_agents) if (keep_agents := list(keep_agents)) else F.lit(False)
    split = rows.filter("text is not null").select("source", "text").mapInArrow(heads, "source string, head string, body string")
    return split.select("source", F.concat_ws("\n", "head", sanitized(F.col("body"), keep & F.col("head").isNotNull())).alias("text"))


def dictionary_empties(phrases: DataFrame) -> DataFrame:
    """phrase of the rows (phrase, concepts) that have no concept, or only blank ones."""
    return phrases.filter(~F.exists(F.coalesce("concepts", F.array().cast("array<string>")), lambda c: F.trim(c) != "")).select("phrase")


#: Concepts that travel to the documents at once.
CONCEPT_BLOCK = 10_000


def dictionary_grounding(docs: DataFrame, concepts: DataFrame, text: str = "text") -> DataFrame:
    """concept, grounded: whether the normalised concept occurs in a normalised document. Concepts (concept) are counted and
    travel to the documents in blocks of bounded size; each task reports each concept once."""
    blocks = -(-concepts.count() // CONCEPT_BLOCK) or 1
    texts, seen = docs.select(normalize(F.col(text)).alias("_t")), None
    for i in range(blocks):
        own = concepts.filter(F.pmod(F.xxhash64("concept"), F.lit(blocks)) == i).agg(F.sort_array(F.collect_set("concept")).alias("_concepts"))  # one block
        pairs = texts.crossJoin(F.broadcast(own))
        found = pairs.select(F.explode(F.filter("_concepts", lambda c: F.col("_t").contains(normalize(c, False)))).alias("concept")).distinct()
        seen = found if seen is None else seen.unionByName(found)
    return concepts.select("concept").distinct().join(seen.withColumn("_s", F.lit(True)), "concept", "left").select("concept", F.coalesce("_s", F.lit(False)).alias("grounded"))


def grounded(docs: DataFrame, concepts: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The same for any number of concepts: automata and tables of the normalised ones are written below a shared folder, and
    each distinct text passes each once. A concept of which normalising leaves nothing is in every text."""
    concepts.select("concept").distinct().withColumn("pattern", normalize(F.col("concept"))).write.parquet(f"{path}/concepts")
    named = docs.sparkSession.read.parquet(f"{path}/concepts")
    texts = docs.select(F.col(text).alias("text")).distinct().select(normalize(F.col("text")).alias("text"))
    found = patterns.present(texts, patterns.build(named, path, windows=True))
    some = not docs.filter(F.col(text).isNotNull()).isEmpty()
    hit = F.coalesce(F.col("_found"), F.lit(False)) | ((F.col("pattern") == "") & F.lit(some))
    return named.join(found.withColumn("_found", F.lit(True)), "pattern", "left").select("concept", F.coalesce(hit, F.lit(False)).alias("grounded"))


def unbalanced_fences(text: Column) -> Column:
    """Whether the lines that open or close code fences leave one open."""
    marks = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*(`{3,}|~{3,})")), lambda x: F.regexp_extract(x, r"^\s*(`{3,}|~{3,})", 1))
    step = lambda acc, m: F.when(acc == "", m).when((F.substring(acc, 1, 1) == F.substring(m, 1, 1)) & (F.length(m) >= F.length(acc)), F.lit("")).otherwise(acc)
    return F.aggregate(marks, F.lit(""), step) != ""


def chunk_quality(chunks: DataFrame, limit: int = 384) -> DataFrame:
    """chunks, ids (distinct), max_tokens, over_limit, unbalanced."""
    n = token_count(F.col("text"))
    each = chunks.select("id", n.alias("n"), unbalanced_fences(F.col("text")).alias("u"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return each.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("id").alias("ids"), F.max("n").cast("long").alias("max_tokens"), count(F.col("n") > limit).alias("over_limit"), count(F.col("u")).alias("unbalanced"))


def fence_gates(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, broken_fences (one backtick and a language), lone_backticks, agent_reads, persona_lines, fences of each document."""
    lines = F.split(F.col(text), "\n")
    count = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p))).cast("long")
    return docs.select(
        key,
        count(r"^`[A-Za-z]+\s*$").alias("broken_fences"),
        count(r"^`\s*$").alias("lone_backticks"),
        count(r"\.agents/").alias("agent_reads"),
        count(r"(?i)^\s*You are an? .*expert").alias("persona_lines"),
        count(r"^\s*(```|~~~)").alias("fences"),
    )


def fence_parity(published: DataFrame, sources: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, published, source, state of documents whose numbers of fence lines differ, or that only one side has."""
    left, right = (fence_gates(d, key, text).select(key, F.col("fences").alias(n)) for d, n in ((published, "published"), (sources, "source")))
    state = F.when(F.col("source").isNull(), "extra").when(F.col("published").isNull(), "missing").when(F.col("published") != F.col("source"), "different")
    return left.join(right, key, "full").withColumn("state", state).filter("state is not null")


# API comments of C++ headers.
MACROS = ("UCLASS", "USTRUCT", "UENUM", "UINTERFACE", "UFUNCTION", "UPROPERTY")
TYPE_DECLARATION = re.compile(r"(class|struct|enum\s+class|enum)\s+(\w+)(\s*:\s*[^{]+)?\s*\{")
FUNCTION = re.compile(r"(?:UE_API\s+)?(void|bool|int32|float|FName|FString|UClass\s*\*|AActor\s*\*|APlayerController\s*\*|F\w+)\s+(\w+)\s*\(")
ACCESS = re.compile(r"(?:public|private|protected)\s*:\s*")
COMMENT = re.compile(r"/\*\*(.*?)\*/", re.S)
BLANK = re.compile(r"\s*")
PARENS = re.compile(r"[()]")


def _behind_macros(text: str, at: int) -> int:
    """Place of the declaration behind a comment: macros with balanced parentheses and one access specifier are passed over."""
    at = BLANK.match(text, at).end()
    while text.startswith(MACROS, at):
        depth = 0
        for m in PARENS.finditer(text, at):
            depth += 1 if m[0] == "(" else -1
            if depth <= 0:
                at = BLANK.match(text, m.end()).end()
                break
        else:
            return len(text)
    m = ACCESS.match(text, at)
    return m.end() if m else at


def api_docs(path: str, text: str) -> Iterable[dict]:
    """Entries of one header: documented types, functions, and overviews (comments of over 500 characters before neither)."""
    for n, comment in enumerate(COMMENT.finditer(text)):
        raw = comment[1].strip()
        if len(raw) < 20:
            continue
        lines = [x for x in (re.sub(r"^\s*\*\s?", "", y).strip() for y in raw.split("\n")) if x]
        doc, at = " ".join(lines), _behind_macros(text, comment.end())
        common = {"source": f"engine-source/{path}"}
        if m := TYPE_DECLARATION.match(text, at):
            head = [f"[{m[1]} {m[2]}]", *([f"Base: {m[3].strip()}"] if m[3] else []), "", doc]
            yield common | {"text": "\n".join(head), "heading": m[2], "doc_type": m[1], "id": f"gas:{path}:{m[2]}:{n}"}
        elif m := FUNCTION.match(text, at):
            yield common | {"text": f"[function] {m[1]} {m[2]}()\n\n{doc}", "heading": f"{m[2]}()", "doc_type": "function", "id": f"gas:{path}:func:{m[2]}:{n}"}
        elif len(raw) > 500:
            yield common | {"text": doc, "heading": lines[0][:60] if lines else "System Overview", "doc_type": "overview", "id": f"gas:{path}:system:{n}"}


API_DOC = pa.schema([(c, pa.string()) for c in ("id", "source", "heading", "doc_type", "text")])


def extract_api_docs(headers: DataFrame) -> DataFrame:
    """id, source, heading, doc_type, text of headers (path, text)."""

    def run(batches):
        for b in batches:
            rows = [d for p, t in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True) for d in api_docs(p, t or "")]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=API_DOC)

    return headers.select("path", "text").mapInArrow(run, "id string, source string, heading string, doc_type string, text string")
