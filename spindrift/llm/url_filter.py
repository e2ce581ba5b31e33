"""URL filters: a sort-merge range join of reversed-host keys with prefix rules.

A canonical key writes the labels of a host in reverse, each followed by a dot ("www.example.net" gives
"net.example.www."), so a rule's host covers the interval of keys that start with the rule's key: itself and all
subdomains. URLs are sorted by (key, path), rules by (key, path); one sweep over both keeps the stack of the rules whose
interval is open. The path prefixes of a host's rules are nested intervals of its own paths, searched by bisection, and
the longest rule of all open hosts decides.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

Rule = tuple[str, str, str]  # verdict, host, path

#: (verdict, host, path)
DEFAULT_RULES: tuple[Rule, ...] = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def host_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


class Paths:
    """The path prefixes of one host's rules, sorted, each with the longest other one that it starts with: nested intervals."""

    def __init__(self, rules: list[tuple[str, int]]):
        first: dict[str, int] = {}
        for path, rule in rules:
            first[path] = min(rule, first.get(path, rule))
        self.paths = sorted(first)
        self.rules = [first[p] for p in self.paths]
        self.outer: list[int] = []
        open_: list[int] = []
        for i, path in enumerate(self.paths):
            while open_ and not path.startswith(self.paths[open_[-1]]):
                open_.pop()
            self.outer.append(open_[-1] if open_ else -1)
            open_.append(i)

    def longest(self, path: str) -> int:
        """The rule of the longest prefix of a path, or -1. All prefixes of it enclose the last entry that is not behind it."""
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.outer[i]
        return self.rules[i] if i >= 0 else -1


def prepared(rules: Sequence[Rule]) -> list[tuple[str, Paths]]:
    """The rules' host keys in order, each with its paths."""
    by_host: dict[str, list[tuple[str, int]]] = {}
    for r, (_, host, path) in enumerate(rules):
        by_host.setdefault(host_key(host), []).append((path, r))
    return [(k, Paths(by_host[k])) for k in sorted(by_host)]


def sweep(urls: Sequence[tuple[str, str]], rules: Sequence[Rule], starts: list[tuple[str, Paths]] | None = None) -> list[int]:
    """For each (host, path) the index of the longest rule that fits, or -1; starts: prepared(rules), if that is there already.

    Longest: most characters of host and path together, then of the host, then the first in the list. The stack holds the
    hosts whose intervals are open, at most one for each label; each is asked for its longest path prefix.
    """
    starts = prepared(rules) if starts is None else starts
    keys = [host_key(h) for h, _ in urls]
    order = sorted(range(len(urls)), key=lambda i: (keys[i], urls[i][1]))
    found = [-1] * len(urls)
    stack: list[tuple[str, Paths]] = []  # open intervals, the innermost last
    nxt, last = 0, None
    for i in order:
        key, path = keys[i], urls[i][1]
        if key != last:
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            while nxt < len(starts) and starts[nxt][0] <= key:
                if key.startswith(starts[nxt][0]):  # else its interval closed before this key
                    stack.append(starts[nxt])
                nxt += 1
            last = key
        fits = [r for _, own in stack if (r := own.longest(path)) >= 0]
        found[i] = max(fits, key=lambda r: (len(rules[r][1]) + len(rules[r][2]), len(rules[r][1]), -r), default=-1)
    return found


def rule_blocks(rules: Iterable[Rule], block_bytes: int) -> list[list[Rule]]:
    blocks, size = [[]], 0
    for rule in rules:
        size += sum(map(len, rule)) + 200
        if size > block_bytes and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append(tuple(rule))
    return blocks


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    default_verdict: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
    block_bytes: int = 32 << 20,
) -> DataFrame:
    """Judges every URL; returns id_col, host, path, rule, verdict, one row per input row.

    The rules travel with the tasks in blocks of at most block_bytes; a longer list is swept block after block, and the
    longest of the blocks' finds stays, so its size has no limit and no page is shuffled: a hot host costs nothing.
    Null url or none with "://": host and path are empty, rule null, default verdict. Null ids, repeated rows and ties
    are kept row by row. An empty table gives an empty result.
    """
    out_id = pages.schema[id_col].dataType
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    cut = F.instr(url, "://")
    rest = F.when(cut > 0, url.substr(cut + 3, F.length(url))).otherwise(F.lit(""))
    parsed = pages.select(
        F.col(id_col).alias("id"),
        ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    blocks = rule_blocks(rules, block_bytes) if rules else []

    def judge(batches, rules=None, base=0):
        starts = prepared(rules)
        for b in batches:
            urls = list(zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True))
            best = sweep(urls, rules, starts)
            hits = [None if r < 0 else f"{rules[r][1]}{rules[r][2]}" for r in best]
            verdicts = [None if r < 0 else rules[r][0] for r in best]
            hosts = [-1 if r < 0 else len(rules[r][1]) for r in best]
            if base:  # an earlier block may have found a longer rule
                old = b.select(["rule", "verdict", "rule_host"]).to_pylist()
                for i, o in enumerate(old):
                    if o["rule"] is not None and (len(o["rule"]), o["rule_host"]) >= (len(hits[i] or ""), hosts[i]):
                        hits[i], verdicts[i], hosts[i] = o["rule"], o["verdict"], o["rule_host"]
            own = [b.column("id"), b.column("host"), b.column("path"), pa.array(hits, pa.string()), pa.array(verdicts, pa.string()), pa.array(hosts, pa.int32())]
            yield pa.RecordBatch.from_arrays(own, names=["id", "host", "path", "rule", "verdict", "rule_host"])

    schema = f"id {out_id.simpleString()}, host string, path string, rule string, verdict string, rule_host int"
    judged = parsed
    for k, block in enumerate(blocks):
        judged = judged.mapInArrow(lambda it, block=block, k=k: judge(it, block, k), schema)
    if not blocks:
        judged = parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default_verdict)).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


OP9_SQL = """
with p as (
  select page_id, case when instr(coalesce(url,''),'://') > 0 then substr(url, instr(url,'://') + 3) else '' end as rest from pages),
q as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
r as (
  select * from (values ('block','net','/'),('allow','example.net','/en/'),('block','example.com','/de/'),('allow','org','/fr/')) t(v,h,p)),
m as (
  select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as verdict
  from q join r on (q.host = r.h or suffix(q.host, '.' || r.h)) and starts_with(q.path, r.p) group by page_id)
select q.page_id, q.host, q.path, m.rule, coalesce(m.verdict, 'allow') as verdict from q left join m using (page_id)
"""
