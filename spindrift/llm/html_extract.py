"""Main text of HTML pages by wrapper induction.

The element trees of a host's pages are aligned by simple tree matching into one wrapper: a tree whose slots know on how
many pages they occur and whether their text differs between pages. Slots whose text never changes are template, varying
slots are content; the part that holds the varying text is the article. Tags and roles that mean menus, forms and the like
are template from the start. Class names only settle what alignment leaves open: a part that holds nearly all varying text, or
a page's title, is never template by its name. Every task adds up its pages by skeleton (the labels of their trees), sums by skeleton
are merged by host in three steps and always in the same order, so a wrapper depends on the pages alone, not on how they are
dealt. Extraction aligns each page with the finished wrapper of its host. A page's HTML never leaves its task.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import OrderedDict
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, by_bytes, filesystem, materialize, resident, shared_dir, table, text_of, write_file

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An open element of the value's tags ends where the key's tag starts.
ENDS = {
    **{t: ("p",) for t in BLOCK - {"td", "th", "tr", "li", "dd", "dt", "tbody", "thead", "tfoot", "body", "html"}},
    "li": ("li", "p"),
    "dt": ("dt", "dd", "p"),
    "dd": ("dt", "dd", "p"),
    "tr": ("tr", "td", "th", "p"),
    "td": ("td", "th", "p"),
    "th": ("td", "th", "p"),
    "tbody": ("thead", "tbody", "tr", "td", "th", "p"),
    "option": ("option",),
}
#: An end by ENDS or by a closing tag does not reach beyond these.
FENCE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",)}
#: Elements that come in runs of any length; a run is one slot.
RUNS = frozenset("p li tr td th dt dd h2 h3 h4 h5 h6 pre blockquote figure".split())
#: Texts whose slot stays content even if it is the same on all pages.
TEXTUAL = frozenset("p li h1 h2 h3 h4 h5 h6 pre blockquote td th tr dd dt figure figcaption article main body html".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form button select input dialog menu head script style noscript iframe textarea template svg object".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
def _named(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I | re.A)


#: Names of parts that are no content, where alignment does not tell otherwise; each kind with the mark that its labels get.
SUSPECT_NAMES = (
    ("#", _named("comments?|replies|respond|disqus")),
    (
        "!",
        _named(
            "nav|navbar|navigation|menu|footer|sidebar|aside|ads?|advert|advertisement|sponsor(?:ed)?|promo|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|"
            "share|sharing|social|related|recommended|breadcrumbs?|newsletter|subscribe|signup|login|search|pagination|pager|toolbar|skip|widget"
        ),
    ),
    ("^", _named("header|masthead|topbar|banner")),
)
MARKS = "#!^"
MAIN = frozenset(("article", "main"))
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
UNQUOTED = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Block elements nested deeper than this are put on the last level; template elements are told on any level.
DEPTH = 200
#: A run of more siblings of one structure is a list: one slot.
LIST = 12


class Node:
    __slots__ = ("tag", "label", "drop", "kids")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.kids = tag, []
        self.label, self.drop = tag, tag in BOILERPLATE_TAGS
        if attributes and attributes.strip("/ "):
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
            name = found.get("class", "").split()
            if name:
                self.label = f"{tag}.{re.sub(r'[0-9]+', '', name[0].lower()).rstrip(MARKS)}"
            if tag not in MAIN and tag not in ("body", "html"):
                named = f"{found.get('class', '')} {found.get('id', '')}"
                self.label += next((mark for mark, names in SUSPECT_NAMES if names.search(named)), "") if named.strip() else ""
                self.drop = self.drop or found.get("role", "").lower() in BOILERPLATE_ROLES
                self.drop = self.drop or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")


class Tags:
    """Cuts a page into texts and tags in one pass: what follows nowhere (a >, a quote) is not looked for again."""

    def __init__(self, source: str):
        self.source = source
        self.last = {c: source.rfind(c) for c in (">", '"', "'")}
        self.quotes = True  # until a tag proves to have an odd quote

    def _end_of_tag(self, at: int) -> int:
        """Place of the > that ends a tag whose attributes start at a place; quoted ones don't count, as long as quotes match."""
        source, here = self.source, at
        while self.quotes:
            here = UNQUOTED.match(source, here).end()
            if here == len(source):
                self.quotes = False
            elif source[here] == ">":
                return here
            elif self.last[source[here]] > here:
                here = source.index(source[here], here + 1) + 1
            else:
                self.quotes = False
        return source.index(">", at)

    def raw_end(self, tag: str, at: int) -> int:
        m = re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A).search(self.source, at)
        return m.start() if m else len(self.source)

    def next(self, at: int) -> tuple[int, int, str, str]:
        """The next tag from a place on: where it starts and ends, its name (with / if it closes, "" for what only goes) and
        attributes; (-1, ...) without one."""
        source, here = self.source, at
        while (here := source.find("<", here)) >= 0:
            if source.startswith("<!--", here):
                end = source.find("-->", here + 4)
                return here, len(source) if end < 0 else end + 3, "", ""
            if self.last[">"] < here:
                break
            if source[here + 1] in "!?":
                return here, source.index(">", here) + 1, "", ""
            if m := NAME.match(source, here + 1):
                end = self._end_of_tag(m.end())
                return here, end + 1, m[0].lower(), source[m.end() : end]
            if source[here + 1] == "/" and (m := NAME.match(source, here + 2)):
                return here, source.index(">", m.end()) + 1, "/" + m[0].lower(), ""
            here += 1
        return -1, len(source), "", ""


def parse(source: str) -> Node:
    """The tree of a page's blocks and of elements that may be template. Other elements' text belongs to the block around."""
    root = Node("html")
    stack, at = [root], 0
    inside: dict[str, int] | None = None  # open tags inside a template element, whose content does not matter
    tags = Tags(source)

    def close(names, fence=()):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                return True
            if stack[i].tag in fence:
                return False
        return False

    while True:
        start, end, tag, attributes = tags.next(at)
        if inside is None and (text := source[at : start if start >= 0 else len(source)]):
            stack[-1].kids.append(text)
        if start < 0:
            return root
        at = end
        if not tag or tag == "html":
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if inside and inside.get(tag):
                inside[tag] -= 1
            elif tag not in ("html", "body") and close((tag,), FENCE.get(tag, ())):
                inside = None
            continue
        if tag in RAW:
            at = tags.raw_end(tag, at)
        if inside is not None:
            if tag not in VOID:
                inside[tag] = inside.get(tag, 0) + 1
            continue
        if tag == "br":
            stack[-1].kids.append(" ")
            continue
        for _ in range(3):
            if not (tag in ENDS and close(ENDS[tag], FENCE.get(tag, ("table", "li", "td", "th", "div", "section", "article", "blockquote", "button") if tag not in ("td", "th") else ("table",)))):
                break
        node = Node(tag, attributes)
        if transparent(node):
            continue
        stack[-1].kids.append(node)
        if tag not in VOID and tag not in RAW and (node.drop or len(stack) < DEPTH) and not (attributes.endswith("/") and tag not in BLOCK):
            stack.append(node)
            inside = {} if node.drop else None


def transparent(node: Node) -> bool:
    """Elements whose text belongs to the block around them."""
    return node.tag not in BLOCK and node.tag not in RAW and not node.drop and node.label[-1] not in MARKS


class Slot:
    """A node of a wrapper, or of a page that is to be aligned with one."""

    __slots__ = ("label", "pages", "texts", "chars", "kids", "nodes")

    def __init__(self, label: str, pages: int = 1, texts=frozenset(), chars: int = 0, kids=None, nodes=None):
        self.label, self.pages, self.texts, self.chars = label, pages, texts, chars
        self.kids, self.nodes = kids if kids is not None else [], nodes

    def walk(self):
        yield self
        for k in self.kids:
            yield from k.walk()

    def pack(self) -> list:
        return [self.label, self.pages, None if self.texts is None else sorted(self.texts), self.chars, [k.pack() for k in self.kids]]

    @classmethod
    def unpack(cls, x: list) -> Slot:
        return cls(x[0], x[1], None if x[2] is None else frozenset(x[2]), x[3], [cls.unpack(k) for k in x[4]])


#: Different texts that a slot tells apart; more are "many" (None). Decisions ask for one, for more, and for three at least.
FEW = 3


def both(a: frozenset | None, b: frozenset | None) -> frozenset | None:
    if a is None or b is None:
        return None
    out = a | b
    return out if len(out) <= FEW else None


def page_tree(node: Node) -> Slot:
    """A page's tree for alignment; runs of like elements are one slot."""
    runs: list[list[Slot]] = []
    for k in node.kids:
        if isinstance(k, str):
            continue
        slot = page_tree(k) if not k.drop else Slot(k.label, 1, frozenset((0,)), 0, [], [k])
        if runs and runs[-1][0].label == slot.label and (k.tag in RUNS or "." in k.label or k.drop):
            runs[-1].append(slot)
        else:
            runs.append([slot])
    kids = [merge_run(run) for run in runs]
    text = " ".join("".join(k for k in node.kids if isinstance(k, str)).split())
    return Slot(node.label, 1, frozenset((zlib.crc32(text.encode()),)) if text else frozenset(), len(text), lists_folded(kids), [node])


def merge_run(run: list[Slot]) -> Slot:
    out = run[0]
    for slot in run[1:]:
        out = merge(out, slot, same_page=True)
    return out


def lists_folded(kids: list[Slot]) -> list[Slot]:
    """Runs of more than LIST siblings of one structure are one slot."""
    if len(kids) <= LIST:
        return kids
    out: list[Slot] = []
    for _, run in groupby(kids, skeleton):
        run = list(run)
        out += [merge_run(run)] if len(run) > LIST else run
    return out


def alike(a: list[Slot], b: list[Slot]) -> bool:
    """Lists of one row of labels of which one has no children at all: their best matching is one to one."""
    return len(a) == len(b) and all(x.label == y.label for x, y in zip(a, b, strict=True)) and not (any(x.kids for x in a) and any(y.kids for y in b))


def same(x: Slot, y: Slot) -> bool:
    return x.label == y.label and len(x.kids) == len(y.kids) and all(map(same, x.kids, y.kids))


#: Cells up to which a table is filled one by one, by Python; larger ones are filled by rows. Both give a best matching.
CELLS = 1 << 16
#: Bytes of rows of a table, and of weights, that are kept at once, and pairs of trees whose weight is; others are computed again.
KEPT, MEMO = 32 << 20, 250_000
#: Lost nodes are counted up to the length of the other list, divided by this.
FEWER = 8


def settled(a: list[Slot], b: list[Slot]) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Pairs of like siblings at the start and end, which are in some best matching, and the places between, of labels that both
    lists have there."""
    pairs, i, j = [], list(range(len(a))), list(range(len(b)))
    while True:
        lo, most = 0, min(len(i), len(j))
        while lo < most and same(a[i[lo]], b[j[lo]]):
            lo += 1
        end = 0
        while end < most - lo and same(a[i[-1 - end]], b[j[-1 - end]]):
            end += 1
        pairs += [*zip(i[:lo], j[:lo]), *zip(i[len(i) - end :], j[len(j) - end :])]
        i, j = i[lo : len(i) - end], j[lo : len(j) - end]
        labels = {a[x].label for x in i} & {b[y].label for y in j}
        known = len(i) + len(j)
        i, j = [x for x in i if a[x].label in labels], [y for y in j if b[y].label in labels]
        if len(i) + len(j) == known or not i:
            return pairs, i, j


def most_labels(a: list[Slot], b: list[Slot]) -> int:
    """Nodes of the best matching of two lists of which one has no children at all: the longest common subsequence of labels, by
    the bits of a number where a row of the table grows."""
    places: dict[str, int] = {}
    for j, y in enumerate(b):
        places[y.label] = places.get(y.label, 0) | 1 << j
    every = stays = (1 << len(b)) - 1
    for x in a:
        grows = stays & places.get(x.label, 0)
        stays = (stays + grows | stays - grows) & every
    return len(b) - stays.bit_count()


def weight(x: Slot, y: Slot, memo: dict) -> int:
    """Nodes of the best matching of two trees; memo holds those of pairs of trees that are there as long as it."""
    if x.label != y.label:
        return 0
    if not (x.kids and y.kids):
        return 1
    key = id(x), id(y)
    if key not in memo:
        if not (any(k.kids for k in x.kids) and any(k.kids for k in y.kids)):
            nodes = 1 + most_labels(x.kids, y.kids)
        else:
            pairs, i, j = settled(x.kids, y.kids)
            nodes = 1 + sum(nodes_of(x.kids[p]) for p, _ in pairs) + most_nodes([x.kids[p] for p in i], [y.kids[p] for p in j], memo)
        if len(memo) >= MEMO:
            memo.clear()
        memo[key] = nodes
        return nodes
    return memo[key]


def cells(a: list[Slot], b: list[Slot], memo: dict) -> list[list[int]]:
    """For each i and j, nodes of the best matching of the first i of a list with the first j of another."""
    rows = [[0] * (len(b) + 1)]
    for x in a:
        above, row = rows[-1], [0]
        for j, y in enumerate(b):
            row.append(max(above[j + 1], row[j], above[j] + weight(x, y, memo)))
        rows.append(row)
    return rows


def weights_of(a: list[Slot], b: list[Slot], memo: dict):
    """Gives the weights of a's place i with all of b, and the structures of a, by numbers; those of one have the same weights."""
    kinds: dict[str, int] = {}
    own, other = ([kinds.setdefault(skeleton(x), len(kinds)) for x in slots] for slots in (a, b))
    places, firsts = np.array(other), dict(zip(own[::-1], a[::-1]))
    by_label: dict[str, dict[int, Slot]] = {}
    for k, y in zip(other, b, strict=True):
        by_label.setdefault(y.label, {}).setdefault(k, y)
    held: OrderedDict[int, np.ndarray] = OrderedDict()

    def row(i: int) -> np.ndarray:
        k = own[i]
        if k not in held:
            known = np.zeros(len(kinds), np.int32)
            for kind, y in by_label.get(a[i].label, {}).items():
                known[kind] = weight(firsts[k], y, memo)
            held[k] = known[places]
            while len(held) > 1 and len(held) * held[k].nbytes > KEPT:
                held.popitem(last=False)
        return held[k]

    for i in dict(zip(own[::-1], range(len(a) - 1, -1, -1))).values():  # here, so that matchings of deep trees nest less
        row(i)
    return row, own


def below(row: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The next row of a table of cells."""
    out = np.zeros(len(row), np.int32)
    np.maximum(row[:-1] + weights, row[1:], out=out[1:])
    return np.maximum.accumulate(out)


def most_nodes(a: list[Slot], b: list[Slot], memo: dict) -> int:
    """Nodes of the best matching of two lists."""
    if len(a) * len(b) <= CELLS:
        return cells(a, b, memo)[-1][-1]
    p, q, _ = by_nodes(a, b)
    weights, kinds = weights_of(p, q, memo)
    if (found := few_lost(p, len(q), weights, kinds)) is not None:
        return sum(int(weights(i)[j]) for i, j in found)
    row = np.zeros(len(q) + 1, np.int32)
    for i in range(len(p)):
        row = below(row, weights(i))
    return int(row[-1])


def nodes_of(x: Slot) -> int:
    return sum(1 for _ in x.walk())


def by_nodes(a: list[Slot], b: list[Slot]) -> tuple[list[Slot], list[Slot], bool]:
    """Two lists, that of fewer nodes first, and whether they were turned."""
    turned = sum(map(nodes_of, a)) > sum(map(nodes_of, b))
    return (b, a, True) if turned else (a, b, False)


def few_lost(p: list[Slot], width: int, weights, kinds: list[int]) -> list[tuple[int, int]] | None:
    """Pairs of a best matching of a list with another of a width, if it loses few of the first list's nodes, else None: for each
    place of the first and each number of nodes lost before it, the least place in the other that is reached."""
    sizes = list(map(nodes_of, p))
    levels: OrderedDict[int, list[tuple[int, np.ndarray]]] = OrderedDict()

    def steps(i: int) -> list[tuple[int, np.ndarray]]:
        """Nodes that place i loses, and the places that lose no more, with the width at their end."""
        k = kinds[i]
        if k not in levels:
            w = weights(i)
            levels[k] = [(sizes[i] - int(x), np.append(np.flatnonzero(w >= x), width)) for x in np.unique(w[w > 0])[::-1]]
            while len(levels) > 1 and 8 * width * len(levels) > KEPT:
                levels.popitem(last=False)
        return levels[k]

    lost = 32
    while lost * FEWER <= width and 4 * (len(p) + 1) * (lost + 1) <= KEPT:
        reached = np.full((len(p) + 1, lost + 1), width + 1, np.int32)
        reached[0] = 0
        for i, size in enumerate(sizes):
            now, new = reached[i], reached[i + 1]
            if size <= lost:
                new[size:] = now[: lost + 1 - size]
            for loses, places in steps(i):
                if loses <= lost:
                    own = now[: lost + 1 - loses]
                    np.minimum(new[loses:], places[np.minimum(np.searchsorted(places, own), len(places) - 1)] + 1, out=new[loses:])
            if new[-1] > width:
                break
        else:
            c, out = int(np.argmax(reached[-1] <= width)), []
            for i in range(len(p) - 1, -1, -1):
                for loses, places in steps(i):
                    if loses <= c and (j := int(places[min(np.searchsorted(places, reached[i, c - loses]), len(places) - 1)])) < width and j + 1 == reached[i + 1, c]:
                        c -= loses
                        out.append((i, j))
                        break
                else:
                    c -= sizes[i]
            return out
        lost *= 4
    return None


def best_pairs(a: list[Slot], b: list[Slot], memo: dict) -> list[tuple[int, int]]:
    """Pairs of a best matching of two lists, from the end. Of a large table only every n-th row is kept, and what lies between is
    filled again for those columns that the matching has not passed."""
    out: list[tuple[int, int]] = []

    def back(rows, weight_at, lo: int, hi: int, j: int) -> int:
        i = hi
        while i > lo and j:
            row, above, w = rows[i - lo], rows[i - lo - 1], weight_at(i - 1, j - 1)
            if w and row[j] == above[j - 1] + w:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif row[j] == above[j]:
                i -= 1
            else:
                j -= 1
        return j

    if len(a) * len(b) <= CELLS:
        back(cells(a, b, memo), lambda i, j: weight(a[i], b[j], memo), 0, len(a), len(b))
        return out
    p, q, turned = by_nodes(a, b)
    weights, kinds = weights_of(p, q, memo)
    keep = max(16, KEPT // (4 * len(q) + 4))

    def trace(row: np.ndarray, lo: int, hi: int, j: int) -> int:
        gap, kept = -(-(hi - lo) // keep), [row]
        for i in range(lo, hi):
            row = below(row, weights(i)[:j])
            if (i + 1 - lo) % gap == 0:
                kept.append(row)
        if gap == 1:
            return back(kept, lambda i, j: weights(i)[j], lo, hi, j)
        for start in range(lo, hi, gap)[::-1]:
            if j:
                j = trace(kept[(start - lo) // gap][: j + 1], start, min(start + gap, hi), j)
        return j

    if (found := few_lost(p, len(q), weights, kinds)) is not None:
        out = found
    else:
        trace(np.zeros(len(q) + 1, np.int32), 0, len(p), len(q))
    return [(j, i) for i, j in out] if turned else out


def matched(a: list[Slot], b: list[Slot], memo: dict) -> list[tuple[int, int]]:
    """Simple tree matching of two lists of children: pairs of the order-keeping matching of most nodes."""
    if alike(a, b):
        return [(i, i) for i in range(len(a))]
    pairs, i, j = settled(a, b)
    return sorted([*pairs, *((i[x], j[y]) for x, y in best_pairs([a[x] for x in i], [b[y] for y in j], memo))])


def merge(a: Slot, b: Slot, same_page: bool = False, memo: dict | None = None) -> Slot:
    """The union of two aligned trees of one label, in an order that keeps both."""
    memo = {} if memo is None else memo
    kids, i, j = [], 0, 0
    for x, y in [*matched(a.kids, b.kids, memo), (len(a.kids), len(b.kids))]:
        kids += a.kids[i:x] + b.kids[j:y]
        if x < len(a.kids):
            kids.append(merge(a.kids[x], b.kids[y], same_page, memo))
        i, j = x + 1, y + 1
    if same_page:  # the texts of a run are one text
        texts = frozenset((zlib.crc32(repr((sorted(a.texts or ()), sorted(b.texts or ()))).encode()),)) if a.texts or b.texts else frozenset()
        a.nodes.extend(b.nodes)
        return Slot(a.label, 1, texts, a.chars + b.chars, kids, a.nodes)
    return Slot(a.label, a.pages + b.pages, both(a.texts, b.texts), a.chars + b.chars, kids)


def skeleton(s: Slot) -> str:
    return f"{s.label}({','.join(map(skeleton, s.kids))})" if s.kids else s.label


def add_up(known: Slot, tree: Slot) -> None:
    """Adds a tree to one of the same skeleton; sums are the same in any order."""
    for a, b in zip(known.walk(), tree.walk(), strict=True):
        a.pages += b.pages
        a.texts, a.chars = both(a.texts, b.texts), a.chars + b.chars


def wrapper_of(trees: list[Slot]) -> Slot:
    """One wrapper of different skeletons, the most frequent first."""
    named = sorted(((-t.pages, skeleton(t)), i) for i, t in enumerate(trees))
    out = trees[named[0][1]]
    for _, i in named[1:]:
        out = merge(out, trees[i])
    return out


#: Fewer pages, or fewer different articles, don't tell what is constant.
LEAST_PAGES = 3


def decide(wrapper: Slot) -> list:
    """[label, verdict, kids] of a wrapper: verdict 1 is the article, 2 template inside or outside of it, 0 neither."""
    nodes = list(wrapper.walk())
    tag = lambda s: s.label.split(".")[0].rstrip(MARKS)
    own = {id(s): s.chars if s.texts is None or len(s.texts) > 1 or s.pages < LEAST_PAGES else 0 for s in nodes}
    if not any(own.values()):  # nothing tells the pages apart
        own = {id(s): s.chars for s in nodes}
    total: dict[int, int] = {}
    titled: set[int] = set()
    suspect: set[int] = set()

    def add(s: Slot) -> int:
        total[id(s)] = 0 if id(s) in suspect else own[id(s)] + sum(map(add, s.kids))
        if tag(s) == "h1" or any(id(k) in titled for k in s.kids):
            titled.add(id(s))
        return total[id(s)]

    add(wrapper)
    most = 0.8 * total[id(wrapper)]
    suspect.update(id(s) for s in nodes if s.label[-1] in MARKS and id(s) not in titled and (s.label[-1] == "#" or total[id(s)] < most or not most))
    add(wrapper)
    named = [s for s in nodes if tag(s) in MAIN and total.get(id(s), 0)]
    inside: set[int] = set()  # below a suspect
    for s in nodes:
        if id(s) in suspect or id(s) in inside:
            inside.update(map(id, s.kids))
    named = [s for s in named if id(s) not in inside]
    if named:
        best = max(total[id(s)] for s in named)
        article = [s for s in named if total[id(s)] == best][-1]  # the innermost of those that hold all of it
    else:
        article = wrapper
        while found := [k for k in article.kids if total.get(id(k), 0) >= 0.7 * total[id(wrapper)] and total[id(k)] and tag(k) not in RUNS]:
            article = found[0]
    different = article.texts is None or any(s.texts is None or len(s.texts) >= LEAST_PAGES for s in article.walk())
    # Lines that repeat in an element that is an article by its name belong to it; elsewhere they are template.
    stays = TEXTUAL if named else frozenset(("article", "main", "body", "html"))

    def constant(s: Slot) -> bool:
        """A part all of whose texts never change though the articles do."""
        if not different or s.pages < LEAST_PAGES or tag(s) in stays:
            return False
        below = list(s.walk())
        return any(x.texts for x in below) and all(x.texts is not None and len(x.texts) <= 1 for x in below)

    def verdicts(s: Slot) -> list:
        by_name = id(s) in suspect and not (named and s.label[-1] == "^")  # an article's own header is its title
        v = 1 if s is article else 2 if by_name or constant(s) else 0
        return [s.label, v, [verdicts(k) for k in s.kids]]

    return verdicts(wrapper)


def verdicts_of(page: Slot, wrapper: list) -> list[int]:
    """For each slot of a page in walking order, the verdict of the wrapper's slot that it is aligned with (0: none)."""

    def as_slot(w: list) -> Slot:
        return Slot(w[0], w[1], kids=[as_slot(k) for k in w[2]])

    memo: dict = {}
    found: dict[int, int] = {}

    def align(w: Slot, p: Slot):
        found[id(p)] = w.pages
        for i, j in matched(w.kids, p.kids, memo):
            align(w.kids[i], p.kids[j])

    align(as_slot(wrapper), page)
    return [found.get(id(s), 2 if s.label[-1] in "#!" else 0) for s in page.walk()]


def block_texts(nodes: list[Node], template: set[int]) -> list[str]:
    """Texts of the blocks below nodes, in page order, without templates and boilerplate."""
    out: list[str] = []
    now: list[str] = []

    def flush():
        if text := " ".join(html.unescape("".join(now)).split()):
            out.append(text)
        now.clear()

    def walk(n: Node):
        for k in n.kids:
            if isinstance(k, str):
                now.append(k)
            elif k.drop or id(k) in template or k.tag in RAW:
                if k.tag in BLOCK:
                    flush()
            elif k.tag in BLOCK:
                flush()
                walk(k)
                flush()
            else:
                walk(k)

    for n in nodes:
        walk(n)
        flush()
    return out


class Extractor:
    """Applies wrappers; the verdicts of a host's skeletons are remembered, up to a bound."""

    def __init__(self, root: str, shards: int):
        self.root, self.shards = root, shards
        self.loaded: dict[int, dict[str, list]] = {}
        self.known: dict[tuple[str, str], list[int]] = {}

    def wrapper(self, host: str) -> list | None:
        s = zlib.crc32(host.encode()) % self.shards
        if s not in self.loaded:
            if len(self.loaded) >= 32:
                self.loaded.clear()
            fs, path = filesystem(f"{self.root}/wrappers-{s}.json")
            with fs.open_input_stream(path) as f:
                self.loaded[s] = json.loads(f.read())
        return self.loaded[s].get(host)

    def text(self, host: str, source: str) -> str:
        if not source.strip():
            return ""
        page = parse(source)
        tree = page_tree(page)
        key = host, skeleton(tree)
        if key not in self.known:
            if len(self.known) >= 20_000:
                self.known.clear()
            self.known[key] = verdicts_of(tree, self.wrapper(host))
        article, template = [], set()
        for slot, v in zip(tree.walk(), self.known[key], strict=True):
            if v == 1:
                article += slot.nodes
            elif v == 2:
                template.update(map(id, slot.nodes))
        return "\n".join(block_texts(article or [page], template))


def extractor(root: str, shards: int) -> Extractor:
    return resident(("wrappers", root), lambda: Extractor(root, shards))


def host_of(url_col: str):
    """What stands between the first :// and the next of / ? #, A-Z lower-cased; empty for null or without ://."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    cut = F.instr(url, "://")
    rest = F.when(cut > 0, url.substr(cut + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html", hosts_per_shard: int = 1000, most_trees: int = 20_000) -> tuple[str, int]:
    """Writes the wrappers of all hosts below the shared folder, in shards by host; returns the folder and their number."""

    def add_pages(batches):
        known: dict[tuple[str, str], Slot] = {}

        def rows():
            hosts, parts = [h for h, _ in known], [zlib.crc32(k.encode()) % 1024 for _, k in known]
            packed = [json.dumps(t.pack()).encode() for t in known.values()]
            known.clear()
            return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(parts, pa.int32()), pa.array(packed, pa.binary())], names=["host", "part", "wrapper"])

        for b in batches:
            for piece in by_bytes(b, "html", 4 << 20):
                for host, source in zip(piece.column("host").to_pylist(), piece.column("html").to_pylist(), strict=True):
                    if source.strip():
                        tree = page_tree(parse(source))
                        for s in tree.walk():
                            s.nodes = None
                        key = host, skeleton(tree)
                        if key in known:
                            add_up(known[key], tree)
                        else:
                            known[key] = tree
                if len(known) > most_trees:
                    yield rows()
        yield rows()

    def merged(pdf: pd.DataFrame) -> Slot:
        trees: dict[str, Slot] = {}
        for packed in pdf["wrapper"]:
            tree = Slot.unpack(json.loads(packed))
            key = skeleton(tree)
            if key in trees:
                add_up(trees[key], tree)
            else:
                trees[key] = tree
        return wrapper_of(list(trees.values()))

    def combine(parts: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"host": pdf["host"].head(1), "part": pdf["part"].head(1) % parts, "wrapper": [json.dumps(merged(pdf).pack()).encode()]})

        return run

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": pdf["host"].head(1), "rules": [json.dumps(decide(merged(pdf)))]})

    rows = pages.select(host_of(url_col).alias("host"), text_of(html_col).alias("html"))
    # All trees of a skeleton get into one group of the first step, so its sums are whole before anything is aligned.
    own = rows.mapInArrow(add_pages, "host string, part int, wrapper binary")
    for parts in (32, 1):
        own = own.groupBy("host", "part").applyInPandas(combine(parts), "host string, part int, wrapper binary")
    by_part = own
    rules = materialize(by_part.groupBy("host").applyInPandas(finish, "host string, rules string"), "wrappers")
    shards = int(rules.count() / hosts_per_shard) + 1
    root = shared_dir(pages.sparkSession)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(pdf["shard"].iloc[0])
        body = ",".join(f"{json.dumps(h)}:{r}" for h, r in zip(pdf["host"], pdf["rules"], strict=True) if h is not None)
        write_file(f"{root}/wrappers-{s}.json", f"{{{body}}}".encode())
        return pdf[["shard"]].head(1)

    every = pages.sparkSession.range(0, shards, 1, 1).select(F.col("id").cast("int").alias("shard"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("rules"))
    found = rules.select((F.crc32("host") % shards).cast("int").alias("shard"), "host", "rules").unionByName(every)
    found.groupBy("shard").applyInPandas(write, "shard int").write.format("noop").mode("overwrite").save()
    return root, shards


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text, n_chars of every page: the article's blocks, joined by line feeds.

    Null or empty html: empty text. A null url, or one without a host, belongs to the host "". Null ids and repeated rows
    are kept row by row. Of hosts with fewer than three pages only tags and names tell template from content. An element
    that no wrapper knows is content if it stands in the article. If no part of a page is an article, the whole page
    counts, without what its tags and names tell to be template. An empty table gives an empty result.
    """
    root, shards = induce(pages, url_col, html_col)
    types = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches):
        own = extractor(root, shards)
        for b in batches:
            for part in by_bytes(b, "html", 4 << 20):
                texts = [own.text(h, s) for h, s in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"), text_of(html_col).alias("html"))
    out = rows.mapInArrow(run, f"id {types[id_col]}, url {types[url_col]}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
