import random

import pytest

from spindrift.llm import html_extract
from spindrift.llm.html_extract import Slot, extract_text, matched


def nodes(x, y):
    return 1 + nodes_of_lists(x.kids, y.kids) if x.label == y.label else 0


def nodes_of_lists(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = max(rows[i][j + 1], rows[i + 1][j], rows[i][j] + nodes(x, y))
    return rows[-1][-1]


def tree(r, depth):
    return Slot(r.choice("abc"), kids=[tree(r, depth - 1) for _ in range(r.randint(0, 4))] if depth and r.random() < 0.7 else [])


@pytest.mark.parametrize("cells, kept, fewer", [(4096, 32 << 20, 8), (0, 32 << 20, 8), (0, 32 << 20, 0), (0, 1, 8)], ids=["one by one", "by rows", "few lost", "few rows kept"])
def test_a_matching_is_the_best(monkeypatch, cells, kept, fewer):
    for name, value in (("CELLS", cells), ("KEPT", kept), ("FEWER", fewer)):
        monkeypatch.setattr(html_extract, name, value)
    r = random.Random(8)
    for n in [6] * 150 + [60] * 5:
        a, b = ([tree(r, 2) for _ in range(r.randint(0, n))] for _ in range(2))
        pairs = matched(a, b, {})
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        assert sum(nodes(a[i], b[j]) for i, j in pairs) == nodes_of_lists(a, b)


def test_lists_of_like_labels_are_not_always_one_to_one():
    a, b = [Slot("d"), Slot("d", kids=[Slot("p"), Slot("q")])], [Slot("d", kids=[Slot("p"), Slot("q")]), Slot("d")]
    assert matched(a, b, {}) == [(1, 0)]


def test_long_lists_lose_no_pair():
    r = random.Random(4)
    row = lambda n: [Slot(f"div.{r.choice('abcdefgh')}") for _ in range(n)]
    own = [Slot(f"div.{i}", kids=[Slot("p")]) for i in range(2100)]
    a, b = [*row(3), *own, *row(5)], [*row(40), *own, *row(5)]
    held = {(i + 3, i + 40) for i in range(2100)}
    assert held <= set(matched(a, b, {})) and {(j, i) for i, j in held} <= set(matched(b, a, {}))


def test_a_menu_behind_many_new_parts_stays_template(spark):
    """Pages of over 2,100 parts; the last has other parts before and behind them."""
    parts = "".join(f"<div class=s{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}>Same part {i}</div>" for i in range(2100))
    page = lambda n: f"<body>{''.join(f'<section class=q{chr(97 + i)}><p>Own {n} {i}</p></section>' for i in range(20 if n == 4 else 0))}{parts}<div class={'words' if n == 4 else 'text'}><p>{f'Text number {n} is here. ' * 2000}</p></div></body>"
    rows = spark.createDataFrame([(n, f"http://parts.example/{n}", page(n)) for n in range(5)], "page_id long, url string, html string")
    for r in extract_text(rows).collect():
        assert "Same part" not in r.text and f"Text number {r.page_id}" in r.text
