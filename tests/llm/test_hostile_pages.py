import random
import time

import pytest

from spindrift.llm.html_extract import Slot, add_up, decide, extract_text, page_tree, parse, skeleton, wrapper_of


def extract(spark, htmls, host="h.org"):
    rows = spark.createDataFrame([(i, f"http://{host}/{i}", x) for i, x in enumerate(htmls)], "page_id long, url string, html string")
    return [r.text for r in extract_text(rows).orderBy("page_id").collect()]


def test_letters_whose_lower_case_is_longer(spark):
    page = f"<article><p>{'İ' * 30}</p><script>var a = '<p>'</SCRIPT ><p>after it this sentence should stay whole</p></article>"
    assert extract(spark, [page]) == [f"{'İ' * 30}\nafter it this sentence should stay whole"]


def test_names_never_drop_what_holds_the_text_or_a_title(spark):
    layout = "<div class='logo'>Logo</div><div class='content with-sidebar'><h1>Title {0}</h1><p>Text {0} is here.</p><div class='sidebar'>Other things {0}</div></div>"
    assert extract(spark, [layout.format(i) for i in range(5)], "a.org") == [f"Title {i}\nText {i} is here." for i in range(5)]
    article = "<article><div class='entry-header'><h2>Title {0}</h2></div><p>Text {0}.</p><div class='comments'>{1}</div></article><div class='notice'>n {0}</div>"
    got = extract(spark, [article.format(i, f"<p>reader says {i}</p>" * 40) for i in range(5)], "b.org")
    assert got == [f"Title {i}\nText {i}." for i in range(5)]


def test_constant_lines_are_template_where_no_element_is_an_article(spark):
    page = "<body><div><ul><li>Home</li><li>About</li></ul></div><div><p>All rights reserved</p><section><p>One {0}</p><pre>Two {0} two</pre></section></div></body>"
    assert extract(spark, [page.format(f"text number {i}") for i in range(6)]) == [f"One text number {i}\nTwo text number {i} two" for i in range(6)]


def test_wrappers_do_not_depend_on_the_order_of_pages():
    rnd = random.Random(4)
    block = lambda n: rnd.choice(["<p>t{0}</p>", "<div class=a><p>x</p></div>", "<div><h2>h{0}</h2></div>", "<ul><li>{0}</li></ul>", "<div class=b>same</div>"]).format(n)
    pages = [f"<div>menu</div><div>{''.join(block(n) for _ in range(rnd.randint(1, 7)))}</div>" for n in range(30)]

    def rules(order):
        known = {}
        for n in order:
            tree = page_tree(parse(pages[n]))
            key = skeleton(tree)
            if key in known:
                add_up(known[key], tree)
            else:
                known[key] = tree
        return decide(wrapper_of(list(known.values())))

    orders = [rnd.sample(range(30), 30) for _ in range(20)]
    assert all(rules(o) == rules(range(30)) for o in orders)


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 350_000,
        "<a " * 350_000 + ">",
        '<a "' * 250_001,
        '<a ">" ' * 150_001 + '<a "',
        "<a '>\" " * 120_000,
        "<!--" * 250_000,
        "<!" * 500_000,
        "</a" * 350_000,
        "<div>" * 200_000,
        "<script>" * 120_000,
        "<nav><p>" * 120_000 + "x",
        "<p>x</p><h2>y</h2>" * 50_000,
        "".join(f"<div class={chr(97 + i * 7 % 26)}><p>{i}</p></div><h2>b</h2>" for i in range(25_000)),
        "<a b=" + " " * 1_000_000 + ">",
        "&amp" * 250_000,
    ],
    ids=lambda p: p[:12],
)
def test_a_megabyte_of_anything_takes_seconds(page):
    start = time.time()
    tree = page_tree(parse(page))
    other = page_tree(parse("<p>a</p><div class=q>b</div>" + page[: len(page) // 3] + "<h2>c</h2>"))
    rules = decide(wrapper_of([tree, other]))
    assert rules and time.time() - start < 20


def test_deep_template_stays_out(spark):
    page = "<div>" * 300 + "<p>deep text</p><nav>menu</nav><form>f</form>" + "<b>" * 5000 + "bold</b> end"
    assert extract(spark, [page]) == ["deep text\nbold end"]


def test_sums_of_texts_are_the_same_in_any_order():
    slots = lambda *t: Slot("p", texts=frozenset(t), chars=1)
    for order in ((1, 2, 3, 4, 1), (4, 1, 1, 3, 2)):
        total = slots(order[0])
        for t in order[1:]:
            add_up(total, slots(t))
        assert (total.pages, total.texts, total.chars) == (5, None, 5)
