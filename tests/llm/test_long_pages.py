from spindrift.llm.html_extract import extract_text


def test_a_long_page_keeps_its_article(spark):
    """Over 3,000 slots that are on equally many pages: the wrapper still knows the article."""
    page = lambda n: f"<html><body><div class=strip>Same words of every page</div><article>{''.join(f'<h2>Head {n} {i}</h2><p>Text {n} {i}</p>' for i in range(1600))}</article></body></html>"
    rows = spark.createDataFrame([(n, f"http://long.example/{n}", page(n)) for n in range(4)], "page_id long, url string, html string")
    for r in extract_text(rows).collect():
        lines = r.text.split("\n")
        assert len(lines) == 3200 and lines[0] == f"Head {r.page_id} 0" and "Same words" not in r.text


def test_slots_of_many_layouts_stay(spark):
    """Layouts that are on one page of each task each, but together have over 3,000 slots, and a notice on all pages."""
    page = lambda n: "<html><body><div class=strip>Same words of every page</div><article>" + "".join(f"<div class=c{'abcdefghij'[n % 10]}{chr(97 + i % 26)}{chr(97 + i // 26)}>Text {n} {i}</div>" for i in range(350)) + "</article></body></html>"
    rows = spark.createDataFrame([(n, f"http://many.example/{n}", page(n)) for n in range(10)], "page_id long, url string, html string").repartition(2)
    for r in extract_text(rows).collect():
        assert len(r.text.split("\n")) == 350 and "Same words" not in r.text
