import hashlib
import random
import zlib

from spindrift.llm import html_extract, media, url_filter

from .helpers import ODD, SMALL, documents


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def extract(spark, rows):
    return {r.page_id: r.text for r in html_extract.extract_text(pages(spark, rows)).collect()}


def test_wrappers_without_telling_tags(spark):
    """Class-less layout: the menu and the line below never change, the middle does."""
    page = "<html><body><div><span>Home</span> <span>About</span></div><div><h1>Title {0}</h1><p>Text {0} &amp; more\n words<p>Second {0}</div><div>All rights reserved</div></body></html>"
    rows = [(i, f"http://h.org/{i}", page.format(f"number {i}")) for i in range(6)]
    got = extract(spark, rows)
    assert got == {i: f"Title number {i}\nText number {i} & more words\nSecond number {i}" for i in range(6)}


def test_constant_containers_in_the_article_go_and_paragraphs_stay(spark):
    page = "<nav>m</nav><article><h1>T{0}</h1><p>Same line.</p><div><span>Join us today</span></div><p>Own {0}<br>x</p><div class='comments'><p>c {0}</p></div><form>f</form></article><aside>a</aside><footer>&copy;</footer>"
    got = extract(spark, [(i, "https://a.b/x", page.format(i)) for i in range(5)])
    assert got[3] == "T3\nSame line.\nOwn 3 x"


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "x", ""), (3, "http://q/", "plain text  only"), (4, "http://q/", "<p>a<!-- <p>b</p> --><script>if (a<b) '</p>'</script>c&#233;&lt;x&gt;"), (5, "http://q/", "<b>" * 3000 + "deep"), (None, "http://q/", "<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>"), (7, "http://q/", "<article><p>unclosed <div>inner</article>tail")]
    got = extract(spark, rows)
    assert got == {1: "", 2: "", 3: "plain text only", 4: "acé<x>", 5: "deep", None: "one\ntwo\nx\ny", 7: "unclosed\ninner"}
    assert html_extract.extract_text(pages(spark, [])).count() == 0


def test_tree_matching_keeps_order_and_counts_nodes():
    s = lambda label, *kids: html_extract.Slot(label, kids=list(kids))
    a = [s("div", s("p")), s("ul"), s("div", s("p"), s("span"))]
    b = [s("ul"), s("div", s("p"), s("span"))]
    assert html_extract.matched(a, b, {}) == [(1, 0), (2, 1)]
    merged = html_extract.merge(s("body", *a), s("body", *b))
    assert [k.pages for k in merged.kids] == [1, 2, 2]


def test_pages_of_a_table_give_their_article(spark):
    import html
    import re

    rows = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.op2_html_text(spark, SMALL).collect()}
    for r in rows:
        inside = r.html[r.html.index("<article>") : r.html.rindex("</article>")]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1|article)>", inside))
        text = "\n".join(b for b in blocks if b)
        assert got[r.page_id] == (text, len(text))


def brute_rule(host, path, rules):
    fits = [(len(h) + len(p), len(h), -i) for i, (_, h, p) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return -max(fits)[2] if fits else -1


def test_sweep_is_brute_force():
    rnd = random.Random(2)
    host = lambda: ".".join(rnd.choice(["a", "b", "ab", "com", ""]) for _ in range(rnd.randint(1, 4)))
    path = lambda: rnd.choice(["", "/", "/x", "/x/", "/x/y", "/xy"])
    rules = [(rnd.choice(["block", "allow"]), host(), path()) for _ in range(60)]
    urls = [(host(), path()) for _ in range(800)]
    assert url_filter.sweep(urls, rules) == [brute_rule(h, p, rules) for h, p in urls]


def test_url_filter_edges_and_blocks(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?q", "https://x.net?y", "ftp://example.com/de/", "http://org/fr/", "http://net.com/"]
    rows = pages(spark, [(i, u, "h") for i, u in enumerate(urls)])
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(rows).orderBy("page_id").collect()]
    assert got[:3] == [("", "", None, "allow")] * 3
    assert got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[4] == ("x.net", "", None, "allow")
    assert [g[3] for g in got[5:]] == ["block", "allow", "allow"]
    assert [(r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(rows, block_bytes=1).orderBy("page_id").collect()] == got
    assert url_filter.filter_urls(rows.limit(0)).count() == 0 and url_filter.filter_urls(rows, rules=()).filter("rule is not null").count() == 0


def test_media_round_trip(spark):
    got = media.media_columns(documents(spark, ODD)).collect()
    texts = {(i, (t or "").encode()) for i, t in ODD}
    for r in got:
        raw = next(b for i, b in texts if i == r.doc_id and len(b) == r.n_bytes)
        payload = media.pad_payload(raw)
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and len(payload) % 192 == 0 and payload == raw.ljust(len(payload), b" ") and len(payload) - len(raw) <= 192
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and r.feature
        audio = media.read_audio(bytes(r.media))
        assert r.payload_bytes == len(payload) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert media.read_payload(bytes(r.media), audio) == payload and r.crc_bad == 0 and r.crc_ok == len(payload) // 192 + 1
        assert audio.seconds * 32000 == 1152 * len(audio.offsets) and audio.vbr["frames"] == len(audio.offsets)
    assert media.media_columns(documents(spark, [])).count() == 0


def test_audio_is_found_again_behind_damage():
    data = media.write_audio(media.pad_payload(b"x" * 900))
    whole = media.read_audio(data)
    cut = whole.offsets[2]
    hurt = media.read_audio(data[:cut] + b"\xff\xfb junk \xff" + data[cut:])
    assert len(hurt.offsets) >= len(whole.offsets) - 1 and hurt.skipped > 0
    flipped = bytearray(data)
    flipped[whole.offsets[1] + 8] ^= 1
    assert media.read_audio(bytes(flipped)).crc_bad == 1
    assert media.read_audio(b"").offsets == [] and media.read_audio(b"\xff" * 50).offsets == []


def test_long_rule_lists_are_searched_not_scanned():
    import random
    import time

    from spindrift.llm import url_filter as u

    r = random.Random(7)
    part = lambda k: "".join(r.choices("ab", k=k))
    rules = [("block", r.choice(["com", "a.com", "b.a.com", "net"]), "/" + part(r.randint(0, 4))) for _ in range(300)]
    urls = [(r.choice(["com", "a.com", "x.b.a.com", "net", "xnet", "a.net", ""]), "/" + part(r.randint(0, 6)) if r.random() < 0.9 else "") for _ in range(500)]
    fits = lambda h, p, x: (h == x[1] or h.endswith("." + x[1])) and p.startswith(x[2])
    want = [max((i for i, x in enumerate(rules) if fits(h, p, x)), key=lambda i: (len(rules[i][1]) + len(rules[i][2]), len(rules[i][1]), -i), default=-1) for h, p in urls]
    assert u.sweep(urls, rules) == want
    many = [("block", "com", f"/{i}/") for i in range(20_000)]
    starts, began = u.prepared(many), time.time()
    assert u.sweep([(f"h{i}.com", f"/{i}/x") for i in range(5000)], many, starts) == list(range(5000))
    assert time.time() - began < 3
