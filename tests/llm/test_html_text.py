from pyspark.sql import functions as F

from rulespark.llm import html_text


def text_of(page):
    return html_text.main_text(html_text.blocks(page), set(), set())


def test_pages_are_their_documents(spark, docs, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = html_text.extract(pages)
    assert got.count() == pages.count() and got.columns == ["page_id", "url", "text"]
    known = {" ".join(r.text.split()) for r in docs.collect()}
    rows = got.collect()
    bodies = [" ".join(r.text.split("\n\n", 1)[1].split()) for r in rows]
    assert sum(b in known for b in bodies) > 0.98 * len(rows)


def test_blocks_and_references():
    page = "<html><body><nav><a href=x>Home</a></nav><main><h1>A&amp;B &lt;x&gt;</h1><p>one<br>two <b>thr</b>ee\n\n four<p>five&nbsp;six<ul><li>a<li>b</ul>tail</main><footer>f</footer>"
    assert text_of(page) == "A&B <x>\n\none two three four\n\nfive six\n\na\n\nb\n\ntail"


def test_marked_boilerplate_goes():
    parts = ["<div class='ad'>x</div>", "<aside>x</aside>", "<form><p>x</p></form>", "<div id=comments><p>x</p></div>", "<div class='cookie-notice'>x</div>", "<script>if (a<b) x</script>",
             "<style>x</style>", "<!-- x -->", "<header>x</header>", "<div role=navigation>x</div>", "<div hidden>x</div>", "<noscript>x</noscript>", "<ul class=menu><li>x</ul>"]
    assert text_of("<body>" + "<p>keep</p>".join(["", *parts, ""]) + "</body>") == "\n\n".join(["keep"] * (len(parts) + 1))


def test_odd_html():
    assert text_of(None) == text_of("") == "" and text_of("<") == "<"
    assert text_of("a < b & c <p>d") == "a < b & c\n\nd"
    assert text_of("<p>" * 3000 + "x") == "x"
    assert text_of("<div>" * 3000 + "x") == "x"
    assert text_of("<script>never closed") == ""
    assert len(text_of("<p>" + "word " * 100_000)) == 499_999


def test_left_out_elements_end_where_they_end():
    for tag in ("<svg-icon name=x></svg-icon>", "<select-box>", "<title-bar></title-bar>", "<style-x/>", "<svg class=i/>", "<svg viewBox='0 0 1 1' />", "<svg>", "<select name=a>", "<template>", "<noscript>", "<iframe src=x>"):
        got = text_of(f"<body><p>one</p>{tag}<p>two</p><p>three</p></body>").split("\n\n")
        assert got == ["one", "two", "three"], tag
    for name in ("svg", "select", "iframe", "noscript", "template", "script", "style", "textarea", "title"):
        assert text_of(f"<p>one</p><{name} a='b'>x</{name}-y><b>y</b></{name.upper()} ><p>two</p>") == "one\n\ntwo", name
    assert text_of("<p>one</p><svg/><p>two</p><svg><text>x</text></svg><p>three") == "one\n\ntwo\n\nthree"
    assert len(text_of("<svg>" * 40_000 + "x" * 10)) == 10
    for name in ("script", "style", "textarea", "title"):
        assert text_of(f"<p>one</p><{name} a=b>x<p>y") == "one"


def test_simple_tree_matching():
    a = {"x": {"p": {}, "q": {}}, "y": {}}
    b = {"w": {}, "x": {"q": {}}, "y": {}}
    assert html_text.match(a, b)[0] == 3
    assert html_text.aligned(a, b) == {("x",): ("x",), ("x", "q"): ("x", "q"), ("y",): ("y",)}
    assert html_text.match({"a": {}, "b": {}}, {"b": {}, "a": {}})[0] == 1  # order counts


def test_template_is_induced_from_same_host_pages(spark):
    """Neither names nor classes tell the site's lines apart: only that they repeat, or are links."""
    page = "<body><div class=t1><p>Site of things</p></div><div class=t2><a href=1>{0} one</a> <a href=2>{0} two</a></div><div class=post-{0:03d}><p>Story {0} begins.</p><p>And {0} ends.</p></div><div class=t3><span>All rights kept</span></div></body>"
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(12)]
    rows += [(100, "http://lone.example/", page.format(100)), (101, None, page.format(101)), (102, "http://h.example/x", None)]
    rows += [(200 + i, "http://copies.example/", page.format(7)) for i in range(9)]  # copies say nothing about a template
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    for i in range(12):
        assert got[i] == f"Story {i} begins.\n\nAnd {i} ends."
    assert got[102] == ""
    for i in (100, 101, 200):
        assert "Story" in got[i] and "Site of things" in got[i]


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, host string, draw int"
    df = spark.createDataFrame([(None, "http://a/b", "<p>x</p>", "h", 1)] * 5 + [(1, "", "", None, None)], schema)
    got = html_text.extract(df)
    assert sorted(r.text for r in got.collect()) == ["", *["x"] * 5]
    assert html_text.extract(df.where(F.lit(False))).count() == 0


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    return {r.page_id: r.text for r in html_text.extract(df).collect()}


def test_a_slot_constant_on_most_pages_keeps_other_texts(spark):
    """20 hosts whose second heading is the same on 60 % of the pages."""
    head = lambda i: "Summary" if i % 20 < 12 else f"Own heading {i}"
    page = "<body><div class=top>The site</div><article><h1>Title {0}</h1><h2>{1}</h2><p>Story {0} is told here.</p></article></body>"
    got = extracted(spark, [(h * 20 + i, f"http://h{h}.org/{i}", page.format(h * 20 + i, head(i))) for h in range(20) for i in range(20)])
    assert sum(f"Own heading {i}" in t for t in got.values() for i in range(12, 20)) == 160
    assert all("The site" not in t and "is told here" in t for t in got.values())


def test_list_items_without_links_stay_beside_linked_ones(spark):
    page = "<body><article><p>Story {0} is told here, at some length.</p><ul><li><a href=x>Linked item number {0} and more</a><li>Plain item {0}</ul></article><ul class=x><li><a href=1>Link {0}</a><li><a href=2>Link two {0}</a></ul></body>"
    got = extracted(spark, [(i, f"http://a.org/{i}", page.format(i)) for i in range(100)])
    assert sum(f"Plain item {i}" in t for i, t in got.items()) == 100 and sum(f"Linked item number {i}" in t for i, t in got.items()) == 100
    assert not any("Link two" in t for t in got.values())


def test_a_page_without_blocks_is_no_reference(spark):
    page = "<body><div class=t>Always the same line</div><div class=c>Story {0} is told here.</div></body>"
    rows = [(h * 10 + i, f"http://h{h}.org/{i}", ["", "<html><script>var x = 1</script></html>", "<p> </p>"][i] if i < 3 else page.format(h * 10 + i)) for h in range(30) for i in range(10)]
    got = extracted(spark, rows)
    assert all(got[h * 10 + i] == f"Story {h * 10 + i} is told here." for h in range(30) for i in range(3, 10))


def test_siblings_of_one_label_are_told_apart(spark):
    page = "<body><div>Site notice</div>{1}<div>Story {0} is told here.</div><div>All rights kept</div></body>"
    got = extracted(spark, [(i, f"http://a.org/{i}", page.format(i, "")) for i in range(12)])
    assert all(t == f"Story {i} is told here." for i, t in got.items())


def test_names_that_only_hint_and_teasers(spark):
    assert text_of('<body><div class="related-work"><p>Earlier studies.</p></div><div class="widget text">Body</div><div class=related><a href=x>Other story</a></div></body>') == "Earlier studies.\n\nBody"
    body = "<p>The body of this page goes on for quite a while.</p>" * 3
    assert text_of(f"<body>{body}<article>Teaser</article></body>").count("quite a while") == 3


def test_hosts_beyond_a_broadcast_are_salted(spark, monkeypatch):
    page = "<body><div class=t>Always the same line</div><div class=c>Story {0} is told here.</div></body>"
    rows = [(i, f"http://h{i % 2}.org/{i}", page.format(i)) for i in range(40)] + [(90, None, page.format(90)), (91, "http://lone.org/", None)]
    want = extracted(spark, rows)
    monkeypatch.setattr(html_text, "fits_broadcast", lambda df: False)
    assert extracted(spark, rows) == want and want[0] == "Story 0 is told here."


def test_deep_pages_and_unclosed_quotes(spark):
    import time

    deep = "<div>" * 5_000 + "bottom {0}" + "</div>" * 5_000
    got = extracted(spark, [(i, f"http://a.org/{i}", f"<body><p>Line {i}</p>" + deep.format(i)) for i in range(8)])
    assert all(t == f"Line {i}\n\nbottom {i}" for i, t in got.items())
    start = time.perf_counter()
    for bad in ('<a b="' * 170_000, '<a b=">"' * 125_000, "<a b='\"" * 140_000, '<p>one</p><a b="x>two</p><p>three', "<" * 1_000_000, "<a" * 500_000):
        text_of(bad)
    assert time.perf_counter() - start < 30
    assert text_of('<p>one</p><a b="x>two</a><p>three') == "one\n\ntwo\n\nthree"


def brute_match(a, b):
    """The most nodes two forests can match in order, by trying all pairs."""
    best = 0
    left, right = list(a.items()), list(b.items())
    for i, (x, xs) in enumerate(left):
        for j, (y, ys) in enumerate(right):
            if x.split("#")[0] == y.split("#")[0]:
                best = max(best, 1 + brute_match(xs, ys) + brute_match(dict(left[i + 1 :]), dict(right[j + 1 :])))
    return best


def test_matching_of_random_trees():
    import random

    rng = random.Random(4)

    def forest(depth):
        out = {}
        for k in range(rng.randint(0, 4) if depth else 0):
            out[f"{rng.choice('ab')}#{k}"] = forest(depth - 1)
        return out

    for _ in range(300):
        a, b = forest(3), forest(3)
        size, pairs = html_text.match(a, b)
        assert size == brute_match(a, b) == len(html_text.aligned(a, b))
