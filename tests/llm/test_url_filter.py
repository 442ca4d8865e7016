import duckdb
import pandas as pd
import pytest

from rulespark.llm import url_filter
from rulespark.llm.queries import URL_RULES
from rulespark.llm.url_filter import Rule

PAGES = [
    (1, "https://a.example.org/en/1#top", "<p>no link</p>"),
    (2, "http://a.example.org/start", '<head><LINK class="x" REL="canonical" HREF="http://b.example.com/en/9?x=1&amp;y=2"></head>'),
    (3, "http://a.example.org/x/y/z", "<meta http-equiv='refresh' content='0; url=../../start'>"),
    (4, "http://b.example.com/de/ok", '<link href="//a.example.org/x/y/z" rel=canonical>'),  # allowed by its own rule
    (5, "http://d.example.org", "<meta content='5;URL=\"/far/./away/\"' http-equiv=Refresh>"),
    (6, "HTTP://D.example.org/far/away/", '<!-- <link rel="canonical" href="http://x.net/es/"> --><link rel="canonical" href="mailto:me">'),
    (7, "http://d.example.org/far/away/?q", "<script>canonical <link rel='canonical' href='http://x.net/es/1'></script>"),
    (8, None, '<link rel="canonical" href="http://x.net/es/1">'),
    (9, "no scheme", None),
    (10, "http://e.net?x://y/es/", ""),
    (11, "http://e.net/es/1", '<link rel="canonical" href="http://f.org/self">'),
    (12, "https://f.org/self", '<link rel="canonical" href="#here">'),
    (13, "http://f.org/self#again", "<link rel='stylesheet' href='http://x.net/es/2'>"),
    (14, "http://www.example.com/en/1", '<link rel="canonical" href="http://example.com/en/1">'),
    (15, "http://EXAMPLE.com/en/1", "x" * 300_000 + "canonical"),
    (16, "http://com/", '<link rel="canonical" href="http://f.org/self"'),
    (None, "http://f.org/self", None),
    (11, "http://e.net/es/1", '<link rel="canonical" href="http://f.org/self">'),
    (17, "http://xcom/en/", "<meta http-equiv=refresh content=3>"),
    (18, "http://g.org/\n?a", '<link\nrel="alternate canonical"\nhref=" http://e.net/fr/&#38;1 ">'),
]
BLOCKED = {2, 3, 11, 12, 13, 15, 18, None}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, verdict string, key int").repartition(3)


def answer(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def judged(pages):
    return url_filter.judge(pages, URL_RULES)


def test_blocks_follow_links_and_allow_comes_first(judged):
    got = judged
    assert {r["page_id"] for r in got.where("verdict_ = 'block'").collect()} == BLOCKED
    assert got.count() == len(PAGES) and {"verdict", "key", "host", "path", "rule", "verdict_"} <= set(got.columns)


def test_equals_sql(judged):
    con = duckdb.connect()
    con.register("pages", pd.DataFrame([(str(p[0]), *p[1:]) for p in PAGES], columns=["page_id", "url", "html"]))
    want = con.execute(url_filter.oracle(URL_RULES)).fetchall()
    none = lambda v: None if v is None or v != v else v
    got = [(str(i), h, p, none(r), v) for i, h, p, r, v in answer(judged, "page_id", "host", "path", "rule", "verdict_")]
    assert sorted(got, key=repr) == sorted(((i, h, p, none(r), v) for i, h, p, r, v in want), key=repr)


def brute_rule(host, path, rules):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return min(fit, key=lambda r: (-len(r.host + r.path), r.verdict, r.host, r.path), default=None)


def test_long_rule_tables_are_joined_and_agree(spark, pages):
    rules = URL_RULES + [Rule(f"h{i}.org", f"/{'p' * (i % 7)}", ("allow", "block")[i % 2]) for i in range(200)] + [Rule("org", "/x/", "block"), Rule("b.org", "/d", "block"), Rule("org", "/de/b", "allow")]
    urls = [(i, f"http://{'s.' * (i % 3)}h{i % 40}.org/{'p' * (i % 9)}/{i}", None) for i in range(300)] + [(900, "http://b.org/de/b", None), (901, None, None)]
    urls = spark.createDataFrame(urls, "page_id long, url string, html string").unionByName(pages.select("page_id", "url", F_null()))
    rows = url_filter.judge(urls, rules).collect()
    assert len(rows) == 302 + len(PAGES)
    for r in rows:
        best = brute_rule(r["host"], r["path"], rules)
        assert (r["rule"], r["verdict"]) == ((best.host + best.path, best.verdict) if best else (None, "allow"))


def F_null():
    from pyspark.sql import functions as F

    return F.lit(None).cast("string").alias("html")


def test_redirect_log_reaches_pages_and_long_chains_close(spark):
    pages = spark.createDataFrame([(i, f"http://n.org/{i}", None) for i in range(60)], "page_id long, url string, html string")
    hops = [(f"http://n.org/{i}", f"https://n.org/{i + 1}#x") for i in range(40)] + [("http://n.org/40", "http://bad.net/es/"), (None, "http://n.org/50"), ("http://n.org/41", None)]
    log = spark.createDataFrame(hops, "source string, target string")
    got = url_filter.judge(pages, URL_RULES, redirects=log)
    assert {r["page_id"] for r in got.where("verdict = 'block'").collect()} == set(range(41))


def test_one_host_may_hold_everything(spark):
    pages = spark.createDataFrame([(i, f"http://hub.org/{i}", '<link rel="canonical" href="http://hub.org/all">') for i in range(500)], "page_id long, url string, html string")
    log = spark.createDataFrame([("http://hub.org/all", "http://x.net/fr/1")], "source string, target string")
    assert url_filter.judge(pages, URL_RULES, redirects=log).where("verdict = 'block'").count() == 500


def test_empty_tables_and_no_rules(spark, pages):
    assert url_filter.judge(pages.limit(0), URL_RULES).count() == 0
    pages = pages.select("page_id", "url", F_null())
    assert url_filter.judge(pages, []).where("verdict = 'allow' and rule is null").count() == len(PAGES)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_filter.judge(pages, none).where("verdict = 'allow'").count() == len(PAGES)


def test_main_path_runs_no_python(judged):
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan and "CartesianProduct" not in plan
