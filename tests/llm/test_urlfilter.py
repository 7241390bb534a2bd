import duckdb
import pytest
from pyspark.sql import functions as F

from siftwell.llm import urlfilter
from siftwell.llm.sql import OP8
from verify import rows as canonical

RULES = urlfilter.RULES


def judged(spark, rows, **kw):
    df = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, rule string")
    return [tuple(r)[1:] for r in urlfilter.judge(df, **kw).orderBy("page_id").collect()]


def test_rules(spark):
    got = judged(spark, [("http://A.Example.NET/en/1?x", ""), ("https://example.net/de/1", ""), ("https://badexample.com/de/1", ""), ("x://m.example.com/de/", None), ("example.com/de/", ""), (None, None), ("http://org/fr/", ""), ("http://net#a", ""), ("a://b.org?c/fr/", "")])
    assert got == [
        ("a.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "/de/1", "net/", "block"), ("badexample.com", "/de/1", None, "allow"),
        ("m.example.com", "/de/", "example.com/de/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("org", "/fr/", "org/fr/", "allow"), ("net", "", None, "allow"), ("b.org", "", None, "allow"),
    ]


def link(u):
    return f'<html><link href="{u}" rel="canonical">'


def hop(u):
    return f"<META content='0; url={u}' HTTP-EQUIV='refresh'>"


def test_aliases(spark):
    rows = [("http://a.com/1", link("http://x.net/1")), ("http://b.com/1", hop("http://a.com/1")), ("http://c.com/1", link("http://d.com/1")), ("http://e.com/1", link("http://b.com/1#x")),
            ("http://p.com/", link("http://q.org/fr/")), ("http://r.com/", link("http://p.com/")), ("http://r.com/", hop("http://example.com/de/"))]
    assert [v[3] for v in judged(spark, rows)] == ["block", "block", "allow", "block", "allow", "allow", "allow"]


def test_long_chain_and_star(spark):
    rows = [(f"http://h{i}.com/", link(f"http://h{i + 1}.com/")) for i in range(40)] + [("http://h40.com/", link("http://z.net/"))]
    rows += [(f"http://s{i}.com/", link("http://hub.com/")) for i in range(60)]
    got = [v[3] for v in judged(spark, rows)]
    assert got == ["block"] * 41 + ["allow"] * 60


def test_extra_edges_and_empty(spark):
    e = spark.createDataFrame([("http://a.com/", "http://b.net/"), (None, "http://c.com/")], "url string, target string")
    assert [v[3] for v in judged(spark, [("http://a.com/", None), ("http://c.com/", None)], edges=e)] == ["block", "allow"]
    assert judged(spark, []) == []


@pytest.mark.parametrize("target, want", [
    ("x", "http://a.b/c/x"), ("../x", "http://a.b/x"), ("../../../x", "http://a.b/x"), ("./x/./y/", "http://a.b/c/x/y/"), ("..", "http://a.b/"), (".", "http://a.b/c/"), ("/x/../y?z/../w", "http://a.b/y?z/../w"),
    ("//q.org/fr/", "http://q.org/fr/"), ("?z", "http://a.b/c/d?z"), ("#z", None), ("", None), (None, None), ("mailto:x", None), ("https://x.y/z", "https://x.y/z"), ("/", "http://a.b/"), ("x..y", "http://a.b/c/x..y"),
])
def test_targets(spark, target, want):
    df = spark.createDataFrame([("http://a.b/c/d?e#f", target)], "u string, t string")
    assert df.select(urlfilter.resolved(F.col("u"), F.col("t"))).first()[0] == want


def test_same_as_sql_where_pages_have_links(spark, rng):
    hosts = ["a.com", "b.org", "example.net", "x.net", "example.com", "M.example.COM", "c.de"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}/{rng.choice(['fr/', 'de/', 'en/', ''])}{i % 40}{rng.choice(['', '?q', '#f'])}" for i in range(160)]
    target = lambda: rng.choice([rng.choice(urls), "/fr/" + str(rng.randint(0, 40)), "7", "//x.net/1", "?q", "#top", "mailto:me"])
    page = lambda: rng.choice(["", "<p>no link</p>", link(target()), hop(target()), f"<link\nhref='{target()}'\nrel='canonical'>"])
    rows = [(i, u, page() * rng.randint(0, 2)) for i, u in enumerate(urls)] + [(900, None, link("http://x.net/")), (901, "no url", link("/1")), (902, "http://a.com/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert urlfilter.page_edges(df).count() > 50
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    got, want = urlfilter.judge(df).toPandas(), con.execute(OP8).fetchdf()
    assert canonical(got) == canonical(want)
    assert (got["rule"].isna() & (got["verdict"] == "block")).any()


def test_very_long_html(spark):
    html = "<p>text</p>" * 200_000 + link("http://x.net/1")
    assert judged(spark, [("http://a.com/1", html)])[0][3] == "block"
