from helpers_llm import same
from pyspark.sql import functions as F

from simloom.llm import registry, urls


def test_oracle(spark, sf_dir):
    same(registry.op3_url_filters(spark, sf_dir), registry.ORACLES["op3_url_filters"], sf_dir)
    same(registry.url_alias_verdicts(spark, sf_dir), registry.ORACLES["url_alias_verdicts"], sf_dir)
    verdicts = registry.url_alias_verdicts(spark, sf_dir).groupBy((F.col("rule").isNull()).alias("free"), "verdict").count().collect()
    assert any(r.free and r.verdict == "block" for r in verdicts)


def test_links_by_the_book(spark):
    """The examples of normal and abnormal references of RFC 3986, 5.4, that lead to an address."""
    base = "http://a/b/c/d;p?q"
    want = {"g": "/b/c/g", "./g": "/b/c/g", "g/": "/b/c/g/", "/g": "/g", "?y": "/b/c/d;p?y", "g?y": "/b/c/g?y", "g?y/./x": "/b/c/g?y/./x", ";x": "/b/c/;x", "g;x?y#s": "/b/c/g;x?y#s", ".": "/b/c/", "./": "/b/c/", "..": "/b/", "../": "/b/", "../g": "/b/g", "../..": "/", "../../g": "/g", "../../../g": "/g", "/./g": "/g", "/../g": "/g", "g.": "/b/c/g.", "..g": "/b/c/..g", "./../g": "/b/g", "./g/.": "/b/c/g/", "g/./h": "/b/c/g/h", "g/../h": "/b/c/h"}
    rows = [(h, "http://a" + w) for h, w in want.items()] + [("//g", "http://g"), ("http://x/y/../z", "http://x/z"), ("mailto:a@b", None), ("#s", None)]
    df = spark.createDataFrame(rows, "href string, want string").withColumn("got", urls.resolved(F.col("href"), F.lit(base)))
    assert [(r.href, r.got) for r in df.collect() if r.got != r.want] == []


PAGES = [
    (1, "http://a.org/x", '<link rel="canonical" href="https://b.net/es/y?q=1">'),
    (2, "HTTP://B.NET/es/y#frag", None),
    (3, "http://c.org/1", "<META content='5; URL=/2' http-equiv=refresh>"),
    (4, "http://c.org/2#x", "<link href='//a.org/x' rel=canonical>"),
    (5, "http://d.org/a/b", "<link rel='canonical' href='c'>"),
    (6, "http://d.org/a/c", "<link rel=canonical href=http://shop.com/ok>"),
    (7, "http://shop.com/ok", "<link rel=canonical href=http://z.net/fr/1>"),
    (8, "http://z.net/fr/1", ""),
    (9, None, "<link rel=canonical href=http://z.net/fr/1>"),
    (10, "no scheme", "x"),
    (11, "http://example.com", "x"),
    (12, "http://example.com/en/1", "x"),
    (13, "http://www.example.com/en/1", "x"),
    (14, "http://notexample.com/en/1", "x"),
    (14, "http://notexample.com/en/1", "x"),
    (None, "http://x.net/es/", "x"),
    (15, "http://loop.org/", "<link rel=canonical href='http://loop.org/'>"),
    (16, "http://q.org/" + "p" * 50_000, "x"),
    (17, "http://r.org/p?id=1", "<link rel=canonical href='http://w.net/fr/a'>"),
    (18, "http://r.org/p?id=2", "x"),
    (19, "http://s.org/a/b/c?x", "<link rel=canonical href='../../t/./u'><link rel=canonical href='?k=1'><meta http-equiv=refresh content='0;url=http://w.net/fr/b'>"),
    (20, "http://s.org/t/u", "x"),
    (21, "http://s.org/a/b/c?k=1#z", "x"),
    (22, "http://s.org/a/b/c", "<link rel=canonical href='mailto:x@w.net'><link rel=canonical href='#top'>"),
    (23, "http://root.org", "<link rel=canonical href='http://w.net/fr/c'>"),
    (24, "http://root.org/", "x"),
]


def test_aliases_and_precedence(spark, tmp_path):
    df = spark.createDataFrame([(*p, "h", "p") for p in PAGES], "page_id long, url string, html string, host string, path string")
    got = urls.judge(df, registry.RULES).collect()
    by = {r.page_id: (r.rule, r.verdict) for r in got}
    assert len(got) == len(PAGES)
    # 1, 3 and 4 are aliases of a blocked address; 5 and 6 have both an allowed and a blocked one.
    assert [by[k][1] for k in (1, 3, 4, 5, 6)] == ["block", "block", "block", "allow", "allow"]
    assert by[2] == ("net/es/", "block") and by[7] == ("com/", "allow") and by[8] == ("net/fr/", "block")
    assert [by[k] for k in (9, 10, 11, 15, 16)] == [(None, "allow")] * 5
    assert by[12] == ("example.com/en/", "block") and by[13] == ("www.example.com/en/", "allow") and by[14] == ("com/", "allow")
    assert by[None] == ("net/es/", "block")
    # The query is part of an address; several links, dots and queries of links count; a fragment doesn't.
    assert [by[k][1] for k in (17, 18, 19, 20, 21, 22, 23, 24)] == ["block", "allow", "block", "block", "block", "allow", "block", "block"]
    assert urls.judge(df.limit(0), registry.RULES).count() == 0
    more = spark.createDataFrame([("http://loop.org/", "http://x.net/es/"), (None, "http://loop.org/")], "src string, dst string")
    assert {r.page_id: r.verdict for r in urls.judge(df, registry.RULES, more).collect()}[15] == "block"
    df.write.parquet(f"{tmp_path}/pages.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    rows = con.sql(registry.ORACLES["op3_url_filters"]).fetchall()
    cols = con.sql(registry.ORACLES["op3_url_filters"]).columns
    assert cols == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(repr, rows)) == sorted(repr((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got)
