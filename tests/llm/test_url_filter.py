import random
import time
from urllib.parse import urljoin

import duckdb

from lumenframe.llm import queries, url_filter
from lumenframe.llm.shared import components

PAGES = "page_id long, url string, html string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.index(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def rule_of(host, path, rules):
    fits = [(len(h + p), h + p, k) for k, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = ["http://example.org/es/a", "https://WWW.Example.ORG/en/1?x#y", "http://a.org", "http://a.org/", "ftp://x.com/fr/", "http://x.com/de/1", "http://xcom/de/", "http://example.com#f://g", "no scheme", "", None, "http://é.com/de/ü", "http://a.net/p?q=://b.org/", "://org/", "http://org:80/"]


def test_rules(spark):
    rows = [(i, u, "<p>") for i, u in enumerate(URLS)]
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_urls(spark.createDataFrame(rows, PAGES), queries.URL_RULES).collect()}
    for i, u, _ in rows:
        host, path = split(u)
        rule, kind = rule_of(host, path, queries.URL_RULES)
        assert got[i] == (host, path, rule, kind or "allow"), u


def test_blocks_reach_aliases_but_allow_comes_first(spark):
    def link(target):
        return f"<html><LINK href='{target}' data-x=1 Rel=canonical></html>"

    pages = [
        (1, "http://a.net/1", link("http://x.com/de/9")),
        (2, "http://a.net/2", link("/1")),
        (3, "http://a.net/3#top", '<meta http-equiv="refresh" content="0; URL=http://a.net/2?k=1&amp;l=2">'),
        (4, "HTTP://A.net/2?k=1&l=2", link("1")),
        (5, "http://b.net/1", link("http://x.com/de/8")),
        (6, "http://b.net/2", link("http://x.com/fr/8") + link("")),
        (7, "http://b.net/2#again", '<meta content="5;url=//b.net/1" http-equiv=refresh>'),
        (8, "http://c.net/", '<link rel="stylesheet" href="http://x.com/de/1">'),
        (9, "http://example.org/es/", link("http://ok.org/")),
        (10, None, link("http://x.com/de/1")),
        (11, "http://d.net/", None),
    ]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(spark.createDataFrame(pages, PAGES).repartition(3), queries.URL_RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "allow", 11: "allow"}


def test_given_edges(spark):
    pages = [(i, f"http://h.net/{i}", "") for i in range(6)] + [(6, "http://y.com/de/", ""), (0, "http://h.net/0", "")]
    edges = [(f"http://h.net/{i}", f"http://h.net/{i + 1}") for i in range(4)] + [("http://h.net/4", "http://y.com/de/"), (None, "http://h.net/5"), ("bad", "http://h.net/5")]
    rows = url_filter.judge_urls(spark.createDataFrame(pages, PAGES), queries.URL_RULES, spark.createDataFrame(edges, "a string, b string")).collect()
    assert sorted((r["page_id"], r["verdict"]) for r in rows) == [(0, "block"), (0, "block"), *((i, "block") for i in range(1, 5)), (5, "allow"), (6, "block")]


def test_relative_targets(spark):
    base = "http://h.net/a/b?q"
    targets = ["c", "/c", "//o.net/c", "?z", "http://o.net/"]
    pages = [(i, base, f'<link rel="canonical" href="{t}">') for i, t in enumerate(targets)]
    edges = {r["b"] for r in url_filter.link_edges(spark.createDataFrame(pages, PAGES)).collect()}
    assert edges == {urljoin(base, t) for t in targets}


def test_empty(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], PAGES), queries.URL_RULES).collect() == []


def test_components_of_long_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5000, 5000), (None, 7), (7, None), (6001, 6000), (6001, 6000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1300)} | {6000: 6000, 6001: 6000}
    assert got == want


def test_the_main_path_is_native(spark):
    plan = url_filter.judge_urls(spark.createDataFrame([(1, "http://a.org/", "<p>")], PAGES), queries.URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_all_links_of_a_page_count(spark):
    html = (
        "<link rel=canonical href=\"\"><link rel=canonical href='https://b.org/1'><link href=https://c.org/2 rel=canonical>"
        "<meta http-equiv=refresh content='0; url=https://d.org/3'><meta http-equiv=refresh content='5; url=https://e.org/4'>"
    )
    pages = spark.createDataFrame([(1, "https://a.org/", html), (2, "https://c.org/2", ""), (3, "https://e.org/4", "")], "page_id long, url string, html string")
    edges = {(r["a"], r["b"]) for r in url_filter.link_edges(pages).collect()}
    assert edges == {("https://a.org/", t) for t in ("https://b.org/1", "https://c.org/2", "https://d.org/3", "https://e.org/4")}
    judged = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, [("block", "a.org", "/")]).collect()}
    assert judged == {1: "block", 2: "block", 3: "block"}


def targets(spark, *html):
    rows = [(i, "http://h.net/p", x) for i, x in enumerate(html)]
    return sorted(r["target"] for r in url_filter.link_targets(spark.createDataFrame(rows, PAGES)).collect())


def test_only_links_of_the_page_itself_count(spark):
    assert targets(spark, '<link rel="alternate canonical" href="/a">', "<LINK HREF=/b REL='Canonical'>") == ["/a", "/b"]
    assert targets(spark, '<link rel=canonical href=/c data-href=/x>', '<link data-href="/x" rel=canonical href="/d">') == ["/c", "/d"]
    assert targets(spark, '<!-- <link rel=canonical href="/x"> --><link rel=canonical href=/e>', "<!-- <link rel=canonical href=/x>") == ["/e"]
    assert targets(spark, "<script>'<link rel=canonical href=/x>'</script><link rel=canonical href=/f><style><!--</style>") == ["/f"]
    assert targets(spark, '<link title="a rel=canonical" rel=next href="/x">', "<linkx rel=canonical href=/x>", "<link rel=canonical-x href=/x>") == []
    assert targets(spark, "<meta http-equiv=refresh content=\"0;URL='/g'\">", '<meta content="5 ; url = /h" http-equiv="Refresh">', '<meta name=refresh content="0;url=/x">') == ["/g", "/h"]
    assert targets(spark, '<link rel=canonical\nhref\n=\n"/i">', "<link rel='canonical' href=''>", "<link rel=canonical>", None, "") == ["/i"]


def test_hostile_pages_take_linear_time(spark):
    hostile = ["<link rel=canonical ", "<link ", "<!--", "<link rel=canonical href=x", "<script", "<meta http-equiv=refresh content=\"", "<link a='", '<link a=" ', "<link rel = ", "url=  "]
    targets(spark, "warm up")
    for text in hostile:
        began = time.time()
        assert targets(spark, (text * (1_000_000 // len(text))) + "<link rel=canonical href=/z>")[-1:] in ([], ["/z"])
        assert time.time() - began < 20, text
    whole = "<link rel=canonical " + "a " * 500_000 + "href=/z>"
    assert targets(spark, whole) == ["/z"]


def test_aliases_against_sql(spark):
    rng = random.Random(11)
    hosts = [*(f"h{i}.net" for i in range(12)), "example.org", "x.com", "y.com"]
    paths = ["/", "/es/1", "/en/1", "/fr/2", "/de/3", "/p", "/q", "/r"]
    every = [f"http://{h}{p}" for h in hosts for p in paths]
    form = ['<link rel=canonical href="{}">', "<meta http-equiv=refresh content='0; url={}'>", "<link href={} rel='nofollow canonical'>"]
    pages, links = [], []
    for i in range(90):
        url = rng.choice(every)
        out = [rng.choice(every) for _ in range(rng.choice([0, 1, 1, 2]))] if i % 2 else []
        pages.append((i, url, "<p>" + "".join(rng.choice(form).format(t) for t in out)))
        links += [(url, t) for t in out]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    con.execute("CREATE TABLE links (a VARCHAR, b VARCHAR)")
    con.executemany("INSERT INTO links VALUES (?, ?)", links)
    rules = ", ".join(f"('{k}', '{h}', '{p}')" for k, h, p in queries.URL_RULES)
    sql = f"""WITH RECURSIVE u AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT a FROM links UNION ALL SELECT b FROM links)),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
r AS (SELECT url AS node, url AS reached FROM u UNION SELECT node, b FROM r JOIN e ON reached = a),
v(kind, h, p) AS (VALUES {rules}),
o AS (SELECT url, arg_max(kind, length(h || p)) AS own FROM u JOIN v ON (split_part(split_part(url, '://', 2), '/', 1) = h OR split_part(split_part(url, '://', 2), '/', 1) LIKE '%.' || h) AND starts_with(substr(split_part(url, '://', 2), strpos(split_part(url, '://', 2), '/')), p) GROUP BY url),
s AS (SELECT node, min(own) AS shared FROM r JOIN o ON reached = o.url GROUP BY node)
SELECT page_id, coalesce(own, shared, 'allow') FROM pages LEFT JOIN o USING (url) LEFT JOIN s ON node = pages.url ORDER BY page_id"""
    want = con.execute(sql).fetchall()
    got = url_filter.judge_urls(spark.createDataFrame(pages, PAGES).repartition(4), queries.URL_RULES).select("page_id", "verdict").collect()
    assert sorted(tuple(r) for r in got) == want
    plain = url_filter.judge_urls(spark.createDataFrame([(i, u, "") for i, u, _ in pages], PAGES), queries.URL_RULES).select("page_id", "verdict").collect()
    assert sorted(tuple(r) for r in plain) != want
