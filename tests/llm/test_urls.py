"""URL rules, templates and purity."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from larder.llm import queries, urls

RULES = queries.URL_RULES


def judged(spark, rows, rules=RULES, **more):
    schema = more.pop("schema", "page_id long, url string, html string, host string, `shape` int")
    return {r.page_id: r for r in urls.judged(spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, "h", 3) for r in rows], schema), rules, **more).collect()}


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://www.Example.COM/en/1?x#y": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://m.example.com/en/1": ("m.example.com", "/en/1", "example.com/en/", "block"),
        "https://badexample.com/en/1": ("badexample.com", "/en/1", "com/", "allow"),
        "x://example.com/e": ("example.com", "/e", "com/", "allow"),
        "http://com/": ("com", "/", "com/", "allow"),
        "http://a.net/es": ("a.net", "/es", None, "allow"),
        "http://a.net/es/": ("a.net", "/es/", "net/es/", "block"),
        "http://a.com": ("a.com", "", None, "allow"),
        "http://a.com?q=/en/": ("a.com", "", None, "allow"),
        "http://a.com#/": ("a.com", "", None, "allow"),
        "http://É.com/É": ("É.com", "/É", "com/", "allow"),
        "http://a.net://b/es/": ("a.net:", "//b/es/", None, "allow"),
        "a.net/es/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "://": ("", "", None, "allow"),
        "http://u@a.net:80/es/": ("u@a.net:80", "/es/", None, "allow"),
    }
    got = judged(spark, list(enumerate(cases)))
    assert {u: (got[i].host, got[i].path, got[i]["rule"], got[i].verdict) for i, u in enumerate(cases)} == cases


def test_a_long_url_an_empty_table_and_repeated_rows(spark):
    long = "http://a.org/" + "x/" * 50_000
    got = judged(spark, [(1, long), (None, "http://a.net/fr/1")])
    assert len(got[1].path) == 100_001 and got[1].template.endswith("/**") and got[None].verdict == "block"
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judged(empty, RULES).count() == 0
    twice = spark.createDataFrame([(1, "http://a.net/fr/1")] * 2, "page_id long, url string")
    assert [r.verdict for r in urls.judged(twice, RULES).collect()] == ["block"] * 2


def test_variable_segments_become_wildcards(spark):
    rows = [(i, f"http://h.org/user/name{chr(97 + i % 26)}{chr(97 + i // 26)}/post/{i}") for i in range(600)] + [(1000 + i, f"http://h.org/about/{i}") for i in range(40)]
    got = judged(spark, rows)
    assert {got[i].template for i in range(600)} == {"/user/*/post/{n}"}
    assert {got[1000 + i].template for i in range(40)} == {"/about/{n}"}
    assert judged(spark, [(1, "http://h.org/a/0123456789abcdef/1.html")])[1].template == "/*/{x}/{n}.html"


def labelled(spark, rows):
    """rows: (url, label)"""
    return judged(spark, [(i, u, str(y) if y is not None else None) for i, (u, y) in enumerate(rows)], rules=[], label=F.col("html").cast("int"))


def test_similar_branches_merge_and_lend_their_labels(spark):
    """Two branches of one form with the same rate of blocked pages merge, a third with another form does not."""
    rows = [(f"http://h.org/{b}/{i}.html", 1 if i % 10 < 7 else None) for b in ("spam", "scam") for i in range(100)]
    rows += [(f"http://h.org/news/{i}/{j}", 0) for i in range(10) for j in range(10)]
    got = labelled(spark, rows)
    assert {got[i].template for i in range(200)} == {"/{scam|spam}/{n}.html"} and {got[i].verdict for i in range(200)} == {"block"}
    assert {got[i].template for i in range(200, 300)} == {"/news/{n}/{n}"} and {got[i].verdict for i in range(200, 300)} == {"allow"}


def test_branches_of_other_rates_stay_apart(spark):
    rows = [(f"http://h.org/{b}/{i}", y) for b, y in (("bad", 1), ("good", 0), ("fine", 0)) for i in range(60)]
    got = labelled(spark, rows)
    assert [got[i].template for i in (0, 60, 120)] == ["/bad/{n}", "/{fine|good}/{n}", "/{fine|good}/{n}"]
    assert [got[i].verdict for i in (0, 60, 120)] == ["block", "allow", "allow"]


def test_few_labels_and_labels_of_a_minority_say_nothing(spark):
    few = [(f"http://a.org/x/{i}", 1) for i in range(urls.LEAST - 1)]
    part = [(f"http://b.org/x/{i}", 1 if i < 40 else None) for i in range(100)]
    clean = [(f"http://c.org/x/{i}", 0) for i in range(100)]
    assert {r.verdict for r in labelled(spark, few + part + clean).values()} == {"allow"}


def test_query_equals_sql_with_a_hot_host(spark, tmp_path):
    """Branches that merge, deep paths, and templates that the method rejects, held against the SQL."""
    rows, n = [], 0
    for host, branches in (("hot.example.net", (("es", 300), ("fr", 280), ("de", 70), ("en", 60))), ("b.example.org", (("a", 30), ("b", 31), ("c", 5))), ("www.x.com", (("en", 40),))):
        for b, k in branches:
            for i in range(k):
                rows.append((n, f"http://{host}/{b}/{i}" + ("/" if i % 7 == 0 else "") + (f"/a/b/c/{i}" if i % 11 == 0 and host[0] == "b" else "") + ("?q" if i % 3 else ""), "h"))
                n += 1
    rows += [(n, None, None), (n + 1, "no scheme", ""), (None, "http://hot.example.net/es/1", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op11_path_template_tree(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    run = con.execute(queries.ORACLE_SQL["op11_path_template_tree"])
    names = [c[0] for c in run.description]
    want = sorted(map(repr, run.fetchall()))
    assert sorted(repr(tuple(r[c] for c in names)) for r in got.collect()) == want
    by_method = got.where("rule is null and verdict = 'block'")
    assert by_method.count() > 0
