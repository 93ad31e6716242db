"""Relative targets of canonical links."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from emberframe.llm import url_filters

BASES = ["http://h.org/a/b/c.html?q#f", "http://h.org/a/b/", "http://h.org/x", "http://h.org/"]
TARGETS = ["../x", "./x", "../../x", "../../../x", "x/../y", "x/./y/", "..", ".", "../", "./", "?p=1", "x?a=../b", "/a/../b", "/a/./b/..", "g;x=1/../y", "..g", "g..", "//o.org/a/../b", "http://o.org/a/b/../../c", "plain"]


def test_absolute(spark):
    rows = spark.createDataFrame([(b, t) for b in BASES for t in TARGETS], "base string, target string")
    got = {(r.base, r.target): r.url for r in rows.select("base", "target", url_filters.absolute(F.col("target"), F.col("base")).alias("url")).collect()}
    assert got == {(b, t): urljoin(b, t) for b in BASES for t in TARGETS}


def test_block_is_handed_on_by_relative_links(spark):
    link = "<link rel='canonical' href='%s'>"
    rows = [(1, "http://x.net/p/q/a", link % "../b"), (2, "http://x.net/p/b", link % "http://a.example.org/es/1"), (3, "http://y.net/c", link % "?p=1"), (4, "http://y.net/c?p=1", link % "http://a.example.org/es/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filters.judge(pages, url_filters.rule_table(spark)).collect()}
    assert got == dict.fromkeys(range(1, 5), "block")
