"""URL filters: rules for host and path, and redirect equivalence.

A rule ``host/path`` fits its host and all subdomains if the url's path starts with the rule's path; the longest rule
wins. URLs that stand for the same page (canonical links and refresh redirects found in the pages, and any redirect
table given) form components; a page without a rule of its own takes the decision of its component: blocked if the
component holds a blocked url and no allowed one. An explicit allow thus goes before any block that is handed on.
All work is DataFrame operations; components are distributed, nothing of them reaches the driver.

Defined results: a null url or one without ``://`` has an empty host and path, no rule and the verdict allow. Rows that
repeat a url get the same verdict. Urls of any length are read whole. Rules of equal length: the longer host, then allow. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .components import components

#: Rules as (action, host and path).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ://, else an empty text."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The url as a node of the graph: scheme and host in lower case, no fragment, an empty path as /; null without ://."""
    top = F.translate(F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), _UPPER, _LOWER)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(top != "", F.concat(top, F.when(rest.startswith("/"), "").otherwise("/"), rest))


def _no_dots(path: Column) -> Column:
    """A path without its . and .. segments, by RFC 3986 (5.2.4)."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), none,
        lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(x == ".", out).otherwise(F.concat(out, F.array(x))),
    )
    end = F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), end)).otherwise(path)


def absolute(target: Column, base: Column) -> Column:
    """A link's target seen from base, by RFC 3986 (5.2.2); a target with a host keeps its path as written, as urls of pages do."""
    own = F.regexp_extract(target, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//.*", 0)
    scheme = F.regexp_extract(base, r"^[^:]*:", 0)
    top = F.regexp_extract(base, r"^[^:]*://[^/?#]*", 0)
    folder = F.regexp_replace(F.regexp_extract(base, r"^[^:]*://[^/?#]*(?:/(?:[^?#]*/)?)?", 0), "([^/])$", "$1/")
    whole = (
        F.when(own.startswith("//"), F.concat(scheme, own))
        .when(own != "", own)
        .when(target.startswith("/"), F.concat(top, target))
        .when(target.startswith("?"), F.concat(F.regexp_extract(base, r"^[^:]*://[^?#]*", 0), target))
        .when(target.startswith("#"), F.concat(F.regexp_extract(base, r"^[^#]*", 0), target))
        .otherwise(F.concat(folder, target))
    )
    cut_at = r"(?s)^([^:]*://[^/?#]*)([^?#]*)(.*)$"
    part = lambda k: F.regexp_extract(whole, cut_at, k)
    return F.when((own == "") & whole.rlike(cut_at), F.concat(part(1), _no_dots(part(2)), part(3))).otherwise(whole)


def page_links(pages: DataFrame) -> DataFrame:
    """u, v: a page's node and that of its canonical link or refresh target, for pages(url, html)."""
    html = F.col("html")
    may = pages.where(html.rlike(r"(?i)<link[^>]+canonical|<meta[^>]+refresh"))
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>", "")
    tags = may.select("url", F.explode(F.regexp_extract_all(bare, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"))
    quoted = r"""\s*=\s*["']?\s*"""
    canonical = F.when(F.col("tag").rlike(rf"(?is)^<link\b.*\brel{quoted}canonical\b"), F.regexp_extract("tag", rf"""(?is)\bhref{quoted}([^"'\s>]+)""", 1))
    refresh = F.when(F.col("tag").rlike(rf"(?is)^<meta\b.*\bhttp-equiv{quoted}refresh\b"), F.regexp_extract("tag", r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>]+)""", 1))
    links = tags.select("url", F.coalesce(canonical, refresh).alias("target")).where("target <> ''")
    links = links.select("url", F.replace("target", F.lit("&amp;"), F.lit("&")).alias("target")).select("url", absolute(F.col("target"), F.col("url")).alias("target"))
    return links.select(node_of(F.col("url")).alias("u"), node_of(F.col("target")).alias("v")).where("u <> v")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """node, rule, action for the nodes of urls(node) that a rule(action, rule) fits."""
    labels = F.split("host", r"\.", -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = urls.select("node", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    parts = parts.select("node", "path", F.explode(ends).alias("end"))
    told = rules.select(
        "action", "rule", F.translate(F.substring_index("rule", "/", 1), _UPPER, _LOWER).alias("end"),
        F.regexp_extract("rule", r"^[^/]*(.*)", 1).alias("start"),
    )
    fits = parts.join(told, "end").where(F.col("path").startswith(F.col("start")))
    best = F.struct(F.length("rule"), F.length("end"), (F.col("action") == "allow"), F.col("rule"), F.col("action"))
    return fits.groupBy("node").agg(F.max(best).alias("best")).select("node", F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """A list of rules as a literal relation: its size is known to the planner, which broadcasts it, and never the pages, below its threshold."""
    if not rules:
        return spark.sql("SELECT '' AS action, '' AS rule WHERE false")
    marks = ", ".join(f"(:a{i}, :r{i})" for i in range(len(rules)))
    args = {f"{k}{i}": x for i, rule in enumerate(rules) for k, x in zip("ar", rule, strict=True)}
    return spark.sql(f"SELECT * FROM VALUES {marks} AS t(action, rule)", args=args)


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """One row per row of pages(page_id, url, html): page_id, host, path, rule, verdict.

    redirects: further edges as (source, target) urls.
    """
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("source")), node_of(F.col("target"))))
    edges = written(edges.where("u is not null and v is not null").distinct(), "url-edges")
    # a rule is judged on the page's own path, which an empty path written as / would change
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = matched(rows.select(F.concat(F.lit("x://"), "host", "path").alias("node")).distinct(), rules)
    out = rows.withColumn("node", F.concat(F.lit("x://"), "host", "path")).join(own, "node", "left").drop("node")
    verdict = F.coalesce("action", F.lit("allow"))
    if not edges.isEmpty():
        member = components(edges)
        told = matched(member.select("node"), rules)
        blocked = F.bool_or(F.col("action") == "block") & ~F.bool_or(F.col("action") == "allow")
        handed = member.join(told, "node").groupBy("component").agg(blocked.alias("blocked")).where("blocked")
        aliases = member.join(handed, "component").select("node", F.lit(True).alias("by_alias"))
        out = out.withColumn("node", node_of(F.col("url"))).join(aliases, "node", "left").drop("node")
        verdict = F.coalesce("action", F.when(F.col("by_alias"), "block"), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
