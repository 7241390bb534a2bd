"""URL filters with redirect equivalence.

A rule ``(action, host, path)`` fits its host and all subdomains where the url's path starts
with the rule's; the longest wins. Urls that no rule fits take the verdict of their alias
component: redirect (meta refresh) and canonical-link edges are undirected, and a component
with an explicitly allowed member is allowed, else blocked if a member is blocked, else allowed.

Targets of links are resolved against the page's url (``//host/x``, ``/x``, ``x``, ``?x``; ``.`` and ``..`` parts are taken out).

Defined cases: a null url or one without ``://`` has empty host and path and no rule, links nothing and is
allowed; null html has no edges; repeated rows are judged each; of rules that tie an allowing one wins, in rules of equal length as in
components; very long html is searched whole; an empty table gives none. Only ``page_id``, ``url`` and ``html`` are
read, whatever other columns are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import Scratch
from siftwell.llm.graph import connected_components

Rule = tuple[str, str, str]
#: Rules of the registered query: action, host, path.
RULES: tuple[Rule, ...] = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    u = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(u, r"(?s)^.*?://(.*)\z", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER_AZ, LOWER_AZ)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The longest fitting rule's text and action, else nulls; of equally long ones an allowing one first."""
    best, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", r[1])):
        fits = (host.eqNullSafe(h) | host.endswith("." + h)) & path.startswith(p)
        best, action = F.when(fits, h + p).otherwise(best), F.when(fits, act).otherwise(action)
    return best, action


def without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` parts."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"),
        lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))),
    )
    open_end = F.when(path.rlike(r"/\.{1,2}\z") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.rlike(r"/\.{1,2}(/|\z)"), F.concat(F.lit("/"), F.array_join(kept, "/"), open_end)).otherwise(path)


def resolved(url: Column, target: Column) -> Column:
    """The absolute form of a link's target on a page; null where there is none."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    page = F.regexp_extract(url, r"(?s)^([^?#]*)", 1)
    folder = F.regexp_extract(F.substring(page, F.length(site) + 1, 1 << 30), r"(?s)^(.*/)", 1)
    path = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    rest = F.substring(target, F.length(path) + 1, 1 << 30)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(target.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when((site == "") | (target == "") | target.startswith("#") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("?"), F.concat(page, target))
        .when(target.startswith("/"), F.concat(site, without_dots(path), rest))
        .otherwise(F.concat(site, without_dots(F.concat(folder, path)), rest))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """``(url, target)`` from canonical links and refresh redirects in ``pages(url, html)``."""
    tags = F.when(
        F.col("html").rlike(r"(?i)canonical|http-equiv"),
        F.regexp_extract_all(F.col("html"), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0)),
    ).otherwise(F.array().cast("array<string>"))
    t = pages.where("url is not null and html is not null").select("url", F.explode(tags).alias("tag"))
    canonical = F.when(F.col("tag").rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?canonical\b"), F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.when(F.col("tag").rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract("tag", r"(?is)\burl\s*=\s*['\"]?([^\"'\s>;]+)", 1))
    return t.select("url", resolved(F.col("url"), F.coalesce(canonical, refresh)).alias("target")).where("target is not null")


def node(url: Column) -> Column:
    """A url's node: host, path and query; scheme and fragment don't matter."""
    host, path = host_path(url)
    return F.when(host != "", F.concat(host, path, F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, edges: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages(page_id, url, html)``.

    ``edges(url, target)`` adds redirects known from elsewhere, such as crawl logs.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    host, path = host_path(F.col("url"))
    rule, action = rule_of(host, path, rules)
    p = pages.select("page_id", "url", host.alias("host"), path.alias("path"), rule.alias("rule"), action.alias("action"))
    links = page_edges(pages.select("url", "html"))
    if edges is not None:
        links = links.union(edges.select("url", "target"))
    links = scratch.save(links, "links")
    ends = links.select(F.explode(F.array("url", "target")).alias("url")).where("url is not null").distinct()
    h, q = host_path(F.col("url"))
    decided = ends.select(node(F.col("url")).alias("node"), rule_of(h, q, rules)[1].alias("action")).where("action is not null")
    cc = scratch.save(connected_components(links.select(node(F.col("url")).alias("a"), node(F.col("target")).alias("b")), scratch), "aliases")
    # "allow" sorts before "block": the least action is the one that takes precedence
    spread = cc.join(decided, "node").groupBy("component").agg(F.min("action").alias("alias_action"))
    verdicts = cc.join(spread, "component").select(F.col("node").alias("_node"), "alias_action")
    out = p.withColumn("_node", node(F.col("url"))).join(verdicts, "_node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", "alias_action", F.lit("allow")).alias("verdict"))
