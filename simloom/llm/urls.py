"""URL rules and their spread over redirect and canonical-link aliases.

Addresses are nodes named by host, path and query. A page's own address is joined by an edge to the targets of its
canonical links and of its refresh redirects; further redirect edges can be given. Addresses of one connected
component are aliases. A page that a rule fits gets the rule's verdict. Of the others, a page is blocked if an
alias is blocked by a rule and none is allowed by one; else it is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    allow: bool
    host: str
    path: str


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased from A to Z, and path without query and fragment; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    host, path = (F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k) for k in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def verdict_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``struct<rule string, allow boolean>`` of the longest rule that fits, null if none does; allow wins a tie."""
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), not r.allow))
    none = F.lit(None).cast("struct<rule:string,allow:boolean>")

    def longest(x: Column) -> Column:
        fit = lambda r: ((x["host"] == r.host) | F.endswith(x["host"], F.lit("." + r.host))) & F.startswith(x["path"], F.lit(r.path))
        return F.coalesce(*(F.when(fit(r), F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.allow).alias("allow"))) for r in ordered), none)

    # Through an array of one, so that host and path are computed once and not again for each rule.
    return F.transform(F.array(F.struct(host.alias("host"), path.alias("path"))), longest)[0]


def address(url: Column) -> Column:
    """Host, path and query of ``url`` as one string without a fragment, empty without ``://``. A path is never empty."""
    host, path = host_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)
    return F.when(host == "", "").otherwise(F.concat(host, F.when(path == "", "/").otherwise(path), query))


def without_dots(path: Column) -> Column:
    """``path`` with ``.`` segments taken out, and ``..`` segments with the one before each."""
    ended = F.when(path.rlike(r"/\.\.?$"), F.concat(path, F.lit("/"))).otherwise(path)

    def step(acc: Column, segment: Column) -> Column:
        up = F.regexp_replace(acc, r"/[^/]*$", "")
        return F.when(segment == "..", up).when(segment == ".", acc).otherwise(F.concat(acc, F.lit("/"), segment))

    inner = F.aggregate(F.split(F.substring(ended, 2, 1 << 30), "/", -1), F.lit(""), step)
    return F.when(path.rlike(r"/\.\.?(/|$)"), inner).otherwise(path)


def resolved(href: Column, url: Column) -> Column:
    """The absolute form of a link found on the page at ``url``; null for one that leads to no address."""
    scheme = F.regexp_extract(url, r"^([^:/?#]*)://", 1)
    site = F.regexp_extract(url, r"^([^:/?#]*://[^/?#]*)", 1)
    page = F.regexp_extract(url, r"^([^:/?#]*://[^?#]*)", 1)
    folder = F.regexp_extract(url, r"^([^:/?#]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    whole = (
        F.when(F.contains(href, F.lit("://")) & href.rlike(r"^[^/?#]*://"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("#") | href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("?"), F.concat(page, href))
        .otherwise(F.concat(folder, href))
    )
    part = lambda k: F.regexp_extract(whole, r"(?s)^([^:/?#]*://[^/?#]*)([^?#]*)(.*)$", k)
    return F.concat(part(1), without_dots(part(2)), part(3))


CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]*)"
GOES_TO = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]*)"


def link_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst)`` addresses: each page's own url and what its canonical links and refresh redirects point to."""
    targets = lambda tag, p: F.transform(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda x: F.trim(F.regexp_extract(x, p, 1)))
    found = pages.where(F.contains("url", F.lit("://")) & F.col("html").rlike(r"(?i)canonical|refresh"))
    found = found.select("url", F.explode(F.concat(targets(CANONICAL, HREF), targets(REFRESH, GOES_TO))).alias("href")).where("href <> ''")
    return found.select(F.col("url").alias("src"), resolved(F.col("href"), F.col("url")).alias("dst"))


def judge(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``pages(page_id, url, html)``: page_id, host, path, rule, verdict.

    Urls are aliases of others by host, path and query; an empty path counts as ``/`` there. ``redirects(src, dst)``
    adds edges between absolute urls; null ends are ignored. A null url, or one without
    ``://``, has an empty host and path, fits no rule of a named host and has no aliases. Null html has no
    links. Repeated rows are judged each; other columns are ignored; an empty table gives no rows.
    """
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("src", "dst"))
    named = edges.select(address(F.col("src")).alias("a"), address(F.col("dst")).alias("b"))
    aliases = components(named.where("a <> '' and b <> ''"))

    host, path = host_path(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"), address(F.col("url")).alias("node"))
    own = own.withColumn("own", verdict_of(F.col("host"), F.col("path"), rules))
    # A component's decision: allow if a rule allows an alias, else block if a rule blocks one.
    parts = lambda k: F.regexp_extract("node", r"(?s)^([^/]*)([^?]*)", k)
    hit = aliases.withColumn("v", verdict_of(parts(1), parts(2), rules))
    decided = hit.where("v is not null").groupBy("component").agg(F.bool_or("v.allow").alias("allowed"))
    blocked = aliases.join(decided.where("not allowed"), "component").select("node")
    out = own.join(blocked.withColumn("blocked", F.lit(True)), "node", "left")
    allow = F.coalesce(F.col("own.allow"), ~F.coalesce("blocked", F.lit(False)))
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.when(allow, "allow").otherwise("block").alias("verdict"))
