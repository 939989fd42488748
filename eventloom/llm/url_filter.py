"""URL filters with redirect equivalence, in DataFrame functions alone.

A rule (host, path, allow or block) fits a url of its host or a subdomain whose
path starts with the rule's; of several that fit the longest decides.  Urls
without a rule are judged by their aliases: redirects and canonical links are the
edges of a graph whose connected components are found over all pages.  A component
with an explicitly allowed url is allowed, else one with a blocked url is blocked;
what remains is allowed.

Defined results: a null url, or one without ``://``, has an empty host and path,
no alias, no rule (unless a rule has an empty host) and is allowed; null or empty
html has no edge; repeated rows are each judged; rules that fit and are equally
long are ordered by host, then path, allow first.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .tables import settle


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    action: str


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def decide(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct (rule, action); null if none does.  The rules are part of the plan: thousands at most."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host, r.path, r.action != "allow")):
        # Later rules are asked first.
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.action).alias("action"))).otherwise(out)
    return out


def node_of(url: Column) -> Column:
    """What two names of one document share: host, path and query; null without a host."""
    query = F.coalesce(F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def resolve(link: Column, base: Column) -> Column:
    """The absolute url of a link in a page."""
    origin = F.regexp_extract(base, r"^([\s\S]*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([\s\S]*?://[^/?#]*(?:[^?#]*/)?)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(origin, path_of(base), link))
        .otherwise(F.concat(folder, F.when(folder.endswith("/"), F.lit("")).otherwise(F.lit("/")), link))
    )


def page_links(page: Column) -> Column:
    """Canonical links and redirects that a page's html states."""
    value = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""

    def attr(tag: Column, name: str) -> Column:
        return F.concat(*(F.regexp_extract(tag, rf"(?is)\b{name}{value}", k) for k in (1, 2, 3)))

    links = F.filter(F.regexp_extract_all(page, F.lit(r"(?is)<link\b[^>]*>"), 0), lambda t: F.array_contains(F.split(F.lower(attr(t, "rel")), r"\s+"), "canonical"))
    metas = F.filter(F.regexp_extract_all(page, F.lit(r"(?is)<meta\b[^>]*>"), 0), lambda t: F.lower(attr(t, "http-equiv")) == "refresh")
    to = F.concat(F.transform(links, lambda t: attr(t, "href")), F.transform(metas, lambda t: F.regexp_extract(attr(t, "content"), r"(?i)url\s*=\s*['\"]?([^'\"]*)", 1)))
    to = F.filter(F.transform(to, lambda x: F.trim(F.replace(x, F.lit("&amp;"), F.lit("&")))), lambda x: x != "")
    return F.when(page.rlike("(?i)canonical|refresh"), to)


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, *, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Returns ``key``, host, path, rule and verdict of every page.  ``redirects``: further edges (from_url, to_url)."""
    rows = pages.select(pages[key].alias("key"), pages[url].cast("string").alias("url"), pages[page].cast("string").alias("html"))
    found = rows.select("url", F.explode(page_links(F.col("html"))).alias("link"))
    edges = found.select(node_of(F.col("url")).alias("a"), node_of(resolve(F.col("link"), F.col("url"))).alias("b"))
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("from_url")), node_of(F.col("to_url"))))
    edges = settle(edges.where("a <> b").distinct(), "aliases")
    judged = rows.select("key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    judged = judged.withColumn("own", decide(F.col("host"), F.col("path"), rules))
    if edges.isEmpty():
        judged = judged.withColumn("shared", F.lit(None).cast("string"))
    else:
        roots = connected_components(edges)
        host = F.regexp_extract("node", r"^([^/?]*)", 1)
        acts = roots.withColumn("act", decide(host, F.regexp_extract("node", r"^[^/?]*([^?]*)", 1), rules)["action"]).where("act is not null")
        # Text order puts allow before block.
        shared = roots.join(acts.groupBy("root").agg(F.min("act").alias("shared")), "root").select("node", "shared")
        judged = judged.join(shared, "node", "left")
    return judged.select(F.col("key").alias(key), "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.action", "shared", F.lit("allow")).alias("verdict"))
