"""Main text of web pages by a style tree for each site.

All pages of a host are merged: elements with one path of tags, ids and classes are
one node of the site's tree.  A node has presentation styles (the sequences of
children it is written with) and contents (the texts that stand in it).  Its
presentation importance is the entropy of its styles; its content importance is 1
less the mean normalised entropy of its texts over the pages, so texts of one page
alone count 1 and texts that come again on page after page near 0.  Text that is
mostly links counts against a node.  These are summed as log odds, and what the
path's names say (an article, or a menu, an advert, comments, ...) is a prior beside
them, which they can outweigh: a list of links that repeats goes from an article, and
a name of noise around nearly all of a site's text (a form around the page) says
nothing there.  On sites that mark their article, what stands outside it under names
that say nothing has the odds against it.  Branches of negative odds are removed from
each page; what stays is its text.

What is gathered of a site is counts of hashes, summed before any row meets the
others of its host.  To its pages come back only the paths that the tree decides
otherwise than their names say.

Defined results: null and empty pages, and pages without any branch left, have the
empty text and 0 characters; a null url's host is the empty one; repeated rows are
each extracted, but are one page of their host's tree.  Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import settle

#: Log odds: of a text of one page alone (and less it, of one on all pages), of styles of full entropy, of text that is all links.
CONTENT, PRESENTATION, LINKS = 2.0, 0.5, -2.5
#: Log odds that names give, and those of a nameless node outside the article of a site that marks it.
NOISE, PLAIN, MAIN = 0, 1, 2
NAMES, OUTSIDE = (-2.8, 0.0, 2.6), -2.2
#: Share of a site's text from which a name of noise says nothing, and a marked article is its main part.
WRAPPER, MARKED = 0.9, 0.5

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[a-zA-Z/!?][^>]*(?:>|\Z)", re.S)
MARK = re.compile(r"\b(?:id|class|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
RAW = frozenset("script style noscript template textarea iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end an open one of the same set, as pages leave out end tags.
ENDS = {t: k for k, ts in enumerate(("p", "li", "dt dd", "tr", "td th", "option", "thead tbody tfoot")) for t in ts.split()}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
NOISE_TAGS = frozenset("nav footer aside form menu button select dialog head title".split())
MAIN_TAGS = frozenset("article main".split())
NOISE_NAME = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|menu|nav\w*|breadcrumbs?|sidebar|side|widget|footer|header|masthead|cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|signup|login|search|share|social|related|recommended|comments?|replies|reply|discussion|disqus|respond|pagination|pager|legal|copyright)(?:$|[-_\s])", re.I)
MAIN_NAME = re.compile(r"(?:^|[-_\s])(?:article|content|main|post|entry|story|body-text)(?:$|[-_\s\d])", re.I)


def _label(tag: str, attrs: str) -> tuple[str, int]:
    """An element's name in a path, and what it says."""
    names = " ".join(sorted({m.strip("\"'") for m in MARK.findall(attrs)})) if "=" in attrs else ""
    names = re.sub(r"\d+", "#", names)
    label = f"{tag}[{names}]" if names else tag
    if tag in NOISE_TAGS or names and NOISE_NAME.search(names):
        return label, NOISE
    if tag in MAIN_TAGS or names and MAIN_NAME.search(names):
        return label, MAIN
    return label, PLAIN


class Node(NamedTuple):
    """An element's place in the tree: paths are hashes, so depth costs nothing."""

    path: int
    kind: int
    #: The outermost element of a noisy name around it, or 0, and its kind without that one.
    outer: int
    inner: int
    heading: bool


ROOT = Node(0, PLAIN, 0, PLAIN, False)


def _hash(s: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(s, seed) - (1 << 63)


def _below(up: int, own: int) -> int:
    """A noisy name anywhere above, or this one, wins; then one of an article."""
    return NOISE if NOISE in (up, own) else max(up, own)


def blocks(page: str, seen: Counter | None = None) -> Iterator[tuple[Node, str, float]]:
    """(node, text, share of links) of the blocks of a page in order; seen: counts (node, style) of its elements."""
    stack: list[list] = []  # tag, node, hash of the children, last child
    text: list[str] = []
    at, n, in_link, linked, whole = 0, len(page), False, 0, 0
    labels: dict[tuple[str, str], tuple[str, int]] = {}

    def add(segment: str) -> None:
        nonlocal linked, whole
        text.append(segment)
        size = len(segment.strip())
        whole += size
        linked += size * in_link

    def flush() -> Iterator[tuple[Node, str, float]]:
        nonlocal linked, whole
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            text.clear()
            share, linked, whole = linked / max(whole, 1), 0, 0
            if joined:
                yield (stack[-1][1] if stack else ROOT), joined, share

    def close(k: int) -> None:
        while len(stack) > k:
            _, node, style, _ = stack.pop()
            if seen is not None:
                seen[node, style] += 1

    def child(label: str) -> None:
        if stack and stack[-1][3] != label:
            stack[-1][2], stack[-1][3] = _hash(label, stack[-1][2] & (1 << 64) - 1), label

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not m[1]:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not m[1]
            if not m[1]:
                child(tag)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                text.append(" ")
            continue
        yield from flush()
        if m[1]:
            in_link = False
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if k is not None:
                close(k)
            continue
        if tag in CLOSES_P and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if tag in ENDS and stack and ENDS.get(stack[-1][0]) == ENDS[tag]:
            close(len(stack) - 1)
        found = labels.get((tag, m[3]))
        if found is None:
            found = labels[tag, m[3]] = _label(tag, m[3])
        label, kind = found
        up = stack[-1][1] if stack else ROOT
        if tag == "header" and kind == PLAIN and up.kind != MAIN:
            kind = NOISE  # of the site; an article's own has its title
        child(label)
        path = _hash(label, up.path & (1 << 64) - 1)
        if up.outer:
            node = Node(path, NOISE, up.outer, _below(up.inner, kind), tag == "h1")
        elif kind == NOISE:
            node = Node(path, NOISE, path, up.kind, tag == "h1")
        else:
            node = Node(path, both := _below(up.kind, kind), 0, both, tag == "h1")
        stack.append([tag, node, 0, None])
    yield from flush()
    close(0)


def odds(content, style, links, names):
    """Log odds that a node's text is the page's own; numbers or columns."""
    return CONTENT * (2 * content - 1) + PRESENTATION * style + LINKS * links + names


def host_of(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^.*?://([^/?#]*)", 1)), F.lit(""))


def site_trees(rows: DataFrame) -> DataFrame:
    """(host, wrappers, marked, cut, kept) from rows (host, html); equal pages of a host count once.

    wrappers: noisy names that say nothing there; marked: whether the site marks its
    article; cut and kept: the paths that are decided against what their names say.
    """
    rows = rows.where("html <> ''").withColumn("page", F.xxhash64("html"))
    fields = {"host": pa.string(), "path": pa.int64(), "content": pa.bool_(), "value": pa.int64(), "page": pa.int64(), "size": pa.int64(), "links": pa.float64(), "kind": pa.int32(), "outer": pa.int64(), "inner": pa.int32(), "heading": pa.bool_()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for host, page, copy in zip(*(b.column(i).to_pylist() for i in range(3))):
                seen: Counter = Counter()
                texts = {(node.path, _hash(t)): (node, len(t), links) for node, t, links in blocks(page, seen)}
                out += [(host, path, True, h, copy, size, links, node.kind, node.outer, node.inner, node.heading) for (path, h), (node, size, links) in texts.items()]
                out += [(host, node.path, False, style, copy, 0, 0.0, node.kind, node.outer, node.inner, node.heading) for node, style in seen]
            cols = list(zip(*out)) if out else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, fields.values())], names=list(fields))

    schema = ", ".join(f"{k} {v}" for k, v in zip(fields, ("string", "bigint", "boolean", "bigint", "bigint", "bigint", "double", "int", "bigint", "int", "boolean")))
    own = ("kind", "outer", "inner", "heading")
    values = rows.mapInArrow(read, schema).groupBy("host", "path", "content", "value").agg(F.count_distinct("page").alias("k"), F.max("size").alias("size"), F.max("links").alias("links"), *(F.max(c).alias(c) for c in own))
    pages = rows.groupBy("host").agg(F.count_distinct("page").alias("m"))
    weight, words = F.col("k") * F.log("k"), F.col("k") * F.col("size")
    nodes = values.groupBy("host", "path").agg(
        # Texts on k of m pages, evenly: entropy log k / log m; each text of a page counts.
        F.sum(F.when(F.col("content"), weight)).alias("spread"),
        F.sum(F.when(F.col("content"), F.col("k"))).alias("texts"),
        F.sum(F.when(~F.col("content"), weight)).alias("style_spread"),
        F.sum(F.when(~F.col("content"), F.col("k"))).alias("styles"),
        F.sum(words).alias("size"),
        F.sum(words * F.col("links")).alias("linked"),
        *(F.max(c).alias(c) for c in own),
    )
    nodes = settle(nodes.where("texts > 0").join(pages, "host"), "nodes")
    sites = nodes.groupBy("host").agg(F.sum("size").alias("whole"))
    branches = nodes.where("outer <> 0").groupBy("host", "outer").agg(F.sum("size").alias("size")).join(sites, "host")
    wrappers = branches.groupBy("host").agg(F.collect_list(F.when(F.col("size") >= WRAPPER * F.col("whole"), F.col("outer"))).alias("wrappers"))
    sites = sites.join(wrappers, "host", "left").withColumn("wrappers", F.coalesce("wrappers", F.array().cast("array<bigint>")))
    seen = nodes.join(sites, "host").withColumn("says", F.when(F.array_contains("wrappers", F.col("outer")), F.col("inner")).otherwise(F.col("kind")))
    marked = seen.groupBy("host").agg((F.sum(F.when(F.col("says") == MAIN, F.col("size")).otherwise(0)) >= MARKED * F.first("whole")).alias("marked"))
    seen = seen.join(marked, "host")
    log_m = F.log(F.greatest(F.col("m"), F.lit(2)).cast("double"))
    content = 1 - F.least(F.lit(1.0), F.col("spread") / F.col("texts") / log_m)
    style = F.coalesce(F.greatest(F.lit(0.0), F.log(F.col("styles").cast("double")) - F.col("style_spread") / F.col("styles")) / log_m, F.lit(0.0))
    names = F.when(F.col("says") == NOISE, NAMES[NOISE]).when(F.col("says") == MAIN, NAMES[MAIN]).when(F.col("marked") & ~F.col("heading"), OUTSIDE).otherwise(NAMES[PLAIN])
    keeps = odds(content, style, F.col("linked") / F.greatest(F.col("size"), F.lit(1)), names) >= 0
    usual = (F.col("says") != NOISE) & ~((F.col("says") == PLAIN) & F.col("marked") & ~F.col("heading"))
    return seen.groupBy("host").agg(
        F.first("wrappers").alias("wrappers"),
        F.first("marked").alias("marked"),
        F.collect_list(F.when(~keeps & usual, F.col("path"))).alias("cut"),
        F.collect_list(F.when(keeps & ~usual, F.col("path"))).alias("kept"),
    )


class Site:
    """What a page needs to know of its site."""

    def __init__(self, wrappers=(), marked: bool = False, cut=(), kept=()):
        self.wrappers, self.marked, self.cut, self.kept = frozenset(wrappers), marked, frozenset(cut), frozenset(kept)

    def keeps(self, node: Node) -> bool:
        """As the names say, but for the paths that the tree decides otherwise."""
        if node.path in self.cut or node.path in self.kept:
            return node.path in self.kept
        says = node.inner if node.outer in self.wrappers else node.kind
        return says == MAIN or says == PLAIN and (node.heading or not self.marked)


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Returns ``key``, ``url``, text and n_chars (its code points) of every page."""
    rows = pages.select(pages[key].alias("key"), pages[url].cast("string").alias("url"), pages[page].cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    facts = ("wrappers", "marked", "cut", "kept")
    trees = settle(site_trees(rows.select("host", "html")), "trees").select("host", F.struct(*facts).alias("site"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, names = [], b.schema.names
            sites, last, site = b.column(names.index("site")), None, Site()
            for i, (host, doc) in enumerate(zip(b.column(names.index("host")).to_pylist(), b.column(names.index("html")).to_pylist())):
                if host != last:
                    last, site = host, Site(**(sites[i].as_py() or {}))
                texts.append(" ".join(t for node, t, _ in blocks(doc or "") if site.keeps(node)))
            yield pa.RecordBatch.from_arrays([b.column(names.index("key")), b.column(names.index("url")), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[key, url, "text", "n_chars"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.join(trees, "host", "left").select("key", "url", "html", "host", "site").mapInArrow(cut, f"`{key}` {kind}, `{url}` string, text string, n_chars bigint")
