"""Url keys, which are not interchangeable, and host parts.

``parse_url`` is not used: it fails on spaces and gives no host outside ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from .text import strip

_PARTS = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def host(c: Column) -> Column:
    return F.regexp_replace(strip(F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), _PARTS, 1))), "^www\\.", "")


def _path(c: Column) -> Column:
    # Parameters of the last segment are no part of a path.
    return F.regexp_replace(strip(F.regexp_extract(F.coalesce(c, F.lit("")), _PARTS, 2)), ";[^/]*$", "")


def page_key(c: Column) -> Column:
    """Host and path: no scheme, www, query, fragment or last slash."""
    return F.regexp_replace(F.concat(host(c), _path(c)), "/+$", "")


def article_key(c: Column) -> Column:
    """page_key and the sorted query parameters that name an article."""
    query = F.regexp_extract(F.coalesce(c, F.lit("")), _PARTS, 3)
    decode = lambda x: strip(F.try_url_decode(F.replace(x, F.lit("+"), F.lit(" "))))
    pairs = F.transform(F.split(query, "&"), lambda p: F.struct(strip(F.lower(F.split_part(p, F.lit("="), F.lit(1)))).alias("k"), decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: p["k"].isin(*lx.QUERY_PARAMS) & (p["v"] != "")))
    tail = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), F.url_encode(p["v"]))), "&")
    key = page_key(strip(c))
    return F.when(tail != "", F.concat(key, F.lit("?"), tail)).otherwise(key)


def link_key(c: Column) -> Column:
    """The whole url in lower case without scheme, www and last slash; its query stays."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(F.lower(c)), "^https?://", ""), "^www\\.", ""), "/+$", "")


def bare_host(c: Column) -> Column:
    """Host without port and www."""
    return F.regexp_replace(F.split_part(strip(F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), _PARTS, 1))), F.lit(":"), F.lit(1)), "^www\\.", "")


def host_suffixes(h: Column) -> Column:
    """The host and all that remains of it behind each dot."""
    parts = F.split(h, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def publisher_code(h: Column) -> Column:
    """What a host without publisher is called: the host without the first suffix that fits."""
    out = h
    for s in reversed(lx.HOST_SUFFIXES):
        out = F.when(h.endswith(s), F.substring(h, F.lit(1), F.length(h) - len(s))).otherwise(out)
    return F.when(out == "", lx.UNKNOWN_PUBLISHER).otherwise(out)
