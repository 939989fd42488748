"""Text rules as column expressions: cleaning, tokens, anchors, actions, event keys.

Everything stays inside the JVM.  White space means that of Unicode where the rule
trims, as in ``strip``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx

_TRIM = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), _TRIM, "")


def first_text(*cols: Column) -> Column:
    """The first that isn't null or blank, trimmed; else the empty text."""
    return F.coalesce(*(F.nullif(strip(c), F.lit("")) for c in cols), F.lit(""))


def _replace(c: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


# The entities that the rules know, in the order in which they are replaced.
ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"))


def remove_tags(c: Column) -> Column:
    return strip(_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "<.*?>", ""), ENTITIES))


def strip_entities(c: Column) -> Column:
    c = _replace(F.regexp_replace(F.coalesce(c, F.lit("")), "<.*?>", " "), ENTITIES)
    return strip(_replace(c, (("…", " "), ("...", " "))))


def normalize_title(c: Column) -> Column:
    t = F.lower(strip_entities(c))
    t = F.regexp_replace(t, r"\[[^\]]*\]|【[^】]*】|\([^)]*\)", " ")
    return F.regexp_replace(F.regexp_replace(t, lx.PUNCTUATION, " "), "[^0-9a-z가-힣]", "")


def apply_aliases(c: Column) -> Column:
    c = _replace(F.lower(c), (("openai", " openai "), ("skax", " skax ")))
    return _replace(c, ((a, f" {b} ") for a, b in lx.ENTITY_ALIASES.items()))


def normalize_compare(c: Column, aliases: bool = False) -> Column:
    t = strip_entities(c)
    t = F.lower(apply_aliases(t) if aliases else t)
    t = F.regexp_replace(t, r"\[[^\]]*\]|【[^】]*】", " ")
    t = F.regexp_replace(t, lx.PUNCTUATION, " ")
    t = F.regexp_replace(t, r"(?U)[0-9]{4}년\s*[0-9]{1,2}월\s*[0-9]{1,2}일", " ")
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))


def compact(c: Column, aliases: bool = False) -> Column:
    return F.regexp_replace(normalize_compare(c, aliases), r"(?U)\s+", "")


def expand_hanja(c: Column) -> Column:
    return _replace(c, lx.HANJA.items())


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(c), lambda x: use(x)), 1)


# The shortest rest of two letters or more leaves the longest particle, which is the first listed that fits.
_PARTICLE = "^(.{2,}?)(?:" + "|".join(lx.PARTICLES) + ")$"


def normalize_token(c: Column) -> Column:
    """One particle is taken off, so this isn't idempotent."""
    return F.regexp_replace(expand_hanja(strip(F.lower(c))), _PARTICLE, "$1")


def _action(t: Column) -> Column:
    known = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in lx.ACTION_ALIASES.items()))
    found = F.get(F.filter(known, lambda s: F.contains(t, s["k"])), F.lit(0))["v"]
    return F.coalesce(found, F.when(t.isin(*lx.ACTIONS), t), F.lit(""))


def action_of(c: Column) -> Column:
    """The action a token stands for, or the empty text."""
    return let(normalize_token(c), _action)


def _raw_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[가-힣a-zA-Z0-9]{2,}"), F.lit(0))


def unique(arr: Column, limit: int | None = None) -> Column:
    out = F.array_distinct(F.filter(F.transform(arr, strip), lambda x: x != ""))
    return F.slice(out, 1, limit) if limit else out


def _tokens(text: Column, stopwords: tuple[str, ...], limit: int | None, keep_actions: bool = False) -> Column:
    toks = F.transform(_raw_tokens(text), normalize_token)
    ok = lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$") & ((~t.isin(*stopwords)) | ((action_of(t) != "") if keep_actions else F.lit(False)))
    out = F.array_distinct(F.filter(toks, ok))
    return F.slice(out, 1, limit) if limit else out


def cluster_tokens(c: Column, limit: int = 80) -> Column:
    return _tokens(normalize_compare(c), lx.CLUSTER_STOPWORDS, limit)


def history_tokens(c: Column, limit: int = 80) -> Column:
    return _tokens(normalize_compare(c, aliases=True), lx.HISTORY_STOPWORDS, limit, keep_actions=True)


def final_text(c: Column) -> Column:
    t = _replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "<.*?>", " "), (("&quot;", '"'), ("&amp;", "&")))
    t = expand_hanja(t)
    t = F.regexp_replace(t, r"\[[^\]]*\]|【[^】]*】", " ")
    return strip(F.regexp_replace(F.regexp_replace(t, lx.PUNCTUATION, " "), r"(?U)\s+", " "))


def final_title(c: Column) -> Column:
    return F.regexp_replace(final_text(c), "[^0-9a-z가-힣]", "")


def final_tokens(c: Column, limit: int | None = 90) -> Column:
    return _tokens(final_text(c), lx.STOPWORDS, limit)


def history_anchors(tokens: Column) -> Column:
    t = F.transform(tokens, normalize_token)
    keep = lambda x: (x != "") & ~x.isin(*lx.ANCHOR_STOPWORDS) & (x.rlike("[a-zA-Z]") | (x.rlike("[가-힣]") & (F.length(x) >= 3)) | (F.length(x) >= 4))
    return F.slice(F.array_distinct(F.filter(t, keep)), 1, 20)


def final_anchors(tokens: Column) -> Column:
    return F.filter(tokens, lambda x: x.rlike("[a-zA-Z]") | (F.length(x) >= 3))


def numbers(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))))


def actions(tokens: Column) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(tokens, action_of), lambda a: a != "")), 1, 6)


def is_weak_anchor(c: Column) -> Column:
    return let(normalize_token(c), _weak)


def _weak(t: Column) -> Column:
    return (t == "") | t.isin(*lx.WEAK_ANCHORS) | t.rlike(r"^[0-9]{1,4}(?:년|월|일|선|대|개|명|억|조|%|p|pt)?$") | t.rlike(r"^[0-9]+(?:\.[0-9]+)?$")


def is_strong_anchor(c: Column) -> Column:
    shape = lambda t: t.rlike("[a-zA-Z]") | (t.rlike("[가-힣]") & (F.length(t) >= 3)) | (F.length(t) >= 5)
    return let(normalize_token(c), lambda t: (t != "") & ~is_weak_anchor(t) & shape(t))


def strong_anchors(tokens: Column) -> Column:
    return unique(F.filter(tokens, is_strong_anchor), 20)


def has_specific_action(acts: Column) -> Column:
    name = lambda a: F.coalesce(F.nullif(action_of(a), F.lit("")), strip(a))
    return F.exists(F.transform(acts, name), lambda a: (a != "") & ~a.isin(*lx.WEAK_ACTIONS))


def event_key(anchors: Column, acts: Column, nums: Column) -> Column:
    """Strong anchors, actions and numbers; empty where these say too little."""
    def build(x: Column) -> Column:
        specific = F.filter(x["acts"], lambda a: ~a.isin(*lx.WEAK_ACTIONS))
        chosen = F.when(F.size(specific) > 0, specific).otherwise(x["acts"])
        parts = F.concat(F.slice(x["strong"], 1, 3), F.slice(chosen, 1, 2), F.slice(x["nums"], 1, 2))
        enough = (F.size(x["strong"]) >= 2) | ((F.size(x["strong"]) >= 1) & (F.size(specific) >= 1))
        return F.when(enough, F.array_join(unique(parts, 7), "|")).otherwise("")

    return let(F.struct(F.slice(strong_anchors(anchors), 1, 4).alias("strong"), acts.alias("acts"), nums.alias("nums")), build)


def clip(c: Column, limit: int = 180, rstrip: bool = True) -> Column:
    t = F.coalesce(c, F.lit(""))
    head = F.substring(t, 1, limit)
    return F.when(F.length(t) > limit, F.concat(F.regexp_replace(head, r"(?U)\s+$", "") if rstrip else head, F.lit("..."))).otherwise(t)


def slug(c: Column) -> Column:
    t = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"[^0-9A-Za-z가-힣_-]+", "_")
    return F.regexp_replace(t, "^_+|_+$", "")


def escape_html(c: Column) -> Column:
    return _replace(F.coalesce(c, F.lit("")), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")))


def escape_url(c: Column) -> Column:
    """A link that can stand in an attribute; # without one."""
    t = strip(c)
    return F.when(t == "", "#").otherwise(escape_html(t))


def model_base(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"-[0-9]{4}-[0-9]{2}-[0-9]{2}$", "")


def env_key(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+", "_")
