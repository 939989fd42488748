"""Pieces of DuckDB SQL for the text rules, from the same word lists."""

from __future__ import annotations

from ..functions import lexicon as lx
from ..functions.text import ENTITIES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(words) -> str:
    return "(" + ", ".join(map(q, words)) + ")"


SPACES = "[ \\t\\n\\r\\f\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
PUNCT = r"[“”‘’\"'`~!@#$%^&*()_+=\[\]{};:,.<>/?\\|《》〈〉·ㆍ-]"


def strip(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^{SPACES}+|{SPACES}+$', '', 'g')"


def swap(c: str, pairs) -> str:
    for a, b in pairs:
        c = f"replace({c}, {q(a)}, {q(b)})"
    return c


def gsub(c: str, pattern: str, by: str) -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(by)}, 'g')"


def remove_tags(c: str) -> str:
    return strip(swap(gsub(f"coalesce({c}, '')", "<.*?>", ""), ENTITIES))


def strip_entities(c: str) -> str:
    return strip(swap(swap(gsub(f"coalesce({c}, '')", "<.*?>", " "), ENTITIES), (("…", " "), ("...", " "))))


def normalize_title(c: str) -> str:
    t = gsub(f"lower({strip_entities(c)})", r"\[[^\]]*\]|【[^】]*】|\([^)]*\)", " ")
    return gsub(t, "[^0-9a-z가-힣]", "")


def normalize_compare(c: str, aliases: bool = False) -> str:
    t = f"lower({strip_entities(c)})"
    if aliases:
        t = swap(swap(t, (("openai", " openai "), ("skax", " skax "))), ((a, f" {b} ") for a, b in lx.ENTITY_ALIASES.items()))
    t = gsub(gsub(t, r"\[[^\]]*\]|【[^】]*】", " "), PUNCT, " ")
    t = gsub(t, f"[0-9]{{4}}년{SPACES}*[0-9]{{1,2}}월{SPACES}*[0-9]{{1,2}}일", " ")
    return strip(gsub(t, SPACES + "+", " "))


def normalize_token(c: str) -> str:
    """A scalar expression over a variable; the hanja are expanded before."""
    whens = " ".join(f"WHEN ends_with({c}, {q(p)}) AND length({c}) > {len(p) + 1} THEN left({c}, length({c}) - {len(p)})" for p in lx.PARTICLES)
    return f"(CASE {whens} ELSE {c} END)"


def action_of(c: str) -> str:
    whens = " ".join(f"WHEN contains({c}, {q(k)}) THEN {q(v)}" for k, v in lx.ACTION_ALIASES.items())
    return f"(CASE WHEN {c} = '' THEN '' {whens} WHEN {c} IN {any_of(lx.ACTIONS)} THEN {c} ELSE '' END)"


def ordered_distinct(c: str) -> str:
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


def raw_tokens(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '[가-힣a-zA-Z0-9]{{2,}}'), lambda t: {swap('t', lx.HANJA.items())})"


def simhash(tokens: str) -> str:
    digits = []
    for p in range(1, 17):
        bits = " + ".join(f"(CASE WHEN list_sum(list_transform({tokens}, lambda t: CASE WHEN (strpos('0123456789abcdef', substr(md5(t), {p}, 1)) - 1) & {1 << k} > 0 THEN 1 ELSE -1 END)) >= 0 THEN {1 << k} ELSE 0 END)" for k in range(4))
        digits.append(f"substr('0123456789abcdef', CAST(1 + {bits} AS BIGINT), 1)")
    return f"(CASE WHEN len({tokens}) > 0 THEN {' || '.join(digits)} ELSE '' END)"


PARTS = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def host(c: str) -> str:
    return f"regexp_replace({strip(f'lower(regexp_extract({c}, {q(PARTS)}, 1))')}, '^www\\.', '')"


def page_key(c: str) -> str:
    path = f"regexp_replace({strip(f'regexp_extract({c}, {q(PARTS)}, 2)')}, ';[^/]*$', '')"
    return f"regexp_replace({host(c)} || {path}, '/+$', '')"


def link_key(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({strip(f'lower({c})')}, '^https?://', ''), '^www\\.', ''), '/+$', '')"


def article_key(c: str) -> str:
    part = "split_part(p, '=', 1)"
    value = "url_decode(replace(regexp_extract(p, '^[^=]*=(.*)$', 1), '+', ' '))"
    pairs = f"list_transform(string_split(regexp_extract({c}, {q(PARTS)}, 3), '&'), lambda p: {{'k': {strip(f'lower({part})')}, 'v': {strip(value)}}})"
    tail = f"array_to_string(list_transform(list_sort(list_filter({pairs}, lambda x: x.k IN {any_of(lx.QUERY_PARAMS)} AND x.v <> '')), lambda x: x.k || '=' || url_encode(x.v)), '&')"
    return f"({page_key(c)} || CASE WHEN {tail} <> '' THEN '?' || {tail} ELSE '' END)"
