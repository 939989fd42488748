"""The text rules on Python strings, for payloads that are built row by row.

A payload needs the same few rules on every token; as nested column expressions these
are interpreted again for each token of each row.  Here a token's forms are looked up
in a dictionary, and a whole payload is one Arrow pass over the rows.  The rules are
those of ``text`` and ``similarity``, and tests hold both forms against each other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from .text import ENTITIES

_TAG = re.compile("<[^\\n\\r\\u0085\\u2028\\u2029]*?>")
_BRACKETS, _PARENTHESES = re.compile(r"\[[^\]]*\]|【[^】]*】"), re.compile(r"\[[^\]]*\]|【[^】]*】|\([^)]*\)")
_PUNCTUATION = re.compile(lx.PUNCTUATION)
# White space as Unicode has it; Python's own also has the separators 1C to 1F.
_WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_DATE = re.compile(f"[0-9]{{4}}년[{_WHITE}]*[0-9]{{1,2}}월[{_WHITE}]*[0-9]{{1,2}}일")
_SPACE = re.compile(f"[{_WHITE}]+")
_GAP = re.compile(lx.PUNCTUATION[:-2] + _WHITE + "-]+")
_NOT_KEY = re.compile("[^0-9a-z가-힣]")
_TOKEN, _NUMBER = re.compile("[가-힣a-zA-Z0-9]{2,}"), re.compile(r"[0-9]+(?:\.[0-9]+)?")
_LATIN, _HANGUL, _DIGITS = re.compile("[a-zA-Z]"), re.compile("[가-힣]"), re.compile("[0-9]+")
_WEAK = re.compile(r"[0-9]{1,4}(?:년|월|일|선|대|개|명|억|조|%|p|pt)?|[0-9]+(?:\.[0-9]+)?")


#: Tokens whose forms a Python worker keeps, for each rule.
_KNOWN = 1 << 15


def _swap(t: str, pairs: Iterable[tuple[str, str]]) -> str:
    for a, b in pairs:
        t = t.replace(a, b)
    return t


def strip_entities(t: str | None) -> str:
    t = t or ""
    if "<" in t:
        t = _TAG.sub(" ", t)
    if "&" in t:
        t = _swap(t, ENTITIES)
    return _swap(t, (("…", " "), ("...", " "))).strip(_WHITE)


def normalize_title(t: str | None) -> str:
    return _NOT_KEY.sub("", _PUNCTUATION.sub(" ", _PARENTHESES.sub(" ", strip_entities(t).lower())))


def normalize_compare(t: str | None, aliases: bool = False) -> str:
    t = strip_entities(t).lower()
    if aliases:
        t = _swap(_swap(t, (("openai", " openai "), ("skax", " skax "))), ((a, f" {b} ") for a, b in lx.ENTITY_ALIASES.items())).lower()
    if "[" in t or "【" in t:
        t = _BRACKETS.sub(" ", t)
    if "년" in t:
        t = _DATE.sub(" ", _PUNCTUATION.sub(" ", t))
    return _GAP.sub(" ", t).strip(" ")


def final_text(t: str | None) -> str:
    t = _swap(_TAG.sub(" ", (t or "").lower()), (("&quot;", '"'), ("&amp;", "&"), *lx.HANJA.items()))
    return _GAP.sub(" ", _BRACKETS.sub(" ", t)).strip(" ")


@lru_cache(_KNOWN)
def strip_particle(token: str) -> str:
    t = _swap((token or "").lower().strip(), lx.HANJA.items())
    return next((t[: -len(p)] for p in lx.PARTICLES if len(t) > len(p) + 1 and t.endswith(p)), t)


@lru_cache(_KNOWN)
def action_name(token: str) -> str:
    t = strip_particle(token)
    if not t:
        return ""
    return next((v for k, v in lx.ACTION_ALIASES.items() if k in t), t if t in lx.ACTIONS else "")


@lru_cache(_KNOWN)
def _kept(raw: str, stopwords: tuple[str, ...], keep_actions: bool) -> str:
    """A raw token's form, or the empty text where it doesn't count."""
    t = strip_particle(raw)
    if len(t) < 2 or _DIGITS.fullmatch(t) or t in stopwords and not (keep_actions and action_name(t)):
        return ""
    return t


def _distinct(items: Iterable[str], limit: int | None) -> list[str]:
    return list(dict.fromkeys(x for x in items if x))[:limit]


def _tokens(text: str, stopwords: tuple[str, ...], limit: int | None, keep_actions: bool = False) -> list[str]:
    found: dict[str, None] = {}
    for x in _TOKEN.finditer(text):
        if t := _kept(x[0], stopwords, keep_actions):
            found[t] = None
            if len(found) == limit:
                break
    return list(found)


def cluster_tokens(t: str | None, limit: int = 80) -> list[str]:
    return _tokens(normalize_compare(t), lx.CLUSTER_STOPWORDS, limit)


def history_tokens(t: str | None, limit: int = 80) -> list[str]:
    return _tokens(normalize_compare(t, True), lx.HISTORY_STOPWORDS, limit, True)


def final_tokens(t: str | None, limit: int | None = 90) -> list[str]:
    return _tokens(final_text(t), lx.STOPWORDS, limit)


@lru_cache(_KNOWN)
def _anchor(token: str) -> str:
    t = strip_particle(token)
    ok = t and t not in lx.ANCHOR_STOPWORDS and (_LATIN.search(t) or _HANGUL.search(t) and len(t) >= 3 or len(t) >= 4)
    return t if ok else ""


@lru_cache(_KNOWN)
def is_strong(token: str) -> bool:
    t = strip_particle(token)
    again = strip_particle(t)
    weak = not again or again in lx.WEAK_ANCHORS or _WEAK.fullmatch(again)
    return bool(t and not weak and (_LATIN.search(t) or _HANGUL.search(t) and len(t) >= 3 or len(t) >= 5))


def numbers(t: str | None) -> list[str]:
    return sorted(set(_NUMBER.findall(t or "")))


@lru_cache(_KNOWN)
def _md5(token: str) -> bytes:
    return hashlib.md5(token.encode()).digest()[:8]


def simhash(tokens: list[str]) -> str:
    if not tokens:
        return ""
    bits = np.unpackbits(np.frombuffer(b"".join(map(_md5, tokens)), np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) >= len(tokens)).tobytes().hex()


def history_anchors(tokens: list[str]) -> list[str]:
    return _distinct(map(_anchor, tokens), 20)


def event_key(strong: list[str], acts: list[str], nums: list[str]) -> str:
    strong = strong[:4]
    specific = [a for a in acts if a not in lx.WEAK_ACTIONS]
    if not (len(strong) >= 2 or strong and specific):
        return ""
    return "|".join(_distinct((x.strip() for x in [*strong[:3], *(specific or acts)[:2], *nums[:2]]), 7))


def cluster_payload(title: str | None, body: str | None, url_key: str | None) -> dict:
    whole = both(title, body)
    tokens = cluster_tokens(whole)
    return {"url_key": url_key, "title_key": normalize_title(title), "body_key": normalize_compare(whole).replace(" ", ""), "title_tokens": cluster_tokens(title, 30), "tokens": tokens, "fingerprint": simhash(tokens)}


def history_payload(title: str | None, body: str | None, alias_titles: Iterable[str] | None = None) -> dict:
    """With alias titles these lengthen the text and the title tokens (60 of them, 80 in all), and are compared as titles (16)."""
    text, raw = body, []
    if alias_titles is not None:
        raw = _distinct((strip(x) for x in [title, *alias_titles]), 16)
        text = " ".join(_distinct((strip(x) for x in [title, body, *raw]), None))
    whole = both(title, text)
    tt, toks, nums = history_tokens(title, 30), history_tokens(whole), numbers(whole)
    titles = [normalize_title(title)]
    if alias_titles is not None:
        tt = _distinct([*tt, *history_tokens(" ".join(raw), 60)], 80)
        titles = _distinct(map(normalize_title, raw), 16)
    every = [*tt, *toks]
    acts = _distinct(map(action_name, every), 6)
    strong = _distinct((x.strip() for x in history_anchors(every) if is_strong(x)), 20)
    return {"titles": titles, "body_key": normalize_compare(whole, True).replace(" ", ""), "title_tokens": tt, "tokens": toks, "strong": strong, "numbers": nums, "actions": acts, "fingerprint": simhash(toks), "event_key": event_key(strong, acts, nums)}


def final_payload(title: str | None, body: str | None) -> dict:
    whole = both(title, body)
    tt, tokens = final_tokens(title, None), final_tokens(whole)
    return {"title_key": _NOT_KEY.sub("", final_text(title)), "body_key": final_text(whole).replace(" ", ""), "title_tokens": tt, "tokens": tokens, "anchors": [x for x in tt if _LATIN.search(x) or len(x) >= 3], "numbers": numbers(title), "fingerprint": simhash(tokens)}


def text_keys(title: str | None, body: str | None) -> tuple[str, str, str]:
    return normalize_title(title), normalize_compare(body), normalize_compare(body, True).replace(" ", "")


def joined_tokens(title: str | None, body: str | None) -> tuple[str, int]:
    found = cluster_tokens(both(title, body))
    return " ".join(found), len(found)


def fingerprint(title: str | None, body: str | None) -> tuple[str]:
    return (simhash(cluster_tokens(both(title, body))),)


def tokens_and_hash(title: str | None, body: str | None) -> tuple[list[str], str]:
    found = cluster_tokens(both(title, body))
    return found, hashlib.md5(" ".join(found).encode()).hexdigest()[:16]


def anchors_and_numbers(title: str | None, body: str | None) -> tuple[str, str]:
    whole = both(title, body)
    return " ".join(history_anchors(history_tokens(whole))), " ".join(numbers(whole))


def strip(t: str | None) -> str:
    return (t or "").strip(_WHITE)


_LISTS = ("title_tokens", "tokens", "titles", "strong", "numbers", "actions", "anchors")
_FIELDS = {
    "cluster": ("url_key", "title_key", "body_key", "title_tokens", "tokens", "fingerprint"),
    "history": ("titles", "body_key", "title_tokens", "tokens", "strong", "numbers", "actions", "fingerprint", "event_key"),
    "final": ("title_key", "body_key", "title_tokens", "tokens", "anchors", "numbers", "fingerprint"),
}
_MAKERS: dict[str, Callable[..., dict]] = {"cluster": cluster_payload, "history": history_payload, "final": final_payload}


def payload(kind: str, *cols: Column) -> Column:
    """A judge's payload, in one Arrow pass: of title and body, for ``cluster`` also the url key, for ``history`` also alias titles if given."""
    make = _MAKERS[kind]
    return one_pass(lambda *x: make(*x).values(), {f: "array<string>" if f in _LISTS else "string" for f in _FIELDS[kind]}, *cols)


#: Rows of an Arrow batch that are Python objects at the same time.
_ROWS = 500


def one_pass(rule: Callable[..., Iterable], fields: dict[str, str], *cols: Column) -> Column:
    """A struct of what ``rule`` makes of a row's texts, in the order of ``fields``; a batch is handed over in parts, so that few of its rows are Python objects."""
    kinds = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "bigint": pa.int64()}
    types = [kinds[k] for k in fields.values()]

    @F.arrow_udf("struct<" + ",".join(f"{f}:{k}" for f, k in fields.items()) + ">")
    def build(*texts: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(texts[0]), _ROWS):
            rows = [tuple(rule(*x)) for x in zip(*(t.slice(at, _ROWS).to_pylist() for t in texts))]
            parts.append(pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), types)], list(fields)))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(zip(fields, types))))

    return build(*cols)


def both(title: str | None, body: str | None) -> str:
    return " ".join(x for x in (title, body) if x is not None)
