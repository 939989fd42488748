"""Fingerprints and overlaps as columns, and the three duplicate judges as pandas UDFs.

A judge takes two structs of payload columns and gives (duplicate, method, score)
by the first rule that holds; cheap rules come first and the sequence ratios are
guarded by their upper bounds, in one Arrow call for a batch of pairs.
"""

from __future__ import annotations

import math
import os
from collections import Counter
from collections.abc import Callable, Iterable
from difflib import SequenceMatcher
from functools import cache, cached_property, lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ClusterThresholds, HistoryThresholds
from . import lexicon as lx
from . import text as tx
from .plain import action_name, strip_particle

VERDICT = "struct<duplicate:boolean,method:string,score:double>"


def simhash(tokens: Column) -> Column:
    """64 bits as 16 hexadecimal digits: a bit is set where as many tokens' md5 have it as lack it, or more; empty without tokens."""
    hashed = F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 16), 16, -10).cast("bigint"))

    def vote(h: Column) -> Column:
        ones = lambda bit: F.size(F.filter(h, lambda x: F.getbit(x, bit) == 1))
        bits = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda a, bit: a.bitwiseOR(F.when(ones(bit) * 2 >= F.size(h), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).otherwise(F.lit(0).cast("bigint"))))
        return F.when(F.size(h) > 0, F.lower(F.lpad(F.hex(bits), 16, "0"))).otherwise("")

    return tx.let(hashed, vote)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints; null where one is empty."""
    bits = lambda h: F.conv(h, 16, -10).cast("bigint")
    return F.when((a != "") & (b != ""), F.bit_count(bits(a).bitwiseXOR(bits(b))).cast("bigint"))


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("bigint")


def overlap(a: Column, b: Column) -> Column:
    """Common tokens by those of the smaller set; 0 where one is empty."""
    small = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(small > 0, common(a, b) / small).otherwise(0.0)


@lru_cache(1 << 11)
def _counts(t: str) -> dict[str, int]:
    return Counter(t)


def _pairs_of(t: str) -> frozenset:
    """Letter pairs, equal ones numbered, so that sets share as many as the texts; of a single letter itself."""
    pairs = [t[i : i + 2] for i in range(len(t) - 1)]
    if len(set(pairs)) == len(pairs):
        return frozenset(pairs or [t])
    seen: Counter = Counter()
    out = set()
    for x in pairs:
        out.add((x, seen[x]) if seen[x] else x)
        seen[x] += 1
    return frozenset(out)


# Forms of tokens come again in many texts, titles only in a few comparisons.
_marks, _title_marks = lru_cache(1 << 14)(_pairs_of), lru_cache(1 << 9)(_pairs_of)


@lru_cache(1 << 12)
def _pairs_needed(n: int, least: float) -> int:
    """Letter pairs that texts of ``n`` letters together share where their ratio reaches ``least``.

    A block of k matched letters holds k - 1 pairs, and an unmatched letter lies between two blocks.
    """
    matched = math.ceil(least * n / 2 - 1e-9)
    return 3 * matched - n - 1


#: Letters of two texts together up to which their pairs are counted: in longer ones the plain letters say as much.
_PAIRS_UP_TO = 160


@lru_cache(1 << 9)
def _places(t: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, x in enumerate(t):
        out[x] = out.get(x, 0) | 1 << i
    return out


def _in_order(a: str, b: str, least: float) -> bool:
    """Whether as many letters stand in the same order in both as a ratio of ``least`` matches: the longest common subsequence, by bits."""
    at, need = _places(b), math.ceil(least * (len(a) + len(b)) / 2 - 1e-9)
    every = (1 << len(b)) - 1
    free = every
    for i in range(0, len(a), 64):
        for x in a[i : i + 64]:
            if m := free & at.get(x, 0):
                free = (free + m | free - m) & every
        if len(b) - free.bit_count() + max(0, len(a) - i - 64) < need:
            return False
    return len(b) - free.bit_count() >= need


def ratio(a: str, b: str, least: float = 0.0) -> float:
    """Sequence similarity; where it can't reach ``least``, 0 without the full comparison."""
    if not a or not b:
        return 0.0
    n = len(a) + len(b)
    if least:
        if 2 * min(len(a), len(b)) / n < least:
            return 0.0
        ca, cb = _counts(a), _counts(b)
        if 2 * sum(min(k, cb.get(x, 0)) for x, k in ca.items()) / n < least:
            return 0.0
        if n <= _PAIRS_UP_TO and (need := _pairs_needed(n, least)) > 0 and len(_title_marks(a) & _title_marks(b)) < need:
            return 0.0
        # In a long second text the matcher starts only at its rare characters, and at both beginnings.
        if len(b) >= 200 and not any(k <= len(b) // 100 + 1 and x in ca for x, k in cb.items()):
            return 2 * len(os.path.commonprefix((a, b))) / n
        if not _in_order(a, b, least):
            return 0.0
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b)])


def related(a: str, b: str) -> bool:
    """Equal, one (3 letters or more) inside the other, or 4 letters and a ratio of 0.82."""
    a, b = strip_particle(a), strip_particle(b)
    return bool(a and b) and _related(a, b)


def _related(a: str, b: str) -> bool:
    if a == b:
        return True
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if len(short) >= 3 and short in long:
        return True
    n = len(a) + len(b)
    return len(short) >= 4 and 2 * len(short) >= 0.82 * n and len(_marks(a) & _marks(b)) >= _pairs_needed(n, 0.82) and _close(a, b)


@lru_cache(1 << 14)
def _close(a: str, b: str) -> bool:
    return ratio(a, b, 0.82) >= 0.82


@lru_cache(1 << 12)
def _needed(m: int, n: int) -> int:
    """Letter pairs that related forms of so many letters share at least; 0 where there are none."""
    short = min(m, n)
    if short < 3:
        return int(m == n)
    return min(short - 1, _pairs_needed(m + n, 0.82) if short >= 4 and 2 * short >= 0.82 * (m + n) else short)


class Side:
    """A token list as one side of soft matches: tokens that count, their forms, and places by the forms' letter pairs."""

    def __init__(self, tokens: Iterable[str]):
        kept = [t for t in map(strip_particle, tokens) if t and not (t in lx.ANCHOR_STOPWORDS and not action_name(t))]
        self.tokens, self.forms = kept, [strip_particle(t) for t in kept]
        self._needs: dict[int, list[int]] = {}

    @cached_property
    def places(self) -> dict:
        """Bits of the tokens that have a letter pair."""
        out: dict = {}
        for i, form in enumerate(self.forms):
            for x in _marks(form):
                out[x] = out.get(x, 0) | 1 << i
        return out

    def by_need(self, n: int) -> list[int]:
        """Bits of the tokens whose forms share 1, 2, 3 or (at least) 4 letter pairs with a related one of ``n`` letters."""
        if n not in self._needs:
            out = self._needs[n] = [0, 0, 0, 0]
            for i, form in enumerate(self.forms):
                if need := _needed(n, len(form)):
                    out[min(need, 4) - 1] |= 1 << i
        return self._needs[n]


def _soft(left: Side, right: Side, least: float = 0) -> list[str]:
    """The greedy matches; only tokens that share enough letter pairs are compared, and where ``least`` can't be reached, only some."""
    places, free, out = right.places, -1, []
    for rest, a, form in zip(range(len(left.tokens), 0, -1), left.tokens, left.forms):
        if len(out) + rest < least:
            break
        c1 = c2 = c3 = c4 = 0
        for x in _marks(form):
            if x in places:
                m = places[x]
                c4 |= c3 & m
                c3 |= c2 & m
                c2 |= c1 & m
                c1 |= m
        if not c1:
            continue
        n1, n2, n3, n4 = right.by_need(len(form))
        near = (c1 & n1 | c2 & n2 | c3 & n3 | c4 & n4) & free
        while near:
            bit = near & -near
            at = bit.bit_length() - 1
            if _related(form, right.forms[at]):
                free &= ~bit
                b = right.tokens[at]
                out.append(a if len(a) <= len(b) else b)
                break
            near ^= bit
    return list(dict.fromkeys(out))


def soft_common(left: list[str], right: list[str]) -> list[str]:
    """Greedy matching from the left; each right token once; the shorter of two related ones is kept."""
    return _soft(Side(left), Side(right))


def soft_overlap(left: list[str], right: list[str]) -> tuple[float, int]:
    n = min(len(dict.fromkeys(left)), len(dict.fromkeys(right)))
    found = len(soft_common(left, right)) if n else 0
    return (found / n if n else 0.0), found


def hard_overlap(left: list[str], right: list[str]) -> tuple[float, int]:
    a, b = set(left), set(right)
    n = len(a & b)
    return (n / min(len(a), len(b)) if a and b else 0.0), n


def distance(a: str, b: str) -> int | None:
    return (int(a, 16) ^ int(b, 16)).bit_count() if a and b else None


def _list(x) -> list[str]:
    return [] if x is None else list(x)


Verdict = tuple[bool, str, float]
NO: Verdict = (False, "", 0.0)


def judge_cluster(c: dict, p: dict, t: ClusterThresholds = ClusterThresholds()) -> Verdict:
    """Eight rules; dicts with url_key, title_key, body_key, title_tokens, tokens, fingerprint."""
    if c["url_key"] and c["url_key"] == p["url_key"]:
        return True, "url", 1.0
    a, b = c["title_key"], p["title_key"]
    if a and a == b:
        return True, "title_exact", 1.0
    if a and b:
        short, long = sorted((a, b), key=len)
        if len(short) >= 10 and short in long:
            return True, "title_contains", len(short) / len(long)
        r = ratio(a, b, t.title)
        if r >= t.title:
            return True, "title_similarity", r
    share, n = hard_overlap(_list(c["title_tokens"]), _list(p["title_tokens"]))
    if n >= 3 and share >= 0.55:
        return True, "title_token_overlap", share
    r = ratio(c["body_key"], p["body_key"], t.text)
    if r >= t.text:
        return True, "text_similarity", r
    share, n = hard_overlap(_list(c["tokens"]), _list(p["tokens"]))
    if n >= t.common and share >= t.overlap:
        return True, "token_overlap", share
    d = distance(c["fingerprint"], p["fingerprint"])
    if d is not None and d <= t.simhash and n >= max(2, t.common - 1):
        return True, "simhash", 1 - d / 64
    return NO


class History:
    """A history payload as the judge reads it, with the sets and sides that each comparison needs again."""

    def __init__(self, p: dict):
        self.event_key, self.body_key, self.fingerprint = p["event_key"], p["body_key"], p["fingerprint"]
        self.titles = [x for x in _list(p["titles"])[:16] if x]
        self.numbers, self.strong, self.actions = (frozenset(_list(p[k])) for k in ("numbers", "strong", "actions"))
        self.title_list, self.token_list = _list(p["title_tokens"]), _list(p["tokens"])
        self.title_tokens, self.tokens = frozenset(self.title_list), frozenset(self.token_list)

    @cached_property
    def title_side(self) -> Side:
        return Side(self.title_list)

    @cached_property
    def token_side(self) -> Side:
        return Side(self.token_list)


def history(p: dict | History) -> History:
    return p if isinstance(p, History) else History(p)


def _overlaps(a: frozenset, b: frozenset, left: Callable[[], Side], right: Callable[[], Side], least: float = 0.0) -> tuple[float, int]:
    """The larger share and the larger count of hard and soft matches; both may be less than they are where the share is below ``least``."""
    if not a or not b:
        return 0.0, 0
    n = max(len(a & b), len(_soft(left(), right(), least * min(len(a), len(b)) - 1e-9)))
    return n / min(len(a), len(b)), n


def judge_history(c: dict | History, p: dict | History, t: HistoryThresholds = HistoryThresholds()) -> Verdict:
    """Fifteen rules; payloads with titles (own and alias titles) instead of one title."""
    c, p = history(c), history(p)
    conflict = bool(c.numbers and p.numbers and c.numbers.isdisjoint(p.numbers))
    if c.event_key and c.event_key == p.event_key and not conflict:
        return True, "event_key", 1.0
    titles = cache(lambda: _overlaps(c.title_tokens, p.title_tokens, lambda: c.title_side, lambda: p.title_side))
    strong = len(c.strong & p.strong)
    if not strong:
        # Without a shared strong anchor only the titles' own rules are left.
        return _judge_titles(c, p, t, conflict, lambda: titles()[1] >= 3)
    specific = any(a not in lx.WEAK_ACTIONS for a in c.actions & p.actions)
    to, tc = titles()
    if (strong >= 3 and tc >= 3) or (strong >= 2 and specific and tc >= 2) or strong >= 4:
        conflict = False
    found, best = _titles(c, p, conflict, lambda: tc >= 3 or strong >= 2, min(0.80, t.title) if tc >= 3 else t.title)
    if found[0]:
        return found
    if conflict:
        return NO
    for name, holds, score in (
        ("title_similarity", best >= t.title, best),
        ("title_similarity_anchor", best >= 0.80 and tc >= 3 and strong >= 1, best),
        ("anchor_bundle", strong >= 4 and tc >= 2, to),
        ("anchor_action", strong >= 3 and specific and tc >= 2, to),
        ("anchor_action_title", strong >= 3 and bool(c.actions & p.actions) and tc >= 3, to),
        ("anchor_title_bundle", strong >= 3 and tc >= 4, to),
        ("distinctive_anchor_pair", strong >= 3 and tc >= 3, to),
        ("title_token_overlap", to >= 0.58 and tc >= 4 and strong >= 1, to),
    ):
        if holds:
            return True, name, score
    body = ratio(c.body_key, p.body_key, t.text if strong < 2 else min(0.76, t.text))
    if strong < 2 and body < t.text:
        return NO
    d = distance(c.fingerprint, p.fingerprint)
    # Unlike bodies and fingerprints leave the rule of shares.
    only_share = body < min(0.76, t.text) and (d is None or d > t.simhash)
    o, n = _overlaps(c.tokens, p.tokens, lambda: c.token_side, lambda: p.token_side, max(t.overlap, 0.70) if only_share else 0.0)
    for name, holds, score in (
        ("text_similarity", body >= t.text and n >= t.common and strong >= 1, body),
        ("text_similarity_anchor", body >= 0.76 and n >= 5 and strong >= 2, body),
        ("token_overlap", n >= 5 and o >= max(t.overlap, 0.70) and strong >= 2, o),
        ("simhash", d is not None and d <= t.simhash and n >= t.common and strong >= 2, 1 - (d or 0) / 64),
    ):
        if holds:
            return True, name, score
    return NO


def _titles(c: History, p: History, conflict: bool, backed: Callable[[], bool], least: float) -> tuple[Verdict, float]:
    """The rules of equal and contained titles over all alias pairs, and the best ratio, where it can reach ``least``."""
    best = 0.0
    for x in c.titles:
        for y in p.titles:
            if x == y:
                return (True, "title_exact", 1.0), 1.0
            short, long = (x, y) if len(x) <= len(y) else (y, x)
            if len(short) >= 14 and short in long and not conflict and backed():
                return (True, "title_contains", len(short) / len(long)), best
            if not conflict:
                best = max(best, ratio(x, y, least))
    return NO, best


def _judge_titles(c: History, p: History, t: HistoryThresholds, conflict: bool, backed: Callable[[], bool]) -> Verdict:
    found, best = _titles(c, p, conflict, backed, t.title)
    return found if found[0] else (True, "title_similarity", best) if best >= t.title and not conflict else NO


def judge_final(c: dict, p: dict) -> Verdict:
    """Ten rules; here numbers conflict where both titles have some and not the same."""
    a, b = c["title_key"], p["title_key"]
    if a and a == b:
        return True, "title_exact", 1.0
    na, nb = set(_list(c["numbers"])), set(_list(p["numbers"]))
    if na and nb and na != nb:
        return NO
    best = 0.0
    if a and b:
        short, long = sorted((a, b), key=len)
        if len(short) >= 10 and short in long:
            return True, "title_contains", len(short) / len(long)
        best = ratio(a, b, 0.76)
        if best >= 0.88:
            return True, "title_similarity", best
    to, tc = hard_overlap(_list(c["title_tokens"]), _list(p["title_tokens"]))
    anchor = bool(set(_list(c["anchors"])) & set(_list(p["anchors"])))
    if best >= 0.76 and tc >= 3 and anchor:
        return True, f"title_similarity_anchor_common_{tc}", best
    if to >= 0.45 and tc >= 3:
        return True, f"title_token_overlap_common_{tc}", to
    if tc >= 3 and anchor:
        return True, f"title_common_anchor_{tc}", to
    o, n = hard_overlap(_list(c["tokens"]), _list(p["tokens"]))
    body = ratio(c["body_key"], p["body_key"], 0.72)
    if body >= 0.92 and (n >= 5 or anchor):
        return True, "text_similarity", body
    if body >= 0.72 and n >= 4 and anchor:
        return True, f"text_similarity_anchor_common_{n}", body
    if o >= 0.48 and n >= 4 and anchor:
        return True, f"token_overlap_common_{n}", o
    d = distance(c["fingerprint"], p["fingerprint"])
    if d is not None and d <= 8 and n >= 4 and anchor:
        return True, f"simhash_distance_{d}", 1 - d / 64
    return NO


#: What a judge reads of a payload; made once for a row that is compared with many.
READS: dict[str, Callable] = {"cluster": lambda p: p, "history": history, "final": lambda p: p}
JUDGES = {"cluster": judge_cluster, "history": judge_history, "final": judge_final}


def judge(kind: str, left: Column, right: Column) -> Column:
    """The verdict on two payload structs."""
    rule = JUDGES[kind]

    @F.pandas_udf(VERDICT)
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [rule(x, y) for x, y in zip(a.to_dict("records"), b.to_dict("records"))]
        return pd.DataFrame(out, columns=["duplicate", "method", "score"])

    return run(left, right)


def cluster_payload(title: Column, body: Column, url_key: Column) -> Column:
    both = F.concat_ws(" ", title, body)
    return F.struct(url_key.alias("url_key"), tx.normalize_title(title).alias("title_key"), tx.compact(both).alias("body_key"), tx.cluster_tokens(title, 30).alias("title_tokens"), tx.cluster_tokens(both).alias("tokens"), simhash(tx.cluster_tokens(both)).alias("fingerprint"))


def history_payload(title: Column, body: Column) -> Column:
    both = F.concat_ws(" ", title, body)

    def build(x: Column) -> Column:
        anchors, acts = tx.history_anchors(x["all"]), tx.actions(x["all"])
        return tx.let(F.struct(anchors.alias("anchors"), acts.alias("acts"), x.alias("x")), finish)

    def finish(y: Column) -> Column:
        x = y["x"]
        return F.struct(F.array(x["title_key"]).alias("titles"), x["body_key"].alias("body_key"), x["tt"].alias("title_tokens"), x["toks"].alias("tokens"), tx.strong_anchors(y["anchors"]).alias("strong"), x["nums"].alias("numbers"), y["acts"].alias("actions"), simhash(x["toks"]).alias("fingerprint"), tx.event_key(y["anchors"], y["acts"], x["nums"]).alias("event_key"))

    start = F.struct(tx.normalize_title(title).alias("title_key"), tx.compact(both, True).alias("body_key"), tx.history_tokens(title, 30).alias("tt"), tx.history_tokens(both).alias("toks"), tx.numbers(both).alias("nums"))
    return tx.let(start, lambda s: build(F.struct(*(s[c].alias(c) for c in ("title_key", "body_key", "tt", "toks", "nums")), F.concat(s["tt"], s["toks"]).alias("all"))))


def final_payload(title: Column, body: Column) -> Column:
    both = F.concat_ws(" ", title, body)
    tt = tx.final_tokens(title, None)
    return F.struct(tx.final_title(title).alias("title_key"), F.regexp_replace(tx.final_text(both), r"(?U)\s+", "").alias("body_key"), tt.alias("title_tokens"), tx.final_tokens(both).alias("tokens"), tx.final_anchors(tt).alias("anchors"), tx.numbers(title).alias("numbers"), simhash(tx.final_tokens(both)).alias("fingerprint"))
