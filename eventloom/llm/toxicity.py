"""Toxicity by a weighted grammar of finite-state transducers over clauses.

Five transducers read a clause's words and are composed, that is, run together
with the product of their states: *insult* and *threat* give a word or a sequence
of words a weight; *target*, *negation* and *reported speech* pass words on and
scale what the first two give, by whom a clause speaks of, by a negation shortly
before, and by a verb of saying.  A clause scores by what the composition accepts
in it; a text by its highest clause, the sum over its clauses, and their share,
through a logistic curve.

The weights of insults are log odds of word beginnings between toxic and other
labelled texts; the scales and the curve are fitted on the same texts.  These are
a bounded sample, FIT_ROWS at most, the least by a hash of the id; everything
else is done for every text, on the whole text.

Defined results: null and empty texts, and texts without a matching clause, get
the curve's value of no match (0 without labelled texts); repeated rows get equal
scores; rows of a null id are scored and never held out.  Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .neighbours import fitting_rows, held_out

FIT_ROWS = 6000
#: Word beginnings in the insult transducer, their lengths, and what they need to be in it.
TERMS, SHORTEST, LONGEST, LEAST_TOXIC, LEAST_WEIGHT = 2000, 4, 12, 4, 2.5
#: Words for which a negation holds.
NEGATION_REACH = 3

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")

# The closed word classes of the grammar, in the languages of the corpus.
NEGATIONS = frozenset("not no never nobody nothing without nicht kein keine keinen nie niemals ohne pas ne jamais sans ni nunca jamás sin tampoco".split())
REPORTS = frozenset("said says say saying told wrote called quoted reported claimed alleged sagte sagt schrieb nannte behauptet dit disait écrit appelé déclaré dijo dice escribió llamó declaró".split())
TARGETS = frozenset("you your yours yourself u he she they them him her his their du dich dir dein deine ihr euch sie tu toi ton ta vous votre ils elles tú ti te usted ustedes vosotros ellos ellas".split())
SPEAKERS = frozenset("i we ich wir je nous yo nosotros".split())
INTENTS = frozenset("will going gonna shall must werde werden vais allons voy vamos".split())
HARMS = frozenset("kill hurt beat destroy burn shoot stab murder strangle bomb töten umbringen schlagen verbrennen erschießen tuer frapper brûler détruire matar golpear quemar destruir".split())
THREAT_WEIGHT = 4.0


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, class of word) -> (next state, scale or weight); other classes lead to ``rest`` of the state."""

    arcs: dict[tuple[int, str], tuple[int, float]]
    rest: dict[int, int]
    #: What a state multiplies the weights by that others give in it.
    scale: dict[int, float]

    def step(self, state: int, kind: str) -> tuple[int, float]:
        found = self.arcs.get((state, kind))
        return found if found else (self.rest.get(state, state), 0.0)


def grammar(scales: dict[str, float]) -> dict[str, Transducer]:
    """threat: speaker, intent, harm, target in this order, other words between; the rest scale."""
    threat = Transducer({(0, "speaker"): (1, 0.0), (1, "intent"): (2, 0.0), (2, "harm"): (3, 0.0), (3, "target"): (0, THREAT_WEIGHT)}, {}, {})
    target = Transducer({(0, "target"): (1, 0.0)}, {}, {1: scales["target"]})
    negation = Transducer({(s, "negation"): (NEGATION_REACH, 0.0) for s in range(NEGATION_REACH + 1)}, {s: s - 1 for s in range(1, NEGATION_REACH + 1)}, dict.fromkeys(range(1, NEGATION_REACH + 1), scales["negation"]))
    reported = Transducer({(0, "report"): (1, 0.0)}, {}, {1: scales["reported"]})
    return {"threat": threat, "target": target, "negation": negation, "reported": reported}


_CLASSES = {w: k for k, words in (("negation", NEGATIONS), ("report", REPORTS), ("target", TARGETS), ("speaker", SPEAKERS), ("intent", INTENTS), ("harm", HARMS)) for w in words}


class Grammar:
    """The insult transducer (word beginnings with weights) composed with the others."""

    def __init__(self, terms: dict[str, float], scales: dict[str, float]):
        self.terms, self.parts = terms, grammar(scales)
        self.lengths = sorted({len(t) for t in terms}, reverse=True)
        self.finder = ahocorasick.Automaton()
        for t in [*terms, *HARMS]:
            self.finder.add_word(t, len(t))
        if len(self.finder):
            self.finder.make_automaton()

    def insult(self, word: str) -> float:
        """The weight of the longest known beginning of a word."""
        for n in self.lengths:
            w = self.terms.get(word[:n]) if len(word) >= n else None
            if w is not None:
                return w
        return 0.0

    def clause(self, words: list[str]) -> tuple[float, dict[str, int]]:
        """The weight of a clause, and how many of its insults each scale met."""
        states = dict.fromkeys(self.parts, 0)
        total, met = 0.0, {"plain": 0, "target": 0, "negation": 0, "reported": 0}
        for word in words:
            kind, given, scale = _CLASSES.get(word, ""), 0.0, 1.0
            for name, t in self.parts.items():
                states[name], weight = t.step(states[name], kind)
                given += weight
            given += self.insult(word)
            if given:
                hit = [n for n, t in self.parts.items() if states[n] in t.scale]
                for n in hit:
                    scale *= self.parts[n].scale[states[n]]
                    met[n] += 1
                met["plain"] += not hit
                total += given * scale
        return total, met

    def matches(self, text: str) -> Iterator[tuple[float, dict[str, int]]]:
        """Each clause that the composition accepts; only clauses with a known beginning are read."""
        low, done = text.lower(), 0
        if not len(self.finder):
            return
        for end, n in self.finder.iter(low):
            start = end - n + 1
            if start < done or start and low[start - 1].isalpha():
                continue
            a = max(done, *(low.rfind(c, done, start) + 1 for c in ".!?;:\n"))
            stop = CLAUSE.search(low, end)
            done = stop.end() if stop else len(low)
            weight, met = self.clause(WORD.findall(low[a : stop.start() if stop else len(low)]))
            if weight:
                yield weight, met

    def features(self, text: str) -> list[float]:
        """Highest clause, logarithm of the sum, and of the matches for each character."""
        weights = [w for w, _ in self.matches(text)]
        if not weights:
            return [0.0, 0.0, 0.0]
        return [max(weights), math.log1p(max(sum(weights), 0.0)), math.log1p(1e4 * len(weights) / (len(text) + 200))]


def choose_terms(found: list[tuple[str, int, int]], toxic: int, other: int) -> dict[str, float]:
    """Weights of word beginnings, from (beginning, toxic texts, other texts) with it; of nested ones the longest that loses no toxic text, else the shorter."""
    weight = {t: math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (other + 1)) for t, a, b in found}
    count = {t: a for t, a, _ in found}
    kept: dict[str, float] = {}
    for t in sorted(count, key=lambda t: (len(t), t)):
        if any(t[:n] in kept for n in range(SHORTEST, len(t))):
            continue
        longer = [u for u in count if len(u) > len(t) and u.startswith(t) and count[u] >= 0.9 * count[t]]
        if not longer:
            kept[t] = weight[t]
    return kept


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method with a small ridge."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        ridge = 1e-2 * np.eye(len(w))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def classify(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, threshold: float = 0.5, fit_rows: int = FIT_ROWS, carry: bool = False) -> DataFrame:
    """Returns ``key``, held_out, score and predicted (1 if the score is ``threshold`` or more).

    With ``carry`` it returns the rows of ``docs`` that are predicted 0, whole.
    """
    spark = docs.sparkSession
    sample = fitting_rows(docs, labels, label, key=key, text=text, folds=folds, limit=fit_rows).select("text", "label")

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ta.only_now()
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen = {w[:n] for w in set(WORD.findall((t or "").lower())) for n in range(SHORTEST, min(len(w), LONGEST) + 1)}
                yield pa.RecordBatch.from_arrays([pa.array(["", *seen], pa.string()), pa.array([y] * (len(seen) + 1), pa.int32())], names=["term", "label"])
        ta.release()

    counted = sample.mapInArrow(beginnings, "term string, label int").groupBy("term").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    totals = {r["term"]: (r["a"], r["b"]) for r in counted.where("term = ''").collect()}
    toxic, other = totals.get("", (0, 0))
    odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (other + 1))
    found = counted.where((F.col("term") != "") & (F.col("a") >= LEAST_TOXIC) & (odds >= LEAST_WEIGHT)).orderBy(F.desc("a"), "term").limit(TERMS).collect()
    terms = choose_terms([(r["term"], r["a"], r["b"]) for r in found], toxic, other)

    def describe(batches: Iterator[pa.RecordBatch], terms=terms) -> Iterator[pa.RecordBatch]:
        g = Grammar(terms, {"target": 1.0, "negation": 1.0, "reported": 1.0})
        for b in batches:
            rows = []
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                met = dict.fromkeys(("plain", "target", "negation", "reported"), 0)
                for _, m in g.matches(t or ""):
                    for k, v in m.items():
                        met[k] += v
                rows.append((y, met["plain"], met["target"], met["negation"], met["reported"], *g.features(t or "")))
            yield pa.RecordBatch.from_arrays([pa.array([float(v) for v in c], pa.float64()) for c in zip(*rows)], names=["y", "plain", "target", "negation", "reported", "f0", "f1", "f2"])

    got = np.array([tuple(r) for r in sample.mapInArrow(describe, "y double, plain double, target double, negation double, reported double, f0 double, f1 double, f2 double").collect()]).reshape(-1, 8)
    got = got[np.lexsort(got.T)]
    y = got[:, 0]
    # A scale is the share of toxic texts among the matches it met, against that among plain ones.
    share = lambda c: ((got[y == 1, c] > 0).sum() + 0.9) / ((got[:, c] > 0).sum() + 1.0)
    scales = {n: float(np.clip(share(c) / share(1), 0.1, 1.5)) for n, c in (("target", 2), ("negation", 3), ("reported", 4))} if len(got) else {"target": 1.0, "negation": 0.5, "reported": 0.5}
    w, bias = fit_curve(got[:, 5:8], y) if len(got) else (np.zeros(3), -30.0)
    model = spark.sparkContext.broadcast((terms, scales, w, bias))

    def scores(g: Grammar, texts: pa.Array, w: np.ndarray, bias: float) -> np.ndarray:
        x = np.array([g.features(t or "") for t in texts.to_pylist()]).reshape(-1, 3)
        p = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30)))
        return np.where(p < 1e-12, 0.0, p)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ta.only_now()
        terms, scales, w, bias = model.value
        g = Grammar(terms, scales)
        for b in batches:
            yield b.filter(pa.array(scores(g, b.column(b.schema.names.index(text)), w, bias) < threshold))
            ta.release()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, scales, w, bias = model.value
        g = Grammar(terms, scales)
        for b in batches:
            p = scores(g, b.column(1), w, bias)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    if carry:
        return docs.mapInArrow(pick, docs.schema)
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).select("key", "text", held_out("key", folds).alias("held_out"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(score, f"`{key}` {kind}, held_out boolean, score double, predicted int")
