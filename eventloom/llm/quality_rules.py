"""Quality rules joined by weak supervision, in DataFrame functions alone.

Each rule votes that a text is good (1), bad (-1) or abstains (0).  The table of
vote patterns, of 3**rules rows at most, is counted once over the corpus;
expectation-maximisation on it estimates how often each rule votes good on good
texts and bad on bad ones, and the share of good texts.  A text's posterior
probability of being good then decides, not the single rules.

Defined results: null and empty texts have no words, fail the base rule and are
not kept; repeated rows are judged alike; without any row nothing is fitted and
the result is empty.  Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import settle

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: Rounds of expectation-maximisation at most, and the change below which it ends.
ROUNDS, CHANGE = 25, 1e-4
#: First values, which are also the means of the accuracies' priors: a rule seldom
#: votes bad on a good text, and knows one kind of bad text among several.
FIRST_PRIOR, FIRST_GOOD, FIRST_BAD = 0.85, 0.995, 0.2
#: Weight of these priors, as votes: a fixed number, so what the corpus says outweighs it.
PRIOR_VOTES = 50.0
KEEP = 0.5


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The rules' votes over the columns that measures() makes."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    few = F.col("n_words") < 20
    return {
        "length": _vote(F.col("n_words") >= 40, few),
        "symbols": _vote(F.col("n_symbols") * 50 <= n, F.col("n_symbols") * 5 > n),
        "density": _vote(F.col("n_symbols") * 50 <= chars, F.col("n_symbols") * 15 > chars),
        "symbol_words": _vote(F.col("n_symbol_runs") * 20 <= n, F.col("n_symbol_runs") * 5 > n),
        "lines": _vote(F.col("n_dup_lines") == 0, F.col("n_dup_lines") * 2 > F.col("n_lines")),
        "repeats": _vote(F.col("n_repeat_words") == 0, F.col("n_repeat_words") * 10 > n * 3),
        "variety": F.when(few, 0).otherwise(_vote(F.col("n_distinct") * 4 >= n, F.col("n_distinct") * 10 < n)),
        "word_length": F.when(few, 0).otherwise(_vote(F.col("word_chars").between(n * 3, n * 9), ~F.col("word_chars").between(n * 2, n * 12))),
        "capitals": F.when(few, 0).otherwise(_vote(F.col("n_capitals") * 10 <= chars, F.col("n_capitals") * 10 > chars * 4)),
        "marks": F.when(few, 0).otherwise(_vote(F.col("n_marks") * 20 <= n, F.col("n_marks") * 2 > n)),
    }


def measures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and the counts of each text."""
    df = docs.select(docs[key].alias("key"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    df = df.select("key", "t", F.array_remove(F.split("t", SPACE), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    df = df.select("*", F.transform("w", lambda x: F.xxhash64(x)).alias("k"))
    runs = F.when(F.size("k") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("k") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("k", i, WINDOW))))
    df = df.select("*", runs.alias("r"))
    without = lambda p: (F.length("t") - F.length(F.regexp_replace("t", p, ""))).cast("long")
    df = df.select(
        "key",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        without(r"[#*$%&|<>]").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]+")).cast("long").alias("n_symbol_runs"),
        without(r"[A-Z]+").alias("n_capitals"),
        without(r"!+").alias("n_marks"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("k")).cast("long").alias("n_distinct"),
        F.when(F.size(F.array_distinct("r")) < F.size("r"), F.array_sort(F.transform("r", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"),
    )
    # Windows with an equal neighbour in hash order, by place; each covers up to the next one, the last all its words.
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    df = df.withColumn("p", F.array_sort(F.transform(F.filter("s", lambda x, i: same(F.get("s", i - 1), x) | same(F.get("s", i + 1), x)), lambda x: x["i"])))
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("p", i + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("s", "p")


def fit(votes: DataFrame, names: list[str], *, rounds: int = ROUNDS) -> dict[str, float]:
    """Share of good texts and each rule's (good on good, bad on bad), from the table of vote patterns."""
    patterns = settle(votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "patterns")
    p = {"prior": FIRST_PRIOR} | {f"good_{r}": FIRST_GOOD for r in names} | {f"bad_{r}": FIRST_BAD for r in names}
    for _ in range(rounds):
        # The posterior is a column of its own below the sums, not a part of each of them.
        now = patterns.withColumn("good", posterior(p, names))
        w, v = F.col("n") * F.col("good"), F.col("n") * (1 - F.col("good"))
        sums = [F.sum(w).alias("prior"), F.sum("n").alias("n")]
        for r in names:
            sums += [F.sum(F.when(F.col(r) == 1, w)).alias(f"gg_{r}"), F.sum(F.when(F.col(r) != 0, w)).alias(f"g_{r}"), F.sum(F.when(F.col(r) == -1, v)).alias(f"bb_{r}"), F.sum(F.when(F.col(r) != 0, v)).alias(f"b_{r}")]
        s = now.agg(*sums).first().asDict()
        if not s["n"]:
            return p
        ratio = lambda x, y, mean: ((x or 0.0) + mean * PRIOR_VOTES) / ((y or 0.0) + PRIOR_VOTES)
        old, p = p, {"prior": (s["prior"] + 1) / (s["n"] + 2)}
        for r in names:
            p[f"good_{r}"] = ratio(s[f"gg_{r}"], s[f"g_{r}"], FIRST_GOOD)
            p[f"bad_{r}"] = ratio(s[f"bb_{r}"], s[f"b_{r}"], FIRST_BAD)
        if max(abs(p[k] - old[k]) for k in p) < CHANGE:
            break
    return p


def posterior(p: dict[str, float], names: list[str]) -> Column:
    """Probability that a text with these votes is good."""
    odds = F.lit(math.log(p["prior"] / (1 - p["prior"])))
    for r in names:
        a, b = p[f"good_{r}"], p[f"bad_{r}"]
        odds += F.when(F.col(r) == 1, math.log(a / (1 - b))).when(F.col(r) == -1, math.log((1 - a) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: float = KEEP) -> DataFrame:
    """Measures, base_failed, posterior and kept of every text."""
    measured = settle(measures(docs, key, text), "measures")
    voted = measured.select("*", *(v.alias(f"vote_{r}") for r, v in rules().items()))
    names = [f"vote_{r}" for r in rules()]
    p = fit(voted, names)
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    out = voted.select("*", failed.alias("base_failed"), posterior(p, names).alias("posterior"))
    return out.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("posterior") >= keep)).alias("kept"), "posterior")
