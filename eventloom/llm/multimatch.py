"""Set similarity join on word shingles with adaptive multi-match prefixes.

Each text is the set of its distinct word shingles.  Tokens have one order for
all texts, rare ones first, by sketches of the whole corpus.
A text of n tokens that needs an overlap of o with any partner may take as prefix
its first n - o + k tokens for any k: two linked texts then share at least the
smaller of their two k among their prefixes.  Each text picks the k whose
estimated cost (postings, and candidates by the sketch's counts divided by k) is
least, so texts made of frequent passages get long prefixes and must share several
tokens, the others short ones.  Candidates that share enough are verified exactly
on the whole sets.

Texts with equal sets are one class, and only classes are joined.  No group's
pairs are listed.  Each posting list has a leader (the class that shares most of its
prefix with others).  A class first meets the one leader with which it shares most
lists; these links are contracted to components, and only pairs of different
components are compared after that: pair by pair in short lists, and in long ones by
a prefix join on the differences from the leader.  This gives all links up to reachability, so the components are exact.

A pair's first shared tokens say how much the two sets can share at all: what stands
behind them, in the common order, must be enough for the overlap.  Pairs that can't
reach it are not listed.  Then counts of hashed bins, made when a text is first read,
bound the overlap, and only what is left has its texts read again.

Joins of tables that grow with the corpus are sort-merge joins at every size, whose
hot keys adaptive execution deals out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .components import connected_components
from .tables import discard, settle

SKETCH_BITS, SKETCH_PARTS = 21, 128
#: Ranks of tokens are logarithms to base 2 in these parts, whole numbers, so every machine orders them alike.
RANK_PARTS = 256
#: Bins of a set in which its tokens are counted.
BINS = 256
#: Bits of the filter on keys whose texts are read again.
FILTER_BITS = 24
#: The largest k of the prefixes.
MOST_MATCHES = 4
#: Lists of more classes than this are not joined pair by pair but by differences from their leader.
LIGHT = 24
#: Parts in which the rows of one component are dealt out.
SALTS = 16

_U = np.uint64


def _ordered(batch: pa.RecordBatch, at: int, width: int, rarity: Rarity) -> Iterator[tuple[int, int, list[np.ndarray], list[np.ndarray]]]:
    """Rows i to j of a batch with their distinct shingles, rare ones first, and the shingles' ranks."""
    data, off = ta.buffers(batch.column(at))
    for i, j in ta.pieces(off):
        words, rows = ta.word_keys(data[off[i] : off[j]], off[i : j + 1] - off[i])
        all_keys, ends = ta.shingle_keys(words, rows, width)
        all_ranks = rarity.ranks(all_keys, words, rows, width)
        sets, ranks = [], []
        for x, y in zip(ends[:-1], ends[1:]):
            keys, first = np.unique(all_keys[x:y], return_index=True)
            r = all_ranks[x:y][first]
            order = np.argsort(r, kind="stable")
            sets.append(keys[order])
            ranks.append(r[order])
        yield i, j, sets, ranks


def _digests(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, the same for equal sets."""
    out = []
    for salt in (0x510E527FADE682D1, 0x9B05688C2B3E6C1F):
        total = np.concatenate((np.zeros(1, _U), np.cumsum(ta.splitmix(keys ^ _U(salt)), dtype=_U)))
        out.append((total[rows[1:]] - total[rows[:-1]]).view(np.int64))
    return out[0], out[1]


class Rarity:
    """In how many texts a shingle is expected, from two sketches of the whole corpus, of fixed size.

    One counts the texts' distinct shingles in 2**SKETCH_BITS bins, which shows the
    passages that many texts share; the other counts words, whose shares multiply to
    what shingles of common words come to by chance.  A shingle's rank is the larger
    of the two as a logarithm.  The logarithms are rounded to whole numbers once, on
    the driver; executors only add and compare these.
    """

    def __init__(self, shingles: np.ndarray, words: np.ndarray):
        middle = float(np.median(shingles))
        excess = shingles - (middle + 3 * np.sqrt(middle) + 1)
        log = lambda x: np.round(np.log2(np.maximum(x, 1)) * RANK_PARTS).astype(np.int32)
        self.excess = np.where(excess > 0, log(excess + 1), NEVER).astype(np.int32)
        self.words = log(words)
        self.total = int(log(words.sum()))

    def ranks(self, shingles: np.ndarray, words: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
        """Ranks of the runs of ``width`` words, in the order of shingle_keys; texts of fewer words are as rare as can be."""
        logs = self.words[(words >> _U(64 - SKETCH_BITS)).astype(np.int64)]
        counts = np.diff(rows)
        many = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
        first = np.repeat(rows[:-1] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        full = np.repeat(counts >= width, many)
        chance = np.full(len(first), -(width - 1) * self.total, np.int32)
        for k in range(width):
            chance[full] += logs[first[full] + k]
        chance[~full] = NEVER
        return np.maximum(self.excess[(shingles >> _U(64 - SKETCH_BITS)).astype(np.int64)], chance)


#: A rank below all others.
NEVER = -(1 << 24)


def measure_rarity(texts: DataFrame, width: int) -> Rarity:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros((2, 1 << SKETCH_BITS), np.int32)
        held: tuple[list, list] = ([], [])

        def add_up() -> None:
            for one, keys in zip(bins, held):
                if keys:
                    at, n = np.unique(np.concatenate(keys), return_counts=True)
                    one[at] += n.astype(np.int32)
                    keys.clear()

        for b in batches:
            data, off = ta.buffers(b.column(0))
            for i, j in ta.pieces(off):
                keys, rows = ta.word_keys(data[off[i] : off[j]], off[i : j + 1] - off[i])
                for to, found in zip(held, (ta.distinct_sorted(*ta.shingle_keys(keys, rows, width))[0], keys)):
                    to.append((found >> _U(64 - SKETCH_BITS)).astype(np.int32))
                if sum(map(len, held[0])) > 1_000_000:
                    add_up()
        add_up()
        ta.release()
        if bins.any():
            parts = bins.reshape(SKETCH_PARTS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=["part", "bins"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, bins in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = np.frombuffer(zlib.decompress(bins), np.int32).astype(np.int64)
                sums[part] = sums[part] + got if part in sums else got
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["part", "bins"])

    rows = texts.mapInArrow(count, "part int, bins binary").repartition("part").mapInArrow(add, "part int, bins binary").collect()
    out = np.zeros((SKETCH_PARTS, (2 << SKETCH_BITS) // SKETCH_PARTS), np.int64)
    for r in rows:
        out[r["part"]] += np.frombuffer(zlib.decompress(r["bins"]), np.int64)
    shingles, words = out.reshape(2, -1)
    return Rarity(shingles, words)


def _prefix(keys: np.ndarray, ranks: np.ndarray, num: int, den: int) -> tuple[int, np.ndarray]:
    """k and the prefix of a set, given in order: the k of the least estimated cost."""
    n = len(keys)
    need = -(-num * n // den)
    most = min(MOST_MATCHES, need)
    cost = np.cumsum(np.exp2(ranks[: n - need + most] / RANK_PARTS))
    ks = np.arange(1, most + 1)
    ends = n - need + ks
    k = int(ks[np.argmin(cost[ends - 1] / ks + ends)])
    return k, keys[: n - need + k]


def _bins(keys: np.ndarray) -> bytes:
    return np.minimum(np.bincount((keys >> _U(56)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def link(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Group the texts whose shingle sets link, directly or over others: den * intersection >= num * union.

    Returns ``key``, n_shingles, component_id (the least key of all that can be
    reached) and class_id (the least key of those with an equal set).

    Defined results: null, empty and wordless texts have no shingles and are
    their own component; a text with fewer than ``width`` words is one shingle;
    repeated rows are in one component; rows with a null key take part, and a
    component of such rows alone has a null id.  Other columns are not read.
    """
    rows = docs.select(docs[key].cast("bigint").alias("key"), docs[text].cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(measure_rarity(rows.select("text"), width))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, sets, ranks in _ordered(b, 1, width, sent.value):
                ks, parts = zip(*(_prefix(x, r, num, den) if len(x) else (0, x) for x, r in zip(sets, ranks)))
                at = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
                h1, h2 = _digests(np.concatenate(sets), at)
                ends = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(h1), pa.array(h2), pa.array(ks, pa.int32()), ta.list_array(np.concatenate(parts).view(np.int64), ends), pa.array([_bins(x) for x in sets], pa.binary())], names=["key", "n", "h1", "h2", "k", "prefix", "bins"])

    signed = settle(rows.mapInArrow(sign, "key bigint, n bigint, h1 bigint, h2 bigint, k int, prefix array<bigint>, bins binary"), "signed")
    same = ("n", "k", "prefix", "bins")
    grouped = signed.where("n > 0").groupBy("h1", "h2").agg(F.min("key").alias("first_key"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in same))
    classes = settle(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    ids = settle(signed.select("key", "n", "h1", "h2"), "ids")
    discard(signed)
    roots = _components(_Corpus(rows, classes, sent, width, num, den))
    named = settle(classes.select("node", "h1", "h2", "first_key"), "names")
    discard(classes)
    found = roots.join(named.select("node", "first_key").hint("merge"), "node")
    # A component may hold a third of all classes, so its rows meet its least key in SALTS parts.
    least = found.groupBy("root").agg(F.min("first_key").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = found.select("node", "root", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt"))
    named = named.join(salted.join(least.hint("merge"), ["root", "salt"]).select("node", "component_id").hint("merge"), "node", "left").withColumn("component_id", F.coalesce("component_id", "first_key"))
    named = named.select("h1", "h2", F.col("first_key").alias("class_id"), "component_id")
    out = ids.where("n > 0").join(named.hint("merge"), ["h1", "h2"]).select("key", "n", "component_id", "class_id")
    out = out.unionByName(ids.where("n = 0").select("key", "n", F.col("key").alias("component_id"), F.col("key").alias("class_id")))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", "class_id")


class _Corpus(NamedTuple):
    """What the rounds of a join read."""

    rows: DataFrame
    classes: DataFrame
    rarity: Broadcast
    width: int
    num: int
    den: int

    def fits(self) -> Column:
        """Sizes n and n2 are near enough."""
        return (F.col("n") * self.den >= F.col("n2") * self.num) & (F.col("n2") * self.den >= F.col("n") * self.num)

    def may_link(self) -> Column:
        """Holds in the lists of a linked pair's first k shared tokens: what stands behind them in both sets is enough.

        The r-th shared token (from 0) has as many shared tokens from it on as the
        overlap less r, so behind the first k the two sets still have room for the
        overlap less k - 1.
        """
        room = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) + F.least("k", "k2") - 1
        return self.fits() & ((F.col("n") + F.col("n2")) * self.num <= room * (self.num + self.den))


def _components(c: _Corpus) -> DataFrame:
    """(node, root) of the classes that have links."""
    postings = c.classes.select("node", "k", F.posexplode("prefix").alias("place", "token"))
    common = postings.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("k").alias("least")).where("c > 1").select("token", "least")
    shared = settle(postings.select("node", "place", "token").join(common.hint("merge"), "token"), "shared")
    # A class meets partners only if it shares as many tokens as the smallest k in its lists, its own or a partner's; the leader of a list is the one that shares most.
    able = shared.groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.min("least").alias("least"))
    able = able.join(c.classes.select("node", "n", "k", "copies", F.size("prefix").alias("size")).hint("merge"), "node").where("m >= least").select("node", "n", "k", "copies", (F.col("m") / F.col("size")).alias("hub"))
    kept = settle(shared.select("node", "place", "token").join(able.hint("merge"), "node"), "postings")
    discard(shared)
    # First each class meets the leader of most of its lists.
    heads = _leaders(kept)
    met = kept.join(heads.hint("merge"), "token").where(c.may_link() & (F.col("node") != F.col("node2"))).groupBy("node", "node2").agg(F.count(F.lit(1)).alias("m"), F.first(F.least("k", "k2")).alias("k")).where("m >= k")
    best = met.groupBy("node").agg(F.max(F.struct("m", (-F.col("node2")).alias("x"))).alias("b")).select("node", (-F.col("b.x")).alias("node2"))
    ends = [F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")]
    tested = settle(best.select(*ends).distinct(), "tested")
    links = _verified(c, tested)
    roots = connected_components(links)
    # Then, in lists with several components, the pairs of different ones.
    lists = kept.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = lists.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("c")).where("x <> y").select("token", "c")
    lists = settle(lists.join(mixed.hint("merge"), "token"), "mixed")
    discard(kept)
    discard(roots)
    light = lists.where(F.col("c") <= LIGHT)
    second = light.select("token", *(F.col(x).alias(f"{x}2") for x in ("node", "place", "n", "k", "root")))
    pairs = light.join(second.hint("merge"), "token").where(c.may_link() & (F.col("root") != F.col("root2")) & (F.col("node") < F.col("node2")))
    near = pairs.groupBy("node", "node2").agg(F.count(F.lit(1)).alias("m"), F.first(F.least("k", "k2")).alias("k")).where("m >= k").select(*ends)
    close = _by_differences(c, lists.where(F.col("c") > LIGHT))
    near = settle(near.union(close).distinct().join(tested, ["a", "b"], "left_anti"), "near")
    for done in (lists, close, tested):
        discard(done)
    more = _verified(c, near)
    roots = connected_components(links.union(more))
    for done in (near, links, more):
        discard(done)
    return roots


def _leaders(lists: DataFrame) -> DataFrame:
    """For each token the class of its list that shares most of its prefix with others, has most copies, and is the first."""
    rank = F.struct("hub", "copies", (-F.col("node")).alias("first"), *(F.col(x).alias(f"{x}2") for x in ("node", "place", "n", "k")))
    return lists.groupBy("token").agg(F.max(rank).alias("h")).select("token", "h.node2", "h.place2", "h.n2", "h.k2")


def _verified(c: _Corpus, ready: DataFrame) -> DataFrame:
    """The pairs (a, b) of ready, a settled table of distinct ones, that link."""
    # Two sets share no more than the smaller count of each bin; most candidates end here, before their texts are read.
    small = c.classes.select("node", "n", "bins")
    likely = ready.join(small.toDF("b", "nb", "hb").hint("merge"), "b").join(small.toDF("a", "na", "ha").hint("merge"), "a")
    likely = likely.withColumn("i", _most_common(F.col("ha"), F.col("hb"))).where((F.col("na") + F.col("nb") - F.col("i")) * c.num <= F.col("i") * c.den).select("a", "b")
    likely = settle(likely, "likely")
    sets = _whole_sets(c, likely.select(F.col("a").alias("node")).union(likely.select("b")))
    both = likely.join(sets.toDF("b", "sb").hint("merge"), "b").join(sets.toDF("a", "sa").hint("merge"), "a")
    both = both.withColumn("i", F.size(F.array_intersect("sa", "sb")).cast("bigint")).where((F.size("sa") + F.size("sb") - F.col("i")) * c.num <= F.col("i") * c.den)
    out = settle(both.select("a", "b").distinct(), "links")
    discard(sets)
    discard(likely)
    return out


def _by_differences(c: _Corpus, heavy: DataFrame) -> DataFrame:
    """Candidates (a, b) of different components in long lists, without their pairs being listed.

    Each class is held as its difference from the list's leader: the tokens that
    one of the two has and the other lacks, D of them.  With c = (den - num) /
    (den + num), a and b link if and only if their symmetric difference, which is
    that of their differences, is at most c (|a| + |b|).  So the differences share
    (D_a + D_b - c (|a| + |b|)) / 2 tokens at least, and one at least unless both
    link to the leader, which then joins them.  With D_a <= D_b this bounds two
    prefixes, a short one of a and a longer one of b, in the common order but with
    the leader's own tokens last: all its near copies lack these.  What stands behind
    the first shared one in both differences must be enough, too.
    """
    heads = _leaders(heavy).select("token", F.col("node2").alias("leader"))
    met = heavy.join(heads.hint("merge"), "token").select("leader", "node", "n", "root").distinct()
    met = settle(met, "heavy")
    sets = _whole_sets(c, met.select("node").union(met.select("leader")))
    both = met.where("node <> leader").join(sets.toDF("node", "s").hint("merge"), "node").join(sets.toDF("leader", "sl").hint("merge"), "leader")
    # array_except keeps the order of its first array.
    delta = F.concat(F.array_except("s", "sl"), F.array_except("sl", "s"))
    both = both.select("leader", "node", "n", "root", delta.alias("delta"))
    share, t = (c.den - c.num) / (c.den + c.num), c.num / c.den
    need = lambda of: F.greatest(F.lit(1), F.ceil(F.col("d") - F.col("n") * of - 1e-9))
    both = both.withColumn("d", F.size("delta")).withColumns({"short": F.col("d") - need((1 - t) / (2 * t)) + 1, "long": F.col("d") - need((1 - t) / t) + 1})
    both = settle(both.select("leader", "node", "n", "root", "d", "short", F.slice("delta", F.lit(1), F.least("long", "d").cast("int")).alias("first")), "differences")
    discard(sets)
    one = both.select("leader", "node", "n", "root", "d", "short", F.posexplode("first").alias("place", "token"))
    two = one.select("leader", "token", *(F.col(x).alias(f"{x}2") for x in ("node", "n", "root", "d", "place")))
    first = F.struct("d", "node") < F.struct("d2", "node2")
    room = F.least(F.col("d") - F.col("place"), F.col("d2") - F.col("place2"))
    enough = F.col("d") + F.col("d2") - share * (F.col("n") + F.col("n2")) <= 2 * room + 1e-6
    pairs = one.where("place < short").join(two.hint("merge"), ["leader", "token"]).where(first & c.fits() & enough & (F.col("root") != F.col("root2")))
    close = pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
    # The leader itself against each class.
    own = met.where("node = leader").select("leader", F.col("n").alias("n2"), F.col("root").alias("root2")).distinct()
    at_leader = both.join(own.hint("merge"), "leader").where((F.col("d") <= share * (F.col("n") + F.col("n2")) + 1e-9) & (F.col("root") != F.col("root2")))
    out = settle(close.union(at_leader.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))), "close")
    discard(met)
    discard(both)
    return out


def _most_common(a: Column, b: Column) -> Column:
    """The most tokens that two sets can share by their bins; a full bin bounds nothing."""
    @F.pandas_udf("bigint")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int64")
        u, v = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, BINS) for s in (x, y))
        m = np.minimum(u, v)
        return pd.Series(np.where(m.max(1) < 255, m.sum(1, dtype=np.int64), 1 << 40))

    return run(a, b)


def _whole_sets(c: _Corpus, nodes: DataFrame) -> DataFrame:
    """(node, keys) of the classes in nodes, from their texts; keys in the common order.

    A bit for each hashed key, in a vector of fixed size, spares most of the other
    texts the way to the join that finds the rows.
    """
    wanted = settle(c.classes.join(nodes.distinct().hint("merge"), "node", "left_semi").select("node", F.col("first_key").alias("wanted_key"), "h1", "h2"), "wanted")
    bit = lambda x: F.pmod(F.xxhash64(x), F.lit(1 << FILTER_BITS))
    # 64 bits a row, so the driver gets 2**FILTER_BITS / 64 short rows at most.
    found = wanted.select(bit("wanted_key").alias("bit")).groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % 64).cast("int"))).alias("bits")).toArrow()
    words = np.zeros(1 << FILTER_BITS - 6, np.int64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy()
    sent, rarity, width = c.rows.sparkSession.sparkContext.broadcast(words), c.rarity, c.width

    @F.pandas_udf("boolean")
    def maybe(at: pd.Series) -> pd.Series:
        x = at.to_numpy(np.int64)
        return pd.Series((sent.value[x >> 6] >> (x & 63) & 1).astype(bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            w1, w2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            for i, j, sets, _ in _ordered(b, 1, width, rarity.value):
                at = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
                h1, h2 = _digests(np.concatenate(sets), at)
                nodes = b.column(0).slice(i, j - i).to_pylist()
                # Repeated rows of a class are read once in a task; its links are made distinct later.
                same = [x for x in np.flatnonzero((h1 == w1[i:j]) & (h2 == w2[i:j])) if nodes[x] not in done and not done.add(nodes[x])]
                if same:
                    ends = np.concatenate(([0], np.cumsum([len(sets[x]) for x in same])))
                    yield pa.RecordBatch.from_arrays([pa.array([nodes[x] for x in same], pa.int64()), ta.list_array(np.concatenate([sets[x] for x in same]).view(np.int64), ends)], names=["node", "keys"])

    joined = c.rows.where(maybe(bit("key"))).join(wanted.hint("merge"), c.rows["key"].eqNullSafe(F.col("wanted_key"))).select("node", "text", "h1", "h2")
    out = settle(joined.mapInArrow(run, "node bigint, keys array<bigint>"), "sets")
    discard(wanted)
    return out
