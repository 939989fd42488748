"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is dealt in blocks of BLOCK words.  Sources get blocks by the highest
quotients target / (2 * blocks + 1), and each source's blocks go to its shards,
which are hashed by the document's id, in the same way by their sizes; no shard
gets more than two passes.  In a shard documents stand in a seeded order; its
quota is a number of whole passes and a run of blocks from a seeded place, so
what a document gives follows from where it stands in the shard.

The driver gets a row for each source and each shard, SHARDS and the number of
sources at most; a shard's rows are sorted in one task, and a large source has
many shards.

Defined results: null and wordless texts have size 0 and give nothing; a null
source is one source, the last; rows of one id, or of a null one, are in one shard
and follow each other by size, so equal rows get what they get in some order;
sources without words have the target 0; without any words all targets are 0.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import settle

WEIGHTS, SHARE, REPEATS = (5.0, 2.0, 1.0), 1.5, 2.0
BLOCK, SHARD_WORDS, SHARDS, SEED = 8, 1 << 16, 1 << 16, 20240229
#: Rows of the source and shard tables, of five short columns each, that are sent to all executors.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = REPEATS) -> list[float]:
    """Shares by weight of share * all sizes; where one is above most * its size, the excess is reshared."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def sainte_lague(votes: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients votes / (2 * own seats + 1); ties go to the first; none above its cap."""
    total = sum(votes)
    if seats <= 0 or total <= 0:
        return [0] * len(votes)
    caps = caps or [seats] * len(votes)
    start = seats - len(votes) / 2 - 1
    # floor(votes / divisor + 1/2) is what the quotients give for some smaller number of seats.
    out = [min(math.floor(v * start / total + 0.5), c) if start > 0 else 0 for v, c in zip(votes, caps)]
    heap = [(-v / (2 * s + 1), i) for i, (v, s, c) in enumerate(zip(votes, out, caps)) if v > 0 and s < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def _table(spark: SparkSession, rows: list[tuple], **columns: pa.DataType) -> DataFrame:
    """Rows of the driver go to the JVM as Arrow; a list of them would start Python workers in every executor, which stay."""
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(columns.values())], names=list(columns)))


def _small(table: DataFrame, rows: int) -> DataFrame:
    """A table of the driver, of a known number of rows: broadcast up to a bound, else joined by a sort, whose hot keys are split."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table.hint("merge")


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """Returns ``key``, size, source_size, target and taken of every document.

    With ``carry`` also these columns of ``docs``, and passes, from_1, to_1, from_2
    and to_2: the whole copies, and the ranges of its words (from 0, end excluded),
    that the mix takes of the document.
    """
    spark = docs.sparkSession
    names = {c: f"carry_{i}" for i, c in enumerate(carry or [])}
    source_key = F.coalesce(F.concat(F.lit("s"), docs[source].cast("string")), F.lit("n"))
    sized = docs.select(docs[key].alias("key"), source_key.alias("source"), words(docs[text].cast("string")).alias("size"), *(docs[c].alias(n) for c, n in names.items()))
    if not names:
        sized = settle(sized, "sizes")
    found = {r["source"]: r["size"] for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    order = sorted(found, key=lambda s: (s == "n", s))
    sizes = [found[s] for s in order]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(order))], share)
    total = sum(sizes)
    quotas = dict(zip(order, sainte_lague(aims, round(sum(aims) / BLOCK))))
    count = {s: max(1, min(-(-found[s] // SHARD_WORDS), SHARDS * found[s] // max(total, 1))) for s in order}
    by_source = _table(spark, [(s, found[s], t, count[s]) for s, t in zip(order, aims)], source=pa.string(), source_size=pa.int64(), target=pa.float64(), shards=pa.int64())
    placed = sized.join(_small(by_source, len(order)), "source").withColumn("tie", F.xxhash64("key", F.lit(seed))).withColumn("shard", F.pmod("tie", "shards"))
    shards: dict[str, list[tuple[int, int]]] = {}
    for r in placed.groupBy("source", "shard").agg(F.sum("size").alias("size")).collect():
        shards.setdefault(r["source"], []).append((r["shard"], r["size"]))
    dealt = []
    for s in order:
        own = sorted(shards.get(s, []))
        blocks = [-(-z // BLOCK) for _, z in own]
        for (k, z), n, q in zip(own, blocks, sainte_lague([z for _, z in own], quotas[s], [int(REPEATS) * n for n in blocks])):
            dealt.append((s, k, z, n, q))
    quota = _table(spark, dealt, source=pa.string(), shard=pa.int64(), shard_size=pa.int64(), blocks=pa.int64(), quota=pa.int64())
    in_shard = Window.partitionBy("source", "shard").orderBy(F.xxhash64("tie", F.lit(seed)), "key", "size")
    df = placed.join(_small(quota, len(dealt)), ["source", "shard"]).withColumn("end", F.sum("size").over(in_shard.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.greatest("blocks", F.lit(1))
    df = df.withColumns({"start": F.col("end") - F.col("size"), "passes": F.floor(F.col("quota") / n).cast("long"), "run": F.pmod("quota", n), "first": F.pmod(F.xxhash64("source", "shard", F.lit(seed + 1)), n)})
    # The run of blocks, which may go on at the shard's beginning, as two ranges of words.
    ends = {
        "from_1": F.col("first") * BLOCK,
        "to_1": F.least((F.col("first") + F.col("run")) * BLOCK, F.col("shard_size")),
        "from_2": F.lit(0).cast("long"),
        "to_2": F.greatest(F.lit(0), (F.col("first") + F.col("run") - F.col("blocks")) * BLOCK),
    }
    clip = lambda x: F.least(F.greatest(x - F.col("start"), F.lit(0)), F.col("size")).cast("long")
    df = df.withColumns({k: clip(v) for k, v in ends.items()})
    piece = lambda a, b: F.greatest(F.col(b) - F.col(a), F.lit(0))
    df = df.withColumn("taken", F.col("passes") * F.col("size") + piece("from_1", "to_1") + piece("from_2", "to_2"))
    own = [F.col("key").alias(key), "size", "source_size", "target", "taken"]
    if names:
        own += ["passes", "from_1", "to_1", "from_2", "to_2", *(F.col(n).alias(c) for c, n in names.items() if c != key)]
    return df.select(*own)


def apply_mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed corpus in the columns of ``docs``: each document as often, and as much of it, as the mix takes."""
    taken = ("passes", "from_1", "to_1", "from_2", "to_2", "taken")
    columns = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    safe = docs.select(*(docs[c].alias(n) for c, n in columns.items()))
    df = mix(safe, key=columns[key], text=columns[text], source=columns[source], carry=list(columns.values()), **options).select(*columns.values(), "size", *taken)
    # Only a document that the run cuts is taken apart into its words; a whole one's words are joined by one space as text.
    all_words = F.array_remove(F.split(columns[text], r"[\x20\x09-\x0D]+"), "")
    whole = F.trim(F.regexp_replace(columns[text], r"[\x20\x09-\x0D]+", " "))
    cut = lambda a, b: F.array_join(F.slice(all_words, F.col(a).cast("int") + 1, (F.col(b) - F.col(a)).cast("int")), " ")
    part = lambda a, b: F.when((F.col(a) == 0) & (F.col(b) == F.col("size")) & (F.col(b) > 0), whole).when(F.col(b) > F.col(a), cut(a, b))
    pieces = F.concat(F.array_repeat(F.col(columns[text]), F.col("passes").cast("int")), F.array_compact(F.array(part("from_1", "to_1"), part("from_2", "to_2"))))
    out = df.withColumn("pieces", F.filter(pieces, lambda x: x.isNotNull())).where("taken > 0")
    out = out.select(*(F.col(n).alias(c) for c, n in columns.items() if c != text), F.explode("pieces").alias(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
