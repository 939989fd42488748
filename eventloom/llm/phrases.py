"""Document fingerprints by locally consistent parsing.

A text's UTF-8 bytes are parsed into phrases, these into longer phrases, and so
on.  On each level runs of one symbol become one symbol; deterministic coin
tossing compares each symbol with the one before it (the lowest bit in which they
differ, and that bit) three times, which leaves labels below 8 with no two equal
neighbours; a phrase begins at each local maximum of the labels and is named by a
hash of its symbols.  Whether a phrase begins somewhere depends on a few symbols
around that place alone, so equal substrings get equal names inside, wherever
they stand.

A fingerprint has the 64 smallest hashed names of levels 2 to 6 (phrases of some
9 bytes and more) and the 16 smallest of level 1, as hexadecimal text.  Likeness
is the estimated Jaccard similarity of the sets of names, on level 1 only where
one text has under 8 longer phrases.

Defined results: a null text counts as an empty one; an empty text has the
fingerprint ":" and likeness 1 to another empty text, else 0.  Rows with one
doc_id follow each other by text, null ids stand last, each row is one document;
a single row is followed by itself.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textarrays import powers, splitmix

LEVELS = 6
COARSE, FINE, FEW = 64, 16, 8
#: Bytes of text that are parsed at once; a longer text is parsed alone.
BLOCK_BYTES = 1 << 19

_U = np.uint64
_BYTE_NAME = splitmix(np.arange(1000, 1256, dtype=_U))
_a, _b = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
_low = np.log2(np.maximum((_a ^ _b) & -(_a ^ _b), 1)).astype(int)
#: [before, this]: twice the lowest bit in which they differ, and that bit of this.
_TOSS = (2 * _low + (_b >> _low & 1)).astype(np.uint8).ravel()
del _a, _b, _low


def _toss(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.empty_like(labels)
    idx = labels[:-1].astype(np.uint16)
    idx <<= 8
    idx |= labels[1:]
    out[1:] = _TOSS[idx]
    out[first] = labels[first] & 1
    return out


def _toss_names(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.empty(len(names), np.uint8)
    diff = names[1:] ^ names[:-1]
    diff &= ~diff + _U(1)
    k = (diff.astype(np.float64).view(np.int64) >> 52) - 1023
    out[1:] = 2 * k + ((names[1:] & diff) != 0)
    out[first] = (names[first] & _U(1)).astype(np.uint8)
    return out


def parse(data: np.ndarray, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Names of the phrases of each level, and each text's range in them."""
    levels, symbols, names = [], data, None
    for _ in range(LEVELS):
        n = len(symbols)
        if not n:
            break
        starts = rows[:-1][np.diff(rows) > 0]
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
        new[starts] = True
        if names is None:
            names = _BYTE_NAME[symbols]
        if not new.all():
            at = np.flatnonzero(new)
            runs = np.diff(np.append(at, n))
            names, symbols = names[at], symbols[at]
            long = runs > 1
            names[long] = splitmix(names[long] ^ splitmix(runs[long].astype(_U)))
            rows = np.searchsorted(at, rows)
            starts = rows[:-1][np.diff(rows) > 0]
            n = len(at)
        labels = symbols if symbols.dtype == np.uint8 else _toss_names(symbols, starts)
        for _ in range(3 if symbols.dtype == np.uint8 else 2):
            labels = _toss(labels, starts)
        up = labels[1:] > labels[:-1]
        begins = np.zeros(n, bool)
        begins[1:-1] = up[:-1] & ~up[1:]
        # The first and the last symbol of a text have no neighbour on one side.
        begins[rows[1:][np.diff(rows) > 0] - 1] = False
        begins[starts] = True
        at = np.flatnonzero(begins)
        up_to, down = powers(n + 1)
        total = np.empty(n + 1, _U)
        total[0] = 0
        np.cumsum(names * up_to[:n], out=total[1:])
        ends = np.append(at[1:], n)
        names = splitmix((total[ends] - total[at]) * down[at] ^ (ends - at).astype(_U))
        rows = np.searchsorted(at, rows)
        symbols = names
        levels.append((names, rows))
    return levels


def _smallest(names: np.ndarray, k: int) -> np.ndarray:
    return np.unique((splitmix(names) >> _U(32)).astype(">u4"))[:k]


def fingerprints(texts: list[bytes]) -> list[str]:
    rows = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    levels = parse(np.frombuffer(b"".join(texts), np.uint8), rows)
    out = []
    for i in range(len(texts)):
        own = [x[r[i] : r[i + 1]] for x, r in levels]
        coarse = _smallest(np.concatenate([x for x in own[1:]] or [np.zeros(0, _U)]), COARSE)
        fine = _smallest(own[0], FINE) if own else coarse
        out.append(f"{coarse.tobytes().hex()}:{fine.tobytes().hex()}")
    return out


def _sets(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    a, _, b = fingerprint.partition(":")
    return np.frombuffer(bytes.fromhex(a), ">u4"), np.frombuffer(bytes.fromhex(b), ">u4")


def likeness(x: str, y: str) -> float:
    """Estimated Jaccard similarity of two texts' phrase names."""
    if x == y:
        return 1.0
    (a, fa), (b, fb) = _sets(x), _sets(y)
    k = COARSE
    if min(len(a), len(b)) < FEW:
        a, b, k = fa, fb, FINE
    if not len(a) or not len(b):
        return 0.0
    seen, counts = np.unique(np.concatenate((a, b)), return_counts=True)
    # Below the k-th smallest of both, and where a set was cut off, below its last, each set is whole.
    return float((counts[:k] == 2).mean())


def _rows_of(block: list[tuple], keys: pa.DataType) -> pa.RecordBatch:
    """block: (key, text, next text), the text of each being the next of the one before or not."""
    out: dict[str, list] = {c: [] for c in ("key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
    texts, edits = [], []
    for _, text, after in block:
        half = len(text) // 2
        edits.append((text[: len(text) - half] + after[:half]).encode())
        texts.append(text.encode())
    texts.append(block[-1][2].encode())
    prints = fingerprints(texts + edits)
    m = len(block)
    for i, (key, text, _) in enumerate(block):
        edited = prints[m + 1 + i]
        for c, v in zip(out, (key, len(text), hashlib.sha256(edits[i]).hexdigest(), prints[i], edited, likeness(prints[i], edited), likeness(prints[i], prints[i + 1]))):
            out[c].append(v)
    return pa.RecordBatch.from_arrays([pa.array(out["key"], keys), pa.array(out["n_chars"], pa.int64()), *(pa.array(out[c], pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), *(pa.array(out[c], pa.float64()) for c in ("near_edited", "near_next"))], names=["doc_id", *list(out)[1:]])


_LAST = (1 << 63) - 1


def with_successors(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (bucket, guest, order, key, text) dealt by ranges of the key.

    Each range also gets, as guest, the first row of the next one (the last range
    that of the first), so every row stands before its successor in one task.
    What goes to the driver is two numbers for each range.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[key].cast("bigint").alias("key"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("order", F.coalesce("key", F.lit(_LAST)))
    probs = [i / parts for i in range(1, parts)]
    found = rows.agg(F.percentile_approx("order", F.array(*map(F.lit, probs or [0.5])), F.lit(max(10_000, 20 * parts))).alias("q")).first()["q"]
    splits = np.unique(np.array(found or [0], np.int64))

    @F.pandas_udf(T.IntegerType())
    def bucket(order: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splits, order.to_numpy(np.int64), "right").astype(np.int32))

    firsts = {r[0]: r[1] for r in rows.groupBy(bucket("order").alias("b")).agg(F.min("order").alias("m")).collect()}
    used = sorted(firsts)
    before = {b: used[i - 1] for i, b in enumerate(used)}

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def places(order: pd.Series) -> pd.Series:
        o = order.to_numpy(np.int64)
        return pd.Series([[b, before[b]] if v == firsts[b] else [b] for b, v in zip(np.searchsorted(splits, o, "right").tolist(), o.tolist())])

    return rows.select("key", "text", "order", F.posexplode(places("order")).alias("guest", "bucket")).repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", "order", "text")


def fingerprint_successors(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text, and its edited text: its last half replaced by as much of the next document's beginning."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (bucket, key, text): the rows that wait for their successor
        size, closed = 0, None
        def flush(keep_last: bool) -> Iterator[pa.RecordBatch]:
            block = [(held[i][1], held[i][2], held[i + 1][2]) for i in range(len(held) - 1)]
            if block:
                yield _rows_of(block, pa.int64())
            del held[: -1 if keep_last else None]
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(len(batch)):
                b, guest = col["bucket"][i].as_py(), col["guest"][i].as_py()
                if guest and b == closed:
                    continue
                t = col["text"][i].as_py()
                held.append((b, col["key"][i].as_py(), t))
                size += 2 * len(t)
                if guest:
                    closed = b
                    yield from flush(False)
                    size = 0
                elif size > BLOCK_BYTES and len(held) > 1:
                    yield from flush(True)
                    size = 2 * len(t)

    schema = f"{key} bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_successors(docs, key, text).mapInArrow(run, schema)
