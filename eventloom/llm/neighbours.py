"""Quality by nearest labelled neighbours in a latent semantic space.

A text's terms are its byte trigrams, hashed to BINS bins, and marks of its shape
(how much of it repeats, is upper case, is symbols).  Logarithmic counts times
inverse document frequency are projected on the leading right singular vectors of
the labelled texts' matrix.  Those texts' unit vectors go to all executors; each
text's cosines with all of them are computed exactly, block by block, and its
NEIGHBOURS nearest vote with their labels, weighted by similarity.

The labelled texts are a bounded sample, FIT_ROWS at most, the least by a hash of
the id; everything else is done for every text.

Defined results: null and empty texts, and all texts where no row is labelled, get
the labels' mean (0.5 without any); repeated rows get equal scores; rows of a
null id are scored and never held out.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta

FIT_ROWS, BINS, DIMENSIONS, NEIGHBOURS = 6000, 1024, 64, 25
#: Similarities are raised to this power as weights.
SHARPNESS = 8
#: Texts whose cosines with all labelled texts are in memory at once.
BLOCK = 512

_A, _B, _C = (ta.splitmix(np.arange(k, k + 256, dtype=np.uint64)).astype(np.uint16) for k in (11, 977, 5003))
_UPPER, _SYMBOL, _LETTER = (np.zeros(256, np.uint8) for _ in range(3))
_UPPER[65:91] = 1
_SYMBOL[[ord(c) for c in "#*$%&|<>!@^~_=+\\/{}[]"]] = 1
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1
#: Marks of shape stand after the trigrams, each in a few grades.
GRADES, SHAPES = 8, 5
WIDTH = BINS + SHAPES * GRADES


def held_out(key: str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo folds, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fitting_rows(docs: DataFrame, labels: DataFrame, label: str, *, key: str, text: str, folds: int, limit: int) -> DataFrame:
    """(key, text, label) of a bounded sample of labelled rows that are not held out; of documents with one id the least text."""
    chosen = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("label")).where(F.col("key").isNotNull() & F.col("label").isNotNull()).where(~held_out("key", folds))
    chosen = chosen.groupBy("key").agg(F.max("label").alias("label")).orderBy(F.xxhash64("key"), "key").limit(limit)
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    return rows.join(F.broadcast(chosen), "key").groupBy("key", "label").agg(F.min("text").alias("text")).select("key", "text", "label")


def term_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """[text, term] of a few texts."""
    n, rows = len(data), len(off) - 1
    out = np.zeros((rows, WIDTH), np.float32)
    sizes = np.diff(off)
    if n >= 3:
        code = (_A[data[:-2]] ^ _B[data[1:-1]] ^ _C[data[2:]]) % BINS
        row = np.repeat(np.arange(rows, dtype=np.int64), sizes)
        inside = row[:-2] == row[2:]
        out[:, :BINS] = np.bincount((row[:-2] * BINS + code)[inside], minlength=rows * BINS).reshape(rows, BINS)
    safe = np.maximum(sizes, 1)
    sums = lambda table: np.diff(np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))[off])
    keys, at = ta.word_keys(data, off)
    pairs, pair_rows = ta.shingle_keys(keys, at, 2)
    variety = np.array([len(np.unique(pairs[a:b])) / max(b - a, 1) for a, b in zip(pair_rows[:-1], pair_rows[1:])])
    letters = np.maximum(sums(_LETTER), 1)
    shapes = [np.where(np.diff(at) > 20, 1 - variety, 0), sums(_UPPER) / letters, sums(_SYMBOL) / safe * 2, np.minimum(np.log2(safe / np.maximum(np.diff(at), 1) / 6 + 1e-9) / 4 + 0.25, 1), np.log2(safe) / 20]
    for k, x in enumerate(shapes):
        grade = np.clip((x * GRADES).astype(int), 0, GRADES - 1)
        out[np.arange(rows), BINS + k * GRADES + grade] = 1
    return out


def weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    tf = np.log1p(counts)
    norm = np.linalg.norm(tf[:, :BINS], axis=1, keepdims=True)
    tf[:, :BINS] /= np.maximum(norm, 1e-9)
    tf[:, BINS:] *= 0.25
    return tf * idf


class Space:
    """idf, projection, unit vectors of the labelled texts, and their labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        self.mean = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
        x = weighed(counts, self.idf)
        _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
        self.basis = vectors[:, ::-1][:, :DIMENSIONS].astype(np.float32)
        self.units = self.unit(x)

    def unit(self, x: np.ndarray) -> np.ndarray:
        v = x @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.mean)
        cosines = self.unit(weighed(counts, self.idf)) @ self.units.T
        # Rounded, so that a block's shape doesn't decide between equal ones; all that are as near as the last neighbour vote.
        cosines = np.round(cosines, 5)
        k = min(NEIGHBOURS, cosines.shape[1])
        last = -np.partition(-cosines, k - 1, axis=1)[:, k - 1 : k]
        row, near = np.nonzero(cosines >= last)
        weight = np.maximum(cosines[row, near], 1e-3).astype(np.float64) ** SHARPNESS
        return np.bincount(row, weight * self.labels[near], len(cosines)) / np.bincount(row, weight, len(cosines))


def classify(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Returns ``key``, held_out, score and predicted (1 if the score is ``threshold`` or more)."""
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = ta.buffers(b.column(1))
            for i, j in ta.pieces(off):
                x = term_counts(data[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], names=["key", "label", "terms"])

    sample = fitting_rows(docs, labels, label, key=key, text=text, folds=folds, limit=fit_rows)
    kind = sample.schema["key"].dataType.simpleString()
    got = sorted(sample.mapInArrow(count, f"key {kind}, label int, terms binary").collect(), key=lambda r: (r["key"], r["terms"]))
    matrix = np.stack([np.frombuffer(r["terms"], np.float32) for r in got]) if got else np.zeros((0, WIDTH), np.float32)
    space = spark.sparkContext.broadcast(Space(matrix, np.array([r["label"] for r in got], np.int64)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space.value
        for b in batches:
            data, off = ta.buffers(b.column(1))
            parts = []
            for i, j in ta.pieces(off):
                for k in range(i, j, BLOCK):
                    m = min(j, k + BLOCK)
                    x = s.score(term_counts(data[off[k] : off[m]], off[k : m + 1] - off[k]))
                    parts.append(np.where(np.diff(off[k : m + 1]) == 0, s.mean, x))
            x = np.clip(np.concatenate(parts) if parts else np.zeros(0), 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x), pa.array((x >= threshold).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).select("key", "text", held_out("key", folds).alias("held_out"))
    return rows.mapInArrow(score, f"`{key}` {kind}, held_out boolean, score double, predicted int")
