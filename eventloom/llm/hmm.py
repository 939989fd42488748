"""Hidden Markov language model over whole texts, trained by Baum-Welch.

Words are grouped into a bounded alphabet of symbols: the most frequent words
have one each, all others share those of their last three bytes' hash, and the
end of a text has one.  A word's probability is that of its symbol from the
hidden state times its share of the symbol's training count, so the model gives
every word, known or not, a probability, and needs K * symbols numbers whatever
the corpus's size.  Every round of Baum-Welch, from a start that knows only the
corpus's shares of the symbols, sums expected counts over all partitions.  Every training token is counted once, in the window of its text that
has it in its core; beside the core the recursions read some of the text's tokens on
both sides, after which what the states were further off hardly matters.  So texts of
CORE + LAG tokens are counted exactly, the start of a text only where it starts, and
moves between windows, too.  The exact likelihood of a text comes from the scaled
forward recursion over all its words.

Texts are kept in blocks of about BLOCK_WORDS words: a dictionary of the block's
distinct words and their places in the texts.  Counts meet the blocks by one join
on the distinct words of each block, not on all words.

Defined results: a null text counts as an empty one, which is the end token
alone; repeated rows are each counted and scored; without training rows counts
are 0 and all words equally unknown.  Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .tables import discard, settle

STATES, ROUNDS = 6, 12
TOP_WORDS, TAILS = 4096, 2048
#: Tokens of a window whose counts Baum-Welch takes from it, and those of the same text that it reads before and behind them.
CORE, LAG = 256, 24
BLOCK_WORDS = 1_600_000
SMOOTH = 0.1
SYMBOLS = TOP_WORDS + TAILS + 1
END = SYMBOLS - 1

_U = np.uint64


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dictionary, tail symbols, training counts; the rest, doc ids, training flags, words in each, tail symbols and places, as one value) of whole texts."""
    held: list[tuple] = []
    size = 0

    def close() -> pa.RecordBatch:
        ids = [x for h in held for x in h[0]]
        train = np.concatenate([h[1] for h in held])
        lens = np.concatenate([h[2] for h in held])
        keys = np.concatenate([h[3] for h in held])
        tails = np.concatenate([h[4] for h in held])
        words, first, places = np.unique(keys, return_index=True, return_inverse=True)
        # Frequent words first: their places are small numbers, which pack well.
        order = np.argsort(-np.bincount(places, minlength=len(words)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        words, first, places = words[order], first[order], rank[places]
        counts = np.bincount(places[np.repeat(train, lens)], minlength=len(words))
        binary = lambda *arrays: [pa.array([x], pa.binary()) for x in arrays]
        rest = pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), *binary(train.tobytes(), lens.astype(np.int32).tobytes(), tails[first].tobytes(), pack(places))], names=["ids", "train", "lens", "tails", "places"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rest.schema) as out:
            out.write_batch(rest)
        return pa.RecordBatch.from_arrays(binary(words.tobytes(), tails[first].tobytes(), counts.astype(np.int32).tobytes(), sink.getvalue().to_pybytes()), names=["words", "tails", "counts", "rest"])

    for b in batches:
        data, off = ta.buffers(b.column(2))
        ids, train = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for i, j in ta.pieces(off):
            d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
            starts, ends, rows = ta.word_bounds(d, o)
            tails = ta.span_keys(d, np.maximum(starts, ends - 3), ends)
            held.append((ids[i:j], train[i:j], np.diff(rows), ta.span_keys(d, starts, ends), (tails % _U(TAILS)).astype(np.uint16)))
            size += len(starts)
            if size >= BLOCK_WORDS:
                yield close()
                held, size = [], 0
    if held:
        yield close()
    held = []
    ta.release()


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2**24, each of their three bytes apart, compressed."""
    planes = numbers.astype("<i4").view(np.uint8).reshape(-1, 4)
    return zlib.compress(np.ascontiguousarray(planes[:, :3].T).tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(3, -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, :3] = planes.T
    return out.view("<i4").ravel()


class Model:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit
        #: [symbol, state], for gathers by symbol.
        self.by_symbol = np.ascontiguousarray(emit.T)

    @classmethod
    def guess(cls, unigram: np.ndarray, seed: int = 7) -> Model:
        noise = np.random.default_rng(seed).random((STATES, SYMBOLS)) + 0.5
        emit = (unigram + 1e-9) * noise
        move = np.full((STATES, STATES), 0.4 / (STATES - 1))
        np.fill_diagonal(move, 0.6)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(1, keepdims=True))

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: np.ndarray) -> Model:
        """Counts, smoothed towards the corpus's share of each symbol."""
        emit = emit + SMOOTH * 100 * unigram + 1e-6
        norm = lambda x: x / x.sum(-1, keepdims=True)
        return cls(norm(start + SMOOTH), norm(move + SMOOTH), norm(emit))


class Windows(NamedTuple):
    """Windows of texts: first place and size, tokens before the core, the core's size, and whether the text starts there."""

    first: np.ndarray
    size: np.ndarray
    skip: np.ndarray
    core: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, lens: np.ndarray) -> Windows:
        many = -(-lens // CORE)
        text = np.repeat(np.arange(len(lens)), many)
        begin = (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)) * CORE
        core = np.minimum(CORE, lens[text] - begin)
        skip = np.minimum(LAG, begin)
        size = skip + core + np.minimum(LAG, lens[text] - begin - core)
        return cls((np.cumsum(lens) - lens)[text] + begin - skip, size, skip, core, begin == 0)

    def take(self, at: np.ndarray) -> Windows:
        return Windows(*(x[at] for x in self))

    def alone(self, symbols: np.ndarray) -> tuple[np.ndarray, Windows]:
        """The windows' own symbols, one behind the other, and the windows over them."""
        total = int(self.size.sum())
        place = np.repeat(self.first - (np.cumsum(self.size) - self.size), self.size) + np.arange(total)
        return symbols[place], self._replace(first=np.cumsum(self.size) - self.size)


def expected_counts(m: Model, symbols: np.ndarray, windows: Windows, width: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Forward and backward recursions over windows: expected starts, moves and emissions of their cores, and the cores' log-likelihood.

    Steps are [state, window] in single precision, scaled at each token; sums over tokens are in double precision.
    """
    start, moves, emit, total = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, SYMBOLS)), 0.0
    emits, move = m.emit.astype(np.float32), m.move.astype(np.float32)
    into = np.ascontiguousarray(move.T)
    order = np.argsort(-windows.size, kind="stable")
    for lo in range(0, len(order), width):
        mine = windows.take(order[lo : lo + width])
        at, n = mine.first, mine.size
        steps, cols = int(n[0]), len(at)
        live = np.searchsorted(-n, -np.arange(steps), "left").tolist()  # windows longer than t
        place = np.arange(steps)[:, None]
        grid = np.where(place < n, symbols[np.minimum(at + place, len(symbols) - 1)], 0).astype(np.int64)
        counted = (place >= mine.skip) & (place < mine.skip + mine.core)
        alpha, b, scale = np.zeros((steps, STATES, cols), np.float32), np.empty((steps, STATES, cols), np.float32), np.ones((steps, cols), np.float32)
        for t in range(steps):
            c = live[t]
            np.take(emits, grid[t], axis=1, out=b[t], mode="clip")
            a = alpha[t, :, :c]
            if t:
                np.matmul(into, alpha[t - 1, :, :c], out=a)
            else:
                a[:] = np.where(mine.starts, m.start[:, None], 1 / STATES)
            a *= b[t, :, :c]
            a /= a.sum(0, out=scale[t, :c])
        total += float(np.log(scale[counted]).sum(dtype=np.float64))
        beta = np.ones((STATES, cols), np.float32)
        gamma = alpha  # becomes the posterior in place, from the end
        for t in range(steps - 1, 0, -1):
            c = live[t]
            w = b[t, :, :c]
            w *= beta[:, :c]
            w /= scale[t, :c]
            gamma[t, :, :c] *= beta[:, :c]
            np.matmul(move, w, out=beta[:, :c])
            w *= counted[t, :c]
            moves += alpha[t - 1, :, :c] @ w.T
        gamma[0] *= beta
        start += gamma[0][:, mine.starts].sum(1, dtype=np.float64)
        flat = np.where(counted, grid, SYMBOLS).ravel()
        for k in range(STATES):
            emit[k] += np.bincount(flat, weights=gamma[:, k].ravel(), minlength=SYMBOLS + 1)[:SYMBOLS]
    return start, moves * m.move, emit, total


def log_likelihoods(m: Model, symbols: np.ndarray, lens: np.ndarray, width: int = 512) -> np.ndarray:
    """Natural logarithm of each text's likelihood, by the scaled forward recursion over all its words."""
    out = np.zeros(len(lens))
    first = np.cumsum(lens) - lens
    order = np.argsort(-lens, kind="stable")
    order = order[: int((lens > 0).sum())]
    for lo in range(0, len(order), width):
        mine = order[lo : lo + width]
        at, n = first[mine], lens[mine]
        steps = int(n[0])
        live = np.searchsorted(-n, -np.arange(steps), "left")
        a = np.tile(m.start, (len(mine), 1))
        logs, product = np.zeros(len(mine)), np.ones(len(mine))
        for t in range(steps):
            c = live[t]
            a = a[:c]
            if t:
                a = a @ m.move
            a *= m.by_symbol[symbols[at[:c] + t]]
            s = a.sum(1)
            a /= s[:, None]
            product[:c] *= s
            if t % 16 == 15 or t == steps - 1 or live[t + 1] < c:
                logs[:c] += np.log(product[:c])
                product[:c] = 1.0
        out[mine] = logs
    return out


def _with_ends(symbols: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(symbols, np.cumsum(lens), END), lens + 1


def _array(batch: pa.RecordBatch, name: str, row: int, kind: type) -> np.ndarray:
    return np.frombuffer(batch.column(batch.schema.get_field_index(name))[row].as_buffer(), kind)


def _symbols(batch: pa.RecordBatch, row: int) -> np.ndarray:
    return unpack(batch.column(batch.schema.get_field_index("symbols"))[row].as_buffer()).astype(np.uint16)


def score(docs: DataFrame, *, key: str = "doc_id", text: str = "text", folds: int = 10, rounds: int = ROUNDS) -> DataFrame:
    """Train on the rows whose crc32(key as text) mod ``folds`` is not 0, score all.

    Returns ``key``, held_out, n_tokens, n_known, train_tokens, base_score and
    score, both scores log10 probabilities.  The driver gets the counts of
    TOP_WORDS words and TAILS tails, and K * symbols expected counts a round.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("key").cast("string").cast("binary")) % folds == 0, F.lit(False))
    rows = docs.select(docs[key].cast("bigint").alias("key"), docs[text].cast("string").alias("text")).select("key", (~held).alias("train"), "text")
    blocks = settle(rows.mapInArrow(_blocks, "words binary, tails binary, counts binary, rest binary").withColumn("block", F.monotonically_increasing_id()), "blocks")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                words, tails, counts = _array(b, "words", r, np.int64), _array(b, "tails", r, np.uint16), _array(b, "counts", r, np.int32)
                block = b.column(b.schema.get_field_index("block"))[r].as_py()
                for i in range(0, len(words), 50_000):
                    n = len(words[i : i + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(i, i + n, dtype=np.int32)), pa.array(words[i : i + n]), pa.array(tails[i : i + n].astype(np.int32)), pa.array(counts[i : i + n])], names=["block", "place", "word", "tail", "c"])

    listed = blocks.select("block", "words", "tails", "counts").mapInArrow(entries, "block bigint, place int, word bigint, tail int, c int")
    totals = listed.groupBy("word").agg(F.sum("c").alias("n"), F.first("tail").alias("tail"))
    counts = settle(totals.where("n > 0"), "counts")
    n_docs = rows.where("train").count()
    best = counts.orderBy(F.desc("n"), "word").limit(TOP_WORDS).collect()
    top = {r["word"]: r["n"] for r in best}
    top_words = np.array(sorted(top), np.int64)
    top_counts = np.array([top[w] for w in top_words.tolist()], np.int64)
    by_tail = counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    tail_n, tail_v = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    for r in by_tail:
        tail_n[r["tail"]], tail_v[r["tail"]] = r["n"], r["v"]
    n_words, vocabulary = int(tail_n.sum()), int(tail_v.sum())
    for r in best:
        tail_n[r["tail"]] -= r["n"]
        tail_v[r["tail"]] -= 1
    n_all, v_all = n_words + n_docs, vocabulary + (1 if n_docs else 0)
    unigram = np.zeros(SYMBOLS)
    unigram[: len(top_counts)] = top_counts
    unigram[TOP_WORDS:END] = tail_n
    unigram[END] = n_docs
    unigram = (unigram + SMOOTH) / (unigram + SMOOTH).sum()
    known = spark.sparkContext.broadcast((top_words, tail_n, tail_v))

    # Each block's counts, in the order of its dictionary.
    wanted = listed.select("block", "place", "word").join(counts.select("word", "n"), "word")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tops = spark.createDataFrame([(int(w), i) for i, w in enumerate(top_words)], "word bigint, slot smallint")
    spot = F.col("place").cast("bigint") * 8192 + F.coalesce("slot", F.lit(-1)) + 1
    back = wanted.join(F.broadcast(tops), "word", "left").select("block", F.lit(None).cast("binary").alias("rest"), spot.alias("spot"), "n")
    # One shuffle, in which a block's row comes behind its counts; few blocks a task, as their rows are large, and few columns, as Arrow's cost is by value.
    behind = blocks.select("block", "rest", F.lit(-1).cast("bigint").alias("spot"), F.lit(0).cast("bigint").alias("n"))
    met = back.union(behind).repartition(max(parts, 2 * blocks.count()), "block").sortWithinPartitions("block", F.col("rest").isNotNull()).select("rest", "spot", "n")

    def symbolise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, of_tail, kinds = known.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            spots, sizes, lo = batch.column(1).to_numpy(), batch.column(2).to_numpy(), 0
            for i in np.flatnonzero(spots < 0).tolist():
                at, seen = (np.concatenate(x) for x in zip(*held, (spots[lo:i], sizes[lo:i])))
                held, lo, r = [], i + 1, 0
                b = pa.ipc.open_stream(batch.column(0)[i].as_buffer()).read_next_batch()
                tails, lens = _array(b, "tails", r, np.uint16), _array(b, "lens", r, np.int32).astype(np.int64)
                places = unpack(b.column(b.schema.get_field_index("places"))[r].as_buffer())
                n, slot = np.zeros(len(tails), np.int64), np.full(len(tails), -1, np.int16)
                n[at >> 13], slot[at >> 13] = seen, (at & 8191) - 1
                is_top = slot >= 0
                symbol = np.where(is_top, slot, TOP_WORDS + tails.astype(np.int64)).astype(np.uint16)
                share = np.where(is_top, 0.0, np.log10((n + SMOOTH) / (of_tail[tails] + SMOOTH * (kinds[tails] + 1))))
                rows_ = np.concatenate(([0], np.cumsum(lens)))
                sums = lambda per_word: np.diff(np.concatenate(([0.0], np.cumsum(per_word[places])))[rows_])  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x], pa.binary()) for x in (_array(b, "train", r, np.bool_).tobytes(), lens.astype(np.int32).tobytes(), pack(symbol[places].astype(np.int32)), _exact_sums(np.log10(n + SMOOTH), places, rows_).tobytes(), sums((n > 0).astype(float)).tobytes(), _exact_sums(share, places, rows_).tobytes()))], names=["ids", "train", "lens", "symbols", "base", "n_known", "share"])
            held.append((spots[lo:].copy(), sizes[lo:].copy()))
        ta.release()

    coded = settle(met.mapInArrow(symbolise, "ids array<bigint>, train binary, lens binary, symbols binary, base binary, n_known binary, share binary"), "symbols")
    discard(blocks)
    discard(counts)
    model = _train(coded.select("train", "lens", "symbols"), unigram, rounds)
    sent = spark.sparkContext.broadcast((model.start, model.move, model.emit))
    end_log, low = math.log10((n_docs or 0) + SMOOTH), math.log10(n_all + SMOOTH * (v_all + 1))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for b in batches:
            for r in range(len(b)):
                lens, train = _array(b, "lens", r, np.int32).astype(np.int64), _array(b, "train", r, np.bool_)
                symbols, tokens = _with_ends(_symbols(b, r), lens)
                base = _array(b, "base", r, np.float64) + end_log - tokens * low
                n_known = _array(b, "n_known", r, np.float64).round().astype(np.int64) + (1 if n_docs else 0)
                scores = log_likelihoods(m, symbols, tokens) / math.log(10) + _array(b, "share", r, np.float64)
                yield pa.RecordBatch.from_arrays([b.column(0)[r].values, pa.array(~train), pa.array(tokens), pa.array(n_known), pa.array(np.full(len(lens), n_all)), pa.array(base), pa.array(scores)], names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return coded.mapInArrow(judge, f"`{key}` bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def _exact_sums(per_word: np.ndarray, places: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of each text's words, without the rounding of one long running sum."""
    values = np.append(per_word[places], 0.0)
    out = np.add.reduceat(values, rows[:-1]) if len(rows) > 1 else np.zeros(0)
    out[np.diff(rows) == 0] = 0.0
    return out


def _training(batch: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols, with ends, and lengths of a block's training texts."""
    lens, train = _array(batch, "lens", r, np.int32).astype(np.int64), _array(batch, "train", r, np.bool_)
    symbols, tokens = _with_ends(_symbols(batch, r), lens)
    return symbols[np.repeat(train, tokens)], tokens[train]


def _train(coded: DataFrame, unigram: np.ndarray, rounds: int) -> Model:
    """Rounds of Baum-Welch from the noisy unigram, each on the windows of all training texts."""
    spark = coded.sparkSession
    model = Model.guess(unigram)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((model.start, model.move, model.emit))

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            m, sums = Model(*sent.value), None
            for b in batches:
                for r in range(len(b)):
                    symbols, lens = _training(b, r)
                    got = expected_counts(m, symbols, Windows.of(lens))
                    flat = np.concatenate([x.ravel() for x in got[:3]])
                    sums = flat if sums is None else sums + flat
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["slot", "sums"])
            ta.release()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = None
            for b in batches:
                for x in b.column(0):
                    got = np.frombuffer(x.as_buffer(), np.float64)
                    sums = got if sums is None else sums + got
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

        # One row a task; summed in 16 tasks, then those sums on the driver.
        each = coded.mapInArrow(count, "slot int, sums binary").repartition(16).select("sums").mapInArrow(add, "sums binary").collect()
        if not each:
            break
        flat = np.sum([np.frombuffer(r["sums"], np.float64) for r in each], axis=0)
        start, move, emit = flat[:STATES], flat[STATES : STATES + STATES**2].reshape(STATES, STATES), flat[STATES + STATES**2 :].reshape(STATES, SYMBOLS)
        model = Model.from_counts(start, move, emit, unigram)
        sent.unpersist()
    return model
