"""Byte-pair encoding and decoding as bounded-lookahead streaming transducers.

Encoding rests on two facts of a merge list.

* A token sequence is the encoding of its bytes exactly when each two adjacent
  tokens are stable beside each other: no merge across their border comes
  before the merges that made them.  So the encoding of every prefix of a
  stream ends in one token that is stable after the encoding of what stands
  before it, and one step for each byte finds it among the tokens that end there.
* A later byte changes an earlier token only through a chain of overlapping
  merges of ever higher priority.  The bytes that the longest such chain in the
  list spans are the lookahead that is sufficient.  A token is emitted once
  all prefixes that a later byte can build on share it, which is so within that
  lookahead; memory doesn't depend on the stream's length.

Decoding feeds the tokens' bytes to an incremental UTF-8 machine that holds an
unfinished character, three bytes at most, and gives U+FFFD for what can't be one.

Defined results: a null or empty text has no tokens and decodes to the empty
text; strings of added tokens in a text become their ids; repeated rows are each
encoded; other columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import textarrays as ta

#: Splits a text before the merges, as byte-level tokenizers do.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of the characters of PLAIN, where re's classes are those of Unicode; it is faster.
SPLIT_PLAIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
PLAIN = "[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]*"
#: Pre-tokens that each worker keeps: seen twice, seen once; and their longest length in characters.
CACHE_ENTRIES, CACHE_ONCE, CACHE_CHARS = 400_000, 250_000, 48
#: Pairs of tokens of which each worker remembers whether they stay apart; the results don't depend on it.
STABLE_ENTRIES = 1 << 16
#: Characters of a text that are split at once.
SEGMENT_CHARS = 1 << 18

_NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {chr(b if b in plain else next(spare)): b for b in range(256)}


class MergeList:
    """Tokens and merges of a tokenizer file, with what the transducers need."""

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        model = spec["model"]
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.id_of = {raw(s): i for s, i in model["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        order: list[bytes] = []
        for r, m in enumerate(model["merges"]):
            left, right = (raw(x) for x in (m if isinstance(m, list) else m.split(" ")))
            a, b, whole = self.id_of[left], self.id_of[right], self.id_of[left + right]
            self.rank.setdefault((a, b), r)
            self.made.setdefault(whole, (a, b, r))
            order.append(left + right)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for text, i in self.added.items():
            self.bytes_of[i] = text.encode()
        self.longest = max(map(len, self.id_of))
        self.lookahead = longest_chain(order)
        # Tokens read from their ends: node 0 is the root, its children have the byte as key.
        self.back: dict[int, int] = {}
        self.ends = [-1]
        for token, i in self.id_of.items():
            node = 0
            for c in reversed(token):
                nxt = self.back.get(node << 8 | c)
                if nxt is None:
                    nxt = self.back[node << 8 | c] = len(self.ends)
                    self.ends.append(-1)
                node = nxt
            self.ends[node] = i
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self.known_stable: dict[int, bool] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stood at one edge while this one was made, each with the rank that ended it."""
        memo = self._left if side == 0 else self._right
        if (found := memo.get(token)) is None:
            found, end, t = [], _NEVER, token
            while True:
                found.append((t, end))
                if t not in self.made:
                    break
                end, t = self.made[t][2], self.made[t][side]
            memo[token] = found
        return found

    def stable(self, a: int, b: int) -> bool:
        """Whether a and b stay apart.  Of two places for one rule the left one comes first."""
        key = a << 20 | b
        if (known := self.known_stable.get(key)) is None:
            rank, known = self.rank, True
            for y, until_y in self.edge(b, 0):
                for x, until_x in self.edge(a, 1):
                    r = rank.get((x, y))
                    if r is not None and r < until_x and r <= until_y:
                        known = False
                        break
                if not known:
                    break
            if len(self.known_stable) >= STABLE_ENTRIES:
                self.known_stable.clear()
            self.known_stable[key] = known
        return known


def longest_chain(merged: list[bytes]) -> int:
    """Bytes that the longest chain of merges spans, each of higher priority than the one before and beginning inside it."""
    spans: dict[bytes, int] = {}
    best = 1
    for w in merged:
        n = max(len(w), max((k + spans.get(w[k:], 0) for k in range(1, len(w))), default=0))
        best = max(best, n)
        for k in range(1, len(w)):
            p = w[:k]
            if spans.get(p, 0) < n:
                spans[p] = n
    return best


class Encoder:
    """Bytes in, stable token ids out."""

    def __init__(self, merges: MergeList):
        self.m = merges
        self.held = b""
        self.last: list[tuple[int, int]] = []

    def feed(self, more: bytes) -> list[int]:
        self.held += more
        self._scan()
        return self._settled() if len(self.held) > 2 * self.m.lookahead else []

    def finish(self) -> list[int]:
        last, out, i = self.last, [], len(self.last)
        while i:
            t, n = last[i - 1]
            out.append(t)
            i -= n
        self.held, self.last = b"", []
        return out[::-1]

    def _scan(self) -> None:
        """last[i]: the token that ends the encoding of the i + 1 first bytes, and its length."""
        held, last, step, ends, known = self.held, self.last, self.m.back.get, self.m.ends, self.m.known_stable
        heads = [t for t, _ in last]
        for i in range(len(last), len(held)):
            s, node = i, step(held[i], 0)
            while node:
                t = ends[node]
                if t >= 0:
                    if not s:
                        break
                    key = heads[s - 1] << 20 | t
                    ok = known.get(key)
                    if ok is None:
                        ok = self.m.stable(heads[s - 1], t)
                    if ok:
                        break
                s -= 1
                node = step(node << 8 | held[s], 0) if s >= 0 else 0
            if not node:
                raise ValueError("a byte has no token")
            heads.append(t)
            last.append((t, i + 1 - s))

    def _settled(self) -> list[int]:
        """Emit what all prefixes share that a later byte can build on."""
        last = self.last
        heads = {len(last) - k for k in range(min(self.m.longest, len(last)))}
        while len(heads) > 1:
            top = max(heads)
            heads.discard(top)
            heads.add(top - last[top - 1][1])
        at = cut = heads.pop()
        out = []
        while at:
            t, n = last[at - 1]
            out.append(t)
            at -= n
        if cut:
            # What stays begins with the last shared token, against which the next ones are checked.
            keep = cut - last[cut - 1][1]
            self.held, self.last = self.held[keep:], last[keep:]
            first, n = self.last[cut - keep - 1]
            self.last = [(first, i + 1) if i + 1 == n else x for i, x in enumerate(self.last)]
            out = out[1:]
        return out[::-1]


class Decoder:
    """Token ids in, text out as soon as its characters are whole."""

    def __init__(self, text_of: list[bytes]):
        self.text_of = text_of
        self.machine = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.text_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


class _Cache(dict):
    """Ids, as little-endian 32-bit integers, of the pre-tokens that came twice or more; those that came once wait aside."""

    def __init__(self, merges: MergeList):
        self.encoder, self.once = Encoder(merges), {}

    def __missing__(self, word: str) -> bytes:
        found = self.once.get(word)
        if found is not None:
            if len(self) < CACHE_ENTRIES:
                self[word] = found
                del self.once[word]
            return found
        raw, e, ids = word.encode("utf-8", "surrogatepass"), self.encoder, []
        for k in range(0, len(raw), 4096):
            ids += e.feed(raw[k : k + 4096])
        ids += e.finish()
        found = array("I", ids).tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self.once) >= CACHE_ONCE:
                self.once.clear()
            self.once[word] = found
        return found


class Tokenizer:
    def __init__(self, blob: bytes, split: str = SPLIT):
        self.merges = MergeList(blob)
        self.words = regex.compile(split)
        self.plain_words = re.compile(SPLIT_PLAIN) if split == SPLIT else None
        self.plain = re.compile(PLAIN).fullmatch
        self.text_of = [self.merges.bytes_of.get(i, b"") for i in range(max(self.merges.bytes_of) + 1)]
        self.added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.merges.added, key=len, reverse=True))) + ")") if self.merges.added else None
        self.cache = _Cache(self.merges)

    def segments(self, text: str) -> Iterator[str]:
        """Parts of a text that can be split alone: each begins at a space after something else."""
        i = 0
        while len(text) - i > SEGMENT_CHARS:
            j = i + SEGMENT_CHARS
            while j < len(text) and not (text[j] == " " and not text[j - 1].isspace()):
                j += 1
            yield text[i:j]
            i = j
        yield text[i:] if i else text

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of a text as little-endian 32-bit integers, part by part."""
        parts = self.added.split(text) if self.added else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield self.merges.added[part].to_bytes(4, "little")
            elif part:
                words = (self.plain_words if self.plain_words and self.plain(part) else self.words).findall
                for s in self.segments(part):
                    yield b"".join(map(self.cache.__getitem__, words(s)))

    def encode_ids(self, text: str) -> list[int]:
        return memoryview(b"".join(self.encode(text))).cast("I").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        d = Decoder(self.text_of)
        return d.feed(ids) + d.finish()


def tokenizer(blob: bytes) -> Tokenizer:
    """One for each worker and file, with its cache, until a task of another operator comes."""
    key = hashlib.sha256(blob).digest()
    if key not in ta.kept:
        ta.kept.clear()
        ta.kept[key] = Tokenizer(blob)
    return ta.kept[key]


def digests(tok: Tokenizer, text: str, parts: list[bytes] | None = None, decoded: list[str] | None = None) -> tuple[int, str, str]:
    """Number of tokens, sha256 of the ids, and of the text decoded from them; parts and decoded take these as they come."""
    n, of_ids, of_text, out = 0, hashlib.sha256(), hashlib.sha256(), Decoder(tok.text_of)

    def said(more: str) -> None:
        of_text.update(more.encode())
        if decoded is not None:
            decoded.append(more)

    for part in tok.encode(text):
        n += len(part) // 4
        of_ids.update(part)
        if parts is not None:
            parts.append(part)
        said(out.feed(memoryview(part).cast("I").tolist()))
    said(out.finish())
    return n, of_ids.hexdigest(), of_text.hexdigest()


def vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", ids: bool = False, decode: bool = True) -> DataFrame:
    """Encode every text and decode its ids again.

    Returns ``key``, n_tokens, ids_sha256 and decoded_sha256, and with ``ids``
    also token_ids (array of int) and decoded (null without ``decode``).  ``path`` is a tokenizer file that
    the driver reads; its content goes to the executors.
    """
    blob = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    rows = docs.select(docs[key].alias(key), docs[text].cast("string").alias("__text"))
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>, decoded string" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(blob.value)
        names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *(["token_ids", "decoded"] if ids else [])]
        for whole in batches:
            _, off = ta.buffers(whole.column(1))
            for i, j in ta.pieces(off):
                b = whole.slice(i, j - i)
                texts = [t or "" for t in b.column(1).to_pylist()]
                flat, plain = ([[] for _ in texts] if on else [None] * len(texts) for on in (ids, ids and decode))
                n, a, d = zip(*(digests(tok, *x) for x in zip(texts, flat, plain)))
                cols = [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
                if ids:
                    ends = np.concatenate(([0], np.cumsum(n)))
                    whole_ids = np.frombuffer(b"".join(x for parts in flat for x in parts), np.int32)
                    cols += [ta.list_array(whole_ids, ends), pa.array([None if x is None else "".join(x) for x in plain], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=names)
            ta.release()

    return rows.mapInArrow(run, schema)
