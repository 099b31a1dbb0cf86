"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Exact merges without merging.  Two tokens are compatible if encoding their
concatenation gives just these two; a sequence in which all neighbours are
compatible is the encoding.  The encoder follows the longest matches of an
Aho-Corasick automaton, falls back to the next shorter match where a pair isn't
compatible, and steps back a token where none is left; a position that failed
is never tried again, so the time is linear.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = os.environ.get("LECTERN_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's texts are cut before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoded pieces a worker remembers; beyond that it forgets them all and begins again.
REMEMBERED = 400_000


def read_vocabulary(path: str) -> list[bytes]:
    """Bytes of every token by id; ids must be dense, in order of merging."""
    with open(path, "rb") as lines:
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines)]
    pairs.sort()
    if [i for i, _ in pairs] != list(range(len(pairs))):
        raise ValueError("token ids must run from 0 without gaps")
    return [token for _, token in pairs]


class Vocabulary:
    """Automaton, split table, pair table and offset table of one byte-level BPE vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str = PATTERN) -> None:
        self.tokens = tokens
        self.id_of = {t: i for i, t in enumerate(tokens)}
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.sizes: list[int] = self.lengths.tolist()
        self.cut = regex.compile(pattern)
        self.single = [self.id_of[bytes([b])] for b in range(256)]
        self._split()
        self._shorter()
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for i, t in enumerate(tokens):
            automaton.add_word(t.decode("latin-1"), i)
        automaton.make_automaton()
        self.automaton = automaton
        self.known: dict[int, bool] = {}
        self.memory: dict[str, list[int]] = {}
        # Offset table: token i is pool[ends[i] - length[i] : ends[i]].
        self.pool = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.ends = np.cumsum(self.lengths)

    def _split(self) -> None:
        """The two tokens whose merge made each token, and the merge of each such pair."""
        n = len(self.tokens)
        self.left, self.right, self.merged = list(range(n)), list(range(n)), {}
        get = self.id_of.get
        for i, t in enumerate(self.tokens):
            for k in range(1, len(t)):
                a, b = get(t[:k]), get(t[k:])
                # Parts precede their merge, and no other merge may reach across the split earlier.
                if a is not None and b is not None and a < i and b < i and (a, b) not in self.merged and self.compatible(a, b, i):
                    self.left[i], self.right[i] = a, b
                    self.merged[(a, b)] = i
                    break

    def _shorter(self) -> None:
        """For every token the longest token that is a proper prefix of it; -1 if none."""
        get = self.id_of.get
        self.shorter = [next((s for k in range(len(t) - 1, 0, -1) if (s := get(t[:k])) is not None), -1) for t in self.tokens]

    def compatible(self, a: int, b: int, before: int = 1 << 60) -> bool:
        """Whether no merge ranked under ``before`` would join material across the border of a and b.

        Undo merges of the two tokens from the latest to the earliest and look
        at the pair that faces each other across the border at every moment.
        """
        limit, merged, left, right = before, self.merged, self.left, self.right
        while True:
            m = merged.get((a, b))
            if m is not None and m < limit:
                return False
            if a > b and right[a] != a or left[b] == b:
                if right[a] == a:
                    return True
                limit, a = a, right[a]
            else:
                # Of equal ranks the merge further left comes first: one later is still allowed here.
                limit, b = b + 1, left[b]

    def _fits(self, a: int, b: int) -> bool:
        key = a << 20 | b
        hit = self.known.get(key)
        if hit is None:
            if len(self.known) > 2_000_000:
                self.known.clear()
            hit = self.known[key] = self.compatible(a, b)
        return hit

    def backtrack(self, text: str) -> list[int]:
        """Ids of one piece, given as its bytes in Latin-1."""
        n = len(text)
        longest = self._longest(text)
        failed = bytearray(n + 1)
        out: list[int] = []
        at, token, sizes, shorter = 0, longest[0], self.sizes, self.shorter
        while True:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + sizes[token]
                if not failed[end] and (last < 0 or self._fits(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            else:
                failed[at] = 1
                token = out.pop()
                at -= sizes[token]
                token = shorter[token]

    def _longest(self, text: str) -> list[int]:
        """The longest token that begins at each position."""
        found = [self.single[ord(c)] for c in text]
        sizes = self.sizes
        best = [1] * len(text)
        for end, token in self.automaton.iter(text):
            start = end - sizes[token] + 1
            if sizes[token] > best[start]:
                best[start], found[start] = sizes[token], token
        return found

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that aren't remembered yet, all at once.

        Greedy longest matches of all pieces come from one scan; where all
        neighbours are compatible they are the encoding, else the piece goes
        through ``backtrack``.
        """
        raw = [p.encode("utf-8").decode("latin-1") for p in pieces]
        greedy = [[t for _, t in self.automaton.iter_long(r)] for r in raw]
        flat = np.fromiter(chain.from_iterable(greedy), dtype=np.int64)
        counts = np.fromiter(map(len, greedy), dtype=np.int64, count=len(greedy))
        begin = np.concatenate([[0], np.cumsum(counts)])
        broken = np.zeros(len(pieces), dtype=bool)
        if len(flat) > 1:
            keys = flat[:-1] << 20 | flat[1:]
            inner = np.ones(len(keys), dtype=bool)
            inner[begin[1:-1] - 1] = False
            where = np.nonzero(inner)[0]
            unique, inverse = np.unique(keys[where], return_inverse=True)
            fits = np.fromiter((self._fits(k >> 20, k & 0xFFFFF) for k in unique.tolist()), dtype=bool, count=len(unique))
            wrong = where[~fits[inverse]]
            broken[np.searchsorted(begin, wrong, side="right") - 1] = True
        memory = self.memory
        for i, (p, g) in enumerate(zip(pieces, greedy)):
            memory[p] = self.backtrack(raw[i]) if broken[i] else g

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text); null and empty texts have none."""
        cut, memory = self.cut.findall, self.memory
        parts = [cut(t) if t else () for t in texts]
        missing = set(chain.from_iterable(parts)) - memory.keys()
        if len(memory) + len(missing) > REMEMBERED:
            memory.clear()
            missing = set(chain.from_iterable(parts))
        if missing:
            self.learn(list(missing))
        look = memory.__getitem__
        rows = [list(chain.from_iterable(map(look, p))) for p in parts]
        counts = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        return np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=int(counts.sum())), np.concatenate([[0], np.cumsum(counts)])

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids, by gathers from the offset table."""
        ids = np.asarray(ids, dtype=np.int64)
        if not len(ids):
            return b""
        length = self.lengths[ids]
        ends = np.cumsum(length)
        owner = np.repeat(np.arange(len(ids)), length)
        return self.pool[(self.ends[ids] - length)[owner] + np.arange(ends[-1]) - (ends - length)[owner]].tobytes()


_LOADED: dict[tuple[str, str], Vocabulary] = {}


def _vocabulary(key: tuple[str, str], tokens: list[bytes]) -> Vocabulary:
    """One vocabulary per worker process and file."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(tokens, key[1])
    return _LOADED[key]


def with_ids(df: DataFrame, text: str, out: str = "ids", path: str | None = None, pattern: str = PATTERN, count_only: bool = False) -> DataFrame:
    """Add ``out``: the token ids of ``text`` (array<int>), or with ``count_only`` their number (int).

    Null and empty texts have the empty list (number 0); special tokens are
    ordinary text.  No shuffle: one pass over the scan.  The vocabulary is read
    once on the driver from ``path`` and broadcast (its size is that of the
    file, under 2 MB, whatever the corpus).
    """
    path = path or os.path.join(TOKENIZERS, VOCABULARY)
    tokens = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    others = [c for c in df.columns if c != out]
    at = others.index(text)
    schema = df.select(*others).schema.add(out, T.IntegerType() if count_only else T.ArrayType(T.IntegerType(), False), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary((path, pattern), tokens.value)
        for batch in batches:
            for part in _slices(batch, at):
                ids, offsets = vocabulary.encode_batch(part.column(at).to_pylist())
                if count_only:
                    column = pa.array(np.diff(offsets).astype(np.int32))
                else:
                    column = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*others, out])

    return df.select(*others).mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, at: int, characters: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded amount of text, so that long texts don't pile up."""
    sizes = np.array([x or 0 for x in pc.binary_length(batch.column(at)).to_pylist()], dtype=np.int64)
    block = np.cumsum(sizes) // characters
    cuts = [0, *(np.nonzero(np.diff(block))[0] + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def with_text(df: DataFrame, ids: str, out: str = "decoded", path: str | None = None) -> DataFrame:
    """Add ``out``: the text of a list of ids; bytes that are no UTF-8 become U+FFFD, null stays null."""
    path = path or os.path.join(TOKENIZERS, VOCABULARY)
    tokens = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    others = [c for c in df.columns if c != out]
    at = others.index(ids)
    schema = df.select(*others).schema.add(out, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary((path, PATTERN), tokens.value)
        for batch in batches:
            texts = [None if x is None else vocabulary.decode(x).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*others, out])

    return df.select(*others).mapInArrow(run, schema)


def count_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, n_tokens) of every document."""
    return with_ids(documents.select(F.col("doc_id"), F.col("text")), "text", "n_tokens", count_only=True).select("doc_id", "n_tokens")
