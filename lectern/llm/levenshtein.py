"""All words of a vocabulary within an edit distance: Levenshtein automata intersected with a trie.

The automaton is the universal one: its state is the band of the dynamic
program around the diagonal, which takes only a few different values, so the
transitions are a small table.  Intersection walks the trie level by level, for
many query words at once, dropping every branch whose state is dead; nothing
within the distance is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=4)
def automaton(distance: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(next state by state and match bits, band by state, dead state)."""
    width, dead = 2 * distance + 1, distance + 1
    start = tuple(min(dead, max(0, t - distance)) if t >= distance else dead for t in range(width))
    index, order, rows = {start: 0}, [start], []
    for band in order:
        row = []
        for bits in range(1 << width):
            new: list[int] = []
            for t in range(width):
                best = band[t] + (0 if bits >> t & 1 else 1)
                if t + 1 < width:
                    best = min(best, band[t + 1] + 1)
                if t:
                    best = min(best, new[t - 1] + 1)
                new.append(min(dead, best))
            key = tuple(new)
            if key not in index:
                index[key] = len(order)
                order.append(key)
            row.append(index[key])
        rows.append(row)
    return np.array(rows, dtype=np.int32), np.array(order, dtype=np.int8), index[(dead,) * width]


class Trie:
    """A trie of words as arrays: children of node i are ``first[i]`` to ``first[i] + count[i]``."""

    def __init__(self, words: list[str]) -> None:
        self.words = sorted(set(words))
        level: list[tuple[int, int]] = [(0, len(self.words))]
        letters, first, count, final = [0], [], [], []
        depth, done = 0, 1
        while level:
            following: list[tuple[int, int]] = []
            for low, high in level:
                end = -1
                if low < high and len(self.words[low]) == depth:
                    end, low = low, low + 1
                final.append(end)
                first.append(done)
                n = 0
                while low < high:
                    letter = self.words[low][depth]
                    top = low
                    while top < high and self.words[top][depth] == letter:
                        top += 1
                    letters.append(ord(letter))
                    following.append((low, top))
                    n += 1
                    low = top
                count.append(n)
                done += n
            level, depth = following, depth + 1
        self.letters = np.array(letters, dtype=np.int32)
        self.first, self.count = np.array(first, dtype=np.int64), np.array(count, dtype=np.int64)
        self.final = np.array(final, dtype=np.int64)

    def within(self, queries: list[str], distance: int = 2, block: int = 2_000) -> Iterator[tuple[int, int]]:
        """(number of the query, number of the word) of every word at most ``distance`` away."""
        for i in range(0, len(queries), block):
            yield from self._within(queries[i : i + block], distance, i)

    def _within(self, queries: list[str], distance: int, base: int) -> Iterator[tuple[int, int]]:
        table, bands, dead = automaton(distance)
        longest = max(map(len, queries), default=0)
        pad = distance + 1
        # Positions outside a word never match.
        text = np.full((len(queries), longest + 2 * pad + 2 * distance + 2), -1, dtype=np.int32)
        for i, q in enumerate(queries):
            text[i, pad : pad + len(q)] = np.frombuffer(q.encode("utf-32-le"), dtype=np.uint32)
        length = np.array([len(q) for q in queries], dtype=np.int64)
        query, node, state = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64), np.zeros(len(queries), dtype=np.int64)
        depth = 0
        while len(query):
            # Words that end here: the distance stands where the query ends in the band.
            ends = self.final[node]
            t = length[query] - depth + distance
            hit = (ends >= 0) & (t >= 0) & (t <= 2 * distance)
            where = np.nonzero(hit)[0]
            where = where[bands[state[where], t[where]] <= distance]
            yield from zip((query[where] + base).tolist(), ends[where].tolist())
            n = self.count[node]
            total = int(n.sum())
            if not total:
                return
            parent = np.repeat(np.arange(len(node)), n)
            child = self.first[node][parent] + np.arange(total) - (np.cumsum(n) - n)[parent]
            letter, owner = self.letters[child], query[parent]
            bits = np.zeros(total, dtype=np.int64)
            begin = depth - distance + pad
            for j in range(2 * distance + 1):
                at = begin + j
                if 0 <= at < text.shape[1]:
                    bits |= (text[owner, at] == letter).astype(np.int64) << j
            after = table[state[parent], bits]
            alive = after != dead
            # A branch already longer than the query allows is dead too.
            alive &= depth + 1 <= length[owner] + distance
            query, node, state = owner[alive], child[alive], after[alive].astype(np.int64)
            depth += 1
