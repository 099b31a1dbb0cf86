"""Splitting oversized items at natural boundaries.

Every position of a text has a boundary strength.  A sparse table over the
strengths answers "strongest cut in this window" in constant time; ties go to
the right, so pieces are as long as an equally good cut allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2_000, 200
#: The shortest piece as a share of the limit, and the shortest overlap as a share of the overlap.
LEAST_PIECE, LEAST_OVERLAP = 0.5, 0.6

# Strength of a cut after these characters.
_STRENGTH = (
    ("。！？…", 50),  # ends of CJK sentences
    (";:；：", 30),
    (",，、", 20),
)
_CLOSERS = "\"'”’)」』）]»"


def strengths(text: str) -> np.ndarray:
    """``s[i]``: how natural it is to cut before code point i, i from 0 to n."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(a)
    s = np.zeros(n + 1, dtype=np.int16)
    if n == 0:
        return s
    space = np.isin(a, np.array([9, 11, 12, 32, 0xA0, 0x1680, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B)], dtype=np.uint32))
    line = np.isin(a, np.array([10, 13, 0x85, 0x2028, 0x2029], dtype=np.uint32))
    after = s[1:]
    for chars, value in _STRENGTH:
        after[np.isin(a, np.array([ord(c) for c in chars], dtype=np.uint32))] = value
    closer = np.isin(a, np.array([ord(c) for c in _CLOSERS], dtype=np.uint32))
    stop = np.isin(a, np.array([ord(c) for c in ".!?"], dtype=np.uint32))
    ended = stop.copy()
    ended[1:] |= closer[1:] & stop[:-1]
    # White space passes on what comes before it: the cut falls after the space.
    after[space] = 10
    if n > 1:
        at = np.nonzero(space[1:] & ended[:-1])[0] + 1
        after[at] = 40
        for chars, value in _STRENGTH[1:]:
            before = np.isin(a[:-1], np.array([ord(c) for c in chars], dtype=np.uint32))
            at = np.nonzero(space[1:] & before)[0] + 1
            after[at] = value
            after[np.nonzero(before)[0]] = np.where(space[1:][before], 5, np.where(a[:-1][before] < 128, 0, value))
        cjk_close = np.nonzero(closer[1:] & (after[:-1] == 50))[0] + 1
        after[cjk_close] = 50
        after[cjk_close - 1] = 5
    after[line] = 60
    if n > 1:
        pair = np.nonzero(line[1:] & line[:-1] & ~((a[:-1] == 13) & (a[1:] == 10)))[0] + 1
        after[pair] = 70
        if n > 2:
            crlf = np.nonzero((a[2:] == 10) & (a[1:-1] == 13) & (a[:-2] == 10))[0] + 2
            after[crlf] = 70
        # Never between CR and LF, nor before a mark that belongs to the character ahead of it.
        after[np.nonzero((a[:-1] == 13) & (a[1:] == 10))[0]] = -2
        mark = ((a[1:] >= 0x300) & (a[1:] <= 0x36F)) | ((a[1:] >= 0xFE00) & (a[1:] <= 0xFE0F)) | (a[1:] == 0x200D)
        after[np.nonzero(mark)[0]] = -2
    s[0] = s[n] = 80
    return s


class StrongestCut:
    """Sparse table: position of the rightmost maximum in a window, in constant time.

    The windows asked for have at most ``widest`` positions, so only the levels
    below its logarithm are built.
    """

    def __init__(self, values: np.ndarray, widest: int) -> None:
        n = len(values)
        # Strength above, position below: the maximum breaks ties rightward by itself.
        level = (values.astype(np.int64) << 40) + np.arange(n, dtype=np.int64)
        self.levels = [level]
        width = 1
        while width * 2 <= min(widest, n):
            level = np.maximum(level[: n - 2 * width + 1], level[width : n - width + 1])
            self.levels.append(level)
            width *= 2

    def at(self, low: int, high: int) -> int:
        """Rightmost strongest position in [low, high]."""
        k = (high - low + 1).bit_length() - 1
        level = self.levels[k]
        return int(max(level[low], level[high - (1 << k) + 1]) & ((1 << 40) - 1))


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``text`` in code points; one piece if it fits."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    shortest, keep = max(overlap + 1, int(limit * LEAST_PIECE)), int(overlap * LEAST_OVERLAP)
    values = strengths(text)
    cuts = StrongestCut(values, limit - shortest + 1)
    # For the start of the next piece ties go to the left: the longest overlap.
    starts = StrongestCut(values[::-1], max(1, overlap - keep + 1))
    found, start = [], 0
    while n - start > limit:
        end = cuts.at(start + shortest, start + limit)
        found.append((start, end))
        start = n - starts.at(n - (end - keep), n - (end - overlap)) if overlap else end
    found.append((start, n))
    return found


def split_oversized(blocks: DataFrame, sections: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece_no, heading_path, char_start, char_end, text) of blocks longer than ``limit``.

    ``char_start`` and ``char_end`` are offsets in the block's own text.  Null,
    empty and short texts give no rows (they need no cut); a block without a
    section, or with an unknown one, has a null ``heading_path``; repeated rows
    count once.  The heavy side is cut first and only then joined.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and less than half the limit")
    long = blocks.select("id", "section_id", "text").where(F.length("text") > limit).distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sids, texts = (batch.column(i).to_pylist() for i in range(3))
            rows: list[tuple] = [
                (i, s, k, a, b, t[a:b]) for i, s, t in zip(ids, sids, texts) for k, (a, b) in enumerate(pieces(t, limit, overlap))
            ]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["id", "section_id", "piece_no", "char_start", "char_end", "text"])

    cuts = long.mapInArrow(cut, "id string, section_id string, piece_no int, char_start int, char_end int, text string")
    paths = sections.select(F.col("id").alias("section_id"), "heading_path").distinct()
    return cuts.join(paths, "section_id", "left").select("id", "piece_no", "heading_path", "char_start", "char_end", "text")
