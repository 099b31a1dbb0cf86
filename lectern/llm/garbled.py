"""Garbled text from a wrong character encoding: find it and restore it.

Three steps.  All adjacent character pairs of the corpus are counted into a
hash table of fixed size; a pair scores by its mutual information, shrunk
towards improbable where it is rare.  In every text the maximum-scoring
segments of improbability are isolated.  Only inside these are inverse mappings
tried: encode with the encoding that was wrongly used, decode with the one
that was meant, and keep what makes the pairs probable.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.same_look import LIMIT, code_points
from lectern.session import bounded

#: Buckets of the pair table: the bound of what is collected and broadcast, with the code points.
BUCKETS = 1 << 21
#: Share of all pairs below which a pair counts as rare: beside Latin letters and signs, within
#: other alphabets (which few of the texts may use), and among the many CJK characters.
RARE_LATIN, RARE_LETTERS, RARE_CJK = 2e-4, 1.2e-5, 1.2e-5
#: Share of all characters from which a character belongs to the corpus.
SEEN = 1e-6
#: A segment of at least this improbability is looked into.
LEAST = 3.0
#: What a repair must gain in score per pair, and on the whole.
GAIN_EACH, GAIN = 1.0, 6.0
#: Improbability of a run that counts as garbled though nothing undoes it.
HOPELESS = 12.0
#: Characters of a run that are tried at a time, from its start to its end, until a mapping explains them; it is then
#: undone in the whole text.
VOTING = 96
#: Length up to which the readings of a run are remembered, and how many a worker remembers.
SHORT, REMEMBERED = 12, 10_000
_BAD = "�"

# Single-byte and multi-byte encodings that text is mistaken for, and those it was written in.
READ_AS = ("cp1252", "cp1251", "koi8_r", "mac_roman", "cp437", "cp850", "cp866", "cp1250", "iso8859_15", "gb18030", "cp950", "big5hkscs", "cp932", "euc_jp", "euc_kr")
WRITTEN_IN = ("utf-8", "gb18030", "cp950", "big5hkscs", "cp932", "euc_jp", "euc_kr", "cp1251", "koi8_r", "cp866", "cp1252", "mac_roman", "cp437", "cp850")
# A no-break space among the bytes may have become a plain one since.
_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef](?:[\x80-\xbf]{2}|[\x80-\xbf] | [\x80-\xbf])|[\xf0-\xf4][\x80-\xbf]{3}|\xc3 ")
_LATIN = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_15")
_CYRILLIC = ("cp1251", "koi8_r", "cp866")
_BESIDE_LATIN = re.compile("[A-Za-z][^\x00-\x7f]|[^\x00-\x7f][A-Za-z]")
_U64 = (1 << 64) - 1
_CONTROLS = frozenset(map(chr, range(0x80, 0xA0))) - {"\x85"}
_WIDE = ("gb18030", "cp950", "big5hkscs", "cp932", "euc_jp", "euc_kr")


@lru_cache(maxsize=None)
def _letters(name: str) -> frozenset[str]:
    return frozenset(map(chr, range(128))) | frozenset(map(chr, _byte_table(name)))


@lru_cache(maxsize=None)
def _byte_table(name: str) -> dict[int, int]:
    """Code point to byte of a single-byte encoding; bytes it leaves undefined stand for themselves."""
    table = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        table[ord(c)] = b
    for b in range(128, 160):
        table.setdefault(b, b)
    return table


def _as_bytes(text: str, letters: set[str], name: str) -> bytes | None:
    """The bytes that were read as ``text``, of the characters ``letters``; None where it can't have been read so."""
    if name in _WIDE:
        try:
            return text.encode(name)
        except UnicodeEncodeError:
            return None
    return text.translate(_byte_table(name)).encode("latin-1") if letters <= _letters(name) else None


def _hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - 21)).astype(np.int64)


@lru_cache(maxsize=1)
def _same() -> np.ndarray:
    """Every code point as it is counted: digits and white space as one character each."""
    out = np.arange(LIMIT, dtype=np.uint32)
    out[48:58] = 48
    out[[9, 10, 13, 0xA0, 0x3000]] = 32
    return out


def _plain(points: np.ndarray) -> np.ndarray:
    return _same()[np.minimum(points, LIMIT - 1)]


def weighed(documents: DataFrame, text: str) -> DataFrame:
    """``text`` with ``weight``: one over the number of rows that hold the same text, so that each text counts once.

    Only hashes are counted; texts that repeat are looked up by them.
    """
    two = [F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(17), text).alias("_h2")]
    hashed = documents.where(F.length(text) > 0).select(text, *two)
    repeated = bounded(hashed.groupBy("_h1", "_h2").agg(F.count("*").alias("_n")).where("_n > 1"))
    return hashed.join(repeated, ["_h1", "_h2"], "left").select(text, (1.0 / F.coalesce("_n", F.lit(1))).alias("weight"))


def count_pairs(documents: DataFrame, text: str) -> DataFrame:
    """(slot, n, once): slots below BUCKETS are pairs, those from there on single characters; over all rows, and each distinct text once."""

    def add(total: np.ndarray, points: np.ndarray, inner: np.ndarray, weight: np.ndarray | None) -> None:
        total[BUCKETS:] += np.bincount(points, weight, minlength=LIMIT)
        total[:BUCKETS] += np.bincount(_hash(points[:-1], points[1:])[inner], None if weight is None else weight[:-1][inner], minlength=BUCKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, extra = np.zeros(BUCKETS + LIMIT, dtype=np.float64), np.zeros(BUCKETS + LIMIT, dtype=np.float64)
        for batch in batches:
            points, offsets = code_points(batch.column(0))
            if not len(points):
                continue
            points = _plain(points)
            inner = np.ones(len(points) - 1, dtype=bool)
            cuts = offsets[(offsets > 0) & (offsets < len(points))]
            inner[cuts - 1] = False
            add(total, points, inner, None)
            weight = np.asarray(batch.column(1))
            if (weight < 1).any():
                add(extra, points, inner, np.repeat(1 - weight, np.diff(offsets)))
        slots = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(total[slots]), pa.array((total - extra)[slots])], ["slot", "n", "once"])

    counted = weighed(documents, text).mapInArrow(run, "slot int, n double, once double")
    return counted.groupBy("slot").agg(F.sum("n").alias("n"), F.sum("once").alias("once"))


def doubtful(scores: np.ndarray, offsets: np.ndarray) -> set[int]:
    """Rows of a batch with a stretch whose improbability reaches LEAST; ``scores`` are those of all adjacent pairs of the batch."""
    low = np.nonzero(scores < -0.5)[0]
    found = set()
    for i in np.unique(np.searchsorted(offsets, low, side="right") - 1).tolist():
        badness = -0.5 - scores[offsets[i] : offsets[i + 1] - 1].astype(np.float64)
        if len(badness):
            sums = np.cumsum(badness)
            if (sums - np.minimum.accumulate(np.minimum(sums - badness, sums))).max() >= LEAST:
                found.add(i)
    return found


class PairModel:
    """Shrunk mutual information of adjacent characters.

    A pair is as probable as its share of all rows or its share of the distinct
    texts, whichever is less: a text can't become normal by being copied, nor
    by standing among few texts that are.
    """

    def __init__(self, slots: np.ndarray, counts: np.ndarray, once: np.ndarray) -> None:
        pair = slots < BUCKETS
        self.table, self.single = np.zeros(BUCKETS, dtype=np.float32), np.zeros(LIMIT, dtype=np.float32)
        shares = [n / max(1.0, n[pair].sum()) for n in (counts, once)]
        self.table[slots[pair]] = np.minimum(*shares)[pair]
        self.single[slots[~pair] - BUCKETS] = shares[0][~pair]

    def scores(self, points: np.ndarray) -> np.ndarray:
        """Score of every adjacent pair; a pair of ASCII characters has a fixed, slightly probable one."""
        points = _plain(points)
        out = np.full(max(0, len(points) - 1), 0.7, dtype=np.float32)
        wide = points >= 128
        at = np.nonzero(wide[:-1] | wide[1:])[0]
        a, b = points[at], points[at + 1]
        joint = self.table[_hash(a, b)]
        expected = self.single[a] * self.single[b]
        rare = np.full(len(a), RARE_LATIN, dtype=np.float32)
        other_a, other_b = (a >= 0x370) & (a < 0x2000), (b >= 0x370) & (b < 0x2000)
        rare[(other_a & (other_b | (b < 128))) | (other_b & (a < 128))] = RARE_LETTERS
        rare[(a >= 0x2E80) | (b >= 0x2E80)] = RARE_CJK
        s = np.log((joint + 0.02 * rare) / (np.minimum(expected, joint) + rare))
        s = np.clip(s, -4.0, 3.0)
        odd = ((a >= 0x80) & (a < 0xA0)) | ((b >= 0x80) & (b < 0xA0)) | (a == 0xFFFD) | (b == 0xFFFD) | ((b >= 0xE000) & (b < 0xF900))
        s[odd] = -4.0
        out[at] = s
        return out

    def score(self, a: int, b: int) -> float:
        """``scores`` for one pair that isn't plain ASCII."""
        if 0x80 <= a < 0xA0 or 0x80 <= b < 0xA0 or a == 0xFFFD or b == 0xFFFD or 0xE000 <= b < 0xF900:
            return -4.0
        a, b = (48 if 48 <= x <= 57 else 32 if x in (9, 10, 13, 0xA0, 0x3000) else x for x in (a, b))
        if a < 128 and b < 128:
            return 0.7
        x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & _U64
        x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & _U64
        joint = float(self.table[x >> (64 - 21)])
        rare = RARE_LATIN
        if a >= 0x2E80 or b >= 0x2E80:
            rare = RARE_CJK
        elif (0x370 <= a < 0x2000 and (0x370 <= b < 0x2000 or b < 128)) or (0x370 <= b < 0x2000 and a < 128):
            rare = RARE_LETTERS
        value = math.log((joint + 0.02 * rare) / (min(float(self.single[a]) * float(self.single[b]), joint) + rare))
        return min(3.0, max(-4.0, value))


def segments(badness: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments [from, to) of a sequence of scores, with their sums, in linear time.

    Neighbours of one sign are summed first.  Then the known stack method:
    every positive block joins the nearest earlier candidate from which the
    running sum is lower at its start and not higher at its end.
    """
    n = len(badness)
    if not n:
        return []
    sign = badness > 0
    at = np.concatenate([[0], np.nonzero(np.diff(sign))[0] + 1])
    sums = np.add.reduceat(badness, at)
    ends = np.append(at[1:], n)
    stack: list[list] = []  # start, end, running sum before, running sum after
    running = 0.0
    for start, end, value in zip(at.tolist(), ends.tolist(), sums.tolist()):
        before, running = running, running + value
        if value <= 0:
            continue
        item = [start, end, before, running]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= item[2]:
                j -= 1
            if j < 0 or stack[j][3] >= item[3]:
                break
            item = [stack[j][0], item[1], stack[j][2], item[3]]
            del stack[j:]
        stack.append(item)
    return [(s, e, after - before) for s, e, before, after in stack]


def segments_above(badness: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """The `segments` of a sum of at least ``least``.

    But for ties no maximal segment crosses a place where the best sum that ends there is
    0; only the stretches between such places that reach ``least`` are looked into.
    """
    sums = np.cumsum(badness)
    best = sums - np.minimum.accumulate(np.minimum(sums - badness, sums))
    rising = np.concatenate([[False], best > 0, [False]])
    starts, ends = (np.nonzero(np.diff(rising.astype(np.int8)) == d)[0] for d in (1, -1))
    if not len(starts):
        return []
    peaks = np.maximum.reduceat(best, starts)
    return [
        (a + x, a + y, total)
        for a, z in zip(starts[peaks >= least].tolist(), ends[peaks >= least].tolist())
        for x, y, total in segments(badness[a:z])
        if total >= least
    ]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Repairer:
    """Finds improbable runs in texts and undoes wrong decodings in them."""

    def __init__(self, model: PairModel) -> None:
        self.model = model
        self.seen_characters = frozenset(map(chr, np.nonzero(model.single >= SEEN)[0].tolist()))
        self.pair: dict[str, float] = {}
        self.readings: dict[tuple[str, bool], list[tuple[bytes, str, str, str, int]]] = {}
        self.verdicts: dict[tuple[str, str, str], tuple[float, str, tuple[str, str]] | None] = {}

    def runs(self, text: str, scores: np.ndarray | None = None, least: float = LEAST) -> list[tuple[int, int, float]]:
        """(from, to, improbability) of stretches of ``text``, in code points."""
        if len(text) < 2 or text.isascii():
            return []
        s = self.model.scores(_points(text)) if scores is None else scores
        return [(a, b + 1, total) for a, b, total in segments_above(-0.5 - s.astype(np.float64), least)]

    def _score(self, text: str) -> tuple[float, int]:
        """Sum of scores and number of pairs that aren't plain ASCII; pairs are remembered, as the texts here are short."""
        pair, total, n, last = self.pair, 0.0, 0, ""
        for c in text:
            if last and (last > "\x7f" or c > "\x7f"):
                key = last + c
                value = pair.get(key)
                if value is None:
                    if len(pair) > 1_000_000:
                        pair.clear()
                    value = pair[key] = self.model.score(ord(last), ord(c))
                total += value
                n += 1
            last = c
        return total, n

    def _scores(self, texts: list[str]) -> list[tuple[float, int]]:
        """`_score` of several texts; long ones are scored as one array."""
        if sum(map(len, texts)) < 400:
            return [self._score(t) for t in texts]
        points = _points("".join(texts))
        ends = np.cumsum([len(t) for t in texts])
        wide = points > 127
        counts = wide[:-1] | wide[1:]
        counts[ends[:-1] - 1] = False
        values = np.where(counts, self.model.scores(points), 0.0)
        sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        numbers = np.concatenate([[0], np.cumsum(counts)])
        begins = np.concatenate([[0], ends[:-1]])
        return list(zip((sums[ends - 1] - sums[begins]).tolist(), (numbers[ends - 1] - numbers[begins]).tolist()))

    def _reading(self, run: str, clean: str, raw: bytes, wrong: str, meant: str) -> tuple[str, int] | None:
        """(the bytes of the run read as they were meant, lost characters), if that can be a text."""
        lost = 0
        try:
            new = raw.decode(meant)
        except UnicodeDecodeError:
            # Only where one character is several bytes on either side can a part be missing.
            if not (clean is not run or wrong in _WIDE or meant in _WIDE):
                return None
            new = raw.decode(meant, "replace")
            lost = new.count(_BAD)
            if lost * 8 > len(new):
                return None
        # Leaving out what was lost is no reading.
        if not new or new == run or new == clean:
            return None
        letters = frozenset(new)
        if len(letters - self.seen_characters) * 5 > len(letters) or not _CONTROLS.isdisjoint(letters):
            return None
        return new, lost

    def _gain(self, run: str, raw: bytes, wrong: str, meant: str, new: str, lost: int, scored: tuple[float, int], before: tuple[float, int]) -> tuple[float, float, str] | None:
        """(rank, gain, new text) if a reading makes the run more probable."""
        old, old_n = before
        value, n = scored
        # What was lost in reading can't count against the mapping as garbling would.
        value += 6.0 * lost
        each = value / n if n else 1.5
        gain = value - old * min(1.0, max(1, n) / max(1, old_n))
        # Signs between Latin letters that happen to be well-formed UTF-8 are proof by
        # themselves, even if what comes out is still garbled from an earlier time.
        sure = meant == "utf-8" and wrong not in _WIDE and not lost and len(raw) > len(new)
        sure = sure and (wrong in _LATIN or any(c > "\x7f" and not ("А" <= c <= "я" or c in "Ёё") for c in run))
        if not sure and (each < -0.3 or each - old / max(1, old_n) < GAIN_EACH):
            return None
        return each + (1.0 if sure else 0.0) - 4.0 * lost / len(new), gain + (GAIN if sure else 0.0), new

    def _read(self, run: str, raw: bytes, wrong: str, meant: str, left: str, right: str, before: tuple[float, int]) -> tuple[float, float, str] | None:
        """(rank, gain, new text) if reading the bytes of the run in another way makes it more probable."""
        got = self._reading(run, run.replace(_BAD, "") if _BAD in run else run, raw, wrong, meant)
        return self._gain(run, raw, wrong, meant, *got, self._score(left + got[0] + right), before) if got else None

    def _readings(self, run: str, latin: bool) -> list[tuple[bytes, str, str, str, int]]:
        """(bytes, wrong, meant, new text, lost characters) of all ways to read a run; those of short runs are remembered."""
        known = self.readings.get((run, latin))
        if known is not None:
            return known
        clean = run.replace(_BAD, "") if _BAD in run else run
        letters, tried, found = set(clean), set(), []
        # Beside Latin letters Cyrillic ones are as improbable as what is read.
        meanings = [m for m in WRITTEN_IN if m not in _CYRILLIC] if latin else WRITTEN_IN
        for wrong in READ_AS:
            raw = _as_bytes(clean, letters, wrong)
            # Encodings that agree on the run's characters differ in nothing that follows.
            if raw is None or (raw, wrong in _WIDE) in tried:
                continue
            tried.add((raw, wrong in _WIDE))
            for meant in meanings:
                got = self._reading(run, clean, raw, wrong, meant) if meant != wrong else None
                if got:
                    found.append((raw, wrong, meant, *got))
        if len(run) <= SHORT:
            if len(self.readings) > REMEMBERED:
                self.readings.clear()
            self.readings[run, latin] = found
        return found

    def _try(self, run: str, left: str, right: str) -> tuple[float, str, tuple[str, str]] | None:
        """The best inverse mapping of one run, if any is good enough."""
        key = (run, left, right)
        if key in self.verdicts:
            return self.verdicts[key]
        found = self._readings(run, bool(_BESIDE_LATIN.search(left + run + right)))
        best: tuple[float, str, tuple[str, str]] | None = None
        before, *values = self._scores([left + x + right for x in (run, *(f[3] for f in found))])
        for (raw, wrong, meant, new, lost), scored in zip(found, values):
            got = self._gain(run, raw, wrong, meant, new, lost, scored, before)
            if got and got[1] >= GAIN and (best is None or got[0] > best[0]):
                best = (got[0], got[2], (wrong, meant))
        if len(self.verdicts) > 100_000:
            self.verdicts.clear()
        self.verdicts[key] = best
        return best

    def repair(self, text: str, scores: np.ndarray | None = None) -> tuple[bool, str]:
        """(whether a stretch is garbled, the text with what could be undone)."""
        garbled, hopeless, met = _BAD in text, set(), {text}
        while True:
            runs = sorted(self._joined(text, self.runs(text, scores)), key=lambda r: -r[2])
            scores, undone = None, None
            for a, b, bad in runs:
                if text[a:b] in hopeless:
                    continue
                mapping = self._mapping(text, a, b)
                # One mapping is undone wherever it applies, in the whole text.
                undone = self._undo(text, *mapping) if mapping else text
                if undone not in met:
                    break
                undone = None
                hopeless.add(text[a:b])
                garbled = garbled or bad >= HOPELESS
            if undone is None:
                break
            garbled, text = True, undone
            met.add(text)
        return garbled, text

    def _joined(self, text: str, runs: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        """Runs joined where only ASCII lies between them in one line."""
        joined: list[list] = []
        for a, b, bad in runs:
            if joined and "\n" not in (gap := text[joined[-1][1] : a]) and gap.isascii():
                joined[-1][1:] = [b, joined[-1][2] + bad]
            else:
                joined.append([a, b, bad])
        return [tuple(r) for r in joined]

    def _ends(self, text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
        """A run, then the run with its ends shifted by what else may belong to the same bytes."""
        seen = set()
        for low, high in ((a, b), (a + 1, b - 1), (a + 1, b), (a, b - 1), (a, b + 1), (a - 1, b)):
            low, high = max(0, low), min(len(text), high)
            if high > low and (low, high) not in seen and not text[low:high].isascii():
                seen.add((low, high))
                yield low, high

    def _mapping(self, text: str, a: int, b: int) -> tuple[str, str] | None:
        """The mapping that explains a run; the first part of a long one that can tell decides."""
        for start in range(a, b, VOTING):
            # Inside a run a part may be cut amid a character; all shifts matter at its start only.
            for low, high in islice(self._ends(text, start, min(b, start + VOTING)), 6 if start == a else 2):
                got = self._try(text[low:high], text[max(0, low - 2) : low], text[high : high + 2])
                if got:
                    return got[2]
        return None

    def _undo(self, text: str, wrong: str, meant: str) -> str:
        if meant == "utf-8" and wrong not in _WIDE:
            return self._undo_utf8(text, wrong)
        parts, done = [], 0
        runs = self.runs(text, least=0.5)
        for a, b, _ in self._joined(text, runs):
            # What can't be read as one is read run by run.
            for low, high in chain(self._ends(text, a, b), *(self._ends(text, x, y) for x, y, _ in runs if a <= x and y <= b)):
                if low < done:
                    continue
                clean = text[low:high].replace(_BAD, "")
                raw = _as_bytes(clean, set(clean), wrong)
                left, right = text[max(0, low - 2) : low], text[high : high + 2]
                got = raw and self._read(text[low:high], raw, wrong, meant, left, right, self._score(left + text[low:high] + right))
                if got and got[1] > 0:
                    parts += [text[done:low], got[2]]
                    done = high
                    if (low, high) == (a, b) or high >= b:
                        break
        return "".join(parts) + text[done:]

    def _undo_utf8(self, text: str, wrong: str) -> str:
        """Every stretch that is well-formed UTF-8 in the bytes of the wrong encoding."""
        table = {o: chr(b) for o, b in _byte_table(wrong).items()}
        table |= {o: "\uffff" for o in set(map(ord, text)) if o > 127 and o not in table}
        parts, done = [], 0
        for m in _UTF8.finditer(text.translate(table)):
            try:
                new = m.group().encode("latin-1").replace(b" ", b"\xa0").decode("utf-8")
            except UnicodeDecodeError:
                continue
            parts += [text[done : m.start()], new]
            done = m.end()
        return "".join(parts) + text[done:]


def repair_documents(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, garbled, restored): ``restored`` is the text with all damage undone that can be.

    The pair statistics are over all rows and over all distinct texts of
    ``documents``, so that no text becomes probable by being copied; what
    reaches the driver is at most BUCKETS + 0x110000 counts, whatever the corpus.  Null
    and empty texts aren't garbled and stay as they are.
    """
    counted = count_pairs(documents, text).toArrow()
    model = documents.sparkSession.sparkContext.broadcast((np.asarray(counted["slot"]).astype(np.int32), np.asarray(counted["n"]), np.asarray(counted["once"])))
    rows = documents.select(key, text)
    schema = T.StructType([*rows.schema.fields, T.StructField("garbled", T.BooleanType()), T.StructField("restored", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(PairModel(*model.value))
        for batch in batches:
            flags, out = [], []
            points, offsets = code_points(batch.column(1))
            scores = repairer.model.scores(points) if len(points) > 1 else np.zeros(0)
            # A text without an improbable segment has none to look into.
            inspected = doubtful(scores, offsets)
            for i, t in enumerate(batch.column(1).to_pylist()):
                a, b = offsets[i], max(offsets[i], offsets[i + 1] - 1)
                bad, new = repairer.repair(t, scores[a:b]) if i in inspected else (False, t)
                flags.append(bad)
                out.append(new)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags), pa.array(out, pa.string())], [key, text, "garbled", "restored"])

    return rows.mapInArrow(run, schema).select(key, "garbled", "restored")
