"""Noise in text from scanned pages: found, and repaired into continuous paragraphs.

The texts are read once, into a table of what each block shows: lines that may
be page furniture, its words, words cut at line ends, easily confused CJK
characters with their neighbours.  All decisions are joins over that table.
Page furniture (running lines that carry a title along, lines that are only a
page number) is told by agreement over pages of the document; cut words by
whether the joined or the hyphenated word is one; misread words by
``scan_words``.  Nothing is gathered by document: a document may hold any share
of all blocks, so agreement is counted, joined or looked up by range.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import scan_words as words
from lectern.llm.scan_words import CJK, CUT, Folder
from lectern.operators.positions import cumulative, following
from lectern.session import BROADCAST_ROWS, bounded, written

#: Points from the top of a page above and below which only furniture stands.
TOP_MARGIN, BOTTOM_MARGIN = 60.0, 770.0
#: Pages that must agree on a numbering.
PAGES = 2
#: Lines of so many characters and blanks are looked at in any case; longer ones if the tables have longer titles.
SHORT_LINE, SHORT_BLANKS = 80, 8
#: A line that is only a page number is shorter than this.
NUMBER_LENGTH = 24
#: Characters that a running line may have beside the title it carries along: a page number with its signs.
BESIDE = 12
#: Blocks in which both halves of a compound must occur to be words of their own.
KNOWN = 2
#: Words a task counts before it passes its counts on, and words in one row of counts.
COUNTED, PER_ROW = 500_000, 10_000

_LINE = re.compile(r"\r\n|\n|\r")
_NUMBER = re.compile(
    r"[\s\-–—\[(|·.]*(?:(?:page|pages|seite|pág|pag|página|p|s|第)\.?\s*)?(?:(\d{1,5})(?:\s*(?:/|of|von|de|sur)\s*\d{1,5})?|([ivxlcdm]{1,8}))\s*(?:页|頁)?[\s\-–—\])|·]*",
    re.IGNORECASE,
)
_HAN = re.compile(r"\s*[—\-–]*\s*(?:第\s*([〇零一二三四五六七八九十百]{1,6})\s*[页頁]|([〇零一二三四五六七八九十百]{1,6})\s*[页頁])\s*[—\-–]*\s*")
_HAN_DIGIT = {c: i for i, c in enumerate("〇一二三四五六七八九")} | {"零": 0}
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
# Groups of letters that recognition mixes up, each read as its second form.
_GROUPS = (("rn", "m"), ("cl", "d"), ("ci", "a"), ("ri", "n"), ("ii", "u"), ("vv", "w"), ("li", "h"), ("in", "m"), ("ti", "u"), ("fi", "u"))
# Single letters that are mixed up, each group read as its first.
_ALIKE = ("o0", "li1j!|", "s5", "bh68", "g9q", "ce", "tf", "uüúùû", "oöóòô", "aäáàâ", "eéèê", "iíìî", "nñ", "cç")
_SINGLE = str.maketrans({c: g[0] for g in _ALIKE for c in g[1:]})
_CJK_FIRST = str.maketrans({c: g[0] for g in words.CJK_CONFUSED for c in g[1:]})
_NO_LETTER = re.compile(r"[\W_\u0300-\u036f]+")
_HAN_LETTER = re.compile(f"[{CJK}]")
_OUTER_NUMBER = re.compile(r"^[\s\d.\-–—|·\[\]()]+|[\s\d.\-–—|·\[\]()]+$")


def roman(text: str) -> int:
    total = 0
    values = [_ROMAN[c] for c in text.lower()]
    for a, b in zip(values, [*values[1:], 0]):
        total += -a if a < b else a
    return total


def han_number(text: str) -> int:
    """Chinese numerals, written by place (一〇三) or with tens and hundreds (一百零三)."""
    if not set(text) & {"十", "百"}:
        return int("".join(str(_HAN_DIGIT[c]) for c in text))
    total, digit = 0, 0
    for c in text:
        if c in _HAN_DIGIT:
            digit = _HAN_DIGIT[c]
        else:
            total += (digit or 1) * (10 if c == "十" else 100)
            digit = 0
    return total + digit


def page_number(line: str) -> int | None:
    """The number of a line that is only a page number."""
    if m := _HAN.fullmatch(line):
        return han_number(m.group(1) or m.group(2))
    m = _NUMBER.fullmatch(line)
    if not m:
        return None
    if m.group(1):
        return int(m.group(1))
    value = roman(m.group(2))
    return value if 0 < value < 400 else None


@dataclass(frozen=True)
class Longest:
    """The most characters and blanks that a line of a title may have: those of the longest title or heading of the tables, or more."""

    length: int
    blanks: int


def longest_title(sections: DataFrame, versions: DataFrame) -> Longest:
    named = versions.select(F.col("title").alias("t")).unionByName(sections.select(F.col("heading").alias("t")))
    blanks = F.length("t") - F.length(F.replace("t", F.lit(" "), F.lit("")))
    found = named.agg(F.max(F.length("t")), F.max(blanks)).first()
    return Longest(max(found[0] or 0, SHORT_LINE), max(found[1] or 0, SHORT_BLANKS))


def title_key(line: str, longest: Longest) -> str:
    """A title line as letters only, with all letters that are easily confused made one; empty if it is none.

    A title and the same title misread have the same key, also with a page
    number before or after it.
    """
    if line.count(" ") > longest.blanks + BESIDE:
        return ""
    line = _OUTER_NUMBER.sub("", line)
    if not line or len(line) > longest.length or line.count(" ") > longest.blanks:
        return ""
    if not line.isascii():
        line = unicodedata.normalize("NFKD", line)
    key = _NO_LETTER.sub("", line.lower())
    for a, b in _GROUPS:
        key = key.replace(a, b)
    # Accents go first, so that a letter and its accented form end in one group.
    key = key.translate(_SINGLE).translate(_SINGLE).translate(_SINGLE).translate(_CJK_FIRST)
    return key if len(key) >= (2 if _HAN_LETTER.search(key) else 4) else ""


def hash_key(key: str) -> int:
    return xxhash.xxh64_intdigest(key) - (1 << 63)


_TABLE = (
    "id string, document_id string, section_id string, page int, char_start int, top double, hash long, copy long, body boolean, "
    "lines array<struct<line:int,whole:boolean,number:int,key:long>>, words string, ns array<long>, "
    "cuts array<string>, tail string, mark string, head string, skip string, around array<string>"
)
_EDGE = re.compile(rf"({words.HALF})([-‐‑¬\xad])\s*$")
_HEAD = re.compile(rf"\s*({words.HALF})")
_MARKS = "-‐‑¬\xad"
_STOPS = ".,;:!?。，；：！？、"
_MAY_BE_NUMBER = re.compile(r"\d|[页頁]|^[\W_]*(?:[a-zá]+\.?\s*)?[ivxlcdm]{1,8}[\W_]*$", re.IGNORECASE)


class Reader:
    """What single lines and edges of a text show; lines are remembered, as furniture returns on every page."""

    def __init__(self, longest: Longest) -> None:
        self.longest, self.seen = longest, {}

    def line(self, x: str) -> tuple[int | None, str]:
        """(page number, title key) of a stripped line; (None, "") if it can't be furniture."""
        got = self.seen.get(x)
        if got is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            n = page_number(x) if len(x) < NUMBER_LENGTH and _MAY_BE_NUMBER.search(x) else None
            got = self.seen[x] = (n, "" if n is not None else title_key(x, self.longest))
        return got

    def inner(self, x: str) -> tuple[int | None, str]:
        """As `line`, of a line between others: there a title ends without a stop."""
        n, key = self.line(x)
        return (n, key) if n is not None or x[-1] not in _STOPS else (None, "")

    def lines(self, text: str) -> list[tuple[int, bool, int | None, str]]:
        """(number of the line, whether it is the whole text, page number, title key) of lines that may be furniture."""
        most = max(self.longest.length + BESIDE, NUMBER_LENGTH)
        if "\n" not in text and "\r" not in text:
            x = text.strip()
            found = self.line(x) if len(x) <= most else (None, "")
            return [(0, True, *found)] if found != (None, "") else []
        rows = [(k, x) for k, y in enumerate(_LINE.split(text)) if (x := y.strip())]
        alone = len(rows) == 1
        found = [(k, alone, *(self.line(x) if alone else self.inner(x))) for k, x in rows if len(x) <= most]
        return [f for f in found if f[2:] != (None, "")]

    def tail(self, text: str) -> tuple[str, str] | None:
        """A half word and its mark at the end of a block, also before a last line of furniture."""
        text = text.rstrip()
        if text[-1:] in _MARKS:
            return self._edge(text)
        at = max(text.rfind("\n"), text.rfind("\r"))
        before = text[:at].rstrip() if at > 0 else ""
        if before and before[-1] in _MARKS and (x := text[at:].strip()) and self.inner(x) != (None, ""):
            return self._edge(before)
        return None

    @staticmethod
    def _edge(text: str) -> tuple[str, str] | None:
        # A half word has no blanks: it lies in what follows the last one.
        edge = _EDGE.search(text.rsplit(None, 1)[-1]) if text else None
        return (edge.group(1), edge.group(2)) if edge else None

    def beyond(self, text: str, at: int) -> list[str]:
        """First words after one and two lines of furniture that begin before ``at``, the end of a word of theirs."""
        begin = max(text.rfind("\n", 0, at), text.rfind("\r", 0, at)) + 1
        lines = _LINE.split(text[begin:], maxsplit=3)
        found = []
        for k in range(1, min(3, len(lines))):
            x = lines[k - 1].strip()
            if not x or self.inner(x) == (None, ""):
                break
            if m := _HEAD.match(lines[k]):
                found.append(m.group(1))
        return found


def _lists(rows: list, kind: pa.DataType) -> pa.Array:
    """A list array of rows of values."""
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(list(chain.from_iterable(rows)), kind))


def _join_cut(*parts: str) -> str:
    """A cut word as one string: first half, mark, ``f`` if only spaces are left of the line end, second half, halves beyond furniture."""
    return "\x1f".join(parts)


def read_blocks(blocks: DataFrame, longest: Longest) -> DataFrame:
    """What every block shows, in one pass over the texts; and the word counts of each task.

    Rows with ``ns`` are counts: in how many blocks of the task each of
    ``words`` occurs (they are joined by a separator, as one string is much
    cheaper to pass on than an array).  The others are blocks: ``lines`` that may be furniture,
    distinct ``words`` (and pairs of confused CJK characters), ``cuts``, a half
    word at the end (``tail``, ``mark``), the first word (``head``; ``skip`` if
    it may be the second half of a word), CJK characters with neighbours
    (``around``).  ``copy`` tells deliveries of a row apart.
    """
    page = F.coalesce(F.col("page"), F.col("bbox")[0].cast("int"))
    columns = ["id", "document_id", "section_id", page.alias("page"), "char_start", F.col("bbox")[2].cast("double").alias("top")]
    source = blocks.select(*columns, F.xxhash64("id", "document_id", "kind", "text", "section_id", "page", "char_start").alias("hash"), "kind", "text")
    names = [f.name for f in source.sparkSession.createDataFrame([], _TABLE).schema.fields]

    def counted(total: Counter[str]) -> Iterator[pa.RecordBatch]:
        keys, ns = list(total.keys()), list(total.values())
        rows = range(0, len(keys), PER_ROW)
        if rows:
            w, n = pa.array(["\x1f".join(keys[i : i + PER_ROW]) for i in rows]), _lists([ns[i : i + PER_ROW] for i in rows], pa.int64())
            none = lambda t: pa.nulls(len(rows), t)
            lines = pa.list_(pa.struct([("line", pa.int32()), ("whole", pa.bool_()), ("number", pa.int32()), ("key", pa.int64())]))
            kinds = [*[pa.string()] * 3, pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), lines]
            yield pa.RecordBatch.from_arrays([*map(none, kinds), w, n, none(pa.list_(pa.string())), *[none(pa.string())] * 4, none(pa.list_(pa.string()))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, reader, total = Folder(), Reader(longest), Counter()
        draw = np.random.default_rng(int.from_bytes(os.urandom(8), "big"))
        for batch in batches:
            shown, asked = [], set()
            for t in batch.column(8).to_pylist():
                if not t or t.isspace():
                    shown.append(None)
                    continue
                cut = words.marked(t)
                tokens = set(words.words_of(t, cut))
                inner = [(a, m, b, flat, () if flat else reader.beyond(t, end)) for a, m, b, flat, end in words.cuts(t) if b] if cut else []
                tail, head = reader.tail(t), _HEAD.match(t)
                head = head.group(1) if head else None
                shown.append((tokens, inner, tail, head, reader.lines(t), words.surroundings(t)))
                asked |= tokens
                for a, _, b, _, c in inner:
                    asked.update((a, b, *c))
                asked.update(x for x in (tail and tail[0], head) if x)
            folded = folder(asked)
            lines, found, cuts, tails, marks, heads, skips, arounds = [], [], [], [], [], [], [], []
            for x in shown:
                tokens, inner, tail, head, furniture, around = x or ((), (), None, None, (), ())
                own = {folded[w] for w in tokens}
                own.update([p for w in own if "-" in w for p in w.split("-")], words.pairs_of(around))
                own.discard("")
                total.update(own)
                lines.append(furniture)
                found.append("\x1f".join(own))
                cuts.append([_join_cut(folded[a], m, "f" if flat else "", folded[b], *[folded[w] for w in c]) for a, m, b, flat, c in inner])
                tails.append(folded[tail[0]] if tail else None)
                marks.append(tail[1] if tail else None)
                heads.append(folded[head] if head else None)
                skips.append(folded[head] if head and head[0].islower() and head.isalpha() else None)
                arounds.append(list(around))
            kinds = batch.column(7).to_pylist()
            flat = list(chain.from_iterable(lines))
            fields = [
                pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], pa.bool_()), pa.array([f[2] for f in flat], pa.int32()),
                pa.array([hash_key(f[3]) if f[3] else None for f in flat], pa.int64()),
            ]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in lines])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:7], pa.array(draw.integers(1 << 62, size=len(kinds))), pa.array([x is not None and k != "table" for x, k in zip(shown, kinds)]),
                    pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["line", "whole", "number", "key"])), pa.array(found, pa.string()), pa.nulls(len(kinds), pa.list_(pa.int64())),
                    _lists(cuts, pa.string()), *[pa.array(c, pa.string()) for c in (tails, marks, heads, skips)], _lists(arounds, pa.string()),
                ],
                names,
            )
            if len(total) > COUNTED:
                yield from counted(total)
                total = Counter()
        yield from counted(total)

    return source.mapInArrow(run, _TABLE)


def split_words() -> Column:
    """The column of words as an array."""
    return F.split("words", "\x1f")


def once(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of `read_blocks`, each delivered row once; in how many of them each word occurs)."""
    blocks = table.where("ns IS NULL")
    repeated = bounded(blocks.groupBy("id", "hash").agg(F.count("*").alias("_n"), F.min("copy").alias("_keep")).where("_n > 1 AND id IS NOT NULL").drop("_n"))
    marked = blocks.join(repeated, ["id", "hash"], "left")
    first = marked.where("_keep IS NULL OR _keep = copy").drop("_keep")
    again = marked.where("_keep <> copy").select(F.explode(split_words()).alias("word"), F.lit(-1).cast("long").alias("n"))
    counted = table.where("ns IS NOT NULL").select(F.explode(F.arrays_zip(split_words().alias("word"), F.col("ns").alias("n"))).alias("x")).select("x.word", "x.n")
    return first, counted.unionByName(again).groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def titles(features: DataFrame, sections: DataFrame, versions: DataFrame, longest: Longest) -> DataFrame:
    """(document_id, key, head_page): keys of the document's title (head_page null) and of its headings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [title_key(t.strip(), longest) if t else "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([hash_key(k) if k else None for k in keys], pa.int64())], ["document_id", "head_page", "key"])

    named = versions.where("is_current").select("document_id", F.col("title").alias("text"), F.lit(None).cast("int").alias("head_page"))
    headed = sections.select("document_id", F.col("heading").alias("text"), F.coalesce("page", F.lit(0)).cast("int").alias("head_page"))
    keyed = named.unionByName(headed).where("text IS NOT NULL").distinct().mapInArrow(run, "document_id string, head_page int, key long")
    opening = features.where("char_start = 0 AND whole AND key IS NOT NULL").select("document_id", F.lit(None).cast("int").alias("head_page"), "key")
    every = keyed.unionByName(opening).where("key IS NOT NULL AND document_id IS NOT NULL")
    # A title wins over a heading of the same words.
    return every.groupBy("document_id", "key").agg(F.max(F.col("head_page").isNull()).alias("is_title"), F.min("head_page").alias("head_page"))


def furniture(rows: DataFrame, sections: DataFrame, versions: DataFrame, longest: Longest) -> DataFrame:
    """(id, line, whole, noise): lines that are page furniture, ``running`` or ``page_number``."""
    features = written(rows.where(F.size("lines") > 0).select("document_id", "id", "page", "char_start", "top", F.inline("lines")))
    known = titles(features, sections, versions, longest)
    margin = F.coalesce((F.col("top") < TOP_MARGIN) | (F.col("top") > BOTTOM_MARGIN), F.lit(False))
    keyed = features.where("key IS NOT NULL")
    lines = keyed.join(known, ["document_id", "key"])
    # What stands alone in a margin and is no number is carried along, also where no title is known.
    marginal = keyed.where(F.col("whole") & margin & (F.col("char_start") > 0)).select("document_id", "id", "line", "whole")
    # Without coordinates the earliest such block on the heading's own page is the heading itself.
    earliest = lines.where("whole AND top IS NULL AND NOT is_title").groupBy("document_id", "key").agg(F.min("char_start").alias("_earliest"))
    lines = lines.join(earliest, ["document_id", "key"], "left")
    heading = ~F.col("is_title") & (F.col("char_start") == F.col("_earliest")) & (F.coalesce(F.col("page"), F.col("head_page")) <= F.col("head_page"))
    running = lines.where(
        F.when(F.col("char_start") == 0, F.lit(False))
        .when(~F.col("whole"), F.lit(True) & ((F.col("line") > 0) | F.col("is_title")))
        .when(F.col("top").isNotNull(), margin)
        .otherwise(~F.coalesce(heading, F.lit(False)))
    ).select("document_id", "id", "line", "whole").unionByName(marginal).distinct()
    numbers = features.where("number IS NOT NULL")
    offset = F.col("number") - F.col("page")
    support = numbers.where("page IS NOT NULL").groupBy("document_id", offset.alias("_offset")).agg(F.countDistinct("page").alias("_pages"))
    # One numbering a document: the one most pages agree on (at most one row per distinct offset).
    best = support.where(F.col("_pages") >= PAGES).groupBy("document_id").agg(F.max_by("_offset", F.struct("_pages", -F.col("_offset"))).alias("_offset"))
    agreed = numbers.withColumn("_offset", offset).join(best, ["document_id", "_offset"], "left_semi").select("id", "line", "whole")
    # A number next to a running line inside a block belongs to it.
    beside = running.where("NOT whole").select("id", F.explode(F.array(F.col("line") - 1, F.col("line") + 1)).alias("line"))
    adjacent = numbers.where("NOT whole").join(beside, ["id", "line"], "left_semi").select("id", "line", "whole")
    numbered = agreed.unionByName(adjacent).distinct()
    return running.select("id", "line", "whole", F.lit("running").alias("noise")).unionByName(numbered.select("id", "line", "whole", F.lit("page_number").alias("noise")))


def cut_word(left: str, mark: str, right: str | None, known: dict[str, int], flat: bool = False) -> str | None:
    """The whole word if ``left`` + ``mark`` is a word cut in two, else None.  Words in folded form.

    A hyphen that the word is spelled with is no cut.  The other marks are
    never part of a spelling.  ``flat``: only spaces are left of the line end,
    so a hyphen must join to a known word.  ``known`` has the counts of the
    words `asked_words` names.
    """
    if not left or left[-1].isdigit():
        return None
    if mark in "¬\xad":
        return left + (right or "")
    if right is None:
        return None
    joined, compound = left + right, f"{left}-{right}"
    if right[0].isdigit():
        return None
    whole, spelled = known.get(joined, 0), known.get(compound, 0)
    if spelled > whole:
        return None
    if whole or flat:
        return joined if whole else None
    # Neither is known: two known words are a compound, anything else was cut.
    tail, head = left.rsplit("-", 1)[-1], right.split("-", 1)[0]
    if known.get(tail + head, 0):
        return joined
    both = min(known.get(tail, 0), known.get(head, 0)) >= KNOWN
    return None if both and len(tail) > 3 and len(head) > 3 else joined


def asked_words(left: str, rights: list[str]) -> set[str]:
    """The words whose counts decide whether a word was cut before one of ``rights``."""
    tail = left.rsplit("-", 1)[-1]
    heads = [(r, r.split("-", 1)[0]) for r in rights]
    return {w for r, h in heads for w in (left + r, f"{left}-{r}", tail + h, tail, h) if w}


def decided(cuts: DataFrame, counts: DataFrame) -> DataFrame:
    """(cut, whole, more, less) of distinct cut words that were indeed cut or whose halves are words.

    ``whole`` is the word if it was cut, ``more`` are words the block holds
    besides, ``less`` is one that is none.  Only the words asked about are
    looked up, by a join; each cut gathers the few counts it needs.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c, w) for c in batch.column(0).to_pylist() for left, _, _, *rights in [c.split("\x1f")] for w in asked_words(left, rights)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], ["cut", "word"])

    asked = cuts.select("cut").distinct().mapInArrow(ask, "cut string, word string").join(counts, "word", "left")
    known = asked.groupBy("cut").agg(F.collect_list("word").alias("words"), F.collect_list(F.coalesce("n", F.lit(0))).alias("ns"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wholes, mores, lesses = [], [], []
            for c, w, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                table = dict(zip(w, n))
                left, mark, flat, right, *beyond = c.split("\x1f")
                # A line of furniture may stand between the halves.
                later = next((x for x in beyond if table.get(left + x, 0)), "")
                if table.get(left + right, 0):
                    later = ""
                whole = cut_word(left, mark, later or right, table, bool(flat))
                wholes.append(whole)
                mores.append([x for x in [*(whole or f"{left}-{later or right}").split("-"), *([right] if later else [])] if x])
                lesses.append(later or None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(wholes, pa.string()), _lists(mores, pa.string()), pa.array(lesses, pa.string())], ["cut", "whole", "more", "less"])

    return known.mapInArrow(decide, "cut string, whole string, more array<string>, less string")


def cut_between(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, cut) of blocks that end in a half word, with the first word of the next block of the document's body."""
    body = rows.where("body AND document_id IS NOT NULL AND char_start IS NOT NULL").select("document_id", "char_start", "id", "tail", "mark", "head")
    # Only documents with a half word at the end of some block have anything to look up.
    halved = bounded(body.where("tail IS NOT NULL").select("document_id").distinct())
    body = body.join(halved, "document_id", "left_semi").join(lines.where("whole").select("id").distinct(), "id", "left_anti")
    followed = following(body, ["document_id"], ["char_start", "id"], "head", "after").where("tail IS NOT NULL AND (after IS NOT NULL OR mark IN ('¬', '\xad'))")
    return followed.select("id", F.concat_ws("\x1f", "tail", "mark", F.lit(""), F.coalesce("after", F.lit(""))).alias("cut"))


def misread(rows: DataFrame, more: DataFrame, less: DataFrame, fixes: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """(id, word, fix): misread words of every block, with the likeliest original by context.

    ``fixes`` of up to ``most`` words are looked up where the words lie, in one
    pass over the column of words; more are joined.  Either way the candidates
    of a word are ranked with the words of its own block.
    """
    corrected = written(fixes)
    own = rows.select("id", "words", "skip", F.lit(None).cast("array<struct<word:string,fixes:array<struct<fix:string,weight:double,n:bigint>>>>").alias("found"))
    joined = more.join(corrected, "word").select("id", "word", "fixes")
    share = corrected.count() <= most
    if share:
        table = corrected.toArrow()
        broadcast = rows.sparkSession.sparkContext.broadcast(table)
    else:
        broadcast = None
        hits = own.select("id", "skip", F.explode(split_words()).alias("word")).where("NOT word <=> skip").join(corrected, "word").groupBy("id").agg(F.collect_list(F.struct("word", "fixes")).alias("found"))
        own = own.drop("found").join(hits, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if broadcast is not None:
            keys, values = broadcast.value["word"].combine_chunks(), broadcast.value["fixes"]
        for batch in batches:
            ids, out = batch.column(0), []
            if broadcast is not None:
                lists = pc.split_pattern(batch.column(1), "\x1f")
                at = pc.index_in(lists.flatten(), value_set=keys)
                hit = np.nonzero(np.asarray(at.is_valid()))[0]
                parents = np.asarray(pc.list_parent_indices(lists))[hit]
                places = np.asarray(at.take(pa.array(hit)))
                present = {i: set(lists[i].as_py()) for i in set(parents.tolist())}
                for i, j in zip(parents.tolist(), places.tolist()):
                    if (w := keys[j].as_py()) != batch.column(2)[i].as_py():
                        out.append((ids[i].as_py(), w, words.choose(values[j].as_py(), present[i])))
            else:
                for i, w, found in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3))):
                    out += [(i, f["word"], words.choose(f["fixes"], set(w.split("\x1f")))) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.string()) for c in range(3)], ["id", "word", "fix"])

    inside = own.select("id", "words", "skip", "found").mapInArrow(run, "id string, word string, fix string")
    apart = joined.select("id", "word", F.col("fixes")[0]["fix"].alias("fix"))
    return inside.join(less, ["id", "word"], "left_anti").unionByName(apart)


def printed_characters(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(around, printed): misread CJK characters between their neighbours.

    The pairs looked up hold one of a fixed few characters each, so their
    number is bounded by that of the characters of the script.
    """
    pairs = counts.where(F.col("word").rlike(f"^[{CJK}]{{2}}$")).toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(dict(zip(pairs["word"].to_pylist(), pairs["n"].to_pylist())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(a, c) for a in batch.column(0).to_pylist() if (c := words.printed_cjk(a, shared.value))]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in range(2)], ["around", "printed"])

    return rows.select(F.explode("around").alias("around")).distinct().mapInArrow(run, "around string, printed string")


@dataclass
class Evidence:
    """What is known of the blocks: all tables by id of the block."""

    rows: DataFrame
    lines: DataFrame
    inner: DataFrame
    between: DataFrame
    fixed: DataFrame
    glyphs: DataFrame


def evidence(blocks: DataFrame, sections: DataFrame, versions: DataFrame) -> Evidence:
    """Furniture lines (id, line, whole, noise), words cut inside and between blocks (id, whole), misread words (id, word, fix) and characters (id, around, printed)."""
    longest = longest_title(sections, versions)
    rows, counts = once(written(read_blocks(blocks, longest)))
    counts = written(counts)
    lines = written(furniture(rows, sections, versions, longest))
    cuts = rows.where(F.size("cuts") > 0).select("id", F.explode("cuts").alias("cut"), F.lit(False).alias("ends"))
    cuts = written(cuts.unionByName(cut_between(rows, lines).withColumn("ends", F.lit(True))))
    known = written(cuts.join(bounded(decided(cuts, counts)), "cut").select("id", "whole", "more", "less", "ends"))
    more = known.where("NOT ends").select("id", F.explode("more").alias("word")).distinct()
    less = known.where("NOT ends AND less IS NOT NULL").select("id", F.col("less").alias("word")).distinct()
    fixed = misread(rows, more, less, words.corrections(counts))
    around = rows.where(F.size("around") > 0).select("id", F.explode("around").alias("around"))
    glyphs = around.join(bounded(printed_characters(rows, counts)), "around")
    whole = known.where("whole IS NOT NULL").select("id", "whole", "ends")
    return Evidence(rows, lines, whole.where("NOT ends").drop("ends"), whole.where("ends").drop("ends"), fixed, glyphs)


def find_noise(blocks: DataFrame, sections: DataFrame, versions: DataFrame) -> DataFrame:
    """(id, noise): one row per block and kind of noise: running, page_number, hyphen, misread.

    Null, empty and blank texts hold none; repeated rows count once; blocks
    without a page, coordinates or section are judged by what they have.
    """
    e = evidence(blocks, sections, versions)
    named = lambda df, noise: df.select("id", F.lit(noise).alias("noise"))
    hyphen = named(e.inner, "hyphen").unionByName(named(e.between, "hyphen"))
    wrong = named(e.fixed, "misread").unionByName(named(e.glyphs, "misread"))
    return e.lines.select("id", "noise").unionByName(hyphen).unionByName(wrong).distinct()


_STOP = re.compile(r"[.!?…。！？:：;；\"”»)\]]\s*$")
_BETWEEN_CJK = re.compile(rf"(?<=[{CJK}，。！？；：、])[ \t]*(?:\r\n|\n|\r)[ \t]*(?=[{CJK}])")


def mend(text: str, drop: set[int], fixes: dict[str, str], wholes: set[str], printed: dict[str, str], folder: Folder) -> str:
    """One block without furniture, its cut words joined, misread words and characters replaced, lines reflowed."""
    if drop:
        text = "\n".join(x for k, x in enumerate(_LINE.split(text)) if k not in drop)
    text = words.replace_cjk(text, printed)

    def rejoin(m: re.Match) -> str:
        left, mark, right = m.group(1), m.group(2), m.group(3) or m.group(4)
        if not right:
            return m.group(0)
        folded = folder({left, right})
        return left + right if folded[left] + folded[right] in wholes else f"{left}{mark}{right}"

    text = CUT.sub(rejoin, text)
    if fixes:
        present = set(words.words_of(text))
        folded = folder(present)
        for w in present:
            best = fixes.get(folded[w])
            if best:
                cased = best.upper() if w.isupper() and len(w) > 1 else best.capitalize() if w[0].isupper() else best
                text = re.sub(rf"(?<![^\W_]){re.escape(w)}(?![^\W_])", lambda m, x=cased: x, text)
    text = _BETWEEN_CJK.sub("", text)
    return re.sub(r"\s+", " ", text).strip()


def repair_text(blocks: DataFrame, sections: DataFrame, versions: DataFrame) -> DataFrame:
    """(document_id, char_start, text): the paragraphs of every document's body, in order of ``char_start``.

    A block goes on in the next one if its last word is cut, or if it ends
    without a stop and the next begins in lower case; then both are one
    paragraph.  Tables and blocks without text or place are left out.  No
    document is gathered: the next block is looked up by range, paragraphs are
    numbered by range counts, and only a paragraph's own blocks meet.
    """
    e = evidence(blocks, sections, versions)
    dropped = e.lines.groupBy("id").agg(F.collect_set("line").alias("drop"))
    wrong = e.fixed.groupBy("id").agg(F.collect_set(F.struct("word", "fix")).alias("wrong"))
    wholes = e.inner.groupBy("id").agg(F.collect_set("whole").alias("wholes"))
    glyphs = e.glyphs.groupBy("id").agg(F.collect_set(F.struct("around", "printed")).alias("glyphs"))
    cut_here = e.between.select("id", F.lit(True).alias("cut")).distinct()
    body = blocks.where("kind <> 'table' AND text IS NOT NULL AND document_id IS NOT NULL AND char_start IS NOT NULL").select("id", "document_id", "char_start", "text").distinct()
    joined = body.join(dropped, "id", "left").join(wrong, "id", "left").join(wholes, "id", "left").join(glyphs, "id", "left").join(cut_here, "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder()
        for batch in batches:
            done = [
                mend(t, set(d or ()), {x["word"]: x["fix"] for x in w or ()}, set(h or ()), {x["around"]: x["printed"] for x in g or ()}, folder)
                for t, d, w, h, g in zip(*(batch.column(i).to_pylist() for i in range(4, 9)))
            ]
            heads = [_HEAD.match(t) for t in done]
            stops, low = pa.array([bool(_STOP.search(t)) for t in done]), pa.array([bool(m and m.group(1)[0].islower()) for m in heads])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(done, pa.string()), stops, low], ["id", "document_id", "char_start", "cut", "text", "stops", "low"])

    mended = joined.select("id", "document_id", "char_start", F.coalesce("cut", F.lit(False)).alias("cut"), "text", "drop", "wrong", "wholes", "glyphs")
    mended = mended.mapInArrow(run, "id string, document_id string, char_start int, cut boolean, text string, stops boolean, low boolean").where("text <> ''")
    chained = following(mended, ["document_id"], ["char_start", "id"], "low", "next_low")
    goes_on = F.col("cut") | (~F.col("stops") & F.coalesce("next_low", F.lit(False)))
    linked = chained.select("id", "document_id", "char_start", "text", "cut", F.when(goes_on, 0).otherwise(1).cast("long").alias("ends"))
    numbered = cumulative(linked, ["document_id"], ["char_start", "id"], "ends")
    parts = F.array_sort(F.collect_list(F.struct("char_start", "id", "text", "cut")))
    glued = F.aggregate(parts, F.struct(F.lit("").alias("t"), F.lit(True).alias("glue")), lambda a, p: F.struct(
        F.concat(a["t"], F.when(a["glue"], "").otherwise(" "), F.when(p["cut"], F.regexp_replace(p["text"], r"[-‐‑¬\u00ad]\s*$", "")).otherwise(p["text"])).alias("t"), p["cut"].alias("glue")
    ))
    return numbered.groupBy("document_id", "below").agg(F.min("char_start").alias("char_start"), glued["t"].alias("text")).select("document_id", "char_start", "text")
