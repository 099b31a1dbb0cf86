"""Words read wrongly on scanned pages: counts, candidates and corrections."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.levenshtein import Trie
from lectern.llm.same_look import fold_array

#: A correction must be this many times as frequent as what was read; less if a digit was read inside a word.
TIMES, TIMES_DIGIT = 8, 2
#: From this many blocks on a form is hardly a chance reading: the times rise with it, up to the most that is asked of any.
STEADY, MOST_TIMES = 40, 100
#: Least count of a word that corrects others, and length of a word that is questioned.
LEAST_COUNT, SHORTEST = 5, 3
DISTANCE = 2
#: Vocabulary words of one trie, and questioned words that meet it in one task.
VOCABULARY_BLOCK, QUESTIONED_BLOCK = 100_000, 100_000

# Fixed values: (as read, as printed), letters that recognition mixes up.
CONFUSED = (
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("j", "i"), ("i", "l"), ("l", "i"), ("b", "h"), ("h", "b"), ("u", "n"), ("n", "u"),
    ("ci", "a"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("d", "cl"), ("rn", "m"), ("m", "rn"), ("m", "in"), ("vv", "w"), ("h", "li"),
    ("li", "h"), ("ii", "ü"), ("ü", "ti"), ("b", "ß"), ("ni", "m"), ("nri", "nn"), ("a", "o"), ("o", "a"), ("v", "y"), ("y", "v"), ("fi", "ti"),
)
# CJK characters that differ in a stroke or its length.
CJK_CONFUSED = ("土士", "人入", "己已巳", "未末", "日曰", "干千", "天夭", "刀力", "午牛", "戊戌戍", "折析", "侯候", "刺剌", "卷券", "鳥烏", "書晝", "間問", "今令", "冶治", "木本", "大太", "微徽", "季李", "王玉", "貝見")
#: How clear the neighbours must speak for the other character.
CJK_TIMES, CJK_LEAST = 5, 8

CJK = "㐀-鿿豈-﫿"
# Signs that letters inside a word are read as.
SIGNS = {"(": "c", "|": "li", "!": "li", "$": "s"}
# A letter, with marks and invisible characters that belong to it.
_UNSEEN = "\u0300-\u036f\u200b-\u200d\u2060\ufeff"
_LETTERS = rf"[^\W_{CJK}぀-ヿ](?:[^\W_{CJK}぀-ヿ]|[{_UNSEEN}]|\xad(?=[^\W_]))*+"
# Letters next to these signs are no words of a text.
_TOKEN = re.compile(rf"(?<![+/=_@#\\\w])({_LETTERS}(?:[-‐‑(|!$]{_LETTERS})*+)(?![+/=_@#\\])")
# The same for plain ASCII and for texts without such characters, which are most.
_SPECIAL = re.compile(rf"[{_UNSEEN}\xad]")
_TOKEN_ASCII = re.compile(r"(?<![+/=@#\\\w])([A-Za-z0-9]++(?:[-(|!$][A-Za-z0-9]++)*+)(?![+/=_@#\\])")
_TOKEN_PLAIN = re.compile(rf"(?<![+/=@#\\\w])([^\W_{CJK}぀-ヿ]++(?:[-‐‑(|!$][^\W_{CJK}぀-ヿ]++)*+)(?![+/=_@#\\])")
#: Capitals inside a word, but for an I read for an l.
_JUNK = re.compile(r"[a-z0-9][A-HJ-Z]")
HALF = rf"{_LETTERS}(?:[-‐‑'’]{_LETTERS})*"
_MARK_AT_END = re.compile(r"[-‐‑¬\xad](?:\s|$)")
#: Both halves of a word cut at a line end, also where the line ends have become spaces (the fourth group
#: then holds the second half), or a half at the end of the text.
CUT = re.compile(rf"(?<![^\W_])({HALF})([-‐‑¬\xad])(?:[ \t]*(?:\r\n|\n|\r)[ \t]*({HALF})?|[ \t]+({HALF})|[ \t]*$)")
_RARE_CJK = frozenset("".join(CJK_CONFUSED))
_OTHERS = {c: g.replace(c, "") for g in CJK_CONFUSED for c in g}
_CONFUSED_CJK = re.compile("[" + "".join(CJK_CONFUSED) + "]")


def fold_words(words: list[str]) -> list[str]:
    """Words in the form of same look, lower case."""
    return [w.lower() for w in fold_array(pa.array(words, pa.string())).to_pylist()] if words else []


class Folder:
    """Folded words, remembered: only words beyond ASCII need the fold."""

    def __init__(self) -> None:
        self.known: dict[str, str] = {}

    def __call__(self, words: set[str]) -> dict[str, str]:
        if len(self.known) > 500_000:
            self.known.clear()
        fresh = [w for w in words if w not in self.known]
        plain = [w for w in fresh if w.isascii()]
        self.known.update(zip(plain, map(str.lower, plain)))
        wide = [w for w in fresh if not w.isascii()]
        self.known.update(zip(wide, fold_words(wide)))
        return self.known


def words_of(text: str, marked: bool | None = None) -> list[str]:
    """Words and hyphenated compounds of a text, without words cut at a line end (``marked``: whether there may be any)."""
    if _MARK_AT_END.search(text) if marked is None else marked:
        text = CUT.sub(" ", text)
    pattern = _TOKEN_ASCII if text.isascii() else _TOKEN if _SPECIAL.search(text) else _TOKEN_PLAIN
    return [w for w in pattern.findall(text) if w.islower() or not _JUNK.search(w)]


def marked(text: str) -> bool:
    """Whether a mark that cuts words stands at a line end."""
    return bool(_MARK_AT_END.search(text))


def cuts(text: str) -> list[tuple[str, str, str | None, bool, int]]:
    """(first half, mark, second half, whether spaces stand for the line end, end of the match) of words cut at a line end."""
    return [(m.group(1), m.group(2), m.group(3) or m.group(4), m.group(4) is not None, m.end()) for m in CUT.finditer(text)]


def surroundings(text: str) -> set[str]:
    """Every easily confused CJK character between its CJK neighbours (a blank for none), across line ends."""
    if text.isascii() or _RARE_CJK.isdisjoint(text):
        return set()
    return {f"{_neighbour(text, m.start(), -1) or ' '}{m.group()}{_neighbour(text, m.start(), 1) or ' '}" for m in _CONFUSED_CJK.finditer(text)}


def pairs_of(around: set[str]) -> set[str]:
    """The pairs of CJK characters in `surroundings`."""
    return {p for x in around for p in (x[:2], x[1:]) if " " not in p}


@lru_cache(maxsize=1)
def _weights() -> dict[tuple[str, str], float]:
    table = {pair: 1.0 for pair in CONFUSED}
    for digit, letters in {"0": "oO", "1": "li", "5": "s", "6": "b", "9": "gq", "8": "b", "2": "z", "3": "e", "4": "a", "7": "t"}.items():
        table |= {(digit, x): 1.5 for x in letters}
    table |= {(sign, x): 1.5 for sign, letters in SIGNS.items() for x in letters}
    return table


def explained(read: str, printed: str) -> float:
    """How well recognition explains reading ``printed`` as ``read``; 0 if it doesn't."""
    a, b = len(read), len(printed)
    i = 0
    while i < min(a, b) and read[i] == printed[i]:
        i += 1
    j = 0
    while j < min(a, b) - i and read[a - 1 - j] == printed[b - 1 - j]:
        j += 1
    table = _weights()
    # The common ends may have swallowed part of a group that was misread.
    for left in range(min(i, 1) + 1):
        for right in range(min(j, 1) + 1):
            pair = (read[i - left : a - j + right], printed[i - left : b - j + right])
            if pair in table:
                return table[pair] - 0.01 * (left + right)
    x, y = read[i : a - j], printed[i : b - j]
    if len(x) == 1 and x.isdigit() and y.isalpha() and len(y) <= 2:
        return 0.8
    if len(x) == len(y) and all(p == q or (p, q) in table for p, q in zip(x, y)):
        return 0.5
    return 0.0


_CJK_WORD = re.compile(f"[{CJK}]")


def enough(read: str, n: int, printed_n: int) -> bool:
    """Whether a word is so much more frequent than a form in ``n`` blocks that the form may be a misreading of it.

    Chance misreadings of one word into one form are a small share of it.  A
    form met often is more likely a word of its own, so the share that is
    allowed falls as the evidence grows, to one in a hundred; it doesn't
    depend on the size of the corpus.
    """
    times = TIMES_DIGIT if not read.isalpha() else TIMES
    return printed_n >= n * max(times, min(MOST_TIMES, times * n / STEADY))


def corrections(counts: DataFrame) -> DataFrame:
    """(word, fixes): for every word that recognition explains as a misreading of another, its likely originals.

    ``fixes`` is an array of (fix, weight, n), the best explained and most
    frequent first.  Every questioned word meets every vocabulary word whose
    length differs by at most the distance.  The vocabulary is cut into blocks
    by length and hash, each of which is a trie; only questions, blocked by
    hash, are sent to the tries of near lengths: a stated set against all
    words, of bounded size in every task, nothing left out.
    """
    rows = counts.where(~F.col("word").rlike(f"[{CJK}-]")).withColumn("_length", F.length("word"))
    odd = F.length(F.regexp_replace("word", r"\p{L}", ""))
    vocabulary = rows.where((F.col("n") >= LEAST_COUNT) & (F.col("_length") >= SHORTEST - DISTANCE) & ~F.col("word").rlike("[0-9(|!$]"))
    asked = rows.where((F.col("_length") >= SHORTEST) & (odd <= 2) & (F.col("_length") - odd >= 2))
    # One row for each length of a word: as many as the longest word has letters at most.
    sizes = {r["_length"]: r["n"] for r in vocabulary.groupBy("_length").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return counts.select("word", F.array().cast("array<struct<fix:string,weight:double,n:bigint>>").alias("fixes")).where("1 = 0")
    blocks_v = {k: -(-v // VOCABULARY_BLOCK) for k, v in sizes.items()}
    blocks_q = max(1, -(-asked.count() // QUESTIONED_BLOCK))
    tries = F.create_map(*[F.lit(x) for kv in blocks_v.items() for x in kv])
    hashed = F.xxhash64("word")
    v = vocabulary.select(
        "word", "n", F.col("_length").alias("lv"), F.pmod(hashed, F.element_at(tries, F.col("_length"))).cast("int").alias("pv"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks_q - 1))).alias("pq"), F.lit(False).alias("ask"),
    )
    near = F.filter(F.array(*[F.lit(k) for k in sorted(sizes)]), lambda x: F.abs(x - F.col("_length")) <= DISTANCE)
    q = asked.select("word", "n", F.explode(near).alias("lv"), F.pmod(hashed, F.lit(blocks_q)).cast("int").alias("pq"))
    q = q.select("word", "n", "lv", F.explode(F.sequence(F.lit(0), F.element_at(tries, F.col("lv")) - 1)).alias("pv"), "pq", F.lit(True).alias("ask"))

    def search(table: pa.Table) -> pa.Table:
        ask, word, n = (np.asarray(table[c].to_pandas()) for c in ("ask", "word", "n"))
        count = dict(zip(word[~ask], n[~ask].tolist()))
        most = max(count.values(), default=0)
        # A word that no word of this trie outnumbers can't be a misreading of one.
        names, times = [], []
        for w, m in zip(word[ask], n[ask].tolist()):
            if enough(w, m, most):
                names.append(w)
                times.append(m)
        out: list[tuple[str, str, float, int]] = []
        if names and count:
            trie = Trie(list(count))
            for i, j in trie.within(names, DISTANCE):
                read, printed = names[i], trie.words[j]
                if read != printed and enough(read, times[i], count[printed]) and (w := explained(read, printed)):
                    out.append((read, printed, w, count[printed]))
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.int64()))], ["word", "fix", "weight", "n"])

    found = v.unionByName(q.select(v.columns)).groupBy("lv", "pv", "pq").applyInArrow(search, "word string, fix string, weight double, n long")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), (-F.col("n")).alias("m"), "fix")))
    return found.groupBy("word").agg(F.transform(ranked, lambda x: F.struct(x["fix"].alias("fix"), (-x["w"]).alias("weight"), (-x["m"]).alias("n"))).alias("fixes"))


def choose(fixes: list[dict], present: set[str]) -> str:
    """The likeliest original of a word: one that occurs elsewhere in the text comes before a better explained, then a more frequent one."""
    return min(fixes, key=lambda f: (f["fix"] not in present, -f["weight"], -f["n"], f["fix"]))["fix"]


def printed_cjk(around: str, pairs: dict[str, int]) -> str | None:
    """The character printed, of an easily confused one between its neighbours that speak for a look-alike."""
    p, c, q = around
    for o in _OTHERS[c]:
        left, left_o = pairs.get(p + c, 0), pairs.get(p + o, 0)
        right, right_o = pairs.get(c + q, 0), pairs.get(o + q, 0)
        for_other = (right_o >= CJK_LEAST and right_o >= CJK_TIMES * right) or (left_o >= CJK_LEAST and left_o >= CJK_TIMES * left)
        for_this = (right >= CJK_LEAST and right >= CJK_TIMES * right_o) or (left >= CJK_LEAST and left >= CJK_TIMES * left_o)
        if for_other and not for_this:
            return o
    return None


def replace_cjk(text: str, printed: dict[str, str]) -> str:
    """``text`` with the characters whose `surroundings` are keys of ``printed`` replaced."""
    if not printed:
        return text
    letters = list(text)
    for m in _CONFUSED_CJK.finditer(text):
        around = f"{_neighbour(text, m.start(), -1) or ' '}{m.group()}{_neighbour(text, m.start(), 1) or ' '}"
        letters[m.start()] = printed.get(around, m.group())
    return "".join(letters)


def _neighbour(text: str, i: int, step: int) -> str:
    """The next CJK character on one side, over a line end; empty if there is none."""
    j = i + step
    while 0 <= j < len(text) and text[j] in "\r\n \t":
        j += step
    return text[j] if 0 <= j < len(text) and _CJK_WORD.match(text[j]) else ""
