"""One consistent form for texts that look the same.

Whole Arrow batches are copied into one array of code points.  Table gathers
replace every code point by its expansion (canonical decomposition, width
variants, drawn-alike letters, kinds of space and hyphen, nothing for what is
invisible), marks are put in canonical order and composed again, all by array
operations over the batch: no string is touched row by row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 0x110000

# Letters of other scripts that are drawn like a Latin letter (or another plain character).
DRAWN_ALIKE = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "Ѕ": "S", "ѕ": "s", "І": "I", "і": "i", "Ј": "J", "ј": "j",
    "Ү": "Y", "һ": "h", "Һ": "h", "ԁ": "d", "Ԛ": "Q", "ԛ": "q", "Ԝ": "W", "ԝ": "w", "ӏ": "l", "Ӏ": "I", "Ԍ": "G", "ѵ": "v", "Ѵ": "V",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "γ": "y", "υ": "u", "κ": "k", "β": "ß", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "ϱ": "p",
    # Armenian, Hebrew-free others, and letter-like signs
    "օ": "o", "Օ": "O", "ս": "u", "հ": "h", "ց": "g", "ո": "n", "Տ": "S", "Ꭺ": "A", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K",
    "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮃ": "W", "Ꮓ": "Z", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʼ": "’", "ʹ": "′",
    "K": "K", "Å": "Å", "Ω": "Ω", "µ": "μ", "∑": "Σ", "∏": "Π", "…": "...", "‥": "..", "․": ".", "℃": "°C", "ˋ": "`", "ꞌ": "'",
    "丶": "、", "ー": "一", "㇐": "一", "⼀": "一", "囗": "口",
}
# Kinds of hyphen; dashes are drawn longer and stay what they are.
HYPHENS = "‐‑﹣－⁃"
# Further characters without any look, beside those of the categories Cf and Cc.
UNSEEN = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
_JOINER = 0x200D
_PICTURE = ((0x2190, 0x2BFF), (0x1F000, 0x1FAFF), (0xFE0F, 0xFE0F))


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, pool, combining class, composable pairs, composed), built from the Unicode data of Python."""
    expansion: dict[int, str] = {}
    classes = np.zeros(LIMIT, dtype=np.uint8)
    pairs: dict[int, int] = {}
    for o in range(0x80, 0x30000):
        if 0xD800 <= o < 0xE000:
            continue
        c = chr(o)
        classes[o] = unicodedata.combining(c)
        kind, written = unicodedata.category(c), unicodedata.decomposition(c)
        if kind == "Zs":
            expansion[o] = " "
        elif kind == "Cf" or (kind == "Cc" and o != 0x85):
            expansion[o] = ""
        elif written:
            tag, _, rest = written.partition(">") if written[0] == "<" else ("", "", written)
            if not tag:
                expansion[o] = unicodedata.normalize("NFD", c)
                if " " in rest and (d := unicodedata.normalize("NFC", c)) == c:
                    first, second = (int(x, 16) for x in rest.split())
                    pairs[first << 21 | second] = o
            elif tag in ("<wide", "<narrow") or (tag == "<compat" and (0xFB00 <= o <= 0xFB04 or o == 0xFB06 or 0x2160 <= o <= 0x217F or 0x2E80 <= o <= 0x2FD5 or 0x01C4 <= o <= 0x01F3)):
                expansion[o] = unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in rest.split()))
        elif 0xAC00 <= o <= 0xD7A3:
            expansion[o] = unicodedata.normalize("NFD", c)
            lead, vowel, tail = (o - 0xAC00) // 588, (o - 0xAC00) % 588 // 28, (o - 0xAC00) % 28
            if tail:
                pairs[(o - tail) << 21 | (0x11A7 + tail)] = o
            else:
                pairs[(0x1100 + lead) << 21 | (0x1161 + vowel)] = o
    for o in [*range(0, 9), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F, *UNSEEN, *range(0xE0000, 0xE0080)]:
        expansion[o] = ""
    for c in HYPHENS:
        expansion[ord(c)] = "-"
    alike = {ord(k): v for k, v in DRAWN_ALIKE.items()}
    for o, v in alike.items():
        expansion[o] = v
    # A letter under an accent is folded like the bare one: decompose first, then look alike.
    expansion = {o: "".join(alike.get(ord(x), x) if x != chr(o) or o in alike else x for x in v) for o, v in expansion.items()}
    start, length = np.arange(LIMIT, dtype=np.int32), np.ones(LIMIT, dtype=np.uint8)
    extra: list[int] = []
    for o, v in expansion.items():
        start[o], length[o] = LIMIT + len(extra), len(v)
        extra.extend(map(ord, v))
    pool = np.concatenate([np.arange(LIMIT, dtype=np.uint32), np.array(extra, dtype=np.uint32)])
    keys = np.array(sorted(pairs), dtype=np.int64)
    return start, length, pool, classes, keys, np.array([pairs[k] for k in keys.tolist()], dtype=np.uint32)


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all rows, offsets by row); null rows are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    raw = memoryview(data)[int(offsets[0]) : int(offsets[-1])]
    points = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), dtype=np.uint32)
    return points, np.concatenate([[0], np.cumsum(np.asarray(pc.utf8_length(texts), dtype=np.int64))])


def to_arrow(points: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The inverse of ``code_points``."""
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(size)])[offsets]
    mask = None
    if valid is not None and not valid.all():
        mask = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [mask, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data)])


def _pictures(points: np.ndarray) -> np.ndarray:
    hit = np.zeros(len(points), dtype=bool)
    for low, high in _PICTURE:
        hit |= (points >= low) & (points <= high)
    return hit


def fold(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The common form of all rows at once."""
    start, length, pool, classes, keys, composed = tables()
    n = len(points)
    row_start = np.zeros(n + 1, dtype=bool)
    row_start[offsets[:-1]] = True
    sizes = length[points].astype(np.int64)
    # A joiner between two pictures makes one picture of them: it is seen.
    joiner = np.nonzero(points == _JOINER)[0]
    if len(joiner):
        inner = joiner[(joiner > 0) & (joiner < n - 1)]
        seen = inner[_pictures(points[inner - 1]) & _pictures(points[inner + 1]) & ~row_start[inner] & ~row_start[inner + 1]]
        sizes[seen] = 1
    else:
        seen = joiner
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if n else 0
    # Expansion offsets: entry j of the expansion of i stands at ends[i] - sizes[i] + j.
    owner = np.repeat(np.arange(n), sizes)
    out = pool[start[points][owner] + (np.arange(total) - (ends - sizes)[owner])]
    if len(seen):
        out[(ends - sizes)[seen]] = _JOINER
    bounds = np.concatenate([[0], ends])[offsets] if n else np.zeros_like(offsets)
    return _compose(*_ordered(out, bounds, classes), classes, keys, composed)


def _ordered(points: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of marks in order of their combining class, each run within its row."""
    cc = classes[points]
    marks = np.nonzero(cc)[0]
    if len(marks) > 1:
        row = np.searchsorted(bounds, marks, side="right")
        fresh = np.concatenate([[True], (np.diff(marks) > 1) | (np.diff(row) > 0)])
        run = np.cumsum(fresh)
        points = points.copy()
        points[marks] = points[marks][np.lexsort((np.arange(len(marks)), cc[marks], run))]
    return points, bounds


def _compose(points, bounds, classes, keys, composed):
    """Compose base and mark pairs until none is left; each pass handles the first mark of every base."""
    while len(points) > 1:
        pair = points[:-1].astype(np.int64) << 21 | points[1:]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        hit = keys[at] == pair
        cuts = bounds[(bounds > 0) & (bounds < len(points))]
        hit[cuts - 1] = False
        # A pair may not begin where another ends.
        where = np.nonzero(hit)[0]
        if len(where) > 1:
            close = np.diff(where) == 1
            if close.any():
                run = np.cumsum(np.concatenate([[True], ~close]))
                first = np.concatenate([[0], np.nonzero(~close)[0] + 1])
                where = where[(np.arange(len(where)) - first[run - 1]) % 2 == 0]
        if not len(where):
            break
        points = points.copy()
        points[where] = composed[at[where]]
        keep = np.ones(len(points), dtype=bool)
        keep[where + 1] = False
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        points = points[keep]
    return points, bounds


def fold_array(texts: pa.Array) -> pa.Array:
    """The common form of an Arrow text array; null stays null."""
    valid = np.asarray(texts.is_valid())
    return to_arrow(*fold(*code_points(texts)), valid)


def with_form(df: DataFrame, text: str, form: str = "form") -> DataFrame:
    """Add the common form of ``text``; null stays null, an empty or invisible text becomes empty."""
    others = [c for c in df.columns if c != form]
    schema = df.select(*others).schema.add(form, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = fold_array(batch.column(others.index(text))).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, done], [*others, form])

    return df.select(*others).mapInArrow(run, schema)


def same_look_pairs(records: DataFrame, field: str, key: str, text: str) -> DataFrame:
    """(field, id_a, id_b): pairs of records of the same look whose texts are not equal; smaller id first.

    Only two hashes of 128 bits travel per record, not the texts.  Forms with
    a single text drop out in a grouped aggregate (with its map-side half), so
    the self-join on the form sees only records that have a partner; a large
    form is split by adaptive execution.  Null texts have no look; repeated
    rows count once.
    """
    rows = records.select(F.col(key).cast("string").alias("_id"), F.col(text).alias("_text")).where("_text IS NOT NULL AND _id IS NOT NULL")
    formed = with_form(rows, "_text", "_form")
    two = lambda c: [F.xxhash64(c), F.xxhash64(F.lit(17), c)]
    (f1, f2), (t1, t2) = two(F.col("_form")), two(F.col("_text"))
    hashed = formed.select("_id", f1.alias("_f1"), f2.alias("_f2"), t1.alias("_t1"), t2.alias("_t2"))
    mixed = (
        hashed.groupBy("_f1", "_f2")
        .agg(F.min("_t1").alias("_a1"), F.max("_t1").alias("_b1"), F.min("_t2").alias("_a2"), F.max("_t2").alias("_b2"))
        .where("_a1 <> _b1 OR _a2 <> _b2")
        .select("_f1", "_f2")
    )
    alive = hashed.join(mixed, ["_f1", "_f2"], "left_semi").distinct()
    a, b = alive.alias("a"), alive.alias("b")
    joined = a.join(
        b,
        (F.col("a._f1") == F.col("b._f1")) & (F.col("a._f2") == F.col("b._f2")) & (F.col("a._id") < F.col("b._id"))
        & ((F.col("a._t1") != F.col("b._t1")) | (F.col("a._t2") != F.col("b._t2"))),
    )
    return joined.select(F.lit(field).alias("field"), F.col("a._id").alias("id_a"), F.col("b._id").alias("id_b"))
