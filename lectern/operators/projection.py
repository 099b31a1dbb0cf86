"""Texts as overlapping windows of sentences with their fingerprints: what reuse is looked up in."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lectern.functions import text as T
from lectern.operators import reuse

#: Sentences of a window, and those it shares with the next one.
SENTENCES, OVERLAP = 4, 1
#: Characters that are neither blank nor punctuation, below which nothing is looked up.
LEAST_EFFECTIVE = 12
# Fixed value: a sentence with what follows it: stops of either script, or a line end.
_SPACE = r"[ \t\n\r\f\v]"
SENTENCE = rf"[^.!?。！？；\n]*(?:[.!?]+(?:{_SPACE}+|\Z)|[。！？；]+{_SPACE}*|\n{_SPACE}*|[.!?]+)|[^.!?。！？；\n]+"


def spans(text: str) -> np.ndarray:
    """Rows (start, end) of the sentences; they cover the text."""
    return np.array([m.span() for m in re.finditer(SENTENCE, text) if m.end() > m.start()], dtype=np.int64).reshape(-1, 2)


def window_starts(n: int, sentences: int = SENTENCES, overlap: int = OVERLAP) -> range:
    """First sentences of the windows over n sentences; none begins where the one before has covered the end."""
    if overlap >= sentences:
        raise ValueError("windows must overlap by fewer sentences than they hold")
    return range(0, max(1, n - overlap) if n else 0, sentences - overlap)


def sentence_windows(df: DataFrame, text: str, sentences: int = SENTENCES, overlap: int = OVERLAP) -> DataFrame:
    """The rows of ``df`` once for each window: (..., chunk_index, char_start, char_end, sentence_count, chunk) in place of the text.

    Offsets are those of the text as stored: chunk = text[char_start:char_end].
    Null and empty texts have no window.
    """
    window_starts(1, sentences, overlap)
    others = [c for c in df.columns if c != text]
    added = [("chunk_index", S.IntegerType()), ("char_start", S.IntegerType()), ("char_end", S.IntegerType()), ("sentence_count", S.IntegerType()), ("chunk", S.StringType())]
    schema = S.StructType([*df.select(*others).schema.fields, *[S.StructField(n, t) for n, t in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(len(others)).to_pylist()):
                found = spans(t or "")
                for k, a in enumerate(window_starts(len(found), sentences, overlap)):
                    z = min(a + sentences, len(found))
                    low, high = int(found[a, 0]), int(found[z - 1, 1])
                    at.append(i)
                    rows.append((k, low, high, z - a, t[low:high]))
            take = pa.array(at, pa.int64())
            kinds = (*[pa.int32()] * 4, pa.string())
            columns = [*(c.take(take) for c in batch.columns[: len(others)]), *(pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays(columns, [*others, *(n for n, _ in added)])

    return df.select(*others, text).mapInArrow(run, schema)


def with_chunk_fingerprints(chunks: DataFrame, kernel: str = "blake2b", out: str = "fingerprints") -> DataFrame:
    """Add the fingerprints of ``chunk``; of chunks with ideographs those without blanks and punctuation as well, so that either kind of query finds them."""
    both = F.when(F.col("chunk").rlike(T.DOMINANT), F.regexp_replace(F.lower("chunk"), r"[\s\p{P}]", ""))
    first = reuse.with_fingerprints(chunks.withColumn("_solid", both), "chunk", "_first", kernel)
    second = reuse.with_fingerprints(first, "_solid", "_second", kernel)
    return second.withColumn(out, F.array_sort(F.array_union("_first", "_second"))).drop("_solid", "_first", "_second")


def policy(text: Column, declared: Column) -> Column:
    """How a query is matched: (profile, effective, seed, passage, short_exact).

    A declared language decides; ``auto`` looks at the share of ideographs.
    """
    base = F.lower(F.substring_index(F.coalesce(declared, F.lit("auto")), "-", 1))
    chinese = (base == "zh") | ((base == "auto") & T.cjk_dominant(text))
    effective = F.coalesce(T.effective_characters(text), F.lit(0))
    return F.struct(
        F.when(chinese, "zh").otherwise("generic").alias("profile"),
        effective.alias("effective"),
        F.when(chinese, 12).otherwise(30).alias("seed"),
        F.when(chinese, 20).otherwise(50).alias("passage"),
        (chinese & (effective >= LEAST_EFFECTIVE) & (effective < 20)).alias("short_exact"),
    )


def detect_language(text: Column) -> Column:
    """zh, ja, ru or the Latin-script language most of whose commonest words a text holds; en where nothing speaks for another."""
    words = F.array_distinct(F.split(F.lower(F.substring(text, 1, 4000)), T.NOT_WORD))
    scores = [F.struct(F.size(F.array_intersect(words, F.array(*map(F.lit, w.split())))).alias("n"), F.lit(-i).alias("at"), F.lit(k).alias("lang")) for i, (k, w) in enumerate(COMMON_WORDS.items())]
    best = F.array_max(F.array(*scores))["lang"]
    kana, cyrillic = T.matches(text, "[぀-ヿ]"), T.matches(text, r"\p{IsCyrillic}")
    han = T.matches(text, T.IDEOGRAPH)
    solid = F.greatest(F.length(F.regexp_replace(text, r"[\s\p{P}\p{N}]", "")), F.lit(1))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "en").when(kana / solid > 0.1, "ja").when(han / solid > 0.3, "zh").when(cyrillic / solid > 0.3, "ru").otherwise(best)


# The commonest words of languages in Latin script.
COMMON_WORDS = {
    "en": "the of and to in is that it for was with as on be by this are or from not",
    "de": "der die und das den von ist mit sich des auf für nicht im ein eine dem als auch es",
    "fr": "le la les de des et un une est en que qui dans pour par sur pas plus ce au",
    "es": "el la los las de y en que un una es por con para del se no al su lo",
    "pt": "o a os as de e em que um uma é por com para do da não se no na",
}
