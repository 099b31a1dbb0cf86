"""Where terms stand in texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as S

#: Spans of one text at most: what a reader is shown.
MOST = 32


def spans(text: str, terms: list[str], most: int = MOST) -> list[tuple[int, int]]:
    """(start, end) of occurrences, longer terms first; none begins inside one that was taken before."""
    taken, found = bytearray(len(text)), []
    for term in sorted({t for t in terms if t}, key=lambda t: (-len(t), t)):
        at = text.find(term)
        while at >= 0 and len(found) < most:
            if not taken[at]:
                found.append((at, at + len(term)))
                taken[at : at + len(term)] = b"\1" * len(term)
            at = text.find(term, at + 1)
    return sorted(found)


def with_spans(df: DataFrame, text: str, terms: str, out: str, most: int = MOST) -> DataFrame:
    """Add ``out``: the `spans` of the ``terms`` (an array) in the text, in order; none for null."""
    others = [c for c in df.columns if c != out]
    at, by = others.index(text), others.index(terms)
    span = S.StructType([S.StructField("start", S.IntegerType()), S.StructField("end", S.IntegerType())])
    schema = S.StructType([*df.select(*others).schema.fields, S.StructField(out, S.ArrayType(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows = [[{"start": a, "end": z} for a, z in spans(t or "", w or [], most)] for t, w in zip(batch.column(at).to_pylist(), batch.column(by).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*others, out])

    return df.select(*others).mapInArrow(run, schema)
