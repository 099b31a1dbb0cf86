"""Filling fixed-capacity containers with items of varying length.

Only the histogram of lengths, at most one entry per token of capacity,
reaches the driver.  Shortest-pack-first places the lengths longest first, each
into the kind of pack that is filled least, and counts how often each packing
pattern occurs.  Items are numbered within their length, and the patterns hand
out containers by that number.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.positions import cumulative
from lectern.session import cut

CAPACITY = 2_048


Pattern = tuple[tuple[int, int], ...]


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, Pattern]]:
    """(how often, ((length, times), ...)) of every packing pattern.

    Lengths from the longest to the shortest; each goes to the packs with the
    most free space, a whole batch of equal packs at a time.  Where no pack can
    take it, new ones are opened, each filled with the length as often as it
    fits: opening one at a time would do the same.
    """
    spaces: dict[int, list[tuple[int, Pattern]]] = defaultdict(list)
    widest = 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError("lengths must lie between 1 and the capacity")
        left = histogram[length]
        while left:
            while widest and not spaces.get(widest):
                widest -= 1
            if widest >= length:
                count, pattern = spaces[widest].pop()
                used = min(count, left)
                if count > used:
                    spaces[widest].append((count - used, pattern))
                (last, times), head = pattern[-1], pattern[:-1]
                grown = (*head, (last, times + 1)) if last == length else (*pattern, (length, 1))
                spaces[widest - length].append((used, grown))
                left -= used
            else:
                fits = capacity // length
                packs, rest = divmod(left, fits)
                for count, times in ((packs, fits), (1, rest)):
                    if count and times:
                        spaces[capacity - times * length].append((count, ((length, times),)))
                        widest = max(widest, capacity - times * length)
                left = 0
    return [entry for space in sorted(spaces) for entry in spaces[space]]


def slots(patterns: list[tuple[int, Pattern]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: (first item number of every run, container number minus item number within it)."""
    starts: dict[int, list[int]] = defaultdict(list)
    shift: dict[int, list[int]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    container = 0
    for count, pattern in patterns:
        for length, times in pattern:
            for _ in range(times):
                starts[length].append(taken[length])
                shift[length].append(container - taken[length])
                taken[length] += count
        container += count
    return {k: (np.array(starts[k], dtype=np.int64), np.array(shift[k], dtype=np.int64)) for k in starts}


def fill(items: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece_no, start, size, container) with no container over ``capacity``.

    An item over the capacity is cut into full pieces and a rest; all others
    stay whole in piece 0.  Null and zero sizes take no room: their container
    is null.  Keys must be unique and not null.  Containers are numbered from
    0; the result depends on nothing but the keys and sizes.
    """
    sized = items.select(F.col(key), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_total"))
    pieces = sized.select(key, F.explode(F.expr(f"sequence(0L, greatest(0L, (_total - 1) div {capacity}L))")).alias("piece_no"), "_total")
    pieces = pieces.select(
        key, F.col("piece_no").cast("int").alias("piece_no"), (F.col("piece_no") * capacity).alias("start"),
        F.least(F.lit(capacity), F.col("_total") - F.col("piece_no") * capacity).cast("int").alias("size"),
    )
    pieces = cut(pieces)
    # At most `capacity` rows, whatever the corpus.
    histogram = {r["size"]: r["n"] for r in pieces.where("size > 0").groupBy("size").agg(F.count("*").alias("n")).collect()}
    table = pieces.sparkSession.sparkContext.broadcast(slots(shortest_pack_first(histogram, capacity)))
    numbered = cumulative(pieces.where("size > 0").withColumn("_one", F.lit(1)), ["size"], [key, "piece_no"], "_one")
    numbered = numbered.select(key, "piece_no", "start", "size", "below")
    schema = numbered.drop("below").schema.add("container", "long")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = table.value
        for batch in batches:
            size_, number = (np.asarray(batch.column(i)) for i in (3, 4))
            container = np.empty(len(size_), dtype=np.int64)
            for length in np.unique(size_).tolist():
                at = size_ == length
                starts, shift = runs[length]
                n = number[at]
                container[at] = n + shift[np.searchsorted(starts, n, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(container)], schema.names)

    placed = numbered.mapInArrow(assign, schema)
    empty = pieces.where("size = 0").select(key, "piece_no", "start", "size", F.lit(None).cast("long").alias("container"))
    return placed.unionByName(empty)
