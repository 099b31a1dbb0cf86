"""The most similar vectors of every vector, by additive quantisation.

A vector is approximated by a sum of codewords, one from each of several
full-dimensional codebooks.  The first two codebooks name the list a vector is
stored in: the pair whose sum is nearest, of all pairs.  The later ones are
trained on the residuals the ones before leave; their codes are found by beam
search.  A query visits the lists nearest to it, scores what lies there from
lookup tables (one inner product per codeword instead of one per vector) and
the stored norms of the sums, and the best are reranked by the exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import written

DIM = 64
#: Vectors the codebooks are fitted on, at most: a bounded sample by hash of the direction; every vector is indexed.
SAMPLE = 32_768
#: Later codebooks, their size, and the width of the beam.
STAGES, CODEWORDS, BEAM = 3, 256, 4
#: Items, and queries, of one row of lists (those of one first codeword) that meet in one task; more are split.
SEGMENT, QUERIES = 131_072, 262_144
#: Best scored items reranked exactly, per query and list: so many, or a share of the list where every neighbour counts.
RERANKED, RERANKED_WIDE = 16, 0.25
#: How far below the least cosine asked for a score from the tables may lie, to be reranked still.
SLACK = 0.4
ROUNDS = 6
#: Lists visited for close neighbours as a multiple of the root of all lists (what it takes grows about so), and the share
#: of lists visited where every neighbour counts: directions without a close neighbour have their nearest anywhere.
CLOSE, CLOSE_LEAST, WIDE = 1.5, 16, 0.6


@dataclass
class Codebooks:
    """``first`` and ``second`` (each codewords x dim) and ``later`` (stages x codewords x dim)."""

    first: np.ndarray
    second: np.ndarray
    later: np.ndarray

    @property
    def lists(self) -> int:
        return len(self.first) * len(self.second)

    def centre(self, lists: np.ndarray) -> np.ndarray:
        """The sums of the two codewords that name lists."""
        return self.first[lists // len(self.second)] + self.second[lists % len(self.second)]

    def nearness(self, x: np.ndarray) -> np.ndarray:
        """Half the squared distance to every list's centre, negated, but for a constant of each row.

        One inner product for each codeword, not for each of their pairs.
        """
        one = x @ self.first.T - 0.5 * (self.first**2).sum(1)
        two = x @ self.second.T - 0.5 * (self.second**2).sum(1)
        both = self.first @ self.second.T
        return (one[:, :, None] + (two[:, None, :] - both[None])).reshape(len(x), -1)

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest lists of each row, its own first."""
        count = min(count, self.lists)
        parts = []
        for i in range(0, len(x), step := max(1, 8_000_000 // self.lists)):
            near = self.nearness(x[i : i + step])
            best = np.argpartition(-near, count - 1, axis=1)[:, :count]
            parts.append(np.take_along_axis(best, np.argsort(-np.take_along_axis(near, best, 1), axis=1, kind="stable"), 1))
        return np.concatenate(parts) if parts else np.zeros((0, count), dtype=np.int64)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(later codes, norm of the sum of all codewords) of rows that are stored in ``lists``.

        A beam keeps the best partial sums over the later codebooks.  The
        distance to the next sum needs only inner products: of the vector with
        the codewords, and of the codewords with each other.
        """
        n, stages, k = len(x), *self.later.shape[:2]
        flat = self.later.reshape(stages * k, -1)
        rest = x - self.centre(lists)
        dots = (rest @ flat.T).reshape(n, stages, k)
        squares = (self.later**2).sum(2)
        codes = np.zeros((n, 1, 0), dtype=np.int64)
        cost = np.zeros((n, 1), dtype=np.float32)
        overlap = np.zeros((n, 1, stages, k), dtype=np.float32)  # sum so far with every later codeword
        gram = (flat @ flat.T).reshape(stages, k, stages, k)
        for s in range(stages):
            step = cost[:, :, None] + squares[s] - 2 * dots[:, None, s] + 2 * overlap[:, :, s]
            wide = step.reshape(n, -1)
            keep = min(BEAM, wide.shape[1])
            best = np.argpartition(wide, keep - 1, axis=1)[:, :keep]
            rows = np.arange(n)[:, None]
            parent, code = best // k, best % k
            cost = wide[rows, best]
            codes = np.concatenate([codes[rows, parent], code[:, :, None]], axis=2)
            if s + 1 < stages:
                overlap = overlap[rows, parent] + gram[s][code]
        codes = codes[np.arange(n), cost.argmin(1)]
        total = self.centre(lists) + sum(self.later[s][codes[:, s]] for s in range(stages))
        return codes.astype(np.uint8), np.linalg.norm(total, axis=1).astype(np.float32)


def nearest(x: np.ndarray, centres: np.ndarray, block: int = 4_096) -> np.ndarray:
    half = 0.5 * (centres**2).sum(1)
    return np.concatenate([(x[i : i + block] @ centres.T - half).argmax(1) for i in range(0, len(x), block)]) if len(x) else np.zeros(0, dtype=np.int64)


def _averages(x: np.ndarray, of: np.ndarray, centres: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Means of the rows of each codeword; one without rows is given a row."""
    order = np.argsort(of, kind="stable")
    filled, begin = np.unique(of[order], return_index=True)
    out = centres.copy()
    out[filled] = np.add.reduceat(x[order], begin, axis=0) / np.diff(np.append(begin, len(x)))[:, None]
    empty = np.setdiff1d(np.arange(len(centres)), filled)
    out[empty] = x[rng.choice(len(x), len(empty))]
    return out.astype(np.float32)


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(ROUNDS):
        centres = _averages(x, nearest(x, centres), centres, rng)
    return centres.astype(np.float32)


def fit(sample: np.ndarray, each: int, seed: int = 7) -> Codebooks:
    """Codebooks from a sample of unit vectors: two of ``each`` codewords, fitted together, then those of residuals."""
    rng = np.random.default_rng(seed)
    first = _means(sample, each, rng)
    second = _means(sample - first[nearest(sample, first)], each, rng)
    book = Codebooks(first, second, np.zeros((0, CODEWORDS, sample.shape[1]), dtype=np.float32))
    for _ in range(ROUNDS):
        # Each is the mean of what the other leaves, under the nearest of all pairs.
        own = book.probes(sample, 1)[:, 0]
        a, b = own // each, own % each
        book.first = _averages(sample - book.second[b], a, book.first, rng)
        book.second = _averages(sample - book.first[a], b, book.second, rng)
    rest = sample - book.centre(book.probes(sample, 1)[:, 0])
    later = []
    for _ in range(STAGES):
        words = _means(rest, CODEWORDS, rng)
        rest = rest - words[nearest(rest, words)]
        later.append(words)
    book.later = np.stack(later)
    return book


def usable(batch: pa.RecordBatch, column: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors as float32) of the usable vectors: ``dim`` finite values, not all zero."""
    lists = batch.column(column).cast(pa.large_list(pa.float64()))
    values = np.asarray(lists.values.fill_null(np.nan), dtype=np.float64)
    offsets = np.frombuffer(lists.buffers()[1], dtype=np.int64)[lists.offset : lists.offset + len(lists) + 1]
    rows = np.nonzero(np.asarray(lists.is_valid()) & (np.diff(offsets) == dim))[0]
    x = values[offsets[rows][:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim))
    finite = np.isfinite(x).all(1)
    rows, x = rows[finite], x[finite]
    # Scaled by the largest value first, so that tiny and huge vectors have a norm too.
    largest = np.abs(x).max(1, initial=0.0)
    rows, x = rows[largest > 0], x[largest > 0] / largest[largest > 0][:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    return rows, x.astype(np.float32)


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of an array as fixed-size binary, without copying row by row."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    """The inverse of ``_binary``; the column has no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), dtype=dtype)
    if pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=dtype, count=(offsets[-1] - offsets[0]) // np.dtype(dtype).itemsize, offset=int(offsets[0])).reshape(len(column), width)


def directions(vectors: DataFrame, key: str, dense: str, dim: int) -> DataFrame:
    """(d1, d2, id, vec): usable vectors as unit vectors, with a 128-bit hash of the direction.

    Vectors whose directions agree to four digits in every value share the
    hash: copies, also of another length.
    """
    rng = np.random.default_rng(11)
    odd = rng.integers(1, 1 << 62, size=(dim, 2), dtype=np.int64) * 2 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = usable(batch, 1, dim)
            grid = np.rint(x.astype(np.float64) * 1e4).astype(np.int64)
            with np.errstate(over="ignore"):
                h1, h2 = (grid * odd[:, 0]).sum(1), (grid * odd[:, 1]).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), batch.column(0).take(pa.array(rows)).cast(pa.string()), _binary(_fine(x))], ["d1", "d2", "id", "vec"])

    rows = vectors.select(F.col(key).cast("string").alias("id"), F.col(dense).alias("dense")).where("id IS NOT NULL AND dense IS NOT NULL")
    return rows.mapInArrow(run, "d1 long, d2 long, id string, vec binary")


def _fine(x: np.ndarray) -> np.ndarray:
    """Unit vectors in three bytes a value: the error of a cosine stays below 1e-6."""
    scaled = np.rint(x.astype(np.float64) * ((1 << 23) - 1)).astype("<i4")
    return scaled.view(np.uint8).reshape(len(x), x.shape[1], 4)[:, :, :3].reshape(len(x), 3 * x.shape[1])


def _unfine(raw: np.ndarray, dim: int) -> np.ndarray:
    """The inverse of ``_fine``."""
    wide = np.zeros((len(raw), dim, 4), dtype=np.uint8)
    wide[:, :, 1:] = raw.reshape(len(raw), dim, 3)
    return (wide.reshape(len(raw), 4 * dim).view("<i4") / np.float64(((1 << 23) - 1) * 256)).astype(np.float32)


def _classes(rows: DataFrame, count: int, *vec: str) -> DataFrame:
    """(d1, d2, ids) with the ``count`` smallest ids of every direction.

    A hot direction is cut to them before the shuffle: the rank filter becomes
    a window group limit on the map side.
    """
    order = Window.partitionBy("d1", "d2").orderBy("id")
    heads = rows.select("d1", "d2", "id", *vec).withColumn("_at", F.dense_rank().over(order)).where(F.col("_at") <= count)
    return heads.groupBy("d1", "d2").agg(F.array_sort(F.collect_set("id")).alias("ids"), *[F.min_by(v, "id").alias(v) for v in vec])


def codewords(n: int) -> int:
    """Size of each of the two codebooks that name lists, for n directions: lists are about the root of n, and grow as it does."""
    return int(max(2, 2 ** round(np.log2(max(1.0, n**0.5)) / 2)))


@dataclass
class Index:
    """Codebooks, how many lists a query visits, and in how many parts the items and the queries of each row of lists are cut."""

    book: Codebooks
    visited: int
    sections: np.ndarray
    blocks: np.ndarray


def train(classes: DataFrame, n: int, dim: int, wide: float | None = None) -> Index:
    """An index for n directions, from a bounded sample; ``wide`` is a share of all lists to be visited."""
    each = codewords(n)
    share = min(1.0, SAMPLE / max(1, n))
    picked = classes.where(F.pmod(F.xxhash64("d1"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("d1", "d2", "vec").toArrow()
    sample = _unfine(_matrix(picked["vec"], np.uint8, 3 * dim), dim)[np.lexsort((np.asarray(picked["d2"]), np.asarray(picked["d1"])))]
    if not len(sample):
        sample = np.eye(1, dim, dtype=np.float32)
    book = fit(sample, min(each, len(sample)))
    visited = min(book.lists, max(CLOSE_LEAST, round(wide * book.lists if wide else CLOSE * book.lists**0.5)))
    scale = n / len(sample)
    stored = np.bincount(book.probes(sample, 1)[:, 0] // len(book.second), minlength=len(book.first)) * scale
    asking = np.bincount(np.concatenate([np.unique(p) for p in book.probes(sample, visited) // len(book.second)]), minlength=len(book.first)) * scale
    return Index(book, visited, np.maximum(1, np.ceil(stored / SEGMENT)).astype(np.int64), np.maximum(1, np.ceil(asking / QUERIES)).astype(np.int64))


def neighbours(vectors: DataFrame, key: str, dense: str, k: int = 5, dim: int = DIM, least: float | None = None, wide: float | None = None, one_in: int = 1) -> DataFrame:
    """(id, neighbour, cosine, place): the ``k`` most similar other vectors of every usable one.

    Similar is by direction, whatever the length.  Ties are ordered by id.
    ``least`` drops neighbours of a lower cosine; ``wide`` visits that share of
    the lists instead of the few where close neighbours lie; ``one_in`` takes
    as queries only the ids whose hash is divisible by it (all rows are
    searched).  Vectors that are null, of another length than ``dim``, all zero
    or not finite take no part; repeated rows count once; a lone vector has no
    neighbour.

    Copies of a direction are one item of the index, with their k + 1 smallest
    ids: that many are enough for the k nearest of anyone, so a direction that
    holds a third of all rows costs no more than another.
    """
    spark = vectors.sparkSession
    rows = written(directions(vectors, key, dense, dim))
    classes = written(_classes(rows, k + 1, "vec"))
    n = classes.count()
    index = spark.sparkContext.broadcast(train(classes, n, dim, wide))
    is_query = lambda c: F.pmod(F.xxhash64(c), F.lit(one_in)) == 0
    items = classes.select(
        "d1", "d2", "vec",
        # A class of more than k copies has its neighbours in itself.
        ((F.size("ids") <= k) & F.exists("ids", is_query)).alias("asks"),
        F.pmod(F.xxhash64("d2"), F.lit(1 << 20)).cast("int").alias("part"),
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, sections, blocks = index.value.book, index.value.sections, index.value.blocks
        width = len(book.second)
        for batch in batches:
            fine = _matrix(batch.column(2), np.uint8, 3 * dim)
            if not len(fine):
                continue
            x = _unfine(fine, dim)
            asking, part = np.nonzero(np.asarray(batch.column(3)))[0], np.asarray(batch.column(4))
            own = book.probes(x, 1)[:, 0]
            codes, norms = book.encode(x, own)
            a = own // width
            # An item is stored with its codes in its section of its row of lists, for every block of queries.
            place, row = [], []
            for t in range(int(blocks[a].max())):
                reach = np.nonzero(blocks[a] > t)[0]
                place.append(a[reach] << 40 | (part[reach] % sections[a[reach]]) << 20 | t)
                row.append(reach)
            stored = np.concatenate(row)
            # A query is sent once to each section of a row of lists, with the lists it visits there.
            seen = np.zeros((len(asking), book.lists), dtype=bool)
            seen[np.arange(len(asking))[:, None], book.probes(x[asking], index.value.visited)] = True
            seen = seen.reshape(len(asking), len(book.first), width)
            masks = [np.zeros((0, -(-width // 8)), dtype=np.uint8)]
            for s in range(int(sections.max())):
                r, b = np.nonzero(seen.any(2) & (sections > s)[None])
                place.append(b << 40 | s << 20 | part[asking[r]] // 7 % blocks[b])
                row.append(asking[r])
                masks.append(np.packbits(seen[r, b], axis=1))
            r, m = np.concatenate(row), len(stored)
            mask = pa.concat_arrays([pa.nulls(m, pa.binary()), _binary(np.concatenate(masks))])
            code = pa.concat_arrays([_binary(np.concatenate([(own[stored] % width).astype("<u2").view(np.uint8).reshape(-1, 2), codes[stored]], axis=1)), pa.nulls(len(r) - m, pa.binary())])
            norm = pa.array(np.concatenate([norms[stored], np.zeros(len(r) - m, dtype=np.float32)]), mask=np.arange(len(r)) >= m)
            d1, d2 = batch.column(0).take(pa.array(r)), batch.column(1).take(pa.array(r))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(place)), d1, d2, _binary(fine[r]), code, norm, mask], ["place", "d1", "d2", "vec", "codes", "norm", "mask"])

    sent = items.mapInArrow(assign, "place long, d1 long, d2 long, vec binary, codes binary, norm float, mask binary")

    def search(table: pa.Table) -> pa.Table:
        return _search(table, index.value.book, k, dim, least, RERANKED_WIDE if wide else 0.0)

    close = sent.groupBy("place").applyInArrow(search, "d1 long, d2 long, o1 long, o2 long, cosine double")
    best = Window.partitionBy("d1", "d2").orderBy(F.desc("cosine"), "o1", "o2")
    # At most (k + 1) candidates from each section of a row of lists visited.
    near = close.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= k).drop("_at")
    names = classes.select("d1", "d2", "ids")
    others = near.join(names.select(F.col("d1").alias("o1"), F.col("d2").alias("o2"), F.col("ids").alias("_others")), ["o1", "o2"])
    named = others.join(names, ["d1", "d2"])
    apart = named.select(F.explode("ids").alias("id"), "cosine", "_others").select("id", F.explode("_others").alias("neighbour"), "cosine")
    several = names.where(F.size("ids") > 1).select("d1", "d2", F.col("ids").alias("_heads"))
    copies = rows.select("d1", "d2", "id").distinct().join(several, ["d1", "d2"])
    together = copies.select("id", F.explode("_heads").alias("neighbour"), F.lit(1.0).alias("cosine")).where("id <> neighbour")
    pairs = apart.unionByName(together).where(is_query("id"))
    ranked = pairs.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")))
    return ranked.where(F.col("place") <= k)


def similar_pairs(vectors: DataFrame, key: str, dense: str, least: float, k: int = 5, dim: int = DIM) -> DataFrame:
    """(chunk_a, chunk_b): pairs of a cosine of at least ``least``, one among the ``k`` most similar of the other; each once."""
    found = neighbours(vectors, key, dense, k, dim, least)
    return found.select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b")).distinct()


def _search(table: pa.Table, book: Codebooks, k: int, dim: int, least: float | None, share: float) -> pa.Table:
    """Best items for every query of one section of a row of lists."""
    x = _unfine(_matrix(table["vec"], np.uint8, 3 * dim), dim)
    d1, d2 = np.asarray(table["d1"]), np.asarray(table["d2"])
    stored = np.asarray(table["norm"].is_valid())
    items, queries = np.nonzero(stored)[0], np.nonzero(~stored)[0]
    asked, answer, cosines = [], [], []
    if len(items) and len(queries):
        row = int(table["place"][0].as_py()) >> 40
        width, (stages, words) = len(book.second), book.later.shape[:2]
        visits = np.unpackbits(_matrix(table["mask"].drop_null(), np.uint8, -(-width // 8)), axis=1, count=width).astype(bool)
        codes = _matrix(table["codes"].drop_null(), np.uint8, 2 + stages)
        column = np.ascontiguousarray(codes[:, :2]).view("<u2")[:, 0]
        slots = codes[:, 2:].astype(np.int64) + np.arange(stages) * words
        norms = np.asarray(table["norm"].drop_null())
        flat = book.later.reshape(stages * words, dim)
        for b in np.unique(column):
            here, ask = np.nonzero(column == b)[0], queries[visits[:, b]]
            take = min(len(here), max(RERANKED, int(share * len(here))))
            y, centre = x[items[here]], book.centre(np.array([row * width + b]))[0]
            block = max(1, min(1_024, 4_000_000 // len(here)))
            for i in range(0, len(ask), block):
                mine = ask[i : i + block]
                q = x[mine]
                # Lookup tables: inner products of the queries with all codewords.
                lookup = flat @ q.T
                scores = lookup[slots[here, 0]]
                for s in range(1, stages):
                    scores += lookup[slots[here, s]]
                scores += q @ centre
                scores /= norms[here][:, None]
                hopeful = scores >= (-2.0 if least is None else least - SLACK)
                if hopeful.sum(axis=0).max(initial=0) > take:
                    best = np.argpartition(-scores, take - 1, axis=0)[:take]
                    c, r = np.nonzero(np.take_along_axis(hopeful, best, 0))
                    c = best[c, r]
                else:
                    c, r = np.nonzero(hopeful)
                exact = np.einsum("nd,nd->n", q[r].astype(np.float64), y[c].astype(np.float64))
                mine, other = mine[r], items[here[c]]
                keep = (d1[other] != d1[mine]) | (d2[other] != d2[mine])
                if least is not None:
                    keep &= exact >= least
                asked.append(mine[keep])
                answer.append(other[keep])
                cosines.append(exact[keep])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
    q, o, v = join(asked, np.int64), join(answer, np.int64), join(cosines, np.float64)
    order = np.lexsort((o, -v, q))
    q, o, v = q[order], o[order], v[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) <= k
    q, o, v = q[keep], o[keep], v[keep]
    return pa.table([pa.array(d1[q]), pa.array(d2[q]), pa.array(d1[o]), pa.array(d2[o]), pa.array(v)], ["d1", "d2", "o1", "o2", "cosine"])
