"""Lexical index and BM25, as tables and joins."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lectern.functions import text as T
from lectern.operators import overlap
from lectern.session import bounded, parallelism, written

K1, B = 1.2, 0.75


def postings(chunks: DataFrame, text: str = "text", folded: bool = False, scope: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, *scope, term, tf): rows of ``chunks`` are counted as they come; ``scope`` are columns that a chunk has one value of."""
    return chunks.select("chunk_id", *scope, F.explode(T.tokens(F.col(text), folded)).alias("term")).groupBy("chunk_id", *scope, "term").agg(F.count("*").alias("tf"))


def lengths(tf: DataFrame) -> DataFrame:
    """(chunk_id, dl)"""
    return tf.groupBy("chunk_id").agg(F.sum("tf").alias("dl"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """(term, df)"""
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame, query: str = "query", folded: bool = False, scope: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, *scope, term): the distinct terms of every query."""
    return queries.select("query_id", *scope, F.explode(F.array_distinct(T.tokens(F.col(query), folded))).alias("term"))


def bm25(terms: DataFrame, tf: DataFrame, mode: str = "plus-one", scope: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, chunk_id, score): every chunk that shares a term with a query.

    Only postings of asked terms are joined: the stated queries' distinct terms
    select them first, so the index side shrinks before anything is multiplied.
    ``mode``: how rarity counts; ``clamped`` gives common terms almost nothing.
    ``scope`` (a tenant, say) must agree, so that a query's terms never meet
    the postings of another; rarity is counted over all.
    """
    dl = lengths(tf)
    corpus = dl.agg(F.count("*").alias("_n"), F.avg("dl").alias("_avg"))
    hits = tf.join(terms.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    odds = (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    idf = F.log1p(odds) if mode == "plus-one" else F.greatest(F.log(odds), F.lit(1e-6))
    weighed = df.join(F.broadcast(corpus)).select("term", idf.alias("_idf"), "_avg")
    scored = hits.join(weighed, "term").join(dl, "chunk_id")
    part = F.col("_idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("_avg")))
    # One row per (chunk, term) is weighed before queries multiply it.  Laid out by chunk, with
    # all partitions kept, what the queries multiply is summed where it is, without a shuffle.
    weights = scored.select("chunk_id", *scope, "term", part.alias("_part")).repartition(parallelism(tf.sparkSession), "chunk_id")
    return terms.join(weights, [*scope, "term"]).groupBy("query_id", "chunk_id").agg(F.sum("_part").alias("score"))


def tokenized(df: DataFrame, text: str, out: str, folded: bool = False) -> DataFrame:
    """``df`` with the `T.tokens` of ``text`` as ``out`` in its place; words are split in the JVM, those with ideographs taken apart over Arrow batches, a tenth of the time."""
    others = [c for c in df.columns if c != text]
    schema = S.StructType([*df.select(*others).schema.fields, S.StructField(out, S.ArrayType(S.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ideograph = re.compile(T.IDEOGRAPH)
        for batch in batches:
            lists = batch.column(len(others))
            bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists).fill_null(0)))])
            terms: list[str] = []
            ends = [0]
            for s in lists.flatten().to_pylist():
                if s.isascii() or not ideograph.search(s):
                    terms.append(s)
                else:
                    terms += s
                    terms += map(str.__add__, s, s[1:])
                ends.append(len(terms))
            offsets = np.array(ends, dtype=np.int32)[bounds]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.ListArray.from_arrays(pa.array(offsets), pa.array(terms, pa.string()))], [*others, out])

    return df.select(*others, T.segments(F.col(text), folded).alias("_segments")).mapInArrow(run, schema)


def index(chunks: DataFrame, text: str = "text", folded: bool = False, keep: tuple[str, ...] = (), scope: tuple[str, ...] = ()) -> DataFrame:
    """(number, chunk_id, *keep, terms) of the distinct ``chunks``, written; ``keep`` may name the text too.

    Numbers ascend with (scope, chunk_id), and so do the table's parts: a query
    of one scope meets few of them, and ties are decided by number.
    """
    parts = parallelism(chunks.sparkSession)
    placed = chunks.select("chunk_id", *dict.fromkeys((*keep, text))).repartitionByRange(parts, *scope, "chunk_id").distinct().sortWithinPartitions(*scope, "chunk_id")
    return written(tokenized(placed.select(F.monotonically_increasing_id().alias("number"), "chunk_id", *keep, F.col(text).alias("_text")), "_text", "terms", folded))


def index_in_place(delivered: DataFrame, text: str = "text") -> DataFrame:
    """(chunk_id, terms) of the distinct ``delivered`` chunks, written in the order they are read in, so that copies stay side by side.

    As `index` without a scope, but only chunks delivered again are shuffled
    with their texts; ties are decided by chunk_id.
    """
    rows = delivered.select("chunk_id", text)
    again = bounded(rows.groupBy(F.col("chunk_id").alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1").select("_again"))
    same = F.col("chunk_id").eqNullSafe(F.col("_again"))
    placed = rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").distinct())
    return written(tokenized(placed.select("chunk_id", F.col(text).alias("_text")), "_text", "terms"))


def best(queries: DataFrame, stored: DataFrame, k: int, mode: str = "plus-one", visible: bool = False, named: bool = True) -> DataFrame:
    """(query_id, chunk_id, or the number if not ``named``, score, rank): the best ``k`` of each of ``queries`` (query_id, terms) by BM25 in an `index`, or one `index_in_place`, ties by chunk.

    As `top` of `bm25`, scores to six digits, without a row for every chunk
    that shares a term.  ``visible``: queries (with tenant_id, acl,
    current_only and a ``_limit`` of their own, up to ``k``) rank only chunks
    they may see, which the index holds (tenant_id, acl, is_current); rarity is
    counted over all.
    """
    spark, by = stored.sparkSession, "number" if "number" in stored.columns else "chunk_id"
    asked = queries.select("query_id", F.array_distinct("terms").alias("terms"), *(("tenant_id", "acl", "current_only", "_limit") if visible else ())).orderBy("query_id").toArrow().combine_chunks()
    row, values = overlap.flat(asked["terms"])
    vocabulary = values.unique()
    known = overlap.table_of(spark, term=vocabulary, _feature=pa.array(np.arange(len(vocabulary), dtype=np.int32)))
    sizes = stored.select(F.size("terms").alias("dl")).where("dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("a")).first()
    counted = stored.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).join(known, "term").select("_feature", "df").toArrow()
    df = np.zeros(len(vocabulary))
    df[np.asarray(counted["_feature"])] = np.asarray(counted["df"])
    odds = (sizes["n"] - df + 0.5) / (df + 0.5)
    idf = np.log1p(odds) if mode == "plus-one" else np.maximum(np.log(odds), 1e-6)
    average, terms = sizes["a"] or 1.0, spark.sparkContext.broadcast((vocabulary, idf))
    numbers = np.asarray(pc.index_in(values, vocabulary)).astype(np.int32)
    starts = np.searchsorted(row, np.arange(asked.num_rows + 1))
    limits = np.asarray(asked["_limit"]).astype(np.int32) if visible else np.full(asked.num_rows, k, dtype=np.int32)
    audience, asking = overlap.audiences(asked) if visible else (None, [])

    def rows_of(table: pa.Table) -> Iterator[tuple]:
        vocabulary, idf = terms.value
        table = overlap.ordered(table, by)
        item, values = overlap.flat(table["terms"])
        found = pc.index_in(values, vocabulary)
        hit = np.asarray(found.is_valid())
        dl = np.bincount(item, minlength=table.num_rows)
        key, tf = np.unique(item[hit] * len(idf) + np.asarray(found.drop_null()), return_counts=True)
        item, term = key // max(1, len(idf)), (key % max(1, len(idf))).astype(np.int32)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[item] / average))
        if not visible:
            yield table.num_rows, [table[by].combine_chunks()], item, term, weight, None, None
            return
        for rows, seen in overlap.seen_rows(table, asking):
            place = np.full(table.num_rows, -1)
            place[rows] = np.arange(len(rows))
            own = place[item] >= 0
            yield len(rows), [table[by].combine_chunks().take(pa.array(rows))], place[item[own]], term[own], weight[own], None, seen

    scan = stored.select(by, "terms", *(("tenant_id", "acl", "is_current") if visible else ()))
    hits = overlap.scored(scan, overlap.Queries(starts, numbers, limits, audience=audience), {by: "long" if by == "number" else "string"}, rows_of)
    names = overlap.table_of(spark, _query=pa.array(np.arange(asked.num_rows, dtype=np.int32)), query_id=asked["query_id"].combine_chunks(), _limit=pa.array(limits))
    found = overlap.ranked(hits, names if visible else k, by).join(names.drop("_limit"), "_query")
    if not named or by == "chunk_id":
        return found.select("query_id", by, "score", "rank")
    return found.join(stored.select("number", "chunk_id"), "number").select("query_id", "chunk_id", "score", "rank")


def top(hits: DataFrame, k: int | str, by: str = "query_id", score: str = "score", key: str = "chunk_id") -> DataFrame:
    """The best ``k`` of each group with their ``rank`` from 1; ties by key.  Cut on the map side first."""
    limit = F.col(k) if isinstance(k, str) else F.lit(k)
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), key)))
    return ranked.where(F.col("rank") <= limit)
