"""Rank fusion and lexical reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import bind

RRF_K = 60


def reciprocal_rank(hits: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, score, contributions): sum of weight / (k + rank) over the retrievers.

    ``hits`` (query_id, retriever, chunk_id, score) are ranked from 1 within
    each retriever, ties by id; a retriever of weight 0 adds nothing.
    """
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("retriever") == name, F.lit(float(w))).otherwise(weight)
    order = Window.partitionBy("query_id", "retriever").orderBy(F.desc("score"), "chunk_id")
    ranked = hits.withColumn("_rank", F.row_number().over(order)).withColumn("_weight", weight).where("_weight > 0")
    return ranked.groupBy("query_id", "chunk_id").agg(
        F.sum(F.col("_weight") / (k + F.col("_rank"))).alias("score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("retriever", "_rank")))).alias("contributions"),
    )


def coverage_score(query_tokens: Column, chunk_tokens: Column) -> Column:
    """0.7 coverage + 0.2 density + 0.1 earliness of a query's distinct terms in a chunk, to six digits; 0 for none."""

    def score(x: Column) -> Column:
        terms, chunk = x["q"], x["c"]
        n = F.size(chunk)
        coverage = F.size(F.array_intersect(terms, chunk)) / F.size(terms)
        hits = F.size(F.filter(chunk, lambda t: F.array_contains(terms, t)))
        density = hits / (F.sqrt(n) + 1.0)
        # 1-based place of the first hit; none counts as just past the end.
        places = F.filter(F.transform(terms, lambda t: F.array_position(chunk, t)), lambda p: p > 0)
        first = F.coalesce(F.array_min(places) - 1, n)
        value = 0.7 * coverage + 0.2 * F.least(density, F.lit(1.0)) + 0.1 * (1.0 - first / n)
        return F.when((F.size(terms) > 0) & (n > 0), F.round(value, 6)).otherwise(F.lit(0.0))

    return bind(F.struct(F.array_distinct(query_tokens).alias("q"), chunk_tokens.alias("c")), score)
