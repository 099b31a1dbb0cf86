"""One ranking from several differently-scaled scores.

Each score becomes its percentile among the scores of the same kind in its
group (ties averaged), the percentile becomes a normal deviate, and the
deviates are combined by a weighted mean.  Only ranks enter, so no score can
rule by its range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.probit import probit
from lectern.operators.positions import cumulative
from lectern.session import written

SIGNALS = ("score", "dense_score", "sparse_score", "rerank_score")


def gather_scores(hits: DataFrame, results: DataFrame) -> DataFrame:
    """Fused hits with their rerank score, one row per (query_id, chunk_id).

    A hit without a row in ``results`` keeps a null ``rerank_score``.  A
    retriever other than dense and sparse that is named in ``contributions``
    adds minus its rank as a further score, under ``other``.
    """
    hits = hits.select("query_id", "chunk_id", "score", "contributions", "dense_score", "sparse_score")
    # Maps can't be grouped by; their sorted entries can.
    entries = F.array_sort(F.map_entries("contributions"))
    hits = hits.withColumn("contributions", entries).distinct()
    results = results.select("query_id", "chunk_id", "rerank_score").distinct()
    return hits.join(results, ["query_id", "chunk_id"], "left")


def scored(wide: DataFrame, signals: tuple[str, ...] = SIGNALS) -> DataFrame:
    """Long form (query_id, chunk_id, kind, value); null, NaN are no scores."""
    named = [F.struct(F.lit(s).alias("kind"), F.col(s).cast("double").alias("value")) for s in signals]
    pairs = F.array(*named)
    if "contributions" in wide.columns:
        other = F.transform(
            F.filter(F.coalesce("contributions", F.array()), lambda e: ~e["key"].isin("dense", "sparse")),
            lambda e: F.struct(F.concat(F.lit("rank:"), e["key"]).alias("kind"), (-e["value"]).cast("double").alias("value")),
        )
        pairs = F.concat(pairs, other)
    long = wide.select("query_id", "chunk_id", F.inline(pairs))
    # -0.0 and 0.0 are one score.
    return long.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("value", F.col("value") + F.lit(0.0))


def places(long: DataFrame) -> DataFrame:
    """(query_id, kind, value, higher, percentile, deviate): ``higher`` is the number of strictly higher scores of the kind in the query."""
    values = long.groupBy("query_id", "kind", "value").agg(F.count("*").alias("_n"))
    placed = cumulative(values, ["query_id", "kind"], ["value"], "_n")
    p = (F.col("below") + F.col("_n") / 2) / F.col("total")
    return placed.select(
        "query_id", "kind", "value",
        (F.col("total") - F.col("below") - F.col("_n")).alias("higher"),
        p.alias("percentile"),
        probit(p).alias("deviate"),
    )


def percentiles(long: DataFrame) -> DataFrame:
    """The scores with their `places`."""
    return long.join(places(long), ["query_id", "kind", "value"])


def fuse(hits: DataFrame, results: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, chunk_id, fused, n_scores, position): one order of the hits of each request.

    ``weights`` by kind, 1 where not named.  Missing scores leave the mean to
    the others; a hit without any score has null ``fused`` and comes last.
    Position 1 is best; equal ``fused`` is ordered by chunk id.  Empty tables
    give no rows; a single hit has percentile one half.
    """
    wide = gather_scores(hits, results)
    ranked = percentiles(scored(wide))
    weight = F.lit(1.0)
    for kind, w in (weights or {}).items():
        weight = F.when(F.col("kind") == kind, F.lit(float(w))).otherwise(weight)
    fused = ranked.groupBy("query_id", "chunk_id").agg(
        (F.sum(F.col("deviate") * weight) / F.sum(weight)).alias("fused"),
        F.count("*").alias("n_scores"),
    )
    whole = wide.select("query_id", "chunk_id").join(fused, ["query_id", "chunk_id"], "left")
    whole = whole.withColumn("n_scores", F.coalesce("n_scores", F.lit(0)))
    # Rounded so that the order of summation can't decide between equal hits.
    whole = whole.withColumn("fused", F.round("fused", 9)).withColumn("_one", F.lit(1))
    whole = whole.withColumn("_order", F.coalesce(-F.col("fused"), F.lit(float("inf"))))
    placed = cumulative(whole, ["query_id"], ["_order", "chunk_id"], "_one")
    return placed.select("query_id", "chunk_id", "fused", "n_scores", (F.col("below") + 1).alias("position"))


def top_by_all(hits: DataFrame, results: DataFrame, kinds: tuple[str, ...] = SIGNALS[1:], top: int = 3, least: int = 6) -> DataFrame:
    """(query_id, chunk_id) of hits among the ``top`` by each of ``kinds``, in requests of at least ``least`` hits.

    Such a hit has a mean deviate at least as high as the mean of the lowest
    deviates of the leading hits by each kind.  The fused score cuts the hits
    of a request there; that a hit is among the leading by each kind is then
    checked exactly.  A hit without one of the scores is not among them.
    """
    wide = gather_scores(hits, results)
    long = scored(wide.drop("contributions"), kinds)
    placed = written(places(long))
    ranked = long.join(placed, ["query_id", "kind", "value"])
    leads = F.col("higher") < top
    fused = ranked.groupBy("query_id", "chunk_id").agg(F.avg("deviate").alias("fused"), F.sum(leads.cast("int")).alias("_leads"))
    bars = placed.where(leads).groupBy("query_id", "kind").agg(F.min("deviate").alias("_bar"))
    bars = bars.groupBy("query_id").agg(F.avg("_bar").alias("_bar"), F.count("*").alias("_kinds")).where(F.col("_kinds") == len(kinds))
    sizes = wide.groupBy("query_id").agg(F.count("*").alias("_hits")).where(F.col("_hits") >= least)
    found = fused.join(bars.join(sizes, "query_id"), "query_id").where(F.col("fused") >= F.col("_bar") - 1e-9)
    return found.where(F.col("_leads") == len(kinds)).select("query_id", "chunk_id")
