"""Hybrid search for a batch of requests, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import lexical
from lectern.operators.dense import best_visible, nearest_visible, with_hash_embedding
from lectern.operators.fusion import coverage_score, reciprocal_rank
from lectern.operators.visibility import acl_overlap, heading_contains
from lectern.session import parallelism, written

OVERFETCH = 4
DIM = 128
MODES = ("hybrid", "dense", "sparse")


def variants(requests: DataFrame) -> DataFrame:
    """(query_id, variant): a request as it is, then without framing, then in parts."""
    return requests.select("query_id", F.posexplode(T.rewrite(F.col("query"))).alias("no", "variant"))


def allowed_pairs(hits: DataFrame, requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits a request may see: its tenant, its acl, current versions if it asks so; before any rank is given."""
    r = requests.select("query_id", F.col("tenant_id").alias("_tenant"), F.col("acl").alias("_allowed"), "current_only")
    c = chunks.select("chunk_id", "tenant_id", "acl", "is_current")
    joined = hits.join(r, "query_id").join(c, "chunk_id")
    seen = (F.col("tenant_id") == F.col("_tenant")) & acl_overlap(F.col("acl"), F.coalesce("_allowed", F.array().cast("array<string>")))
    return joined.where(seen & (F.col("is_current") | ~F.col("current_only"))).select(*hits.columns)


def sparse(requests: DataFrame, chunks: DataFrame, tf: DataFrame, folded: bool = False) -> DataFrame:
    """BM25 of all variants' terms together, one search a request."""
    joined = variants(requests).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "variant"))), lambda v: v["variant"]), " ").alias("query"))
    terms = lexical.query_terms(joined.join(requests.select("query_id", "tenant_id"), "query_id"), folded=folded, scope=("tenant_id",))
    return allowed_pairs(lexical.bm25(terms, tf, scope=("tenant_id",)), requests, chunks)


def dense(requests: DataFrame, chunks: DataFrame, k: int, folded: bool = False) -> DataFrame:
    """Best cosine over a request's variants, of all chunks it may see: its ``k`` best are among the rows."""
    asked = with_hash_embedding(variants(requests), "variant", "dense", DIM, folded).select("query_id", "dense")
    asked = asked.join(requests.select("query_id", "tenant_id", "acl", "current_only"), "query_id")
    # Each block of requests reads the vectors again, so they are written once.
    stored = written(with_hash_embedding(chunks.select("chunk_id", "tenant_id", "acl", "is_current", "text"), "text", "dense", DIM, folded).drop("text"))
    return nearest_visible(asked, stored, k, DIM).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def checked(requests: DataFrame, top_k: int = 10) -> DataFrame:
    """``requests`` with ``reason`` why one can't be answered (null if it can), and with its defaults filled in.

    A query has 1 to 2,000 characters that aren't all blank, ``top_k`` is 1 to
    100, ``mode`` is one of hybrid, dense and sparse.
    """
    query = F.regexp_replace("query", r"^\s+|\s+$", "")
    reason = (
        F.when(F.coalesce(F.length(query), F.lit(0)) == 0, "no_query")
        .when(F.length("query") > 2_000, "query_too_long")
        .when(~F.coalesce("top_k", F.lit(top_k)).between(1, 100), "invalid_top_k")
        .when(~F.coalesce("mode", F.lit("hybrid")).isin(*MODES), "invalid_mode")
    )
    filled = {"top_k": F.coalesce("top_k", F.lit(top_k)), "mode": F.coalesce("mode", F.lit("hybrid")), "rerank": F.coalesce("rerank", F.lit(True))}
    return requests.withColumn("reason", reason).withColumns(filled)


def hybrid(requests: DataFrame, chunks: DataFrame, heading: str | None = None, width: int = 320, folded: bool = False) -> DataFrame:
    """(query_id, rank, chunk_id, score, rerank_score, contributions, snippet, anchor) of cited results.

    Rewriting, lexical retrieval and vectors of all visible chunks as the
    request's ``mode`` says, rank fusion, the heading filter after fusion and
    before reranking, reranking by coverage (by 0 for requests that want none,
    which keeps the fused order), a cut at the request's ``top_k``, and a
    snippet.  Requests that `checked` refuses, and those without a term, have
    no results.  ``chunks`` (chunk_id, text, tenant_id, acl, is_current,
    heading_path, page, uri; with ``analyzed`` their stored tokens are used).
    """
    requests = checked(requests).where("reason IS NULL")
    # A chunk is taken apart and written once, in order of tenant and id: a request meets few parts of the index.
    stored = [c for c in ("analyzed",) if c in chunks.columns]
    index = lexical.index(chunks, folded=folded, keep=("tenant_id", "acl", "is_current", "text", "heading_path", "page", "uri", *stored), scope=("tenant_id",))
    asked = requests.select("query_id", "query", "tenant_id", "acl", "current_only", "mode", (F.col("top_k") * OVERFETCH).alias("_limit"))
    each = asked.withColumn("variant", F.explode(T.rewrite(F.col("query"))))
    every = asked.withColumn("terms", T.tokens(F.array_join(T.rewrite(F.col("query")), " "), folded))
    most = (asked.agg(F.max("_limit")).first()[0]) or OVERFETCH
    lexical_hits = lexical.best(every.where("mode <> 'dense'"), index, most, visible=True, named=False)
    vector_hits = best_visible(each.where("mode <> 'sparse'").withColumn("terms", T.tokens(F.col("variant"), folded)), index, DIM)
    runs = lexical_hits.withColumn("retriever", F.lit("sparse")).unionByName(vector_hits.withColumn("retriever", F.lit("dense")))
    # Numbers are in order of the ids.  A request's hits meet once; ranks and fusion are made where they are.
    met = runs.withColumnRenamed("number", "chunk_id").repartition(parallelism(chunks.sparkSession), "query_id")
    limits = asked.select("query_id", "_limit")
    fused = lexical.top(reciprocal_rank(met).join(limits, "query_id"), "_limit").select("query_id", F.col("chunk_id").alias("number"), "score", "contributions")
    # Only numbers were ranked; the texts are fetched for what is left.
    cited = fused.join(index.select("number", "chunk_id", "text", "heading_path", "page", "uri", *stored), "number").drop("number")
    if heading:
        cited = cited.where(heading_contains(F.col("heading_path"), heading))
    cited = cited.join(requests.select("query_id", "query", "top_k", "rerank"), "query_id")
    q, c = T.tokens(F.col("query"), folded), stored_tokens(F.col("analyzed") if stored else None, F.col("text"), folded)
    scored = cited.withColumn("rerank_score", F.when(F.col("rerank"), coverage_score(q, c)).otherwise(F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.desc("score"), "chunk_id")
    best_hits = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("top_k"))
    long = F.filter(F.array_distinct(q), lambda t: F.length(t) > 1)
    terms = F.when(F.size(long) > 0, long).otherwise(F.array_distinct(q))
    return best_hits.select(
        "query_id", "rank", "chunk_id", "score", "rerank_score", "contributions",
        T.snippet(F.col("text"), terms, width).alias("snippet"), T.source_anchor(F.col("uri"), F.col("page")).alias("anchor"),
    )


def stored_tokens(analyzed: Column | None, text: Column, folded: bool = False) -> Column:
    """The tokens of a chunk from its index form, made from the text where that is missing."""
    made = T.tokens(text, folded)
    return made if analyzed is None else F.when(F.coalesce(analyzed, F.lit("")) != "", F.split(analyzed, " ")).otherwise(made)


def backfilled(chunks: DataFrame, folded: bool = False, force: bool = False) -> DataFrame:
    """``chunks`` with ``analyzed`` made where it is missing or empty, or with ``force`` everywhere."""
    missing = F.lit(force) | (F.coalesce(F.col("analyzed"), F.lit("")) == "")
    return chunks.withColumn("analyzed", F.when(missing, T.analyze(F.col("text"), folded)).otherwise(F.col("analyzed")))


def to_embed(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Chunks without a vector of ``model``: what a run that was broken off, or a change of model, leaves to do."""
    return chunks.join(vectors.where(F.col("model") == model).select("chunk_id"), "chunk_id", "left_anti")


def trace(requests: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, reason, n_variants, n_results, n_sparse, n_dense) of every request: what was asked, and what each retriever gave."""
    asked = checked(requests).select("query_id", "reason", F.size(T.rewrite(F.col("query"))).alias("n_variants"))
    by = lambda name: F.count(F.when(F.map_contains_key("contributions", name), 1))
    given = results.groupBy("query_id").agg(F.count("*").alias("n_results"), by("sparse").alias("n_sparse"), by("dense").alias("n_dense"))
    return asked.join(given, "query_id", "left").fillna(0, ["n_results", "n_sparse", "n_dense"])
