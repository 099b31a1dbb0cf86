"""Queries over the nine training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.probit import probit_sql
from lectern.functions.text import tokens, tokens_sql
from lectern.llm import byte_bpe, distinctive_terms, fill_containers, fuse_scores, garbled, same_look, scan_repair, similar_vectors, split_oversized
from lectern.sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_vectors.similar_pairs(load(spark, folder, "vectors"), "chunk_id", "dense", 0.85)


def p1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar of every hundredth chunk (by hash of its id), among all chunks."""
    found = similar_vectors.neighbours(load(spark, folder, "vectors"), "chunk_id", "dense", wide=similar_vectors.WIDE, one_in=100)
    return found.withColumn("cosine", F.round("cosine", 6))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    noise = scan_repair.find_noise(load(spark, folder, "blocks"), load(spark, folder, "sections"), load(spark, folder, "versions"))
    return noise.withColumnRenamed("id", "block_id")


def p2_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return scan_repair.repair_text(load(spark, folder, "blocks"), load(spark, folder, "sections"), load(spark, folder, "versions"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return fuse_scores.top_by_all(load(spark, folder, "fused_hits"), load(spark, folder, "results"))


def p3_ranking(spark: SparkSession, folder: str) -> DataFrame:
    fused = fuse_scores.fuse(load(spark, folder, "fused_hits"), load(spark, folder, "results"))
    return fused.withColumn("fused", F.round("fused", 6))


def p4_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The common form of every distinct block text and request query."""
    blocks = load(spark, folder, "blocks").select(F.lit("block").alias("field"), F.col("id"), "text").distinct()
    queries = load(spark, folder, "requests").select(F.lit("query").alias("field"), F.col("query_id").alias("id"), F.col("query").alias("text")).distinct()
    return same_look.with_form(blocks.unionByName(queries), "text").select("field", "id", "form")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    blocks = same_look.same_look_pairs(load(spark, folder, "blocks"), "block", "id", "text")
    return blocks.unionByName(same_look.same_look_pairs(load(spark, folder, "requests"), "query", "query_id", "query"))


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized.split_oversized(load(spark, folder, "blocks"), load(spark, folder, "sections"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    cut = split_oversized.split_oversized(load(spark, folder, "blocks"), load(spark, folder, "sections"))
    return cut.where("piece_no = 0").select(F.col("id").alias("block_id")).distinct()


def p6_weights(spark: SparkSession, folder: str) -> DataFrame:
    """All terms of the blocks of every kind, as an index would take them: words, and characters and pairs of Chinese."""
    weights = distinctive_terms.log_entropy(load(spark, folder, "blocks"), "document_id", "text", ["id"], tokens)
    return weights.drop("records").withColumn("score", F.round("score", 6))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    blocks = load(spark, folder, "blocks").where("kind = 'text'")
    weights = distinctive_terms.log_entropy(blocks, "document_id", "text", ["id"])
    return distinctive_terms.marks(weights, 5, 3).select("document_id", "term")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.with_ids(load(spark, folder, "documents", "doc_id", "text"), "text").select("doc_id", "ids")


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Of every document whether decoding its ids gives its text back; a null text comes back empty."""
    encoded = byte_bpe.with_ids(load(spark, folder, "documents", "doc_id", "text"), "text")
    decoded = byte_bpe.with_text(encoded, "ids")
    return decoded.select("doc_id", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"))


def p8_packing(spark: SparkSession, folder: str) -> DataFrame:
    counted = byte_bpe.count_documents(load(spark, folder, "documents"))
    packed = fill_containers.fill(counted, "doc_id", "n_tokens")
    return packed.withColumnsRenamed({"size": "n_tokens", "start": "token_start"})


def p9_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Every garbled document with its text as far as it could be restored."""
    found = garbled.repair_documents(load(spark, folder, "documents"), "doc_id", "text")
    return found.where("garbled").select("doc_id", "restored")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled.repair_documents(load(spark, folder, "documents"), "doc_id", "text").where("garbled").select("doc_id")


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_neighbours": p1_neighbours,
    "p2_found": p2_found,
    "p2_paragraphs": p2_paragraphs,
    "p3_found": p3_found,
    "p3_ranking": p3_ranking,
    "p4_found": p4_found,
    "p4_forms": p4_forms,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p6_found": p6_found,
    "p6_weights": p6_weights,
    "p7_ids": p7_ids,
    "p7_round_trip": p7_round_trip,
    "p8_packing": p8_packing,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}

_P3 = """
WITH h AS (SELECT DISTINCT query_id, chunk_id, score, dense_score, sparse_score FROM fused_hits),
     r AS (SELECT DISTINCT query_id, chunk_id, rerank_score FROM results),
     w AS (SELECT h.*, rerank_score FROM h LEFT JOIN r USING (query_id, chunk_id)),
     l AS (SELECT query_id, chunk_id, 'score' AS kind, score AS value FROM w
           UNION ALL SELECT query_id, chunk_id, 'dense', dense_score FROM w
           UNION ALL SELECT query_id, chunk_id, 'sparse', sparse_score FROM w
           UNION ALL SELECT query_id, chunk_id, 'rerank', rerank_score FROM w),
     v AS (SELECT * FROM l WHERE value IS NOT NULL AND NOT isnan(value)),
     k AS (SELECT *, rank() OVER (PARTITION BY query_id, kind ORDER BY value DESC) - 1 AS higher,
                  (rank() OVER (PARTITION BY query_id, kind ORDER BY value) - 1
                   + count(*) OVER (PARTITION BY query_id, kind, value) / 2.0::DOUBLE)
                  / count(*) OVER (PARTITION BY query_id, kind) AS p FROM v)
"""

_TERM = "regexp_extract_all(lower(text), '[a-z\\x{00DF}-\\x{00F6}\\x{00F8}-\\x{024F}]{5,}')"


def _terms(blocks: str, split: str) -> str:
    return f"""
WITH b AS (SELECT DISTINCT id, document_id, text FROM {blocks}),
     t AS (SELECT document_id, unnest({split}) AS term FROM b WHERE text IS NOT NULL),
     l AS (SELECT document_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
     s AS (SELECT term, sum(tf) AS gf, count(*) AS df, sum(tf * ln(tf)) AS x FROM l GROUP BY 1),
     n AS (SELECT count(DISTINCT document_id) AS n FROM b)
"""

ORACLE: dict[str, str] = {
    "p3_found": _P3
    + """SELECT query_id, chunk_id FROM k WHERE kind <> 'score' AND higher < 3
         AND query_id IN (SELECT query_id FROM h GROUP BY 1 HAVING count(*) >= 6)
         GROUP BY 1, 2 HAVING count(*) = 3""",
    "p3_ranking": _P3
    + f""", f AS (SELECT query_id, chunk_id, round(avg({probit_sql("p")}), 9) AS fused, count(*) AS n_scores FROM k GROUP BY 1, 2)
        SELECT w.query_id, w.chunk_id, round(fused, 6) AS fused, coalesce(n_scores, 0)::BIGINT AS n_scores,
               row_number() OVER (PARTITION BY w.query_id ORDER BY fused DESC NULLS LAST, w.chunk_id)::BIGINT AS position
        FROM w LEFT JOIN f USING (query_id, chunk_id)""",
    "p5_found": "SELECT DISTINCT id AS block_id FROM blocks WHERE length(text) > 2000",
    "p7_round_trip": "SELECT doc_id, true AS same FROM documents",
    "p6_found": _terms("blocks WHERE kind = 'text'", _TERM) + "SELECT document_id, term FROM l JOIN s USING (term) WHERE tf >= 5 AND df <= 3",
    "p6_weights": _terms("blocks", tokens_sql("text"))
    + """SELECT document_id, term, tf::BIGINT AS tf, df::BIGINT AS df,
         round(ln(1 + tf) * greatest(0, CASE WHEN n > 1 THEN 1 - (ln(gf) - x / gf) / ln(n) ELSE 1 END), 6) AS score
         FROM l JOIN s USING (term), n""",
}
