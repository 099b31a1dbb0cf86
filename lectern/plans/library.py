"""The chunk table and the library's listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.intervals import numbered
from lectern.operators.positions import following
from lectern.session import bounded
from lectern.sources.tables import delivered_once, load


def chunks(spark: SparkSession, folder: str, once: bool = True) -> DataFrame:
    """Blocks with what search needs of their version, section and source: one denormalized row each.

    Without ``once`` a repeated delivery has a row of its own, for plans that
    count distinct rows themselves.
    """
    b = (delivered_once if once else load)(spark, folder, "blocks", "id", "document_id", "version_id", "source_id", "kind", "text", "section_id", "page", "char_start", "char_end")
    v = delivered_once(spark, folder, "versions", "version_id", "tenant_id", "title", "acl", "is_current")
    s = delivered_once(spark, folder, "sections", "id", "heading_path").select(F.col("id").alias("section_id"), "heading_path")
    u = delivered_once(spark, folder, "sources", "source_id", "uri")
    # Texts are shuffled only by versions or sections that are too many to be broadcast.
    v, s = bounded(v), bounded(s)
    joined = b.withColumnRenamed("id", "chunk_id").join(v, "version_id").join(s, "section_id", "left").join(u, "source_id", "left")
    return joined.withColumn("text", F.coalesce("text", F.lit("")))


def version_counts(versions: DataFrame, blocks: DataFrame) -> DataFrame:
    """(document_id, n_versions, n_chunks): counted each by itself, then joined."""
    n = versions.groupBy("document_id").agg(F.countDistinct("version_id").alias("n_versions"))
    c = blocks.groupBy("document_id").agg(F.countDistinct("id").alias("n_chunks"))
    return n.join(c, "document_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))


def version_lists(versions: DataFrame) -> DataFrame:
    """(document_id, listed): number and status of every version of a document, in order."""
    listed = F.array_sort(F.collect_list(F.struct("version_no", "status")))
    each = F.transform(listed, lambda v: F.concat(v["version_no"].cast("string"), F.lit(":"), v["status"]))
    return versions.groupBy("document_id").agg(F.array_join(each, " ").alias("listed"))


def shelves(versions: DataFrame) -> DataFrame:
    """(source_id, place, title, document_id): current documents by source, in order of title and id, on a shelf of any length."""
    current = versions.where("is_current").select("source_id", F.coalesce("title", F.lit("")).alias("title"), "document_id")
    return numbered(current, ["source_id"], ["title", "document_id"], "place", first=1)


def validity(versions: DataFrame) -> DataFrame:
    """Each version with the half-open time it was the live one: (document_id, version_id, active_from, active_until)."""
    rows = versions.select("document_id", "version_id", "version_no", F.col("created_at").alias("active_from"))
    return following(rows, ["document_id"], ["version_no", "version_id"], "active_from", "active_until").drop("version_no")
