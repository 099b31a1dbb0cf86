"""How distinctive a term is per record: log-entropy weighting in two aggregations.

A term counts by the logarithm of its frequency in the record, times one minus
the normalised entropy of its spread over all records: a term spread evenly
over everything gets 0, a term of one record gets the whole local weight.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a term is a longest run of at least five of these letters.
TERM = "[a-z\\u00DF-\\u00F6\\u00F8-\\u024F]{5,}"


def terms(text: Column) -> Column:
    """The terms of a text, with repetition; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def log_entropy(records: DataFrame, record: str, text: str, identity: list[str], split: Callable[[Column], Column] = terms) -> DataFrame:
    """(record, term, tf, df, score, records) for every term of every record; ``records`` is how many there are.

    ``split`` makes the array of terms of a text.
    ``identity`` names the columns that make a row of ``records`` one item;
    repeated rows count once.  Null and empty texts have no terms but their
    records still count in the number of records that normalises the entropy;
    rows with a null record are left out.  With a single record all terms
    have full weight.
    """
    items = records.select(record, text, *[c for c in identity if c not in (record, text)]).where(F.col(record).isNotNull()).distinct()
    # First aggregation, with a map-side half: a hot record or term is counted where it lies.
    # The filter is one that the join below would infer on its side only; stated
    # here, both uses have the same plan and share one exchange.
    exploded = items.select(record, F.explode(split(F.col(text))).alias("term")).where("term IS NOT NULL")
    local = exploded.groupBy(record, "term").agg(F.count("*").alias("tf"))
    n = records.where(F.col(record).isNotNull()).agg(F.countDistinct(record).alias("_records"))
    # Second aggregation: sum of p log p from sum of tf log tf.
    spread = local.groupBy("term").agg(
        F.sum("tf").alias("_gf"),
        F.count("*").alias("df"),
        F.sum(F.col("tf") * F.log("tf")).alias("_tlogt"),
    )
    entropy = F.log("_gf") - F.col("_tlogt") / F.col("_gf")
    weighed = spread.join(F.broadcast(n)).select(
        "term", "df", F.col("_records").alias("records"), F.when(F.col("_records") > 1, 1 - entropy / F.log("_records")).otherwise(F.lit(1.0)).alias("_global")
    )
    scored = local.join(weighed, "term")
    return scored.select(record, "term", "tf", "df", (F.log1p("tf") * F.greatest(F.col("_global"), F.lit(0.0))).alias("score"), "records")


def marks(weights: DataFrame, tf: int, df: int) -> DataFrame:
    """Of the weights those of terms that mark their record: at least ``tf`` times in it, in at most ``df`` records.

    The entropy of a spread over so few records is at most log df, so the
    weight of every such term reaches a bound that is known beforehand: the
    weight selects, and the counts are then checked exactly.
    """
    spread = F.when(F.col("records") > 1, 1 - F.log(F.lit(float(df))) / F.log("records")).otherwise(F.lit(1.0))
    bound = F.log1p(F.lit(float(tf))) * F.greatest(spread, F.lit(0.0))
    return weights.where((F.col("score") >= bound - 1e-9) & (F.col("tf") >= tf) & (F.col("df") <= df))
