"""The Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Scan ``folder/name.parquet``; the given columns only, so that pruning reaches the scan."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def delivered_once(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The table with repeated deliveries counted once.

    Copies of a row agree in every column but ``ingested_at``, so a distinct
    over the wanted columns (which must hold the key) is exact.  It runs as a
    hash aggregate with a map-side half, unlike a first-value per key, which
    sorts.
    """
    return load(spark, folder, name, *columns).distinct()


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the scan has fewer splits than the session has: a small file with costly rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
