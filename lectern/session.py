"""Session helpers: a local session for tests and a lineage cut that survives lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast after they were counted; a larger side is shuffled.
BROADCAST_ROWS = 200_000


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lectern")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LECTERN_DRIVER_MEMORY", "6g"))
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), f"lectern-{spark.sparkContext.applicationId}")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder now and read it from there afterwards.

    Reliable ``checkpoint()``: the rows survive the loss of any executor, and
    every later read sees the same rows even where the plan above was not
    deterministic (range sampling, partition ids).
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder now and read it from there afterwards.

    As `cut`, for wide rows of which later reads need a few columns each: the
    table is columnar and compressed.  It is deleted when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` written and counted: to be broadcast in joins up to ``most`` rows, to be shuffled beyond them."""
    table = written(df)
    return F.broadcast(table) if table.count() <= most else table


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of this session, the unit in which plans here size their blocks."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
