"""Object store, index tables without MERGE, and atomic publication of a batch."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.identity import derived_id


def allowed_path(path: str, roots: list[str]) -> str:
    """The resolved path if it lies under one of the roots, else an error."""
    real = os.path.realpath(path)
    if not any(os.path.commonpath([real, os.path.realpath(r)]) == os.path.realpath(r) for r in roots):
        raise PermissionError(f"{path} lies outside the allowed folders")
    return real


def scan_files(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = True, most: int | None = None) -> DataFrame:
    """(path, content, length, modificationTime) of the files under a folder of any file system; the first ``most`` by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    if most is None:
        return files
    # Paths are ordered without the contents, which are read for the chosen files only.
    chosen = files.select("path").orderBy("path").limit(most)
    return files.join(chosen, "path", "left_semi")


def incoming_files(files: DataFrame, tenant: str, source_id: str) -> DataFrame:
    """Scanned files as what `register` takes: (document_id, content_hash, external_id, title, uri, mime, size); empty files are left out."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.where("length > 0").select(
        derived_id("document", F.lit(tenant), F.lit(source_id), F.col("path")).alias("document_id"),
        F.sha2("content", 256).alias("content_hash"), F.col("path").alias("external_id"), T.title_from(name, F.lit("")).alias("title"),
        F.col("path").alias("uri"), T.mime_type(F.col("path")).alias("mime"), F.col("length").alias("size"),
    )


def register(incoming: DataFrame, versions: DataFrame) -> DataFrame:
    """New versions for content that no indexed version of the document has yet; the next number each.

    ``incoming`` (document_id, content_hash, ...) and ``versions``
    (document_id, content_hash, version_no, status).
    """
    from pyspark.sql import Window

    known = versions.where("status = 'indexed'").select("document_id", "content_hash")
    fresh = incoming.dropDuplicates(["document_id", "content_hash"]).join(known, ["document_id", "content_hash"], "left_anti")
    last = versions.groupBy("document_id").agg(F.max("version_no").alias("_last"))
    order = Window.partitionBy("document_id").orderBy("content_hash")
    numbered = fresh.join(last, "document_id", "left").withColumn("version_no", F.coalesce("_last", F.lit(0)) + F.row_number().over(order))
    return numbered.drop("_last").withColumn("status", F.lit("pending"))


def upsert(index: DataFrame, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The index with rows replaced or added by key."""
    return index.join(rows.select(key), key, "left_anti").unionByName(rows)


def update_only(index: DataFrame, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The index with known keys replaced; unknown keys change nothing."""
    return upsert(index, rows.join(index.select(key), key, "left_semi"), key)


def replace(index: DataFrame, rows: DataFrame, by: str) -> DataFrame:
    """The index with all rows of every value of ``by`` that ``rows`` has replaced by those."""
    return index.join(rows.select(by).distinct(), by, "left_anti").unionByName(rows)


def delete(index: DataFrame, keys: DataFrame, by: str = "chunk_id") -> DataFrame:
    return index.join(keys.select(by).distinct(), by, "left_anti")


def check_dimension(index: DataFrame, dim: int, column: str = "dense") -> DataFrame:
    """The index, or an error at run time where a vector has another dimension."""
    wrong = F.col(column).isNotNull() & (F.size(column) != dim)
    return index.withColumn(column, F.when(wrong, F.raise_error(F.lit(f"vectors must have {dim} values"))).otherwise(F.col(column)))


class ObjectStore:
    """Objects by key under a root on any file system that Spark reads: a local folder, HDFS, or a bucket (s3a)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(self.root))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def uri(self, key: str) -> str:
        """The address of a key; an error for one that leads out of the root."""
        parts = key.split("/")
        if not key or key.startswith("/") or "\0" in key or any(p in ("", ".", "..") for p in parts):
            raise PermissionError(f"{key!r} is no key of this store")
        return f"{self.root}/{key}"

    def put(self, key: str, data: bytes) -> str:
        """Store an object; it is written aside and moved, so that no reader sees a part of it."""
        target, staged = self.uri(key), self._path(f"{self.root}/.staged-{uuid.uuid4().hex}")
        out = self._fs.create(staged, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        self._fs.mkdirs(self._path(target).getParent())
        self.replace(staged, self._path(target))
        return target

    def replace(self, staged, target) -> None:
        """Move a file to its place in one step, over what is there."""
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        how = self._gateway().new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context.rename(staged, target, how)

    @staticmethod
    def _gateway():
        from pyspark import SparkContext

        return SparkContext._gateway

    def get(self, key: str) -> bytes:
        stream = self._fs.open(self._path(self.uri(key)))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def exists(self, key: str) -> bool:
        return self._fs.exists(self._path(self.uri(key)))

    def delete(self, key: str) -> bool:
        """Whether there was such an object; it is gone either way."""
        return self._fs.delete(self._path(self.uri(key)), False)


class Publication:
    """Tables of batches under one root, visible together once the manifest names their batch.

    The manifest is an object that is replaced in one step; readers resolve it
    first and see whole batches only.  A root on shared storage serves a cluster.
    """

    MANIFEST = "MANIFEST.json"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, ObjectStore(spark, root)

    def live(self) -> list[str]:
        return json.loads(self.store.get(self.MANIFEST))["batches"] if self.store.exists(self.MANIFEST) else []

    def write(self, tables: dict[str, DataFrame], replace: bool = False) -> str:
        """Add a batch, or with ``replace`` put it in place of all others (with empty tables: recreate)."""
        batch = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(self.store.uri(f"{name}/batch_id={batch}"))
        batches = ([] if replace else self.live()) + [batch]
        self.store.put(self.MANIFEST, json.dumps({"batches": batches}).encode())
        return batch

    def read(self, name: str) -> DataFrame:
        keys = [k for b in self.live() if self.store.exists(k := f"{name}/batch_id={b}")]
        if not keys:
            raise FileNotFoundError(f"no published batch of {name}")
        return self.spark.read.parquet(*map(self.store.uri, keys))
