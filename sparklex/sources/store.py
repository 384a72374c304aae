"""Key-value tables of documents: in memory, or Parquet under any Hadoop path.

A Parquet store is a log of batches.  Every batch has its own folder and number;
a read keeps the latest entry of each key.  Compaction writes the live entries as
one batch and then removes the older ones.  Any path that Hadoop can open will
do, object stores included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import latest


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, sorted; empty if it is not there."""
    fs, where = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()) if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``, which is made the session's checkpoint folder.

    On a single machine the warehouse stands in where it is unset; on a cluster that
    would be a folder of the driver's own, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class MemoryStore:
    """Documents held by the session: ``key, value``; the lineage is cut every ``CUT_EVERY`` changes."""

    kind = "memory"
    SCHEMA = "key string, value string"

    CUT_EVERY = 10

    def __init__(self, spark: SparkSession):
        self.spark, self._changes = spark, 0
        self._rows = spark.createDataFrame([], self.SCHEMA)

    def _become(self, rows: DataFrame) -> None:
        self._changes += 1
        if self._changes % self.CUT_EVERY == 0:
            checkpoint_folder(self.spark)
            rows = rows.checkpoint()
        self._rows = rows

    def put(self, rows: DataFrame) -> None:
        rows = rows.select("key", "value")
        self._become(self._rows.join(rows.select("key"), "key", "left_anti").unionByName(rows))

    def delete(self, *keys: str) -> None:
        if keys:
            self.delete_all(self.spark.createDataFrame([(k,) for k in keys], "key string"))

    def delete_all(self, keys: DataFrame) -> None:
        """Delete the keys that a DataFrame lists."""
        self._become(self._rows.join(keys.select("key"), "key", "left_anti"))

    def each(self) -> DataFrame:
        return self._rows

    def get(self, key: str) -> str | None:
        row = self.each().where(F.col("key") == key).select("value").first()
        return row.value if row else None

    def has(self, key: str) -> bool:
        return bool(self.each().where(F.col("key") == key).take(1))

    def size(self) -> int:
        return self.each().count()

    def clear(self) -> None:
        self._rows = self.spark.createDataFrame([], self.SCHEMA)

    def compact(self) -> None:
        """Nothing to do; the lineage is cut as the store changes."""

    def close(self) -> None:
        """Nothing to do."""


class ParquetStore(MemoryStore):
    """Documents in a log of Parquet batches."""

    kind = "parquet"
    LOG_SCHEMA = "key string, value string, seq bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _batches(self) -> list[str]:
        return [b for b in subfolders(self.spark, self.path) if b.startswith("batch-")]

    def _append(self, rows: DataFrame, number: int | None = None) -> str:
        taken = self._batches()
        number = (int(taken[-1][6:]) + 1 if taken else 0) if number is None else number
        name = f"batch-{number:012d}"
        rows.select("key", "value", F.lit(number).cast("bigint").alias("seq")).write.mode("overwrite").parquet(f"{self.path}/{name}")
        return name

    def _log(self) -> DataFrame:
        done = [b for b in self._batches() if finished(self.spark, f"{self.path}/{b}")]
        return self.spark.read.schema(self.LOG_SCHEMA).parquet(*(f"{self.path}/{b}" for b in done)) if done else self.spark.createDataFrame([], self.LOG_SCHEMA)

    def put(self, rows: DataFrame) -> None:
        self._append(rows)

    def delete_all(self, keys: DataFrame) -> None:
        self._append(keys.select("key", F.lit(None).cast("string").alias("value")))

    def each(self) -> DataFrame:
        return latest(self._log(), "key", "seq").where(F.col("value").isNotNull()).select("key", "value")

    def clear(self) -> None:
        remove(self.spark, self.path)

    def compact(self) -> None:
        old = self._batches()
        self._append(self.each())
        for name in old:
            remove(self.spark, f"{self.path}/{name}")


def finished(spark: SparkSession, path: str) -> bool:
    """Was a folder written to its end?"""
    fs, where = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(where)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a folder."""
    fs, where = _fs(spark, path)
    return fs.getContentSummary(where).getLength()
