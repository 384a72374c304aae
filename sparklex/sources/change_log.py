"""A change log of upserts and deletes as JSON lines, and its replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import FIELD_TYPE
from .store import remove, subfolders

INDEX, DELETE = "index", "delete"
ENTRY_SCHEMA = f"seq bigint, op string, doc_id string, fields map<string,{FIELD_TYPE}>"


class ChangeLog:
    """Entries ``seq, op, doc_id, fields`` in numbered folders of JSON lines under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _parts(self) -> list[str]:
        return [p for p in subfolders(self.spark, self.path) if p.startswith("part-")]

    def append(self, entries: DataFrame) -> None:
        """Write a batch of entries; it is durable when this returns."""
        parts = self._parts()
        number = int(parts[-1][5:]) + 1 if parts else 0
        entries.select("seq", "op", "doc_id", "fields").write.json(f"{self.path}/part-{number:012d}")

    def replay(self) -> DataFrame:
        """All entries that can be read, unordered; broken lines are skipped."""
        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], ENTRY_SCHEMA)
        reader = self.spark.read.schema(ENTRY_SCHEMA).option("mode", "DROPMALFORMED")
        return reader.json([f"{self.path}/{p}" for p in parts]).where(F.col("op").isin(INDEX, DELETE) & F.col("doc_id").isNotNull())

    def truncate(self) -> None:
        """Forget all entries, after a snapshot holds them."""
        for part in self._parts():
            remove(self.spark, f"{self.path}/{part}")


def fold(entries: DataFrame) -> DataFrame:
    """The last entry of each document: ``doc_id, op, fields``."""
    return entries.groupBy("doc_id").agg(F.max_by(F.struct("op", "fields"), "seq").alias("e")).select("doc_id", "e.op", "e.fields")


def wide(entries: DataFrame, fields: list[str], vectors: tuple[str, ...] = ()) -> DataFrame:
    """Documents ``doc_id, <fields>, boost_<fields>`` of index entries."""
    columns = [F.col("doc_id")]
    for name in fields:
        field = F.col("fields").getItem(name)
        columns += [field["vector"].alias(name) if name in vectors else field["value"].alias(name), field["boost"].alias(f"boost_{name}")]
    return entries.where(F.col("op") == INDEX).select(*columns)


def entries_of(df: DataFrame, id_col: str, fields: list[str], seq: int, op: str = INDEX, vectors: tuple[str, ...] = (), boosts: dict[str, float] | None = None) -> DataFrame:
    """Log entries of wide rows."""
    boosts = boosts or {}
    pairs = []
    for name in fields if op == INDEX else []:
        value = F.lit(None).cast("string") if name in vectors else F.col(name).cast("string")
        vector = F.col(name).cast("array<double>") if name in vectors else F.lit(None).cast("array<double>")
        body = F.struct(value.alias("value"), F.lit(float(boosts.get(name, 1.0))).alias("boost"), vector.alias("vector"))
        pairs.append(F.struct(F.lit(name).alias("key"), F.when(F.col(name).isNotNull(), body).alias("value")))
    map_ = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())) if pairs else F.lit(None).cast(f"map<string,{FIELD_TYPE}>")
    return df.select(F.lit(seq).cast("bigint").alias("seq"), F.lit(op).alias("op"), F.col(id_col).cast("string").alias("doc_id"), map_.alias("fields"))
