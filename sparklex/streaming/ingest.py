"""Streaming ingestion: an op-log in, an up-to-date table of documents out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import finished, remove, stored_bytes, subfolders

#: How far behind the newest sequence number a late entry may come and still not bring a deleted document back.
TOMBSTONE_SPAN = 1 << 20


@dataclass(frozen=True)
class MergePolicy:
    """When batches are folded into one: that many of them, or of that many bytes together; 0 sets no bound."""

    max_batches: int = 16
    max_bytes: int = 0


class DocumentTable:
    """A log of batches ``op, seq, <key>, <columns>`` under a path: a base, and what came after it.

    A batch is only ever appended.  Compaction folds the base and all batches into
    a new base, named by the last batch in it, and then removes what that holds.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", tombstone_span: int = TOMBSTONE_SPAN):
        self.spark, self.path, self.key, self.tombstone_span = spark, path, key, tombstone_span

    def _numbers(self, kind: str) -> list[int]:
        names = [n for n in subfolders(self.spark, self.path) if n.startswith(f"{kind}-") and finished(self.spark, f"{self.path}/{n}")]
        return sorted(int(n.rpartition("-")[2]) for n in names)

    def _folder(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}-{number:012d}"

    def _parts(self) -> tuple[int, list[int]]:
        """The base's number, -1 without one, and those of the batches after it."""
        base = max(self._numbers("base"), default=-1)
        return base, [n for n in self._numbers("batch") if n > base]

    def read(self) -> DataFrame | None:
        """The last entry of each key, deletes included; None before the first batch."""
        base, batches = self._parts()
        paths = ([self._folder("base", base)] if base >= 0 else []) + [self._folder("batch", n) for n in batches]
        if not paths:
            return None
        rows = self.spark.read.option("mergeSchema", True).parquet(*paths)
        return rows if not batches else latest_entries(rows, self.key)

    def append(self, batch: DataFrame, number: int) -> None:
        """Write a batch under its number; one that is tried again is written over."""
        if number > self._parts()[0]:
            latest_entries(batch, self.key).write.mode("overwrite").parquet(self._folder("batch", number))

    def depth(self) -> int:
        """Batches that a read folds."""
        return len(self._parts()[1])

    def bytes(self) -> int:
        """Stored bytes of the batches that a read folds."""
        return sum(stored_bytes(self.spark, self._folder("batch", n)) for n in self._parts()[1])

    def compact(self) -> None:
        """Fold all batches into the base, without deletes that lie ``tombstone_span`` behind the newest entry."""
        base, batches = self._parts()
        if not batches:
            return
        rows = self.read()
        newest = rows.agg(F.max("seq")).first()[0]
        rows.where((F.col("op") != "delete") | (F.col("seq") > newest - self.tombstone_span)).write.mode("overwrite").parquet(self._folder("base", batches[-1]))
        for old in [self._folder("base", base)] * (base >= 0) + [self._folder("batch", n) for n in batches]:
            remove(self.spark, old)


def latest_entries(rows: DataFrame, key: str) -> DataFrame:
    """The entry of the largest ``seq`` of each key."""
    return rows.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*rows.columns), "seq").alias("r")).select("r.*")


def apply_batch(table: DocumentTable, batch: DataFrame, number: int, policy: MergePolicy = MergePolicy()) -> None:
    """Append a batch of ``op, seq, <columns>``: the last entry of each key wins, deletes remove it.

    The sequence number stays in the table, so late entries do not undo newer ones.
    What a batch costs depends on its own rows; the table is folded when the policy says so.
    """
    table.append(batch, number)
    if (policy.max_batches and table.depth() >= policy.max_batches) or (policy.max_bytes and table.bytes() >= policy.max_bytes):
        table.compact()


def ingest(op_log: DataFrame, path: str, checkpoint: str, key: str = "doc_id", interval: str | None = None, policy: MergePolicy = MergePolicy()) -> StreamingQuery:
    """Start folding a stream of ``op, seq, <key>, <columns>`` into the table at ``path``.

    ``interval`` is how often a batch is taken; without it all that is there is
    taken and the query ends.
    """
    table = DocumentTable(op_log.sparkSession, path, key)
    writer = op_log.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: apply_batch(table, batch, number, policy))
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def live(table: DataFrame) -> DataFrame:
    """The documents of a table that :func:`ingest` keeps, without deleted ones."""
    return table.where(F.col("op") != "delete").drop("op", "seq")
