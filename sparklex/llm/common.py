"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows, and bytes of strings, that a worker turns at once; a batch is cut into pieces of this size, but a row is never cut.
SLICE_ROWS = 512
SLICE_BYTES = 4 << 20
#: Bytes that the JVM hands a worker at once, unless the session asks for less; both sides hold such a batch several times over.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a table from which it is worth spreading, and up to which each core may get.
SPREAD_FROM, SPREAD_TO = 1 << 20, 16 << 20
#: A key with more than one row in this many is hot; no table has more hot keys than this.
HOT_KEYS = 1000
#: Keys that a sketch of frequent ones tracks; its error stays below half of a hot key's rows.
SKETCH_KEYS = 8192
#: Groups of tasks whose sketches are merged first.
SKETCH_GROUPS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the standard Parquet tables, read through Spark's own readers."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """A small table in fewer files than there are cores, dealt out to all of them; any other as it is.

    Such a file may be a single row group, which one task would work on alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if SPREAD_FROM < size <= cores * SPREAD_TO else df


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``, which is made the session's checkpoint folder.

    Where neither the session nor its context names one, a single machine takes a
    folder under the warehouse; on a cluster that is an error, since the warehouse
    may be a folder of the driver's own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder under any path that Hadoop can open."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: StructType) -> DataFrame:
    """Arrow map over the rows of ``df`` in small slices.

    ``make`` runs once in each task and returns the function that turns a slice
    into a dictionary of columns, so vocabularies and caches live as long as the
    task.  Memory follows the slice, in rows and in bytes, not the partition.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(schema)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = make()
        for batch in batches:
            for start, end in slices(batch):
                columns = turn(batch.slice(start, end - start))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[field.name], type=field.type) for field in arrow_schema], schema=arrow_schema
                )

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches from now on; a row is never cut."""
    given = spark.conf.get(_BATCH_SETTING)
    if int("".join(filter(str.isdigit, given))) > BATCH_BYTES or not given.rstrip("b").isdigit():
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)


def slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Where to cut a batch: at most ``SLICE_ROWS`` rows and ``SLICE_BYTES`` bytes of strings, or one row."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        end = max(start + 1, min(start + SLICE_ROWS, int(np.searchsorted(total, before + SLICE_BYTES, "right"))))
        yield start, min(end, batch.num_rows)
        start = end


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, under fixed names."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def row_key(id_col: str | Column, text_col: str | Column) -> list:
    """Two 64-bit hashes that stand for a row by its id and text (nulls included)."""
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    return [F.xxhash64(id_col, F.lit(11)).alias("key_id"), F.xxhash64(text, F.length(text), F.lit(12)).alias("key_text")]


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it was counted and has at most ``max_rows`` rows, else as it is.

    Give it a narrow table that is cheap to count (a checkpoint or a stored one).
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def split_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """Join by ``keys`` where some of them may hold a large share of ``left``.

    ``right`` has each key once and, in ``rows``, at least as many rows as ``left`` has of it.  Keys above one in
    ``HOT_KEYS`` of the sum of ``rows`` (or of ``total``, which must not be less) are fewer than ``HOT_KEYS``; they
    are broadcast, so their rows stay where they are, and all others are joined by shuffle.  ``rows`` is not
    returned.  ``how`` is inner or left_semi; both sides are read more than once.
    """
    if total is None:
        total = right.agg(F.sum(rows)).first()[0] or 0
    hot, rest = right.where(F.col(rows) * HOT_KEYS > total).drop(rows), right.where(F.col(rows) * HOT_KEYS <= total).drop(rows)
    others = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(hot), keys, how).unionByName(others.join(rest, keys, how))


def hot_keys(df: DataFrame, key: str) -> list[int]:
    """The keys (longs) of ``df`` with more than one in ``HOT_KEYS`` of its rows, and perhaps a few others; at most ``HOT_KEYS``.

    Found by frequent-item sketches of a fixed size, one for each task, which are merged in two steps.  They tell how
    to deal rows out, never what a result holds.
    """
    sketches = df.groupBy((F.spark_partition_id() % SKETCH_GROUPS).alias("g")).agg(F.expr(f"approx_top_k_accumulate({key}, {SKETCH_KEYS})").alias("s"))
    top = sketches.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(s, {SKETCH_KEYS})").alias("s")).select(F.expr(f"approx_top_k_estimate(s, {HOT_KEYS})").alias("top"))
    row = top.first()  # none without rows
    found = sorted((r["count"], r["item"]) for r in (row.top if row and row.top else []) if r["item"] is not None)
    return [item for _, item in found[-HOT_KEYS:]]


def split_by_heat(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of hot keys, and all others, whose keys each fit in a task."""
    keys = hot_keys(df, key)
    if not keys:
        return df.where(F.lit(False)), df
    return df.where(F.col(key).isin(*keys)), df.where(~F.col(key).isin(*keys))
