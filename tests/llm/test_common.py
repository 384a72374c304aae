"""Joins that keep hot keys apart, slices, the shared folder."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sparklex.llm import common


@pytest.mark.parametrize("hot_keys", [1, 3, 1000])
def test_split_join_is_a_join(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
    left = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 5), (3, 1), (4, 1)) for i in range(n)], "k long, i long")
    right = spark.createDataFrame([(1, "a", 50), (2, "b", 5), (3, "c", 1), (5, "d", 9)], "k long, v string, n long")
    plain = sorted(tuple(r) for r in left.join(right.drop("n"), "k").collect())
    assert sorted(tuple(r) for r in common.split_join(left, right, ["k"], "n").collect()) == plain
    semi = sorted(tuple(r) for r in left.join(right, "k", "left_semi").collect())
    assert sorted(tuple(r) for r in common.split_join(left, right, ["k"], "n", "left_semi").collect()) == semi


def test_split_join_of_empty_tables(spark):
    left, right = spark.createDataFrame([], "k long, i long"), spark.createDataFrame([], "k long, v string, n long")
    assert common.split_join(left, right, ["k"], "n").columns == ["k", "i", "v"]
    assert common.split_join(left, right, ["k"], "n").count() == 0


def test_batches_and_slices_are_bounded_by_bytes(spark):
    """Whatever a row count allows, a worker gets few bytes at once; a row is never cut."""
    schema = StructType([StructField("rows", LongType()), StructField("bytes", LongType())])

    def turn(batch):
        texts = batch.column(0).to_pylist()
        return {"rows": [len(texts)] * len(texts), "bytes": [sum(map(len, texts))] * len(texts)}

    df = spark.range(60, numPartitions=1).select(F.repeat(F.lit("x"), 1_000_000).alias("t")).unionByName(spark.range(2).select(F.repeat(F.lit("x"), 6_000_000).alias("t")))
    found = common.map_slices(df, lambda: turn, schema).collect()
    assert len(found) == 62 and all(r.bytes <= common.SLICE_BYTES or r.rows == 1 for r in found)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= common.BATCH_BYTES


def test_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n if n else None for n in (1, common.SLICE_BYTES, 0, 5, 5, common.SLICE_BYTES - 5, 1)])], names=["t"])
    assert list(common.slices(batch)) == [(0, 1), (1, 3), (3, 5), (5, 7)]
    many = pa.RecordBatch.from_arrays([pa.array(range(1500))], names=["n"])
    assert list(common.slices(many)) == [(0, 512), (512, 1024), (1024, 1500)] and list(common.slices(many.slice(0, 0))) == []


def test_a_cluster_needs_a_shared_folder():
    """Without a checkpoint folder a single machine takes the warehouse; a cluster refuses."""

    class Context:
        def __init__(self, master):
            self.master, self.folder = master, None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        def __init__(self, master, **conf):
            self.sparkContext, self.conf = Context(master), {"spark.sql.warehouse.dir": "w", **conf}

    assert common.shared_folder(Session("local[2]")) == "w/_checkpoints"
    assert common.shared_folder(Session("spark://x", **{"spark.checkpoint.dir": "hdfs://c"})) == "hdfs://c"
    for master in ("spark://x", "local-cluster[3,2,1000]", "yarn"):
        with pytest.raises(ValueError):
            common.shared_folder(Session(master))


def test_only_small_tables_in_few_files_are_spread(spark, tmp_path, monkeypatch):
    rows = spark.range(2000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t"))
    for files in (1, 8):
        rows.repartition(files).write.parquet(str(tmp_path / f"{files}.parquet"))
    plan = lambda name: common.table(spark, str(tmp_path), name)._jdf.queryExecution().toString()
    assert "Repartition" not in plan("1") and "Repartition" not in plan("8")
    monkeypatch.setattr(common, "SPREAD_FROM", 0)
    assert "Repartition" in plan("1") and "Repartition" not in plan("8")
    assert sorted(common.table(spark, str(tmp_path), "1").collect()) == sorted(rows.collect())
    monkeypatch.setattr(common, "SPREAD_TO", 1)
    assert "Repartition" not in plan("1")
