"""Stores, the change log, the JSON codec and streaming ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparklex.sources.change_log import ChangeLog, entries_of, fold, wide
from sparklex.sources.documents import from_json, latest, to_json, upsert
from sparklex.sources.store import MemoryStore, ParquetStore
from sparklex.streaming.ingest import DocumentTable, MergePolicy, apply_batch, ingest, live


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, value string")


def check_store(spark, store):
    store.put(pairs(spark, ("a", "1"), ("b", "2")))
    store.put(pairs(spark, ("a", "3")))
    store.delete("b")
    assert store.get("a") == "3" and store.get("b") is None and store.has("a") and not store.has("b")
    store.compact()
    assert [tuple(r) for r in store.each().collect()] == [("a", "3")] and store.size() == 1
    store.clear()
    assert store.size() == 0


def test_memory_store(spark):
    check_store(spark, MemoryStore(spark))


def test_parquet_store(spark, tmp_path):
    check_store(spark, ParquetStore(spark, str(tmp_path / "s")))


def test_unfinished_batches_are_not_read(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "s"))
    store.put(pairs(spark, ("a", "1")))
    (tmp_path / "s/batch-000000000001").mkdir()
    assert store.size() == 1
    assert ParquetStore(spark, str(tmp_path / "s")).get("a") == "1"


def test_change_log(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"))
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "doc_id string, body string")
    assert log.replay().count() == 0
    log.append(entries_of(rows, "doc_id", ["body"], 1, boosts={"body": 2.0}))
    log.append(entries_of(rows.where("doc_id = '1'"), "doc_id", [], 2, "delete"))
    folder = tmp_path / "log/part-000000000000"
    for checksum in folder.glob(".*.crc"):  # of the file as it was
        checksum.unlink()
    with open(next(folder.glob("part*")), "a") as f:
        f.write('{"seq": 3, "op": "ind')
    last = {r.doc_id: r.op for r in fold(log.replay()).collect()}
    assert last == {"1": "delete", "2": "index"}
    assert [tuple(r) for r in wide(fold(log.replay()), ["body"]).collect()] == [("2", "b", 2.0)]
    log.truncate()
    assert log.replay().count() == 0


def test_json_codec(spark):
    rows = spark.createDataFrame([("1", "x", [1.0, 2.0]), ("2", None, None)], "doc_id string, body string, e array<double>")
    coded = to_json(rows, "doc_id", ["body", "e"], ("e",), {"body": 3.0})
    back = from_json(coded, "json", ["body", "e"], ("e",)).orderBy("doc_id").collect()
    assert (back[0].body, back[0].boost_body, back[0].e) == ("x", 3.0, [1.0, 2.0]) and back[1].body is None
    assert from_json(spark.createDataFrame([("{broken",)], "json string"), "json", ["body"]).count() == 0


def test_latest_and_upsert(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, seq int, v string")
    assert {r.k: r.v for r in latest(rows, "k", "seq").collect()} == {"a": "y", "b": "z"}
    merged = upsert(rows.where("seq = 1"), rows.where("seq = 2"), "k")
    assert {r.k: r.v for r in merged.collect()} == {"a": "y", "b": "z"}


def test_streaming_ingest(spark, tmp_path):
    schema = "op string, seq bigint, doc_id string, body string"
    source = str(tmp_path / "in")

    def feed(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(schema).json(source)
        ingest(stream, str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()

    feed(("index", 1, "a", "one"), ("index", 2, "b", "two"))
    feed(("index", 3, "a", "new"), ("delete", 4, "b", None), ("index", 0, "a", "late"))
    rows = live(DocumentTable(spark, str(tmp_path / "table")).read()).collect()
    assert [(r.doc_id, r.body) for r in rows] == [("a", "new")]
    feed(("index", 5, "c", "three"))
    assert live(DocumentTable(spark, str(tmp_path / "table")).read()).select(F.count(F.lit(1))).first()[0] == 2


def test_batches_are_appended_and_folded(spark, tmp_path):
    """A batch writes its own rows alone; folding keeps the newest entries and forgets old deletes."""
    schema = "op string, seq bigint, doc_id string, body string"
    table = DocumentTable(spark, str(tmp_path / "t"), tombstone_span=10)
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    apply_batch(table, batch(("index", 1, "a", "one"), ("index", 2, "a", "two"), ("delete", 3, "b", None)), 0)
    apply_batch(table, batch(("index", 40, "c", "far")), 1)
    assert table.depth() == 2 and spark.read.parquet(str(tmp_path / "t/batch-000000000000")).count() == 2
    table.compact()
    assert table.depth() == 0 and {r.doc_id: r.op for r in table.read().collect()} == {"a": "index", "c": "index"}
    apply_batch(table, batch(("index", 1, "a", "again")), 1)  # tried again after it was folded
    assert table.depth() == 0
    apply_batch(table, batch(("index", 0, "a", "late"), ("delete", 41, "c", None)), 2, MergePolicy(1))
    assert [(r.doc_id, r.body) for r in live(table.read()).collect()] == [("a", "two")]
    apply_batch(table, batch(("index", 50, "d", "new")), 3, MergePolicy(0, 1 << 30))
    assert table.depth() == 1 and 0 < table.bytes() < 1 << 20
    apply_batch(table, batch(("index", 51, "d", "newer")), 4, MergePolicy(0, 1))
    assert table.depth() == 0


def test_memory_store_cuts_its_lineage(spark, monkeypatch):
    monkeypatch.setattr(MemoryStore, "CUT_EVERY", 3)
    store = MemoryStore(spark)
    for i in range(7):
        store.put(pairs(spark, (f"k{i % 4}", str(i))))
    assert sorted(map(tuple, store.each().collect())) == [("k0", "4"), ("k1", "5"), ("k2", "6"), ("k3", "3")]
    assert store.each()._jdf.queryExecution().logical().toString().count("Join") <= 2
