"""Registered queries of storage, recovery, streaming and the stored index.

They are added to those of :mod:`sparklex.catalog`.  What a query writes goes to a
folder of its own in the session's shared checkpoint folder.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import make_dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import _DOC_TOKENS, _METRIC_COLUMNS, _VECTOR, _bm25, _docs, _expansion_sql, _has, _hybrid_sql, _rounded, _scored, _table, _texts, _vectors, query
from .engine import EngineConfig, SearchEngine
from .functions.text import Analyzer, whitespace_tokenizer
from .functions.values import decode_float64, encode_float64
from .plans.mapping import FieldMapping
from .plans.query import Builder, Query
from .sources.change_log import ChangeLog, entries_of, fold, wide
from .sources.documents import search_field
from .sources.store import MemoryStore, ParquetStore, checkpoint_folder, subfolders
from .streaming.ingest import DocumentTable, MergePolicy, apply_batch, ingest, live

_PART = {"p_brand": FieldMapping("keyword"), "p_size": FieldMapping("integer")}
_WITHOUT_BIG = "SELECT p_brand AS key, count(*) AS count FROM (SELECT CASE WHEN p_size > 25 THEN 'big' ELSE p_brand END AS p_brand FROM part WHERE p_size <> 7) GROUP BY 1"


def _scratch(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/catalog-{uuid.uuid4().hex}"


def _brands(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_brand", "p_size")


def _write_brands(engine: SearchEngine, rows: DataFrame, between=lambda engine: None) -> SearchEngine:
    """Index all parts, then change some and delete others; ``between`` happens after the first step."""
    engine.index(rows, check_ids=False)
    between(engine)
    engine.index(rows.where("p_size > 25").withColumn("p_brand", F.lit("big")), check_ids=False)
    return engine.delete_all(rows.where("p_size = 7").select("doc_id"))


# -- the stored index ------------------------------------------------------------------


def _stored(engine: SearchEngine) -> SearchEngine:
    """The engine after a round trip through its saved form."""
    path = _scratch(engine.spark)
    engine.save(path)
    return SearchEngine.load(engine.spark, path, engine.config)


@query("stored_index_fuzzy", _expansion_sql("levenshtein(term, 'from') <= 1"))
def stored_index_fuzzy(spark, sf_dir):
    return _scored(_stored(_texts(spark, sf_dir)).fuzzy_search("text", "from", 1))


@query("stored_index_wildcard", _expansion_sql("regexp_matches(term, '^th.*ing$')"))
def stored_index_wildcard(spark, sf_dir):
    return _scored(_stored(_texts(spark, sf_dir)).wildcard_search("text", "th*ing"))


@query("stored_index_prefix", f"WITH {_DOC_TOKENS} SELECT doc_id, 0.0::double AS score FROM tok WHERE len(list_filter(t, lambda x: starts_with(x, 'wh'))) > 0")
def stored_index_prefix(spark, sf_dir):
    return _scored(_stored(_texts(spark, sf_dir)).prefix_search("text", "wh"))


@query("stored_index_hybrid", _hybrid_sql(0.5))
def stored_index_hybrid(spark, sf_dir):
    return _scored(_stored(_vectors(spark, sf_dir)).hybrid_search(Builder().must("text", "this").build(), "embedding", _VECTOR, 0.5, 40))


@query("stored_index_agg", f"WITH {_DOC_TOKENS} SELECT source AS key, count(*) AS count FROM tok JOIN documents USING (doc_id) WHERE {_has('in')} AND lang <> 'fr' GROUP BY source")
def stored_index_agg(spark, sf_dir):
    return _stored(_docs(spark, sf_dir)).aggregate(Builder().must("text", "in").must_not("lang", "fr").build(), "source")


@query("stored_index_metrics", f"WITH {_DOC_TOKENS} SELECT {_METRIC_COLUMNS} FROM (SELECT n_chars::double AS x FROM tok JOIN documents USING (doc_id) WHERE {_has('this')})")
def stored_index_metrics(spark, sf_dir):
    return _rounded(_stored(_docs(spark, sf_dir)).metrics(Builder().must("text", "this").build(), "n_chars"))


@query("segment_export", f"WITH {_DOC_TOKENS}, x AS (SELECT doc_id, 'text' AS field, unnest(t) AS term FROM tok UNION ALL SELECT doc_id, 'lang', lang FROM documents), p AS (SELECT field, term, doc_id, count(*) AS freq FROM x GROUP BY ALL) SELECT field, count(*) AS postings, count(DISTINCT term) AS terms, sum(freq)::bigint AS occurrences FROM p GROUP BY field")
def segment_export(spark, sf_dir):
    mapping = {"text": FieldMapping("text"), "lang": FieldMapping("keyword")}
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    stored = _stored(SearchEngine(spark, EngineConfig(mapping=mapping)).index(rows, check_ids=False)).stored_index
    counted = stored.postings.groupBy("field").agg(F.count(F.lit(1)).alias("postings"), F.sum("freq").alias("occurrences"))
    return counted.join(stored.terms.groupBy("field").agg(F.count(F.lit(1)).alias("terms")), "field")


# -- exactness at the edges -----------------------------------------------------------------


@query("phrase_control_chars", "WITH d AS (SELECT doc_id, lang || CASE WHEN doc_id % 3 = 0 THEN chr(1) WHEN doc_id % 3 = 1 THEN ' ' ELSE ' ' || chr(2) || ' ' END || source AS t FROM documents) SELECT doc_id FROM d WHERE contains(' ' || t || ' ', ' en src1 ')")
def phrase_control_chars(spark, sf_dir):
    between = F.when(F.col("doc_id") % 3 == 0, "\x01").when(F.col("doc_id") % 3 == 1, " ").otherwise(" \x02 ")
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.concat("lang", between, "source").alias("t"))
    engine = SearchEngine(spark, EngineConfig(analyzer=Analyzer(whitespace_tokenizer), mapping={"t": FieldMapping("text")})).index(rows, check_ids=False)
    return engine.search(Builder().phrase("t", "en", "src1").build()).hits.select("doc_id")


@query("upsert_repeated_ids", "SELECT event_type AS key, count(*) AS count FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY 1")
def upsert_repeated_ids(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    engine = SearchEngine(spark, EngineConfig(mapping={"event_type": FieldMapping("keyword"), "event_id": FieldMapping("integer")}))
    return engine.index(rows, "user_id", latest_by="event_id").aggregate(Query(), "event_type")


@query("upsert_repeated_ids_unordered", "SELECT count(DISTINCT user_id) AS size FROM events")
def upsert_repeated_ids_unordered(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("user_id", "event_type")
    engine = SearchEngine(spark, EngineConfig(mapping={"event_type": FieldMapping("keyword")})).index(rows, "user_id")
    return spark.createDataFrame([(engine.size(),)], "size bigint")


_PATTERNS = ((r"[-*+/]x|R\++", r"[-*+/]x|R\++"), (r"^\Qhttps://\E", r"^https://"), (r"//(?i)EXAMPLE\.(com|org)/[[:alpha:]]{2}/", r"//(?i:EXAMPLE\.(com|org)/[[:alpha:]]{2}/)"), (r"\x2fen\x2f\d{1,2}$", r"/en/[0-9]{1,2}$"), (r"\\1", r"\\1"))


@query("regex_escapes", " UNION ALL ".join(f"SELECT {i} AS pattern, page_id FROM pages WHERE regexp_matches(url, '{sql}')" for i, (_, sql) in enumerate(_PATTERNS)))
def regex_escapes(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").select("page_id", "url", F.lit(1).alias("one"))
    engine = SearchEngine(spark, EngineConfig(mapping={"url": FieldMapping("keyword")})).index(rows, "page_id", check_ids=False)
    parts = [engine.search(Builder().range("one", gte=0).regex("url", p).build()).hits.select(F.lit(i).alias("pattern"), F.col("doc_id").alias("page_id")) for i, (p, _) in enumerate(_PATTERNS)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("float_codes", "SELECT c_custkey, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal - 4000) AS place, c_acctbal - 4000 AS decoded FROM customer")
def float_codes(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", encode_float64(F.col("c_acctbal") - 4000).alias("code"))
    place = F.dense_rank().over(Window.partitionBy("c_nationkey").orderBy("code"))
    return rows.select("c_custkey", place.cast("bigint").alias("place"), decode_float64(F.col("code")).alias("decoded"))


# -- records, stores, the change log ---------------------------------------------------------


@query("struct_records", "SELECT n_nationkey::varchar AS doc_id, n_name AS name FROM nation WHERE n_regionkey IN (1, 2)")
def struct_records(spark, sf_dir):
    kind = make_dataclass("Nation", [("key", str, search_field(is_id=True)), ("name", str, search_field("name", boost=2.0)), ("region", str, search_field("region")), ("note", str)])
    records = [kind(str(r.n_nationkey), r.n_name, str(r.n_regionkey), "not searched") for r in _table(spark, sf_dir, "nation").collect()]
    engine = SearchEngine(spark, EngineConfig(mapping={"name": FieldMapping("text"), "region": FieldMapping("keyword")})).index_records(records)
    hits = engine.search(Builder().should("region", "1").should("region", "2").build()).hits
    return hits.select("doc_id", F.col("fields")["name"].alias("name"))


@query("engine_size", "SELECT count(*) AS size FROM part WHERE p_size <> 7")
def engine_size(spark, sf_dir):
    engine = _write_brands(SearchEngine(spark, EngineConfig(mapping=_PART)), _brands(spark, sf_dir))
    return spark.createDataFrame([(engine.size(),)], "size bigint")


_STORE_SQL = "SELECT event_id::varchar AS key, CASE WHEN value >= 50 THEN 'high' ELSE event_type END AS value FROM events WHERE event_type <> 'error'"


def _fill(store: MemoryStore, events: DataFrame) -> MemoryStore:
    """Put all events, put some again with another value, and delete others."""
    key = F.col("event_id").cast("string").alias("key")
    store.put(events.select(key, F.col("event_type").alias("value")))
    store.put(events.where("value >= 50").select(key, F.lit("high").alias("value")))
    store.delete_all(events.where("event_type = 'error'").select(key))
    return store


@query("memory_store", _STORE_SQL)
def memory_store(spark, sf_dir):
    return _fill(MemoryStore(spark), _table(spark, sf_dir, "events")).each()


@query("log_store", _STORE_SQL)
def log_store(spark, sf_dir):
    return _fill(ParquetStore(spark, _scratch(spark)), _table(spark, sf_dir, "events")).each()


@query("object_store", _STORE_SQL)
def object_store(spark, sf_dir):
    """The log store under a path with a scheme, as that of an object store."""
    path = _scratch(spark)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    path = fs.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(path)).toString()
    _fill(ParquetStore(spark, path), _table(spark, sf_dir, "events"))
    return ParquetStore(spark, path).each()


@query("store_contract", f"WITH s AS ({_STORE_SQL}), one AS (SELECT min(event_id)::varchar AS key FROM events), k(kind) AS (VALUES ('memory'), ('parquet')) SELECT kind, (SELECT count(*) FROM s) AS size, (SELECT count(*) > 0 FROM s JOIN one USING (key)) AS has, coalesce((SELECT value FROM s JOIN one USING (key)), '') AS got, 0::bigint AS cleared FROM k")
def store_contract(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    key = str(events.agg(F.min("event_id")).first()[0])
    rows = []
    for store in (MemoryStore(spark), ParquetStore(spark, _scratch(spark))):
        _fill(store, events)
        seen = (store.kind, store.size(), store.has(key), store.get(key) or "")
        store.clear()
        rows.append((*seen, store.size()))
        store.close()
    return spark.createDataFrame(rows, "kind string, size bigint, has boolean, got string, cleared bigint")


@query("store_compaction", f"SELECT value, count(*) AS n, 1::bigint AS batches FROM ({_STORE_SQL}) GROUP BY value")
def store_compaction(spark, sf_dir):
    path = _scratch(spark)
    store = _fill(ParquetStore(spark, path), _table(spark, sf_dir, "events"))
    store.compact()
    return store.each().groupBy("value").agg(F.count(F.lit(1)).alias("n")).withColumn("batches", F.lit(len(subfolders(spark, path))).cast("bigint"))


def _logged(spark, sf_dir) -> ChangeLog:
    """A log of all parts, changes and deletes, with a line that breaks off."""
    rows, path = _brands(spark, sf_dir), _scratch(spark)
    log = ChangeLog(spark, path)
    log.append(entries_of(rows, "doc_id", ["p_brand"], 1))
    log.append(entries_of(rows.where("p_size > 25").withColumn("p_brand", F.lit("big")), "doc_id", ["p_brand"], 2))
    log.append(entries_of(rows.where("p_size = 7"), "doc_id", [], 3, "delete"))
    spark.createDataFrame([('{"seq": 4, "op": "index", "doc_id": "1", "fie',)], "line string").coalesce(1).write.text(f"{path}/part-{3:012d}")
    return log


@query("log_append", "SELECT 1::bigint AS seq, 'index' AS op, count(*) AS n FROM part UNION ALL SELECT 2, 'index', count(*) FROM part WHERE p_size > 25 UNION ALL SELECT 3, 'delete', count(*) FROM part WHERE p_size = 7")
def log_append(spark, sf_dir):
    return _logged(spark, sf_dir).replay().groupBy("seq", "op").agg(F.count(F.lit(1)).alias("n"))


@query("log_replay_broken_line", "SELECT p_partkey::varchar AS doc_id, CASE WHEN p_size > 25 THEN 'big' ELSE p_brand END AS p_brand FROM part WHERE p_size <> 7")
def log_replay_broken_line(spark, sf_dir):
    return wide(fold(_logged(spark, sf_dir).replay()), ["p_brand"]).select("doc_id", "p_brand")


@query("log_truncate", "SELECT n_nationkey::varchar AS doc_id FROM nation")
def log_truncate(spark, sf_dir):
    log = _logged(spark, sf_dir)
    log.truncate()
    log.append(entries_of(_table(spark, sf_dir, "nation"), "n_nationkey", ["n_name"], 5))
    return log.replay().select("doc_id")


# -- snapshots and recovery -------------------------------------------------------------------


@query("save_load", f"WITH {_DOC_TOKENS} SELECT doc_id, round({_bm25('from')}, 6) AS score FROM tok WHERE {_has('from')} AND NOT {_has('er')}")
def save_load(spark, sf_dir):
    return _scored(_stored(_texts(spark, sf_dir)).search(Builder().must("text", "from").must_not("text", "er").build()).hits)


@query("load_without_index", "SELECT p_brand AS key, count(*) AS count FROM part GROUP BY 1")
def load_without_index(spark, sf_dir):
    path = _scratch(spark)
    SearchEngine(spark, EngineConfig(mapping=_PART)).index(_brands(spark, sf_dir), check_ids=False).save(path, with_index=False)
    return SearchEngine.load(spark, path).aggregate(Query(), "p_brand")


@query("snapshot_and_log", _WITHOUT_BIG)
def snapshot_and_log(spark, sf_dir):
    """A restart after a snapshot: it is loaded, and the log replayed on top of it."""
    path = _scratch(spark)
    config = EngineConfig(mapping=_PART, log_path=f"{path}/log", snapshot_path=f"{path}/snapshots")
    _write_brands(SearchEngine(spark, config), _brands(spark, sf_dir), lambda engine: engine.snapshot())
    return SearchEngine(spark, config).aggregate(Query(), "p_brand")


@query("replay_into_engine", _WITHOUT_BIG)
def replay_into_engine(spark, sf_dir):
    """A restart without any snapshot: the log alone."""
    config = EngineConfig(mapping=_PART, log_path=f"{_scratch(spark)}/log")
    _write_brands(SearchEngine(spark, config), _brands(spark, sf_dir))
    return SearchEngine(spark, config).aggregate(Query(), "p_brand")


@query("delta_recover_engine", "SELECT p_brand AS key, count(*) AS count FROM part GROUP BY 1")
def delta_recover_engine(spark, sf_dir):
    """A restart with a snapshot of half the documents, and a store that has them all."""
    path, rows = _scratch(spark), _brands(spark, sf_dir)
    config = EngineConfig(mapping=_PART, snapshot_path=f"{path}/snapshots", store=ParquetStore(spark, f"{path}/store"))
    engine = SearchEngine(spark, config).index(rows.where("p_size <= 25"), check_ids=False)
    engine.snapshot()
    engine.index(rows.where("p_size > 25"), check_ids=False)
    return SearchEngine(spark, config).aggregate(Query(), "p_brand")


@query("periodic_snapshot", _WITHOUT_BIG)
def periodic_snapshot(spark, sf_dir):
    """What an engine that was never closed has saved by itself."""
    path = f"{_scratch(spark)}/snapshots"
    engine = _write_brands(SearchEngine(spark, EngineConfig(mapping=_PART, snapshot_path=path, snapshot_seconds=0.2)), _brands(spark, sf_dir))
    for _ in range(600):
        if engine.is_saved():
            break
        time.sleep(0.2)
    engine.stop_snapshots()
    return SearchEngine.load(spark, path).aggregate(Query(), "p_brand")


@query("close_saves", _WITHOUT_BIG)
def close_saves(spark, sf_dir):
    path = f"{_scratch(spark)}/snapshots"
    _write_brands(SearchEngine(spark, EngineConfig(mapping=_PART, snapshot_path=path)), _brands(spark, sf_dir)).close()
    return SearchEngine.load(spark, path).aggregate(Query(), "p_brand")


@query("merge_policy", _WITHOUT_BIG)
def merge_policy(spark, sf_dir):
    """Every second change cuts the lineage; the documents stay what they are."""
    return _write_brands(SearchEngine(spark, EngineConfig(mapping=_PART, merge_every=2)), _brands(spark, sf_dir)).aggregate(Query(), "p_brand")


# -- streaming ------------------------------------------------------------------------------------

_OPS_SQL = "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'"


def _op_log(spark, sf_dir) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").otherwise("index")
    return _table(spark, sf_dir, "events").select(op.alias("op"), F.col("event_id").alias("seq"), "user_id", "event_type", "value")


@query("streaming_ingest", _OPS_SQL)
def streaming_ingest(spark, sf_dir):
    """An op-log read as a stream, in two runs of the same query, and the table it leaves."""
    path, ops = _scratch(spark), _op_log(spark, sf_dir)
    for half in (0, 1):
        ops.where(F.col("seq") % 2 == half).write.mode("append").parquet(f"{path}/in")
        ingest(spark.readStream.schema(ops.schema).parquet(f"{path}/in"), f"{path}/table", f"{path}/progress", "user_id").awaitTermination()
    return live(DocumentTable(spark, f"{path}/table", "user_id").read()).select("user_id", "event_type", "value")


@query("flush_and_compact", _OPS_SQL)
def flush_and_compact(spark, sf_dir):
    """Batches in any order, one of them tried twice, folded every second batch."""
    ops = _op_log(spark, sf_dir)
    table = DocumentTable(spark, _scratch(spark), "user_id")
    for number, rest in enumerate((2, 0, 1, 1)):
        apply_batch(table, ops.where(F.col("seq") % 3 == rest), min(number, 2), MergePolicy(max_batches=2))
    return live(table.read()).select("user_id", "event_type", "value")


@query("flush_by_bytes", _OPS_SQL)
def flush_by_bytes(spark, sf_dir):
    """Every batch is over the bound, so each is folded at once."""
    ops = _op_log(spark, sf_dir)
    table = DocumentTable(spark, _scratch(spark), "user_id")
    for number in range(3):
        apply_batch(table, ops.where(F.col("seq") % 3 == number), number, MergePolicy(0, 1))
    return live(table.read()).select("user_id", "event_type", "value")
