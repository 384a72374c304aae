"""The engine: documents in, ranked, filtered and aggregated answers out.

The state of an engine is two lazy DataFrames (the source rows and their analysed
form) and a schema.  Every change makes new ones, so readers keep a consistent
snapshot.  ``merge_every`` changes deep, the lineage is cut by a checkpoint.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scoring import Bm25
from .functions.text import Analyzer
from .operators import aggregate as aggregates
from .operators import expand, index, vector
from .operators.filters import passes
from .operators.posting_search import StoredIndex, expand_postings, match_postings, prefix_postings
from .operators.search import SearchOptions, SearchResult, Totals, match_rows, present, search
from .plans.mapping import SKIP, TEXT, VECTOR, FieldMapping, Schema, infer_mapping
from .plans.query import Query
from .sources import documents
from .sources.change_log import DELETE, INDEX, ChangeLog, entries_of, fold, wide
from .sources.store import MemoryStore, checkpoint_folder, remove, subfolders


#: Bytes of input from which texts are worth spreading, and up to which each core may get.
SPREAD_FROM, SPREAD_TO = 1 << 20, 64 << 20


@dataclass(frozen=True)
class EngineConfig:
    """Settings of an engine.

    ``n_mode`` chooses what BM25 counts as a document: every indexed value
    ("field_instances") or every row ("documents").  ``merge_every`` bounds how
    many changes may stack up before a checkpoint; 0 never cuts.  ``store`` keeps
    every document as JSON; what it has and the snapshot lacks is indexed again when
    the engine starts.  ``snapshot_seconds`` is how often a snapshot is taken if
    anything has changed; 0 takes none by itself.
    """

    analyzer: Analyzer = Analyzer()
    bm25: Bm25 = Bm25()
    synonyms: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    mapping: Mapping[str, FieldMapping] = field(default_factory=dict)
    n_mode: str = "field_instances"
    merge_every: int = 10
    log_path: str | None = None
    snapshot_path: str | None = None
    snapshot_seconds: float = 0.0
    store: MemoryStore | None = None


class SearchEngine:
    """Search over DataFrames of documents."""

    def __init__(self, spark: SparkSession, config: EngineConfig = EngineConfig()):
        self.spark, self.config = spark, config
        self.schema = Schema()
        self.rows: DataFrame | None = None
        self.corpus: DataFrame | None = None
        self.stored_index: StoredIndex | None = None
        self.totals = Totals()
        self._changes = self._seq = self._saved_changes = 0
        self._lock, self._closed = threading.RLock(), threading.Event()
        self._log = ChangeLog(spark, config.log_path) if config.log_path else None
        if config.snapshot_path and subfolders(spark, config.snapshot_path):
            self._restore(config.snapshot_path)
        if config.store is not None:
            self._recover()
        if self._log:
            self._replay()
        self._timer = None
        if config.snapshot_seconds > 0 and config.snapshot_path:
            self._timer = threading.Thread(target=self._snapshot_now_and_then, daemon=True)
            self._timer.start()

    # -- writing ---------------------------------------------------------

    def index(self, df: DataFrame, id_col: str = "doc_id", boosts: Mapping[str, float] | None = None, check_ids: bool = True, latest_by: str | None = None) -> "SearchEngine":
        """Add the rows of ``df``, in place of documents with the same ids.

        Absent or empty ids are an error.  Of rows that repeat an id within ``df``
        one counts: that of the largest ``latest_by``, or if none is named, one that
        the rows' content picks.  ``check_ids=False`` says that the ids are known to
        be there and distinct, and saves a pass over them.
        """
        if check_ids and df.where(F.col(id_col).isNull() | (F.col(id_col).cast("string") == "")).take(1):
            raise ValueError("a document's id is empty")
        if latest_by:
            df = documents.latest(df, id_col, latest_by)
        elif check_ids:
            df = documents.distinct_keys(df, id_col)
        df = df.withColumnRenamed(id_col, "doc_id") if id_col != "doc_id" else df
        explicit = dict(self.config.mapping)
        schema = infer_mapping(df, "doc_id", explicit, self.schema)
        for name, boost in (boosts or {}).items():
            schema[name] = replace(schema[name], boost=float(boost))
        df = self._spread(df, schema)
        names, vectors = self._loggable(schema, df)
        with self._lock:
            if self._log:
                self._log.append(entries_of(df, "doc_id", names, self._next_seq(), INDEX, vectors, dict(boosts or {})))
            if self.config.store is not None:
                coded = documents.to_json(df, "doc_id", names, vectors, dict(boosts or {}))
                self.config.store.put(coded.select(F.col("doc_id").cast("string").alias("key"), F.col("json").alias("value")))
            self._add(df, schema)
        return self

    def _spread(self, df: DataFrame, schema: Schema) -> DataFrame:
        """A small input with texts, dealt out to all cores: it may lie in a single row group, which one task would analyse.

        Larger inputs have splits enough and stay where they are.
        """
        if not any(schema[c].type == TEXT and schema[c].index for c in df.columns if c in schema):
            return df
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores, "doc_id") if SPREAD_FROM < size <= cores * SPREAD_TO else df

    def _add(self, df: DataFrame, schema: Schema) -> None:
        self.schema = schema
        self._set_rows(df if self.rows is None else documents.upsert(self.rows, df, "doc_id"))

    def index_records(self, records: list, check_ids: bool = True) -> "SearchEngine":
        """Add dataclass instances, see :func:`documents.search_field`."""
        df, boosts = documents.from_records(self.spark, records)
        return self.index(df, boosts=boosts, check_ids=check_ids)

    def delete(self, *ids) -> "SearchEngine":
        """Remove documents by id."""
        if self.rows is None or not ids:
            return self
        kind = self.rows.schema["doc_id"].dataType.simpleString()
        keys = self.spark.createDataFrame([(i,) for i in ids], f"doc_id {kind}")
        return self.delete_all(keys)

    def delete_all(self, keys: DataFrame) -> "SearchEngine":
        """Remove the documents whose ids a DataFrame lists."""
        with self._lock:
            if self._log:
                self._log.append(entries_of(keys, "doc_id", [], self._next_seq(), DELETE))
            if self.config.store is not None:
                self.config.store.delete_all(keys.select(F.col("doc_id").cast("string").alias("key")))
            if self.rows is not None:
                self._set_rows(documents.delete(self.rows, keys, "doc_id"))
        return self

    def _loggable(self, schema: Schema, df: DataFrame) -> tuple[list[str], tuple[str, ...]]:
        names = [c for c in df.columns if c in schema and schema[c].type != SKIP]
        return names, tuple(c for c in names if schema[c].type == VECTOR)

    def _next_seq(self) -> int:
        self._seq += 1
        return self._seq

    def _set_rows(self, rows: DataFrame) -> None:
        self._changes += 1
        self.rows = rows
        if self.config.merge_every and self._changes % self.config.merge_every == 0:
            self.merge()
        self._analyse()

    def _analyse(self) -> None:
        self.stored_index, self.totals = None, Totals()
        self.corpus = index.analyse(self.rows, "doc_id", self.schema, self.config.analyzer)

    def merge(self) -> None:
        """Write the live rows to the checkpoint folder and go on from there."""
        checkpoint_folder(self.spark)
        self.rows = self.rows.checkpoint()

    def reindex(self, config: EngineConfig | None = None) -> "SearchEngine":
        """A new engine over the same documents, with other settings; this one stays as it is."""
        fresh = SearchEngine(self.spark, replace(config or self.config, log_path=None, snapshot_path=None, store=None))
        return fresh.index(self.rows, check_ids=False) if self.rows is not None else fresh

    # -- reading ---------------------------------------------------------

    def size(self) -> int:
        return 0 if self.rows is None else self.rows.count()

    def cache(self) -> "SearchEngine":
        """Keep the analysed form for the queries of this session."""
        self.corpus = self.corpus.persist()
        return self

    def _expanded(self, query: Query) -> Query:
        return query.with_synonyms(self.config.synonyms) if self.config.synonyms else query

    def search(self, query: Query, top_k: int = 0, options: SearchOptions = SearchOptions()) -> SearchResult:
        c = self.config
        if self.stored_index is not None and query.clauses:
            return self._search_stored(self._expanded(query), top_k, options)
        return search(self.corpus, self.schema, self._expanded(query), top_k, options, c.bm25, c.analyzer, c.n_mode, self.totals)

    def _n_rows(self) -> int | None:
        """Rows, if they are what BM25 counts."""
        return self.size() if self.config.n_mode == "documents" else None

    def _search_stored(self, query: Query, top_k: int, options: SearchOptions) -> SearchResult:
        """Search by the stored postings; documents are read for the rows that are left."""
        c = self.config
        hits = match_postings(self.stored_index, query, c.bm25, self._n_rows())
        limit = min([x for x in (top_k, options.size) if x > 0], default=0)
        plain = not (query.ranges or query.terms or query.regexes or options.sort or options.search_after)
        if plain and limit:
            hits = hits.orderBy(F.desc("score"), "doc_id").limit(options.from_ + limit)
        rows = self.corpus.where(passes(self.corpus, self.schema, query)).join(hits, "doc_id")
        return present(rows, self.corpus, self.schema, top_k, options, c.analyzer)

    def use_index(self, postings: DataFrame | None = None, field_stats: DataFrame | None = None, terms: DataFrame | None = None) -> "SearchEngine":
        """Answer clauses, term expansions and what builds on them from an inverted index of the current documents, until they change."""
        tables = (self.postings() if postings is None else postings, self.field_stats() if field_stats is None else field_stats, self.term_dictionary() if terms is None else terms)
        self.stored_index = StoredIndex(*tables, tuple(index.indexed_fields(self.corpus)))
        return self

    def fuzzy_search(self, field: str, term: str, max_distance: int, top_k: int = 0) -> DataFrame:
        c = self.config
        if self.stored_index is not None:
            return expand_postings(self.stored_index, field, expand.fuzzy_test(term, max_distance), top_k, c.bm25, self._n_rows())
        return expand.fuzzy(self.corpus, field, term, max_distance, top_k, c.bm25, c.n_mode, self.totals)

    def wildcard_search(self, field: str, pattern: str, top_k: int = 0) -> DataFrame:
        c = self.config
        if self.stored_index is not None:
            return expand_postings(self.stored_index, field, expand.wildcard_test(pattern), top_k, c.bm25, self._n_rows())
        return expand.wildcard(self.corpus, field, pattern, top_k, c.bm25, c.n_mode, self.totals)

    def prefix_search(self, field: str, prefix: str) -> DataFrame:
        if self.stored_index is not None:
            return prefix_postings(self.stored_index, field, prefix)
        return expand.prefix(self.corpus, field, prefix)

    def vector_search(self, field: str, vector_: list[float], top_k: int = 0) -> DataFrame:
        return vector.vector_search(self.corpus, field, vector_, top_k)

    def hybrid_search(self, query: Query, field: str, vector_: list[float], alpha: float, top_k: int = 0) -> DataFrame:
        return vector.hybrid(self._matches(query, rows=False).select("doc_id", "score"), self.vector_search(field, vector_), alpha, top_k)

    def _matches(self, query: Query, scored: bool = True, rows: bool = True) -> DataFrame:
        """The rows that match, or only their ids and scores; from the stored index if there is one."""
        c, query = self.config, self._expanded(query)
        if self.stored_index is None or not query.clauses:
            return match_rows(self.corpus, self.schema, query, c.bm25, c.n_mode, self.totals, scored)
        hits = match_postings(self.stored_index, query, c.bm25, self._n_rows())
        filtered = query.ranges or query.terms or query.regexes
        return self.corpus.where(passes(self.corpus, self.schema, query)).join(hits, "doc_id") if rows or filtered else hits

    def aggregate(self, query: Query, field: str, top_k: int = 0) -> DataFrame:
        """Counts of a field's values over matching documents; over all that pass the filters if there are no clauses."""
        rows = self._matches(query, scored=False) if query.clauses else self.corpus.where(passes(self.corpus, self.schema, query))
        return aggregates.terms_aggregation(self._only_stored(rows, field), field, top_k)

    def metrics(self, query: Query, field: str) -> DataFrame:
        """Count, sum, average, minimum and maximum of a field over matching documents."""
        return aggregates.metrics(self._only_stored(self._matches(query, scored=False), field), field)

    def _only_stored(self, rows: DataFrame, field: str) -> DataFrame:
        return rows if field in self.schema and self.schema[field].store else rows.drop(f"v_{field}")

    # -- index tables ----------------------------------------------------

    def postings(self) -> DataFrame:
        return index.postings(self.corpus)

    def term_dictionary(self) -> DataFrame:
        return index.term_dictionary(self.corpus)

    def field_stats(self) -> DataFrame:
        return index.field_stats(self.corpus)

    # -- persistence -----------------------------------------------------

    def save(self, path: str, with_index: bool = True) -> None:
        """Write a version of the documents, the schema, and the index tables under a path.

        Postings are laid out by field and ordered by term, so that a lookup
        reads few row groups; those of a common term may fill many files.  The
        dictionary is counted from them.  A version counts once its ``meta`` is written.
        """
        versions = subfolders(self.spark, path)
        version = f"{path}/v{(int(versions[-1][1:]) + 1) if versions else 0:012d}"
        self.rows.write.parquet(f"{version}/rows")
        if with_index and index.indexed_fields(self.corpus):
            self.postings().repartitionByRange("field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id").write.partitionBy("field").parquet(f"{version}/postings")
            terms = self._postings_of(version).groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
            terms.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.partitionBy("field").parquet(f"{version}/terms")
            self.field_stats().write.parquet(f"{version}/field_stats")
        meta = {"schema": {n: vars(m) for n, m in self.schema.items()}, "bm25": vars(self.config.bm25), "seq": self._seq}
        self.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.text(f"{version}/meta")

    def _postings_of(self, version: str) -> DataFrame:
        """Stored postings; their fields' names stay strings, whatever they look like."""
        columns = "term string, doc_id " + self.rows.schema["doc_id"].dataType.simpleString() + ", freq bigint, positions array<int>, length int, boost double, field string"
        return self.spark.read.schema(columns).parquet(f"{version}/postings")

    def snapshot(self) -> None:
        """Save to the configured path, then drop the change log that the version covers and older versions."""
        if not self.config.snapshot_path:
            raise ValueError("no snapshot path is configured")
        with self._lock:
            old = subfolders(self.spark, self.config.snapshot_path)
            self.save(self.config.snapshot_path)
            self._restore(self.config.snapshot_path)
            self._saved_changes = self._changes
            if self._log:
                self._log.truncate()
            for version in old:
                remove(self.spark, f"{self.config.snapshot_path}/{version}")

    def _snapshot_now_and_then(self) -> None:
        while not self._closed.wait(self.config.snapshot_seconds):
            with self._lock:
                if not self._closed.is_set() and self.rows is not None and self._changes != self._saved_changes:
                    self.snapshot()

    def is_saved(self) -> bool:
        """Does the last snapshot hold all changes?"""
        return self._changes == self._saved_changes

    def stop_snapshots(self) -> None:
        """End the periodic snapshots; one that is being taken is finished."""
        self._closed.set()
        if self._timer is not None:
            self._timer.join()

    def close(self) -> None:
        """Ends the periodic snapshots, takes a last one if a path is configured, and frees what is cached."""
        self.stop_snapshots()
        if self.config.snapshot_path and self.rows is not None:
            self.snapshot()
        if self.corpus is not None:
            self.corpus.unpersist()

    def _restore(self, path: str) -> None:
        complete = [v for v in subfolders(self.spark, path) if "meta" in subfolders(self.spark, f"{path}/{v}")]
        if not complete:
            return
        version = f"{path}/{complete[-1]}"
        meta = json.loads(self.spark.read.text(f"{version}/meta").first()[0])
        self.schema = Schema({n: FieldMapping(**{**m, "explicit": True}) for n, m in meta["schema"].items()})
        self.config = replace(self.config, bm25=Bm25(**meta["bm25"]))
        self._seq = meta["seq"]
        self.rows = self.spark.read.parquet(f"{version}/rows")
        self._analyse()
        if "postings" in subfolders(self.spark, version):
            terms = self.spark.read.schema("term string, df bigint, field string").parquet(f"{version}/terms")
            self.use_index(self._postings_of(version), self.spark.read.parquet(f"{version}/field_stats"), terms)

    @classmethod
    def load(cls, spark: SparkSession, path: str, config: EngineConfig = EngineConfig()) -> "SearchEngine":
        """An engine from the last complete version that was saved under a path."""
        if not subfolders(spark, path):
            raise FileNotFoundError(path)
        engine = cls(spark, replace(config, log_path=None, snapshot_path=None, store=None))
        engine._restore(path)
        return engine

    def _recover(self) -> None:
        """Index those documents of the store that the engine does not have."""
        coded = self.config.store.each()
        have = self.rows
        if have is not None:
            coded = coded.join(have.select(F.col("doc_id").cast("string").alias("key")), "key", "left_anti")
        found = documents.field_names(coded, "value")
        if not found:
            return
        vectors = tuple(n for n, is_vector in found.items() if is_vector)
        docs = documents.from_json(coded, "value", sorted(found), vectors)
        boosts = {n: docs.agg(F.max(f"boost_{n}")).first()[0] for n in found}
        docs = docs.drop(*(f"boost_{n}" for n in found))
        if have is not None:
            docs = docs.withColumn("doc_id", F.col("doc_id").cast(have.schema["doc_id"].dataType))
        schema = infer_mapping(docs, "doc_id", dict(self.config.mapping), self.schema)
        for name, boost in boosts.items():
            if boost is not None and boost != 1.0:
                schema[name] = replace(schema[name], boost=boost)
        self._add(docs, schema)

    def _replay(self) -> None:
        """Apply the change log on top of the snapshot."""
        entries = self._log.replay()
        last = entries.agg(F.max("seq")).first()[0]
        if last is None:
            return
        names = [r[0] for r in entries.select(F.explode(F.map_keys("fields"))).distinct().collect()]
        vectors = tuple(r[0] for r in entries.select(F.explode(F.map_filter("fields", lambda k, v: v["vector"].isNotNull())).alias("k", "v")).select("k").distinct().collect())
        changed = fold(entries)
        # Fields without a boost column keep their mapping; logged boosts are constant by field and batch.
        docs = wide(changed, sorted(names), vectors)
        boosts = [c for c in docs.columns if c.startswith("boost_") and c[6:] in names]
        log, self._log = self._log, None
        config, self.config = self.config, replace(self.config, store=None)
        if self.rows is not None:
            kind = self.rows.schema["doc_id"].dataType
            docs = docs.withColumn("doc_id", F.col("doc_id").cast(kind))
            self.delete_all(changed.select(F.col("doc_id").cast(kind).alias("doc_id")))
        known = {b[6:]: docs.agg(F.max(b)).first()[0] for b in boosts}
        self.index(docs.drop(*boosts), boosts={n: b for n, b in known.items() if b is not None}, check_ids=False)
        self._log, self._seq, self.config = log, last, config
