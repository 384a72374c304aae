"""The driver contract: every query runs, and agrees with its DuckDB oracle."""

from __future__ import annotations

import os

import duckdb
import pytest

from sparklex import catalog, catalog_storage  # noqa: F401  (adds its queries)

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries compared here; the driver compares all.
SAMPLE = (
    "bm25_bool", "phrase2", "text_range", "regex_raw", "page_after", "agg_terms", "metrics", "fuzzy_1", "hybrid_05", "infer_types", "wal_fold",
    "postings_freq", "stored_index_fuzzy", "stored_index_agg", "phrase_control_chars", "upsert_repeated_ids", "regex_escapes", "number_codes", "float_codes", "schema_table", "json_codec",
    "struct_records", "store_contract", "store_compaction", "log_replay_broken_line", "snapshot_and_log", "delta_recover_engine", "periodic_snapshot", "streaming_ingest", "flush_and_compact",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the standard tables are not here")


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, FOLDER)
    got = sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())
    found = con.sql(catalog.ORACLES[name])
    places = [found.columns.index(c) for c in sorted(found.columns)]
    assert sorted(df.columns) == sorted(found.columns)
    assert got == sorted(tuple(str(r[i]) for i in places) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "score"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
