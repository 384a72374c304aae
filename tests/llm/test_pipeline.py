"""The pipeline against a plain version of its stages, and its queries on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from sparklex.llm.registry import ORACLES, QUERIES

from .test_decontaminate import brute as hits
from .test_line_dedup import brute as without_lines
from .test_near_duplicates import brute as classes

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the standard tables are not here")


def test_stages_like_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before = None
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(number)))
        after = spark.read.parquet(str(tmp_path / str(number)))
        rows = {r.doc_id: getattr(r, "text", None) for r in after.collect()}
        if number < 4:
            assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if number == 0:
            assert 0 < len(rows) < docs.count()
        elif number == 1:
            assert rows == without_lines(list(before.items()), passage_docs=3)
        elif number == 2:
            assert set(rows) == {c for c, *_ in classes(list(before.items())).values()}
        elif number == 3:
            assert set(rows) == {i for i, t in before.items() if not hits(t, items)[4]}
        else:
            assert set(rows) == set(before)
        docs, before = after, rows


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/{'pages' if name.startswith('op7') else 'documents'}.parquet").count()
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "benchmark", "pages"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        found = con.sql(ORACLES[name])
        columns = sorted(df.columns)
        places = [found.columns.index(c) for c in columns]
        assert sorted(tuple(str(r[c]) for c in columns) for r in rows) == sorted(tuple(str(r[i]) for i in places) for r in found.fetchall())


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, key_id string, d_text string, text_key string"


@pytest.fixture
def tables(spark, tmp_path):
    """A folder with a benchmark and labels, nulls among them, and one where both are empty."""
    benchmark = spark.createDataFrame([(1, "a passage of the benchmark with twelve words in it that documents hold"), (None, "null item words"), (2, None), (3, "")], "item_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, None), (None, 0, 1), (8, 1, 0)], "doc_id bigint, quality int, toxic int")
    for name, cut in (("some", 99), ("none", 0)):
        benchmark.limit(cut).write.parquet(str(tmp_path / name / "benchmark.parquet"))
        labels.limit(cut).write.parquet(str(tmp_path / name / "labels.parquet"))
    return tmp_path


def odd(spark):
    long = " ".join(f"word{i % 991} and" for i in range(40_000))
    words = "some words that stand in a line of their own here"
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, f"{words}\nfirst one", "en", "a", 9), (3, f"{words}\nfirst one", "en", "a", 9), (3, f"{words}\nanother text under the id", "en", None, 9),
        (None, f"{words}\nno id", None, "b", 9), (None, f"{words}\nno id", None, "b", 9), (5, long, "fr", "b", 1), (6, long + " end", "fr", "b", 1),
        (7, "here is a passage of the benchmark with twelve words in it that documents hold", "en", "a", 1), (8, "\n\n \t", "en", "a", 1), (9, "it says null item words too", "en", "a", 1),
    ]
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], SCHEMA)


def stage_by_stage(spark, docs, sf_dir, tmp_path):
    out = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"out{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if number < 4:
            assert spark.read.parquet(path).schema.fieldNames() == docs.columns
        docs = spark.read.parquet(path)
        out.append(sorted(((r.doc_id, getattr(r, "text", None)) for r in docs.collect()), key=str))
    return out


def test_stages_bear_odd_rows(spark, tables, tmp_path):
    docs = odd(spark)
    given = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    kept = stage_by_stage(spark, docs, str(tables / "some"), tmp_path)
    assert kept[0] == given
    words = "some words that stand in a line of their own here"
    # Four documents hold the line: that of the null id comes first and keeps it, once for each of its rows.
    cut = [(i, t if i is None or not t else t.removeprefix(words + "\n")) for i, t in given]
    assert kept[1] == sorted(cut, key=str)
    once = sorted({pair for pair in cut if pair[0] != 6}, key=str)
    assert kept[2] == once
    assert kept[3] == [pair for pair in once if pair[0] not in (7, 9)]
    assert [i for i, _ in kept[4]] == sorted((i for i, _ in kept[3]), key=str)


def test_stages_bear_empty_tables(spark, tables, tmp_path):
    given = sorted(((r.doc_id, r.text) for r in odd(spark).collect()), key=str)
    kept = stage_by_stage(spark, odd(spark), str(tables / "none"), tmp_path / "a")
    assert kept[0] == given and len(kept[3]) == len(kept[2])
    assert stage_by_stage(spark, odd(spark).limit(0), str(tables / "some"), tmp_path / "b") == [[]] * 5


def test_intermediate_tables_are_deleted(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "shared")
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda session: folder)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", lambda s, d, f: d.limit(5)), ("b", lambda s, d, f: d), ("c", lambda s, d, f: d)])
    assert corpus_pipeline.run(spark, FOLDER).count() == 5
    (run,) = os.listdir(folder)
    assert os.listdir(f"{folder}/{run}") == ["2"]


def test_two_copies_reach_the_next_stage_whole(spark, tables, tmp_path):
    """Long lines that only two documents share stay for the near-duplicate stage, which drops one of the two."""
    text = "\n".join(" ".join(f"w{a}{i}" for i in range(60)).replace("0", "o").replace("1", "l").translate({ord(str(d)): chr(97 + d) for d in range(2, 10)}) for a in "abc")
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, text + "\nend", "en", "s", len(text) + 4), (3, "alone", "en", "s", 5)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = stage_by_stage(spark, docs, str(tables / "none"), tmp_path)
    assert [i for i, _ in kept[1]] == [1, 2, 3] and kept[1][1][1] == text + "\nend" and [i for i, _ in kept[2]] == [1, 3]
