"""The engine through its public interface, on small corpora."""

from __future__ import annotations

import time
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from sparklex.engine import EngineConfig, SearchEngine
from sparklex.functions.scoring import Bm25
from sparklex.functions.text import Analyzer, whitespace_tokenizer
from sparklex.operators.search import Cursor, SearchOptions, Sort, sort_by
from sparklex.plans.mapping import FieldMapping
from sparklex.plans.query import Builder, Query
from sparklex.sources.documents import search_field
from sparklex.sources.store import ParquetStore

TEXT = {"body": FieldMapping("text"), "title": FieldMapping("text")}


def engine_of(spark, rows, schema, **config):
    return SearchEngine(spark, EngineConfig(**{"mapping": TEXT, **config})).index(spark.createDataFrame(rows, schema))


def bodies(spark, *texts, **config):
    return engine_of(spark, [(str(i + 1), t) for i, t in enumerate(texts)], "doc_id string, body string", **config)


def ids(hits):
    return [r.doc_id for r in hits.collect()]


def priced(spark, *prices, **config):
    mapping = TEXT | {"price": FieldMapping("float")}
    return engine_of(spark, [(str(i + 1), "item", p) for i, p in enumerate(prices)], "doc_id string, body string, price string", **{"mapping": mapping, **config})


@pytest.fixture(scope="module")
def blog(spark):
    rows = [
        ("1", "go concurrency", "goroutines are light", "go"),
        ("2", "go tools", "the goroutines make go fast", "go"),
        ("3", "python data", "frames and notebooks", "python"),
        ("4", "rust safety", "ownership rules", "rust"),
    ]
    mapping = TEXT | {"title": FieldMapping("text", boost=2.0), "category": FieldMapping("keyword")}
    return engine_of(spark, rows, "doc_id string, title string, body string, category string", mapping=mapping)


def test_boolean_clauses(blog):
    assert set(ids(blog.search(Builder().must("title", "go").build()).hits)) == {"1", "2"}
    assert ids(blog.search(Builder().must("body", "goroutines").must_not("title", "tools").build()).hits) == ["1"]
    assert ids(blog.search(Builder().phrase("body", "goroutines", "make go").build()).hits) == ["2"]
    assert set(ids(blog.search(Builder().should("title", "python").should("title", "rust").build()).hits)) == {"3", "4"}
    assert ids(blog.search(Builder().must_not("title", "go").build()).hits) == []
    assert ids(blog.search(Query()).hits) == []
    assert ids(blog.search(Builder().must("title", "Go").build()).hits) == []
    assert ids(blog.search(Builder().must("missing", "go").build()).hits) == []


def test_must_hits_are_should_hits(blog):
    must, should = (set(ids(blog.search(getattr(Builder(), kind)("body", "goroutines").build()).hits)) for kind in ("must", "should"))
    assert must <= should


def test_facets(spark, blog):
    assert [tuple(r) for r in blog.aggregate(Query(), "category").collect()] == [("go", 2), ("python", 1), ("rust", 1)]
    assert [tuple(r) for r in blog.aggregate(Builder().must("title", "go").build(), "category", 1).collect()] == [("go", 2)]
    assert blog.aggregate(Query(), "missing").collect() == []


def test_ranking(spark):
    assert ids(bodies(spark, "go is a language", "go go go").search(Builder().must("body", "go").build()).hits) == ["2", "1"]
    flat = bodies(spark, "go go go go go", "go", bm25=Bm25(k1=0.0)).search(Builder().must("body", "go").build()).hits.collect()
    assert flat[0].score == pytest.approx(flat[1].score)
    once, twice = (b.search(q).hits.first().score for b, q in ((bodies(spark, "go"), Builder().must("body", "go").build()), (bodies(spark, "go"), Builder().must("body", "go").should("body", "go").build())))
    assert twice == pytest.approx(2 * once)


def test_top_k_is_a_prefix(spark):
    e, q = bodies(spark, "a b", "a a b", "b a c d", "a"), Builder().must("body", "a").build()
    assert ids(e.search(q, 2).hits) == ids(e.search(q).hits)[:2]


def test_ranges(spark):
    e = priced(spark, "10", "50", "100", "200", None)
    assert set(ids(e.search(Builder().range("price", 10, 100).build()).hits)) == {"1", "2", "3"}
    assert set(ids(e.search(Builder().must("body", "item").range("price", gt=50).build()).hits)) == {"3", "4"}
    assert ids(priced(spark, "5.0", "5.1", "4.9").search(Builder().range("price", gt=5.0).build()).hits) == ["2"]


def test_terms_and_regexes(spark):
    mapping = TEXT | {"status": FieldMapping("keyword"), "n": FieldMapping("integer")}
    e = engine_of(spark, [("1", "active", 1), ("2", "archived", 1), ("3", None, 1)], "doc_id string, status string, n int", mapping=mapping)
    base = lambda: Builder().range("n", gte=0)
    assert ids(e.search(base().terms("status", "active", "gone").build()).hits) == ["1"]
    assert ids(e.search(base().terms("status").build()).hits) == []
    assert set(ids(e.search(base().regex("status", "^a").build()).hits)) == {"1", "2"}
    assert ids(e.search(base().regex("status", "(").build()).hits) == []
    assert ids(e.search(Builder().terms("status", "active").build()).hits) == []


def test_sorting(spark):
    e, q = priced(spark, "30", "10", "20", None), Builder().must("body", "item").build()
    assert ids(e.search(q, 0, sort_by("price")).hits) == ["2", "3", "1", "4"]
    assert ids(e.search(q, 0, sort_by("price", "desc")).hits) == ["1", "3", "2", "4"]
    assert ids(priced(spark, "9", "10").search(q, 0, sort_by("price")).hits) == ["1", "2"]


def test_pages_join_to_the_whole(spark):
    e, q = priced(spark, "10", "20", "30", "40", "50", None), Builder().must("body", "item").build()
    assert ids(e.search(q, 0, SearchOptions(sort=(Sort("price"),), from_=2, size=2)).hits) == ["3", "4"]
    assert ids(e.search(q, 0, SearchOptions(sort=(Sort("price"),), from_=99)).hits) == []
    seen, cursor = [], None
    for _ in range(4):
        page = e.search(q, 0, SearchOptions(sort=(Sort("price", "desc"),), size=2, search_after=cursor))
        seen += ids(page.hits)
        cursor = page.next_cursor()
        if cursor is None:
            break
    assert seen == ids(e.search(q, 0, sort_by("price", "desc")).hits) == ["5", "4", "3", "2", "1", "6"]
    assert ids(e.search(q, 0, SearchOptions(sort=(Sort("price"),), search_after=Cursor("1", "none"))).hits) == []
    assert e.search(q).next_cursor() is None


def test_metrics(spark):
    q = Builder().must("body", "item").build()
    assert tuple(priced(spark, "10", "20", "30").metrics(q, "price").first()) == (3, 60.0, 20.0, 10.0, 30.0)
    mapping = TEXT | {"price": FieldMapping("keyword")}
    assert tuple(priced(spark, "10", "N/A", mapping=mapping).metrics(q, "price").first()) == (1, 10.0, 10.0, 10.0, 10.0)
    assert tuple(priced(spark, "10").metrics(Query(), "price").first()) == (0, 0.0, 0.0, 0.0, 0.0)


def test_term_expansion(spark):
    e = bodies(spark, "go is fast", "golang rocks", "python routine")
    assert ids(e.fuzzy_search("body", "goo", 1)) == ["1"]
    assert ids(e.fuzzy_search("body", "xyz", 1)) == []
    assert set(ids(e.wildcard_search("body", "go*"))) == {"1", "2"}
    assert ids(e.wildcard_search("body", "*outine")) == ["3"]
    assert ids(e.wildcard_search("body", "g?")) == ["1"]
    assert ids(e.prefix_search("body", "go")) == ["1", "2"]
    assert ids(e.prefix_search("body", "")) == ["1", "2", "3"]
    assert ids(e.prefix_search("missing", "go")) == []


def test_vectors_and_hybrid(spark):
    rows = [("1", "go", [1.0, 0.0]), ("2", "java", [0.9, 0.1]), ("3", "go go", [-1.0, 0.0]), ("4", "rust", None)]
    e = engine_of(spark, rows, "doc_id string, body string, e array<double>", mapping=TEXT | {"e": FieldMapping("vector")})
    assert ids(e.vector_search("e", [1.0, 0.0])) == ["1", "2"]
    assert ids(e.vector_search("e", [1.0])) == []
    q = Builder().must("body", "go").build()
    assert ids(e.hybrid_search(q, "e", [1.0, 0.0], 1.0)) == ids(e.search(q).hits)
    assert ids(e.hybrid_search(q, "e", [1.0, 0.0], 0.0)) == ["1", "2"]
    assert set(ids(e.hybrid_search(q, "e", [1.0, 0.0], 0.5))) == {"1", "2", "3"}


def test_highlights(spark):
    e, q = bodies(spark, "Go is fast and  Go is simple", "foo-bar bar1"), Builder().must("body", "go").build()
    row = e.search(q, 0, SearchOptions(highlight=True)).hits.first()
    assert [tuple(h) for h in row.highlights] == [("body", "<em>Go</em> is fast and <em>Go</em> is simple")]
    row = e.search(Builder().must("body", "bar").build(), 0, SearchOptions(highlight=True, markers=("**", "**"))).hits.first()
    assert row.highlights[0].snippet == "foo-bar **bar1**"
    assert e.search(q).hits.first().highlights == []


def test_synonyms(spark):
    e = bodies(spark, "a car", "an automobile", "a bike", synonyms={"car": ("automobile",)})
    assert set(ids(e.search(Builder().must("body", "car").build()).hits)) == {"1", "2"}
    assert set(ids(e.search(Builder().should("body", "bike").must_not("body", "car").build()).hits)) == {"3"}
    assert ids(e.search(Builder().phrase("body", "a", "car").build()).hits) == ["1"]
    assert ids(e.search(Builder().must("body", "car").regex("body", "^an").build()).hits) == ["2"]


def test_lifecycle(spark):
    e = bodies(spark, "golang is fast")
    e.index(spark.createDataFrame([("1", "python is flexible")], "doc_id string, body string"))
    assert e.size() == 1 and ids(e.search(Builder().must("body", "golang").build()).hits) == []
    e.delete("1")
    assert e.size() == 0 and ids(e.search(Builder().must("body", "python").build()).hits) == []
    with pytest.raises(ValueError):
        e.index(spark.createDataFrame([("", "x")], "doc_id string, body string"))


@dataclass
class Article:
    key: str = search_field(is_id=True)
    headline: str = search_field("title", boost=2.0)
    body: str = search_field()
    draft: bool = False


@dataclass
class NoId:
    body: str = search_field()


def test_records(spark):
    e = SearchEngine(spark, EngineConfig(mapping=TEXT)).index_records([Article("1", "go now", "text"), Article("2", "", "go now")])
    assert ids(e.search(Builder().should("title", "go").should("body", "go").build()).hits) == ["1", "2"]
    for bad in ([NoId("x")], [Article("", "a", "b")], [Article("1", "a", 5)], ["text"], []):
        with pytest.raises((TypeError, ValueError)):
            SearchEngine(spark).index_records(bad)


def test_inferred_mapping_is_sticky(spark):
    e = SearchEngine(spark).index(spark.createDataFrame([("1", "42", "laptop")], "doc_id string, n string, w string"))
    assert (e.schema["n"].type, e.schema["w"].type) == ("integer", "keyword")
    assert ids(e.search(Builder().must("w", "laptop").build()).hits) == ["1"]
    e.index(spark.createDataFrame([("2", "some words here", "desk")], "doc_id string, n string, w string"))
    assert e.schema["n"].type == "text"
    assert ids(e.search(Builder().must("n", "words").build()).hits) == ["2"]


def test_mappings(spark):
    mapping = {"a": FieldMapping("text", store=False), "b": FieldMapping("keyword", index=False), "c": FieldMapping("skip")}
    e = engine_of(spark, [("1", "red fox", "x", "y")], "doc_id string, a string, b string, c string", mapping=mapping)
    assert e.search(Builder().must("a", "fox").build()).hits.first().fields == {"b": "x"}
    assert ids(e.search(Builder().must("b", "x").build()).hits) == []
    assert ids(e.search(Builder().must("c", "y").build()).hits) == []


def test_save_load_and_reindex(spark, tmp_path):
    e = bodies(spark, "Go fast", "go slow", bm25=Bm25(1.5, 0.5))
    e.save(str(tmp_path / "i"))
    back = SearchEngine.load(spark, str(tmp_path / "i"), EngineConfig(mapping=TEXT))
    q = Builder().must("body", "go").build()
    assert [tuple(r)[:3] for r in back.search(q).hits.collect()] == [tuple(r)[:3] for r in e.search(q).hits.collect()]
    assert back.stored_index is not None
    phrase = Builder().phrase("body", "go", "slow").regex("body", "^go").build()
    assert ids(back.search(phrase).hits) == ids(e.search(phrase).hits) == ["2"]
    plan = back.search(q).hits._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,go)" in plan or "In(term, [go])" in plan
    stored = spark.read.parquet(str(tmp_path / "i/v000000000000/postings"))
    assert stored.where("field = 'body' and term = 'go'").count() == 2
    exact = e.reindex(EngineConfig(mapping=TEXT, analyzer=Analyzer(whitespace_tokenizer)))
    assert ids(exact.search(Builder().must("body", "Go").build()).hits) == ["1"]
    with pytest.raises(FileNotFoundError):
        SearchEngine.load(spark, str(tmp_path / "none"))


def test_log_and_snapshot_recover(spark, tmp_path):
    config = EngineConfig(mapping=TEXT, log_path=str(tmp_path / "log"), snapshot_path=str(tmp_path / "snap"))
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id string, body string")
    e = SearchEngine(spark, config).index(rows(("1", "one red"), ("2", "two red")))
    e.snapshot()
    e.index(rows(("2", "two blue"), ("3", "three red")))
    e.delete("1")
    again = SearchEngine(spark, config)
    assert set(ids(again.search(Builder().must("body", "red").build()).hits)) == {"3"}
    assert set(ids(again.search(Builder().must("body", "blue").build()).hits)) == {"2"}
    again.close()
    assert SearchEngine(spark, config).size() == 2


def test_plans(spark, tmp_path):
    """A search shuffles nothing before its top rows, and its range reaches the scan."""
    spark.range(100).select(F.col("id").alias("doc_id"), F.lit("go now").alias("body"), (F.col("id") * 1.0).alias("price")).write.parquet(str(tmp_path / "t"))
    e = SearchEngine(spark, EngineConfig(mapping=TEXT | {"price": FieldMapping("float")})).index(spark.read.parquet(str(tmp_path / "t")), check_ids=False)
    hits = e.search(Builder().must("body", "go").range("price", gte=10).build(), 5).hits
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    assert "GreaterThanOrEqual(price,10.0)" in plan


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_postings_shuffle_nothing(spark):
    engine = bodies(spark, "b a b", "a", "", None)
    postings = engine.postings()
    assert "Exchange" not in plan_of(postings)
    rows = sorted(postings.select("term", "doc_id", "freq", "positions", "length").collect())
    assert list(map(tuple, rows)) == [("a", "1", 1, [1], 3), ("a", "2", 1, [0], 1), ("b", "1", 2, [0, 2], 3)]


def test_a_stored_index_is_all_that_is_read(spark, tmp_path):
    """Clauses, expansions, hybrid search and facets after load() give the same and read no text."""
    mapping = TEXT | {"category": FieldMapping("keyword"), "v": FieldMapping("vector")}
    rows = [(str(i), f"go golang word{i % 3} " + "of " * i, "abc"[i % 3], [1.0, float(i)]) for i in range(12)]
    engine = engine_of(spark, rows, "doc_id string, body string, category string, v array<double>", mapping=mapping)
    engine.save(str(tmp_path / "i"))
    loaded = SearchEngine.load(spark, str(tmp_path / "i"))
    q = Builder().must("body", "word1").build()
    asked = (
        lambda e: e.fuzzy_search("body", "golan", 1),
        lambda e: e.wildcard_search("body", "wor?0"),
        lambda e: e.prefix_search("body", "word"),
        lambda e: e.hybrid_search(q, "v", [1.0, 2.0], 0.5),
        lambda e: e.aggregate(q, "category"),
        lambda e: e.metrics(q, "category"),
    )
    for ask in asked:
        assert [tuple(r) for r in ask(loaded).collect()] == [tuple(r) for r in ask(engine).collect()]
        scans = [line for line in plan_of(ask(loaded)).splitlines() if "ReadSchema" in line and "/rows" in line]
        assert not any("body" in line for line in scans), scans


def test_statistics_are_gathered_once_and_only_for_scores(spark, monkeypatch):
    engine = priced(spark, "1", "2")
    passes = []
    original = type(engine.corpus).agg
    monkeypatch.setattr(type(engine.corpus), "agg", lambda self, *a: (passes.append(1), original(self, *a))[1])
    engine.search(Builder().phrase("body", "item").build())
    engine.aggregate(Builder().must("body", "item").build(), "price")
    assert not passes
    for _ in range(3):
        engine.search(Builder().must("body", "item").build())
    assert len(passes) == 1
    engine.index(spark.createDataFrame([("3", "item", "3")], "doc_id string, body string, price string"))
    engine.search(Builder().must("body", "item").build())
    assert len(passes) == 2


def test_ids_repeated_in_one_call_count_once(spark):
    rows = [("1", "go", 1), ("1", "rust", 2), ("2", "go", 1)]
    df = spark.createDataFrame(rows, "doc_id string, body string, at int")
    engine = SearchEngine(spark, EngineConfig(mapping=TEXT)).index(df, latest_by="at")
    assert engine.size() == 2 and ids(engine.search(Builder().must("body", "go").build()).hits) == ["2"]
    assert SearchEngine(spark, EngineConfig(mapping=TEXT)).index(df).size() == 2
    assert sorted(map(str, SearchEngine(spark, EngineConfig(mapping=TEXT)).index(df).rows.collect())) == sorted(map(str, SearchEngine(spark, EngineConfig(mapping=TEXT)).index(df.repartition(3)).rows.collect()))


def test_snapshots_by_interval(spark, tmp_path):
    config = EngineConfig(mapping=TEXT, snapshot_path=str(tmp_path / "s"), snapshot_seconds=0.05)
    engine = SearchEngine(spark, config).index(spark.createDataFrame([("1", "go")], "doc_id string, body string"))
    for _ in range(200):
        if engine.is_saved():
            break
        time.sleep(0.1)
    assert SearchEngine.load(spark, str(tmp_path / "s")).size() == 1
    engine.index(spark.createDataFrame([("2", "rust")], "doc_id string, body string"))
    engine.close()
    assert SearchEngine.load(spark, str(tmp_path / "s")).size() == 2


def test_documents_of_the_store_are_recovered(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "d"))
    config = EngineConfig(mapping=TEXT, snapshot_path=str(tmp_path / "s"), store=store)
    engine = SearchEngine(spark, config).index(spark.createDataFrame([("1", "go")], "doc_id string, body string"))
    engine.snapshot()
    engine.index(spark.createDataFrame([("2", "rust"), ("3", "zig")], "doc_id string, body string"))
    engine.delete("3")
    again = SearchEngine(spark, config)
    assert again.size() == 2 and ids(again.search(Builder().must("body", "rust").build()).hits) == ["2"]


def test_small_texts_are_spread_and_filters_still_reach_the_scan(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "d.parquet")
    spark.range(500).select("id", F.concat(F.lit("go "), F.col("id").cast("string")).alias("body"), (F.col("id") % 50).alias("price")).coalesce(1).write.parquet(path)
    mapping = TEXT | {"price": FieldMapping("integer")}
    make = lambda: SearchEngine(spark, EngineConfig(mapping=mapping)).index(spark.read.parquet(path), "id", check_ids=False)
    query = Builder().must("body", "go").range("price", gte=40, lt=42).build()
    plain = [tuple(r) for r in make().search(query).hits.collect()]
    assert "Repartition" not in plan_of(make().corpus)
    monkeypatch.setattr("sparklex.engine.SPREAD_FROM", 0)
    engine = make()
    assert "Repartition" in plan_of(engine.corpus) and [tuple(r) for r in engine.search(query).hits.collect()] == plain and len(plain) == 20
    hits = engine.search(query).hits
    assert all(name in hits._jdf.queryExecution().executedPlan().toString() for name in ("GreaterThanOrEqual(price,40)", "LessThan(price,42)"))
    monkeypatch.setattr("sparklex.engine.SPREAD_TO", 1)
    assert "Repartition" not in plan_of(make().corpus)


def test_bounds_on_whole_numbers(spark):
    rows = [(str(i), "item", n) for i, n in enumerate([-5, 0, 3, 4, 1 << 60, None])]
    engine = engine_of(spark, rows, "doc_id string, body string, n bigint", mapping=TEXT | {"n": FieldMapping("integer")})
    find = lambda **bounds: [int(i) for i in sorted(ids(engine.search(Builder().range("n", **bounds).build()).hits))]
    assert find(gte=2.5, lte=4) == [2, 3] and find(gt=3, lt=4.5) == [3] and find(gt=2.5, lt=3.5) == [2] and find(lt=-0.5) == [0]
    assert find(gte=float("-inf")) == find(lte=1e30) == find(gte=-5) == [0, 1, 2, 3, 4] and find(gt=1e30) == find(lt=float("-inf")) == find(gte=float("nan")) == []
