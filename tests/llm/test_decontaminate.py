from __future__ import annotations

import hashlib
import random
import re

import pytest

from sparklex.llm import decontaminate as d


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text, items):
    doc, hit, found = words(text), set(), set()
    for item_id, item in items:
        w = words(item)
        n = min(10, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for s in range(len(doc) - n + 1):
            if tuple(doc[s : s + n]) in windows:
                hit |= set(range(s, s + n))
                found.add(str(item_id))
    ids = sorted(found)
    return len(doc), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")


def compare(spark, docs, items, **options):
    got = sorted(tuple(r) for r in d.digests(d.scan(*tables(spark, docs, items), **options)).collect())
    assert got == sorted((i, *brute(t, items)) for i, t in docs)


@pytest.mark.parametrize("known", [d.MAX_KNOWN, 3])
def test_like_brute_force(spark, monkeypatch, known):
    monkeypatch.setattr(d, "MAX_KNOWN", known)
    rng = random.Random(2)
    some = lambda n, v: " ".join(rng.choice(v) for _ in range(n))
    many, few = [f"w{i}É" for i in range(300)], ["a", "b"]
    items = [(i, some(rng.randrange(0, 40), many)) for i in range(12)] + [(100, some(30, few)), (101, "a a a a a a a a a a a a"), (102, "solo"), (103, "two W5é"), (104, ""), (105, None)]
    docs = []
    for i in range(60):
        parts = [some(rng.randrange(0, 60), many)]
        for _ in range(rng.randrange(3)):
            w = words(rng.choice(items)[1])
            at = rng.randrange(len(w) + 1)
            parts.append(" ".join(w[at : at + rng.choice([9, 10, 11, 25])]))
            parts.append(some(rng.randrange(4), few))
        docs.append((i, "! ".join(parts)))
    docs += [(200, None), (201, ""), (202, "a " * 200), (203, some(300, few)), (204, "SOLO, two w5É")]
    compare(spark, docs, items)
    compare(spark, docs, items, broadcast_bytes=0)


def test_repeated_rows_and_empty_tables(spark, odd_docs, no_docs):
    item = [(1, "one two three"), (1, "one two three")]
    docs, items = tables(spark, [(1, "x one two three"), (1, "x one two three"), (1, "other")], item)
    assert sorted((r.n_words, r.n_hit, r.n_items) for r in d.digests(d.scan(docs, items)).collect()) == [(1, 0, 0), (4, 3, 1), (4, 3, 1)]
    assert d.digests(d.scan(no_docs, items)).collect() == [] and d.digests(d.scan(docs, items.limit(0))).where("contaminated").count() == 0
    assert d.scan(odd_docs, items).count() == odd_docs.count()
    kept = d.clean(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 2


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}])
def test_native(spark, options):
    docs, items = tables(spark, [(1, "a")], [(1, "a")])
    plan = d.scan(docs, items, **options)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


def test_a_passage_of_all_items(spark):
    """Items that share a passage are listed once, however many documents hold it."""
    passage = " ".join(f"w{i}" for i in range(14))
    items = [(i, f"{passage} own{i} end") for i in range(60)]
    docs = [(i, f"before {passage} after{i}") for i in range(30)] + [(100, "no such words"), (100, "no such words"), (101, f"{passage} {passage}")]
    for options in ({}, {"broadcast_bytes": 0}):
        compare(spark, docs, items, **options)
    _, windows, lists = d.benchmark_tables(spark.createDataFrame(items, "item_id bigint, text string"))
    assert lists.count() == 61 and windows.count() == 5 + 60 * 2


def test_documents_without_a_hit_are_in_no_join(spark):
    """In the form for large benchmarks no join has a null key on either side."""
    docs, items = tables(spark, [(i, "nothing shared here") for i in range(50)], [(1, "one two three")])
    plan = d.scan(docs, items, broadcast_bytes=0)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and sum("LeftOuter" in line for line in joins) == 1 and all("key_id" in line for line in joins if "LeftOuter" in line)
