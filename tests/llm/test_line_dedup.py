from __future__ import annotations

import random
import time
from collections import defaultdict

from pyspark.sql import functions as F

from sparklex.llm import common
from sparklex.llm import line_dedup as ld


def kinds(line):
    """Every (token count, pattern) a line fits, told from the docstring alone: fields with a digit and up to two of four stretches are free."""
    words = line.split()
    n = len(words)
    fixed = [None if any(c.isdigit() for c in w) else w for w in words]
    if n < 5 and not any(fixed):
        fixed = words
    place = [max(j for j in range(4) if n * j // 4 <= t) for t in range(n)]
    free = [set()]
    if n >= 8:
        free += [{j} for j in range(4)]
    if n >= 16:
        free += [{i, j} for i in range(4) for j in range(i)]
    return {(n, tuple(None if place[t] in f else w for t, w in enumerate(fixed))) for f in free} if words else set()


def brute(docs, min_docs=3, passage_docs=2):
    """Texts with recurring lines removed, by the definition."""
    seen, first = defaultdict(set), {}
    for i, text in sorted(docs):
        for n, line in enumerate((text or "").split("\n")):
            for t in kinds(line):
                seen[t].add(i)
                first.setdefault(t, (i, n))
    need = lambda t: passage_docs if t[0] > 50 else min_docs
    out = {}
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [line for n, line in enumerate(lines) if not any(len(seen[t]) >= need(t) and first[t] != (i, n) for t in kinds(line))]
        out[i] = None if text is None else "\n".join(kept)
    return out


def test_like_brute_force(spark):
    rng = random.Random(3)
    line = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    fixed = [line(n) for n in (1, 3, 4, 5, 9, 16, 20, 40, 51, 70)]
    docs = []
    for i in range(60):
        lines = [line(rng.randrange(0, 30)) for _ in range(rng.randrange(6))]
        for f in rng.sample(fixed, 4):
            w = f.split()
            if rng.random() < 0.5 and len(w) > 8:
                for _ in range(rng.randrange(1, 4)):
                    w[rng.randrange(len(w))] = rng.choice(["x", "id77", "٣"])
            lines.insert(rng.randrange(len(lines) + 1), " ".join(w))
        docs.append((i, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, "\n".join([fixed[2]] * 3))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    assert {r.doc_id: r.text for r in ld.dedup(df).collect()} == brute(docs)
    report = {r.doc_id: r for r in ld.dedup(df, report=True).collect()}
    assert report[100].n_lines == 0 and report[101].n_lines == 1 and report[102].n_dropped >= 2


def test_hot_keys_are_dealt_apart(spark, monkeypatch):
    """Leaves and templates found to be hot, all or some, change nothing in the result."""
    rng = random.Random(4)
    words = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    lines = [" ".join(rng.choice(words) for _ in range(n)) for n in (2, 6, 9, 18, 60)]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(7)))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    wanted = brute(docs)
    for hot in (lambda d, key: [r[0] for r in d.select(key).distinct().collect()], lambda d, key: [], lambda d, key: sorted(r[0] for r in d.select(key).distinct().collect())[::2]):
        monkeypatch.setattr(common, "hot_keys", hot)
        assert {r.doc_id: r.text for r in ld.dedup(df).collect()} == wanted


def test_hot_keys_are_found(spark):
    keys = spark.range(60_000, numPartitions=9).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 400 == 1, 8).otherwise(F.xxhash64("id")).cast("long").alias("k"))
    assert {7, 8} <= set(common.hot_keys(keys, "k")) and len(common.hot_keys(keys, "k")) <= common.HOT_KEYS
    assert common.hot_keys(keys.where("k = 0"), "k") == []


def test_a_long_text_takes_linear_time(spark):
    text = "\n".join(["same line"] * 60_000 + [f"line {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} {'x' * (i // 676)}" for i in range(60_000)])
    df = spark.createDataFrame([(i, text) for i in range(3)], "doc_id bigint, text string")
    began = time.perf_counter()
    out = {r.doc_id: r.text for r in ld.dedup(df).collect()}
    assert out == {0: brute([(0, text), (1, text), (2, text)])[0], 1: "", 2: ""} and time.perf_counter() - began < 60


def test_variable_fields(spark):
    rows = [(i, f"Posted by user number {i} on this site today\nown text of document {'abc'[i]} stays here") for i in range(3)]
    text = {r.doc_id: r.text for r in ld.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert text[0] == rows[0][1] and text[1] == "own text of document b stays here"


def test_short_lines(spark):
    rows = [(i, f"All rights reserved.\nPage {i}\n{i}00\n\nOwn line {'abc'[i]}") for i in range(3)]
    text = {r.doc_id: r.text for r in ld.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert text == {0: rows[0][1], 1: "100\n\nOwn line b", 2: "200\n\nOwn line c"}


def test_fields_of_words(spark):
    """One field in a line of 8 tokens, its first token, and two fields far apart in a longer one."""
    names = ["anna", "bert", "carl"]
    long = [f"w{c}" for c in "abcdefghijklmnopqrst"]
    rows = [(i, f"{n} has shared this page with all friends\n{' '.join([n, *long[1:10], n, *long[11:]])}\nonly {n}") for i, n in enumerate(names)]
    text = {r.doc_id: r.text for r in ld.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert text == {0: rows[0][1], 1: "only bert", 2: "only carl"}


def test_passages_in_two_documents(spark):
    words = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    rows = [(i, "\n".join([" ".join(words[:51]), " ".join(words[:50]), own])) for i, own in enumerate(["one", "two"])]
    text = {r.doc_id: r.text for r in ld.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert text == {0: rows[0][1], 1: "\n".join([" ".join(words[:50]), "two"])}


def test_rows(spark, odd_docs, no_docs):
    out = ld.dedup(odd_docs)
    assert out.schema == odd_docs.schema and sorted(map(str, out.collect())) == sorted(map(str, odd_docs.collect()))
    assert ld.dedup(no_docs).collect() == []
    same = spark.createDataFrame([(1, "one two three four five")] * 4, "doc_id bigint, text string")
    assert ld.dedup(same).count() == 4
    assert {r.text for r in ld.dedup(same).collect()} == {"one two three four five"}
