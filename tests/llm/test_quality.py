from __future__ import annotations

import math
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparklex.llm import quality as q

FOLDER, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
LABELS = "doc_id bigint, quality int, toxic int"


def test_sites_shrink_toward_their_parents(spark):
    rows = [("a", "x", int(i < 90)) for i in range(100)] + [("b", "x", int(i < 10)) for i in range(100)] + [("c", "x", 1)] + [("d", "x", int(i < 30)) for i in range(100)]
    posteriors = lambda rows: q.site_posteriors(spark.createDataFrame(rows, "host string, path string, bad int"), ("bad",))
    hosts, paths, rate = posteriors(rows)
    host, rate = {r.host: r.host_bad for r in hosts.collect()}, rate["bad"]
    assert 0.8 < host["a"] < 0.9 and 0.1 < host["b"] < 0.2 and rate < host["c"] < 0.95
    alike = [(h, "x", int(i < 5)) for h in "abcdef" for i in range(50)]
    hosts, paths, rate = posteriors(alike)
    assert all(abs(r.host_bad - rate["bad"]) < 1e-3 for r in hosts.collect()) and all(abs(r.path_bad - rate["bad"]) < 1e-3 for r in paths.collect())
    assert posteriors([])[2] == {"bad": 0.5}


def test_learns_words_and_shape(spark):
    texts = [(i, f"plain words number {'abcdefgh'[i % 8]} go on here" if i % 3 else f"this is nasty stuff {'abcdefgh'[i % 8]} you know") for i in range(120)]
    texts += [(200 + i, "!!! $$$ ### *** " * 5) for i in range(40)]
    docs = spark.createDataFrame([(*t, "h", "p") for t in texts], "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i < 200), int(i < 200 and i % 3 == 0)) for i, _ in texts], LABELS)
    judged = {r.doc_id: r.accepted for r in q.judge(docs, labels).select("row.doc_id", "accepted").collect()}
    assert all(judged[i] == (i < 200 and i % 3 != 0) for i, _ in texts)


def test_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], LABELS)
    labels = spark.createDataFrame([(3, 1, 0), (3, None, None), (None, 0, 1), (4, 1, 0), (6, 0, None)], LABELS)
    for given in (none, labels):
        judged = q.judge(odd_docs, given)
        assert judged.count() == odd_docs.count() and judged.where("p_bad is null or accepted is null").count() == 0
        assert q.accepted(judged).columns == odd_docs.columns
        assert q.judge(no_docs, given).collect() == []
    assert q.judge(odd_docs, none).where("accepted").count() == odd_docs.count()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the standard tables are not here")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    judged = q.judge(docs, labels.where("doc_id % 2 = 0")).select("row.doc_id", "accepted")
    held = judged.join(labels.where("doc_id % 2 = 1"), "doc_id")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    rates = held.agg(F.avg(F.when(~bad, F.col("accepted").cast("int"))).alias("kept"), F.avg(F.when(F.col("quality") == 0, (~F.col("accepted")).cast("int"))).alias("caught")).first()
    assert rates.kept > 0.98 and rates.caught > 0.9


def brute_rates(rows, label):
    """Posterior rates by host and by (host, path), and the global one, in plain Python; ``rows`` are (host, path, labels)."""
    n, k = len(rows), sum(r[2][label] for r in rows)
    rate = (k + 0.5) / (n + 1)

    def weight(groups, parent, count):
        inner = rate * (1 - rate)
        room = n - sum(len(g) ** 2 for g in groups.values()) / n
        between = (sum(len(g) * (sum(g) / len(g) - parent(key)) ** 2 for key, g in groups.items()) - max(count - 1, 0) * inner) / room if room > 0 else 0.0
        if between <= inner * 1e-9:
            return 1e9
        return min(inner / between - 1, 1e9) if inner > between else 1.0

    by_host, by_path = defaultdict(list), defaultdict(list)
    for host, path, labels in rows:
        by_host[host].append(labels[label])
        by_path[host, path].append(labels[label])
    w = weight(by_host, lambda key: rate, len(by_host))
    hosts = {h: (sum(g) + w * rate) / (len(g) + w) for h, g in by_host.items()}
    w = weight(by_path, lambda key: sum(by_host[key[0]]) / len(by_host[key[0]]), len(by_path) - len(by_host) + 1)
    return hosts, {key: (sum(g) + w * hosts[key[0]]) / (len(g) + w) for key, g in by_path.items()}, rate


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the standard tables are not here")
@pytest.mark.parametrize("broadcast_sites", [q.BROADCAST_SITES, 3])
def test_query_like_brute_force(spark, broadcast_sites):
    """Rates, probabilities and verdicts of all documents, from the document model's evidence and the labels."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 7 != 0, F.col("source")))
    judged = q.judge(docs, labels, broadcast_sites=broadcast_sites).select("row.doc_id", "row.source", "row.lang", "evidence", "rate_low", "rate_toxic", "p_bad", "accepted").collect()
    assert len(judged) == docs.count()
    given = {r.doc_id: (int(r.quality == 0), int(r.toxic == 1)) for r in labels.collect()}
    rows = [(r.source, r.lang, given[r.doc_id]) for r in judged if r.doc_id in given]
    tables = [brute_rates(rows, label) for label in (0, 1)]
    for r in judged:
        worst = 0.0
        for (hosts, paths, rate), evidence, found in zip(tables, r.evidence, (r.rate_low, r.rate_toxic)):
            site = paths.get((r.source, r.lang), hosts.get(r.source, rate))
            assert found == pytest.approx(site)
            z = evidence + math.log(site / (1 - site)) - math.log(rate / (1 - rate))
            worst = max(worst, 1 / (1 + math.exp(-z)))
        assert r.p_bad == pytest.approx(worst) and r.accepted == (r.p_bad <= 0.5)


def test_a_tie_is_accepted(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 5, "h", "p") for i in range(8)], "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)], LABELS)
    p = q.judge(docs, labels).where("row.doc_id = 3").first().p_bad
    assert q.judge(docs, labels, threshold=p).where("row.doc_id = 3").first().accepted
    assert not q.judge(docs, labels, threshold=math.nextafter(p, 0)).where("row.doc_id = 3").first().accepted
