from __future__ import annotations

import random

import numpy as np
import pytest

from sparklex.llm import near_duplicates as n
from sparklex.llm.components import connected_components


def grams(text):
    w = n.canonical(text).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs, similarity=0.8):
    """class, copy, copies, links of each id, by comparing all pairs."""
    key = {i: n.canonical(t) or b"\0" + t.encode() for i, t in docs}
    copy = {i: min(j for j in key if key[j] == key[i]) for i in key}
    sets = {i: grams(t) for i, t in docs}
    heads = sorted(set(copy.values()))
    links, root = {h: set() for h in heads}, {h: h for h in heads}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in heads:
        for b in heads:
            union = len(sets[a] | sets[b])
            if a < b and union and len(sets[a] & sets[b]) >= similarity * union:
                links[a].add(b)
                links[b].add(a)
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (find(copy[i]), copy[i], sum(c == copy[i] for c in copy.values()), len(links[copy[i]])) for i in key}


def corpus():
    rng = random.Random(6)
    some = lambda k: [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 4) for _ in range(k)]
    docs, i = [], 0
    for size in (1, 1, 1, 2, 3, 5, 9, 30):
        base = some(rng.choice([4, 60, 120]))
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "new" + str(rng.randrange(100))
            docs.append((i, (" ".join(w)).upper() if rng.random() < 0.3 else ", ".join(w)))
            i += 1
    return docs + [(500, ""), (501, ""), (502, "?!"), (503, "one"), (504, "One."), (505, "a b c d"), (506, "a b c e")]


@pytest.mark.parametrize("options", [{}, {"block_classes": 4}, {"block_classes": 4, "max_blocks": 1}])
def test_like_brute_force(spark, options):
    docs = corpus()
    got = {r[0]: tuple(r)[1:] for r in n.join(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), **options).collect()}
    assert got == brute(docs)


def test_keep_one(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, row string")
    kept = n.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, *_ in brute(docs).values()})


def test_rows(spark, odd_docs, no_docs):
    rows = n.join(odd_docs).collect()
    assert len(rows) == odd_docs.count() and n.join(no_docs).collect() == [] and n.keep_one(no_docs).collect() == []
    assert {r.class_id for r in rows if r.doc_id == 3} == {3}
    ids = [r.doc_id for r in n.keep_one(odd_docs).collect()]
    assert sorted(ids, key=str) == [1, 2, 3, 4, 5, 6, None]
    nulls = spark.createDataFrame([(1, None), (2, None)], "doc_id bigint, text string")
    assert n.keep_one(nulls).count() == 2


def test_prefix_is_shortened_to_the_recall():
    floor = n.prefix_depth()
    assert 1 - (1 - 0.8**floor) ** n.TREES >= n.TARGET_RECALL > 1 - (1 - 0.8 ** (floor + 1)) ** n.TREES
    assert n.prefix_depth(target=0.0) == n.MAX_DEPTH
    assert n.shortened_depth({}, 5) == n.shortened_depth({8: 1000, 7: 1}, 5) == 8
    assert n.shortened_depth({8: 900, 7: 100}, 5) == 7 and n.shortened_depth({8: 900, 6: 60, 5: 40}, 5) == 5


def test_tries_match_like_all_prefixes(spark):
    """Neighbours in the sorted tries connect exactly the classes that share a prefix, at each depth, over many partitions."""
    rng = np.random.default_rng(2)
    floor, forest = 5, n.Forest(5)
    sets = []
    for _ in range(25):
        base = rng.integers(0, 1 << 60, 40).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[: 40 - k], rng.integers(0, 1 << 60, k).astype(np.uint64)])) for k in rng.integers(0, 12, 5)]
    signs = [forest.sign(x) for x in sets]
    rows = [(t, int(p[t]), int(tail[t]), i) for i, (p, tail) in enumerate(signs) for t in range(n.TREES)]
    places = spark.createDataFrame(rows, "tree int, prefix long, tail long, node long")
    found = {(r.u, r.v): r.depth for r in n.trie_matches(places, floor).collect()}
    bits = n.print_bits(floor)

    def depth(a, b, t):
        if signs[a][0][t] != signs[b][0][t]:
            return 0
        return floor + sum(signs[a][1][t] >> bits * k == signs[b][1][t] >> bits * k for k in range(n.MAX_DEPTH - floor))

    for least in range(floor, n.MAX_DEPTH + 1):
        wanted, got = (components(len(sets), pairs) for pairs in (
            [(a, b) for a in range(len(sets)) for b in range(a) if max(depth(a, b, t) for t in range(n.TREES)) >= least], [e for e, d in found.items() if d >= least]))
        assert wanted == got


def components(count, pairs):
    root = list(range(count))
    for _ in range(count):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def near_copies(count, seed):
    """Copies of one text with edits, so that many pairs lie about the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    docs = []
    for i in range(count):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(200)] = f"e{i}x{rng.randrange(99)}"
        docs.append((i, " ".join(words)))
    return docs


def test_recall_in_a_component_of_any_size(spark):
    """The same links however a component is cut, and at least 0.99 of those that brute force finds."""
    docs = near_copies(150, 1)
    sets = list({grams(t) for _, t in docs})
    links = sum(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    results = []
    for options in ({}, {"block_classes": 8}, {"block_classes": 8, "max_blocks": 2}):
        results.append(sorted(map(tuple, n.join(df, **options).collect())))
        found = sum(r[4] for r in results[-1] if r[0] == r[2])
        assert 0.99 * links <= found <= links
    assert results[0] == results[1] == results[2]


def test_a_pair_right_at_the_threshold(spark):
    """Eight shingles of ten are linked."""
    words = [f"w{i}" for i in range(13)]
    docs = [(1, " ".join(words)), (2, " ".join([*words[:-1], "x"]))]
    a, b = (grams(t) for _, t in docs)
    assert len(a & b) == 8 and len(a | b) == 10
    assert [r.n_links for r in n.join(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()] == [1, 1]


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_ids_of_any_kind(spark, kind):
    docs = [(-3 - i if kind == "bigint" else f"id{i:03d}", t) for i, t in corpus()]
    df = spark.createDataFrame([(i, t) for i, t in docs] + [(None, docs[0][1]), (None, "no other has this")], f"doc_id {kind}, text string")
    rows = n.join(df).collect()
    wanted = brute(docs)
    for r in rows:
        if r.doc_id is not None:
            assert (r.class_id, r.copy_id, r.n_links) == (wanted[r.doc_id][0], wanted[r.doc_id][1], wanted[r.doc_id][3])
    assert sorted(str(r.class_id) for r in rows if r.doc_id is None) == sorted([str(wanted[docs[0][0]][0]), "None"])


def test_rows_that_share_an_id_are_judged_by_their_text(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, "something else that is not like it at all"), (2, long + " end"), (2, "a third text of its own with some words"), (3, None), (3, None)]
    kept = [tuple(r) for r in n.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(kept, key=str) == sorted([*rows[:2], *rows[3:]], key=str)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(7)
    words = n.canonical(" ".join(rng.choice(["aa", "b", "ccc", "dd"]) + str(rng.randrange(50)) for _ in range(2000)))
    whole = n.shingles(words)
    for size in (10, 97, 1000):
        monkeypatch.setattr(n, "PIECE_BYTES", size)
        assert (n.shingles(words) == whole).all()


def test_intersections(monkeypatch):
    monkeypatch.setattr(n, "MATRIX_COLUMNS", 7)
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(12)]
    wanted = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    apart = ~np.eye(len(sets), dtype=bool)
    assert (n.intersections(sets, sets) == wanted)[apart].all()
    assert (n.intersections(sets[:5], sets[5:]) == np.array(wanted)[:5, 5:]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 201)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []
