from __future__ import annotations

import fnmatch
import random

import pytest

from sparklex.llm import url_filter as u


@pytest.mark.parametrize(
    "url, parts",
    [
        ("https://WWW.Ex.com/A?b#c", ("www.ex.com", "/A")),
        ("http://a.b?x=/y", ("a.b", "")),
        ("x://h#/p", ("h", "")),
        ("no scheme", ("", "")),
        ("a://b://c/d", ("b:", "//c/d")),
        (None, ("", "")),
        ("", ("", "")),
    ],
)
def test_canonical(url, parts):
    assert u.canonical(url) == parts


def test_automaton_is_like_plain_matching():
    rng = random.Random(1)
    globs = ["".join(rng.choice("ab/*?") for _ in range(rng.randrange(1, 9))).lstrip("*") or "a" for _ in range(60)]
    globs += ["*" + g for g in globs[:20]] + ["", "*", "**a*", "x" * 70 + "*"]
    plain = [g.replace("**", "*") for g in globs]
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randrange(0, 12))) for _ in range(300)] + ["x" * 75]
    found = u.GlobAutomaton(globs).match([t.encode() for t in texts])
    for i, text in enumerate(texts):
        for j, glob in enumerate(globs):
            if glob.startswith("**"):
                cuts = [k for k in range(len(text) + 1) if "/" not in text[:k]]
                wanted = any(fnmatch.fnmatchcase(text[k:], glob[2:]) for k in cuts)
            else:
                wanted = fnmatch.fnmatchcase(text, plain[j])
            assert found[i, j] == wanted, (text, glob)


@pytest.mark.parametrize(
    "url, rule, verdict",
    [
        ("http://a.example.com/en/5", "com/en/", "block"),
        ("http://example.com/en/77", "example.com/en/7", "allow"),
        ("http://notexample.com/en/77", "com/en/", "block"),
        ("http://x.net/de/8", "net/de/", "allow"),
        ("http://m.example.net/de/81", "example.net/de/8", "block"),
        ("http://evil.org/x.com/en/1", None, "allow"),
        ("http://m.free-bets.example.fr/x", None, "block"),
        ("http://a.org/x?free-bets", None, "allow"),
        (None, None, "allow"),
    ],
)
def test_verdicts(spark, url, rule, verdict):
    row = u.judge(spark.createDataFrame([(1, url)], "page_id bigint, url string")).first()
    assert (row.rule, row.verdict) == (rule, verdict)


def test_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/", "x"), (1, "http://a.com/en/", "x"), (None, None, None)], "page_id bigint, url string, host string")
    assert u.judge(pages).count() == 3 and u.judge(pages.limit(0)).collect() == []
    assert u.judge(pages, rules=()).first().rule is None


def test_odd_rows(spark):
    """Very long URLs, columns whose names clash, null ids and an empty table."""
    long = "http://a.org/" + "x/" * 100_000 + "casino"
    rows = [(1, long, "no host", "no rule", b"x"), (None, long[:-1], "h", "r", None), (None, "http://b.com/en/", None, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, rule string, verdict binary")
    found = [tuple(r) for r in u.judge(pages).collect()]
    assert [(r[0], r[1], len(r[2]), r[3], r[4]) for r in found] == [(1, "a.org", len(long) - 12, None, "block"), (None, "a.org", len(long) - 13, None, "allow"), (None, "b.com", 4, "com/en/", "block")]
    assert u.judge(pages.limit(0)).collect() == []


def test_ties_between_rules(spark):
    """Of equally long rules the one with the longer host wins, then the earlier."""
    rules = (u.SiteRule("block", "b.c", "/xy"), u.SiteRule("allow", "a.b.c", "/"), u.SiteRule("block", "c", "/q"), u.SiteRule("allow", "c", "/q"))
    pages = spark.createDataFrame([(1, "http://a.b.c/xy"), (2, "http://z.c/q")], "page_id bigint, url string")
    assert [(r.rule, r.verdict) for r in u.judge(pages, rules).collect()] == [("a.b.c/", "allow"), ("c/q", "block")]


def test_rules_from_a_table(spark, monkeypatch):
    schema = "verdict string, host string, path string, glob string"
    table = spark.createDataFrame([("block", "a.org", None, None), ("allow", "a.org", "/ok", None), ("allow", "a.org", "/ok", None), (None, None, None, "*.*/p?z")], schema)
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://m.a.org/ok1"), (3, "http://b.fr/piz"), (4, "http://b.fr/casino")], "page_id bigint, url string")
    assert [(r.rule, r.verdict) for r in u.judge(pages, table).collect()] == [("a.org", "block"), ("a.org/ok", "allow"), (None, "block"), (None, "allow")]
    with pytest.raises(ValueError):
        u.rules_of(spark.createDataFrame([("maybe", "a", "/", None)], schema))
    monkeypatch.setattr(u, "MAX_RULES", 2)
    with pytest.raises(ValueError):
        u.judge(pages, table)


def test_many_rules_like_plain_matching(spark):
    """Thousands of rules, hundreds of words of state."""
    rng = random.Random(3)
    rules = tuple({u.SiteRule(rng.choice(["allow", "block"]), ".".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))), "/" + "".join(rng.choice("xy/") for _ in range(rng.randrange(5)))) for _ in range(2000)})
    names = {}
    for r in rules:
        names.setdefault((r.host, r.path), r)
    urls = [f"http://{'.'.join(rng.choice('abc') for _ in range(rng.randrange(1, 5)))}/{''.join(rng.choice('xy/') for _ in range(rng.randrange(7)))}" for _ in range(300)]
    for row, url in zip(u.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), tuple(names.values())).collect(), urls):
        host, path = u.canonical(url)
        fits = [r for r in names.values() if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.name), len(r.host)), default=None)
        assert (row.rule, row.verdict) == ((best.name, best.verdict) if best else (None, "allow"))
