from __future__ import annotations

import os
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from sparklex.llm import licenses
from sparklex.llm.license_catalog import CATALOG, DIGESTS

TEXTS = "/usr/share/common-licenses"
#: Files of the long licences, and where their terms end if instructions follow.
LONG = {
    "Apache-2.0": ("Apache-2.0", "END OF TERMS AND CONDITIONS"), "Artistic-1.0-Perl": ("Artistic", None), "CC0-1.0": ("CC0-1.0", None),
    "GFDL-1.2": ("GFDL-1.2", "ADDENDUM: How to use"), "GFDL-1.3": ("GFDL-1.3", "ADDENDUM: How to use"), "GPL-1.0": ("GPL-1", "END OF TERMS AND CONDITIONS"), "GPL-2.0": ("GPL-2", "END OF TERMS AND CONDITIONS"),
    "GPL-3.0": ("GPL-3", "END OF TERMS AND CONDITIONS"), "LGPL-2.0": ("LGPL-2", "END OF TERMS AND CONDITIONS"), "LGPL-2.1": ("LGPL-2.1", "END OF TERMS AND CONDITIONS"), "LGPL-3.0": ("LGPL-3", None), "MPL-1.1": ("MPL-1.1", None), "MPL-2.0": ("MPL-2.0", None),
}


def long_texts():
    """(licence, text): whole files, and their terms alone."""
    out = []
    for name, (file, end) in LONG.items():
        with open(f"{TEXTS}/{file}", encoding="utf-8", errors="replace") as f:
            text = f.read()
        out.append((name, text))
        if end:
            out.append((name, text[: text.index(end)]))
    return out


@pytest.mark.skipif(not os.path.isdir(TEXTS), reason="the texts are not here")
def test_digests_of_long_licences(spark):
    df = spark.createDataFrame(long_texts(), "license string, text string")
    rows = df.select("license", F.sha2(licenses.canonical_text(licenses.canonical_lines(F.col("text"))), 256).alias("digest")).collect()
    assert {tuple(r) for r in rows} == set(DIGESTS)


@pytest.mark.skipif(not os.path.isdir(TEXTS), reason="the texts are not here")
def test_long_licences_however_wrapped(spark):
    rows, names = [], []
    for name, text in long_texts():
        for width in (40, 63, 100):
            wrap = lambda p: p if re.search(r"(?im)^\W*copyright \W*(c\W|year|yyyy|\d)", p) else textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False)  # noqa: E731, B023
            wrapped = "\n\n".join(map(wrap, re.split(r"\n\s*\n", text)))
            rows.append((len(rows), f"Copyright (c) 2021 Some Body\n{wrapped.upper() if width == 63 else wrapped}"))
            names.append(name)
    found = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    wrong = [(names[i], i) for i in range(len(rows)) if found[i] != names[i]]
    assert not wrong


@pytest.mark.parametrize(
    "line, at_head, later",
    [
        ("Copyright (c) 2020 A", False, False),
        ("Copyright Jane Doe", False, True),
        ("(C) 1999 X", False, False),
        ("copyright holder be liable for any", False, True),
        ("c is a language", True, True),
        ("All rights reserved.", False, False),
    ],
)
def test_copyright_lines(spark, line, at_head, later):
    rows = spark.createDataFrame([(1, line), (2, f"a\n\nb\nd\n{line}")], "i int, t string").select("i", F.size(licenses.canonical_lines(F.col("t"))).alias("n"))
    assert {r.i: r.n for r in rows.collect()} == {1: int(at_head), 2: 3 + later}


def test_canonical_texts(spark):
    mit = next(t for n, u, t in CATALOG if n == "MIT" and u == "text" and t.startswith("MIT License"))
    changed = mit.replace("MIT License", "MIT Licence\n\nCopyright (c) 2020 Somebody", 1).upper().replace('"', "“").replace(" ", "  ").replace("SUBLICENSE", "SUB-LICENSE")
    rows = [(1, mit), (2, changed), (3, mit + " More."), (4, "Some text.\nReleased under the MIT Licence!\nAll rights reserved."), (5, None), (6, ""), (7, "(c) 2019 A\nCopyright B")]
    found = {r.doc_id: (r.license, r.notices, r.n_notice_lines) for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[1][0] == found[2][0] == "MIT" and found[3][0] is None
    assert found[4] == (None, "MIT", 1) and found[5] == found[6] == found[7] == (None, "", 0)


def test_every_entry_finds_itself(spark):
    rows = [(i, t) for i, (_, _, t) in enumerate(CATALOG)]
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        name, unit, _ = CATALOG[r.doc_id]
        assert (r.license == name) if unit == "text" else (r.notices == name)


def test_rows(spark, odd_docs, no_docs):
    assert licenses.scan(odd_docs).count() == odd_docs.count() and licenses.scan(no_docs).collect() == []
    twice = spark.createDataFrame([(1, "Licensed under CC BY 4.0.\nLicensed under CC BY 4.0")] * 2, "doc_id bigint, text string")
    assert [tuple(r) for r in licenses.scan(twice).collect()] == [(1, None, "CC-BY-4.0", 2)] * 2
    plan = licenses.scan(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)
