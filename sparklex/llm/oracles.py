"""DuckDB SQL for those corpus queries that SQL can express."""

from __future__ import annotations

from .license_catalog import CATALOG, DIGESTS, SPELLINGS
from .licenses import COPYRIGHT, HEAD, HEAD_LINES, SEVERAL_WORDS
from .url_filter import BLOCKED_GLOBS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"list_filter(string_split_regex({lower}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"


def _license_lines(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}\\n©]+', ' ', 'g')"
    for variant, spelling in SPELLINGS:
        out = f"replace({out}, {_quoted(variant)}, {_quoted(spelling)})"
    lines = f"list_filter(list_transform(string_split({out}, chr(10)), lambda l: trim(l)), lambda l: l <> '')"
    return f"list_filter({lines}, lambda l, i: NOT regexp_matches(l, '{COPYRIGHT}') AND NOT (i <= {HEAD_LINES} AND regexp_matches(l, '{HEAD}')))"


def _license_text(lines: str) -> str:
    out = f"array_to_string({lines}, ' ')"
    for variant, spelling in SEVERAL_WORDS:
        out = f"replace({out}, {_quoted(variant)}, {_quoted(spelling)})"
    return out


_URL_RULES = """(VALUES ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'),
                ('block','example.net','/de/8'), ('block','org','/es/'))"""

ORACLES = {
    "op1_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, {_words("text")} AS w FROM documents),
b AS (SELECT item_id, {_words("text")} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, list_slice(w, s, s + least(10, len(w)) - 1) AS win
  FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT len(win) AS n FROM item_windows),
doc_windows AS (
  SELECT row_no, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d, sizes WHERE len(w) >= n
), hits AS (
  SELECT row_no, s, n, item_id FROM doc_windows JOIN item_windows ON win = list_slice(w, s, s + n - 1)
), places AS (
  SELECT row_no, count(DISTINCT p) AS n_hit FROM (SELECT row_no, unnest(range(s, s + n)) AS p FROM hits) GROUP BY row_no
), items AS (
  SELECT row_no, list_sort(list(DISTINCT item_id::varchar)) AS ids FROM hits GROUP BY row_no
)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(len(ids), 0)::bigint AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (row_no) LEFT JOIN items USING (row_no)
""",
    "op5_licenses": f"""
WITH catalog(license, unit, text) AS (VALUES {", ".join("(" + ", ".join(map(_quoted, row)) + ")" for row in CATALOG)}),
known AS (
  SELECT unit, digest, min(license) AS license
  FROM (SELECT license, unit, sha256({_license_text(_license_lines("text"))}) AS digest FROM catalog
        UNION ALL SELECT license, 'text', digest FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(d)})" for n, d in DIGESTS)}) long(license, digest)) GROUP BY ALL
), d AS (SELECT row_number() OVER () AS row_no, doc_id, {_license_lines("text")} AS lines FROM documents),
notices AS (
  SELECT row_no, array_to_string(list_sort(list(DISTINCT license)), ',') AS notices, count(*) AS n
  FROM (SELECT row_no, sha256(unnest(lines)) AS digest FROM d) JOIN known USING (digest) WHERE unit = 'notice' GROUP BY row_no
)
SELECT doc_id, license, coalesce(notices, '') AS notices, coalesce(n, 0)::bigint AS n_notice_lines
FROM d LEFT JOIN known ON unit = 'text' AND digest = sha256({_license_text("lines")}) LEFT JOIN notices USING (row_no)
""",
    "op7_url_filter": f"""
WITH parts AS (
  SELECT row_number() OVER () AS row_no, page_id,
         CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), cut AS (
  SELECT row_no, page_id, regexp_extract(rest, '^[^?#]*') AS rest FROM parts
), split AS (
  SELECT row_no, page_id,
         translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path
  FROM cut
), fits AS (
  SELECT row_no, first(r.h || r.p ORDER BY length(r.h || r.p) DESC, length(r.h) DESC) AS rule,
         first(r.v ORDER BY length(r.h || r.p) DESC, length(r.h) DESC) AS verdict
  FROM split JOIN {_URL_RULES} r(v, h, p)
    ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)
  GROUP BY row_no
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN {" OR ".join(f"('.' || host || path) GLOB '{g}'" for g in BLOCKED_GLOBS)} THEN 'block' ELSE 'allow' END) AS verdict
FROM split LEFT JOIN fits USING (row_no)
""",
}
