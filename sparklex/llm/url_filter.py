"""URL filters: all glob rules at once in one bit-parallel automaton.

Every rule is a glob over the canonical URL, ``.host/path``.  ``*`` stands for
any bytes, ``?`` for one byte, ``**`` at the front of a rule for any bytes of
the host (none of them ``/``).  All rules lie side by side in one bit string cut
into 64-bit words.  A bit is a position in a rule; reading a byte moves every
live bit one place along where the rule accepts that byte (shift, then and), and
leaves bits before a ``*`` where they are.  Many URLs advance together, one byte
at a time, each with all rules.

Canonical form: the host follows the first ``://`` up to ``/``, ``?``, ``#`` or
the end, with A-Z lower-cased; the path goes on to ``?``, ``#`` or the end.  A
null URL, or one without ``://``, has both empty.

Of the site rules that fit, the longest decides (of equal ones the longer host,
then the earlier rule).  Where none fits, a URL is blocked if any pattern of
``blocked`` matches, else allowed.  Rules may come from a table of any origin
(:func:`rules_of`); they are counted before they are sent to the tasks.

Defined cases: repeated rows each give a row; a null id stays null; a URL of any
length is read whole; an empty table gives an empty result; other columns are not
read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import map_slices


@dataclass(frozen=True)
class SiteRule:
    """A host, its subdomains, and the paths that start so."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"**.{_literal(self.host)}{_literal(self.path)}*"


def _literal(text: str) -> str:
    return text.replace("\\", "\\\\").replace("*", "\\*").replace("?", "\\?")


#: Fixed values of the contract.
SITE_RULES = (
    SiteRule("block", "com", "/en/"),
    SiteRule("allow", "example.com", "/en/7"),
    SiteRule("allow", "net", "/de/"),
    SiteRule("block", "example.net", "/de/8"),
    SiteRule("block", "org", "/es/"),
)
#: Names of hosts and paths that are blocked where no site rule fits.
BLOCKED_GLOBS = ("*.*free-bets*", "*.*casino*", "*.*poker*", "*.*porn*", "*.*xxx-*", "*.*warez*", "*/ads/*", "*/tracking/*", "*.exe", "*.apk")


#: Rules that one automaton holds, and bytes of them.  Its masks take 64 bytes for each byte.
MAX_RULES = 20_000
MAX_RULE_BYTES = 1 << 18


def rules_of(table: DataFrame) -> tuple[tuple[SiteRule, ...], tuple[str, ...]]:
    """Site rules and blocked patterns of a table ``verdict, host, path, glob``, in the order of these columns.

    A row with a ``glob`` is a blocked pattern, any other a site rule; nulls in ``host`` and ``path`` are empty.  A
    table of more than ``MAX_RULES`` rows or ``MAX_RULE_BYTES`` bytes is an error.
    """
    names = ("verdict", "host", "path", "glob")
    rows = table.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names)).distinct()
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.concat(*names))).alias("bytes")).first()
    if size.n > MAX_RULES or (size.bytes or 0) > MAX_RULE_BYTES:
        raise ValueError(f"{size.n} rules of {size.bytes} bytes are too many for one automaton")
    found = sorted(tuple(r) for r in rows.collect())
    wrong = {verdict for verdict, _, _, glob in found if not glob} - {"allow", "block"}
    if wrong:
        raise ValueError(f"no such verdict: {', '.join(sorted(wrong))}")
    return tuple(SiteRule(v, h, p) for v, h, p, g in found if not g), tuple(g for _, _, _, g in found if g)


class GlobAutomaton:
    """Extended Shift-And over bytes for a fixed list of globs."""

    def __init__(self, globs: list[str]):
        self.count = len(globs)
        parsed = [self._parse(g) for g in globs]
        bits = sum(len(steps) + 1 for steps in parsed)
        self.words = max(1, (bits + 63) // 64)
        self.advance = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        at = 0
        for steps in parsed:
            self._set(self.start, at)
            loops = steps.front
            for accepts, loop in steps:
                self._loops(at, loops)
                at += 1
                self.advance[accepts, at // 64] |= np.uint64(1 << at % 64)
                loops = loop
            self._loops(at, loops)
            self.final.append((at // 64, np.uint64(1 << at % 64)))
            at += 1

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= np.uint64(1 << bit % 64)

    def _loops(self, bit: int, accepts: np.ndarray) -> None:
        self.stay[accepts, bit // 64] |= np.uint64(1 << bit % 64)

    @staticmethod
    def _parse(glob: str) -> "Steps":
        nothing, host = np.zeros(256, bool), np.ones(256, bool)
        host[ord("/")] = False
        steps = Steps(nothing)
        raw, i = glob.encode(), 0
        if raw.startswith(b"**"):
            steps.front, i = host, 2
        while i < len(raw):
            c = raw[i : i + 1]
            if c == b"*":
                every = np.ones(256, bool)
                if steps:
                    steps[-1] = (steps[-1][0], every)
                else:
                    steps.front = every
                i += 1
                continue
            accepts = nothing.copy()
            if c == b"?":
                accepts[:] = True
            else:
                i += c == b"\\" and i + 1 < len(raw)
                accepts[raw[i]] = True
            steps.append((accepts, nothing))
            i += 1
        return steps

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Boolean matrix: text by glob, true where the glob matches the whole text."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(texts), np.uint8)
        starts = (np.cumsum(lengths) - lengths)[order]
        falling = -lengths[order]
        state = np.tile(self.start, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        for step in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(falling, -step, side="left"))  # those longer than step
            byte = flat[starts[:live] + step]
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = moved & self.advance[byte] | now & self.stay[byte]
        out = np.empty((len(texts), self.count), bool)
        for rule, (word, bit) in enumerate(self.final):
            out[order, rule] = (state[:, word] & bit) != 0
        return out


class Steps(list):
    """Positions of a glob: (bytes accepted, bytes that may repeat after it); ``front``: bytes that may come first."""

    def __init__(self, front: np.ndarray):
        super().__init__()
        self.front = front


def canonical(url: str | None) -> tuple[str, str]:
    """Host and path of a URL, both empty where there is no ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def judge(
    pages: DataFrame,
    rules: tuple[SiteRule, ...] | DataFrame = SITE_RULES,
    blocked: tuple[str, ...] = BLOCKED_GLOBS,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row; a table of rules, see :func:`rules_of`, brings its own patterns."""
    if isinstance(rules, DataFrame):
        rules, blocked = rules_of(rules)
    schema = StructType([StructField("page_id", pages.schema[id_col].dataType), *(StructField(c, StringType()) for c in ("host", "path", "rule", "verdict"))])
    ranked = sorted(rules, key=lambda r: (-len(r.name), -len(r.host)))

    def make():
        automaton = GlobAutomaton([r.glob for r in ranked] + list(blocked))

        def turn(batch: pa.RecordBatch):
            parts = [canonical(url) for url in batch.column(1).to_pylist()]
            hits = automaton.match([f".{host}{path}".encode() for host, path in parts])
            some_rule = hits[:, : len(ranked)]
            first = np.where(some_rule.any(1), some_rule.argmax(1) if ranked else 0, -1).tolist()
            any_blocked = hits[:, len(ranked) :].any(1).tolist()
            return {
                "page_id": batch.column(0),
                "host": [host for host, _ in parts],
                "path": [path for _, path in parts],
                "rule": [ranked[i].name if i >= 0 else None for i in first],
                "verdict": [ranked[i].verdict if i >= 0 else "block" if bad else "allow" for i, bad in zip(first, any_blocked)],
            }

        return turn

    return map_slices(pages.select(F.col(id_col), F.col(url_col).cast("string")), make, schema)
