"""Secret scans: fixed shapes, and a token-efficiency test for random strings.

Three shapes are found by pattern.  The test then looks at the other long runs
of key-like characters: text that a vocabulary knows takes few tokens, a random
string takes many, so a run with few characters per token is reported as
``random``.  Runs that are known to be harmless are left out first: digests of
the usual lengths, UUIDs, numbers and dotted or hyphenated names.  Runs without a
digit are held against words: they count as random only from ``MIN_LETTERS``
characters on, and if the run and its lower-cased camel-case and separated parts
all take many tokens.  All steps are linear in the length of a run.

Offsets are code points, the end exclusive.  Defined cases: a null text counts
as an empty one and has no spans; repeated rows each give a row; a text of any
length is read whole.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .bpe import read_ranks, vocabulary_path
from .common import id_and_text, map_slices

# Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of fewer characters fails whole, so the length may stand in the pattern.
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

#: Key-like characters in a row that the efficiency test looks at.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: Runs without a digit are mostly words, and must be longer to be told from them.
MIN_LETTERS = 16
#: Characters per token below which a run counts as random.
MAX_CHARS_PER_TOKEN = 2.4
#: The same for runs without a digit, most of which are long words or names.
MAX_LETTERS_PER_TOKEN = 2.0
#: Parts of a name: camel-case words, and capitals.
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_HARMLESS = re.compile(
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"  # UUID
    r"|[0-9_+/=-]+"  # numbers, rules
    r"|(?:[A-Za-z]{2,}|[0-9]{1,8}(?:T[0-9]{1,6}Z?)?)(?:[_/+=-]+(?:[A-Za-z]{2,}|[0-9]{1,8}(?:T[0-9]{1,6}Z?)?))+"  # names and dates in parts
)

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Matches of the three shapes: (start, end, kind), leftmost and without overlap in each kind."""
    spans = []
    if "=" in text or ":" in text:
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return _ordered(spans)


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    """``kind:start:end`` of each span, comma-joined."""
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def is_digest(run: str) -> bool:
    """Digests of the usual lengths."""
    return len(run) in DIGEST_LENGTHS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run) is not None


def is_harmless(run: str) -> bool:
    """Digests of the usual lengths, and identifiers."""
    return is_digest(run) or _HARMLESS.fullmatch(run) is not None


class EfficiencyTest:
    """Characters per token of a run under a public vocabulary."""

    def __init__(self, path: str | None = None, max_chars_per_token: float = MAX_CHARS_PER_TOKEN):
        import public_tokenizers
        import tiktoken

        ranks = read_ranks(vocabulary_path(path))
        self.encoding = tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.limit = max_chars_per_token

    def is_random(self, run: str) -> bool:
        body = run.rstrip("=")
        if not any(c.isalpha() for c in body):
            return False
        if not any(c.isdigit() for c in body):
            return len(body) >= MIN_LETTERS and not is_digest(body) and self._is_random_letters(body)
        if is_harmless(body):
            return False
        return len(body) < self.limit * len(self.encoding.encode_ordinary(body))

    def _is_random_letters(self, body: str) -> bool:
        steps = [abs(ord(a) - ord(b)) <= 1 for a, b in zip(body.lower(), body.lower()[1:])]
        if 2 * sum(steps) >= len(steps):  # alphabets and repeated letters
            return False
        limit = min(self.limit, MAX_LETTERS_PER_TOKEN)
        if len(body) >= limit * len(self.encoding.encode_ordinary(body)):
            return False
        parts = [part.lower() for part in PART.findall(body)]
        return sum(map(len, parts)) < limit * sum(len(self.encoding.encode_ordinary(" " + part)) for part in parts)

    def spans(self, text: str, taken: list[Span]) -> list[Span]:
        """Random runs that lie in none of the spans already found."""
        out, taken, at = [], sorted((a, b) for a, b, _ in taken), 0
        reach = 0  # end of the furthest span that starts before the run
        for m in RUN.finditer(text):
            while at < len(taken) and taken[at][0] < m.end():
                reach = max(reach, taken[at][1])
                at += 1
            if reach <= m.start() and self.is_random(m.group()):
                out.append((m.start(), m.end(), "random"))
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, max_chars_per_token: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """One row for each row of ``docs``: counts by kind, the digest of the base spans, and all spans."""
    counts = ["n_assign", "n_access", "n_hex", "n_random"]
    schema = StructType(
        [StructField("doc_id", docs.schema[id_col].dataType), *(StructField(c, LongType()) for c in counts), StructField("base_sha256", StringType()), StructField("spans", StringType())]
    )

    def make():
        test = EfficiencyTest(path, max_chars_per_token)

        def turn(batch: pa.RecordBatch):
            out = {name: [] for name in schema.names}
            out["doc_id"] = batch.column(0)
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                added = test.spans(text or "", base)
                for kind, name in zip(KINDS, counts):
                    out[name].append(sum(s[2] == kind for s in (*base, *added)))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(_ordered(base + added)))
            return out

        return turn

    return map_slices(id_and_text(docs, id_col, text_col), make, schema)
