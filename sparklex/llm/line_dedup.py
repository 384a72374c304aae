"""Line dedup by a log-template tree.

A line is parsed first by its number of tokens, with tokens that hold a digit turned
into a wildcard.  A line of ``MIN_VARIED`` tokens or more is cut into ``SEGMENTS``
equal stretches, and lines of one length share a template if they agree everywhere but
in one stretch, or in two from ``MIN_VARIED_TWICE`` tokens on; a stretch that may
differ becomes a wildcard, so lines of a template agree in three quarters or a half
of their tokens at least.  Shorter lines share a template only if they agree in all
tokens but those with digits.  A template that occurs in ``min_docs`` documents or more is
recurring, and for lines of more than ``PASSAGE_TOKENS`` tokens ``passage_docs`` suffice: all
its lines go but the first, that of the smallest document id.

Sequential parsers open templates in the order of the lines; here a line gives
one hash for each template it could belong to, so the result depends neither on
order nor on partitions, and templates are counted by grouped aggregation.
Two wildcards leave one of the first ``LEAVES`` stretches whole, so these are the
leaves of the tree: lines of which no leaf is reached by enough lines are left out
before templates are counted, and so are templates one of whose leaves is not reached.

Defined cases: null text stays null and empty text empty; lines without a token
always stay; lines of fewer than ``MIN_MASKED`` tokens that all hold a digit have no
wildcard, since no fixed token would be left; lines repeated inside one document count once;
rows repeated with the same id and text are one document, and each of them gives
a row; extra columns pass through under any name.
"""

from __future__ import annotations

from itertools import chain, combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import map_slices, row_key, shared_checkpoint, split_by_heat

MIN_TOKENS = 1
#: Shorter lines keep their digits if no other token is left.
MIN_MASKED = 5
SEGMENTS = 4
#: Lines of fewer tokens have no wildcard but for digits, and then no more than one stretch.
MIN_VARIED = 8
MIN_VARIED_TWICE = 16
#: Stretches of which one at least is whole under any two wildcards.
LEAVES = 3
MIN_DOCS = 3
#: Lines of more tokens than this are passages, which recur from ``PASSAGE_DOCS`` documents on.
PASSAGE_TOKENS = 50
PASSAGE_DOCS = 2
WILDCARD = "<*>"


def _hash(text: str) -> int:
    value = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def masked(line: str) -> list[str]:
    """Tokens of a line, those with a digit as a wildcard."""
    tokens = line.split()
    out = [WILDCARD if not token.isalpha() and any(map(str.isdigit, token)) else token for token in tokens]
    return tokens if len(tokens) < MIN_MASKED and all(token == WILDCARD for token in out) else out


def stretches(tokens: list[str]) -> list[list[str]]:
    """The parts of a line that vary as a whole."""
    if len(tokens) < MIN_VARIED:
        return [tokens]
    cuts = [len(tokens) * i // SEGMENTS for i in range(SEGMENTS + 1)]
    return [tokens[a:b] for a, b in zip(cuts, cuts[1:])]


def masks(n_tokens: int) -> list[tuple[int, ...]]:
    """The stretches that may be wildcards together."""
    most = 0 if n_tokens < MIN_VARIED else 1 if n_tokens < MIN_VARIED_TWICE else 2
    return [mask for size in range(most + 1) for mask in combinations(range(SEGMENTS), size)]


def templates(tokens: list[str]) -> list[str]:
    """All templates a line could belong to, its own tokens first."""
    parts = stretches(tokens)
    wild = [[WILDCARD] * len(part) for part in parts]
    varied = ([wild[i] if i in mask else part for i, part in enumerate(parts)] for mask in masks(len(tokens)))
    return [f"{len(tokens)} {' '.join(chain.from_iterable(v))}" for v in varied]


def _part_hashes(tokens: list[str]) -> list[int]:
    """A hash for each stretch by its place and the length of the line; zero for wildcards alone, and to fill up."""
    parts = stretches(tokens)
    hashes = [0 if all(t == WILDCARD for t in part) else _hash(f"{len(tokens)} {i} {' '.join(part)}") for i, part in enumerate(parts)]
    return hashes + [0] * (SEGMENTS - len(parts))


PARTS = [f"part_{i}" for i in range(SEGMENTS)]


def _leaf_column():
    """Hashes of the stretches by which a line is found."""
    keys = [F.xxhash64("n_tokens", F.lit(i), PARTS[i]) for i in range(LEAVES)]
    return F.when(F.col("n_tokens") < MIN_VARIED, F.array(keys[0])).otherwise(F.array(*keys))


def _template_column():
    """Hashes that are equal where ``templates`` are, of those all of whose leaves are reached (a bit each in ``reached``).

    The lowest bit says whether the line is a passage, so that lines of one template need the same number of documents.
    """
    is_passage = F.when(F.col("n_tokens") > PASSAGE_TOKENS, 1).otherwise(0).cast("long")

    def hashes(n_tokens: int):
        out = []
        for mask in masks(n_tokens):
            columns = [F.lit(0).cast("long") if i in mask else F.col(part) for i, part in enumerate(PARTS)]
            leaves = 1 if n_tokens < MIN_VARIED else sum(1 << i for i in range(LEAVES) if i not in mask)
            value = F.shiftleft(F.shiftright(F.xxhash64("n_tokens", *columns), 1), 1).bitwiseOR(is_passage)
            out.append(F.when(F.col("reached").bitwiseAND(F.lit(leaves)) == leaves, value))
        return F.array_compact(F.array(*out))

    n = F.col("n_tokens")
    return F.when(n < MIN_VARIED, hashes(0)).when(n < MIN_VARIED_TWICE, hashes(MIN_VARIED)).otherwise(hashes(MIN_VARIED_TWICE))


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line with tokens: document, number, tokens and stretches."""
    schema = StructType(
        [StructField("doc_id", docs.schema["doc_id"].dataType), StructField("key_text", LongType())]
        + [StructField(c, IntegerType()) for c in ("line", "n_tokens")]
        + [StructField(c, LongType()) for c in PARTS]
    )

    def turn(batch: pa.RecordBatch):
        picked, out = [], {name: [] for name in ("line", "n_tokens", *PARTS)}
        for row, text in enumerate(batch.column(2).to_pylist()):
            for number, line in enumerate((text or "").split("\n")):
                tokens = masked(line)
                if len(tokens) >= MIN_TOKENS:
                    picked.append(row)
                    out["line"].append(number)
                    out["n_tokens"].append(len(tokens))
                    for name, value in zip(PARTS, _part_hashes(tokens)):
                        out[name].append(value)
        rows = pa.array(picked, pa.int64())
        return out | {name: batch.column(i).take(rows) for i, name in enumerate(("doc_id", "key_text"))}

    return map_slices(docs.select("doc_id", "key_text", "text"), lambda: turn, schema)


def _reached(lines: DataFrame) -> DataFrame:
    """``at, reached``: the lines that share a leaf with enough others, and which of their leaves those are."""
    leaves = lines.select("at", "need", F.posexplode(_leaf_column()).alias("i", "leaf"))
    leaves = leaves.select("at", "need", "leaf", F.expr("shiftleft(1, i)").alias("bit"))
    hot, others = split_by_heat(leaves, "leaf")
    enough = hot.groupBy("leaf", "need").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.col("need"))
    many = others.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("leaf"))).where(F.col("n") >= F.col("need"))
    found = many.select("at", "bit").unionByName(hot.join(F.broadcast(enough.select("leaf")), "leaf", "left_semi").select("at", "bit"))
    return found.groupBy("at").agg(F.bit_or("bit").alias("reached"))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, passage_docs: int = PASSAGE_DOCS) -> DataFrame:
    """``key_id, key_text, drop``: numbers of the lines that go, for each document that loses any.

    ``docs`` has ``doc_id``, ``text`` and ``key_text``, the second of its rows' keys.  Leaves and templates are gathered
    by one shuffle each; those that hold a large share of all rows stay where they are and are counted first.
    """
    least = min(min_docs, passage_docs)
    lines = shared_checkpoint(_lines(docs)).withColumns(
        {"at": F.xxhash64("doc_id", "key_text", "line"), "need": F.when(F.col("n_tokens") > PASSAGE_TOKENS, least).otherwise(min_docs)}
    )
    inside = shared_checkpoint(lines.drop("need").join(_reached(lines).hint("merge"), "at").drop("at"))
    spread = inside.select(F.explode(_template_column()).alias("template"), "doc_id", "key_text", "line")
    need = F.when(F.col("template").bitwiseAND(F.lit(1)) == 1, least).otherwise(min_docs)
    hot, others = split_by_heat(spread, "template")

    together = Window.partitionBy("template")
    placed = others.withColumn("place", F.rank().over(together.orderBy("doc_id", "key_text", "line")))
    placed = placed.withColumn("doc", F.dense_rank().over(together.orderBy("doc_id", "key_text"))).withColumn("n", F.max("doc").over(together))
    later = placed.where((F.col("n") >= need) & (F.col("place") > 1)).select("doc_id", "key_text", "line")

    firsts = (
        hot.groupBy("template", "doc_id", "key_text")
        .agg(F.min("line").alias("line"))
        .groupBy("template")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "key_text", "line")).alias("first"))
        .where(F.col("n") >= need)
        .select("template", "first")
    )
    hot_later = hot.join(F.broadcast(firsts), "template").where(~F.struct("doc_id", "key_text", "line").eqNullSafe(F.col("first"))).select("doc_id", "key_text", "line")
    return later.unionByName(hot_later).groupBy(F.xxhash64("doc_id", F.lit(11)).alias("key_id"), "key_text").agg(F.collect_set("line").alias("drop"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, report: bool = False, passage_docs: int = PASSAGE_DOCS) -> DataFrame:
    """``docs`` with its recurring lines gone; with ``report``, one row of counts and a digest for each row instead."""
    named = docs.select(*(F.col(c).alias(f"c_{i}") for i, c in enumerate(docs.columns)))
    doc_id, raw = (F.col(f"c_{docs.columns.index(c)}") for c in (id_col, text_col))
    key_id, key_text = row_key(doc_id, raw.cast("string"))
    keyed = named.withColumns({"key_id": key_id, "key_text": key_text})
    drops = recurring_lines(keyed.select(doc_id.alias("doc_id"), raw.cast("string").alias("text"), "key_text"), min_docs, passage_docs)
    drops = drops.withColumnsRenamed({"key_id": "d_id", "key_text": "d_text"}).hint("shuffle_hash")
    sent = keyed.select(doc_id, raw, "key_id", "key_text") if report else keyed
    joined = sent.join(drops, (F.col("key_id") == F.col("d_id")) & (F.col("key_text") == F.col("d_text")), "left")
    text = raw.cast("string")

    def without(lines):
        """Lines whose numbers are not dropped; linear, since the numbers are taken away as a set."""
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "drop")
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    # Bound by a lambda, so that a text is split once.
    kept = F.when(F.col("drop").isNull(), text).otherwise(F.get(F.transform(F.array(F.split(text, "\n")), without), F.lit(0)))
    if report:
        return joined.select(
            doc_id.alias("doc_id"),
            F.when(raw.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long").alias("n_lines"),
            F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("n_dropped"),
            F.sha2(F.coalesce(kept, F.lit("")), 256).alias("kept_sha256"),
        )
    return joined.select(*(kept.alias(c) if c == text_col else F.col(f"c_{i}").alias(c) for i, c in enumerate(docs.columns)))
