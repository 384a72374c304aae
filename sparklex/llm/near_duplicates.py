"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

1. Texts with the same words form a copy class; everything below sees one of each.
2. Each of ``TREES`` trees is a prefix trie of signatures, ``MAX_DEPTH`` min-hashes
   over the word 5-grams of a class.  A trie is kept as its sorted leaves: classes
   with a common prefix are adjacent, and the depth to which adjacent ones agree
   is the length of their matched prefix.  The sort is by ranges of all hashes, so
   a prefix that very many classes have is spread over many tasks.
3. Matched prefixes are shortened from ``MAX_DEPTH`` on, until the matches found
   are ``TARGET_RECALL`` of those at the lowest depth.  That is the one at which
   even a pair right at the threshold shares a prefix in some tree with the
   target probability.  Two classes are compared if they share a prefix of the
   depth so reached in some tree; this rule is the same at every size.
4. Classes to be compared are gathered by connected components of the matches, so
   that each text travels once.  A component is cut into blocks of bounded size,
   and a task compares two blocks by products of their incidence matrices, which
   gives the exact Jaccard similarity of every pair without a row for any of
   them.  A component of very many blocks is taken apart into its single prefixes,
   where a pair counts in the first tree in which it meets; this finds the same.
5. A task returns, for each class, how many it links to and the root of its part;
   the parts are joined by connected components.

The number of links of all texts grows with the square of a group of near copies,
and so does the work of counting them; it is dealt out in cells of two blocks.

Words are runs of digits, letters a-z (after lower-casing A-Z) and characters
beyond ASCII.  A text of one to four words has one shingle, all its words.  Equal
texts without words are copies of each other.  A null text is like nothing, not
even another null.  Ids may be of any type that can be ordered, negative numbers
and strings included.  Rows that repeat an id with another text are documents of
their own; a null id comes after all others, so a class is named null only if
none of its rows has an id.  Rows repeated with the same id and text each give a
row.  Texts are read whole, long ones in pieces; other columns are not read, whatever
their names.  A pair right at the threshold is linked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import map_slices, row_key, shared_checkpoint, small_side, split_join
from .components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
TREES = 16
MAX_DEPTH = 8
TARGET_RECALL = 0.998
#: A block holds about this many classes, or bytes of text, at most.
BLOCK_CLASSES = 600
BLOCK_BYTES = 12 << 20
#: Components of more blocks are compared prefix by prefix, with the same result.
MAX_BLOCKS = 48
#: Columns of an incidence matrix multiplied at once.
MATRIX_COLUMNS = 4096
#: Bytes of a text hashed at once.
PIECE_BYTES = 1 << 22
BROADCAST_ROWS = 500_000

_SPACE = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def prefix_depth(similarity: float = SIMILARITY, trees: int = TREES, target: float = TARGET_RECALL, deepest: int = MAX_DEPTH) -> int:
    """The longest prefix at which a pair of that similarity meets in some tree with the target probability."""
    depth = deepest
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < target:
        depth -= 1
    return depth


def shortened_depth(matches: dict[int, int], floor: int, target: float = TARGET_RECALL, deepest: int = MAX_DEPTH) -> int:
    """The longest prefix that keeps the target share of all matches; ``matches`` counts them by the depth they reach."""
    total, found = sum(matches.values()), 0
    for depth in range(deepest, floor, -1):
        found += matches.get(depth, 0)
        if found >= target * total:
            return depth
    return floor


def canonical(text: str) -> bytes:
    """The words of a text, lower-cased and joined by single blanks."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().translate(_SPACE).split())


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's factor and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < count:
        size = 1 << max(16, (count - 1).bit_length())
        inverse = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
        for name, factor in (("up", _FACTOR), ("down", inverse)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_grams(words: bytes, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words: a polynomial over the bytes of the run."""
    flat = np.frombuffer(words, np.uint8)
    gaps = np.flatnonzero(flat == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(flat)]])
    if len(starts) < size:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(starts) - size + 1], ends[size - 1 :]
    up, down = _powers(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(words: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of canonical words; a long text is hashed in overlapping pieces."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= PIECE_BYTES:
        return np.unique(_hash_grams(words, size))
    parts, start = [], 0
    while start < len(words):
        end = words.find(b" ", start + PIECE_BYTES)
        end = len(words) if end < 0 else end
        reach = end
        for _ in range(size - 1):  # the next words that grams of this piece run into
            after = words.find(b" ", reach + 1)
            reach = len(words) if after < 0 else after
        piece = words[start:reach]
        if piece.count(b" ") + 1 >= size or not parts:
            parts.append(np.unique(_hash_grams(piece, size)))
        start = end + 1
    return np.unique(np.concatenate(parts))


class Forest:
    """Signatures of shingle sets: for each tree, its first min-hashes as one key, and short prints of the deeper ones."""

    def __init__(self, floor: int, trees: int = TREES, deepest: int = MAX_DEPTH):
        rng = np.random.default_rng(20)
        count = deepest * trees
        self.factor = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.offset = rng.integers(0, 1 << 63, count, dtype=np.uint64)
        self.shape, self.floor, self.bits = (trees, deepest), floor, print_bits(floor, deepest)

    def sign(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each tree, a 64-bit hash of the first ``floor`` min-hashes, and prints of the others, the first one highest."""
        low = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        for start in range(0, len(hashes), 512):
            np.minimum(low, (hashes[start : start + 512, None] * self.factor + self.offset).min(0), out=low)
        low = low.reshape(self.shape)
        out = np.arange(1, self.shape[0] + 1, dtype=np.uint64)
        for level in range(self.floor):
            out = _mix(out * _FACTOR + low[:, level])
        tail = np.zeros(self.shape[0], np.uint64)
        for level in range(self.floor, self.shape[1]):
            tail = tail << np.uint64(self.bits) | _mix(low[:, level]) >> np.uint64(64 - self.bits)
        return out.view(np.int64), tail.view(np.int64)


def print_bits(floor: int, deepest: int = MAX_DEPTH) -> int:
    """Bits of the print of one deeper hash; all of them fit in a long."""
    return min(21, 62 // max(1, deepest - floor))


def _signatures(rows: DataFrame, size: int, floor: int) -> DataFrame:
    """``doc_id, key_text``, the copy class (two hashes), its bytes, and the signature (null without shingles)."""
    longs = ["key_text", "c1", "c2", "bytes"]
    schema = StructType(
        [StructField("doc_id", rows.schema["doc_id"].dataType)] + [StructField(n, LongType()) for n in longs] + [StructField(n, ArrayType(LongType())) for n in ("prefixes", "tails")]
    )

    def make():
        forest = Forest(floor)

        def turn(batch: pa.RecordBatch):
            copies, signs = [], []
            for text in batch.column(2).to_pylist():
                words = canonical(text)
                own = words or b"\0" + text.encode("utf-8", "surrogatepass")
                copies.append((xxhash.xxh3_128_intdigest(own), len(words)))
                signs.append(forest.sign(shingles(words, size)) if words else (None, None))
            digest = np.frombuffer(b"".join(c.to_bytes(16, "little") for c, _ in copies), "<i8").reshape(-1, 2)
            return {
                "doc_id": batch.column(0), "key_text": batch.column(1), "c1": digest[:, 0], "c2": digest[:, 1], "bytes": [n for _, n in copies],
                "prefixes": [p for p, _ in signs], "tails": [t for _, t in signs],
            }

        return turn

    return map_slices(rows.select("doc_id", "key_text", "text"), make, schema)


def trie_matches(places: DataFrame, floor: int, deepest: int = MAX_DEPTH) -> DataFrame:
    """``u, v, depth``: matches of leaves of the sorted tries, by the longest prefix a leaf shares with the one before it.

    ``places`` has ``tree, prefix, tail, node``.  Classes that share a prefix are a run of leaves.  A leaf is matched
    with the first one of the run that its longest prefix makes, so the matches of at least some depth connect exactly
    the runs of that depth, in few steps.  Only prefixes of ``floor`` hashes or more count.  Runs that go over the end of
    a task are joined by the first and last leaves of the tasks.
    """
    order, bits, levels = ["tree", "prefix", "tail", "node"], print_bits(floor, deepest), deepest - floor
    schema = StructType([StructField("depth", IntegerType())] + [StructField(n, LongType()) for n in ("u", "v", "part", "tree", "prefix", "tail")])

    def run(batches):
        part = TaskContext.get().partitionId()
        last, starts = None, None  # the leaf before, and the first leaf of its run at each depth

        def end(kind: int) -> pa.RecordBatch:
            values = [[kind], [int(last[3])], [int(last[3])], [part], [int(last[0])], [int(last[1])], [int(last[2])]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.int32()] + [pa.int64()] * 6)], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(4)])
            if last is None:
                last, starts = rows[:, 0], np.full(levels + 1, rows[3, 0])
                yield end(0)
                rows = rows[:, 1:]
            leaves = np.concatenate([last[:, None], rows], 1)
            same = (leaves[0, 1:] == leaves[0, :-1]) & (leaves[1, 1:] == leaves[1, :-1])
            depth = np.where(same, floor, 0)
            for level in range(levels):
                by = bits * (levels - 1 - level)
                depth += same & ((leaves[2, 1:] >> by) == (leaves[2, :-1] >> by))
            first = np.zeros((levels + 1, rows.shape[1]), np.int64)
            for level in range(levels + 1):
                begun = np.maximum.accumulate(np.where(depth < floor + level, np.arange(len(depth)), -1)) if len(depth) else depth
                first[level] = np.where(begun >= 0, rows[3][np.maximum(begun, 0)], starts[level]) if len(depth) else 0
            if len(depth):
                last, starts = rows[:, -1], first[:, -1]
            near = np.flatnonzero(depth)
            zeros = pa.array(np.zeros(len(near), np.int64))
            columns = [pa.array(depth[near], pa.int32()), pa.array(first[depth[near] - floor, near]), pa.array(rows[3, near])]
            yield pa.RecordBatch.from_arrays([*columns, *[zeros] * 4], names=schema.names)
        if last is not None:
            yield end(-1)

    found = shared_checkpoint(places.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema))
    ends = found.where(F.col("depth") <= 0)  # two rows for each task
    following = Window.orderBy("part", F.desc("depth"))
    over = ends.withColumns({f"next_{c}": F.lead(c).over(following) for c in ("part", "tree", "prefix", "tail", "u")})
    over = over.where((F.col("depth") == -1) & (F.col("next_part") != F.col("part")) & (F.col("tree") == F.col("next_tree")) & (F.col("prefix") == F.col("next_prefix")))
    depth = F.lit(floor)
    for level in range(levels):
        by = bits * (levels - 1 - level)
        depth = depth + F.when(F.shiftright("tail", by) == F.shiftright("next_tail", by), 1).otherwise(0)
    spanning = ends.select("u", F.first("u").over(Window.partitionBy("tree", "prefix").orderBy("part", F.desc("depth"))).alias("v"), F.lit(floor).alias("depth"))
    matched = found.where(F.col("depth") > 0).select("u", "v", "depth").unionByName(over.select("u", F.col("next_u").alias("v"), depth.alias("depth"))).unionByName(spanning)
    matched = matched.where(F.col("u") != F.col("v"))
    return matched.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("depth").alias("depth"))


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted distinct arrays, left by right.

    Of arrays with themselves the diagonal holds only what others share too.
    """
    same = left is right
    sets = left if same else left + right
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    column = np.cumsum(first) - 1
    shared = np.bincount(column, minlength=1)[column] > 1 if len(values) else first  # others meet in no pair
    owner, column = owner[shared], column[shared]
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(column):
        return out
    edges = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
    for at in range(0, len(edges), MATRIX_COLUMNS):
        begin = edges[at]
        end = edges[at + MATRIX_COLUMNS] if at + MATRIX_COLUMNS < len(edges) else len(column)
        names, local = np.unique(column[begin:end], return_inverse=True)
        matrix = np.zeros((len(sets), len(names)), np.float32)
        matrix[owner[begin:end], local] = 1.0
        out += matrix @ matrix.T if same else matrix[: len(left)] @ matrix[len(left) :].T
    return out


def _parts(links: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each, by a symmetric matrix of links."""
    labels = nodes.copy()
    big = np.iinfo(np.int64).max
    while True:
        new = np.minimum(labels, np.where(links, labels[None, :], big).min(1, initial=big))
        if (new == labels).all():
            return labels
        labels = new


def _compare_cell(cell: pd.DataFrame, size: int, similarity: float) -> pd.DataFrame:
    """Links and local roots of the classes of one cell: one block with itself, or two with each other."""
    nodes = cell["node"].to_numpy()
    sets = [shingles(canonical(text), size) for text in cell["text"]]
    lengths = np.array([len(s) for s in sets], np.float32)
    left, right = int(cell["left"].iloc[0]), int(cell["right"].iloc[0])
    tree = int(cell["tree"].iloc[0])
    block = cell["block"].to_numpy()
    a = np.flatnonzero(block == left)
    b = a if left == right else np.flatnonzero(block == right)
    sets_a = [sets[i] for i in a]
    common = intersections(sets_a, sets_a if left == right else [sets[i] for i in b])
    union = lengths[a][:, None] + lengths[b][None, :] - common
    linked = (common >= similarity * union - 1e-3) & (nodes[a][:, None] != nodes[b][None, :])
    prefixes = np.array(cell["prefixes"].tolist(), np.int64)
    if tree >= 0:  # a pair counts in the first tree where it meets
        for earlier in range(tree):
            linked &= prefixes[a, earlier][:, None] != prefixes[b, earlier][None, :]
    else:  # and only if it meets in any
        meets = np.zeros_like(linked)
        for t in range(prefixes.shape[1]):
            meets |= prefixes[a, t][:, None] == prefixes[b, t][None, :]
        linked &= meets
    full = np.zeros((len(nodes), len(nodes)), bool)
    full[np.ix_(a, b)] = linked
    full |= full.T
    return pd.DataFrame({"node": nodes, "root": _parts(full, nodes), "links": full.sum(1).astype(np.int64)})


def _first():
    """The smallest id, ids before nulls; then the smallest text."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key_text"))


def _judged(docs: DataFrame, id_col: str, text_col: str, size: int, similarity: float, max_blocks: int, block_classes: int) -> DataFrame:
    """For each row with a text: its keys, and ``class`` and ``copy`` (first document of each), ``n_copies, n_links``."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    some = named.where(F.col("text").isNotNull()).select("doc_id", "text", *row_key("doc_id", "text"))
    floor = prefix_depth(similarity)
    signed = shared_checkpoint(_signatures(some, size, floor))
    classes = signed.groupBy("c1", "c2").agg(
        _first().alias("first"), F.count(F.lit(1)).alias("n_copies"), F.max("bytes").alias("bytes"), F.any_value("prefixes").alias("prefixes"), F.any_value("tails").alias("tails")
    )
    # Numbered once and stored, so that the numbers stay.
    classes = shared_checkpoint(classes.withColumn("node", F.monotonically_increasing_id()))
    shingled = classes.where(F.col("prefixes").isNotNull())
    places = shingled.select("node", F.posexplode(F.arrays_zip("prefixes", "tails")).alias("tree", "at")).select("tree", F.col("at.prefixes").alias("prefix"), F.col("at.tails").alias("tail"), "node")
    matches = shared_checkpoint(trie_matches(places, floor))
    depth = shortened_depth({r.depth: r["count"] for r in matches.groupBy("depth").count().collect()}, floor)
    groups = connected_components(matches.where(F.col("depth") >= depth).select("u", "v"))
    cut = print_bits(floor) * (MAX_DEPTH - depth)
    deeper = F.col("prefixes") if depth == floor else F.transform(F.arrays_zip("prefixes", "tails"), lambda p: F.xxhash64(p["prefixes"], F.shiftright(p["tails"], cut)))
    keyed = shingled.select("node", "bytes", deeper.alias("prefixes"), F.xxhash64("first.doc_id", F.lit(11)).alias("key_id"), F.col("first.key_text").alias("key_text"))
    cells = _cells(keyed, groups, max_blocks, block_classes)
    wanted = cells.select("key_id", "key_text").distinct()
    texts = some.join(small_side(shared_checkpoint(wanted), BROADCAST_ROWS), ["key_id", "key_text"], "left_semi").select("key_id", "key_text", "text")
    if _has_repeats(some.select("key_id", "key_text")):
        texts = texts.dropDuplicates(["key_id", "key_text"])
    filled = cells.join(texts, ["key_id", "key_text"])
    compared = shared_checkpoint(
        filled.groupBy("group", "tree", "left", "right").applyInPandas(lambda cell: _compare_cell(cell, size, similarity), "node long, root long, links long")
    )
    roots = connected_components(compared.where(F.col("node") != F.col("root")).select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = compared.groupBy("node").agg(F.sum("links").alias("n_links"))
    own = classes.select("c1", "c2", "node", "first", "n_copies").join(roots, "node", "left").join(links, "node", "left")
    own = shared_checkpoint(own.withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long"))))
    linked = own.where(F.col("root").isNotNull())
    heads = linked.groupBy("root").agg(F.min("first").alias("class"), F.count(F.lit(1)).alias("n"))
    columns = ["c1", "c2", F.col("first").alias("copy"), "n_copies", "n_links", "class"]
    of_class = split_join(linked, heads, ["root"], "n").select(*columns).unionByName(own.where(F.col("root").isNull()).withColumn("class", F.col("first")).select(*columns))
    of_class = shared_checkpoint(of_class.withColumn("rows", F.col("n_copies")))
    return split_join(signed.select("doc_id", "key_text", "c1", "c2"), of_class, ["c1", "c2"], "rows")


def join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    similarity: float = SIMILARITY,
    max_blocks: int = MAX_BLOCKS,
    block_classes: int = BLOCK_CLASSES,
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, class_id, copy_id, n_copies, n_links``.

    ``class_id`` is the smallest id that chains of links and copies lead to;
    ``copy_id`` the smallest with the same words; ``n_copies`` the rows with
    these words; ``n_links`` the number of other copy classes of at least the
    given similarity.
    """
    judged = _judged(docs, id_col, text_col, size, similarity, max_blocks, block_classes)
    given = judged.select("doc_id", F.col("class.doc_id").alias("class_id"), F.col("copy.doc_id").alias("copy_id"), "n_copies", "n_links")
    doc_id = F.col(id_col)
    alone = docs.where(F.col(text_col).isNull()).select(
        doc_id.alias("doc_id"), doc_id.alias("class_id"), doc_id.alias("copy_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links")
    )
    return given.unionByName(alone)


def _cells(classes: DataFrame, groups: DataFrame, max_blocks: int, block_classes: int) -> DataFrame:
    """Where each class is compared: group, tree (-1 for all), its block, and the two blocks of the cell."""

    def blocks(n: str, size: str):
        return F.greatest(F.ceil(F.col(n) / block_classes), F.ceil(F.col(size) / BLOCK_BYTES)).cast("int")

    members = shared_checkpoint(classes.join(groups, "node"))
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("all_bytes"))
    sized = shared_checkpoint(split_join(members, sizes.select("root", blocks("n", "all_bytes").alias("blocks"), "n"), ["root"], "n", total=members.count()))
    own = ["node", "key_id", "key_text", "prefixes"]
    whole = sized.where(F.col("blocks") <= max_blocks).select(*own, F.col("root").alias("group"), F.lit(-1).alias("tree"), "blocks")
    apart = sized.where(F.col("blocks") > max_blocks).select(*own, "bytes", F.posexplode("prefixes").alias("tree", "prefix"))
    buckets = shared_checkpoint(
        apart.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("all_bytes")).where(F.col("n") > 1).select("tree", "prefix", "n", blocks("n", "all_bytes").alias("blocks"))
    )
    taken_apart = split_join(apart, buckets, ["tree", "prefix"], "n").select(*own, F.col("prefix").alias("group"), "tree", "blocks")
    placed = whole.unionByName(taken_apart).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return placed.select("*", other).select(*own, "group", "tree", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))


def _has_repeats(rows: DataFrame) -> bool:
    return bool(rows.groupBy(*rows.columns).count().where(F.col("count") > 1).take(1))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class: the one that names it, see :func:`join`.

    Null texts always stay.  Rows that repeat an id with another text are judged by their text; of rows repeated
    with the same id and text one stays, if it names the class.
    """
    judged = _judged(docs, id_col, text_col, SHINGLE, similarity, MAX_BLOCKS, BLOCK_CLASSES)
    key_id, head_id = F.xxhash64("doc_id", F.lit(11)), F.xxhash64("class.doc_id", F.lit(11))
    judged = shared_checkpoint(judged.select(key_id.alias("key_id"), "key_text", ((key_id == head_id) & (F.col("key_text") == F.col("class.key_text"))).alias("stays")))
    goes = shared_checkpoint(judged.where(~F.col("stays")).select("key_id", "key_text").distinct())
    named = docs.select(*(F.col(c).alias(f"c_{i}") for i, c in enumerate(docs.columns)))
    doc_id, text = (F.col(f"c_{docs.columns.index(c)}") for c in (id_col, text_col))
    keyed = named.select("*", *row_key(doc_id, text.cast("string")))
    with_text = keyed.where(text.isNotNull()).join(small_side(goes, BROADCAST_ROWS), ["key_id", "key_text"], "left_anti")
    if _has_repeats(judged.where("stays").select("key_id", "key_text")):
        with_text = with_text.dropDuplicates(["key_id", "key_text"])
    kept = with_text.unionByName(keyed.where(text.isNull()))
    return kept.select(*(F.col(f"c_{i}").alias(c) for i, c in enumerate(docs.columns)))
