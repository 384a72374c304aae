"""Byte-level BPE encoding and decoding with a segment tree.

A segment tree over the byte positions of a piece keeps in every node the
smallest ``rank * width + position`` of its range, where ``rank`` is that of the
pair which starts at the position.  The root therefore names the leftmost pair
of the lowest rank.  A merge changes at most three leaves (the merged position,
the one swallowed, and the live neighbour before it), each a walk of logarithmic
length to the root.

Short pieces, nearly all of a text, run through the tree in numpy, many pieces
side by side; a long piece runs through the same tree alone.  Pieces already
merged are kept in a bounded cache.

Defined cases: a null text counts as an empty one, which has no tokens; repeated
rows each give a row; the result has the columns named here whatever else the
input holds.  A text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import id_and_text, map_slices

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces up to this many bytes are merged side by side.
SIDE_BY_SIDE = 64
#: Pieces merged in one numpy call.
GROUP = 4096
#: Bytes of pieces and their ids that a task remembers before it forgets them all, and what Python adds to each; long pieces are not remembered.
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 200

_NONE = np.int64(1) << 62


def vocabulary_path(path: str | None) -> str:
    """``path``, or the default vocabulary's place on the machine that asks."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PairTable:
    """A table of pairs of numbers, ``left << 32 | right`` to a number, for whole arrays of pairs."""

    def __init__(self, by_pair: dict[int, int]):
        self.by_pair = by_pair
        size = 1 << max(4, (4 * len(self.by_pair)).bit_length())
        self._shift = np.uint64(64 - size.bit_length() + 1)
        self._mask = size - 1
        self._keys = np.full(size, -1, np.int64)
        self._ranks = np.full(size, -1, np.int64)
        pairs = np.fromiter(self.by_pair.keys(), np.int64, len(self.by_pair))
        values = np.fromiter(self.by_pair.values(), np.int64, len(self.by_pair))
        slots = self._slot(pairs)
        left = np.arange(len(pairs))
        while len(left):  # one round puts at most one pair into each free slot
            free = left[self._keys[slots[left]] == -1]
            _, first = np.unique(slots[free], return_index=True)
            put = free[first]
            self._keys[slots[put]], self._ranks[slots[put]] = pairs[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slots[left] = (slots[left] + 1) & self._mask

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number of each pair, -1 where there is none."""
        pairs = left.astype(np.int64) << 32 | right.astype(np.int64)
        slots = self._slot(pairs)
        found = self._keys[slots]
        out = np.where(found == pairs, self._ranks[slots], -1)
        open_ = np.flatnonzero((found != pairs) & (found != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self._mask
            found = self._keys[slots[open_]]
            hit = found == pairs[open_]
            out[open_[hit]] = self._ranks[slots[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


def pair_ranks(ranks: dict[bytes, int]) -> PairTable:
    """Rank of the token that two adjacent tokens make."""
    by_pair: dict[int, int] = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                by_pair[left << 32 | right] = rank
    return PairTable(by_pair)


class SegmentTreeBpe:
    """Encoder and decoder of one vocabulary of byte tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks = ranks
        self.pairs = pair_ranks(ranks)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.token = {rank: token for token, rank in ranks.items()}

    def merge_one(self, piece: bytes) -> np.ndarray:
        """Token ids of one piece, by the tree alone."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        none = int(_NONE)
        by_pair = self.pairs.by_pair
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = by_pair.get(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b

        def put(leaf: int, value: int) -> None:
            node = width + leaf
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:
                    break
                tree[node] = low
                node >>= 1

        def pair_at(i: int) -> int:
            j = after[i]
            rank = by_pair.get(ids[i] << 32 | ids[j]) if j < n else None
            return none if rank is None else rank * width + i

        while tree[1] != none:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            ids[at], ids[gone] = rank, -1
            after[at] = after[gone]
            before[after[gone]] = at
            put(gone, none)
            put(at, pair_at(at))
            if before[at] >= 0:
                put(before[at], pair_at(before[at]))
        return np.array([x for x in ids if x >= 0], np.int64)

    def merge_side_by_side(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of many pieces of at most ``width`` bytes, each as little-endian 32-bit integers."""
        count = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, count)
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)
        ids = self.of_byte[flat].reshape(count, width)
        ids[np.arange(width)[None, :] >= lengths[:, None]] = -1
        tree = np.full((count, 2 * width), _NONE)
        live = ids[:, 1:] >= 0
        first = np.where(live, self.pairs.look_up(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(live.shape), -1)
        tree[:, width : 2 * width - 1] = np.where(first >= 0, first * width + np.arange(width - 1), _NONE)
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        after = np.tile(np.arange(1, width + 1), (count, 1))
        before = np.tile(np.arange(-1, width), (count, 1))
        flat_ids, flat_tree = ids.reshape(-1), tree.reshape(-1)

        def put(rows: np.ndarray, leaves: np.ndarray, values: np.ndarray) -> None:
            base, node = rows * (2 * width), width + leaves
            flat_tree[base + node] = values
            node = node >> 1
            while node[0]:  # all leaves are equally deep
                at = base + 2 * node
                flat_tree[base + node] = np.minimum(flat_tree[at], flat_tree[at + 1])
                node = node >> 1

        def pair_values(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            right = after[rows, at]
            inside = right < lengths[rows]
            ranks = self.pairs.look_up(flat_ids[rows * width + at], flat_ids[rows * width + np.where(inside, right, 0)])
            return np.where(inside & (ranks >= 0), ranks * width + at, _NONE)

        rows = np.arange(count)
        while True:
            rows = rows[tree[rows, 1] != _NONE]
            if not len(rows):
                break
            root = tree[rows, 1]
            at = root % width
            gone = after[rows, at]
            follower = after[rows, gone]
            flat_ids[rows * width + at] = root // width
            flat_ids[rows * width + gone] = -1
            after[rows, at] = follower
            before[rows, follower] = at
            put(rows, gone, np.full(len(rows), _NONE))
            put(rows, at, pair_values(rows, at))
            left = before[rows, at]
            some = left >= 0
            if some.any():
                put(rows[some], left[some], pair_values(rows[some], left[some]))
        kept = ids >= 0
        raw = ids[kept].astype("<u4").tobytes()
        ends = (np.cumsum(kept.sum(1)) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct pieces, as little-endian 32-bit integers."""
        out, groups = {}, {}
        for piece in pieces:
            whole = self.ranks.get(piece)
            if whole is not None:
                out[piece] = whole.to_bytes(4, "little")
            elif len(piece) <= SIDE_BY_SIDE:
                groups.setdefault(1 << (len(piece) - 1).bit_length(), []).append(piece)
            else:
                out[piece] = self.merge_one(piece).astype("<u4").tobytes()
        for width, members in groups.items():
            for start in range(0, len(members), GROUP):
                part = members[start : start + GROUP]
                out.update(zip(part, self.merge_side_by_side(part, width)))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for; an unknown id is an error."""
        token = self.token
        return b"".join([token[i] for i in ids.tolist()])


class TextEncoder:
    """Whole texts to ids: splits by the pattern, merges each piece, remembers pieces."""

    def __init__(self, path: str | None = None, pattern: str | None = None, cache_bytes: int = CACHE_BYTES):
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        self.bpe = SegmentTreeBpe(read_ranks(vocabulary_path(path)))
        self.split = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}
        self.cache_bytes, self.cached = cache_bytes, 0

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        split = [self.split.findall(text) for text in texts]
        if self.cached > self.cache_bytes:
            self.cache, self.cached = {}, 0
        cache = self.cache
        fresh = list({piece: None for pieces in split for piece in pieces if piece not in cache})
        long = {}
        if fresh:
            raw = [piece.encode("utf-8", "surrogatepass") for piece in fresh]
            merged = self.bpe.encode_pieces(raw)
            for piece, key in zip(fresh, raw):
                if len(key) > SIDE_BY_SIDE:
                    long[piece] = merged[key]
                else:
                    cache[piece] = merged[key]
                    self.cached += len(key) + len(merged[key]) + ENTRY_BYTES
        if not long:
            return [b"".join([cache[piece] for piece in pieces]) for pieces in split]
        return [b"".join([cache[piece] if piece in cache else long[piece] for piece in pieces]) for pieces in split]

    def decode_ids(self, ids: bytes) -> bytes:
        """Bytes of ids given as little-endian 32-bit integers."""
        return self.bpe.decode(np.frombuffer(ids, "<u4"))


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [text or "" for text in batch.column(1).to_pylist()]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (binary, little-endian 32-bit) of every row."""
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), StructField("n_tokens", LongType()), StructField("ids", BinaryType())])

    def make():
        encoder = TextEncoder(path)

        def turn(batch):
            ids = encoder.encode_texts(_texts(batch))
            return {"doc_id": batch.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids": ids}

        return turn

    return map_slices(id_and_text(docs, id_col, text_col), make, schema)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` bytes of rows made by :func:`encode`; null ids give null."""
    schema = StructType([StructField("doc_id", encoded.schema[id_col].dataType), StructField("text", BinaryType())])

    def make():
        encoder = TextEncoder(path)

        def turn(batch):
            return {"doc_id": batch.column(0), "text": [None if x is None else encoder.decode_ids(x) for x in batch.column(1).to_pylist()]}

        return turn

    return map_slices(encoded.select(id_col, ids_col), make, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode every row, decode its ids, and return counts and SHA-256 digests of both."""
    schema = StructType(
        [
            StructField("doc_id", docs.schema[id_col].dataType),
            StructField("n_tokens", LongType()),
            StructField("ids_sha256", StringType()),
            StructField("decoded_sha256", StringType()),
        ]
    )

    def make():
        encoder = TextEncoder(path)

        def turn(batch):
            ids = encoder.encode_texts(_texts(batch))
            return {
                "doc_id": batch.column(0),
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(encoder.decode_ids(x)).hexdigest() for x in ids],
            }

        return turn

    return map_slices(id_and_text(docs, id_col, text_col), make, schema)
