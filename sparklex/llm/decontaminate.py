"""Benchmark decontamination by winnowing, with DataFrame functions alone.

A window is ``WINDOW`` consecutive words of a benchmark item.  Of every window
the smallest hash of its ``GRAM``-word grams is kept as a fingerprint.  A window
that a document shares has the same words, so the same smallest gram, on both
sides: joining the fingerprints misses no shared window.  Each hit is then
extended to all windows around it, and those are joined with the benchmark's
windows by their words, which makes the result exact.

An item of fewer words than a window, but at least one, is one window of its own
length; it is its own fingerprint.

Words are runs of digits, letters a-z (after lower-casing A-Z) and all
characters beyond ASCII.

Defined cases: null text has no words; null item ids match words but are not
listed; repeated items count once; repeated document rows each give a row; an
empty benchmark contaminates nothing.  Only the id and text columns are read.

The benchmark's side of both joins is broadcast if its whole text is at most
``BROADCAST_BYTES``, which is checked.  A larger one is joined by shuffles of the
documents' fingerprints; the words around them are fetched again for the hits
alone, and documents without a hit are in none of these joins.  Items that share
windows are listed once for each distinct list, under a number, and documents
carry only the numbers until they are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, row_key

WINDOW = 10
GRAM = 5
BROADCAST_BYTES = 4 << 20
#: Fingerprints that are written into the plan.
MAX_KNOWN = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Array of a text's words; empty for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _NOT_WORD), "")


def _range(count: Column) -> Column:
    """0 to count - 1; empty if count is not positive."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def _grams(words_col: str) -> Column:
    """Hash of every gram, by place.

    Elements are read one by one: a slice would copy the whole array each time.
    """
    array = F.col(words_col)
    return F.transform(_range(F.size(array) - GRAM + 1), lambda i: F.xxhash64(*(F.get(array, i + k) for k in range(GRAM))))


def _lows(grams_col: str) -> Column:
    """The smallest gram hash of every window, by the window's start."""
    array, count = F.col(grams_col), WINDOW - GRAM + 1
    return F.transform(_range(F.size(array) - count + 1), lambda s: F.least(*(F.get(array, s + k) for k in range(count))))


def _starts(lows_col: str, known: list[int] | None = None) -> Column:
    """Windows at which a run of one smallest gram begins, and every ``WINDOW - GRAM + 1``-th.

    Any window is thus at most ``WINDOW - GRAM`` behind one of these with the
    same smallest gram.  With ``known``, only those whose gram is among them.
    """
    lows, stride = F.col(lows_col), WINDOW - GRAM + 1

    def begins(s: Column) -> Column:
        here = (s % stride == 0) | (F.get(lows, s) != F.get(lows, s - 1))
        return here if known is None else F.get(lows, s).isin(known) & here

    return F.filter(_range(F.size(lows)), begins)


def _text(array: Column, start: Column, length: int) -> Column:
    """The words of a window, joined by blanks."""
    return F.concat_ws(" ", *(F.get(array, start + k) for k in range(length)))


def benchmark_tables(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprints (length, hash), windows (window, list_id), and lists of items (list_id, items), of a benchmark."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col).cast("string")).alias("words")).where(F.size("words") > 0)
    long_ = items.where(F.size("words") >= WINDOW).withColumn("grams", _grams("words")).withColumn("lows", _lows("grams"))
    short = items.where(F.size("words") < WINDOW)
    prints = long_.select(F.lit(WINDOW).alias("length"), F.explode(F.array_distinct("lows")).alias("hash")).unionByName(
        short.select(F.size("words").alias("length"), F.xxhash64(F.array_join("words", " ")).alias("hash"))
    )
    windows = long_.select(
        "item_id", F.explode(F.transform(_range(F.size("words") - WINDOW + 1), lambda s: _text(F.col("words"), s, WINDOW))).alias("window")
    ).unionByName(short.select("item_id", F.array_join("words", " ").alias("window")))
    listed = windows.groupBy("window").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    listed = listed.withColumn("list_id", F.xxhash64("items", F.size("items")))
    return prints.distinct().withColumn("printed", F.lit(True)), listed.select("window", "list_id"), listed.groupBy("list_id").agg(F.first("items").alias("items"))


def _seeds(short_lengths: list[int], with_words: bool, known: dict[int, list[int]] | None = None) -> Column:
    """Fingerprints of a document: place, length of the window sought, hash, and the words around.

    With ``known``, the benchmark's hashes by length, only those among them are made.
    """
    array = F.col("words")

    def seed(at: Column, length: int, hash_: Column, first: Column, count: int) -> Column:
        around = F.array(*(F.get(array, first + k) for k in range(count))) if with_words else F.lit(None).cast("array<string>")
        inside = F.least(F.lit(count), F.size(array) - first)
        return F.struct(
            at.alias("at"), F.lit(length).alias("length"), hash_.alias("hash"), first.alias("first"), inside.alias("count"), around.alias("around")
        )

    found = F.transform(_starts("lows", None if known is None else known.get(WINDOW, [])), lambda i: seed(i, WINDOW, F.get("lows", i), i, 2 * WINDOW - GRAM))

    def short(n: int) -> Column:
        places = _range(F.size(array) - n + 1)
        if known is not None:
            places = F.filter(places, lambda i: F.xxhash64(_text(array, i, n)).isin(known.get(n, [])))
        return F.transform(places, lambda i: seed(i, n, F.xxhash64(_text(array, i, n)), i, n))

    return F.concat(found, *map(short, short_lengths))


def _windows() -> Column:
    """The windows that a seed stands for: where each starts, its length, and its words."""
    around, first, length = F.col("seed.around"), F.col("seed.first"), F.col("seed.length")
    return F.transform(
        _range(F.col("seed.count") - length + 1),
        lambda s: F.struct((first + s).alias("start"), length.alias("length"), F.array_join(F.slice(around, s + 1, length), " ").alias("window")),
    )


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """For each row of ``docs``: its key and id, ``n_words``, ``n_hit``, the windows hit (start, end) and the items found."""
    size = benchmark.select(F.sum(F.octet_length(F.col(item_text_col).cast("string")))).first()[0] or 0
    lengths = words(F.col(item_text_col).cast("string"))
    short_lengths = sorted(
        r[0] for r in benchmark.select(F.size(lengths).alias("n")).where(F.col("n").between(1, WINDOW - 1)).distinct().collect()
    )
    small = size <= broadcast_bytes
    tables = benchmark_tables(benchmark, item_id_col, item_text_col)
    named = id_and_text(docs, id_col, text_col).select(*row_key("doc_id", "text"), "doc_id", words(F.col("text")).alias("words"))
    gathered = _scan_small(named, tables, short_lengths) if small else _scan_large(named, tables, short_lengths)
    # Running over sorted windows: how far words are covered, and how many are.
    start = F.named_struct(F.lit("reached"), F.lit(0), F.lit("n"), F.lit(0).cast("long"))
    covered = F.aggregate(
        "windows",
        start,
        lambda done, w: F.named_struct(
            F.lit("reached"), F.greatest(done["reached"], w["end"]), F.lit("n"), done["n"] + F.greatest(w["end"] - F.greatest(done["reached"], w["start"]), F.lit(0))
        ),
        lambda done: done["n"],
    )
    return gathered.withColumns({"windows": F.array_sort("windows"), "items": F.array_sort(F.array_distinct(F.flatten("items")))}).withColumn("n_hit", covered)


_KEY = ["key_id", "key_text", "doc_id"]
_HIT = "struct<start:int,end:int>"


def _ranges_of_hits() -> Column:
    return F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at.start", (F.col("at.start") + F.col("at.length")).alias("end"))))


def _read(named: DataFrame) -> DataFrame:
    return named.withColumn("grams", _grams("words")).withColumn("lows", _lows("grams"))


def _scan_small(named: DataFrame, tables: tuple[DataFrame, DataFrame, DataFrame], short_lengths: list[int]) -> DataFrame:
    """One pass: every document carries a row of its own through joins with broadcast tables.

    If the benchmark's fingerprints are few they are also known where a document's are made, so that only hits become rows.
    """
    prints, windows, lists = map(F.broadcast, tables)
    few, known = tables[0].select("length", "hash").limit(MAX_KNOWN + 1).collect(), None
    if len(few) <= MAX_KNOWN:
        known = {}
        for r in few:
            known.setdefault(r.length, []).append(r.hash)
    own_row = F.array(F.lit(None).cast("struct<at:int,length:int,hash:bigint,first:int,count:int,around:array<string>>"))
    seeds = _read(named).select(*_KEY, F.size("words").alias("n_words"), F.explode(F.concat(own_row, _seeds(short_lengths, with_words=True, known=known))).alias("seed"))
    hits = seeds.join(prints, (F.col("seed.length") == prints["length"]) & (F.col("seed.hash") == prints["hash"]), "left").where(F.col("printed") | F.col("seed").isNull())
    no_window = F.array(F.lit(None).cast("struct<start:int,length:int,window:string>"))
    spread = hits.select(*_KEY, "n_words", F.explode(F.when(F.col("seed").isNull(), no_window).otherwise(_windows())).alias("at"))
    found = spread.join(windows, F.col("at.window") == windows["window"], "left").where(F.col("list_id").isNotNull() | F.col("at").isNull())
    merged = found.groupBy(*_KEY).agg(
        F.max("n_words").cast("long").alias("n_words"), F.count(F.when(F.col("at").isNull(), 1)).alias("rows"), _ranges_of_hits().alias("windows"), F.collect_set("list_id").alias("list_ids")
    )
    # The same key deals out what follows, so nothing is shuffled again.
    listed = merged.select("*", F.explode_outer("list_ids").alias("list_id")).join(lists, "list_id", "left")
    whole = listed.groupBy(*_KEY).agg(*(F.first(c).alias(c) for c in ("n_words", "rows", "windows")), F.collect_list("items").alias("items"))
    return whole.select(*_KEY, "n_words", "windows", "items", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("row")).drop("row")


def _scan_large(named: DataFrame, tables: tuple[DataFrame, DataFrame, DataFrame], short_lengths: list[int]) -> DataFrame:
    """Joins by shuffle, of fingerprints alone; what is found meets the documents again by their keys."""
    prints, windows, lists = tables
    key = ["key_id", "key_text"]
    seeds = _read(named).select(*key, F.explode(_seeds(short_lengths, with_words=False)).alias("seed"))
    hits = seeds.join(prints, (F.col("seed.length") == prints["length"]) & (F.col("seed.hash") == prints["hash"])).select(*key, "seed").distinct()
    length = F.when(F.col("seed.length") == WINDOW, WINDOW + WINDOW - GRAM).otherwise(F.col("seed.length"))
    around = F.slice("words", F.col("seed.first") + 1, length)
    # Seeds of a document are gathered first, so that its words travel once.
    by_doc = hits.groupBy(*key).agg(F.collect_list("seed").alias("seeds"))
    texts = named.select(*key, "words").join(by_doc, key).dropDuplicates(key)
    filled = texts.select(*key, "words", F.explode("seeds").alias("seed")).select(
        *key, F.struct("seed.at", "seed.length", "seed.hash", "seed.first", "seed.count", around.alias("around")).alias("seed")
    )
    spread = filled.select(*key, F.explode(_windows()).alias("at"))
    found = spread.join(windows, F.col("at.window") == windows["window"]).groupBy(*key).agg(_ranges_of_hits().alias("windows"), F.collect_set("list_id").alias("list_ids"))
    items = found.select(*key, F.explode("list_ids").alias("list_id")).join(lists, "list_id").groupBy(*key).agg(F.collect_list("items").alias("items"))
    base = named.select(*_KEY, F.size("words").cast("long").alias("n_words"))
    none = F.array().cast(f"array<{_HIT}>"), F.array().cast("array<array<string>>")
    joined = base.join(found.select(*key, "windows").join(items, key), key, "left")
    return joined.select(*_KEY, "n_words", F.coalesce("windows", none[0]).alias("windows"), F.coalesce("items", none[1]).alias("items"))


def digests(scanned: DataFrame) -> DataFrame:
    """The contract's columns from the rows of :func:`scan`."""
    return scanned.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that share a window with the benchmark; null texts stay."""
    hit = scan(docs, benchmark, id_col, text_col, **options).where("n_hit > 0").select(F.col("key_id").alias("h_id"), F.col("key_text").alias("h_text"))
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = packed.select("row", *row_key("doc_id", "text"))
    return keyed.join(hit, (F.col("key_id") == F.col("h_id")) & (F.col("key_text") == F.col("h_text")), "left_anti").select("row.*")
