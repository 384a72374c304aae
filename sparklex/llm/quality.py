"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

Two kinds of evidence meet in log-odds.

*Document.*  Two logistic models, one for low quality and one for toxicity, read
the shape of a text (its share of letters, capitals, repeats and so on) and those
words that labelled documents tie to either label.  They are fitted on a bounded
sample of labelled rows, ``max_train_docs``.

*Site.*  Labels are counted by host, and by path within a host, over all
labelled rows, for low quality and for toxicity apart.  A host's rate is shrunk
toward the global rate, and a path's toward its host's, by Beta priors whose weight
is estimated from the spread of the rates between sites (method of moments).  A
site with few labels thus stays near its parent; one without labels takes its
parent's rate.  Rates are found for the distinct sites of the documents, and joined
to them by broadcast if these are counted few; else sites with a large share of the
documents are joined by broadcast and all others by shuffle.

A document is rejected where the posterior probability that it is low in quality
or toxic exceeds ``THRESHOLD``.  A site can move that only as far as the spread
between sites warrants.

Defined cases: rows without a label train nothing; a label of null counts as the
harmless value; of repeated labels of an id the worst counts; if the sample holds
one class only, that model is a constant; a null or empty text is judged by its
shape; a null host or path is a site of its own; a probability right at the
threshold is accepted; repeated rows each give a row; an empty table of documents
gives an empty result, and without labels all are accepted; other columns are kept
as they are, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .common import map_slices, shared_checkpoint, small_batches, small_side, split_join

MAX_TRAIN_DOCS = 20_000
HASH_BITS = 20
#: Labelled documents that must hold a word before it can be evidence, and how clear its evidence must be.
MIN_WORD_DOCS = 4
MIN_Z = 5.0
MAX_WORDS = 500
NEWTON_STEPS = 25
#: Labelled documents that the driver works on at once.
CHUNK = 1000
RIDGE = 0.2
THRESHOLD = 0.5
MAX_LOG_ODDS = 12.0
BROADCAST_SITES = 200_000

_WORD = regex.compile(r"\p{L}+")
_MARKED = regex.compile(r"[^\s\p{L}\p{N}.,;:'\"()-]")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text)


def shape(text: str, words: list[str], distinct: int) -> list[float]:
    """Numbers that describe a text's form, each about 0 to 1."""
    n = max(len(text), 1)
    tokens = text.split()
    letters = sum(map(len, words))
    capitals = sum(1 for w in words if len(w) > 1 and w.isupper())
    lines = text.count("\n") + 1
    marks = len(_MARKED.findall(text))
    return [
        letters / n,
        capitals / max(len(words), 1),
        1 - distinct / max(len(words), 1),
        min(marks / max(len(tokens), 1), 3.0) / 3,
        _digits(text) / n,
        min(len(tokens) / lines, 200) / 200,
        math.log1p(len(tokens)) / 12,
        min(letters / max(len(words), 1), 20) / 20,
        len(set(tokens)) / max(len(tokens), 1),
    ]


def _digits(text: str) -> int:
    return sum(text.count(d) for d in "0123456789")


SHAPES = 9


def buckets(words: list[str]) -> np.ndarray:
    """Hash buckets of the distinct lower-cased words."""
    mask = (1 << HASH_BITS) - 1
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) & mask for w in {w.lower() for w in words}), np.int32))


@dataclass(frozen=True)
class Logistic:
    """Weights of shape numbers and of a few word buckets."""

    centre: np.ndarray
    scale: np.ndarray
    shape_weights: np.ndarray
    word_buckets: np.ndarray
    word_weights: np.ndarray
    bias: float

    def log_odds(self, shapes: np.ndarray, words: np.ndarray) -> float:
        z = self.bias + float(((shapes - self.centre) / self.scale) @ self.shape_weights)
        if len(self.word_buckets):
            at = np.minimum(np.searchsorted(self.word_buckets, words), len(self.word_buckets) - 1)
            z += float(self.word_weights[at[self.word_buckets[at] == words]].sum())
        return max(-MAX_LOG_ODDS, min(MAX_LOG_ODDS, z))


def _fit_logistic(shapes: np.ndarray, words: list[np.ndarray], label: np.ndarray) -> Logistic:
    """Ridge logistic regression by Newton steps on shapes and clearly informative words."""
    n, positive = len(label), int(label.sum())
    centre, scale = shapes.mean(0), shapes.std(0) + 1e-3
    if not 0 < positive < n:
        bias = math.log((positive + 0.5) / (n - positive + 0.5))
        return Logistic(centre, scale, np.zeros(shapes.shape[1]), np.zeros(0, np.int32), np.zeros(0), bias)
    total, bad = (np.zeros(1 << HASH_BITS, np.int64) for _ in range(2))
    for start in range(0, n, CHUNK):  # piece by piece, to keep the driver small
        part, own = words[start : start + CHUNK], label[start : start + CHUNK]
        total += np.bincount(np.concatenate(part), minlength=1 << HASH_BITS)
        bad += np.bincount(np.concatenate([w for w, y in zip(part, own) if y] or [part[0][:0]]), minlength=1 << HASH_BITS)
    rate = positive / n
    spread = np.sqrt(np.maximum(total * rate * (1 - rate), 1e-9))
    z = (bad - total * rate) / spread
    chosen = np.flatnonzero((total >= MIN_WORD_DOCS) & (np.abs(z) >= MIN_Z))
    chosen = np.sort(chosen[np.argsort(-np.abs(z[chosen]), kind="stable")][:MAX_WORDS]).astype(np.int32)
    x = np.zeros((n, 1 + shapes.shape[1] + len(chosen)), np.float32)
    x[:, 0] = 1
    x[:, 1 : 1 + shapes.shape[1]] = (shapes - centre) / scale
    for row, own in enumerate(words if len(chosen) else []):
        at = np.searchsorted(own, chosen)
        x[row, 1 + shapes.shape[1] :] = (at < len(own)) & (own[np.minimum(at, len(own) - 1)] == chosen) if len(own) else 0
    weights = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[0] = 1e-6
    for _ in range(NEWTON_STEPS):
        gradient, curvature = ridge * weights, np.diag(ridge)
        for start in range(0, n, CHUNK):
            part = x[start : start + CHUNK].astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(part @ weights, -30, 30)))
            gradient += part.T @ (p - label[start : start + CHUNK])
            curvature += (part * (p * (1 - p) + 1e-6)[:, None]).T @ part
        step = np.linalg.solve(curvature, gradient)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    k = 1 + shapes.shape[1]
    return Logistic(centre, scale, weights[1:k], chosen, weights[k:], float(weights[0]))


@dataclass(frozen=True)
class DocumentModel:
    """The two models, and the rates of their labels in the sample."""

    low_quality: Logistic
    toxic: Logistic


def _labelled(labels: DataFrame, id_col: str) -> DataFrame:
    return (
        labels.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("label_id"))
        .agg(
            F.max(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("low"),
            F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
        )
    )


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", max_train_docs: int = MAX_TRAIN_DOCS) -> DocumentModel:
    """Fit the document models on at most about ``max_train_docs`` labelled rows, drawn by a hash of the id."""
    labelled = shared_checkpoint(_labelled(labels, label_id_col))
    share = min(1.0, max_train_docs / max(labelled.count(), 1))
    drawn = labelled.where(F.pmod(F.xxhash64("label_id", F.lit(5)), F.lit(1_000_000)) < F.lit(round(share * 1_000_000)))
    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).cast("string").alias("text")).join(
        small_side(drawn, 2 * max_train_docs), "label_id"
    )
    schema = StructType(
        [StructField("low", IntegerType()), StructField("toxic", IntegerType()), StructField("shape", ArrayType(DoubleType())), StructField("words", ArrayType(IntegerType()))]
    )

    def turn(batch: pa.RecordBatch):
        read = [_read(text) for text in batch.column(2).to_pylist()]
        return {"low": batch.column(0), "toxic": batch.column(1), "shape": [r[0] for r in read], "words": [r[1] for r in read]}

    table = map_slices(rows.select("low", "toxic", "text"), lambda: turn, schema).toArrow()
    shapes = np.array(table.column("shape").to_pylist(), np.float64).reshape(-1, SHAPES)
    words = [np.asarray(w.values, np.int32) for w in table.column("words")]
    low, toxic = (np.array(table.column(c).to_pylist(), np.float64) for c in ("low", "toxic"))
    if not len(low):
        nothing = Logistic(np.zeros(SHAPES), np.ones(SHAPES), np.zeros(SHAPES), np.zeros(0, np.int32), np.zeros(0), -MAX_LOG_ODDS)
        return DocumentModel(nothing, nothing)
    return DocumentModel(_fit_logistic(shapes, words, low), _fit_logistic(shapes, words, toxic))


def _read(text: str | None) -> tuple[list[float], np.ndarray]:
    words = words_of(text or "")
    return shape(text or "", words, len(set(words))), buckets(words)


def evidence(docs: DataFrame, model: DocumentModel, text_col: str = "text") -> Column:
    """Column ``struct<low, toxic>`` of log-odds from the text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([StructField("low", DoubleType()), StructField("toxic", DoubleType())])

    @F.pandas_udf(schema)
    def judge(texts: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(texts), 2))
        for i, text in enumerate(texts):
            shapes, words = _read(text)
            out[i] = shared.value.low_quality.log_odds(np.array(shapes), words), shared.value.toxic.log_odds(np.array(shapes), words)
        return pd.DataFrame(out, columns=["low", "toxic"])

    return judge(F.col(text_col).cast("string"))


def _weight(n_sites: float, n: float, bad: float, squares: float, n_squares: float) -> float:
    """Observations that a parent's rate is worth, from the spread of the rates of its children.

    ``squares`` is the sum of n (rate - parent's rate)^2 over the sites, ``n_squares`` that of n^2.
    """
    rate = (bad + 0.5) / (n + 1)
    inner = rate * (1 - rate)
    room = n - n_squares / n if n else 0.0
    between = (squares - max(n_sites - 1, 0) * inner) / room if room > 0 else 0.0
    return min(inner / between - 1, 1e9) if between > inner * 1e-9 and inner > between else (1e9 if between <= inner * 1e-9 else 1.0)


LABELS = ("low", "toxic")


def site_posteriors(labelled: DataFrame, names: tuple[str, ...] = LABELS) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """Posterior rates by host and by (host, path), and the global rates, from rows ``host, path`` and labels of 0 or 1.

    The rates of a label ``x`` are ``host_x`` and ``path_x``.
    """
    paths = shared_checkpoint(labelled.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(f"k_{x}") for x in names)))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), *(F.sum(f"k_{x}").alias(f"h_{x}") for x in names))
    total = hosts.agg(
        F.count(F.lit(1)).alias("sites"), F.sum("hn").alias("n"), F.sum(F.col("hn").cast("double") ** 2).alias("nn"), *(F.sum(f"h_{x}").alias(f"k_{x}") for x in names)
    ).first()
    n = float(total.n or 0)
    rates = {x: (float(total[f"k_{x}"] or 0) + 0.5) / (n + 1) for x in names}
    spread = hosts.agg(*(F.sum(F.col("hn") * (F.col(f"h_{x}") / F.col("hn") - rates[x]) ** 2).alias(x) for x in names)).first()
    for x in names:
        weight = _weight(total.sites, n, float(total[f"k_{x}"] or 0), spread[x] or 0.0, total.nn or 0.0)
        hosts = hosts.withColumn(f"host_{x}", (F.col(f"h_{x}") + weight * F.lit(rates[x])) / (F.col("hn") + weight))
    joined = paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    inside = joined.agg(
        F.count(F.lit(1)).alias("sites"),
        F.sum(F.col("n").cast("double") ** 2).alias("nn"),
        *(F.sum(F.col("n") * (F.col(f"k_{x}") / F.col("n") - F.col(f"h_{x}") / F.col("hn")) ** 2).alias(x) for x in names),
    ).first()
    path_rates = []
    for x in names:
        weight = _weight(inside.sites - total.sites + 1, n, float(total[f"k_{x}"] or 0), inside[x] or 0.0, inside.nn or 0.0)
        path_rates.append(((F.col(f"k_{x}") + weight * F.col(f"host_{x}")) / (F.col("n") + weight)).alias(f"path_{x}"))
    return hosts.select("host", *(f"host_{x}" for x in names)), joined.select("host", "path", *path_rates), rates


def _site_key(host: Column, path: Column) -> Column:
    return F.xxhash64(host.isNull(), F.coalesce(host, F.lit("")), path.isNull(), F.coalesce(path, F.lit("")))


def site_rates(sites: DataFrame, hosts: DataFrame, paths: DataFrame, rates: dict[str, float]) -> DataFrame:
    """``site, n`` and a rate by label for each distinct ``host, path`` of ``sites``: the path's, else the host's, else the global one."""
    found = sites.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    found = found.join(paths.withColumnsRenamed({"host": "h2", "path": "p2"}), F.col("host").eqNullSafe(F.col("h2")) & F.col("path").eqNullSafe(F.col("p2")), "left")
    found = found.join(small_side(hosts.withColumnRenamed("host", "h1"), BROADCAST_SITES), F.col("host").eqNullSafe(F.col("h1")), "left")
    return found.select(_site_key(F.col("host"), F.col("path")).alias("site"), "n", *(_inside(F.coalesce(f"path_{x}", f"host_{x}", F.lit(rate))).alias(f"rate_{x}") for x, rate in rates.items()))


def _inside(rate: Column) -> Column:
    """A rate that has finite log-odds."""
    return F.least(F.greatest(rate, F.lit(1e-9)), F.lit(1 - 1e-9))


def judge(
    docs: DataFrame,
    labels: DataFrame,
    host: Column | None = None,
    path: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    threshold: float = THRESHOLD,
    broadcast_sites: int = BROADCAST_SITES,
) -> DataFrame:
    """``row`` (all columns of ``docs``) with ``evidence``, ``rate_low``, ``rate_toxic``, ``p_bad`` and ``accepted``.

    The host defaults to the column ``source``, the path to ``lang``: the standard documents have no address, and
    these two are what they say of where they come from.
    """
    host = (F.col("source") if host is None else host).cast("string")
    path = (F.col("lang") if path is None else path).cast("string")
    model = fit(docs, labels, id_col, text_col, label_id_col)
    sites = docs.select(F.col(id_col).alias("label_id"), host.alias("host"), path.alias("path"))
    hosts, paths, rates = site_posteriors(sites.join(_labelled(labels, label_id_col), "label_id").select("host", "path", *LABELS))
    table = shared_checkpoint(site_rates(sites, shared_checkpoint(hosts), paths, rates))
    rows = docs.select(F.struct("*").alias("row"), _site_key(host, path).alias("site"), evidence(docs, model, text_col).alias("evidence"))
    if table.limit(broadcast_sites + 1).count() <= broadcast_sites:
        placed = rows.join(F.broadcast(table.drop("n")), "site")
    else:
        placed = split_join(rows, table, ["site"], "n")
    odds = {x: F.log(F.col(f"rate_{x}") / (1 - F.col(f"rate_{x}"))) - F.lit(math.log(rate / (1 - rate))) for x, rate in rates.items()}
    p_low, p_toxic = (1 / (1 + F.exp(-F.col(f"evidence.{x}") - odds[x])) for x in LABELS)
    return placed.select("row", "evidence", "rate_low", "rate_toxic", F.greatest(p_low, p_toxic).alias("p_bad")).withColumn("accepted", F.col("p_bad") <= threshold)


def accepted(judged: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, from :func:`judge`."""
    return judged.where("accepted").select("row.*")
