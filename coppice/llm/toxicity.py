"""Toxicity by a character n-gram linear classifier with naive Bayes scaled features.

Features are the distinct hashed character n-grams of the whole text (presence, not
counts), each scaled by its naive Bayes log-count ratio between the classes; an L2
logistic regression on the scaled features gives the score (Wang and Manning, "Baselines
and Bigrams").

The classifier is fitted on at most ``per_class`` labelled documents of each class, those
whose key has the smallest hash (documented bound), and on the ``features`` n-gram buckets
that tell the classes apart best. Scoring reads every text whole and needs no shuffle.

Defined results: a null or empty text scores the classifier's intercept; labels that are
null or neither 0 nor 1 are ignored; of several labels of a key the highest counts; without
labels of both classes every score is the smoothed share of class 1. Every row of the
documents gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.ngrams import gram_buckets
from coppice.llm.rows import unclashed
from coppice.session import cut, ship

ORDERS = (3, 4, 5)
BITS = 18


def crc_remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor`` (null keys: of the empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % divisor


def presence(column: pa.Array, chosen: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (row, bucket) pairs in order, for pieces of whole rows; with ``chosen``, of the marked buckets only."""
    for first, found in gram_buckets(column, ORDERS, BITS):
        parts = []
        for rows, buckets in found:
            if chosen is not None:
                hit = chosen[buckets]
                rows, buckets = rows[hit], buckets[hit]
            parts.append(np.unique(rows.astype(np.int64) << BITS | buckets))
        both = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
        yield (both >> BITS) + first, both & ((1 << BITS) - 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, learn: Column | None = None, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """k, t, y of at most ``per_class`` labelled documents a class."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    known = known.filter(learn) if learn is not None else known
    known = known.groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    here = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    known = known.join(here.select("k").filter("k is not null").distinct(), "k", "left_semi")
    take = [known.filter(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(take[0].unionByName(take[1]))  # at most 2 x per_class keys
    return here.join(chosen, "k").groupBy("k", "y").agg(F.min(F.coalesce("t", F.lit(""))).alias("t"))


def _train(rows: np.ndarray, features: np.ndarray, y: np.ndarray, ratio: np.ndarray, steps: int = 150, rate: float = 0.05, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2 logistic regression on presence x ratio, by Adam over all rows."""
    n, size = len(y), len(ratio)
    x = ratio[features]
    w, b = np.zeros(size + 1), 0.0
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        margin = np.bincount(rows, x * w[features], minlength=n) + w[size]
        slip = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / n
        grad = np.append(np.bincount(features, x * slip[rows], minlength=size) + penalty * w[:size], slip.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    b = float(w[size])
    return w[:size] * ratio, b


def fit(sample: DataFrame, features: int = 4096, parts: int = 8) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets, their weights and the intercept, from ``labelled_sample``'s bounded rows."""
    spark = sample.sparkSession
    ship(spark)
    sample = cut(sample.coalesce(parts))  # each part sends its dense counts to one task
    counts = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        return np.zeros(0, np.int64), np.zeros(0), float(np.log((n1 + 1) / (n0 + 1)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            y = batch.column(0).to_numpy()
            for rows, buckets in presence(batch.column(1)):
                for c in (0, 1):
                    totals[c] += np.bincount(buckets[y[rows] == c], minlength=1 << BITS).astype(np.int32)
        yield pa.record_batch([pa.array([totals.tobytes()], pa.binary())], names=["totals"])

    def choose(table: pa.Table) -> pa.Table:
        q, p = sum(np.frombuffer(t.as_py(), np.int32).reshape(2, -1).astype(float) for t in table.column("totals"))
        a, b = (p + 1) / (n1 + 2), (q + 1) / (n0 + 2)
        tell = np.abs(a - b) / np.sqrt(a * (1 - a) / n1 + b * (1 - b) / n0 + 1e-12) * (p + q >= min(5, (n0 + n1) / 4))
        best = np.sort(np.argsort(-tell, kind="stable")[:features])
        ratio = np.log(a / a.sum()) - np.log(b / b.sum())
        return pa.table({"bucket": pa.array(best, pa.int64()), "ratio": pa.array(ratio[best], pa.float64())})

    totals = sample.select("y", "t").mapInArrow(count, "totals binary")
    chosen = totals.withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(choose, "bucket long, ratio double").collect()  # at most ``features`` rows
    order = sorted((r["bucket"], r["ratio"]) for r in chosen)
    buckets, ratios = np.array([b for b, _ in order]), np.array([r for _, r in order])

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.zeros(1 << BITS, bool)
        marked[buckets] = True
        for batch in batches:
            blobs = [b""] * batch.num_rows
            for rows, found in presence(batch.column(2), marked):
                at = np.searchsorted(buckets, found).astype(np.int32)
                heads = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else rows
                for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(rows)]):
                    blobs[rows[a]] = at[a:b].tobytes()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["k", "y", "x"])

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        blobs = [np.frombuffer(x.as_py(), np.int32) for x in table.column("x")]
        rows = np.repeat(np.arange(len(blobs)), [len(x) for x in blobs])
        w, b = _train(rows, np.concatenate(blobs), table.column("y").to_numpy().astype(float), ratios)
        return pa.table({"at": pa.array(range(-1, len(w)), pa.int64()), "w": pa.array(np.append(b, w), pa.float64())})

    kind = sample.schema["k"].dataType.simpleString()
    reduced = sample.select("k", "y", "t").mapInArrow(reduce_rows, f"k {kind}, y int, x binary")
    weights = {r["at"]: r["w"] for r in reduced.withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(train, "at long, w double").collect()}
    return buckets, np.array([weights[k] for k in range(len(buckets))]), weights[-1]


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", name: str = "_score") -> DataFrame:
    """All columns of ``docs`` and the score of every row's whole text."""
    ship(docs.sparkSession)
    buckets, weights, intercept = model
    at = docs.columns.index(text)
    out = docs.withColumn(name, F.lit(0.0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS)
        table[buckets] = weights
        marked = table != 0
        for batch in batches:
            margin = np.full(batch.num_rows, intercept)
            for rows, found in presence(batch.column(at), marked):
                margin += np.bincount(rows, table[found], minlength=batch.num_rows)
            values = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values)], names=batch.schema.names)

    return out.mapInArrow(score, out.schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, per_class: int = 3000, learn: Column | None = None, text: str = "text", key: str = "doc_id", label: str = "toxic", name: str = "_score") -> DataFrame:
    """All columns of ``docs`` with ``name``, the probability of class 1; raises if there is such a column."""
    unclashed(docs, name)
    return scored(docs, fit(labelled_sample(docs, labels, per_class, learn, text, key, label)), text, name)
