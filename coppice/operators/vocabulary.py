"""Vocabulary features of token streams and the logistic score on them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.session import cut, ship

WINDOW = 100

#: Means, deviations, weights and bias of the published model.
MEANS = (0.420263, 5.899142, 0.30891, 0.275787)
DEVIATIONS = (0.078555, 0.769656, 0.060406, 0.094452)
WEIGHTS = (0.431562, 0.345762, 0.480687, 0.098488)
BIAS = 0.486314

#: What ``tokens`` takes for a token, in lower-cased UTF-8.
_WORD = re.compile(rb"[a-z]+")

FEATURES = ("mattr", "entropy", "mattr_repeat", "hapax")


def tokens(df: DataFrame, key: str, text: str, pattern: str = "[a-z]+") -> DataFrame:
    """key, pos (from 0) and token of every lower-cased match of ``pattern``."""
    found = F.expr(f"regexp_extract_all(lower({text}), '{pattern}', 0)")
    return df.select(key, F.posexplode(found).alias("pos", "token"))


def features(stream: DataFrame, key: str, window: int = WINDOW) -> DataFrame:
    """Moving type-token ratio, entropy, ratio x repeat rate and hapax share of each stream.

    A token at p whose last occurrence was at q is new in the windows that start in
    (q, p]; summing the number of such windows gives the moving ratio in one pass, without
    a set for each window. Streams shorter than the window have the plain ratio.
    """
    n = stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    last = F.lag("pos").over(Window.partitionBy(key, "token").orderBy("pos"))
    seen = stream.withColumn("q", F.coalesce(last, F.lit(-1)))
    by_token = seen.join(n, key).withColumn(
        "fresh",
        F.greatest(F.least(F.col("pos"), F.col("n") - window) - F.greatest(F.col("q") + 1, F.col("pos") - (window - 1), F.lit(0)) + 1, F.lit(0)).cast("long"),
    )
    counted = by_token.groupBy(key, "n", "token").agg(F.count(F.lit(1)).alias("c"), F.sum("fresh").alias("fresh"))
    p = F.col("c") / F.col("n")
    sums = counted.groupBy(key, "n").agg(F.count(F.lit(1)).alias("unique"), F.sum("fresh").alias("fresh"), F.count_if(F.col("c") == 1).alias("once"), (F.lit(0.0) - F.sum(p * F.log2(p))).alias("entropy"))
    return _measures(sums, key, window)


def text_features(df: DataFrame, key: str, text: str, window: int = WINDOW, few: int = 1_000_000) -> DataFrame:
    """``features`` of ``tokens``, each text counted where it is; rows that share their key go the way of streams.

    No token becomes a row: what is shuffled are the keys, to find those that repeat (up to ``few`` of them are broadcast, else joined).
    """
    ship(df.sparkSession)
    again = cut(df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_key"))
    n_again = again.count()
    if n_again <= few:
        again = F.broadcast(again)
    several = F.col(key).eqNullSafe(F.col("_key"))
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.lower(text).cast("binary").alias("t"))
    names = ["key", "n", "unique", "fresh", "once", "entropy"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_counts(t, window) for t in batch.column(1).to_pylist()]
            kept = np.array([k for k, c in enumerate(out) if c is not None], np.int64)
            columns = list(zip(*(c for c in out if c is not None))) or [[]] * 5
            yield pa.record_batch([batch.column(0).take(pa.array(kept)), *(pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 4, pa.float64()]))], names=names)

    alone = rows.join(again, F.col("key").eqNullSafe(F.col("_key")), "left_anti") if n_again else rows
    alone = alone.mapInArrow(scan, f"key {kind}, n long, unique long, fresh long, once long, entropy double")
    own = _measures(alone.withColumnRenamed("key", key), key, window)
    if not n_again:
        return own
    return own.unionByName(features(tokens(df.join(again, several, "left_semi"), key, text), key, window))


def _counts(text: bytes | None, window: int) -> tuple[int, int, int, int, float] | None:
    """Tokens, distinct ones, their new places in the windows, those that occur once, and the entropy; None without a token."""
    words = _WORD.findall(text or b"")
    n = len(words)
    if not n:
        return None
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    by = np.argsort(codes, kind="stable")
    last = np.full(n, -1)
    same = codes[by[1:]] == codes[by[:-1]]
    last[by[1:][same]] = by[:-1][same]
    at = np.arange(n)
    fresh = np.maximum(np.minimum(at, n - window) - np.maximum(np.maximum(last + 1, at - (window - 1)), 0) + 1, 0)
    counts = np.bincount(codes)
    p = counts / n
    return n, len(counts), int(fresh.sum()), int((counts == 1).sum()), float(0.0 - (p * np.log2(p)).sum())


def _measures(sums: DataFrame, key: str, window: int) -> DataFrame:
    plain = F.col("unique") / F.col("n")
    mattr = F.when(F.col("n") < window, plain).otherwise(F.col("fresh") / (F.lit(float(window)) * (F.col("n") - window + 1)))
    return sums.select(key, "n", "unique", mattr.alias("mattr"), "entropy", (mattr * (F.col("n") - F.col("unique")) / F.col("n")).alias("mattr_repeat"), (F.col("once") / F.col("unique")).alias("hapax"))


def probability() -> Column:
    """The logistic score of the four features."""
    z = F.lit(BIAS)
    for name, mean, deviation, weight in zip(FEATURES, MEANS, DEVIATIONS, WEIGHTS):
        z = z + (F.col(name) - F.lit(mean)) / F.lit(deviation) * F.lit(weight)
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def nearest(vectors: DataFrame, prototypes: DataFrame, threshold: float, margin: float, key: str = "vec_id") -> DataFrame:
    """The most similar prototype (label, vector) by cosine, or ``unknown`` below threshold or margin.

    Prototypes are few and joined by broadcast where Spark sees them as small.
    """
    dot = F.aggregate(F.zip_with("vector", "prototype", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)) + F.lit(1e-9)
    scored = vectors.crossJoin(F.broadcast(prototypes)).select(key, "label", (dot / (norm(F.col("vector")) * norm(F.col("prototype")))).alias("similarity"))
    best = scored.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "label"))).alias("r"))
    first, second = -F.col("r")[0]["s"], -F.try_element_at("r", F.lit(2))["s"]
    sure = (first >= threshold) & (F.coalesce(first - second, F.lit(-1.0)) >= margin)
    return best.select(key, F.col("r")[0]["label"].alias("nearest"), first.alias("similarity"), (first - second).alias("lead"), F.when(sure, F.col("r")[0]["label"].cast("string")).otherwise("unknown").alias("verdict"))


def linear(features: list[str], weights: dict[str, tuple[list[float], float]], floor: float, none: str = "none") -> Column:
    """Softmax over linear scores: struct(label, p); the ``none`` label and p below the floor give null labels."""
    raw = {name: sum((F.col(f) * F.lit(w) for f, w in zip(features, ws)), F.lit(bias)) for name, (ws, bias) in weights.items()}
    top = F.greatest(*raw.values()) if len(raw) > 1 else next(iter(raw.values()))
    total = sum((F.exp(s - top) for s in raw.values()), F.lit(0.0))
    best = F.array_max(F.array(*[F.struct((F.exp(s - top) / total).alias("p"), F.lit(n).alias("label")) for n, s in raw.items()]))
    return F.struct(F.when((best["label"] == none) | (best["p"] < floor), F.lit(None)).otherwise(best["label"]).alias("label"), best["p"].alias("p"))
