"""Connected components of large edge lists by alternating large and small stars.

Every round hooks each node's neighbours to the smallest node known nearby (Kiveris et al.,
"Connected Components in MapReduce and Beyond"), by aggregates and equi-joins only, so that
a hub's neighbours are never gathered in one row and skewed joins can be split. Rounds are
checkpointed in the shared folder; their number is logarithmic in the longest chain.
Callers may let a bounded number of links be settled in one task instead; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.session import cut


#: So many links of whole numbers take one task some 240 MB (measured).
FEW = 2_000_000


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, few: int = 0) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node with a link.

    Self-loops, repeated edges and nulls add nothing. Raises if ``max_rounds`` do not suffice.
    Up to ``few`` edges between whole numbers (long) are settled in one task, without rounds.
    """
    pairs = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).filter("v < u and v is not null")
    if few:
        pairs = cut(pairs)
        if pairs.count() <= few:
            return pairs.repartition(1).mapInArrow(_settled, "node long, component long")
    pairs = pairs.distinct()
    for _ in range(max_rounds):
        pairs = cut(_small_star(_large_star(pairs)))
        if _are_stars(pairs):
            break
    else:
        raise RuntimeError("components did not settle")
    hubs = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(hubs)


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (v, u) at once: every root hooks to its smallest neighbour until no edge leads out of a tree."""
    read = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches if batch.num_rows]
    if not read:
        return
    edges = np.concatenate(read, axis=1)
    del read
    names, at = np.unique(edges, return_inverse=True)
    del edges
    x, y = at.reshape(2, -1)
    labels = np.arange(len(names))
    while len(x):
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while not ((up := labels[labels]) == labels).all():
            labels = up
        x, y = labels[x], labels[y]
        apart = x != y
        x, y = x[apart], y[apart]
    for i in range(0, len(names), 1 << 16):
        yield pa.record_batch([pa.array(names[i : i + (1 << 16)]), pa.array(names[labels[i : i + (1 << 16)]])], names=["node", "component"])


def _are_stars(pairs: DataFrame) -> bool:
    """Whether every node is either a hub or hooked to exactly one."""
    roles = pairs.select(F.col("u").alias("node"), F.lit(1).alias("hooked"), F.lit(0).alias("hub")).unionByName(pairs.select(F.col("v").alias("node"), F.lit(0).alias("hooked"), F.lit(1).alias("hub")))
    return roles.groupBy("node").agg(F.sum("hooked").alias("hooked"), F.max("hub").alias("hub")).filter("hooked + hub > 1").isEmpty()


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    hooked = pairs.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
