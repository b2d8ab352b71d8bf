"""SimHash fingerprints and a binary-trie self-join within a Hamming error budget.

Fingerprints: words are runs of bytes outside space and 0x09-0x0D of the text with A-Z
lower-cased; the shingles of ``width`` words, repeats included, are hashed by XXH64 (seed
42); a bit is set where over half the hashes have it. Fewer words than ``width``: the whole
sequence is the one shingle. No words (null or blank texts): fingerprint zero, linked like
any other.

Join: ``hamming.hamming_links``, a binary-trie self-join with a budget of 4 bits over the
distinct fingerprints, dealt by pairs of equal blocks out of six.

Equal fingerprints are collapsed before the join, so copies cost one row. Rows that repeat
a doc_id are kept; a null doc_id gets a component id but never names one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.components import components
from coppice.llm.hamming import hamming_links
from coppice.session import cut, ship

#: Widths of the six blocks of a fingerprint, from the lowest bit.
BLOCKS = (11, 11, 11, 11, 10, 10)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every shingle of one UTF-8 text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, n = xxhash.xxh64_intdigest, len(words) - width + 1
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist())), np.uint64, n)


def folded(hashes: np.ndarray) -> int:
    """The fingerprint of hashes: bits that over half of them have; zero for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, width: int = 4) -> int:
    """The unsigned fingerprint of one UTF-8 text."""
    return folded(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 4) -> DataFrame:
    """``key`` and ``fp`` (the 64 bits as a signed long) of every row. Map-side only."""
    ship(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_buffer().to_pybytes(), width) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], names=["k", "fp"])

    kind = docs.select(F.col(key)).dtypes[0][1]
    out = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(scan, f"k {kind}, fp long")
    return out.withColumnRenamed("k", key)


def simhash_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 4, budget: int = 4, group_limit: int = 32_000) -> DataFrame:
    """``key``, fingerprint (16 hex digits) and component_id (the smallest key reachable) of every row."""
    prints = cut(fingerprints(docs, text, key, width))
    first = cut(prints.groupBy("fp").agg(F.min(key).alias("first")))
    links = hamming_links(first.select("fp", F.col("fp").alias("id")), budget, BLOCKS, group_limit)
    reach = components(links).withColumnRenamed("node", "fp")
    # Only fingerprints that have links move; the rest name their own smallest key.
    moved = first.join(reach, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = moved.groupBy("component").agg(F.min("first").alias("component_id"))
    named = moved.join(smallest, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
