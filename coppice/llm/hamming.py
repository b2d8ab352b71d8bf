"""Binary-trie self-joins of 64-bit fingerprints within a Hamming budget, dealt by equal blocks.

Fingerprints that differ in at most ``budget`` bits agree on at least ``len(widths) - budget`` of
the blocks that ``widths`` cuts them into, so every fingerprint goes once to each choice of
that many blocks, under a key of the choice and its bits. The fingerprints of a key form a
binary trie, which is joined with itself level by level: node pairs are expanded together,
their differing bits accumulate, and a pair goes once it exceeds the budget or once all
that lies below it is one component already. A key yields a spanning forest of its links.

Rows stream through a task sorted by key and are never all held. A key with over
``group_limit`` rows is passed on instead of gathered: its rows are cut into chunks of half
that size, and every pair of chunks is joined as a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.session import cut, ship

U64 = np.uint64


def _settle(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component labels (smallest index) after linking a[i] with b[i], and which links form a forest of it.

    In each round every component takes the first of its links that lead out of it.
    """
    taken, rest = [np.zeros(0, np.int64)], np.arange(len(a))
    while len(rest := rest[labels[a[rest]] != labels[b[rest]]]):
        x, y = labels[a[rest]], labels[b[rest]]
        first = np.full(len(labels), len(a))
        np.minimum.at(first, x, rest)
        np.minimum.at(first, y, rest)
        chosen = np.unique(first[first < len(a)])
        taken.append(chosen)
        open_ = chosen
        while len(open_ := open_[labels[a[open_]] != labels[b[open_]]]):
            x, y = labels[a[open_]], labels[b[open_]]
            np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
            while not (up := labels[labels] == labels).all():
                labels = labels[labels]
    return labels, np.concatenate(taken)


def _range_ends(lo: np.ndarray, hi: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each range of rows (none empty, in order, disjoint)."""
    cuts = np.stack((lo, hi), axis=1).ravel()
    padded = np.append(values, values[-1:])
    return np.minimum.reduceat(padded, cuts)[::2], np.maximum.reduceat(padded, cuts)[::2]


def trie_components(groups: np.ndarray, keys: np.ndarray, budget: int, frontier: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels and a spanning forest of the components within each group of distinct keys that lie within ``budget`` bits.

    The rows must be sorted by group, then key. All tries (one for each group) are joined
    with themselves at once; at most about ``frontier`` node pairs are expanded at a time, the
    rest waits on a stack. A component's label is the index of its first row; the forest's
    links (two arrays of indices) are pairs within the budget.

    A node is a number: inner nodes of a depth count from 0, a leaf is -2 minus its row, and
    -1 is no node. A leaf stands for the rest of its path.
    """
    n = len(keys)
    labels = np.arange(n)
    forest: list[tuple[np.ndarray, np.ndarray]] = [(labels[:0], labels[:0])]

    def settle(links: list[tuple[np.ndarray, np.ndarray]]) -> None:
        nonlocal labels
        a, b = (np.concatenate(c) for c in zip(*links))
        labels, taken = _settle(labels, a, b)
        forest.append((a[taken], b[taken]))

    if n < 2:
        return labels, *forest[0]
    lo = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    hi = np.append(lo[1:], n)
    inner = hi - lo > 1
    ranges, children = [(lo[inner], hi[inner])], []
    if not inner.any():
        return labels, *forest[0]
    while len(ranges[-1][0]):
        lo, hi = ranges[-1]
        bit = U64(1) << U64(63 - len(children))
        left, right = lo.copy(), hi.copy()  # binary search for the first row with the bit
        while (open_ := np.flatnonzero(left < right)).size:
            middle = (left[open_] + right[open_]) >> 1
            one = (keys[middle] & bit) != 0
            right[open_[one]] = middle[one]
            left[open_[~one]] = middle[~one] + 1
        pair = np.full((2, len(lo)), -1, np.int64)
        bounds = np.stack((lo, left, left, hi), axis=1).reshape(-1, 2)  # both children of each node, in row order
        size = bounds[:, 1] - bounds[:, 0]
        flat = np.where(size == 1, -2 - bounds[:, 0], -1)
        grown = np.flatnonzero(size > 1)
        flat[grown] = np.arange(len(grown))
        pair[0], pair[1] = flat[::2], flat[1::2]
        children.append(pair)
        ranges.append((bounds[grown, 0], bounds[grown, 1]))
    big = (ranges[0][1] - ranges[0][0]).max() > 64
    for step in range(1, budget + 1) if big else (budget,):
        ends = [_range_ends(a, b, labels) for a, b in ranges[:-1]] if big else []
        roots = np.arange(len(ranges[0][0]))
        stack = [(0, roots, roots, np.zeros(len(roots), np.int8))]
        links: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        while stack:
            level, x, y, spent = stack.pop()
            if len(x) > frontier:
                for i in range(0, len(x), frontier):
                    stack.append((level, x[i : i + frontier], y[i : i + frontier], spent[i : i + frontier]))
                continue
            single = (x < -1) & (y < -1)
            if single.any():  # the rest of both paths at once
                p, q = -2 - x[single], -2 - y[single]
                near = (np.bitwise_count(keys[p] ^ keys[q]) <= step) & (p != q)
                links.append((p[near], q[near]))
                waiting += int(near.sum())
                x, y, spent = x[~single], y[~single], spent[~single]
                if waiting > 8 * frontier:
                    settle(links)
                    links, waiting = [], 0
            if not len(x):
                continue
            shift = U64(63 - level)

            def child(node: np.ndarray, side: int) -> np.ndarray:
                leaf = node < -1
                out = np.where(leaf, node, -1)
                out[~leaf] = children[level][side][node[~leaf]]
                own = (keys[-2 - node[leaf]] >> shift) & U64(1)
                out[np.flatnonzero(leaf)[own != side]] = -1
                return out

            sides = [(child(x, 0), child(y, 0)), (child(x, 1), child(y, 1))]
            found = []
            for i, j in ((0, 0), (1, 1), (0, 1), (1, 0)):
                u, v = sides[i][0], sides[j][1]
                ok = (u != -1) & (v != -1)
                if i != j:
                    ok &= (spent < step) & ((x != y) | (i < j))
                u, v, s = u[ok], v[ok], spent[ok] + np.int8(i != j)
                if big and len(ends) > level + 1:
                    least, most = ends[level + 1]
                    inside = (u >= 0) & (v >= 0)
                    a, b = u[inside], v[inside]
                    inside[inside] = (least[a] == most[a]) & (least[b] == most[b]) & (least[a] == least[b])
                    u, v, s = u[~inside], v[~inside], s[~inside]
                found.append((u, v, s))
            x, y, spent = (np.concatenate(c) for c in zip(*found))
            if len(x):
                stack.append((level + 1, x, y, spent))
        if links:
            settle(links)
    return labels, *(np.concatenate(c) for c in zip(*forest))


def block_components(groups: np.ndarray, keys: np.ndarray, budget: int, largest: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``trie_components`` gives, by comparing all pairs of groups of at most ``largest`` rows.

    Small groups are compared together, by the distance of two rows; larger ones each in
    strips of a comparison table, without the pairs that are one component already. No more than
    about a million pairs are held.
    """
    n = len(keys)
    lo = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(lo, n))
    left = np.repeat(lo + size, size) - np.arange(n)  # rows from here to the end of the group
    links = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    at, step = np.flatnonzero(np.repeat(size <= 64, size) & (left > 1)), 1
    while len(at):
        near = at[np.bitwise_count(keys[at] ^ keys[at + step]) <= budget]
        links.append((near, near + step))
        if sum(len(a) for a, _ in links) > 1 << 19:
            links = [_kept(n, links)]
        step += 1
        at = at[left[at] > step]
    for k in np.flatnonzero((size > 64) & (size <= largest)).tolist():
        own, labels = keys[lo[k] : lo[k] + size[k]], np.arange(size[k])
        rows = max(1, (1 << 20) // len(own))
        for i in range(0, len(own), rows):
            strip = np.bitwise_count(own[i : i + rows, None] ^ own[None, i:]) <= budget
            strip &= labels[i : i + rows, None] != labels[None, i:]
            a, b = np.nonzero(strip)
            if len(a):
                labels, taken = _settle(labels, i + a, i + b)
                links.append((lo[k] + i + a[taken], lo[k] + i + b[taken]))
                if not labels.any():
                    break
    rest = np.flatnonzero(np.repeat(size > largest, size))
    if len(rest):
        _, a, b = trie_components(groups[rest], keys[rest], budget)
        links.append((rest[a], rest[b]))
    a, b = _kept(n, links)
    labels, taken = _settle(np.arange(n), a, b)
    return labels, a[taken], b[taken]


def _kept(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links."""
    a, b = (np.concatenate(c) for c in zip(*links))
    _, taken = _settle(np.arange(n), a, b)
    return a[taken], b[taken]


#: A link between two ids, or (with a key) a row of a group that has to be dealt anew.
LINKS = "a long, b long, held long"


def _forest(held: np.ndarray, fp: np.ndarray, ids: np.ndarray, budget: int, trie: bool = True, piece: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Links (first, second id) that connect what lies within the budget in each group."""
    alone = np.append(True, held[1:] != held[:-1])
    alone &= np.append(alone[1:], True)  # rows come sorted by key, most of them alone with theirs
    held, fp, ids = held[~alone], fp[~alone], ids[~alone]
    order = np.lexsort((ids, fp, held))
    held, fp, ids = held[order], fp[order], ids[order]
    fresh = np.ones(len(fp), bool)
    fresh[1:] = (fp[1:] != fp[:-1]) | (held[1:] != held[:-1])
    head = np.flatnonzero(fresh)
    groups = np.flatnonzero(np.append(True, held[head][1:] != held[head][:-1])) if len(head) else head
    same = np.flatnonzero(~fresh)  # further ids of one fingerprint, linked to its first
    firsts, seconds = [ids[head[np.cumsum(fresh) - 1]][same]], [ids[same]]
    join = trie_components if trie else block_components
    at = 0
    while at < len(head):  # some ten thousand rows at once, groups kept whole
        k = int(np.searchsorted(groups, at + piece))
        end = int(groups[k]) if k < len(groups) else len(head)
        _, a, b = join(held[head[at:end]], fp[head[at:end]], budget)
        firsts.append(ids[head[at + a]])
        seconds.append(ids[head[at + b]])
        at = end
    return np.concatenate(firsts), np.concatenate(seconds)


def _join_groups(limit: int, budget: int, trie: bool):
    """Reads rows (held, fp, id) sorted by held; yields links, and the rows of groups over ``limit`` as they are."""

    def out(a: np.ndarray, b: np.ndarray, held: np.ndarray | None) -> pa.RecordBatch:
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int64()) if held is None else pa.array(held)], names=["a", "b", "held"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple[np.ndarray, ...]] = []
        count, passing = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            pending.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()))
            count += batch.num_rows
            if count <= 2 * limit:
                continue
            held, fp, ids = (np.concatenate(c) for c in zip(*pending))
            heads = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
            size = np.diff(np.append(heads, len(held)))
            last = heads[-1]  # the last group may go on in the next batch
            big = (size > limit) | (held[heads] == passing if passing is not None else False)
            through = np.repeat(big, size)
            if through.any():
                yield out(fp[through], ids[through], held[through])
            passing = held[last] if big[-1] else None
            ready, rest = ~through, ~through
            ready[last:] = False
            if ready.any():
                yield out(*_forest(held[ready], fp[ready], ids[ready], budget, trie), None)
            rest[:last] = False
            pending, count = [(held[rest], fp[rest], ids[rest])], int(rest.sum())
        if count:
            held, fp, ids = (np.concatenate(c) for c in zip(*pending))
            through = held == passing if passing is not None else np.zeros(len(held), bool)
            heads = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
            size = np.diff(np.append(heads, len(held)))
            through |= np.repeat(size > limit, size)
            if through.any():
                yield out(fp[through], ids[through], held[through])
            if not through.all():
                yield out(*_forest(held[~through], fp[~through], ids[~through], budget, trie), None)

    return join


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(widths: tuple[int, ...]) -> list[int]:
    masks, at = [], 0
    for width in widths:
        masks.append(((1 << width) - 1) << at)
        at += width
    return masks


def dealt(rows: DataFrame, widths: tuple[int, ...], budget: int) -> DataFrame:
    """Each row (fp, id) under the keys of its equal blocks; fingerprints of one ``kind``, if there is one, meet."""
    if sum(widths) != 64 or len(widths) <= budget:
        raise ValueError("the blocks must cover 64 bits and be more than the budget")
    chosen = [sum(c) for c in combinations(block_masks(widths), len(widths) - budget)]
    kind = [F.col("kind")] if "kind" in rows.columns else []
    keys = F.array(*[F.xxhash64(F.lit(k), *kind, F.col("fp").bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(chosen)])
    return rows.select(F.explode(keys).alias("held"), "fp", "id")


def hamming_links(rows: DataFrame, budget: int, widths: tuple[int, ...], group_limit: int = 32_000, trie: bool = True) -> DataFrame:
    """Links (a, b) between ids: a spanning forest of the pairs of fingerprints within the budget.

    ``rows`` has fp and id, both long; ids with one fingerprint are linked, too. Without
    ``trie``, groups of up to some ten thousand rows are compared pair by pair.
    """
    spark = rows.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def joined(keyed: DataFrame, limit: int) -> DataFrame:
        return cut(keyed.repartition(parts, "held").sortWithinPartitions("held").mapInArrow(_join_groups(limit, budget, trie), LINKS))

    first = joined(dealt(rows, widths, budget), group_limit)
    links = first.filter("held is null").select("a", "b")
    wide = first.filter("held is not null").select("held", F.col("a").alias("fp"), F.col("b").alias("id"))
    if wide.isEmpty():
        return links
    chunks = wide.groupBy("held").agg(F.ceil(F.count(F.lit(1)) * 2 / group_limit).cast("int").alias("n"))
    placed = wide.join(chunks, "held").withColumn("own", F.pmod(F.xxhash64("fp", "id"), F.col("n")).cast("int"))
    pairs = placed.select("held", "fp", "id", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    again = pairs.select(F.xxhash64("held", F.least("own", "other"), F.greatest("own", "other")).alias("held"), "fp", "id")
    # Two chunks of a hashed cut hold about the limit; they are joined whatever they hold.
    return links.unionByName(joined(again, 1 << 31).select("a", "b"))
