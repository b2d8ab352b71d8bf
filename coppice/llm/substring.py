"""Substring dedup by FM-index shards.

Every word covered by a window of ``window`` consecutive words that also starts earlier (in a
document of smaller id, or earlier in the same one) is removed; windows are judged on the
input.

Each window has an anchor, the least hash among its runs of ``gram`` words; equal windows
have equal anchors, so a shard holds all windows of its anchors and no window has to be
looked up in two shards. Neighbouring windows with one anchor form a run, which is dealt
out as one segment of text:

1. Each block of documents tells each anchor's shard the content hashes of its runs, once
   for every content (the copies within a block are known there).
2. The shard answers whose first copy of a content is to be searched: those that occur again,
   here or in another block, and those that share their anchor with other contents.
3. The blocks send the words of these to the shard, and of a content that occurs again one
   more copy, so that the index finds the repeat; what it finds of that copy holds for all
   further ones. Anchors with over ``hot_contents`` contents are dealt out window by window, by
   the window's own hash.
4. The shard builds a compressed FM-index of its segments in document order and streams
   them through it: matching statistics by backward search on the wavelet matrix. Where a
   match reaches the threshold and its earliest place lies before the streamed one, the
   window is reported.
5. The blocks cover the words of all reported windows.

All messages are a few binary columns for each pair of block and shard. The documents are
shuffled once, by id; the blocks of steps 1, 3 and 5 read the same exchange.

Defined results: null and empty texts have no words; texts below ``window`` words lose none;
rows that share a doc_id are one document's parts in order of their text's hash, so that
the later of two equal rows is covered; a null id sorts last. Content hashes have 64 bits.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.bytescan import BLANK, range_hashes, sequence_hashes, slices, span_hashes, text_buffers, window_minima, word_bounds
from coppice.llm.fmindex import FMIndex
from coppice.session import ship

#: Content codes: as the copy that is searched, searched, dealt by window, searched with the block's next copy.
LAST, CHECK, HOT, TWICE = 1, 2, 4, 8
MAX_RUN = 64


class Block:
    """The runs of a block's documents, which must be in document order."""

    def __init__(self, texts: pa.ChunkedArray, window: int, gram: int) -> None:
        self.window = window
        self.data, self.offsets = text_buffers(texts)
        parts: list[tuple[np.ndarray, ...]] = []
        counts = [np.zeros(0, np.int64)]
        for i, j in slices(self.offsets):
            raw = self.data[self.offsets[i] : self.offsets[j]]
            starts, ends, rows = word_bounds(raw, self.offsets[i : j + 1] - self.offsets[i], BLANK_NOT)
            counts.append(np.bincount(rows, minlength=j - i))
            if len(starts) < window:
                continue
            words = span_hashes(raw, starts, ends)
            low, place = window_minima(sequence_hashes(words, gram), window - gram + 1)
            valid = rows[: len(low)] == rows[window - 1 :]
            fresh = valid.copy()
            fresh[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
            head = np.flatnonzero(fresh)
            index = np.flatnonzero(valid)
            run = np.searchsorted(head, index, side="right") - 1
            fresh[index[(index - head[run]) % MAX_RUN == 0]] = True
            head = np.flatnonzero(fresh)
            run = np.searchsorted(head, index, side="right") - 1
            size = np.bincount(run, minlength=len(head))
            first = np.searchsorted(rows, rows[head])
            parts.append(
                (
                    rows[head] + i,
                    head - first,
                    size,
                    low[head],
                    range_hashes(words, head, head + size + window - 1),
                    place[head] != place[head + size - 1],
                    starts[head] + self.offsets[i],
                    ends[head + size + window - 2] + self.offsets[i],
                )
            )
        self.n_words = np.concatenate(counts)
        if parts:
            self.row, self.start, self.size, self.anchor, self.content, self.loops, self.begin, self.end = (np.concatenate(c) for c in zip(*parts))
        else:
            z = np.zeros(0, np.int64)
            self.row = self.start = self.size = self.begin = self.end = z
            self.anchor = self.content = z.astype(np.uint64)
            self.loops = z.astype(bool)
        self.contents, first, self.which = np.unique(self.content, return_index=True, return_inverse=True)
        self.is_first = np.zeros(len(self.row), bool)
        self.is_first[first] = True
        self.first = first
        # The second copy of each content that the block has more than once.
        many = np.bincount(self.which, minlength=len(self.contents))
        by_content = np.argsort(self.which, kind="stable")
        again = (np.cumsum(many) - many)[many > 1] + 1
        self.repeats = many > 1
        self.is_second = np.zeros(len(self.row), bool)
        self.is_second[by_content[again]] = True


BLANK_NOT = ~BLANK


def _in_order(docs: pa.Table) -> pa.Table:
    return docs.sort_by([("doc", "ascending"), ("tie", "ascending")])


def _blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), kind)


def _sizes(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.array([len(x.as_buffer()) // width for x in column], np.int64)


CONTENTS = "shard int, block int, anchors binary, contents binary, docs binary, loops binary"
ANSWERS = "block int, contents binary, codes binary, ords binary, froms binary, tos binary"
SEGMENTS = "shard int, block int, docs binary, ords binary, starts binary, lens binary, text binary"
RESULTS = "k long, n_words long, n_removed long, kept_sha256 string"


def _announce(shards: int, window: int, gram: int):
    """Step 1: the contents of a block's runs for each shard."""

    def announce(docs: pa.Table) -> pa.Table:
        docs = _in_order(docs)
        b = Block(docs.column("text"), window, gram)
        doc = docs.column("doc").to_numpy()
        f = b.first
        shard = (b.anchor[f] % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        pick = [f[order[cuts[s] : cuts[s + 1]]] for s in range(shards)]
        used = [s for s in range(shards) if len(pick[s])]
        block = docs.column("block")[0].as_py() if docs.num_rows else 0
        columns = [[_blob(a[pick[s]]) for s in used] for a in (b.anchor, b.content, doc[b.row] if len(b.row) else b.row, b.loops.astype(np.uint8) | (b.repeats[b.which].astype(np.uint8) << 1))]
        return pa.table([pa.array(used, pa.int32()), pa.array([block] * len(used), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["shard", "block", "anchors", "contents", "docs", "loops"])

    return announce


def _answer(hot_contents: int):
    """Step 2: what each block has to know about its contents."""

    def answer(told: pa.Table) -> pa.Table:
        anchors, contents = _joined(told.column("anchors"), np.uint64), _joined(told.column("contents"), np.uint64)
        docs, loops = _joined(told.column("docs"), np.int64), _joined(told.column("loops"), np.uint8)
        origin = np.repeat(told.column("block").to_numpy(), _sizes(told.column("contents"), 8))
        order = np.lexsort((docs, contents, anchors))
        anchors, contents, loops, origin = anchors[order], contents[order], loops[order], origin[order]
        head = np.ones(len(order), bool)
        head[1:] = (contents[1:] != contents[:-1]) | (anchors[1:] != anchors[:-1])
        _, group = np.unique(anchors, return_inverse=True)
        n_contents = np.bincount(group, head)[group] if len(group) else np.zeros(0)
        hot, here = n_contents > hot_contents, loops & 2 > 0  # ``here``: the first block of a content has it again
        more = np.append(~head[1:], False) if len(head) else head
        next_ = np.zeros(len(order), bool)  # else the next block's first copy is searched as well
        next_[1:] = head[:-1] & ~here[:-1] & ~head[1:] & ~hot[1:]
        code = np.where(head, 0, LAST) | np.where((n_contents > 1) | (loops & 1 > 0) | here | more, CHECK, 0) | np.where(hot, HOT, 0) | np.where(head & here & ~hot, TWICE, 0)
        code = np.where(next_, CHECK, np.where(code & LAST, LAST, code)).astype(np.uint8)
        tell = np.flatnonzero(code)
        tell = tell[np.argsort(origin[tell], kind="stable")]
        blocks, at = np.unique(origin[tell], return_index=True)
        parts = np.split(tell, at[1:]) if len(blocks) else []
        none = [b""] * len(blocks)
        return pa.table([pa.array(blocks, pa.int32()), *(pa.array(c, pa.binary()) for c in ([_blob(contents[p]) for p in parts], [_blob(code[p]) for p in parts], none, none, none))], names=["block", "contents", "codes", "ords", "froms", "tos"])

    return answer


def _codes(b: Block, answers: pa.Table) -> np.ndarray:
    """The code of each run."""
    known, codes = _joined(answers.column("contents"), np.uint64), _joined(answers.column("codes"), np.uint8)
    out = np.zeros(len(b.contents), np.uint8)
    if len(known):
        at = np.searchsorted(b.contents, known)
        out[at] = codes
    return out[b.which]


def _windows(b: Block, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, first and last byte, and content hash of each window of the runs."""
    rows, starts, begins, ends, hashes = [], [], [], [], []
    for r in runs.tolist():
        raw = b.data[b.begin[r] : b.end[r]]
        s, e, _ = word_bounds(raw, np.array([0, len(raw)]), BLANK_NOT)
        n, first = int(b.size[r]), np.arange(int(b.size[r]))
        hashes.append(range_hashes(span_hashes(raw, s, e), first, first + b.window))
        rows.append(np.full(n, b.row[r]))
        starts.append(b.start[r] + first)
        begins.append(s[:n] + b.begin[r])
        ends.append(e[b.window - 1 :] + b.begin[r])
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in (rows, starts, begins, ends, hashes))


def _hot_windows(b: Block, codes: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The windows of hot runs, and which of them are the block's first of their content."""
    w = _windows(b, np.flatnonzero((codes & HOT > 0) & b.is_first))
    first = np.zeros(len(w[0]), bool)
    order = np.lexsort((w[1], w[0], w[4]))
    if len(order):
        fresh = np.ones(len(order), bool)
        fresh[1:] = w[4][order][1:] != w[4][order][:-1]
        first[order[fresh]] = True
    return w, first


def _searched(b: Block, codes: np.ndarray) -> np.ndarray:
    """Which runs go to the index."""
    return (codes & HOT == 0) & (b.is_first & (codes & CHECK > 0) | b.is_second & (codes & TWICE > 0))


def _send(shards: int, window: int, gram: int):
    """Step 3: the words of a block's segments for each shard."""

    def send(docs: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["shard", "block", "docs", "ords", "starts", "lens", "text"]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
        if not docs.num_rows or not answers.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        docs = _in_order(docs)
        b = Block(docs.column("text"), window, gram)
        codes = _codes(b, answers)
        cold = np.flatnonzero(_searched(b, codes))
        w, first = _hot_windows(b, codes)
        row = np.concatenate((b.row[cold], w[0][first]))
        start = np.concatenate((b.start[cold], w[1][first]))
        begin = np.concatenate((b.begin[cold], w[2][first]))
        end = np.concatenate((b.end[cold], w[3][first]))
        key = np.concatenate((b.anchor[cold], w[4][first].astype(np.uint64)))
        shard = (key % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        doc, raw = docs.column("doc").to_numpy(), b.data.tobytes()
        out: list[tuple] = []
        block = docs.column("block")[0].as_py()
        for s in range(shards):
            p = order[cuts[s] : cuts[s + 1]]
            if len(p):
                pieces = [raw[x:y] for x, y in zip(begin[p].tolist(), end[p].tolist())]
                out.append((s, block, _blob(doc[row[p]]), _blob(row[p].astype(np.int32)), _blob(start[p].astype(np.int32)), _blob(np.array([len(x) for x in pieces], np.int32)), b"".join(pieces)))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], names=names)

    return send


def _search(window: int):
    """Step 4: the windows of a shard's segments that start earlier in its text."""

    def search(sent: pa.Table) -> pa.Table:
        docs, ords = _joined(sent.column("docs"), np.int64), _joined(sent.column("ords"), np.int32)
        starts, lens = _joined(sent.column("starts"), np.int32), _joined(sent.column("lens"), np.int32)
        origin = np.repeat(sent.column("block").to_numpy(), _sizes(sent.column("lens"), 4))
        raw = np.frombuffer(b"".join(x.as_py() for x in sent.column("text")), np.uint8)
        offsets = np.append(0, np.cumsum(lens.astype(np.int64)))
        order = np.lexsort((starts, ords, docs))
        hashes, rows = [], []
        for i, j in slices(offsets):
            part = raw[offsets[i] : offsets[j]]
            s, e, r = word_bounds(part, offsets[i : j + 1] - offsets[i], BLANK_NOT)
            hashes.append(span_hashes(part, s, e))
            rows.append(r + i)
        words, row = np.concatenate(hashes), np.concatenate(rows)
        vocabulary, symbols = np.unique(words, return_inverse=True)
        n_words = np.bincount(row, minlength=len(lens))
        begin = np.cumsum(n_words) - n_words
        # The text: segments in document order, each followed by a 0.
        size = n_words[order]
        to = np.cumsum(size + 1) - (size + 1)
        text = np.zeros(int((size + 1).sum()), np.int64)
        source = np.repeat(begin[order] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        target = np.repeat(to - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        text[target] = symbols[source] + 1
        index = FMIndex(text, len(vocabulary) + 1, window)
        length, earliest = index.matches(text, to, to + size)
        found = np.flatnonzero((length >= window) & (earliest < np.arange(len(text))))
        segment = np.searchsorted(to, found, side="right") - 1
        where = starts[order][segment] + found - to[segment]
        fresh = np.ones(len(found), bool)
        fresh[1:] = (segment[1:] != segment[:-1]) | (found[1:] != found[:-1] + 1)
        head = np.flatnonzero(fresh)
        width = np.diff(np.append(head, len(found)))
        who = order[segment[head]]
        back = np.argsort(origin[who], kind="stable")
        blocks, at = np.unique(origin[who][back], return_index=True)
        parts = np.split(back, at[1:]) if len(blocks) else []
        none = [b""] * len(blocks)
        columns = (none, none, [_blob(ords[who[p]]) for p in parts], [_blob(where[head[p]].astype(np.int32)) for p in parts], [_blob((where[head[p]] + width[p]).astype(np.int32)) for p in parts])
        return pa.table([pa.array(blocks, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["block", "contents", "codes", "ords", "froms", "tos"])

    return search


def _covered(b: Block, answers: pa.Table) -> np.ndarray:
    """Which words of a block (in order) are covered."""
    codes = _codes(b, answers)
    base = np.cumsum(b.n_words) - b.n_words
    whole = np.flatnonzero((~b.is_first | (codes & LAST > 0)) & ~_searched(b, codes))
    w, first = _hot_windows(b, codes)
    ords, froms, tos = (_joined(answers.column(c), np.int32) for c in ("ords", "froms", "tos"))
    starts = np.concatenate((base[b.row[whole]] + b.start[whole], base[w[0][~first]] + w[1][~first], base[ords] + froms))
    stops = np.concatenate((base[b.row[whole]] + b.start[whole] + b.size[whole], base[w[0][~first]] + w[1][~first] + 1, base[ords] + tos)) + b.window - 1
    total = int(b.n_words.sum())
    steps = np.bincount(starts, minlength=total + 1) - np.bincount(stops, minlength=total + 1)
    return np.cumsum(steps)[:total] > 0


def _digest(window: int, gram: int):
    """Step 5 and the digest columns of each document."""

    def digest(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _in_order(docs)
        b = Block(docs.column("text"), window, gram)
        covered = _covered(b, answers)
        ends = np.cumsum(b.n_words)
        removed, shas, at = [], [], 0
        for r, end in enumerate(ends.tolist()):
            words = b.data[b.offsets[r] : b.offsets[r + 1]].tobytes().split()
            gone = covered[at:end]
            n = int(gone.sum())
            removed.append(n)
            shas.append(hashlib.sha256(b" ".join(words if not n else compress(words, (~gone).tolist()))).hexdigest())
            at = end
        return pa.table([docs.column("id").cast(pa.int64()), pa.array(b.n_words), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], names=["k", "n_words", "n_removed", "kept_sha256"])

    return digest


def substring_dedup(docs: DataFrame, window: int = 20, gram: int = 6, text: str = "text", key: str = "doc_id", blocks: int | None = None, shards: int | None = None, hot_contents: int = 20_000) -> DataFrame:
    """``key``, n_words, n_removed and kept_sha256 of every row of ``docs``.

    ``key`` must be an integer column. ``blocks`` and ``shards`` default to the
    session's shuffle partitions; both must grow with the input, so that one of them fits
    into a task's memory.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks, n_shards = blocks or parts, shards or parts
    own = docs.select(
        F.col(key).cast("long").alias("id"),
        F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("doc"),
        F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("tie"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    own = own.withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(n_blocks)).cast("int")).repartition(parts, "block")
    told = own.groupBy("block").applyInArrow(_announce(n_shards, window, gram), CONTENTS)
    answers = told.groupBy("shard").applyInArrow(_answer(hot_contents), ANSWERS)
    sent = own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_send(n_shards, window, gram), SEGMENTS)
    found = sent.groupBy("shard").applyInArrow(_search(window), ANSWERS)
    both = answers.unionByName(found)
    out = own.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(_digest(window, gram), RESULTS)
    return out.withColumnRenamed("k", key)
