"""Benchmark decontamination by a generalised suffix automaton of the test items.

The words of all items (A-Z lower-cased; runs of digits, lower-case letters and non-ASCII
characters) build one generalised suffix automaton. Training texts are streamed through it
word by word and the longest matching length is tracked; a match of ``window`` words or more
hits the last ``window`` words, so every word inside any occurrence of a window is hit. An
item with fewer words, but not none, is one window of its own length. Words outside the
items' vocabulary send the automaton to its root, so only runs of known words are streamed.

The automaton is built on the driver and shipped only while the items' text is within
``item_bytes``: 1 MB of items made an object of some 160 MB in each process (190,000 states),
of 450 MB where all words have one letter (730,000). A larger benchmark is cut
into parts below that bound, and each part passes over the texts in turn, row by row, adding
to what the parts before it found.

Defined results: null and empty texts have no words and no hits; items without words never
match; items that share an id count once; items without an id take no part in reports, as in
the report's SQL, and with ``nameless`` (as when texts are cleaned) hit like others but are not listed; every row gives one row, repeated rows included;
``spans`` are half-open word ranges, disjoint and in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.bytescan import ALNUM, LOWER, slices, span_hashes, text_buffers, word_bounds
from coppice.llm.rows import fresh, unclashed
from coppice.session import cut, ship

SPANS = "array<struct<start:int,stop:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


_NEW = object()


class SuffixAutomaton:
    """All substrings of several sequences; a state stands for those that end at the same places."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items: dict[int, set[str] | str] = {}
        self.whole: list[tuple[tuple[int, str], ...]] = [()]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, symbol: int) -> int:
        """The state of the longest string of ``p`` followed by ``symbol``, split off where needed."""
        q = self.next[p][symbol]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = twin
            p = self.link[p]
        return twin

    def add(self, sequence: list[int]) -> None:
        last = 0
        for symbol in sequence:
            if symbol in self.next[last]:
                last = self._split(last, symbol)
                continue
            new = self._state(self.length[last] + 1, 0, {})
            p = last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, symbol)
            last = new

    def mark(self, sequences: list[tuple[str, list[int]]], window: int) -> None:
        """Notes which items have each state's strings of ``window`` symbols or more, and where short items end."""
        self.items, self.whole = {}, [()] * len(self.next)
        for item, sequence in sequences:
            state = 0
            for symbol in sequence:
                state = self.next[state][symbol]
                up = state
                while up > 0 and self.length[up] >= window:
                    held = self.items.setdefault(up, _NEW)
                    if held is _NEW:
                        self.items[up] = item
                    elif held == item or isinstance(held, set) and item in held:
                        break  # this item has been here, and so further up
                    elif isinstance(held, set):
                        held.add(item)
                    else:
                        self.items[up] = {held, item}
                    up = self.link[up]
            if len(sequence) < window:
                self.whole[state] = (*self.whole[state], (len(sequence), item))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for state in order:  # a state also ends with what its suffix link ends with
            if self.whole[self.link[state]]:
                self.whole[state] = self.whole[state] + self.whole[self.link[state]]

    def stream(self, symbols: list[int], window: int) -> tuple[list[tuple[int, int]], set[str]]:
        """The merged hit ranges of a sequence and the items they are from."""
        moves, link, lengths, whole = self.next, self.link, self.length, self.whole
        state, matched = 0, 0
        spans: list[tuple[int, int]] = []
        found: set[str] = set()

        def hit(start: int, stop: int) -> None:
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, stop))

        for i, symbol in enumerate(symbols):
            while symbol not in moves[state] and state:
                state = link[state]
                matched = lengths[state]
            if symbol in moves[state]:
                state = moves[state][symbol]
                matched += 1
            if whole[state]:
                for size, item in whole[state]:
                    if size <= matched:
                        hit(i + 1 - size, i + 1)
                        found.add(item)
            if matched >= window:
                hit(i + 1 - window, i + 1)
                up = state
                while lengths[link[up]] >= window:
                    up = link[up]
                held = self.items[up]
                found.update(held) if isinstance(held, set) else found.add(held)
        return spans, found


class Benchmark:
    """Normalised items: a vocabulary and the automaton of their word numbers."""

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        self.window = window
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        data, offsets = text_buffers(texts)
        data = LOWER[data]
        starts, ends, rows = word_bounds(data, offsets, ALNUM)
        hashes = span_hashes(data, starts, ends)
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        some, heads = np.unique(rows, return_index=True)
        sequences = [(items[r][0], own.tolist()) for r, own in zip(some.tolist(), np.split(numbers, heads[1:]))]
        self.automaton = SuffixAutomaton()
        for _, sequence in sequences:
            self.automaton.add(sequence)
        self.automaton.mark(sequences, window)
        self.shortest = min([window, *(len(s) for _, s in sequences)])
        self.screen = np.zeros(1 << 20, bool)
        self.screen[self.vocabulary & np.uint64((1 << 20) - 1)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, -1 for words that no item has."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.screen[hashes & np.uint64((1 << 20) - 1)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            same = self.vocabulary[at] == hashes[maybe]
            out[maybe[same]] = at[same]
        return out

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
        """Word counts, and for rows with hits the merged word ranges and the items."""
        data, offsets = text_buffers(texts)
        counts = np.zeros(len(offsets) - 1, np.int64)
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        for i, j in slices(offsets):
            part = LOWER[data[offsets[i] : offsets[j]]]
            starts, ends, rows = word_bounds(part, offsets[i : j + 1] - offsets[i], ALNUM)
            if not len(starts):
                continue
            own = np.bincount(rows, minlength=j - i)
            counts[i:j] = own
            if not len(self.vocabulary):
                continue
            first = np.cumsum(own) - own
            numbers = self.numbers(span_hashes(part, starts, ends))
            known = numbers >= 0
            edge = np.ones(len(known) + 1, bool)
            edge[1:-1] = (known[1:] != known[:-1]) | (rows[1:] != rows[:-1])
            cuts = np.flatnonzero(edge)
            runs = np.flatnonzero(known[cuts[:-1]] & (np.diff(cuts) >= self.shortest))
            for a, b in zip(cuts[runs].tolist(), cuts[runs + 1].tolist()):
                hits, found = self.automaton.stream(numbers[a:b].tolist(), self.window)
                if hits:
                    row = int(rows[a])
                    base = a - int(first[row])
                    spans.setdefault(i + row, []).extend((base + s, base + e) for s, e in hits)
                    items.setdefault(i + row, set()).update(found - {None})
        return counts, spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _plans(benchmark: DataFrame, window: int, text: str, item: str, item_bytes: int, nameless: bool = False) -> Iterator[Callable[[], Benchmark]]:
    """Makers of the benchmark's parts, at least one."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("string").alias("t")).filter("t is not null")
    if not nameless:
        rows = rows.filter("i is not null")
    total = rows.agg(F.sum(F.octet_length("t") + F.coalesce(F.octet_length("i"), F.lit(0)) + 64)).first()[0] or 0
    parts = max(1, -(-total // item_bytes))
    for k in range(parts):
        part = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        yield lambda part=part: Benchmark([(r.i, r.t) for r in part.collect()], window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_text: str = "text", item: str = "item_id", item_bytes: int = 1 << 20, clean: bool = False, nameless: bool = False, names: tuple[str, str, str] = ("_words", "_spans", "_items")) -> DataFrame:
    """All columns of ``docs`` with ``names``: words (long), hit word ranges, items (sorted ids); raises if there are such columns.

    With ``clean`` the text comes without the words of its spans. A benchmark of several parts
    passes over the texts that often; each pass is written before the next begins.
    """
    ship(docs.sparkSession)
    unclashed(docs, *names)
    at = docs.columns.index(text)
    out = docs.select("*", F.lit(0).cast("long").alias(names[0]), F.lit(None).cast(SPANS).alias(names[1]), F.lit(None).cast("array<string>").alias(names[2]))
    schema = out.schema
    share = docs.sparkSession.sparkContext.broadcast
    found = list(_plans(benchmark, window, item_text, item, item_bytes, nameless))
    for k, make in enumerate(found):
        out = out.mapInArrow(_scanner(share(make()), at, clean and k == len(found) - 1), schema)
        if k < len(found) - 1:
            out = cut(out)
    return out


def _scanner(shared, at: int, clean: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for batch in batches:
            counts, spans, items = bench.scan(batch.column(at))
            old_spans, old_items = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            all_spans: list = [None] * batch.num_rows
            all_items: list = [None] * batch.num_rows
            for r in range(batch.num_rows):
                mine = spans.get(r, ())
                if old_spans[r].is_valid:
                    mine = [*mine, *((s["start"], s["stop"]) for s in old_spans[r].as_py())]
                if mine:
                    all_spans[r] = [{"start": a, "stop": b} for a, b in merged(list(mine))]
                    all_items[r] = sorted(items.get(r, set()) | set(old_items[r].as_py() or ()))
            columns = list(batch.columns[:-3])
            if clean and any(all_spans):
                texts = columns[at].to_pylist()
                for r, own in enumerate(all_spans):
                    if own:
                        texts[r] = without_words(texts[r], [(s["start"], s["stop"]) for s in own])
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts), pa.array(all_spans, _SPAN), pa.array(all_items, pa.list_(pa.string()))], names=batch.schema.names)

    return scan


def hit_words(spans: str = "_spans") -> F.Column:
    return F.coalesce(F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]), F.lit(0).cast("long"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, text: str = "text", n_chars: str = "n_chars", **how) -> DataFrame:
    """``docs`` without benchmark passages.

    Every hit span (a match of at least ``window`` words, or a whole shorter item) is cut out of
    the text. A document of which more than ``max_coverage`` of the words are hit goes
    altogether. ``n_chars``, if there is such a column, is counted anew for cut texts; other
    columns and untouched documents stay as they are.
    """
    words, spans, items = fresh(docs, "_words", "_spans", "_items")
    found = contamination(docs, benchmark, window, text, clean=True, nameless=True, names=(words, spans, items), **how)
    out = found.filter((hit_words(spans) <= F.lit(max_coverage) * F.col(words)) | F.col(spans).isNull())
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(F.col(spans).isNotNull(), F.char_length(text).cast(docs.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the word ranges; what stood between cut words goes with them."""
    raw = text.encode("utf-8")
    data = LOWER[np.frombuffer(raw, np.uint8)]
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]), ALNUM)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = int(ends[b - 1])
        while at < len(raw) and raw[at : at + 1] in b".,;:!?" and raw[at : at + 1]:
            at += 1
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "replace").strip(" ")


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 10, key: str = "doc_id") -> DataFrame:
    """Digest columns of every document: words, hits, items."""
    found = contamination(docs.select(key, "text"), benchmark, window)
    hits = hit_words()
    return found.select(
        key,
        F.col("_words").alias("n_words"),
        hits.alias("n_hit"),
        F.when(F.col("_items").isNull(), F.lit(0)).otherwise(F.size("_items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("_items", ","), F.lit("")), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )
