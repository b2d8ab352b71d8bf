"""Language-model scores by a hierarchical Pitman-Yor model.

Words are restaurants: the restaurant of a context word seats the words that follow it in
training texts, and the tables of all context restaurants are the customers of one parent
restaurant, whose base is uniform over the training words and one unknown word. Seatings
are sampled by blocked Gibbs: in every sweep all customers of a dish leave and return one
by one, each opening a table with probability (s + d T) P / (n - d t + (s + d T) P), where T
(the restaurant's tables) comes from the sweep before and P is the parent's predictive
probability. Predictive probabilities are averaged over the sweeps after the burn-in; a
text's score is the sum of their log10, and 10 ** (-score / n_tokens) its perplexity.

With d, s, t, T averaged, P(w | u) = (c - d t + (s + d T) P(w)) / (s + c_u): sums to one over
the training words and one unknown word. Every context seen in training has a
restaurant; with a ``min_context`` above one, rarer contexts use the parent.

Counts cover all training texts. Blocks of documents and shards of words and of contexts
talk by binary columns, one row for each pair: words with their training counts and, once
numbered, pairs of word numbers, each distinct pair once a block. A context with over
``hot_context`` customers is split over several shards by the following word; its tables are
summed up by the block that asks. The documents are shuffled once; the steps read the same
exchange.

Random numbers hang on the pair of words (or the word, in the parent), the sweep and the
customer alone, and discounts are parameters, so scores do not depend on the number of blocks
and shards, but for contexts that are split.

Sampling begins with a table for each dish of each context, and the parent is seated on these
(where its own total of tables would be needed, the number of distinct words stands for it).
With ``reseat``, each sweep seats the contexts against the parent and then the parent anew, on the
tables that the contexts now have; the predictive probabilities of each state (contexts, and
the parent seated on them) are averaged. The shards' states travel with the messages: what a
context shard holds passes through the word shard of its number, and the other way round.
Without it the parent stays as it is first seated, averaged over as many seatings as sweeps.

Defined results: a null or empty text has one token, its end; rows that share an id are
scored each; without training texts every word is unknown with probability one over one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.bytescan import BLANK, LOWER, mix, slices, span_hashes, text_buffers, word_bounds
from coppice.session import ship

U32, U64 = np.uint32, np.uint64
END, BEGIN = U64(0x0E4D), U64(0xBE61)  # stand for the end of a text and the context of its first word
NOT_BLANK = ~BLANK

#: Blocks and shards are no more than one for so many bytes of text, as messages are one for each pair of them.
BLOCK_BYTES = 8 << 20

#: What blocks and shards tell each other: four binary columns and two numbers.
MESSAGE = "dest int, kind int, src int, a binary, b binary, c binary, d binary, x double, y double"
_NAMES = ["dest", "kind", "src", "a", "b", "c", "d", "x", "y"]
_KINDS = [pa.int32()] * 3 + [pa.binary()] * 4 + [pa.float64()] * 2
COUNTS, NUMBERS, PAIRS, TABLES, PARENT, SEATS, STATE, SEATED = range(8)


def _messages(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 9, _KINDS)], names=_NAMES)


def _blob(a: np.ndarray, kind: type) -> bytes:
    return np.ascontiguousarray(a.astype(kind, copy=False)).tobytes()


def _planes(a: np.ndarray) -> bytes:
    """32-bit numbers by byte: how many bytes each needs, then all lowest bytes first; small numbers then compress well in a shuffle."""
    wide = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    raw = np.ascontiguousarray(a.astype("<u4", copy=False)).view(np.uint8).reshape(-1, 4)
    return bytes([wide]) + raw[:, :wide].T.tobytes()


def _unplaned(blob: bytes) -> np.ndarray:
    if not len(blob):
        return np.zeros(0, U32)
    planes = np.frombuffer(blob, np.uint8, offset=1).reshape(blob[0], -1) if len(blob) > 1 else np.zeros((1, 0), np.uint8)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u4").ravel()


def _numbers(rows: pa.Table, name: str) -> list[np.ndarray]:
    return [_unplaned(x.as_py() or b"") for x in rows.column(name)]


def _all_numbers(rows: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, U32), *_numbers(rows, name)])


def _column(rows: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() or b"" for x in rows.column(name)), kind)


def _of(rows: pa.Table, kind: int) -> pa.Table:
    """Messages of one kind, by sender."""
    import pyarrow.compute as pc

    return rows.filter(pc.equal(rows.column("kind"), kind)).sort_by("src")


def _each(rows: pa.Table, name: str, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py() or b"", kind) for x in rows.column(name)]


Draw = Callable[[np.ndarray, int], np.ndarray]


def drawn(keys: np.ndarray, salt: int) -> Draw:
    """Uniform numbers that hang on a dish's key, the salt and the step alone, wherever the dish is seated."""
    salted = mix(keys + U64(salt) * U64(0x9E3779B97F4A7C15))

    def draw(dishes: np.ndarray, step: int) -> np.ndarray:
        return (mix(salted[dishes] + U64(step) * U64(0xD6E8FEB86659FD93)) >> U64(11)) * 2.0**-53

    return draw


def seat(counts: np.ndarray, pull: np.ndarray, discount: float, draw: Draw, exact: int = 64) -> np.ndarray:
    """Tables of dishes with ``counts`` customers each, seated anew; ``pull`` is (s + d T) P of a dish.

    Up to ``exact`` customers are seated one by one; beyond, the next customer to open a table
    is drawn at once from the waiting time's power law, which is the product of the same
    probabilities up to terms of order 1 / n ** 2.
    """
    tables = np.minimum(counts, 1).astype(np.int64)
    live = np.flatnonzero(counts > 1)
    for n in range(1, exact):
        if not len(live):
            return tables
        a, t = pull[live], tables[live]
        tables[live] += draw(live, n) * (n - discount * t + a) < a
        live = live[counts[live] > n + 1]
    n, step = np.full(len(live), float(exact)), exact
    while len(live):
        step += 1
        a, t = pull[live], tables[live]
        shift = discount * t - (a - 1) / 2  # centre of (m - dt) and (m - dt + a)
        with np.errstate(over="ignore", divide="ignore"):
            n = np.maximum(n - shift, 0.5) * np.maximum(draw(live, step), 2.0**-53) ** (-1 / np.maximum(a, 1e-12)) + shift
        opened = n < counts[live]
        live, n = live[opened], np.floor(n[opened]) + 1
        tables[live] += 1
        going = n < counts[live]
        live, n = live[going], n[going]
    return tables


class Texts:
    """The words of a block's documents, as places in its list of distinct words."""

    def __init__(self, docs: pa.Table, shards: int) -> None:
        data, offsets = text_buffers(docs.column("text"))
        words, counts = [], []
        for i, j in slices(offsets):
            raw = LOWER[data[offsets[i] : offsets[j]]]
            starts, ends, rows = word_bounds(raw, offsets[i : j + 1] - offsets[i], NOT_BLANK)
            n = np.bincount(rows, minlength=j - i)
            whole = np.full(len(starts) + (j - i), END)
            place = np.arange(len(starts)) + rows
            whole[place] = span_hashes(raw, starts, ends)
            words.append(whole)
            counts.append(n + 1)
        self.n_tokens = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        tokens = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.train = np.asarray(docs.column("train").to_numpy(zero_copy_only=False), bool)
        self.in_train = np.repeat(self.train, self.n_tokens)
        hashes, which = np.unique(np.append(tokens, BEGIN), return_inverse=True)
        order = np.argsort(hashes % U64(shards), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.hashes = hashes[order]  # by shard, then hash
        self.begin = int(place[which[-1]])
        self.token = place[which[:-1]].astype(np.int32)
        self.shard = (self.hashes % U64(shards)).astype(np.int64)
        self.cuts = np.searchsorted(self.shard, np.arange(shards + 1))
        self.first = np.cumsum(self.n_tokens) - self.n_tokens
        self.context = np.empty_like(self.token)
        self.context[1:] = self.token[:-1]
        self.context[self.first] = self.begin


def _sorted(docs: pa.Table) -> pa.Table:
    return docs.sort_by([("id", "ascending"), ("tie", "ascending")])


def _block(docs: pa.Table) -> int:
    return docs.column("block")[0].as_py()


def _tell_counts(shards: int):
    def tell(docs: pa.Table) -> pa.Table:
        t = Texts(_sorted(docs), shards)
        counts = np.bincount(t.token[t.in_train], minlength=len(t.hashes))
        counts[t.begin] = t.train.sum()
        rows = [(s, COUNTS, _block(docs), _blob(t.hashes[i:j], U64), _planes(counts[i:j]), None, None, 0.0, 0.0) for s, (i, j) in enumerate(zip(t.cuts[:-1].tolist(), t.cuts[1:].tolist()))]
        return _messages(rows)

    return tell


class Words:
    """A word shard: distinct words and their training counts."""

    def __init__(self, told: pa.Table) -> None:
        self.asked = _each(told, "a", U64)
        self.blocks = told.column("src").to_pylist()
        hashes = np.concatenate(self.asked) if self.asked else np.zeros(0, U64)
        found, which = np.unique(hashes, return_inverse=True)
        counts = np.bincount(which, _all_numbers(told, "b"), minlength=len(found)).astype(np.int64)
        order = np.argsort(-counts, kind="stable")  # frequent words get small numbers
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.hashes, self.counts, which = found[order], counts[order], place[which]
        self.places = np.split(which, np.cumsum([len(a) for a in self.asked])[:-1]) if self.asked else []
        real = self.hashes != BEGIN
        self.n_tokens, self.n_types = int(self.counts[real].sum()), int((self.counts[real] > 0).sum())


def _number(shards: int):
    def number(told: pa.Table) -> pa.Table:
        shard, w = told.column("dest")[0].as_py(), Words(_of(told, COUNTS))
        rows = []
        for block, at in zip(w.blocks, w.places):
            rows.append((block, NUMBERS, shard, _planes(w.counts[at]), _planes(at * shards + shard), None, None, float(w.n_tokens), float(w.n_types)))
        return _messages(rows)

    return number


class Pairs:
    """A block's questions to the context shards: its contexts and its distinct pairs."""

    def __init__(self, t: Texts, counts: np.ndarray, numbers: np.ndarray, shards: int, min_context: int, hot_context: int) -> None:
        self.counts = counts
        self.open = counts >= min_context
        self.open[t.begin] = counts[t.begin] > 0
        self.asks = self.open[t.context] & (counts[t.token] > 0)
        key = t.context[self.asks].astype(U64) << U64(32) | t.token[self.asks].astype(U64)
        self.keys, which = np.unique(key, return_inverse=True)
        del key
        self.which = which.astype(np.int32)
        self.times = np.bincount(self.which, t.in_train[self.asks], minlength=len(self.keys)).astype(np.int64)
        u, w = (self.keys >> U64(32)).astype(np.int64), (self.keys & U64(0xFFFFFFFF)).astype(np.int64)
        self.context_seed, self.word_seed = (t.hashes[u] & U64(0xFFFFFFFF)).astype(U32), (t.hashes[w] >> U64(48)).astype(np.uint16)
        spread = np.minimum(-(-counts // hot_context), shards)
        home = (numbers.astype(np.int64) * 0x9E3779B1 >> 7) % shards
        shard = np.where(spread[u] > 1, (home[u] + (t.hashes[w] >> U64(24)).astype(np.int64) % np.maximum(spread[u], 1)) % shards, home[u])
        self.order = np.lexsort((numbers[w], numbers[u], shard)).astype(np.int32)
        self.cuts = np.searchsorted(shard[self.order], np.arange(shards + 1))
        self.u, self.w = numbers[u], numbers[w]
        # Each opened context is asked of all shards that hold a part of it.
        contexts = np.unique(np.append(t.context[self.open[t.context]], t.begin))
        contexts = contexts[self.open[contexts]]
        copies = np.maximum(spread[contexts], 1)
        self.context = np.repeat(contexts, copies)
        part = np.arange(len(self.context)) - np.repeat(np.cumsum(copies) - copies, copies)
        shard = (home[self.context] + part) % shards
        self.context_order = np.argsort(shard, kind="stable")
        self.context_cuts = np.searchsorted(shard[self.context_order], np.arange(shards + 1))
        self.numbers = numbers


def _known(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    rows = _of(answers, NUMBERS)
    return _all_numbers(rows, "a").astype(np.int64), _all_numbers(rows, "b")


def _ask_pairs(shards: int, min_context: int, hot_context: int):
    def ask(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _messages([])
        t = Texts(_sorted(docs), shards)
        p = Pairs(t, *_known(answers), shards, min_context, hot_context)
        types = float(np.sum(_of(answers, NUMBERS).column("y").to_numpy()))
        rows = []
        for s in range(shards):
            at, ctx = p.order[p.cuts[s] : p.cuts[s + 1]], p.context_order[p.context_cuts[s] : p.context_cuts[s + 1]]
            u = p.u[at]
            head = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, np.int64)
            runs = np.stack((u[head], np.diff(np.append(head, len(u))), p.context_seed[at][head])).astype(U32)
            rows.append((s, PAIRS, _block(docs), _planes(p.numbers[p.context[ctx]]), _planes(runs.ravel()), _planes(p.w[at]) + _blob(p.word_seed[at], "<u2"), _planes(p.times[at]), types, 0.0))
        return _messages(rows)

    return ask


class Restaurants:
    """A context shard: distinct pairs with their training counts, by context."""

    def __init__(self, told: pa.Table, shards: int) -> None:
        self.blocks = told.column("src").to_pylist()
        self.contexts = _numbers(told, "a")
        self.asked, seeds = [], []
        for runs, blob in zip(_numbers(told, "b"), _each(told, "c", np.uint8)):
            u, n, seed = runs.reshape(3, -1)
            k = (len(blob) - 1) // (int(blob[0]) + 2)  # the bytes of the word's number, two of its seed
            self.asked.append(np.repeat(u, n).astype(U64) << U64(32) | _unplaned(blob[: len(blob) - 2 * k].tobytes()))
            seeds.append(np.repeat(seed, n).astype(U64) << U64(16) | np.frombuffer(blob[len(blob) - 2 * k :].tobytes(), "<u2"))
        keys, times = np.concatenate(self.asked), _all_numbers(told, "d")
        self.types = float(np.max(told.column("x").to_numpy(), initial=0.0))
        seen = times > 0
        self.keys, first, which = np.unique(keys[seen], return_index=True, return_inverse=True)
        self.seeds = np.concatenate(seeds)[seen][first]
        self.counts = np.bincount(which, times[seen], minlength=len(self.keys)).astype(np.int64)
        self.context, self.of = np.unique(self.keys >> U64(32), return_inverse=True)
        self.shards = shards
        word = (self.keys & U64(0xFFFFFFFF)).astype(np.int64)
        self.many = np.flatnonzero(self.counts > 1)
        self.words, self.cuts, self.word = self._words(word[self.many])
        self.lone = word[self.counts == 1]

    def _words(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words by word shard, then number; the cuts between shards; and the place of each."""
        words, which = np.unique(word, return_inverse=True)
        order = np.argsort(words % self.shards, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return words[order], np.searchsorted(words[order] % self.shards, np.arange(self.shards + 1)), place[which]

    def totals(self, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, tables, minlength=len(self.context)).astype(np.int64)

    def told(self, shard: int, tables: np.ndarray, total: float, lone: bool = False) -> list[tuple]:
        """Messages to the word shards: the tables of words with pairs that repeat, the number of distinct words and the parent's total of tables.

        A pair that occurs once has one table for good; ``lone`` tells of these as well.
        """
        sums = np.bincount(self.word, tables[self.many], minlength=len(self.words))
        bounds = lambda cuts: zip(cuts[:-1].tolist(), cuts[1:].tolist())
        seated = [(_planes(self.words[i:j] // self.shards), _planes(sums[i:j])) for i, j in bounds(self.cuts)]
        once = [(None, None)] * self.shards
        if lone:
            words, cuts, place = self._words(self.lone)
            times = np.bincount(place, minlength=len(words))
            once = [(_planes(words[i:j] // self.shards), _planes(times[i:j])) for i, j in bounds(cuts)]
        return [(s, TABLES, shard, *x, *y, self.types, total) for s, (x, y) in enumerate(zip(seated, once))]

    def sweep(self, tables: np.ndarray, parent: np.ndarray, strength: float, discount: float, salt: int) -> np.ndarray:
        """All dishes seated anew against the tables of the sweep before."""
        pull = (strength + discount * self.totals(tables))[self.of[self.many]] * parent[self.word]
        fresh = np.minimum(self.counts, 1)
        fresh[self.many] = seat(self.counts[self.many], pull, discount, drawn(self.seeds[self.many], salt))
        return fresh


def _tell_tables(shards: int):
    """The state that sampling begins with: a table for each dish of each context."""

    def tell(told: pa.Table) -> pa.Table:
        shard, r = told.column("dest")[0].as_py(), Restaurants(_of(told, PAIRS), shards)
        return _messages(r.told(shard, np.minimum(r.counts, 1), r.types, lone=True))

    return tell


def _passed(sent: pa.Table, kind: int) -> list[tuple]:
    """Messages of a kind as they came; they go on to the shard of the same number."""
    return [tuple(row.values()) for row in _of(sent, kind).select(_NAMES).to_pylist()]


def _seat_parent(strength: float, discount: float, seeds: list[int], past: int, keep: bool, to_blocks: bool):
    """The parent seated on the tables told, once for each seed; ``past`` states of it came along, and it joins them if ``keep``."""

    def seat_parent(told: pa.Table, sent: pa.Table) -> pa.Table:
        if not told.num_rows:
            return _messages([])
        shard, w = told.column("dest")[0].as_py(), Words(_of(told, COUNTS))
        tables = _of(sent, TABLES)
        came, asked = _of(sent, SEATED), _numbers(tables, "a")
        lone = np.zeros(len(w.hashes), np.int64)
        for at, n in [*zip(_numbers(tables, "c"), _numbers(tables, "d")), *((slice(None), n) for n in _numbers(came, "b"))]:
            lone[at] += n
        customers = lone.copy()
        for at, n in zip(asked, _numbers(tables, "b")):
            customers[at] += n
        types, total = (float(np.max(tables.column(c).to_numpy(), initial=0.0)) for c in "xy")
        pull = np.full(len(customers), (strength + discount * total) / (types + 1))
        seats = sum(seat(customers, pull, discount, drawn(w.hashes, s)) for s in seeds)
        before = _all_numbers(came, "a").reshape(past, 2, len(customers))
        states = np.concatenate((before, np.stack((customers, seats))[None])) if keep else before
        if to_blocks:
            totals = _blob(states.sum(axis=2, dtype=np.float64), np.float64)
            return _messages([(b, PARENT, shard, _planes(states[:, 0, at].ravel()), _planes(states[:, 1, at].ravel()), totals, None, 0.0, 0.0) for b, at in zip(w.blocks, w.places)])
        rows = [(c, PARENT, shard, _planes(customers[at]), _planes(seats[at]), None, None, float(customers.sum()), float(seats.sum())) for c, at in zip(tables.column("src").to_pylist(), asked)]
        rows.append((shard, SEATED, shard, _planes(states.ravel()), _planes(lone), None, None, 0.0, 0.0))
        return _messages(rows + _passed(sent, STATE))

    return seat_parent


def _parent(customers: np.ndarray, seats: np.ndarray, n: float, tables: float, types: float, strength: float, discount: float) -> np.ndarray:
    """The parent's predictive probabilities, from what its tables hold and what they leave free; ``n`` and ``tables`` are its totals."""
    return (customers - discount * seats + (strength + discount * tables) / (types + 1)) / (strength + n)


class Seating:
    """A context shard about to be seated: its restaurants, the parent's probabilities and the parent's total of tables."""

    def __init__(self, told: pa.Table, sent: pa.Table, shards: int, strength: float, parent_discount: float, each: int) -> None:
        self.shard, self.restaurants = told.column("dest")[0].as_py(), Restaurants(_of(told, PAIRS), shards)
        parent = _of(sent, PARENT)
        n, total = (float(np.sum(parent.column(c).to_numpy())) for c in "xy")
        self.total = total / each
        self.parent = _parent(_all_numbers(parent, "a").astype(float), _all_numbers(parent, "b") / each, n, self.total, self.restaurants.types, strength, parent_discount)


def _seats(shard: int, r: Restaurants, tables: np.ndarray, totals: np.ndarray) -> pa.Table:
    """What the blocks asked: customers and ``tables`` of each pair, and rows of ``totals`` for each context."""

    def look(known: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros((len(values), len(asked)), np.int64)
        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        return np.where(known[at] == asked, values[:, at], 0)

    pairs = np.stack((r.counts, tables))
    return _messages([(b, SEATS, shard, *map(_planes, look(r.keys, pairs, q)), _planes(look(r.context, totals, c.astype(U64)).ravel()), None, 0.0, 0.0) for b, c, q in zip(r.blocks, r.contexts, r.asked)])


def _seat_contexts(shards: int, strength: float, discount: float, parent_discount: float, seed: int, burn_in: int, sweeps: int):
    """All sweeps against a parent that stays."""

    def seat_contexts(told: pa.Table, sent: pa.Table) -> pa.Table:
        if not told.num_rows:
            return _messages([])
        s = Seating(told, sent, shards, strength, parent_discount, sweeps)
        r = s.restaurants
        tables, total = np.minimum(r.counts, 1), np.zeros(len(r.keys), np.int64)
        for k in range(burn_in + sweeps):
            tables = r.sweep(tables, s.parent, strength, discount, seed + 1000 + k)
            if k >= burn_in:
                total += tables
        return _seats(s.shard, r, total, r.totals(total)[None])

    return seat_contexts


def _sweep_contexts(shards: int, strength: float, discount: float, parent_discount: float, salt: int, past: int, keep: int):
    """One sweep after ``past`` states of the shard, of which the last ``keep`` and the new one go on; tells the parent the new tables."""

    def sweep_contexts(told: pa.Table, sent: pa.Table) -> pa.Table:
        if not told.num_rows:
            return _messages([])
        s = Seating(told, sent, shards, strength, parent_discount, 1)
        r = s.restaurants
        states = _all_numbers(_of(sent, STATE), "a").reshape(past, len(r.many))
        tables = np.minimum(r.counts, 1)
        if past:
            tables[r.many] = states[-1]
        tables = r.sweep(tables, s.parent, strength, discount, salt)
        states = np.concatenate((states[past - keep :], tables[None, r.many]))
        rows = [(s.shard, STATE, s.shard, _planes(states.ravel()), None, None, None, 0.0, 0.0)]
        return _messages(r.told(s.shard, tables, s.total) + rows + _passed(sent, SEATED))

    return sweep_contexts


def _tell_seats(shards: int, sweeps: int):
    def tell(told: pa.Table, sent: pa.Table) -> pa.Table:
        if not told.num_rows:
            return _messages([])
        shard, r = told.column("dest")[0].as_py(), Restaurants(_of(told, PAIRS), shards)
        tables = np.repeat(np.minimum(r.counts, 1)[None], sweeps, axis=0)
        tables[:, r.many] = _all_numbers(_of(sent, STATE), "a").reshape(sweeps, len(r.many))
        return _seats(shard, r, tables.sum(axis=0), np.stack([r.totals(t) for t in tables]))

    return tell


SCORES = "k long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(shards: int, min_context: int, hot_context: int, strength: float, discount: float, parent_discount: float, sweeps: int, states: int):
    """Scores by the mean over ``states`` of the model, each of them the mean of as many seatings as make ``sweeps``."""
    each = sweeps // states

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in SCORES.split(", ")]
        if not docs.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
        docs = _sorted(docs)
        t = Texts(docs, shards)
        numbers = _of(answers, NUMBERS)
        n_all, types = (float(np.sum(numbers.column(c).to_numpy())) for c in ("x", "y"))
        p = Pairs(t, *_known(answers), shards, min_context, hot_context)
        parent = _of(answers, PARENT)
        customers, seats = (np.concatenate([np.zeros((states, 0)), *(v.reshape(states, -1) for v in _numbers(parent, c))], axis=1) for c in "ab")
        totals = _column(parent, "c", np.float64).reshape(-1, states, 2).sum(axis=0)
        told = _of(answers, SEATS)
        pair_held = np.zeros(len(p.keys))
        pair_held[p.order] = _all_numbers(told, "a") - discount / sweeps * _all_numbers(told, "b")
        tables = np.concatenate([np.zeros((states, 0)), *(v.reshape(states, -1) for v in _numbers(told, "c"))], axis=1)
        del answers, numbers, parent, told
        own = np.zeros(len(t.token))
        own[p.asks] = pair_held[p.which]
        u = t.context
        guess, given = np.zeros(len(t.token)), np.zeros(len(t.token))
        for k in range(states):
            chance = _parent(customers[k], seats[k] / each, totals[k, 0], totals[k, 1] / each, types, strength, parent_discount)[t.token]
            free = discount / each * np.bincount(p.context[p.context_order], tables[k], minlength=len(t.hashes))
            given += (strength + free[u]) * chance / states
            guess += chance / states
        guess = np.where(p.open[u], (own + given) / (strength + p.counts[u]), guess)
        counts = p.counts[t.token]
        base = np.log10((p.counts + 0.1) / (n_all + 0.1 * (types + 1)))[t.token]
        total = lambda v: np.add.reduceat(v, t.first) if len(v) else np.zeros(0)  # noqa: E731  no text is without its end
        columns = (docs.column("k"), pa.array(~t.train), pa.array(t.n_tokens), pa.array(total((counts > 0).astype(np.int64))), pa.array(np.full(len(t.first), int(n_all))), pa.array(total(base)), pa.array(total(np.log10(guess))))
        return pa.table(list(columns), names=names)

    return score


def model_scores(
    docs: DataFrame,
    held_out: F.Column,
    text: str = "text",
    key: str = "doc_id",
    strength: float = 1.0,
    discount: float = 0.8,
    parent_discount: float = 0.6,
    min_context: int = 1,
    burn_in: int = 2,
    sweeps: int = 3,
    hot_context: int = 2_000_000,
    seed: int = 42,
    blocks: int | None = None,
    shards: int | None = None,
    reseat: bool = False,
) -> DataFrame:
    """Scores of every row; the model learns from the rows where ``held_out`` is false.

    ``key`` must be an integer column. ``blocks`` and ``shards`` default to the session's shuffle
    partitions, or one for each ``BLOCK_BYTES`` of text if these are fewer; both must grow with the input, so that one of them fits into a task's memory. ``reseat``: the
    parent is seated anew, on the contexts' tables, in every sweep.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not (blocks and shards):
        size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("long"))).head()[0] or 0
        parts = min(parts, max(1, -(-size // BLOCK_BYTES)))
    n, s = blocks or parts, shards or parts
    own = docs.select(
        F.col(key).cast("long").alias("k"),
        F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("tie"),
        F.coalesce(~held_out, F.lit(True)).alias("train"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    own = own.withColumn("block", F.pmod(F.xxhash64("id", "tie"), F.lit(n)).cast("int")).repartition(parts, "block")
    by_block = own.groupBy("block")
    told = by_block.applyInArrow(_tell_counts(s), MESSAGE)
    numbered = told.groupBy("dest").applyInArrow(_number(s), MESSAGE)
    asked = by_block.cogroup(numbered.groupBy("dest")).applyInArrow(_ask_pairs(s, min_context, hot_context), MESSAGE)
    tables = asked.groupBy("dest").applyInArrow(_tell_tables(s), MESSAGE)

    def parent(sent: DataFrame, seeds: list[int], past: int, keep: bool, to_blocks: bool) -> DataFrame:
        return told.groupBy("dest").cogroup(sent.groupBy("dest")).applyInArrow(_seat_parent(strength, parent_discount, seeds, past, keep, to_blocks), MESSAGE)

    def contexts(sent: DataFrame, step: Callable) -> DataFrame:
        return asked.groupBy("dest").cogroup(sent.groupBy("dest")).applyInArrow(step, MESSAGE)

    if reseat:
        # A state to score with is the contexts after a sweep and the parent seated on them.
        told_tables, kept = tables, 0
        for k in range(burn_in + sweeps):
            seated = parent(told_tables, [seed + k], max(kept - 1, 0), k > burn_in, False)
            told_tables = contexts(seated, _sweep_contexts(s, strength, discount, parent_discount, seed + 1000 + k, min(k, max(kept, 1)), kept))
            kept += k >= burn_in
        last = parent(told_tables, [seed + burn_in + sweeps], sweeps - 1, True, True)
        seats = contexts(told_tables, _tell_seats(s, sweeps))
    else:
        seeds = list(range(seed, seed + sweeps))
        last = parent(tables, seeds, 0, True, True)
        seats = contexts(parent(tables, seeds, 0, False, False), _seat_contexts(s, strength, discount, parent_discount, seed, burn_in, sweeps))
    answers = numbered.unionByName(last).unionByName(seats)
    out = by_block.cogroup(answers.groupBy("dest")).applyInArrow(_score(s, min_context, hot_context, strength, discount, parent_discount, sweeps, sweeps if reseat else 1), SCORES)
    return out.withColumnRenamed("k", key)
