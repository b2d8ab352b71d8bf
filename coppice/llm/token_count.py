"""Token counts by heap-and-linked-list byte-pair merging.

The vocabulary file of a public BPE tokenizer gives the merge ranks and the normalising and
splitting rules. A word's symbols form a doubly linked list; a heap holds the ranked
adjacent pairs; the lowest-ranked pair is popped and merged until none is left. The count
is the number of initial symbols minus the number of merges, and no identifier is made.

Defined results: a null or empty text has 0 bytes and 0 tokens; strings of special tokens
inside a text count one token each; texts of any length are processed whole; a word costs
O(n log n); every row gives one output row, repeated rows included.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.session import ship

#: Words whose counts are kept by each Python worker; beyond it the table is emptied.
CACHE_WORDS = 500_000


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte that byte-level BPE vocabularies use."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    alphabet = {b: chr(b) for b in shown}
    spare = (chr(0x100 + k) for k in range(256 - len(shown)))
    return [alphabet[b] if b in alphabet else next(spare) for b in range(256)]


class BytePairCounter:
    """Counts tokens as the library of ``vocabulary_path`` (a tokenizers .json BPE file) gives them."""

    def __init__(self, vocabulary_path: str) -> None:
        with open(vocabulary_path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only plain BPE vocabularies are supported")
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.known = set(model["vocab"])
        self.suffix = model.get("end_of_word_suffix") or ""
        self.unknown_dropped = model.get("unk_token") is None
        self.alphabet = _byte_alphabet()
        self.steps = self._normaliser(spec.get("normalizer"))
        self.split, self.byte_level = self._splitter(spec.get("pre_tokenizer"))
        special = [t["content"] for t in spec.get("added_tokens", ())]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cache: dict[str, int] = {}

    @staticmethod
    def _normaliser(spec: dict | None) -> list:
        if spec is None:
            return []
        parts = spec["normalizers"] if spec["type"] == "Sequence" else [spec]
        steps = []
        for part in parts:
            if part["type"] in ("NFC", "NFD", "NFKC", "NFKD"):
                steps.append(lambda s, form=part["type"]: s if s.isascii() else unicodedata.normalize(form, s))
            elif part["type"] == "Replace":
                pattern = regex.compile(part["pattern"].get("Regex") or regex.escape(part["pattern"]["String"]))
                steps.append(lambda s, p=pattern, to=part["content"]: p.sub(lambda _: to, s))
            elif part["type"] == "Lowercase":
                steps.append(_lower)
            else:
                raise ValueError(f"normalizer {part['type']} is not supported")
        return steps

    @staticmethod
    def _splitter(spec: dict | None) -> tuple[regex.Pattern, bool]:
        parts = spec["pretokenizers"] if spec["type"] == "Sequence" else [spec]
        if [p["type"] for p in parts] != ["Split", "ByteLevel"] or not parts[0]["invert"] or parts[0]["behavior"] != "Removed":
            raise ValueError("only a removed-gap split followed by byte level is supported")
        if parts[1].get("use_regex") or parts[1].get("add_prefix_space"):
            raise ValueError("byte level with its own splitting is not supported")
        return regex.compile(parts[0]["pattern"]["Regex"]), True

    def merges(self, symbols: list[str]) -> int:
        """How many merges the symbols of one word allow, lowest rank first, then leftmost."""
        ranks = self.ranks
        n = len(symbols)
        after = [*range(1, n), -1]
        before = [-1, *range(n - 1)]
        alive = [0] * n  # a symbol's version, raised whenever it changes or goes
        heap = [(rank, i, 0, 0) for i in range(n - 1) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, vi, vj = heapq.heappop(heap)
            j = after[i]
            if j < 0 or alive[i] != vi or alive[j] != vj:
                continue
            symbols[i] += symbols[j]
            alive[i] += 1
            alive[j] = -1
            done += 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (rank := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (rank, i, alive[i], alive[k]))
            h = before[i]
            if h >= 0 and (rank := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (rank, h, alive[h], alive[i]))
        return done

    def word(self, word: str) -> int:
        """Tokens of one split-off word."""
        symbols = [self.alphabet[b] for b in word.encode("utf-8")]
        if self.suffix and symbols:
            symbols[-1] += self.suffix
        if self.unknown_dropped and not all(s in self.known for s in symbols):
            symbols = [s for s in symbols if s in self.known]
        return len(symbols) - self.merges(symbols)

    def text(self, text: str | None) -> int:
        """Tokens of a whole text; special strings in it are one token each."""
        if not text:
            return 0
        total, pieces = 0, [text]
        if self.special is not None and self.special.search(text):
            pieces = self.special.split(text)
            total = len(pieces) - 1
        cache = self.cache
        for piece in pieces:
            for step in self.steps:
                piece = step(piece)
            for word, times in Counter(self.split.findall(piece)).items():
                count = cache.get(word)
                if count is None:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    count = self.word(word)
                    if len(word) <= 64:
                        cache[word] = count
                total += count * times
        return total


def _lower(s: str) -> str:
    """Lower-cases character by character (no final-sigma rule)."""
    return s.lower() if "Σ" not in s else "".join(c.lower() for c in s)


_counters: dict[str, BytePairCounter] = {}


def counter(path: str) -> BytePairCounter:
    """The counter of a vocabulary, read once by each Python worker."""
    if path not in _counters:
        _counters[path] = BytePairCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every row of ``docs``.

    Map-side only, no shuffle. Executors read the vocabulary at ``vocabulary_path``.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = counter(vocabulary_path)
        for batch in batches:
            texts = batch.column(1)
            tokens = [bpe.text(t.as_py()) for t in texts]
            sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in texts]
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())],
                names=["k", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.select(F.col(key)).dtypes[0][1]
    out = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(count, f"k {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("k", key)
