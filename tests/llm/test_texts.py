"""Operators that look at one text at a time."""

import hashlib
import os
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from coppice.llm import decontaminate, media, token_count, toxicity
from coppice.llm.bytescan import BLANK, span_hashes, text_buffers, window_minima, word_bounds

WORDS = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té😀\x1c", max_size=12)), max_size=8))
def test_words_are_those_of_each_text(texts):
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    starts, ends, rows = word_bounds(data, offsets, ~BLANK)
    found = [[] for _ in texts]
    for s, e, r in zip(starts, ends, rows):
        found[r].append(data[s:e].tobytes())
    assert found == [(t or "").encode().split() for t in texts]
    assert len(set(span_hashes(data, starts, ends).tolist())) == len({w for f in found for w in f})


def test_window_minima():
    v = np.array([5, 3, 3, 9, 1, 7], np.uint64)
    low, place = window_minima(v, 3)
    assert low.tolist() == [3, 3, 1, 1] and place.tolist() == [1, 1, 4, 4]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcXYZ 'sSΣσıİß01Ⅷ½<|endoftext|>!.你́\x85​😀ǅK", max_size=60))
def test_token_counts_match_the_library(text):
    library = Tokenizer.from_file(WORDS) if not hasattr(test_token_counts_match_the_library, "t") else test_token_counts_match_the_library.t
    test_token_counts_match_the_library.t = library
    assert token_count.counter(WORDS).text(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_token_count_table(odd_docs, no_docs):
    library = Tokenizer.from_file(WORDS)
    got = token_count.token_counts(odd_docs, WORDS).collect()
    texts = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    want = sorted((i if i is not None else -1, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_count.token_counts(no_docs, WORDS).count() == 0


def test_one_long_word_is_merged_in_time():
    word = "ab" * 20_000
    assert token_count.counter(WORDS).text(word) == len(Tokenizer.from_file(WORDS).encode(word, add_special_tokens=False).ids)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1024, 1025, 100_000])
def test_media_round_trip(n):
    raw = os.urandom(n)
    stored = media.padded(raw)
    data = media.wrap(stored)
    (track,) = media.probe(data)
    assert media.payload(data, track) == stored and len(stored) % 64 == 0 and len(stored) >= max(64, n)
    assert track.codec == "raw " and track.duration == len(stored) // 64
    a, b = track.keyframes[0]
    assert data[a:b] == stored[:64]


def test_media_never_crashes_on_damage():
    data = media.wrap(media.padded(b"x" * 500))
    for at in range(len(data)):
        for broken in (data[:at], data[:at] + b"\xff" + data[at + 1 :]):
            try:
                media.probe(broken)
            except media.BadContainer:
                pass


def test_media_box_sizes():
    inner = media._box(b"free", b"abc")
    wide = struct.pack(">I4sQ", 1, b"moov", 16 + len(inner)) + inner
    tail = struct.pack(">I4s", 0, b"mdat") + b"rest"
    assert [k for k, _, _ in media.boxes(wide + tail)] == [b"moov", b"mdat"] and media.probe(wide + tail) == []


def test_media_tables(spark, odd_docs, no_docs):
    got = media.media_digests(media.store_texts(odd_docs)).collect()
    want = {}
    for r in odd_docs.collect():
        raw = (r.text or "").encode()
        stored = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        want[r.doc_id] = (len(raw), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-64:]))
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got} == want
    assert len(got) == odd_docs.count() and media.media_digests(media.store_texts(no_docs)).count() == 0
    table = spark.createDataFrame([(1, bytearray(media.wrap(bytes(64)))), (2, None), (3, bytearray(b"nonsense"))], "id int, media binary")
    found = {r.id: r for r in media.media_columns(table, keep=("id",)).collect()}
    assert found[1].tracks[0].codec == "raw " and found[1].error is None
    assert found[2].tracks == [] and found[3].tracks == [] and found[2].error and found[3].error


def brute_hits(text, items, window):
    words = lambda t: __import__("re").findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").encode().lower())
    w = words(text)
    hit, found = [False] * len(w), set()
    for i, t in items:
        own = words(t)
        if not own:
            continue
        n = min(window, len(own))
        for k in range(len(own) - n + 1):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == own[k : k + n]:
                    found.add(str(i))
                    hit[j : j + n] = [True] * n
    return len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("item_bytes", [1 << 20, 400])
def test_contamination_against_brute_force(spark, odd_docs, unique_docs, no_docs, item_bytes):
    rows = [(r.doc_id, r.text) for r in unique_docs.collect()]
    texts = [t for _, t in rows if t and len(t.split()) < 500]
    items = [(1, " ".join(texts[5].split()[3:25])), (2, texts[6][:70]), (3, "Lora, the"), (4, None), (5, ""), (12, " ".join(texts[5].split()[10:40])), (30, "nowhere else seen words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(unique_docs, bench, 4, item_bytes=item_bytes)
    got = {r.doc_id: (r._words, sum(s.stop - s.start for s in r._spans or ()), len(r._items or ()), hashlib.sha256(",".join(r._items or ()).encode()).hexdigest()) for r in out.collect()}
    want = {i: brute_hits(t, items, 4) for i, t in rows if len((t or "").split()) < 500}
    assert {i: got[i] for i in want} == want and any(v[1] for v in want.values())
    assert out.columns[: len(unique_docs.columns)] == unique_docs.columns
    assert decontaminate.contamination_report(no_docs, bench).count() == 0
    none = decontaminate.contamination_report(odd_docs, bench.limit(0)).collect()
    assert len(none) == odd_docs.count() and not any(r.contaminated for r in none)


def test_decontaminated_texts(spark):
    item = " ".join(f"item{k}" for k in range(20))
    docs = spark.createDataFrame([(1, f"Some own words, {item}. And more of our own words here to stay for a good while, as long as the passage is, which has twenty words.", 9), (2, item, 9), (3, "clean", 5), (4, None, None)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in decontaminate.decontaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(out) == {1, 3, 4} and "item" not in out[1].text and out[1].text.startswith("Some own words, ")
    assert out[1].n_chars == len(out[1].text) and out[3].n_chars == 5


def test_toxicity_on_held_out_rows(spark, odd_docs, no_docs):
    import random

    rng = random.Random(3)
    calm = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(400):
        words = [rng.choice(calm) for _ in range(rng.randint(5, 80))]
        bad = k % 4 == 0
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["vilecreature", "worthless"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(9999, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    rest = toxicity.crc_remainder("doc_id", 3)
    out = toxicity.toxicity_scores(docs, marks, learn=rest != 1).withColumn("h", rest == 1).collect()
    truth = dict(labels)
    held = [r for r in out if r.h]
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert sum((r._score >= 0.7) == bool(truth[r.doc_id]) for r in held) / len(held) > 0.97
    odd = toxicity.toxicity_scores(odd_docs, marks).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r._score <= 1 for r in odd)
    assert len({r._score for r in odd if not r.text}) == 1
    assert toxicity.toxicity_scores(no_docs, marks).count() == 0
    flat = toxicity.toxicity_scores(docs, marks.filter("toxic = 0")).select("_score").distinct().collect()
    assert len(flat) == 1


def test_toxicity_ignores_other_columns(spark):
    docs = spark.createDataFrame([(k, "same text", lang) for k, lang in enumerate(["en", "de", None])], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(docs, labels).agg(F.countDistinct("_score")).first()[0] == 1


@pytest.mark.parametrize("item_bytes", [1 << 20, 40])
def test_items_without_id_are_cut_out(spark, item_bytes):
    bench = spark.createDataFrame([(None, "one two three four five"), (None, "six seven eight nine ten"), ("a", "red green blue white black")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x0 x1 x2 x3 x4 one two three four five x5"), (2, "y0 y1 y2 y3 y4 red green blue white black y5")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in decontaminate.decontaminated(docs, bench, 4, item_bytes=item_bytes).collect()}
    assert {k: t.split() for k, t in out.items()} == {1: "x0 x1 x2 x3 x4 x5".split(), 2: "y0 y1 y2 y3 y4 y5".split()}
    hits = {r.doc_id: r._items for r in decontaminate.contamination(docs, bench, 4, item_bytes=item_bytes, nameless=True).collect()}
    assert hits == {1: [], 2: ["a"]}
    assert {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.contamination_report(docs, bench, 4).collect()} == {1: (0, 0), 2: (5, 1)}
