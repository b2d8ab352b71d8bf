"""Operators that compare texts across the corpus, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from coppice.llm import fmindex, hamming, line_dedup, mixing, near_dup, pitman_yor, simhash, substring, url_filter
from coppice.llm.components import components


def find(parent, x):
    while parent.setdefault(x, x) != x:
        x = parent[x]
    return x


def test_trie_join_finds_all_components():
    rng = np.random.default_rng(1)
    for trial in range(60):
        n = int(rng.integers(2, 150))
        keys = rng.integers(0, 1 << 63, 5, dtype=np.uint64)[rng.integers(0, 5, n)]
        for _ in range(trial % 7):
            keys = keys ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        pairs = np.unique(np.stack([rng.integers(0, 1 + trial % 3, n).astype(np.uint64), keys]), axis=1)
        g, k = pairs
        labels, a, b = hamming.trie_components(g, k, 4, frontier=8)
        near = (np.bitwise_count(k[:, None] ^ k[None]) <= 4) & (g[:, None] == g[None])
        want = np.arange(len(k))
        while not (low := np.where(near, want[None], len(k)).min(1) == want).all():
            want = np.where(near, want[None], len(k)).min(1)
        assert (labels == want).all() and near[a, b].all() and len(a) == len(k) - len(set(labels))


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("limit", [32_000, 3])
def test_simhash_classes(odd_docs, no_docs, limit):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    prints = [brute_fingerprint(t) for _, t in rows]
    parent = {}
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                parent[find(parent, i)] = find(parent, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        root = find(parent, i)
        least[root] = min(x for x in (least.get(root), d) if x is not None) if (least.get(root) is not None or d is not None) else None
    want = Counter((d, f"{prints[i]:016x}", least[find(parent, i)]) for i, (d, _) in enumerate(rows))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_classes(odd_docs, group_limit=limit).collect())
    assert got == want
    assert simhash.simhash_classes(no_docs).count() == 0


def test_spark_hash_is_the_shingle_hash(spark):
    """The engine's own xxhash64 has seed 42, so fingerprints can be made in SQL as well."""
    signed = spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0]
    assert signed % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300), (None, 4), (7, 6)]
    edges += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    parent = {}
    for a, b in edges:
        if a is not None and a != b:
            parent[find(parent, max(find(parent, a), find(parent, b)))] = min(find(parent, a), find(parent, b))
    want = {x: find(parent, x) for x in list(parent)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fm_index_matching_statistics():
    rng = np.random.default_rng(0)
    for _ in range(60):
        sigma, depth = int(rng.integers(2, 6)), int(rng.integers(1, 8))
        text = np.concatenate([np.append(rng.integers(1, sigma, rng.integers(1, 30)), 0) for _ in range(3)])
        index = fmindex.FMIndex(text, sigma, depth)
        queries = [rng.integers(1, sigma + 1, rng.integers(0, 30)) for _ in range(3)]
        q = np.concatenate(queries)
        q = np.where(q >= sigma, -1, q)
        ends = np.cumsum([len(x) for x in queries])
        starts = ends - [len(x) for x in queries]
        lengths, earliest = index.matches(q, starts, ends)
        t = text.tolist()
        for a, b in zip(starts, ends):
            for i in range(a, b):
                best, first = 0, -1
                for n in range(1, min(depth, b - i) + 1):
                    places = [j for j in range(len(t) - n + 1) if t[j : j + n] == q[i : i + n].tolist()]
                    if not places:
                        break
                    best, first = n, places[0]
                assert lengths[i] == best and earliest[i] == (first if best == depth else -1)


def brute_substring(rows, window):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("window", "gram", "hot"), [(20, 6, 20_000), (6, 3, 1), (5, 1, 20_000)])
def test_substring_dedup(unique_docs, no_docs, window, gram, hot):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(unique_docs, window, gram, hot_contents=hot).collect()}
    assert got == brute_substring([(r.doc_id, r.text) for r in unique_docs.collect()], window)
    assert substring.substring_dedup(no_docs).count() == 0


def test_substring_dedup_of_few_words(spark):
    rng = random.Random(4)
    rows = [(d, " ".join(rng.choice(["a", "b"]) for _ in range(rng.randint(0, 60)))) for d in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for gram, hot in ((1, 20_000), (4, 1)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(docs, 7, gram, hot_contents=hot).collect()}
        assert got == brute_substring(rows, 7)


def test_substring_repeated_rows(odd_docs):
    got = substring.substring_dedup(odd_docs).collect()
    assert len(got) == odd_docs.count()
    again = [r for r in got if Counter(x.doc_id for x in got)[r.doc_id] == 3]
    assert len(again) == 3 and sum(r.n_removed == r.n_words for r in again) >= 2


def test_edit_within():
    rng = random.Random(1)
    for _ in range(800):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 10))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(0, 10))] if rng.random() < 0.5 else [x for x in a if rng.random() > 0.1]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, above = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        limit = rng.randint(0, 8)
        assert line_dedup.edit_within(a, b, limit) == (row[-1] <= limit)


def brute_lines(rows, min_words=5, budget=3, similarity=0.8):
    places = []
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            form = tuple(re.findall(rb"[0-9a-z\x80-\xff]+", line.encode().lower()))
            if len(form) >= min_words:
                places.append((d, k, form))
    places.sort()
    prints, parent = {}, {}
    for form in {p[2] for p in places}:
        ((hashes, heads, *_),) = line_dedup._parsed(pa.array([b" ".join(form).decode()]))
        prints[form] = int(line_dedup.simhashes(hashes, heads)[0])
    forms = sorted(prints)
    for i, a in enumerate(forms):
        for b in forms[:i]:
            if bin(prints[a] ^ prints[b]).count("1") <= budget and line_dedup.edit_within(list(a), list(b), int((1 - similarity) * max(len(a), len(b)) + 1e-9)):
                parent[find(parent, a)] = find(parent, b)
    seen, gone = set(), set()
    for d, k, form in places:
        root = find(parent, form)
        if root in seen:
            gone.add((d, k))
        seen.add(root)
    return gone


def test_line_dedup(spark, unique_docs, odd_docs, no_docs):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 30))] for _ in range(12)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                line[rng.randrange(len(line))] = rng.choice(words)
            if rng.random() < 0.2:
                rng.shuffle(line)
            lines.append(" ".join(line))
        rows.append((d, "\n".join(lines) if rng.random() > 0.1 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.id, r.line) for r in line_dedup.repeated_lines(docs, budget=3, short=False).collect()} == brute_lines(rows)
    assert {(r.id, r.line) for r in line_dedup.repeated_lines(docs).collect()} == brute_all_lines(rows, 5, shortest=1)
    gone = brute_all_lines([(r.doc_id, r.text) for r in unique_docs.collect()], 5, shortest=1)
    out = {r.doc_id: r for r in line_dedup.without_repeated_lines(unique_docs).collect()}
    for r in unique_docs.collect():
        want = None if r.text is None else "\n".join(x for k, x in enumerate(r.text.split("\n")) if (r.doc_id, k) not in gone)
        assert out[r.doc_id].text == want and out[r.doc_id]._removed == sum(d == r.doc_id for d, _ in gone)
        assert out[r.doc_id].hash == r.hash and out[r.doc_id].n_chars == (len(want) if out[r.doc_id]._removed else r.n_chars)
    assert line_dedup.without_repeated_lines(odd_docs).count() == odd_docs.count()
    assert line_dedup.without_repeated_lines(no_docs).count() == 0


def brute_all_lines(rows, min_words, similarity=0.8, shortest=None):
    """Brute force by edit similarity alone; ``shortest``: least words of lines that are compared for equality."""
    places = []
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            form = tuple(re.findall(rb"[0-9a-z\x80-\xff]+", line.encode().lower())) or (line.strip().encode() + b" ",)
            if form != (b" ",) and (shortest or len(form) >= min_words):
                places.append((d, k, form))
    places.sort()
    parent, forms = {}, sorted({p[2] for p in places})
    for i, a in enumerate(forms):
        for b in forms[:i]:
            if min(len(a), len(b)) >= min_words and line_dedup.edit_within(list(a), list(b), int((1 - similarity) * max(len(a), len(b)) + 1e-9)):
                parent[find(parent, a)] = find(parent, b)
    seen, gone = set(), set()
    for d, k, form in places:
        root = find(parent, form)
        if root in seen:
            gone.add((d, k))
        seen.add(root)
    return gone


def edited_lines(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    lines = []
    for length in [5, 6, 9, 10, 14, 20, 33, 50, 90, 140] * 3:
        base = rng.choices(words, weights=[1 / (k + 1) for k in range(300)], k=length)
        for edits in (0, 1, length // 10, length // 5, length // 5 + 1, length // 4):
            own = list(base)
            for _ in range(edits):
                at = rng.randrange(len(own))
                own[at : at + rng.choice([0, 1, 1])] = [rng.choice(words)] * rng.choice([0, 1, 1])
            lines.append(" ".join(own))
    rng.shuffle(lines)
    return [(k, "\n".join(lines[3 * k : 3 * k + 3])) for k in range(len(lines) // 3)]


def test_line_dedup_finds_all_near_lines(spark):
    rows = edited_lines(11)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_all_lines(rows, 5)
    for most, width in ((8_192, 1), (8_192, 3), (3, 2)):  # areas in a task, and areas joined by their rarest words
        assert {(r.id, r.line) for r in line_dedup.repeated_lines(docs, short=False, most_lines=most, width=width).collect()} == want
    classes = np.zeros(line_dedup.CLASSES, np.uint8)
    lines = spark.createDataFrame([(k, bytearray(t.encode())) for k, t in enumerate(line for _, x in rows for line in x.split("\n"))], "id long, t binary")
    marks = line_dedup._word_marks(lines, classes, 0.8)
    one, cut_up = ({tuple(r) for r in line_dedup.line_candidates(marks, 0.8, True, group_limit=k).collect()} for k in (32_000, 20))
    assert one == cut_up


def test_few_links_are_settled_in_one_task(spark, monkeypatch):
    """Up to a bound no rounds run, beyond it they do; the components are the same."""
    from coppice.llm import components as module

    rng = random.Random(3)
    rows = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, 5000 - k) for k in range(50)] + [(1, None), (7, 7)]
    edges = spark.createDataFrame(rows, "a long, b long")
    want, rounds = {tuple(r) for r in components(edges).collect()}, []
    monkeypatch.setattr(module, "_large_star", lambda pairs, whole=module._large_star: rounds.append(1) or whole(pairs))
    assert {tuple(r) for r in components(edges, few=1000).collect()} == want and not rounds
    assert {tuple(r) for r in components(edges, few=100).collect()} == want and rounds
    assert components(edges.filter("a = 7"), few=10).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_first_places_come_from_the_match(kind):
    """Of each line the first place and the number of places, also where shards go over batches and held places are cut down."""
    rng = random.Random(2)
    rows = sorted(((h % 7, rng.randrange(40), rng.randrange(3), rng.randrange(9), h) for h in (rng.randrange(30) ** 2 // 30 for _ in range(3000))), key=lambda r: r[0])
    name = (lambda k: k) if kind == "long" else str
    id_type = pa.int64() if kind == "long" else pa.string()
    columns = [(pa.int32(), 0), (id_type, 1), (pa.int64(), 2), (pa.int32(), 3), (pa.int64(), 4)]
    batches = [pa.record_batch([*(pa.array([name(r[c]) if c == 1 else r[c] for r in rows[i : i + 170]], t) for t, c in columns), pa.nulls(len(rows[i : i + 170]), pa.binary())], names=line_dedup._SCANNED) for i in range(0, 3000, 170)]
    want, n = {}, Counter()
    for _, i, t, line, h in rows:
        want[h] = min(want.get(h, (name(i), t, line)), (name(i), t, line))
        n[h] += 1
    for most in (1 << 18, 50):
        out = pa.Table.from_batches(line_dedup._match(0.8, id_type, most=most)(iter(batches))).to_pylist()
        firsts = [r for r in out if r["b"] is not None]
        assert Counter((r["id"], r["tie"], r["line"], r["hash"]) for r in out) == Counter((name(i), *rest) for _, i, *rest in rows)
        assert len(firsts) == len(want) and {r["hash"]: ((r["id"], r["tie"], r["line"]), r["b"]) for r in firsts} == {h: (want[h], n[h]) for h in want}


def test_order_of_words_decides_no_line(spark, monkeypatch):
    """Frequencies of words order the runs that lines meet by; any others give the same lines."""
    rows = edited_lines(12)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, rng = brute_all_lines(rows, 5), np.random.default_rng(1)
    for classes in (np.zeros(line_dedup.CLASSES, np.uint8), rng.integers(0, 90, line_dedup.CLASSES).astype(np.uint8)):
        monkeypatch.setattr(line_dedup, "_word_classes", lambda *_, c=classes: c)
        for most in (8_192, 3):
            assert {(r.id, r.line) for r in line_dedup.repeated_lines(docs, short=False, most_lines=most).collect()} == want


def test_linked_lines_lie_in_one_area():
    """Every linked pair is connected by the shared runs, whatever the order of words, the shards and the widths."""
    for seed in range(6):  # all widths, with and without runs that are held wide
        rng = np.random.default_rng(seed)
        lines = [x.split() for _, t in edited_lines(20 + seed) for x in t.split("\n")]
        lines = [x for x in dict.fromkeys(map(tuple, lines)) if len(x) >= 5]
        column = pa.array(["\n".join(" ".join(x) for x in lines)])
        ((hashes, heads, n, _, _, content),) = line_dedup._parsed(column)
        line, at, run = line_dedup._marks(hashes, heads, n, rng.integers(0, 20, line_dedup.CLASSES).astype(np.uint8), 0.8, 1 + seed % 3, 5)
        within = np.repeat(np.arange(len(n)), n)
        maps = line_dedup._sketches(hashes, within, len(n))[:, line]
        kept = np.split(np.argsort(n[line]), np.searchsorted(np.sort(n[line]), [48, 110], side="right"))
        told = [line_dedup._packed(run[k], content[line][k], n[line][k], at[k], line_dedup._folded(maps[:, k], 1 << w)) for w, k in enumerate(kept)]
        a, b = line_dedup._links(np.concatenate([line_dedup._unpacked(m) for m in told], axis=1), 0.8, wide=[16_384, 3][seed // 3])
        place = {int(c >> np.uint64(16)): k for k, c in enumerate(content)}
        parent = {}
        for u, v in zip(a.tolist(), b.tolist()):
            parent[find(parent, place[u])] = find(parent, place[v])
        x, y = np.triu_indices(len(n), 1)
        near = line_dedup.edits_within(hashes, heads, n, x, y, 0.8)
        assert near.sum() > 100 and all(find(parent, u) == find(parent, v) for u, v in zip(x[near].tolist(), y[near].tolist()))
        labels = line_dedup._clusters(hashes, heads, n, np.zeros(len(n), np.int64), 0.8, together=[64, 10_000][seed % 2])
        parent = {}
        for u, v in zip(x[near].tolist(), y[near].tolist()):
            parent[find(parent, u)] = find(parent, v)
        roots = [find(parent, k) for k in range(len(n))]
        assert len(set(zip(roots, labels.tolist()))) == len(set(roots)) == len(set(labels.tolist()))


def test_batch_edit_distance():
    rng = random.Random(3)
    lines = [x.split() for _, t in edited_lines(3) for x in t.split("\n")]
    lines += [[rng.choice("abc") for _ in range(rng.randint(5, 400))] for _ in range(40)]
    ids = {w: k + 1 for k, w in enumerate(sorted({w for x in lines for w in x}))}
    words = np.array([ids[w] for x in lines for w in x], np.uint64)
    n = np.array([len(x) for x in lines])
    x, y = (np.array([rng.randrange(len(lines)) for _ in range(3000)]) for _ in "xy")
    got = line_dedup.edits_within(words, np.cumsum(n) - n, n, x, y, 0.8, cells=1 << 12)
    assert got.tolist() == [line_dedup.edit_within(lines[a], lines[b], int(0.2 * max(len(lines[a]), len(lines[b])) + 1e-9)) for a, b in zip(x, y)]


def test_marks_of_a_message_come_back():
    rng = np.random.default_rng(1)
    run, line, n, at = rng.integers(0, 1 << 32, 50, dtype=np.uint64), rng.integers(0, 1 << 63, 50, dtype=np.uint64), rng.integers(5, 1 << 17, 50), rng.integers(0, 1 << 17, 50)
    maps = rng.integers(0, 1 << 63, (4, 50), dtype=np.uint64)
    for words in (1, 2, 4):
        own = line_dedup._folded(maps, words)
        back = line_dedup._unpacked(line_dedup._packed(run, line, n, at, own))
        for got, want in zip(back, (run, line >> np.uint64(16), np.minimum(n, line_dedup._FAR), np.minimum(at, line_dedup._FAR), np.full(50, words))):
            assert (got == want.astype(np.uint64)).all()
        assert (back[5] == np.bitwise_xor.reduce(maps, axis=0)).all() and (back[8 : 8 + words] == own).all()


def test_line_dedup_takes_any_ids_and_columns(spark):
    text = "the first line of all of these\nanother line that is here as well"
    rows = [("b", text, 1, 2, 3, 4), ("a", text, 5, 6, 7, 8), (None, text, 9, 10, 11, 12), ("c", "x " * 30_000, 0, 0, 0, 0), ("c", "x " * 30_000, 0, 0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, _id long, id int, gone int, _tie int")
    out = {(r.doc_id, r._id): r for r in line_dedup.without_repeated_lines(docs).collect()}
    assert out["a", 5].text == text and out["a", 5].gone == 7 and out["b", 1].text == "" and out["b", 1]._tie == 4 and out[None, 9].text == ""
    assert out["c", 0].text == "x " * 30_000
    with pytest.raises(ValueError):
        line_dedup.without_repeated_lines(docs.withColumn("_lines", F.lit(1)))
    assert line_dedup.without_repeated_lines(docs.withColumn("_lines", F.lit(1)), counts=("a1", "a2")).columns == [*docs.columns, "_lines", "a1", "a2"]


def test_line_dedup_of_short_lines(spark):
    rows = [(1, "All rights reserved\n----\n\nHome"), (2, "all  rights, reserved!\n ----\n====\n\n home "), (3, "\u65e5\u672c\u8a9e\u306e\u884c\nall rights"), (4, "\u65e5\u672c\u8a9e\u306e\u884c\n\none two three four\n----"), (5, "one two three five"), (6, None), (7, " \n")]
    rows += [(100 + d, t) for d, t in edited_lines(12)[:20]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.id, r.line) for r in line_dedup.repeated_lines(docs).collect()}
    assert got == brute_all_lines(rows, 5, shortest=1) and {g for g in got if g[0] < 100} == {(2, 0), (2, 1), (2, 4), (4, 0), (4, 3)}
    again = {(r.id, r.line) for r in line_dedup.repeated_lines(docs, budget=3).filter("id < 100").collect()}
    assert again == {g for g in got if g[0] < 100}


def test_near_duplicates(spark, odd_docs, no_docs):
    rng = random.Random(6)
    words = [f"x{k}" for k in range(5000)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(300)]
        for c in range(4):
            own = list(base)
            for _ in range(c):
                own[rng.randrange(300)] = rng.choice(words)
            rows.append((g * 10 + c, " ".join(own)))
    rows += [(1000 + k, " ".join(rng.choice(words) for _ in range(50))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in near_dup.without_near_duplicates(docs).collect()}
    assert kept == {g * 10 for g in range(12)} | {1000 + k for k in range(40)}
    odd = near_dup.without_near_duplicates(odd_docs)
    assert odd.columns == odd_docs.columns and odd.filter("trim(coalesce(text, '')) = ''").count() == 1
    assert near_dup.without_near_duplicates(no_docs).count() == 0


def test_model_scores(unique_docs, odd_docs, no_docs):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 0
    got = {r.doc_id: r for r in pitman_yor.model_scores(unique_docs, held, min_context=2, hot_context=50).collect()}
    tokens = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in unique_docs.collect()}
    out = {d: zlib.crc32(str(d).encode()) % 4 == 0 for d in tokens}
    counts = Counter(w for d, ws in tokens.items() if not out[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for d, ws in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[d], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    assert pitman_yor.model_scores(odd_docs, held).count() == odd_docs.count()
    assert pitman_yor.model_scores(no_docs, held).count() == 0
    assert pitman_yor.model_scores(unique_docs, F.lit(True)).filter("train_tokens <> 0 or score is null").count() == 0


def test_rare_contexts_are_seated(spark):
    """A word that stands only after a context seen once scores above a word never seen."""
    rows = [(k, "one two three two one") for k in range(20)] + [(20, "qa qb"), (1000, "qa qb"), (1001, "qa zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in pitman_yor.model_scores(docs, F.col("doc_id") >= 1000).collect()}
    assert got[1000] > got[1001] + 0.01


def test_model_is_normalised(spark):
    """Over all one-word continuations of a context and the unknown word, probabilities sum to one."""
    rng = random.Random(8)
    words = [f"v{k}" for k in range(12)]
    train = [(k, " ".join(rng.choices(words, weights=range(12, 0, -1), k=30))) for k in range(60)]
    # Held-out texts "w x": the score of x after w is what is left of the pair beyond "w" and the end.
    for hot in (2_000_000, 20):
        held = [(1000 + k, x) for k, x in enumerate(["", *words, "never-seen"])]
        docs = spark.createDataFrame(train + held, "doc_id long, text string")
        ends = {r.doc_id: r.score for r in pitman_yor.model_scores(docs, F.col("doc_id") >= 1000, min_context=1, hot_context=hot).collect()}
        first = {x: ends[1000 + k] for k, x in enumerate(["", *words, "never-seen"])}
        pairs = [(5000 + k, f"{x} {y}") for k, (x, y) in enumerate((x, y) for x in words[:2] for y in [*words, "never-seen"])]
        both = {r.doc_id: r.score for r in pitman_yor.model_scores(spark.createDataFrame(train + held + pairs, "doc_id long, text string"), F.col("doc_id") >= 1000, min_context=1, hot_context=hot).collect()}
        # P(first = x, end) over x, summed with what longer texts would take, cannot exceed one.
        assert sum(10**s for s in first.values()) < 1 and all(both[1000 + k] == pytest.approx(first[x], rel=0.2) for k, x in enumerate(["", *words]))


def test_scores_do_not_hang_on_blocks_and_shards(unique_docs):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 0
    one, other = ({r.doc_id: r.score for r in pitman_yor.model_scores(unique_docs, held, blocks=b, shards=s).collect()} for b, s in ((2, 2), (7, 16)))
    assert one.keys() == other.keys() and all(math.isclose(one[k], other[k], rel_tol=1e-5) for k in one)


def test_scores_are_those_of_a_plain_sampler(spark):
    """The same seating in plain Python, one customer at a time; the sum over all next words is one."""
    from coppice.llm.bytescan import mix, span_hashes

    rng = random.Random(8)
    words = [f"v{k}" for k in range(9)]
    train = [(k, " ".join(rng.choices(words, weights=range(9, 0, -1), k=rng.randint(0, 12)))) for k in range(40)]
    held = [(1000, "v0 v1 v8"), (1001, "v3 zz v0"), (1002, "")]
    docs = spark.createDataFrame(train + held, "doc_id long, text string")
    got = {r.doc_id: r.score for r in pitman_yor.model_scores(docs, F.col("doc_id") >= 1000, strength=0.7, discount=0.5, parent_discount=0.4, burn_in=1, sweeps=2, seed=5).collect()}

    def hash_of(w):
        return pitman_yor.END if w == "<end>" else pitman_yor.BEGIN if w == "<begin>" else span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0]

    def chain(text):
        row = ["<begin>", *text.split(), "<end>"]
        return list(zip(row, row[1:]))

    pairs = Counter(p for _, t in train for p in chain(t))
    followers = Counter(w for _, w in pairs)
    types = len(followers)

    def seated(count, pull, d, key, salt):
        draw, tables = pitman_yor.drawn(np.array([key], np.uint64), salt), 1
        for n in range(1, count):
            tables += bool(draw(np.array([0]), n)[0] * (n - d * tables + pull) < pull)
        return tables

    mean = {w: sum(seated(c, (0.7 + 0.4 * types) / (types + 1), 0.4, hash_of(w), 5 + k) for k in range(2)) / 2 for w, c in followers.items()}
    customers, free = sum(followers.values()), 0.4 * sum(mean.values())
    parent = lambda w: ((followers[w] - 0.4 * mean[w] if w in followers else 0) + (0.7 + free) / (types + 1)) / (0.7 + customers)
    assert math.isclose(sum(map(parent, followers)) + parent("never"), 1, rel_tol=1e-9)
    tables, averaged = {p: 1 for p in pairs}, Counter()
    for k in range(3):
        total = Counter()
        for (u, _), t in tables.items():
            total[u] += t
        tables = {(u, w): seated(c, (0.7 + 0.5 * total[u]) * parent(w), 0.5, (int(hash_of(u)) & 0xFFFFFFFF) << 16 | int(hash_of(w)) >> 48, 1005 + k) for (u, w), c in pairs.items()}
        if k >= 1:
            averaged.update({p: t / 2 for p, t in tables.items()})
    size, given = Counter(), Counter()
    for (u, w), c in pairs.items():
        size[u] += c
        given[u] += 0.5 * averaged[u, w]

    def probability(u, w):
        if not size[u]:
            return parent(w)
        own = pairs[u, w] - 0.5 * averaged[u, w] if (u, w) in pairs else 0
        return (own + (0.7 + given[u]) * parent(w)) / (0.7 + size[u])

    for u in size:
        assert math.isclose(sum(probability(u, w) for w in [*followers, "never"]), 1, rel_tol=1e-9)
    for d, t in train + held:
        assert math.isclose(got[d], sum(math.log10(probability(*p)) for p in chain(t)), rel_tol=1e-5)


def test_parent_is_seated_on_the_tables_of_each_sweep(spark):
    """Contexts and parent in turn in plain Python; scores average the probabilities of each state, whatever the blocks and shards."""
    from coppice.llm.bytescan import span_hashes

    rng = random.Random(9)
    words = [f"v{k}" for k in range(9)]
    train = [(k, " ".join(rng.choices(words, weights=range(9, 0, -1), k=rng.randint(0, 12)))) for k in range(40)]
    held = [(1000, "v0 v1 v8"), (1001, "v3 zz v0"), (1002, "")]
    docs = spark.createDataFrame(train + held, "doc_id long, text string")
    runs = [{r.doc_id: r.score for r in pitman_yor.model_scores(docs, F.col("doc_id") >= 1000, strength=0.7, discount=0.5, parent_discount=0.4, burn_in=burn_in, sweeps=2, seed=5, blocks=b, shards=s, reseat=True).collect()} for b, s, burn_in in ((2, 3, 1), (3, 16, 1), (2, 3, 0))]

    def hash_of(w):
        return int(pitman_yor.END if w == "<end>" else pitman_yor.BEGIN if w == "<begin>" else span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0])

    def chain(text):
        row = ["<begin>", *text.split(), "<end>"]
        return list(zip(row, row[1:]))

    def seated(count, pull, d, key, salt):
        draw, tables = pitman_yor.drawn(np.array([key], np.uint64), salt), 1
        for n in range(1, count):
            tables += bool(draw(np.array([0]), n)[0] * (n - d * tables + pull) < pull)
        return tables

    pairs, size = Counter(p for _, t in train for p in chain(t)), Counter()
    for (u, _), c in pairs.items():
        size[u] += c
    known = {w for _, w in pairs}
    asked = {p for _, t in train + held for p in chain(t)} | {(u, w) for u in size for w in [*known, "never"]}

    def plain(burn_in, sweeps):
        tables, total, states = dict.fromkeys(pairs, 1), len(known), []
        for k in range(burn_in + sweeps + 1):
            customers, open_tables = Counter(), Counter()
            for (u, w), t in tables.items():
                customers[w] += t
                open_tables[u] += t
            seats = {w: seated(customers[w], (0.7 + 0.4 * total) / (len(known) + 1), 0.4, hash_of(w), 5 + k) for w in known}
            total = sum(seats.values())
            parent = {w: (customers[w] - 0.4 * seats.get(w, 0) + (0.7 + 0.4 * total) / (len(known) + 1)) / (0.7 + customers.total()) for w in {w for _, w in asked}}
            if k > burn_in:
                states.append({(u, w): (pairs[u, w] - 0.5 * tables.get((u, w), 0) + (0.7 + 0.5 * open_tables[u]) * parent[w]) / (0.7 + size[u]) if size[u] else parent[w] for u, w in asked})
            tables = {(u, w): seated(c, (0.7 + 0.5 * open_tables[u]) * parent[w], 0.5, (hash_of(u) & 0xFFFFFFFF) << 16 | hash_of(w) >> 48, 1005 + k) for (u, w), c in pairs.items()}
        return {p: sum(s[p] for s in states) / sweeps for p in asked}

    for got, burn_in in zip(runs, (1, 1, 0)):
        probability = plain(burn_in, 2)
        for u in size:
            assert math.isclose(sum(probability[u, w] for w in [*known, "never"]), 1, rel_tol=1e-9)
        for d, t in train + held:
            assert math.isclose(got[d], sum(math.log10(probability[p]) for p in chain(t)), rel_tol=1e-9)


def test_language_model_query_reseats_the_parent(spark, monkeypatch):
    """The query's scores are those of the sampler with the parent in its loop."""
    from coppice.llm import queries

    rng = random.Random(4)
    words = [f"v{k}" for k in range(30)]
    docs = spark.createDataFrame([(k, " ".join(rng.choices(words, weights=range(30, 0, -1), k=40))) for k in range(60)], "doc_id long, text string")
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0
    got, whole, once = ({r.doc_id: r.score for r in rows.collect()} for rows in (queries.op7_pitman_yor(spark, ""), pitman_yor.model_scores(docs, held, reseat=True), pitman_yor.model_scores(docs, held)))
    assert got == whole and got != once


def test_seating():
    counts = np.full(4000, 300)
    draw = pitman_yor.drawn(np.arange(4000, dtype=np.uint64), 1)
    for pull in (0.5, 8.0):
        quick = pitman_yor.seat(counts, np.full(4000, pull), 0.6, draw, exact=16).mean()
        slow = pitman_yor.seat(counts, np.full(4000, pull), 0.6, pitman_yor.drawn(np.arange(4000, dtype=np.uint64), 2), exact=300).mean()
        assert abs(quick - slow) / slow < 0.05
    assert pitman_yor.seat(np.array([0, 1, 2]), np.ones(3), 0.5, draw)[:2].tolist() == [0, 1]


def test_budgets_fill_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 100), ("b", "x", 1000)], "_l0 string, _l1 string, tokens long")
    budget = lambda b, w=None: {(r._l0, r._l1): r.budget for r in mixing.leaf_budgets(leaves, w, 2, b, 1).collect()}
    got = budget(120.0)
    assert got[("a", "x")] == pytest.approx(10) and got[("a", "y")] == pytest.approx(50) and got[("b", "x")] == pytest.approx(60)
    got = budget(400.0)
    assert got[("a", "y")] == pytest.approx(100) and got[("b", "x")] == pytest.approx(290)
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("a/x", 0.0)], "node string, weight double")
    got = budget(40.0, weights)
    assert got[("a", "x")] == 0 and got[("a", "y")] == pytest.approx(30) and got[("b", "x")] == pytest.approx(10)


def test_mixing_takes_seeded_prefixes(odd_docs, unique_docs, no_docs):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    rows = {r.doc_id: r for r in unique_docs.collect()}
    out = mixing.mixed(unique_docs, levels, None, 0.5, 2, 7).collect()
    fine = mixing.mixed(unique_docs, levels, None, 0.5, 2, 7, bucket_rows=1, broadcast_leaves=0).collect()
    assert {(r.doc_id, r._times) for r in out} == {(r.doc_id, r._times) for r in fine}
    total = sum(len((r.text or "").split()) for r in rows.values())
    taken = sum(r._tokens * r._times for r in out)
    assert 0 < taken <= total * 0.5 + 1
    assert all(r._tokens == len((r.text or "").encode().split()) for r in out)
    assert mixing.mixed(odd_docs, levels, None, 1.0, 1, 7).count() == odd_docs.count()
    assert mixing.mixed(no_docs, levels).count() == 0


def test_url_parts_rules_and_verdicts(spark):
    urls = ["http://A.Example.COM/en/7x?q=1", "https://com/en/5", "http://x.net/de/8", "http://example.net/de/80#a", "http://ncom/en/", "no scheme", None, "", "http://", "ftp://h?x=/a", "http://org/es", "http://y.org/es/ä"] + [f"http://h{k}.com/{'en' if k % 2 else 'fr'}/{k}?a={k}&b=1" for k in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("_entropy", F.lit("clash"))
    out = {r.page_id: r for r in url_filter.judged(pages, url_filter.RULES).collect()}
    parts = {k: (r._host, r._path, r._rule, r._verdict if r._rule else None) for k, r in out.items() if k < 12}
    assert parts == {
        0: ("a.example.com", "/en/7x", "example.com/en/7", "allow"),
        1: ("com", "/en/5", "com/en/", "block"),
        2: ("x.net", "/de/8", "net/de/", "allow"),
        3: ("example.net", "/de/80", "example.net/de/8", "block"),
        4: ("ncom", "/en/", None, None),
        5: ("", "", None, None),
        6: ("", "", None, None),
        7: ("", "", None, None),
        8: ("", "", None, None),
        9: ("h", "", None, None),
        10: ("org", "/es", None, None),
        11: ("y.org", "/es/ä", "org/es/", "block"),
    }
    assert all(r._verdict in ("allow", "block") for r in out.values()) and len(out) == len(urls)
    assert url_filter.judged(pages.limit(0), url_filter.RULES).count() == 0
    assert {r._verdict for r in url_filter.judged(pages.filter("page_id = 4"), url_filter.RULES).collect()} == {"allow"}


def test_boosted_trees_learn(spark):
    rows = [(float(k % 10), float(k % 7), int(k % 10 >= 6)) for k in range(400)]
    sample = spark.createDataFrame(rows, "a double, b double, label int")
    trees = url_filter.fit_trees(sample, ("a", "b"), rounds=3, depth=2, bins=10, rate=0.5)
    wrong = sample.filter((F.expr(" + ".join(trees)) > 0).cast("int") != F.col("label")).count()
    assert wrong == 0
