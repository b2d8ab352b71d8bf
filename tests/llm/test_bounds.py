"""Long words, many copies, hot keys and repeated labels stay within bounds and give whole results."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from coppice.llm import hamming, line_dedup, mixing, near_dup, simhash, substring, verified
from coppice.llm.components import components
from tests.llm.test_corpus import brute_substring


def test_many_copies_and_a_hot_passage(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, "the very same text " * 8) for k in range(300)] + [(1000 + k, f"own{k} " * 3 + passage + f" tail{k}" * 25) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(docs).collect()}
    assert got == brute_substring(rows, 20) and got[5][1] == 32 and got[1005][1] >= 60
    classes = {r.doc_id: r.component_id for r in simhash.simhash_classes(docs).collect()}
    assert all(classes[k] == 0 for k in range(300))


def test_groups_over_the_limit_are_dealt_anew(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 4)
    prints = np.unique(np.concatenate([base, *[b ^ (1 << rng.integers(0, 62, 200)) ^ (1 << rng.integers(0, 62, 200)) for b in base]]))
    rows = spark.createDataFrame([(int(x), int(x)) for x in prints], "fp long, id long")
    want = {(r.node, r.component) for r in components(hamming.hamming_links(rows, 4, simhash.BLOCKS)).collect()}
    assert len({c for _, c in want}) == 4
    for limit in (20, 100):
        links = hamming.hamming_links(rows, 4, simhash.BLOCKS, group_limit=limit)
        assert {(r.node, r.component) for r in components(links).collect()} == want
        near = links.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 4)
        assert near.isEmpty()


def test_ids_of_one_fingerprint_are_linked_without_pairs(spark):
    rows = spark.createDataFrame([(7, k) for k in range(500)], "fp long, id long")
    for limit in (32_000, 100):
        links = hamming.hamming_links(rows, 3, line_dedup.WIDTHS, group_limit=limit)
        assert links.count() <= 4 * 500 * (1 if limit > 500 else 20) and components(links).select("component").distinct().count() == 1


def test_failed_links_lose_no_other_link(spark):
    """a-b fails, but a-c and c-b hold: all three are one group, and d, near but different, is not."""
    texts = {1: b"aaaa", 2: b"bbbb", 3: b"aabb", 4: b"zzzz"}
    rows = spark.createDataFrame([(0, 1), (1, 2), (3, 3), (2, 4)], "fp long, id long")
    table = spark.createDataFrame([(k, bytearray(v)) for k, v in texts.items()], "id long, t binary")
    near = lambda a, b: sum(x == y for x, y in zip(a, b)) >= 2
    for few in (1_000_000, 0):
        out = verified.verified_components(rows, 3, line_dedup.WIDTHS, lambda ids, _: table.join(ids, "id", "left_semi"), near, few=few)
        assert {r.node for r in out.collect()} == {1, 2, 3} and out.select("component").distinct().count() == 1


def test_block_comparison_equals_the_trie():
    rng = np.random.default_rng(5)
    for n, spread in ((400, 3), (2000, 500), (900, 1)):
        keys = rng.integers(0, 1 << 63, 40, dtype=np.uint64)[rng.integers(0, 40, n)] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        g, k = np.unique(np.stack([rng.integers(0, spread, n).astype(np.uint64), keys]), axis=1)
        a, b = hamming.trie_components(g, k, 3)[0], hamming.block_components(g, k, 3)[0]
        assert (a == b).all() and (hamming.block_components(g, k, 3, largest=100)[0] == a).all()


def test_simhash_of_very_long_lines():
    words = np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64)
    heads = np.array([0, 3, 10, 1000, 1001])
    got = line_dedup.simhashes(words, heads)
    for k, (a, b) in enumerate(zip(heads, [*heads[1:], 5000])):
        assert int(got[k]) == sum(1 << bit for bit in range(64) if 2 * int(((words[a:b] >> np.uint64(bit)) & np.uint64(1)).sum()) > b - a)


def test_slices_keep_rows_whole():
    from coppice.llm.bytescan import slices, text_buffers

    _, offsets = text_buffers(pa.array(["a" * 10, "", "b" * 300, None, "c"]))
    parts = list(slices(offsets, 100))
    assert [i for i, _ in parts] == [0, 2, 3] and parts[-1][1] == 5 and all(j == k for (_, j), (k, _) in zip(parts, parts[1:]))


class _Counting:
    """numpy that counts the pairs of which the shift is tested."""

    pairs = 0

    def __getattr__(self, name):
        return getattr(np, name)

    def abs(self, x):
        self.pairs += len(x)
        return np.abs(x)


def test_lines_of_a_run_meet_near_their_place_alone(monkeypatch):
    rng = np.random.default_rng(5)
    k = 2500
    n = rng.integers(40, 50, k).astype(np.uint64)
    marks = np.zeros((12, k), np.uint64)
    marks[0], marks[1], marks[2], marks[3], marks[4] = 7, np.arange(k), n, rng.integers(0, 40, k), 1
    marks[5] = rng.integers(0, 1 << 63, k, dtype=np.uint64)
    marks[6] = marks[8] = marks[5]
    monkeypatch.setattr(line_dedup, "np", counting := _Counting())
    a, b = line_dedup._links(marks, 0.8)
    monkeypatch.undo()
    assert counting.pairs < k * k // 2  # two counts a pair: less than half of all
    x, y = np.triu_indices(k, 1)
    size, at, fold = marks[2].astype(np.int64), marks[3].astype(np.int64), marks[5]
    limit, gap = line_dedup._allowed(np.maximum(size[x], size[y]), 0.8), np.abs(size[x] - size[y])
    near = (np.abs(at[x] - at[y]) + np.abs(size[x] - at[x] - size[y] + at[y]) <= limit) & (np.bitwise_count(fold[x] ^ fold[y]) <= 2 * limit - gap)
    want, _ = hamming._settle(np.arange(k), x[near], y[near])
    got, _ = hamming._settle(np.arange(k), a.astype(np.int64), b.astype(np.int64))
    assert (got == want).all() and 1 < len(set(want.tolist())) < k


def test_bags_rule_out_long_lines_that_sketches_admit(monkeypatch):
    rng = np.random.default_rng(6)
    lines = [rng.integers(0, 1 << 62, 400).astype(np.uint64) for _ in range(40)]
    lines += [np.where(rng.random(400) < share, rng.integers(0, 1 << 62, 400).astype(np.uint64), lines[k]) for k, share in enumerate(np.linspace(0, 0.3, 40))]
    words, n = np.concatenate(lines), np.full(80, 400)
    heads = np.cumsum(n) - n
    x, y = np.triu_indices(80, 1)
    want = np.array([line_dedup.edit_within(lines[a].tolist(), lines[b].tolist(), 80) if b == a + 40 else False for a, b in zip(x, y)])
    tried, banded = [], line_dedup._banded
    monkeypatch.setattr(line_dedup, "_banded", lambda w, h, m, a, b, limit, band: (tried.append(len(a)), banded(w, h, m, a, b, limit, band))[1])
    assert (line_dedup.edits_within(words, heads, n, x, y, 0.8) == want).all() and 10 < want.sum() < 40
    assert sum(tried) < 200  # of 3,160 pairs, in bands that widen


def test_near_prints_are_compared_in_groups_without_a_trie(spark, monkeypatch):
    seen, links = [], verified.hamming_links
    monkeypatch.setattr(verified, "hamming_links", lambda *a, **how: (seen.append(how.get("trie", True)), links(*a, **how))[1])
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:58], "x"])), (3, "quite another text")], "doc_id long, text string")
    assert {r.doc_id for r in near_dup.without_near_duplicates(docs).collect()} == {1, 3} and seen == [False]
    rng = np.random.default_rng(8)
    held = np.repeat(np.arange(4), 150)
    prints = rng.integers(0, 1 << 24, 600).astype(np.uint64)
    ids = np.arange(600)
    trie, pairs = (hamming._settle(ids.copy(), *hamming._forest(held, prints, ids, 4, trie=trie))[0] for trie in (True, False))
    assert (trie == pairs).all() and 4 < len(set(trie.tolist())) < 600


def test_mixing_counts_the_tokens_of_a_text_twice_at_most(spark, monkeypatch):
    made, kept = [], mixing.cut
    monkeypatch.setattr(mixing, "cut", lambda df: (made.append(df._jdf.queryExecution().optimizedPlan().toString()), kept(df))[1])
    docs = spark.createDataFrame([(k, "a b c " * (k % 7 + 1)) for k in range(50)], "doc_id long, text string")
    out = mixing.mixed(docs, {"one": F.lit("x")}, None, 0.5, 1, 1)
    made.append(out._jdf.queryExecution().optimizedPlan().toString())
    assert sum("regexp_count" in plan or "regexp_extract_all" in plan for plan in made) == 2
    assert 0.4 * 200 < out.agg(F.sum("_tokens")).head()[0] <= 0.5 * 600


def test_large_groups_of_near_prints_are_not_held_pair_by_pair():
    rng = np.random.default_rng(9)
    prints = np.unique(np.concatenate([rng.integers(0, 1 << 62), *[(1 << rng.integers(0, 62, 3000)) ^ (1 << rng.integers(0, 62, 3000)) ^ (1 << rng.integers(0, 62, 3000))]], axis=None).astype(np.uint64))
    other = rng.integers(0, 1 << 62, 500).astype(np.uint64)
    keys = np.concatenate([prints, other, prints[:50]])
    groups = np.repeat([0, 1], [len(prints) + len(other), 50])
    order = np.lexsort((keys, groups))
    groups, keys = groups[order], keys[order]
    tracemalloc.start()
    labels, a, b = hamming.block_components(groups, keys, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    assert (labels == hamming.trie_components(groups, keys, 6)[0]).all()
    assert len(a) == len(keys) - len(set(labels.tolist())) and (np.bitwise_count(keys[a] ^ keys[b]) <= 6).all()


def _messages(rng, k, runs, size=400):
    """Messages of marks of lines that share runs, each mark told twice."""
    run, line = rng.integers(0, runs, k).astype(np.uint64), np.arange(k, dtype=np.uint64) << np.uint64(16)
    n = rng.integers(20, 40, k).astype(np.uint64)
    at, maps = (rng.random(k) * n).astype(np.uint64), rng.integers(0, 1 << 63, (1, k), dtype=np.uint64) & rng.integers(0, 1 << 63, (1, k), dtype=np.uint64)
    maps &= rng.integers(0, 1 << 63, (1, k), dtype=np.uint64)
    told = [line_dedup._packed(run[i : i + size], line[i : i + size], n[i : i + size], at[i : i + size], maps[:, i : i + size]) for i in range(0, k, size)] * 2
    m = len(told)
    return pa.record_batch([pa.array([1] * m, pa.int32()), *(pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64())), pa.array(told, pa.binary())], names=line_dedup._SCANNED)


def test_marks_over_the_limit_of_a_task_are_linked_as_others():
    """A shard of more marks than are linked at once gives the parts of one that is linked whole, not one area."""
    batch = _messages(np.random.default_rng(3), 6000, 400)

    def parts(some):
        links = pa.Table.from_batches(line_dedup._match(0.8, pa.int64(), some=some)(iter([batch])))
        a, b = (links.column(c).to_numpy() for c in ("a", "b"))
        return hamming._settle(np.arange(6000), a, b)[0]

    want = parts(1 << 21)
    assert 10 < len(set(want.tolist())) < 6000 and all((parts(some) == want).all() for some in (5000, 700))


def test_marks_and_sketches_are_bounded_in_memory():
    batch = _messages(np.random.default_rng(4), 500_000, 50_000, 20_000)
    batches = [batch.slice(i, 1) for i in range(batch.num_rows)]
    tracemalloc.start()
    for _ in line_dedup._match(0.8, pa.int64())(iter(batches)):
        pass
    marks = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    line_dedup._sketches(np.arange(300_000, dtype=np.uint64), np.repeat(np.arange(60_000), 5), 60_000)
    sketches = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert marks < 250 << 20 and sketches < 40 << 20
