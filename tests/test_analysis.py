"""Vocabulary, graphs, mining, naming and segments against brute force."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from coppice.functions import naming as N
from coppice.functions import segments as S
from coppice.operators import algebra as A
from coppice.operators import graphs as G
from coppice.operators import mining as M
from coppice.operators import vocabulary as V
from coppice.operators.stars import connected


def brute_features(words, window):
    n, unique = len(words), len(set(words))
    mattr = unique / n if n < window else sum(len(set(words[i : i + window])) for i in range(n - window + 1)) / window / (n - window + 1)
    counts = Counter(words)
    return mattr, -sum(c / n * math.log2(c / n) for c in counts.values()), mattr * (n - unique) / n, sum(c == 1 for c in counts.values()) / unique


def test_vocabulary_features(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.choice([1, 5, 9, 10, 11, 60])))) for k in range(40)]
    out = V.features(V.tokens(spark.createDataFrame(rows, "id int, text string"), "id", "text"), "id", 10).collect()
    texts = dict(rows)
    for r in out:
        assert [r.mattr, r.entropy, r.mattr_repeat, r.hapax] == pytest.approx(brute_features(texts[r.id].split(), 10), abs=1e-9)
    assert len(out) == 40


def modularity(parts, edges):
    total = sum(w for _, _, w in edges)
    of = {v: k for k, p in enumerate(parts) for v in p}
    degree = Counter()
    for u, v, w in edges:
        degree[u] += w
        degree[v] += w
    return sum(sum(w for u, v, w in edges if of[u] == of[v] == k) / total - (sum(degree[v] for v in p) / 2 / total) ** 2 for k, p in enumerate(parts))


def test_communities():
    two = [(a, b, 5.0) for t in ((1, 2, 3), (4, 5, 6)) for a, b in itertools.combinations(t, 2)] + [(3, 4, 1.0)]
    for _ in range(20):
        random.shuffle(two)
        assert G.greedy_communities(range(1, 8), two) == [[1, 2, 3], [4, 5, 6], [7]]
    assert G.greedy_communities([1, 2], []) == [[1], [2]] and G.greedy_communities([1, 2], [(1, 1, 3.0), (1, 2, 0.0)]) == [[1], [2]]


def test_exact_gain_never_lowers_modularity():
    rng = random.Random(2)
    for _ in range(60):
        edges = [(u, v, 1.0) for u, v in itertools.combinations(range(12), 2) if rng.random() < (0.7 if u % 3 == v % 3 else 0.1)]
        if not edges:
            continue
        found = G.greedy_communities(range(12), edges, exact_gain=True)
        q = modularity(found, edges)
        assert q >= modularity([[v] for v in range(12)], edges) - 1e-12
        for a, b in itertools.combinations(range(len(found)), 2):
            merged = [p for k, p in enumerate(found) if k not in (a, b)] + [found[a] + found[b]]
            assert modularity(merged, edges) <= q + 1e-9


def test_graph_measures(spark):
    edges = [("a", "b", 2.0), ("b", "a", 1.0), ("c", "d", 3.0), ("b", "c", 1.0), ("a", "a", 9.0), ("a", "d", 0.0)]
    pairs = G.undirected(spark.createDataFrame(edges, "src string, dst string, w double"))
    parts = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 1)], "vertex string, community int")
    plain = [("a", "b", 3.0), ("c", "d", 3.0), ("b", "c", 1.0)]
    assert G.modularity(pairs, parts).first().q == pytest.approx(modularity([["a", "b"], ["c", "d"]], plain))
    assert G.cut_ratio(pairs, parts).first().cut == pytest.approx(1 / 7)
    whole = parts.withColumn("community", F.lit(0))
    assert G.modularity(pairs, whole).first().q == pytest.approx(0) and G.cut_ratio(pairs, whole).first().cut == 0
    found = G.communities(pairs.withColumn("graph_id", F.lit(1))).collect()
    assert {r.vertex: r.community for r in found} == {"a": 0, "b": 0, "c": 1, "d": 1}


def test_reachability(spark):
    arcs = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src int, dst int")
    roots, nodes = spark.createDataFrame([(1,)], "node int"), spark.createDataFrame([(k,) for k in range(1, 7)], "node int")
    assert {r.node for r in G.reachable(roots, arcs).collect()} == {1, 2, 3}
    assert {r.node for r in G.dead(nodes, roots, arcs).collect()} == {4, 5, 6}
    assert G.dead(nodes, roots, arcs, dynamic=3).count() == 0
    calls = spark.createDataFrame([("x", "f", 1), ("x", "f", 3), ("x", "g", 0)], "caller string, name string, arity int")
    defs = spark.createDataFrame([("f2", "f", 1, 2), ("g0", "g", 0, 0)], "id string, name string, min_arity int, arity int")
    assert {(r.src, r.dst) for r in G.resolve_calls(calls, defs).collect()} == {("x", "f2"), ("x", "g0")}


def test_connected(spark):
    out = connected(spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7)], "a long, b long")).collect()
    assert {r.node: r.component for r in out} == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8, 7: 7}


def test_proximity_weights(spark):
    rows = [(1, 0, ["a", "b"], [0]), (1, 1, ["c"], [0, 0]), (1, 2, ["d"], [0, 1]), (1, 3, ["a"], [0, 1, 0])]
    sites = spark.createDataFrame(rows, "tree_id int, site_id int, tokens array<string>, path array<int>")
    got = {(r.a, r.b): r.weight for r in M.tree_pair_weights(sites).collect()}
    assert got[("a", "b")] == 1.0 + 0.25 and got[("c", "d")] == 0.5 and got[("a", "c")] == 0.5 + 0.125 and got[("a", "d")] == 0.5 + 0.5


def test_outlier_gates(spark):
    sets = [["flex", "pb3"]] * 40 + [["flex", "pb2"]] + [["grid", "mt1"]] * 40 + [["grid", "ml2"]] + [["flex", "pb4"]] * 3
    sites = spark.createDataFrame([(sorted(s),) for s in sets], "tokens array<string>")
    swaps = M.outlier_swaps(M.set_clusters(sites), M.pair_weights(sites)).collect()
    assert [(r.bad, r.good, r.support) for r in swaps] == [("pb2", "pb3", 40)]
    tied = spark.createDataFrame([(sorted(s),) for s in [["flex", "pb3"]] * 40 + [["flex", "pb1"]] * 40 + [["flex", "pb2"]]], "tokens array<string>")
    assert M.outlier_swaps(M.set_clusters(tied), M.pair_weights(tied)).count() == 0


def test_envy_declines_ties(spark):
    uses = spark.createDataFrame([("f", "A"), ("f", "A"), ("f", "B"), ("g", "A"), ("g", "B"), ("h", "C")], "owner string, target string")
    assert {r.owner: (r.target, r.decline) for r in M.envy(uses, "owner", "target").collect()} == {"f": ("A", None), "g": (None, "tie"), "h": (None, "too_few")}


def test_empty_and_null_semantics(spark):
    none = spark.createDataFrame([], "k string, v int")
    assert A.sum_by(none, F.col("v"), "s").first().s == 0 and A.find_first(none, F.col("v") > 0, [F.col("v")]).count() == 0
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("b", 3, None)], "k string, v int, t string")
    assert {r.k: dict(r.m) for r in A.pairs_to_map(rows, ["k"], "k", "v", ["v"], "m").withColumnRenamed("k", "k").collect()} == {"a": {"a": 2}, "b": {"b": 3}}
    wrapped = rows.select(A.wrap(F.col("t")).alias("w"), A.boolean(F.col("t") == "x").alias("b"), A.safe_number(F.col("t")).alias("n")).collect()
    assert [(r.w, r.b, r.n) for r in wrapped] == [([], False, None), (["x"], True, None), ([], False, None)]
    assert rows.select(A.lookup(F.col("k"), {"a": "one"}, "other").alias("x")).distinct().count() == 2


@pytest.mark.parametrize(("short", "parts", "score"), [("cs", ["changeset"], 100), ("oz", ["organization"], 100), ("ast", ["asset"], 0), ("mngr", ["manager"], 100), ("bc", ["build", "changeset"], 100), ("bc", ["build", "changeset", "now"], 80), ("xyz", ["build"], 0)])
def test_latch_scores(short, parts, score):
    assert N.latch_score(short, parts) == score


def test_names():
    assert N.latch("cs", ["build", "changeset"]) == (1, 1) and N.latch("bc", ["build", "changeset"]) == (0, 2) and N.latch("", ["a"]) is None
    assert N.latch_score("cs", ["changeset"], strong=False) == 0
    assert N.resolve("bc", [("build_changeset", True), ("big_cat", True)]) is None and N.resolve("bc", [("build_changeset", True), ("other", True)]) == "build_changeset"
    assert [N.pluralize(w) for w in ("box", "city", "day", "person", "user")] == ["boxes", "cities", "days", "people", "users"]
    assert [N.singularize(w) for w in ("boxes", "cities", "days", "children", "people", "data", "users", "classes", "class", "is")] == ["box", "city", "day", "children", "people", "data", "user", "class", "class", "is"]
    assert [N.past_participle(w) for w in ("parse", "apply", "render")] == ["parsed", "applied", "rendered"]
    assert N.words("My.Mod.is_valid_user") == ["is", "valid", "user"] and N.same_family("pb3", "pb2") and not N.same_family("pb3", "mt2")
    import re

    assert re.match(N.glob_regex("lib/**/*.{ex,exs}"), "lib/a/b/c.exs") and re.match(N.glob_regex("lib/**/*.ex"), "lib/c.ex") and not re.match(N.glob_regex("lib/*.ex"), "lib/a/c.ex")
    assert N.common_module(["A.B.C", "A.B.D"]) == "A.B" and N.unclashed("x", {"x", "x_2"}) == "x_3" and N.constant_name("Max Size!") == "max_size" and N.constant_name("42") is None


def test_segments():
    block = [S.Segment(frozenset(r), frozenset(w), k) for r, w, k in (("x", "a", "1"), ("a", "b", "2"), ("y", "c", "3"), ("c", "d", "4"), ("bd", "e", "5"), ("e", "f", "6"))]
    assert S.live_out(block, 2) == {"b"} and S.carriers(block) == set("abcde")
    assert S.cuts(block) == [2, 4] and S.cuts(block[:4]) == []
    assert S.canonical_order([S.Segment(frozenset(), frozenset("b"), "z"), S.Segment(frozenset(), frozenset("a"), "y"), S.Segment(frozenset("ab"), frozenset(), "a")]) == [1, 0, 2]
    two = {"p": [S.Segment(frozenset(), frozenset(), h, 6) for h in "abcd"], "q": [S.Segment(frozenset(), frozenset(), h, 6) for h in "xabc"]}
    assert S.repeated_windows(two) == [("p", 0, 3), ("q", 1, 4)]


def test_mining_queries_over_whole_tables(spark, tmp_path):
    from coppice.plans.mining import literal_groups_all, surface_pairs_users

    rng = random.Random(13)
    uses = [(rng.randrange(60), rng.randrange(9)) for _ in range(150)]
    spark.createDataFrame([(u, f'{{"k": {f}}}') for u, f in uses], "user_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    own = {u: {f for v, f in uses if v == u} for u, _ in uses}
    want = {(a, b): (len(own[a] & own[b]), len(own[a] & own[b]) / len(own[a] | own[b])) for a in own for b in own if a < b and own[a] & own[b]}
    got = {(r.a, r.b): (r.shared, r.jaccard) for r in surface_pairs_users(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) < 0.00501 for p in want)
    items = [(rng.choice("ANR"), float(rng.randint(1, 30)), rng.choice("OOOF"), rng.randint(0, 10) / 100, rng.randint(0, 8) / 100) for _ in range(150)]
    spark.createDataFrame(items, "l_returnflag string, l_quantity double, l_linestatus string, l_discount double, l_tax double").write.parquet(str(tmp_path / "lineitem.parquet"))
    groups = {}
    for flag, quantity, status, *_ in items:
        groups.setdefault((flag, int(quantity)), []).append(status)
    why = lambda k, v: "too_few" if len(v) < 2 else "ambiguous" if len(set(v)) > 1 else "unnameable" if k[1] < 10 else None
    want = {(*k, len(v), len(set(v)), why(k, v)) for k, v in groups.items()}
    assert {(r.l_returnflag, r.literal, r.n, r.contexts, r.decline) for r in literal_groups_all(spark, str(tmp_path)).collect()} == want


def test_surface_pairs_make_no_row_for_a_shared_function(spark):
    """Owners of many blocks, names in any type, functions over several tables, nulls."""
    rng = random.Random(17)
    rows = [(rng.choice(["a", "B", "é", "ß", None, *"cdefgh"]), rng.choice([None, *range(40)])) for _ in range(200)] + [(f"w{k % 5}", k) for k in range(5000)] + [("w0", k) for k in range(2500)]
    own = {}
    for o, f in rows:
        own.setdefault(o, set()).add(f)
    own.pop(None)
    some = {(a, b): own[a] & own[b] - {None} for a in own for b in own if a.encode() < b.encode()}
    for least in (1, 3):
        want = {p: (len(s), len(s) / len(own[p[0]] | {(p[1], f) if f is None else f for f in own[p[1]]})) for p, s in some.items() if len(s) >= least}
        for block in (512, 3):
            out = M.surface_pairs(spark.createDataFrame(rows, "o string, f int"), "o", "f", least, block)
            got = {(r.a, r.b): (r.shared, r.jaccard) for r in out.collect()}
            assert got.keys() == want.keys() and all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) < 0.00501 for p in want)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_features_of_texts_are_those_of_their_streams(spark):
    """Whole texts give what token rows give, also for keys that repeat, null keys and texts without tokens; tokens are not shuffled."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["ab", "Cd", "É", "İx", "e1f", "Kelvin", *"ghij"]) for _ in range(n))
    rows = [(k, text(rng.choice([1, 4, 9, 10, 11, 80]))) for k in range(30)] + [(3, text(40)), (4, None), (31, None), (32, "1 2"), (33, "")]
    docs = spark.createDataFrame(rows, "id int, text string")
    got, want = ({r.id: r for r in out.collect()} for out in (V.text_features(docs, "id", "text", 10), V.features(V.tokens(docs, "id", "text"), "id", 10)))
    assert got.keys() == want.keys() and len(got) >= 29
    for k, r in want.items():
        assert list(got[k])[:3] == list(r)[:3] and list(got[k])[3:] == pytest.approx(list(r)[3:], abs=1e-12)
    lone = V.text_features(spark.createDataFrame([(None, "a b a")], "id int, text string"), "id", "text", 10).collect()
    assert [(r.id, r.n, r.unique) for r in lone] == [(None, 3, 2)]


def test_vocabulary_queries_keep_texts_where_they_are(spark, tmp_path):
    from coppice.plans import vocabulary as Q

    words = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    rng = random.Random(6)
    spark.createDataFrame([(k, " ".join(rng.choices(words, k=3000))) for k in range(8)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    status = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: status.executorList(False).apply(0).totalShuffleWrite()
    for name in ("vocab_features", "vocab_probability", "linear_score"):
        before = written()
        assert len(getattr(Q, name)(spark, str(tmp_path)).collect()) == 8 and written() - before < 20_000
