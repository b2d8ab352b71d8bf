"""Columns named as those that operators use inside, ids of any type, very long and repeated rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from coppice.llm import decontaminate, mixing, near_dup, queries, toxicity, url_filter
from coppice.llm.rows import fresh

CLASH = ["_id", "_tie", "_plain", "_lines", "_removed", "_score", "_words", "_spans", "_items", "_l0", "_l1", "_tokens", "_times", "_key", "_text", "_doc", "_whole", "_cutoff", "_order", "id", "tie", "hash", "fp", "bucket", "rest", "tokens"]


@pytest.fixture(scope="module")
def clashing(unique_docs):
    base = unique_docs.select("doc_id", "text", "lang", "source", "n_chars")
    return base.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def folder(spark, unique_docs, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    unique_docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic")).write.parquet(f"{at}/labels.parquet")
    unique_docs.limit(3).select(F.col("doc_id").alias("item_id"), "text").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_of_any_name(spark, clashing, folder, name):
    """A stage gives the rows that it gives without the extra columns, and these as they were."""
    stage = dict(corpus_pipeline.STAGES)[name]
    bare = clashing.select("doc_id", "text", "lang", "source", "n_chars")
    out, want = stage(spark, clashing, folder), stage(spark, bare, folder)
    assert out.columns[: len(clashing.columns)] == clashing.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert {k: (r.text, r.n_chars) for k, r in rows.items()} == {r.doc_id: (r.text, r.n_chars) for r in want.collect()}
    assert all(r[c] == f"{c}:{k}" for k, r in rows.items() for c in CLASH)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_repeated_rows_and_null_ids(spark, odd_docs, folder, name):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, folder).collect()
    assert 0 < len(out) <= docs.count()


def test_outputs_do_not_hide_columns(spark, clashing, folder):
    labels, bench = queries.table(spark, folder, "labels"), queries.table(spark, folder, "benchmark")
    with pytest.raises(ValueError):
        toxicity.toxicity_scores(clashing, labels)
    with pytest.raises(ValueError):
        decontaminate.contamination(clashing, bench)
    with pytest.raises(ValueError):
        mixing.mixed(clashing, queries.mix_levels())
    assert fresh(clashing, "_score", "_score", "new") == ["_score_", "_score__", "new"]


def test_near_duplicates_of_text_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [("b", text, 1), ("a", text + " more", 2), (None, text, 3), ("c", "another text of its own", 4), ("c", "another text of its own", 4)]
    out = near_dup.without_near_duplicates(spark.createDataFrame(rows, "doc_id string, text string, _id int"))
    assert sorted((r.doc_id, r._id) for r in out.collect()) == [("a", 2), ("c", 4)]


def test_url_filter_on_long_repeated_and_clashing_urls(spark):
    long_ = "http://a.example.com/en/" + "x" * 50_000
    rows = [(1, long_, "u"), (2, long_, "v"), (3, None, "w"), (4, "no scheme", "x"), (5, "http://example.net/de/8", "y"), (6, "http://q.org/es/", "z"), (7, "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, _found string").withColumn("_suffix", F.lit(1)).withColumn("_rate", F.lit(2))
    got = {r.page_id: r for r in url_filter.judged(pages, url_filter.RULES).collect()}
    assert len(got) == 7 and got[1]._verdict == got[2]._verdict == "block" and got[5]._rule == "example.net/de/8" and got[2]._found == "v" and got[3]._host == ""
    with pytest.raises(ValueError):
        url_filter.judged(pages.withColumn("_host", F.lit(1)), url_filter.RULES)


def test_suffix_rates_by_broadcast_and_join_are_one(spark, monkeypatch):
    rows = [(k, f"http://h{k % 7}.example.{'com' if k % 3 else 'net'}/{'en' if k % 2 else 'de'}/{k}?a=1&b={k}") for k in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    one = {r.page_id: (r._verdict, round(r._score, 9)) for r in url_filter.judged(pages, url_filter.RULES).collect()}
    monkeypatch.setattr(url_filter, "small", lambda *_: False)
    assert {r.page_id: (r._verdict, round(r._score, 9)) for r in url_filter.judged(pages, url_filter.RULES).collect()} == one


def test_parts_of_a_benchmark_are_bounded_and_give_one_result(spark):
    items = [(str(k), " ".join(f"i{k}w{j}" for j in range(30))) for k in range(40)]
    docs = spark.createDataFrame([(k, f"before {items[k][1]} and {items[(k * 7) % 40][1]} after") for k in range(40)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    whole, parts = ({r.doc_id: (r._words, r._spans, r._items) for r in decontaminate.contamination(docs, bench, item_bytes=b).collect()} for b in (1 << 20, 3_000))
    assert whole == parts and all(len(v[2]) in (1, 2) for v in whole.values())


def test_trees_are_those_of_a_plain_fit(spark):
    """Boosting in plain Python, row by row, on the same cuts gives the same scores."""
    rng = random.Random(4)
    rows = [(int(a + b / 2 + rng.gauss(0, 1) > 3), float(a), float(b)) for a, b in ((rng.randint(0, 5), rng.randint(0, 3)) for _ in range(300))]
    sample = spark.createDataFrame(rows, "label int, fa double, fb double").cache()
    features, rounds, depth, bins, rate = ("fa", "fb"), 3, 2, 4, 0.5
    sql = url_filter.fit_trees(sample, features, rounds, depth, bins, rate)
    got = {(r.fa, r.fb): r.m for r in sample.select("fa", "fb", F.expr(" + ".join(sql)).alias("m")).collect()}
    cuts = {f: sorted(set(sample.approxQuantile(f, [k / bins for k in range(1, bins)], 0.005))) for f in features}
    margin = [0.0] * len(rows)

    def grow(members, g, h, level, step):
        total = sum(g[i] for i in members), sum(h[i] for i in members)
        value = lambda s: s[0] ** 2 / (s[1] + 1)
        best = (1e-6, "", 0.0)
        for at, f in enumerate(features, 1):
            for c in cuts[f]:
                low = [i for i in members if rows[i][at] <= c]
                left = sum(g[i] for i in low), sum(h[i] for i in low)
                right = total[0] - left[0], total[1] - left[1]
                if left[1] >= 1 and right[1] >= 1:
                    best = max(best, (round(value(left) + value(right) - value(total), 9), f, c))
        if level == depth or not best[1]:
            for i in members:
                step[i] = rate * total[0] / (total[1] + 1)
            return
        at = 1 + features.index(best[1])
        grow([i for i in members if rows[i][at] <= best[2]], g, h, level + 1, step)
        grow([i for i in members if rows[i][at] > best[2]], g, h, level + 1, step)

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        step = [0.0] * len(rows)
        grow(range(len(rows)), [r[0] - q for r, q in zip(rows, p)], [q * (1 - q) for q in p], 0, step)
        margin = [m + s for m, s in zip(margin, step)]
    assert len(got) == len({r[1:] for r in rows}) and all(math.isclose(got[r[1:]], m, abs_tol=1e-6) for r, m in zip(rows, margin))


def test_scores_are_those_of_the_words_weights(spark):
    """A score is the logistic function of the intercept and the weights of the n-grams that a text has, each once."""
    docs = spark.createDataFrame([(0, None), (1, ""), (2, "abc abc"), (3, "xyz " * 5_000)], "doc_id long, text string")
    buckets = np.arange(0, 1 << toxicity.BITS, 97)
    weights = np.sin(np.arange(len(buckets)))
    got = {r.doc_id: r._score for r in toxicity.scored(docs, (buckets, weights, -0.25)).collect()}
    table = dict(zip(buckets.tolist(), weights.tolist()))
    for r in docs.collect():
        seen = {int(b) for _, found in toxicity.presence(pa.array([r.text or ""])) for b in found}
        assert math.isclose(got[r.doc_id], 1 / (1 + math.exp(0.25 - sum(table.get(b, 0.0) for b in seen))), rel_tol=1e-9)
