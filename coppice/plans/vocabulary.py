"""Queries over vocabularies, prototypes and linear scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from coppice.operators import vocabulary as V
from coppice.plans.registry import registry
from coppice.sources.tables import table

QUERIES, ORACLES, query = registry()

_FEATURES_SQL = """
    t AS (SELECT doc_id, unnest(w) AS token, unnest(range(0, len(w))) AS pos, len(w) AS n FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)),
    f AS (SELECT *, greatest(least(pos, n - 100) - greatest(coalesce(lag(pos) OVER (PARTITION BY doc_id, token ORDER BY pos), -1) + 1, pos - 99, 0) + 1, 0) AS fresh FROM t),
    c AS (SELECT doc_id, n, token, count(*) AS c, sum(fresh) AS fresh FROM f GROUP BY ALL),
    s AS (SELECT doc_id, n, count(*) AS u, sum(fresh)::DOUBLE AS fresh, count(*) FILTER (WHERE c = 1) AS once, 0.0::DOUBLE - sum((c::DOUBLE / n) * log2(c::DOUBLE / n)) AS entropy FROM c GROUP BY ALL),
    m AS (SELECT *, CASE WHEN n < 100 THEN u::DOUBLE / n ELSE fresh / (100.0::DOUBLE * (n - 99)) END AS mattr FROM s)"""


@query(
    f"""WITH {_FEATURES_SQL}
    SELECT doc_id, n AS n_tokens, u AS n_unique, round(mattr, 6) AS mattr, round(entropy, 6) AS entropy, round(mattr * (n - u) / n, 6) AS mattr_repeat, round(once::DOUBLE / u, 6) AS hapax FROM m"""
)
def vocab_features(spark, d):
    out = V.text_features(table(spark, d, "documents"), "doc_id", "text")
    return out.select("doc_id", F.col("n").alias("n_tokens"), F.col("unique").alias("n_unique"), *[F.round(c, 6).alias(c) for c in V.FEATURES])


@query(
    f"""WITH {_FEATURES_SQL},
    z AS (SELECT doc_id, 0.486314::DOUBLE + (mattr - 0.420263::DOUBLE) / 0.078555::DOUBLE * 0.431562::DOUBLE + (entropy - 5.899142::DOUBLE) / 0.769656::DOUBLE * 0.345762::DOUBLE + (mattr * (n - u) / n - 0.30891::DOUBLE) / 0.060406::DOUBLE * 0.480687::DOUBLE + (once::DOUBLE / u - 0.275787::DOUBLE) / 0.094452::DOUBLE * 0.098488::DOUBLE AS z FROM m)
    SELECT doc_id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(least(z, 30.0::DOUBLE), -30.0::DOUBLE))), 6) AS probability FROM z"""
)
def vocab_probability(spark, d):
    out = V.text_features(table(spark, d, "documents"), "doc_id", "text")
    return out.select("doc_id", F.round(V.probability(), 6).alias("probability"))


def _prototypes(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    spread = vectors.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    means = spread.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("prototype"))
    return vectors.select("vec_id", "vector"), means


_NEAREST_SQL = """
    x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings),
    p AS (SELECT label, i, avg(x) AS x FROM x GROUP BY ALL),
    pn AS (SELECT label, sqrt(sum(x * x)) + 1e-9 AS n FROM p GROUP BY 1), xn AS (SELECT vec_id, sqrt(sum(x * x)) + 1e-9 AS n FROM x GROUP BY 1),
    d AS (SELECT x.vec_id, p.label, sum(x.x * p.x) AS dot FROM x JOIN p USING (i) GROUP BY ALL),
    s AS (SELECT d.vec_id, d.label, dot / (pn.n * xn.n) AS s FROM d JOIN pn ON d.label = pn.label JOIN xn ON d.vec_id = xn.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS k, lead(s) OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS next FROM s)"""


@query(f"WITH {_NEAREST_SQL} SELECT vec_id, label AS nearest, round(s, 4) AS similarity FROM r WHERE k = 1")
def proto_nearest(spark, d):
    vectors, means = _prototypes(spark, d)
    return V.nearest(vectors, means, 0.3, 0.05).select("vec_id", "nearest", F.round("similarity", 4).alias("similarity"))


@query(f"WITH {_NEAREST_SQL} SELECT vec_id, CASE WHEN s >= 0.3 AND s - next >= 0.05 THEN label::VARCHAR ELSE 'unknown' END AS verdict FROM r WHERE k = 1")
def proto_gate(spark, d):
    vectors, means = _prototypes(spark, d)
    return V.nearest(vectors, means, 0.3, 0.05).select("vec_id", "verdict")


#: A fixed small model for the linear-score query.
_LINEAR = {"plain": ([4.0, -0.3], 1.0), "rich": ([-4.0, 0.6], 0.0), "none": ([0.0, 0.0], 0.5)}


@query(
    f"""WITH {_FEATURES_SQL},
    r AS (SELECT doc_id, 1.0::DOUBLE + mattr * 4.0::DOUBLE + entropy * (-0.3)::DOUBLE AS a, mattr * (-4.0)::DOUBLE + entropy * 0.6::DOUBLE AS b, 0.5::DOUBLE AS c FROM m),
    e AS (SELECT doc_id, exp(a - greatest(a, b, c)) AS a, exp(b - greatest(a, b, c)) AS b, exp(c - greatest(a, b, c)) AS c FROM r)
    SELECT doc_id, round(greatest(a, b, c) / (a + b + c), 6) AS p, CASE WHEN greatest(a, b, c) / (a + b + c) < 0.5 OR c >= greatest(a, b) THEN NULL WHEN a > b THEN 'plain' ELSE 'rich' END AS label FROM e"""
)
def linear_score(spark, d):
    out = V.text_features(table(spark, d, "documents"), "doc_id", "text").withColumn("best", V.linear(["mattr", "entropy"], _LINEAR, 0.5))
    return out.select("doc_id", F.round("best.p", 6).alias("p"), "best.label")
