"""Queries of set mining: baskets, outliers, surfaces, shapes, trains, literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from coppice.operators import mining as M
from coppice.plans.registry import registry
from coppice.sources.tables import table

QUERIES, ORACLES, query = registry()

_BASKETS = "b AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey), s AS (SELECT l_orderkey, list_sort(list(p_brand)) AS t FROM b GROUP BY 1)"


def _baskets(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return M.sites(items, ["l_orderkey"], "p_brand")


@query(f"WITH {_BASKETS} SELECT array_to_string(t, ',') AS brands, count(*) AS support FROM s WHERE len(t) >= 2 GROUP BY 1")
def basket_sets(spark, d):
    return M.set_clusters(_baskets(spark, d)).select(F.array_join("tokens", ",").alias("brands"), "support")


@query(f"WITH {_BASKETS} SELECT x.p_brand AS a, y.p_brand AS b, count(*)::DOUBLE AS weight FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.p_brand < y.p_brand GROUP BY ALL")
def basket_cooccurrence(spark, d):
    return M.pair_weights(_baskets(spark, d))


@query(
    f"""WITH {_BASKETS}, c AS (SELECT t, count(*) AS n FROM s WHERE len(t) = 2 GROUP BY 1),
    w AS (SELECT x.p_brand AS a, y.p_brand AS b, count(*)::DOUBLE AS w FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.p_brand <> y.p_brand GROUP BY ALL),
    k AS (SELECT o.t AS set, list_filter(o.t, lambda x: NOT list_contains(v.t, x))[1] AS bad, list_filter(v.t, lambda x: NOT list_contains(o.t, x))[1] AS good, list_filter(o.t, lambda x: list_contains(v.t, x))[1] AS other, v.n AS n
          FROM c o JOIN c v ON v.n >= 4 AND v.n >= 2 * o.n AND len(list_filter(o.t, lambda x: list_contains(v.t, x))) = 1),
    g AS (SELECT k.*, coalesce(wg.w, 0) AS gw, coalesce(wb.w, 0) AS bw FROM k LEFT JOIN w wg ON wg.a = good AND wg.b = other LEFT JOIN w wb ON wb.a = bad AND wb.b = other),
    r AS (SELECT *, max(n) OVER (PARTITION BY set) AS top FROM g WHERE gw > bw), q AS (SELECT *, count(*) OVER (PARTITION BY set) AS ties FROM r WHERE n = top)
    SELECT array_to_string(set, ',') AS brands, bad, good, n AS support FROM q WHERE ties = 1"""
)
def basket_outliers(spark, d):
    baskets = _baskets(spark, d)
    clusters = M.set_clusters(baskets).filter("size(tokens) = 2")
    swaps = M.outlier_swaps(clusters, M.pair_weights(baskets), min_support=4, dominance=2, family=False)
    return swaps.select(F.array_join("set", ",").alias("brands"), "bad", "good", "support")


@query(
    """WITH u AS (SELECT s_suppkey, n_regionkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
    t AS (SELECT s_suppkey, n, count(*) AS ties, min(n_regionkey) AS target FROM (SELECT *, max(n) OVER (PARTITION BY s_suppkey) AS top FROM u) WHERE n = top GROUP BY ALL)
    SELECT s_suppkey, CASE WHEN ties = 1 AND n >= 2 THEN target END AS target, n, CASE WHEN ties > 1 THEN 'tie' WHEN n < 2 THEN 'too_few' END AS decline FROM t"""
)
def envy_target(spark, d):
    uses = (
        table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("s_suppkey")).join(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey")
        .join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
        .join(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
    )
    return M.envy(uses, "s_suppkey", "n_regionkey")


@query(
    """WITH u AS (SELECT DISTINCT user_id % 20 AS user_id, json_extract_string(props, '$.k') AS f FROM events), z AS (SELECT user_id, count(*) AS n FROM u GROUP BY 1)
    SELECT x.user_id AS a, y.user_id AS b, count(*) AS shared, round(count(*)::DOUBLE / (any_value(zx.n) + any_value(zy.n) - count(*)), 2) AS jaccard
    FROM u x JOIN u y ON x.f = y.f AND x.user_id < y.user_id JOIN z zx ON zx.user_id = x.user_id JOIN z zy ON zy.user_id = y.user_id GROUP BY ALL"""
)
def surface_pairs(spark, d):
    surfaces = table(spark, d, "events").select((F.col("user_id") % 20).alias("user_id"), F.get_json_object("props", "$.k").alias("f"))
    return M.surface_pairs(surfaces, "user_id", "f")


@query()
def surface_pairs_users(spark, d):
    """All pairs of users that share a value, not folded into few owners."""
    surfaces = table(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").alias("f"))
    return M.surface_pairs(surfaces, "user_id", "f")


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS owners FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2")
def family_seed(spark, d):
    return M.families(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("SELECT p_brand, p_size, count(*) AS n, min(p_type) AS stem FROM part GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT p_type) = 1")
def shape_positions(spark, d):
    return M.shape_positions(table(spark, d, "part"), ["p_brand", "p_size"], "p_type")


@query(
    """WITH c AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS p FROM events GROUP BY user_id, event_id // 20)
    SELECT array_to_string(p, ',') AS params, count(DISTINCT user_id) AS callees, count(DISTINCT user_id) * 10 + len(p) AS score FROM c WHERE len(p) >= 3 GROUP BY p HAVING count(DISTINCT user_id) >= 2"""
)
def param_trains(spark, d):
    calls = table(spark, d, "events").groupBy("user_id", F.floor(F.col("event_id") / 20).alias("g")).agg(F.array_sort(F.collect_set("event_type")).alias("params"))
    return M.parameter_trains(calls, "user_id", "params").select(F.array_join("params", ",").alias("params"), "callees", "score")


@query("SELECT user_id, count(*) AS calls, min(event_type) AS argument FROM events WHERE value > 100 GROUP BY 1 HAVING count(DISTINCT event_type) = 1 AND count(*) >= 2")
def push_constant_arg(spark, d):
    return M.constant_arguments(table(spark, d, "events").filter("value > 100"), ["user_id"], "event_type")


@query("SELECT user_id, count(DISTINCT event_type) AS kinds FROM events WHERE value > 60 GROUP BY 1 HAVING count(DISTINCT event_type) BETWEEN 2 AND 4")
def flag_arg(spark, d):
    return M.flag_arguments(table(spark, d, "events").filter("value > 60"), ["user_id"], "event_type")


@query(
    """SELECT *, CASE WHEN n < 2 THEN 'too_few' WHEN contexts > 1 THEN 'ambiguous' WHEN literal < 10 THEN 'unnameable' END AS decline
    FROM (SELECT l_returnflag, CAST(l_quantity AS BIGINT) AS literal, count(*) AS n, count(DISTINCT l_linestatus) AS contexts FROM lineitem WHERE l_discount = 0.1 AND l_tax = 0.08 GROUP BY ALL)"""
)
def literal_groups(spark, d):
    items = table(spark, d, "lineitem").filter("l_discount = 0.1D and l_tax = 0.08D").select("l_returnflag", F.col("l_quantity").cast("long").alias("literal"), "l_linestatus")
    return M.literal_groups(items, ["l_returnflag"], "literal", "l_linestatus", F.col("literal") >= 10)


@query()
def literal_groups_all(spark, d):
    """Repeated literals of all line items, whatever their discount and tax."""
    items = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("literal"), "l_linestatus")
    return M.literal_groups(items, ["l_returnflag"], "literal", "l_linestatus", F.col("literal") >= 10)
