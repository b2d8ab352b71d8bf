"""Queries over weighted graphs and reachability."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from coppice.operators import graphs as G
from coppice.plans.registry import registry
from coppice.sources.tables import table

QUERIES, ORACLES, query = registry()

_STEPS = """
    s AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events),
    e AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, count(*)::DOUBLE AS w FROM s WHERE b IS NOT NULL AND a <> b GROUP BY ALL)"""


def _steps(spark, d):
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    steps = table(spark, d, "events").select(F.col("user_id"), F.col("event_type").alias("src"), after.alias("dst"), F.lit(1.0).alias("w")).filter("dst is not null")
    return G.undirected(steps)


def _given(spark, d):
    """A stated partition: event types by the length of their names."""
    return table(spark, d, "events").select(F.col("event_type").alias("vertex"), (F.length("event_type") % 2).cast("long").alias("community")).distinct()


@query(f"WITH {_STEPS} SELECT src, dst, w FROM e")
def graph_edges(spark, d):
    return _steps(spark, d)


@query(
    f"""WITH {_STEPS}, m AS (SELECT sum(w) AS m FROM e),
    c AS (SELECT len(src) % 2 AS c, w, CASE WHEN len(src) % 2 = len(dst) % 2 THEN w ELSE 0 END AS i FROM e UNION ALL SELECT len(dst) % 2, w, 0 FROM e)
    SELECT round(sum(i / m - pow(g / (2 * m), 2)), 9) AS q FROM (SELECT c, sum(w) AS g, sum(i) AS i FROM c GROUP BY 1), m"""
)
def graph_modularity(spark, d):
    return G.modularity(_steps(spark, d), _given(spark, d)).select(F.round("q", 9).alias("q"))


@query(f"WITH {_STEPS} SELECT round(sum(CASE WHEN len(src) % 2 = len(dst) % 2 THEN 0 ELSE w END) / sum(w), 9) AS cut FROM e")
def graph_cut(spark, d):
    return G.cut_ratio(_steps(spark, d), _given(spark, d)).select(F.round("cut", 9).alias("cut"))


@query()
def graph_communities(spark, d):
    """Communities of nations by the trade between them, one graph for each order status."""
    trade = (
        table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
        .join(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")
        .join(table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("src")), "s_suppkey")
        .join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("dst")), "o_custkey")
        .select(F.col("o_orderstatus").alias("graph_id"), "src", "dst", F.lit(1.0).alias("w"))
    )
    return G.communities(G.undirected(trade, by=("graph_id",)))


def _arcs(spark, d):
    """A directed acyclic graph: supplier n leads to suppliers 2n and 3n + 1."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"))
    arcs = s.select("src", F.explode(F.array(F.col("src") * 2, F.col("src") * 3 + 1)).alias("dst")).filter("dst > src")
    return arcs.join(s.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")


_REACH = """
    RECURSIVE a AS (SELECT s_suppkey AS src, s_suppkey * 2 AS dst FROM supplier UNION SELECT s_suppkey, s_suppkey * 3 + 1 FROM supplier),
    k AS (SELECT src, dst FROM a JOIN supplier ON s_suppkey = dst WHERE dst > src),
    r AS (SELECT CAST(3 AS BIGINT) AS node UNION SELECT k.dst FROM r JOIN k ON k.src = r.node)"""


@query(f"WITH {_REACH} SELECT node FROM r")
def graph_reachable(spark, d):
    return G.reachable(spark.createDataFrame([(3,)], "node long"), _arcs(spark, d))


@query(f"WITH {_REACH} SELECT s_suppkey AS node FROM supplier WHERE s_suppkey NOT IN (SELECT node FROM r)")
def graph_dead(spark, d):
    return G.dead(table(spark, d, "supplier").select(F.col("s_suppkey").alias("node")), spark.createDataFrame([(3,)], "node long"), _arcs(spark, d))
