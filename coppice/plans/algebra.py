"""Queries of the collection and conditional algebra, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.operators import algebra as A
from coppice.plans.registry import registry
from coppice.sources.tables import table

QUERIES, ORACLES, query = registry()


@query("SELECT count(*) FILTER (WHERE l_quantity > 25) AS n FROM lineitem")
def alg_filter_count(spark: SparkSession, d: str) -> DataFrame:
    return A.count_where(table(spark, d, "lineitem"), F.col("l_quantity") > 25)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 400000 ORDER BY o_orderkey LIMIT 1")
def alg_filter_first(spark, d):
    return A.find_first(table(spark, d, "orders"), F.col("o_totalprice") > 400000, [F.col("o_orderkey")]).select("o_orderkey", "o_custkey")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_name = 'NATION_7' LIMIT 1")
def alg_keyfind(spark, d):
    return A.key_find(table(spark, d, "nation"), "n_name", "NATION_7")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS found FROM nation")
def alg_map_get(spark, d):
    nation = table(spark, d, "nation")
    even = F.map_from_entries(F.collect_list(F.when(F.col("n_nationkey") % 2 == 0, F.struct("n_nationkey", "n_name"))))
    names = nation.agg(even.alias("names"))
    return nation.crossJoin(F.broadcast(names)).select("n_nationkey", F.try_element_at("names", F.col("n_nationkey")).alias("found"))


@query("SELECT l_returnflag, CAST(coalesce(sum(CAST(l_quantity AS DECIMAL(18,0)) * CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS DECIMAL(38,2)) AS total FROM lineitem GROUP BY 1")
def alg_sum_by(spark, d):
    value = F.col("l_quantity").cast("decimal(18,0)") * F.col("l_extendedprice").cast("decimal(18,2)")
    return A.sum_by(table(spark, d, "lineitem"), value, "total", ["l_returnflag"]).withColumn("total", F.col("total").cast("decimal(38,2)"))


@query("SELECT CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS total FROM lineitem WHERE l_quantity < 0")
def alg_reduce_sum(spark, d):
    return A.sum_by(table(spark, d, "lineitem").filter("l_quantity < 0"), F.col("l_linenumber"), "total").withColumn("total", F.col("total").cast("long"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def alg_frequencies(spark, d):
    return A.frequencies(table(spark, d, "orders"), "o_orderstatus")


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def alg_group_lists(spark, d):
    return A.grouped_lists(table(spark, d, "nation"), "n_regionkey", "n_name", "names").withColumn("names", F.array_join("names", ","))


@query("SELECT n_regionkey, CAST(product(n_nationkey + 1) AS BIGINT) AS p FROM nation GROUP BY 1")
def alg_product_by(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.product(F.col("n_nationkey") + 1).cast("long").alias("p"))


@query("SELECT l_linestatus, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1")
def alg_multi_agg(spark, d):
    return A.fused(table(spark, d, "lineitem"), {"n": F.count(F.lit(1)), "low": F.min("l_quantity"), "high": F.max("l_quantity"), "total": F.sum(F.col("l_quantity").cast("long")), "flags": F.countDistinct("l_returnflag")}, ["l_linestatus"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def alg_top_k(spark, d):
    return A.top_k(table(spark, d, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 10).select("o_orderkey", "o_totalprice")


@query("SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
def alg_min_max(spark, d):
    return A.fused(table(spark, d, "orders"), {"low": F.min("o_totalprice"), "high": F.max("o_totalprice")})


@query("SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3")
def alg_top_k_per_group(spark, d):
    top = A.top_k_per_group(table(spark, d, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)
    return top.select("o_orderpriority", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey")
def alg_sort_desc(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')")
def alg_member_in(spark, d):
    return A.members(table(spark, d, "customer"), "c_mktsegment", ["MACHINERY", "BUILDING"]).select("c_custkey", "c_mktsegment")


@query("SELECT event_id, nullif(event_type, 'error') AS kind FROM events WHERE nullif(event_type, 'error') IS NOT NULL")
def alg_reject_null(spark, d):
    kind = table(spark, d, "events").select("event_id", F.nullif(F.col("event_type"), F.lit("error")).alias("kind"))
    return A.without_nulls(kind, "kind")


@query("SELECT o_custkey, o_orderstatus AS k, max_by(o_orderkey, o_orderkey) AS v FROM orders GROUP BY 1, 2")
def alg_map_build(spark, d):
    maps = A.pairs_to_map(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus", "o_orderkey", ["o_orderkey"], "m")
    return maps.select("o_custkey", F.explode("m").alias("k", "v"))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def alg_set_build(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("types")).select("p_brand", F.explode("types").alias("p_type"))


@query("SELECT n_regionkey, string_agg(lower(n_name), ';' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def alg_array_map(spark, d):
    lists = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("a"))
    return lists.select("n_regionkey", F.array_join(F.transform("a", lambda x: F.lower(x["n_name"])), ";").alias("names"))


@query("SELECT p_partkey, k, v FROM (SELECT p_partkey, unnest(['brand', 'type']) AS k, unnest([p_brand, p_type]) AS v FROM part)")
def alg_map_literal(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type")).alias("k", "v"))


@query("SELECT r_name, string_agg(upper(n_name), '-' ORDER BY n_nationkey) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def alg_join_strings(spark, d):
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return A.joined(both, ["r_name"], F.upper("n_name"), "-", "n_nationkey", "names")


@query("SELECT o_orderkey, array_to_string(list_concat(list_reverse(string_split(o_orderpriority, '-')), [o_orderstatus]), '|') AS parts FROM orders")
def alg_concat_reverse(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.array_join(A.reverse_concat(F.split("o_orderpriority", "-"), F.array("o_orderstatus")), "|").alias("parts"))


@query("SELECT o_orderkey, string_split(o_orderpriority, '-')[1] AS first FROM orders")
def alg_last_of_reverse(spark, d):
    return table(spark, d, "orders").select("o_orderkey", A.last_of_reverse(F.split("o_orderpriority", "-")).alias("first"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END::BIGINT AS n FROM events")
def alg_wrap(spark, d):
    return table(spark, d, "events").select("event_id", F.size(A.wrap(F.nullif(F.col("event_type"), F.lit("error")))).cast("long").alias("n"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def alg_is_empty(spark, d):
    return A.is_empty(table(spark, d, "customer"), table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@query("SELECT user_id, bool_or(event_type = 'purchase') AS \"any\" FROM events GROUP BY 1")
def alg_any(spark, d):
    return A.any_where(table(spark, d, "events"), F.col("event_type") == "purchase", ["user_id"])


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents")
def alg_char_length(spark, d):
    return table(spark, d, "documents").select("doc_id", F.char_length("text").cast("long").alias("n"))


@query("SELECT i FROM range(3, 21) t(i)")
def alg_range(spark, d):
    return A.integers(spark, 3, 20)


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'other' END AS word FROM orders")
def alg_case_lookup(spark, d):
    return table(spark, d, "orders").select("o_orderkey", A.lookup(F.col("o_orderstatus"), {"O": "open", "F": "filled"}, "other").alias("word"))


@query("SELECT event_id, CASE WHEN value < 10 THEN 'low' WHEN value < 100 THEN 'mid' ELSE 'high' END AS band FROM events")
def alg_case_chain(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", A.cases([(v < 10, F.lit("low")), (v < 100, F.lit("mid"))], F.lit("high")).alias("band"))


@query("SELECT o_orderkey, coalesce(o_orderstatus = 'F', false) AS done FROM orders")
def alg_bool_if(spark, d):
    return table(spark, d, "orders").select("o_orderkey", A.boolean(F.col("o_orderstatus") == "F").alias("done"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def alg_safe_get(spark, d):
    return table(spark, d, "events").select("event_id", A.safe_number(F.get_json_object("props", "$.k")).alias("k"))


@query("SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS sec FROM events")
def alg_trunc_ts(spark, d):
    return table(spark, d, "events").select("event_id", F.unix_timestamp(F.date_trunc("second", "ts")).alias("sec"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_extendedprice > (SELECT max(l_extendedprice) / 2 FROM lineitem) GROUP BY 1")
def alg_invariant(spark, d):
    items = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    half = items.agg((F.max("l_extendedprice") / 2).alias("half"))
    return A.frequencies(A.above_invariant(items, "l_extendedprice", half), "l_returnflag")


@query("SELECT l_orderkey AS k, CAST(l_quantity AS BIGINT) * 2 AS q FROM lineitem WHERE l_discount = 0 AND l_quantity > 40")
def alg_filter_map(spark, d):
    return A.filtered_map(table(spark, d, "lineitem"), (F.col("l_discount") == 0) & (F.col("l_quantity") > 40), k=F.col("l_orderkey"), q=F.col("l_quantity").cast("long") * 2)


@query("SELECT doc_id, lang FROM documents WHERE lang = 'de'")
def alg_flat_map_filter(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return docs.select("doc_id", F.explode(F.when(F.col("lang") == "de", F.array("lang")).otherwise(F.array().cast("array<string>"))).alias("lang"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def alg_identity(spark, d):
    nation = table(spark, d, "nation")
    return nation.select(*[F.col(c).alias(c) for c in nation.columns])


@query("SELECT o_orderkey, (len(string_split(o_orderpriority, ' ')) >= 2) AS two FROM orders")
def alg_length_guard(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.size(F.split("o_orderpriority", " ")) >= 2).alias("two"))


@query(
    """
    SELECT a.doc_id, (SELECT coalesce(min(i) - 1, least(len(a.w), len(b.w))) FROM range(1, least(len(a.w), len(b.w)) + 1) t(i) WHERE a.w[i] <> b.w[i]) AS prefix
    FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents) a
    JOIN (SELECT doc_id - 1 AS doc_id, string_split(text, ' ') AS w FROM documents) b USING (doc_id)"""
)
def common_prefix(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("w"))
    both = words.join(words.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v")), "doc_id")
    return A.common_prefix(both, "w", "v").select("doc_id", "prefix")


@query(
    """
    SELECT a.doc_id, (SELECT coalesce(min(i) - 1, least(len(a.w), len(b.w))) FROM range(1, least(len(a.w), len(b.w)) + 1) t(i) WHERE a.w[i] <> b.w[i]) AS suffix
    FROM (SELECT doc_id, list_reverse(string_split(text, ' ')) AS w FROM documents) a
    JOIN (SELECT doc_id - 1 AS doc_id, list_reverse(string_split(text, ' ')) AS w FROM documents) b USING (doc_id)"""
)
def common_suffix(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.reverse(F.split("text", " ")).alias("w"))
    both = words.join(words.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v")), "doc_id")
    return A.common_prefix(both, "w", "v", "suffix").select("doc_id", "suffix")


@query(
    """
    SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS length
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS island FROM events)
    GROUP BY user_id, event_type, island"""
)
def layout_runs(spark, d):
    return A.runs(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def liveness_unused(spark, d):
    return A.unused(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT o_custkey AS c_custkey, count(*) AS uses FROM orders GROUP BY 1 HAVING count(*) = 1")
def single_use(spark, d):
    return A.single_use(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
