"""Queries that run detectors and the rewriting engine over the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import coppice.operators.detectors  # noqa: F401  registers its rules
import coppice.operators.source_rules  # noqa: F401
from coppice.plans import engine
from coppice.plans.registry import registry
from coppice.sources.markup import nodes
from coppice.sources.tables import table

QUERIES, ORACLES, query = registry()


def relations(spark: SparkSession, d: str) -> engine.Relations:
    """The code relations as the tables give them: documents as functions of a source, events as calls, pages as markup."""
    docs, events = table(spark, d, "documents"), table(spark, d, "events")
    words = F.size(F.split("text", " "))
    clauses = docs.select(
        F.col("source").alias("path"), F.col("doc_id").cast("int").alias("line"), F.col("source").alias("module"), F.concat("lang", F.lit("_to_"), "source").alias("name"), (words % 3).alias("arity"),
        F.md5("text").alias("body_hash"), F.md5(F.regexp_replace("text", "[A-Z][a-z]*", "X")).alias("skeleton_hash"), words.alias("mass"), (F.col("doc_id") % 3 > 0).alias("public"), F.lit(1).alias("n_clauses"), F.lit(1).alias("lines"),
        F.regexp_extract_all("text", F.lit("[A-Z][a-z]*"), F.lit(0)).alias("literals"),
    )
    k = F.get_json_object("props", "$.k")
    calls = events.select(F.col("user_id").cast("string").alias("path"), F.col("event_id").cast("int").alias("line"), F.lit("events").alias("module"), F.concat(F.lit("u"), (F.col("user_id") % 40)).alias("caller"), F.concat(F.lit("u"), F.col("user_id") % 7).alias("callee"), F.lit(0).alias("pos"), F.col("event_type").alias("arg"), F.lit(True).alias("literal"), F.lit(False).alias("dynamic"))
    literals = events.select(F.col("user_id").cast("string").alias("path"), F.col("event_id").cast("int").alias("line"), F.col("user_id").cast("string").alias("module"), F.lit("number").alias("kind"), k.alias("value"), F.col("event_type").alias("context"))
    elements = nodes(table(spark, d, "pages")).withColumn("path", F.col("tree_id").cast("string"))
    return {"clauses": clauses, "calls": calls, "literals": literals, "elements": elements}


@query(
    """
    WITH c AS (SELECT source, lang || '_to_' || source AS name, len(string_split(text, ' ')) AS mass, len(string_split(text, ' ')) % 3 AS arity, md5(text) AS h FROM documents WHERE doc_id % 3 > 0),
    g AS (SELECT arity, h, name, count(*) AS n, count(DISTINCT source) AS modules, min(mass) AS mass FROM c GROUP BY ALL HAVING count(*) > 1)
    SELECT n, CASE WHEN mass < 20 THEN 'too_small' WHEN modules < 2 THEN 'one_module' END AS decline, count(*) AS groups FROM g GROUP BY ALL"""
)
def rule_exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    found = engine.detected(relations(spark, d), engine.chosen(only=["DelegateExactDuplicates"]))
    return found.groupBy(found["evidence"]["n"].cast("long").alias("n"), "decline").agg(F.count(F.lit(1)).alias("groups"))


@query(
    """
    WITH l AS (SELECT user_id, json_extract_string(props, '$.k') AS v, event_type FROM events),
    g AS (SELECT user_id, v, count(*) AS n, count(DISTINCT event_type) AS contexts FROM l GROUP BY ALL)
    SELECT user_id::VARCHAR AS module, v AS value, n, CASE WHEN n < 2 THEN 'too_few' WHEN contexts > 1 THEN 'ambiguous' WHEN v IN ('0', '1', '-1', '2') THEN 'unnameable' END AS decline FROM g"""
)
def rule_magic_number(spark, d):
    found = engine.detected(relations(spark, d), engine.chosen(only=["ExtractMagicNumber"]))
    return found.select(found["scope"]["module"].alias("module"), found["evidence"]["value"].alias("value"), found["evidence"]["n"].cast("long").alias("n"), "decline")


@query()
def findings_all(spark, d):
    """All detectors whose relations the tables give, those that are off by default included."""
    return engine.detected(relations(spark, d), [r for r in engine.rules() if r.detect])


@query()
def rules_rewrite(spark, d):
    """The markup rules run to their fixpoint over all pages."""
    chosen = engine.chosen(only=["UnwrapSpanInHeading", "CollapseRedundantHeexNesting"])
    return engine.rewritten(table(spark, d, "pages"), chosen, key="page_id", text="html").select("page_id", F.sha2("html", 256).alias("html_sha256"), "changed", "converged", F.array_join("applied", ",").alias("applied"))
