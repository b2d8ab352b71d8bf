"""The opN_<name> queries: each applies one operator to its whole table.

The operators keep their own general interfaces; these thin queries derive the columns
that the contract fixes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm import decontaminate, line_dedup, media, mixing, pitman_yor, simhash, sql, substring, token_count, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The mixing query's tree: domain (by the source's number), language, source; unnamed nodes weigh 1.
MIX_WEIGHTS = [("d0", 4.0), ("d1", 2.0), ("d0/en", 3.0), ("d1/de", 0.5), ("d2/fr/src2", 5.0), ("d3/es", 0.0)]
MIX_BUDGET, MIX_EPOCHS, MIX_SEED = 0.6, 2, 42


def mix_levels() -> dict[str, F.Column]:
    number = F.regexp_extract("source", "([0-9]+)", 1)
    domain = F.concat(F.lit("d"), F.when(number == "", F.lit("x")).otherwise((F.expr("try_cast(regexp_extract(source, '([0-9]+)', 1) AS bigint)") % 4).cast("string")))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def mix_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MIX_WEIGHTS, "node string, weight double")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(table(spark, sf_dir, "documents"), mix_levels(), mix_weights(spark), MIX_BUDGET, MIX_EPOCHS, MIX_SEED)
    return out.select("doc_id", F.concat_ws("/", "_l0", "_l1", "_l2").alias("leaf"), F.col("_tokens").alias("n_tokens"), F.col("_times").cast("long").alias("times"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = toxicity.crc_remainder("doc_id", 3)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels"), learn=rest != 1)
    return out.select("doc_id", (rest == 1).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.7).cast("int").alias("predicted"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(table(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.store_texts(table(spark, sf_dir, "documents")))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.without_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.model_scores(table(spark, sf_dir, "documents"), toxicity.crc_remainder("doc_id", 10) == 0, reseat=True)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judged(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.RULES)
    return out.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": op1_mixing,
        "op2_toxicity": op2_toxicity,
        "op3_simhash": op3_simhash,
        "op4_media": op4_media,
        "op5_substring": op5_substring,
        "op6_line_dedup": op6_line_dedup,
        "op7_pitman_yor": op7_pitman_yor,
        "op8_decontaminate": op8_decontaminate,
        "op9_url_filter": op9_url_filter,
        "op10_token_count": op10_token_count,
    }


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express as a whole; the tests hold the others against brute force."""
    return {"op1_mixing": sql.mixing(MIX_WEIGHTS, MIX_BUDGET, MIX_EPOCHS, MIX_SEED), "op5_substring": sql.substring(20), "op8_decontaminate": sql.decontamination(10)}
