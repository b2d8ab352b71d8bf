"""A corpus of text files as a table, and its sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.functions.naming import glob_regex


def corpus(spark: SparkSession, folder: str, include: Sequence[str] = ("**",), exclude: Sequence[str] = ()) -> DataFrame:
    """path (below ``folder``) and source of the files whose path fits a glob; one row a file.

    Spark lists and reads the files, so any store that it can read will do.
    """
    full = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).withColumn("_file", F.input_file_name())
    root = folder.rstrip("/").split("://")[-1].lstrip("/")
    below = F.regexp_replace(F.url_decode(F.replace(F.col("_file"), F.lit("+"), F.lit("%2B"))), "^.*?" + _quoted(root) + "/+", "")
    rows = full.select(below.alias("path"), F.col("value").alias("source"))
    return rows.filter(fits(F.col("path"), include)).filter(~fits(F.col("path"), exclude))


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def fits(path: Column, globs: Sequence[str]) -> Column:
    """Whether a path fits any of the globs."""
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g))
    return out


def pairs(spark: SparkSession, sources: Sequence[tuple[str, str | None]]) -> DataFrame:
    """The same table from (path, source) pairs."""
    return spark.createDataFrame(list(sources), "path string, source string")


def write(df: DataFrame, folder: str, form: str = "parquet", by: Sequence[str] = ()) -> None:
    """Writes a result; ``by`` names the columns that become folders."""
    writer = df.write.format(form).mode("overwrite")
    (writer.partitionBy(*by) if by else writer).save(folder)
