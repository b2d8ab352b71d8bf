"""The findings relation: what detectors report, accepted and declined rows alike."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "rule string, kind string, path string, line int, range struct<start:int,stop:int>, scope struct<module:string,function:string,arity:int>, evidence map<string,string>, confidence double, accepted boolean, decline string, description string"


def first_decline(gates: Sequence[tuple[Column, str]]) -> Column:
    """The reason of the first gate that holds, in order; null where none does (so: accepted)."""
    out = F.lit(None).cast("string")
    for holds, reason in reversed(gates):
        out = F.when(F.coalesce(holds, F.lit(False)), F.lit(reason)).otherwise(out)
    return out


def findings(
    rows: DataFrame,
    rule: str,
    kind: str,
    decline: Column | None = None,
    evidence: dict[str, Column] | None = None,
    path: str | None = "path",
    line: str | None = "line",
    span: tuple[str, str] | None = None,
    module: str | None = None,
    function: str | None = None,
    arity: str | None = None,
    confidence: Column | None = None,
    description: Column | None = None,
) -> DataFrame:
    """Rows of a detector in the findings schema; a row is accepted where ``decline`` is null."""
    null = lambda kind: F.lit(None).cast(kind)
    column = lambda name, kind: F.col(name).cast(kind) if name and name in rows.columns else null(kind)
    entries = [x for k, v in (evidence or {}).items() for x in (F.lit(k), v.cast("string"))]
    reason = decline if decline is not None else null("string")
    return rows.select(
        F.lit(rule).alias("rule"),
        F.lit(kind).alias("kind"),
        column(path, "string").alias("path"),
        column(line, "int").alias("line"),
        (F.struct(F.col(span[0]).cast("int").alias("start"), F.col(span[1]).cast("int").alias("stop")) if span else null("struct<start:int,stop:int>")).alias("range"),
        F.struct(column(module, "string").alias("module"), column(function, "string").alias("function"), column(arity, "int").alias("arity")).alias("scope"),
        (F.create_map(*entries) if entries else null("map<string,string>")).alias("evidence"),
        (confidence.cast("double") if confidence is not None else null("double")).alias("confidence"),
        reason.isNull().alias("accepted"),
        reason.alias("decline"),
        (description if description is not None else null("string")).alias("description"),
    )


def none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def accepted(found: DataFrame) -> DataFrame:
    return found.filter("accepted")


def declined(found: DataFrame) -> DataFrame:
    return found.filter("not accepted")


def by_path(found: DataFrame) -> DataFrame:
    """path and its findings, by line; findings without a path are left out."""
    rows = F.struct("line", "rule", "kind", "accepted", "decline", "description")
    return found.filter("path is not null").groupBy("path").agg(F.array_sort(F.collect_list(rows)).alias("findings"))


def merged(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ordered(found: DataFrame) -> DataFrame:
    """By path, line and rule; a missing path sorts as the empty one and a missing line as 0."""
    return found.orderBy(F.coalesce("path", F.lit("")), F.coalesce("line", F.lit(0)), "rule", "kind", F.coalesce("description", F.lit("")))


def to_line() -> Column:
    """path:line [kind] accepted, or declined and why."""
    place = F.concat_ws(":", "path", F.col("line").cast("string"))
    verdict = F.when(F.col("accepted"), F.coalesce(F.concat(F.lit("accepted: "), "description"), F.lit("accepted"))).otherwise(F.concat(F.lit("declined: "), "decline"))
    return F.array_join(F.filter(F.array(place, F.concat(F.lit("["), "kind", F.lit("]")), verdict), lambda x: x != ""), " ")
