"""What the operators on documents share: ids of any type, column names of their own, size checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A null integer id sorts last.
LAST = (1 << 63) - 1


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``docs`` does not use (in any case)."""
    used, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def unclashed(docs: DataFrame, *names: str) -> None:
    """Raises if ``docs`` has a column named like an output."""
    if clash := {c.lower() for c in docs.columns} & {n.lower() for n in names}:
        raise ValueError(f"the documents have columns {sorted(clash)}; name the outputs otherwise")


def sortable(docs: DataFrame, key: str) -> F.Column:
    """The id as a value that is never null and sorts as the id does: integers as they are, all else as strings; null last."""
    column = F.col(f"`{key}`")
    if isinstance(docs.schema[key].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return F.coalesce(column.cast("long"), F.lit(LAST))
    return F.when(column.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), column.cast("string")))


def plain(text: str) -> F.Column:
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))


def identified(docs: DataFrame, text: str, key: str) -> DataFrame:
    """id (never null), tie (xxhash64 of the text) and text (null: empty)."""
    return docs.select(sortable(docs, key).alias("id"), F.xxhash64(plain(text)).alias("tie"), plain(text).alias("text"))


def small(df: DataFrame, row_bytes: int, limit: int = 16 << 20) -> bool:
    """Whether ``df`` (cut) is proven small enough to broadcast, at ``row_bytes`` a row."""
    return df.count() * row_bytes <= limit
