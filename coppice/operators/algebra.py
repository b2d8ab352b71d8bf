"""Collection and conditional algebra as DataFrame functions.

Semantics where an eager collection library and SQL differ: sums of nothing are 0, a
lookup that finds nothing is null (no row), maps keep the last value of a key, and order is
always given explicitly with a tie-break. Every function builds a plan; none runs one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def count_where(df: DataFrame, predicate: Column, name: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """filter + count in one aggregate."""
    return df.groupBy(*by).agg(F.count_if(predicate).alias(name))


def find_first(df: DataFrame, predicate: Column, order: Sequence[Column], n: int = 1) -> DataFrame:
    """filter + first: at most ``n`` rows in the given order (a top-k, never a full sort)."""
    return df.filter(predicate).orderBy(*order).limit(n)


def key_find(df: DataFrame, key: str, value) -> DataFrame:
    """The row whose key equals a value; no row where there is none."""
    return df.filter(F.col(key) == F.lit(value)).limit(1)


def sum_by(df: DataFrame, value: Column, name: str, by: Sequence[str] = ()) -> DataFrame:
    """map + sum fused; 0 where nothing is summed."""
    total = F.sum(value)
    return df.groupBy(*by).agg(F.coalesce(total, F.lit(0)).alias(name))


def fused(df: DataFrame, measures: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Several reductions over one collection in one pass."""
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in measures.items()])


def grouped_lists(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """group_by with sorted buckets (Spark keeps no order inside a bucket)."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(name))


def frequencies(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """sort + take: TakeOrderedAndProject."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k of each group; the row_number filter becomes a group limit before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def members(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """member? against a list that is part of the query."""
    return df.filter(F.col(column).isin(list(values)))


def without_nulls(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def pairs_to_map(df: DataFrame, by: Sequence[str], key: str, value: str, order: Sequence[str], name: str) -> DataFrame:
    """into a map: the last value of a key by ``order`` wins."""
    last = df.groupBy(*by, key).agg(F.max_by(value, F.struct(*order)).alias("_v"))
    return last.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col("_v"))))).alias(name))


def joined(df: DataFrame, by: Sequence[str], value: Column, separator: str, order: str, name: str) -> DataFrame:
    """map + join in one aggregate, in a stated order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["v"]), separator).alias(name))


def reverse_concat(a: Column, b: Column) -> Column:
    """reverse(a) ++ b."""
    return F.concat(F.reverse(a), b)


def last_of_reverse(a: Column) -> Column:
    """The last of a reversed list is the first; null for an empty one."""
    return F.try_element_at(a, F.lit(1))


def wrap(value: Column) -> Column:
    """A value in a list; null is the empty list."""
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value.cast("string")))


def is_empty(df: DataFrame, other: DataFrame, on: Column) -> DataFrame:
    """Rows for which the other collection has none (an anti join, not a count)."""
    return df.join(other, on, "left_anti")


def any_where(df: DataFrame, predicate: Column, by: Sequence[str], name: str = "any") -> DataFrame:
    """count(pred) > 0 without counting."""
    return df.groupBy(*by).agg(F.coalesce(F.bool_or(predicate), F.lit(False)).alias(name))


def integers(spark: SparkSession, first: int, last: int, name: str = "i") -> DataFrame:
    """The inclusive range, lazily."""
    return spark.range(first, last + 1).withColumnRenamed("id", name)


def lookup(value: Column, table: dict, default=None) -> Column:
    """Literal clauses to a map: the first clause of a key wins, else the default."""
    entries = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*entries), value), F.lit(default))


def cases(arms: Sequence[tuple[Column, Column]], otherwise: Column) -> Column:
    """A flat conditional from a nest of if and else."""
    first, *rest = arms
    return reduce(lambda c, a: c.when(*a), rest, F.when(*first)).otherwise(otherwise)


def boolean(condition: Column) -> Column:
    """if c, true, else false: null counts as false."""
    return F.coalesce(condition, F.lit(False))


def safe_number(text: Column, kind: str = "bigint") -> Column:
    """An access that gives null instead of an error."""
    return text.try_cast(kind)


def filtered_map(df: DataFrame, predicate: Column, **columns: Column) -> DataFrame:
    """filter + map as one projection over one scan."""
    return df.filter(predicate).select(*[c.alias(n) for n, c in columns.items()])


def above_invariant(df: DataFrame, value: str, invariant: DataFrame) -> DataFrame:
    """Rows above a one-row invariant that is computed once, not for each row."""
    return df.crossJoin(F.broadcast(invariant)).filter(F.col(value) > F.col(invariant.columns[0]))


def common_prefix(df: DataFrame, a: str, b: str, name: str = "prefix") -> DataFrame:
    """How many leading elements two array columns share."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(True).alias("on"))

    def step(s: Column, p: Column) -> Column:
        on = s["on"] & p["x"].eqNullSafe(p["y"])
        return F.struct((s["n"] + on.cast("long")).alias("n"), on.alias("on"))

    return df.withColumn(name, F.aggregate(pairs, state, step)["n"])


def runs(df: DataFrame, by: Sequence[str], order: str, key: str) -> DataFrame:
    """Maximal runs of rows with one key (gaps and islands): by, key, first, last, length."""
    w = Window.partitionBy(*by).orderBy(order)
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(*by, key).orderBy(order))
    marked = df.withColumn("_island", island)
    return marked.groupBy(*by, key, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length")).drop("_island")


def single_use(definitions: DataFrame, uses: DataFrame, on: str, name: str = "uses") -> DataFrame:
    """Definitions that are used exactly once."""
    counted = uses.groupBy(on).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) == 1)
    return definitions.join(counted, on)


def unused(definitions: DataFrame, uses: DataFrame, on: str) -> DataFrame:
    """Definitions that nothing uses."""
    return definitions.join(uses.select(on), on, "left_anti")
