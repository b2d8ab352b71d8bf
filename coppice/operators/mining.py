"""Mining of sets: exact set clusters, weighted co-occurrence, outliers, surfaces, shapes, trains.

Pairs are only ever made inside one site, basket or tree; sets that share a key are
counted, not paired. Where a token is common to very many sets, the counts are aggregated
before they meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.session import cut, ship


def sites(df: DataFrame, by: list[str], token: str, name: str = "tokens") -> DataFrame:
    """The sorted set of tokens of each site."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(token)).alias(name))


def set_clusters(site_sets: DataFrame, tokens: str = "tokens", least: int = 2) -> DataFrame:
    """Exact token sets of at least two tokens and their support."""
    return site_sets.filter(F.size(tokens) >= least).groupBy(tokens).agg(F.count(F.lit(1)).alias("support"))


def pair_weights(site_sets: DataFrame, tokens: str = "tokens", weight: Column | None = None) -> DataFrame:
    """Unordered token pairs of the same site: a < b and the summed weight (1 for each site)."""
    held = site_sets.select(F.posexplode(tokens).alias("i", "a"), F.col(tokens), (weight if weight is not None else F.lit(1.0)).alias("w"))
    pairs = held.select("a", F.explode(F.slice(tokens, F.col("i") + 2, F.size(tokens))).alias("b"), "w")
    return pairs.groupBy("a", "b").agg(F.sum("w").alias("weight"))


def proximity(path_a: Column, path_b: Column, sibling: float = 0.5) -> Column:
    """Weight of two sites of one tree by the way between them: siblings 0.5, else 2 ** -(steps)."""
    n = F.least(F.size(path_a), F.size(path_b))
    same = F.zip_with(F.slice(path_a, 1, n), F.slice(path_b, 1, n), lambda x, y: x == y)
    first = F.array_position(same, False)
    common = F.when(first == 0, n).otherwise(first - 1)
    da, db = F.size(path_a) - common, F.size(path_b) - common
    return F.when((da == 1) & (db == 1), F.lit(sibling)).otherwise(F.pow(F.lit(2.0), -(da + db)))


def tree_pair_weights(class_sites: DataFrame, tree: str = "tree_id", site: str = "site_id", sibling: float = 0.5) -> DataFrame:
    """Pairs of tokens over the sites of a tree (tokens, path): the same element 1, others by proximity."""
    inside = pair_weights(class_sites)
    a, b = class_sites.alias("a"), class_sites.alias("b")
    both = a.join(b, (F.col(f"a.{tree}") == F.col(f"b.{tree}")) & (F.col(f"a.{site}") < F.col(f"b.{site}")))
    across = both.select(F.explode("a.tokens").alias("x"), F.col("b.tokens").alias("ys"), proximity(F.col("a.path"), F.col("b.path"), sibling).alias("w")).select("x", F.explode("ys").alias("y"), "w").filter("x <> y")
    far = across.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("weight"))
    return inside.unionByName(far).groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def split_scale(token: Column) -> tuple[Column, Column]:
    """A token's prefix and trailing number (empty where it has none)."""
    scale = F.regexp_extract(token, r"^(.*?)(\d+)$", 2)
    return F.when(scale == "", token).otherwise(F.regexp_extract(token, r"^(.*?)(\d+)$", 1)), scale


def same_family(a: Column, b: Column) -> Column:
    """Equal prefixes, different trailing numbers."""
    (pa, sa), (pb, sb) = split_scale(a), split_scale(b)
    return (sa != "") & (sb != "") & (pa == pb) & (pa != "") & (sa != sb)


def outlier_swaps(clusters: DataFrame, weights: DataFrame, min_support: int = 8, dominance: int = 20, family: bool = True, tokens: str = "tokens") -> DataFrame:
    """Sets that differ from a convention in one token and should have that token instead.

    Candidates meet on the set less one token (equi-join), so no two sets are compared that
    do not differ by exactly one swap. Ties between conventions decline.
    """
    less = clusters.select(tokens, "support", F.explode(tokens).alias("own")).withColumn("rest", F.array_except(tokens, F.array("own")))
    odd = less.select(F.col("rest"), F.col(tokens).alias("set"), F.col("support").alias("own_support"), F.col("own").alias("bad"))
    convention = less.filter(F.col("support") >= min_support).select("rest", F.col("own").alias("good"), F.col("support").alias("conv_support"))
    swaps = odd.join(convention, "rest").filter((F.col("bad") != F.col("good")) & (F.col("conv_support") >= dominance * F.col("own_support")))
    if family:
        swaps = swaps.filter(same_family(F.col("bad"), F.col("good")))
    toward = swaps.select("set", "bad", "good", "conv_support", F.explode_outer("rest").alias("other"))
    weigh = lambda df, end: df.join(weights.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("weight").alias(f"{end}_w")), (F.least(end, "other") == F.col("_a")) & (F.greatest(end, "other") == F.col("_b")), "left").drop("_a", "_b")
    scored = weigh(weigh(toward, "good"), "bad").groupBy("set", "bad", "good", "conv_support").agg(F.coalesce(F.sum("good_w"), F.lit(0.0)).alias("good_weight"), F.coalesce(F.sum("bad_w"), F.lit(0.0)).alias("bad_weight"))
    good = scored.filter("good_weight > bad_weight")
    w = Window.partitionBy("set")
    ranked = good.withColumn("top", F.max("conv_support").over(w)).filter("conv_support = top").withColumn("ties", F.count(F.lit(1)).over(w))
    return ranked.filter("ties = 1").select("set", "bad", "good", F.col("conv_support").alias("support"))


def envy(uses: DataFrame, owner: str, target: str, least: int = 2) -> DataFrame:
    """The target an owner uses most, if that is unique and at least ``least``; else why not."""
    counted = uses.groupBy(owner, target).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(owner)
    top = counted.withColumn("top", F.max("n").over(w)).filter("n = top").groupBy(owner, "n").agg(F.count(F.lit(1)).alias("ties"), F.min(target).alias("target"))
    decline = F.when(F.col("ties") > 1, "tie").when(F.col("n") < least, "too_few")
    return top.select(owner, F.when(decline.isNull(), F.col("target")).alias("target"), "n", decline.alias("decline"))


def _shared(functions: tuple[pa.Array, pa.Array], counts: tuple[np.ndarray, np.ndarray], columns: int = 2048) -> np.ndarray:
    """How many functions each owner of the first list shares with each of the second: products of 0/1 tables, some columns at a time."""
    flat = pa.chunked_array(functions).combine_chunks().dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False)
    rows = [np.repeat(np.arange(len(c)), c) for c in counts]
    codes = codes[: len(rows[0])], codes[len(rows[0]) :]
    out = np.zeros((len(counts[0]), len(counts[1])), np.float32)
    order = [np.argsort(c, kind="stable") for c in codes]
    for low in range(0, len(flat.dictionary), columns):
        sides = []
        for code, row, by in zip(codes, rows, order):
            of = by[np.searchsorted(code, low, sorter=by) : np.searchsorted(code, low + columns, sorter=by)]
            own, at = np.unique(row[of], return_inverse=True)
            table = np.zeros((len(own), columns), np.float32)
            table[at, code[of] - low] = 1
            sides.append((own, table))
        (x, left), (y, right) = sides
        if len(x) and len(y):
            out[np.ix_(x, y)] += left @ right.T
    return out


def surface_pairs(surfaces: DataFrame, owner: str, function: str, least: int = 1, block: int = 512) -> DataFrame:
    """Pairs of owners by the functions that they share: shared, jaccard (2 digits).

    Owners are dealt into blocks, and each pair of blocks is one product of tables: a task holds two
    blocks and their counts, and no row is made for a function that two owners share.
    """
    spark = surfaces.sparkSession
    ship(spark)
    kind = surfaces.schema[owner].dataType.simpleString()
    own = surfaces.select(F.col(owner).alias("o"), F.col(function).alias("f")).filter("o is not null").distinct()
    sets = cut(own.groupBy("o").agg(F.count(F.lit(1)).alias("size"), F.collect_list("f").alias("fs")))
    blocks = max(1, -(-sets.count() // block))
    dealt = sets.withColumn("own", F.pmod(F.xxhash64("o"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    groups = blocks * (blocks + 1) // 2
    tasks = min(groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), groups // 16))
    met = dealt.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "o", "size", "fs").repartition(tasks, "i", "j")

    def count(held: pa.Table) -> pa.Table:
        i, j = held.column("i")[0].as_py(), held.column("j")[0].as_py()
        sides = [held.filter(pc.equal(held.column("own"), k)).combine_chunks() for k in (i, j)]
        lists = [side.column("fs").combine_chunks() for side in sides]
        shared = _shared(tuple(x.flatten() for x in lists), tuple(pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in lists))
        names = pa.chunked_array([c for side in sides for c in side.column("o").chunks], sides[0].schema.field("o").type).combine_chunks()
        place = np.empty(len(names), np.int64)
        place[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        if i == j:
            place = np.tile(place[: len(names) // 2], 2)  # as both sides are one block
            shared[place[: len(shared), None] >= place[None, : len(shared)]] = 0
        x, y = np.nonzero(shared >= least if least > 0 else shared > 0)
        n = shared[x, y].astype(np.int64)
        y = y + len(shared)
        swap = place[x] > place[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        size = np.concatenate([side.column("size").to_numpy() for side in sides])
        return pa.table({"a": names.take(pa.array(x)), "b": names.take(pa.array(y)), "shared": n, "na": size[x], "nb": size[y]})

    pairs = met.groupBy("i", "j").applyInArrow(count, f"a {kind}, b {kind}, shared long, na long, nb long").filter(F.col("shared") >= least)
    return pairs.select("a", "b", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 2).alias("jaccard"))


def families(surfaces: DataFrame, owner: str, function: str, least: int = 2) -> DataFrame:
    """Functions that at least two owners have, with how many."""
    return surfaces.groupBy(function).agg(F.countDistinct(owner).alias("owners")).filter(F.col("owners") >= least)


def shape_positions(shapes: DataFrame, shape: list[str], stem: str, least: int = 3) -> DataFrame:
    """Shapes seen often enough whose position always has the same stem."""
    return shapes.groupBy(*shape).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(stem).alias("stems"), F.min(stem).alias("stem")).filter((F.col("n") >= least) & (F.col("stems") == 1)).drop("stems")


def parameter_trains(calls: DataFrame, callee: str, params: str, least: int = 3) -> DataFrame:
    """Parameter lists of at least ``least`` that recur: 10 x callees + arity."""
    long = calls.filter(F.size(params) >= least)
    trains = long.groupBy(params).agg(F.countDistinct(callee).alias("callees")).filter("callees >= 2")
    return trains.withColumn("score", (F.col("callees") * 10 + F.size(params)).cast("long"))


def constant_arguments(calls: DataFrame, callee: list[str], argument: str, least: int = 2) -> DataFrame:
    """Callees that are always given the same argument."""
    return calls.groupBy(*callee).agg(F.count(F.lit(1)).alias("calls"), F.countDistinct(argument).alias("kinds"), F.min(argument).alias("argument")).filter((F.col("kinds") == 1) & (F.col("calls") >= least)).drop("kinds")


def flag_arguments(calls: DataFrame, callee: list[str], argument: str, most: int = 4) -> DataFrame:
    """Callees whose argument takes two to ``most`` values."""
    return calls.groupBy(*callee).agg(F.countDistinct(argument).alias("kinds")).filter((F.col("kinds") >= 2) & (F.col("kinds") <= most))


def literal_groups(occurrences: DataFrame, scope: list[str], value: str, context: str, nameable: Column, least: int = 2) -> DataFrame:
    """Repeated literals with the first reason against naming them: too_few, ambiguous, unnameable."""
    counted = occurrences.groupBy(*scope, value).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(context).alias("contexts"))
    decline = F.when(F.col("n") < least, "too_few").when(F.col("contexts") > 1, "ambiguous").when(~nameable, "unnameable")
    return counted.withColumn("decline", decline)


def attribute_bundles(elements: DataFrame, tag: str, attributes: str, least: int = 2) -> DataFrame:
    """Tag and attribute-list shells that recur, richest first."""
    return elements.groupBy(tag, attributes).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
