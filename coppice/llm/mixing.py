"""Mixing sources to target weights by hierarchical budgets, with DataFrame functions only.

The leaves of a tree (domain, language, source) hold documents. A token budget is dealt from
the root down: each node's budget is shared out among its children in proportion to their
weights, no child getting more than all of its documents in ``max_epochs`` epochs hold; what
a child cannot take goes to its siblings by weight, and only what a whole subtree cannot
take goes to the siblings of its parent. With capacities summed from the leaves up, this is
one water-filling at each node: child i gets min(capacity, level x weight).

Each leaf then takes its documents in seeded order: as many whole epochs as its budget
covers, and a prefix of the next epoch in that epoch's own order, ending before the first
document that would exceed the budget. The order of an epoch is by
md5("seed:epoch:leaf:key"), ties by key and text, equal rows in any order.

No leaf is gathered for its prefix: its documents fall into buckets by the leading digits
of their digest, as many as the leaf's size asks for; running totals over the buckets find
the one where the budget ends, and only that one is ordered row by row.

Defined results: null levels are the text ``(null)``; a null or empty text has no tokens and
is never past the budget; a leaf without tokens is taken once; a missing, null or negative weight is ``default_weight``; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.llm.rows import unclashed
from coppice.session import cut

#: A document's tokens are its words: runs of anything but space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
BUCKET_DIGITS = (0, 1, 2, 3, 4, 5)


def n_tokens(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def leaf_budgets(leaves: DataFrame, weights: DataFrame | None, n_levels: int, budget: Column | float, max_epochs: int, default_weight: float = 1.0) -> DataFrame:
    """``leaves`` (_l0.., tokens) with ``budget`` (double) of each leaf.

    ``weights`` has node (the names from the root down, joined by "/") and weight. ``budget`` is
    the share of all tokens if at most 1, else a number of tokens.
    """
    capped = leaves.withColumn("cap", F.col("tokens").cast("double") * max_epochs)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("double").alias("total"))
    root = total.select((F.col("total") * F.lit(float(budget)) if float(budget) <= 1 else F.lit(float(budget))).alias("b"))
    nodes = root.withColumn("_k", F.lit(0))
    above: list[str] = []
    for depth in range(1, n_levels + 1):
        path = [f"_l{k}" for k in range(depth)]
        children = capped.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("node", F.concat_ws("/", *path))
        if weights is not None:
            given = weights.groupBy("node").agg(F.max("weight").alias("weight"))
            children = children.join(given, "node", "left")
        else:
            children = children.withColumn("weight", F.lit(None).cast("double"))
        children = children.withColumn("w", F.when(F.col("weight") >= 0, F.col("weight").cast("double")).otherwise(F.lit(float(default_weight)))).withColumn("_k", F.lit(0))
        on = ["_k", *above]
        dealt = children.join(nodes.select(*on, "b"), on)
        # Water level: children in order of capacity per weight; i is full if all before it are
        # full and the level that fills it costs no more than the budget.
        by = Window.partitionBy(*on)
        order = by.orderBy("r", *path).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        filled = dealt.withColumn("r", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))))
        filled = filled.withColumns({"c_sum": F.sum("cap").over(order), "w_sum": F.sum("w").over(order), "w_all": F.sum("w").over(by)})
        filled = filled.withColumn("full", (F.col("w") > 0) & (F.col("c_sum") + F.col("r") * F.greatest(F.col("w_all") - F.col("w_sum"), F.lit(0.0)) <= F.col("b") * (1 + 1e-12)))
        filled = filled.withColumns({"c_full": F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0.0)), "w_open": F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(by), F.lit(0.0))})
        share = F.when(F.col("full"), F.col("cap")).when(F.col("w_open") > 0, F.least(F.col("cap"), F.col("w") * (F.col("b") - F.col("c_full")) / F.col("w_open"))).otherwise(F.lit(0.0))
        nodes = filled.select("_k", *path, F.greatest(share, F.lit(0.0)).alias("b"))
        above = path
    return leaves.join(nodes.select(*above, F.col("b").alias("budget")), above)


def _by_leaf(rows: DataFrame, leaves: DataFrame, path: list[str], few: bool) -> DataFrame:
    """Joins a table with a row for each leaf: broadcast where it was counted as small, else by Spark's choice."""
    return rows.join(F.broadcast(leaves) if few else leaves, path)


def mixed(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: DataFrame | None = None,
    budget: float = 0.5,
    max_epochs: int = 2,
    seed: int = 42,
    text: str = "text",
    key: str = "doc_id",
    bucket_rows: int = 4096,
    broadcast_leaves: int = 20_000,
    prefix: str = "_",
) -> DataFrame:
    """The selected rows of ``docs`` with ``_l0``.. (the leaf), ``_tokens`` and ``_times`` (how many epochs take the row).

    ``prefix`` stands for the underscore; raises if the documents have a column of such a name.
    """
    path = [f"_l{k}" for k in range(len(levels))]
    outputs = [*path, "_tokens", "_times"]
    unclashed(docs, *[prefix + c[1:] for c in outputs])
    # Columns of the documents travel in one struct, out of the way of the names used here.
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    leaf = [F.coalesce(c.cast("string"), F.lit("(null)")).alias(f"_l{k}") for k, c in enumerate(levels.values())]
    named = docs.select(whole_row, *leaf, F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))
    # Texts are counted and hashed once for all sums; of what is selected they are counted again.
    counted = cut(named.select(*path, n_tokens("_text").alias("_tokens"), "_key", F.xxhash64(F.coalesce(F.col("_text"), F.lit(""))).alias("_hash")))
    sizes = cut(counted.groupBy(*path).agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    few = sizes.count() <= broadcast_leaves
    plan = leaf_budgets(sizes, weights, len(levels), budget, max_epochs)
    plan = plan.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens") + 1e-9)).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.greatest(F.floor(F.col("budget") + 1e-6) - F.col("whole") * F.col("tokens"), F.lit(0)).cast("long"))
    digits = F.coalesce(*[F.when(F.col("rows") <= bucket_rows * 16**d, F.lit(d)) for d in BUCKET_DIGITS], F.lit(BUCKET_DIGITS[-1] + 1))
    plan = cut(plan.select(*path, F.col("whole").alias("_whole"), F.col("rest").alias("_rest"), digits.alias("_digits")))

    salt = F.concat_ws(":", F.lit(str(seed)), F.col("_whole").cast("string"), F.concat_ws("/", *path), F.coalesce(F.col("_key").cast("string"), F.lit("")))

    def order(text_hash: Column) -> Column:
        return F.concat(F.md5(salt.cast("binary")), F.lower(F.lpad(F.hex(text_hash), 16, "0")))

    slim = _by_leaf(counted, plan, path, few).select(*path, "_rest", "_tokens", order(F.col("_hash")).alias("_order"), F.expr("_digits")).withColumn("_bucket", F.expr("substring(_order, 1, _digits)"))
    upto = Window.partitionBy(*path).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = slim.groupBy(*path, "_rest", "_bucket").agg(F.sum("_tokens").alias("t")).withColumn("end", F.sum("t").over(upto))
    # The first bucket that goes past the rest of the budget, and what lies before it.
    edge = cut(sums.filter("end > _rest").groupBy(*path).agg(F.min(F.struct("_bucket", (F.col("end") - F.col("t")).alias("start"))).alias("e")).select(*path, F.col("e._bucket").alias("_edge"), F.col("e.start").alias("_start")))
    last = _by_leaf(slim, edge, path, few).filter("_bucket = _edge").groupBy(*path, "_edge", "_start", "_rest", "_order").agg(F.sum("_tokens").alias("t"))
    run = Window.partitionBy(*path).orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = last.withColumn("run", F.sum("t").over(run)).filter("_start + run <= _rest")
    cutoff = fits.groupBy(*path).agg(F.max("_order").alias("_last"))
    # Without a row that fits, the edge's prefix sorts before its rows; without an edge all rows are taken.
    plan = plan.join(edge, path, "left").join(cutoff, path, "left").select(*path, "_whole", F.coalesce("_last", "_edge", F.lit("g")).alias("_cutoff"))
    plan = cut(plan)
    times = F.least(F.col("_whole") + (order(F.xxhash64(F.coalesce(F.col("_text"), F.lit("")))) <= F.col("_cutoff")).cast("long"), F.lit(max_epochs))
    out = _by_leaf(named, plan, path, few).withColumn("_times", times.cast("int")).filter("_times > 0").withColumn("_tokens", n_tokens("_text"))
    return out.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns], *[F.col(c).alias(prefix + c[1:]) for c in outputs])
