"""Weighted undirected graphs: communities, modularity, cuts, reachability."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.session import cut, ship


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst", w: str = "w", by: tuple[str, ...] = ()) -> DataFrame:
    """One row (src < dst) for each pair, weights summed; self-loops and weights not above 0 are dropped."""
    kept = edges.filter((F.col(src) != F.col(dst)) & (F.col(w) > 0))
    return kept.groupBy(*by, F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst")).agg(F.sum(w).alias("w"))


def modularity(edges: DataFrame, partition: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum over communities of inner weight / m - (degree / 2m) ** 2; edges from ``undirected``, partition (vertex, community)."""
    side = lambda end: partition.select(*by, F.col("vertex").alias(end), F.col("community").alias(f"{end}_c"))
    placed = edges.join(side("src"), [*by, "src"], "left").join(side("dst"), [*by, "dst"], "left")
    ends = placed.select(*by, F.col("src_c").alias("c"), "w", F.when(F.col("src_c") == F.col("dst_c"), F.col("w")).otherwise(0.0).alias("inner")).unionByName(placed.select(*by, F.col("dst_c").alias("c"), "w", F.lit(0.0).alias("inner")))
    sums = ends.groupBy(*by, "c").agg(F.sum("w").alias("degree"), F.sum("inner").alias("inner"))
    total = edges.groupBy(*by).agg(F.sum("w").alias("m"))
    both = sums.join(total, list(by)) if by else sums.crossJoin(F.broadcast(total))
    return both.filter("c is not null").groupBy(*by).agg(F.sum(F.col("inner") / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), F.lit(2.0))).alias("q"))


def cut_ratio(edges: DataFrame, partition: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of the weight between communities."""
    side = lambda end: partition.select(*by, F.col("vertex").alias(end), F.col("community").alias(f"{end}_c"))
    placed = edges.join(side("src"), [*by, "src"], "left").join(side("dst"), [*by, "dst"], "left")
    crossing = F.when(F.col("src_c").eqNullSafe(F.col("dst_c")), 0.0).otherwise(F.col("w"))
    return placed.groupBy(*by).agg((F.sum(crossing) / F.sum("w")).alias("cut"))


def greedy_communities(vertices: Iterable, edges: Iterable[tuple], exact_gain: bool = False) -> list[list]:
    """Agglomerative modularity communities of one graph, as sorted lists.

    The pair with the greatest gain merges first; ties go to the smaller pair of community
    keys, a community's key being its first vertex. The gain of merging u and v is
    2 (w / m - a_u a_v) with a = degree / 2m, as the published rule has it, or the change of
    modularity w / m - 2 a_u a_v with ``exact_gain``. Best partners are kept for each
    community and renewed only for those that a merge touches.
    """
    near: dict = {v: {} for v in vertices}
    total = 0.0
    for u, v, w in edges:
        if u == v or w <= 0:
            continue
        total += w
        for x, y in ((u, v), (v, u)):
            row = near.setdefault(x, {})
            row[y] = row.get(y, 0.0) + w
    members = {v: [v] for v in near}
    if total:
        degree = {v: sum(row.values()) for v, row in near.items()}
        scale = 1.0 / (2 * total)

        share = {v: x * scale for v, x in degree.items()}
        loss = 2.0 if exact_gain else 1.0
        factor = 1.0 if exact_gain else 2.0

        def best(u):
            """The best partner of u among the communities after it: sorts first by gain, then by key."""
            own, top = share[u] * loss, None
            for v, w in near[u].items():
                if u < v:
                    g = own * share[v] - w / total
                    if top is None or g < top[0] or g == top[0] and v < top[2]:
                        top = (g, u, v)
            return top

        choice = {u: best(u) for u in near}
        while True:
            top = min((c for c in choice.values() if c is not None), default=None)
            if top is None or factor * -top[0] <= 0:
                break
            _, i, j = top
            members[i] += members.pop(j)
            share[i] += share.pop(j)
            row = near[i]
            row.pop(j, None)
            choice.pop(j)
            for k, w in near.pop(j).items():
                if k != i:
                    row[k] = row.get(k, 0.0) + w
                    near[k].pop(j)
            for k, w in row.items():
                near[k][i] = w
                if k < i:
                    c = choice[k]
                    if c is None or c[2] == i or c[2] == j:
                        choice[k] = best(k)
                    else:
                        g = share[k] * loss * share[i] - w / total
                        if g < c[0] or g == c[0] and i < c[2]:
                            choice[k] = (g, k, i)
                elif k < j and choice[k] is not None and choice[k][2] == j:
                    choice[k] = best(k)
            choice[i] = best(i)
    return sorted(sorted(m) for m in members.values())


def communities(edges: DataFrame, graph: str = "graph_id", exact_gain: bool = False) -> DataFrame:
    """graph, vertex and community (numbered by first vertex) of every graph; one task a graph.

    The greedy merge is sequential inside a graph, so graphs, not edges, are spread out.
    """
    ship(edges.sparkSession)
    kind = edges.schema[graph].dataType.simpleString()
    vertex = edges.schema["src"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["src", "dst"])
        found = greedy_communities(sorted(set(frame["src"]) | set(frame["dst"])), frame[["src", "dst", "w"]].itertuples(index=False, name=None), exact_gain)
        rows = [(frame[graph].iloc[0], v, k) for k, m in enumerate(found) for v in m]
        return pd.DataFrame(rows, columns=[graph, "vertex", "community"])

    return edges.select(graph, "src", "dst", "w").groupBy(graph).applyInPandas(run, f"{graph} {kind}, vertex {vertex}, community long")


def reachable(roots: DataFrame, arcs: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """node of everything that the roots reach, themselves included (frontier by frontier)."""
    seen = cut(roots.select(F.col(roots.columns[0]).alias("node")).distinct())
    frontier = seen
    for _ in count():
        frontier = cut(arcs.join(frontier.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))
        max_rounds -= 1
        if max_rounds <= 0:
            raise RuntimeError("the graph is deeper than max_rounds")


def dead(nodes: DataFrame, roots: DataFrame, arcs: DataFrame, dynamic: str | None = None) -> DataFrame:
    """Nodes that the roots do not reach; none if they reach the ``dynamic`` node, which may call anything."""
    alive = reachable(roots, arcs)
    if dynamic is not None:
        anything = alive.filter(F.col("node") == dynamic).limit(1).select(F.lit(True).alias("any"))
        nodes = nodes.join(F.broadcast(anything), how="left").filter("any is null").drop("any")
    return nodes.join(alive, "node", "left_anti")


def resolve_calls(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """Calls (caller, name, arity) to definitions (id, name, min_arity, arity): src, dst.

    A definition answers to every arity from its least on; the range becomes rows, so that
    the join is an equality.
    """
    callable_ = definitions.select(F.col("id").alias("dst"), "name", F.explode(F.sequence("min_arity", "arity")).alias("arity"))
    return calls.join(callable_, ["name", "arity"]).select(F.col("caller").alias("src"), "dst").distinct()
