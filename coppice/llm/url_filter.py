"""URL filters: rules by host and path, and boosted trees on lexical features for the rest.

A url's host lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with
A-Z lower-cased; its path runs from there to ``?``, ``#`` or the end. A rule fits its host and all
subdomains where the path starts with the rule's; the longest fitting rule decides. Urls
without a rule are judged by gradient-boosted trees on length, depth, digit ratio, entropy,
parameter counts and the block rate of the host's suffix, trained on labelled urls (here:
the urls that rules label).

Everything is DataFrame functions: features, split statistics, boosting and scoring. Each
round fits one regression tree to the gradients of the logistic loss by per-bin sums, level
by level, and the finished trees become one SQL expression.

The trees are fitted on at most ``sample_rows`` labelled urls, those with the smallest hash
(documented bound); suffix statistics are counted over all labelled urls.

Defined results: a null url or one without ``://`` has an empty host and path and no rule;
empty urls have zero features; with no labelled urls, or none of one label, the verdict is
the only label there is, or allow. Repeated urls are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.rows import small, unclashed
from coppice.session import cut


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("_length", "_depth", "_digits", "_entropy", "_params", "_suffix_odds")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both parts of a url; empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Name and verdict of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features of a url that need nothing but its characters."""
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    share = lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))).cast("double") / n
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return {
        "_length": F.length(u).cast("double"),
        "_depth": F.regexp_count(path, F.lit("/")).cast("double"),
        "_digits": F.regexp_count(u, F.lit("[0-9]")).cast("double") / n,
        "_entropy": F.aggregate(F.array_distinct(F.filter(F.split(u, ""), lambda c: c != "")), F.lit(0.0), lambda e, c: e - share(c) * F.log2(share(c))),
        "_params": F.when(query == "", F.lit(0.0)).otherwise(F.regexp_count(query, F.lit("&")).cast("double") + 1),
    }


def suffix(host: Column, labels: int = 2) -> Column:
    """The last labels of a host."""
    return F.substring_index(host, ".", -labels)


def fit_trees(sample: DataFrame, features: tuple[str, ...], rounds: int, depth: int, bins: int, rate: float, leaf_penalty: float = 1.0) -> list[str]:
    """SQL expressions of regression trees boosted on ``label`` (0 or 1); their sum is a log-odds.

    Only per-bin sums (at most nodes x features x bins rows) reach the driver.
    """
    cuts = {f: sorted(set(sample.approxQuantile(f, [k / bins for k in range(1, bins)], 0.005))) for f in features}
    cuts = {f: c for f, c in cuts.items() if c}
    if not cuts:
        return []
    trees: list[str] = []
    for _ in range(rounds):
        margin = " + ".join(trees) or "0.0D"
        graded = sample.withColumn("p", F.expr(f"1.0D / (1.0D + exp(-({margin})))")).withColumns({"g": F.expr("label - p"), "h": F.expr("p * (1.0D - p)")})
        paths: dict[int, str] = {1: "true"}
        leaves: dict[int, float] = {}
        splits: dict[int, tuple[str, float]] = {}
        for level in range(depth + 1):
            live = {k: v for k, v in paths.items() if k >> level == 1}
            if not live:
                break
            node = "CASE " + " ".join(f"WHEN {v} THEN {k}" for k, v in live.items()) + " END"
            binned = F.array(*[F.struct(F.lit(f).alias("f"), F.expr(" + ".join(f"CAST({f} > {c!r}D AS INT)" for c in edges)).alias("b")) for f, edges in cuts.items()])
            rows = graded.withColumn("node", F.expr(node)).filter("node is not null").select("node", "g", "h", F.explode(binned).alias("x")).groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            sums: dict[tuple[int, str], dict[int, tuple[float, float]]] = {}
            for r in rows:
                sums.setdefault((r["node"], r["f"]), {})[r["b"]] = (r["g"], r["h"])
            for k, where in live.items():
                one = next((s for (n, _), s in sorted(sums.items()) if n == k), {})
                g_all, h_all = (sum(v[i] for _, v in sorted(one.items())) for i in (0, 1))
                leaves[k] = rate * g_all / (h_all + leaf_penalty)
                best = (1e-6, "", 0.0)
                for f, edges in cuts.items():
                    g = h = 0.0
                    own = sums.get((k, f), {})
                    for b, c in enumerate(edges):
                        g, h = g + own.get(b, (0.0, 0.0))[0], h + own.get(b, (0.0, 0.0))[1]
                        if h < 1 or h_all - h < 1:
                            continue
                        gain = g * g / (h + leaf_penalty) + (g_all - g) ** 2 / (h_all - h + leaf_penalty) - g_all * g_all / (h_all + leaf_penalty)
                        best = max(best, (round(gain, 9), f, c))
                if level < depth and best[1]:
                    splits[k] = best[1:]
                    paths[2 * k] = f"({where} AND {best[1]} <= {best[2]!r}D)"
                    paths[2 * k + 1] = f"({where} AND {best[1]} > {best[2]!r}D)"
        trees.append(_tree_sql(1, splits, leaves))
        if 1 not in splits:
            break
    return trees


def _tree_sql(k: int, splits: dict[int, tuple[str, float]], leaves: dict[int, float]) -> str:
    if k not in splits:
        return f"({leaves.get(k, 0.0)!r}D)"
    f, c = splits[k]
    return f"(CASE WHEN {f} > {c!r}D THEN {_tree_sql(2 * k + 1, splits, leaves)} ELSE {_tree_sql(2 * k, splits, leaves)} END)"


def judged(pages: DataFrame, rules: list[Rule], url: str = "url", rounds: int = 6, depth: int = 3, bins: int = 16, rate: float = 0.4, threshold: float = 0.5, sample_rows: int = 20_000) -> DataFrame:
    """All columns of ``pages`` with ``_host``, ``_path``, ``_rule``, ``_score`` (of block) and ``_verdict``; raises if there are such columns.

    The block rates of suffixes are broadcast while they are proven to take at most 16 MB,
    else joined; a labelled url's own label is left out of the rate that it is learned with.
    """
    unclashed(pages, "_host", "_path", "_rule", "_score", "_verdict")
    host, path = host_and_path(F.col(f"`{url}`"))
    # Columns of the pages travel in one struct, out of the way of the names used here.
    parted = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_page"), F.col(f"`{url}`").alias("url"), host.alias("_host"), path.alias("_path"))
    ruled = parted.withColumn("_found", rule_of(F.col("_host"), F.col("_path"), rules)).withColumn("_suffix", suffix(F.col("_host")))
    labelled = ruled.filter("_found is not null").select("url", "_host", "_path", "_suffix", (F.col("_found.verdict") == "block").cast("int").alias("label"))
    rates = cut(labelled.groupBy("_suffix").agg(F.sum("label").alias("_blocked"), F.count(F.lit(1)).alias("_n")))
    rates_here = F.broadcast(rates) if small(rates, 128) else rates
    sample = labelled.orderBy(F.xxhash64("url"), "url", "label").limit(sample_rows)
    lexicals = lexical(F.col("url"), F.col("_host"), F.col("_path"))
    others = (F.col("_blocked") - F.col("label") + 1.0) / (F.col("_n") - 1 + 2.0)
    sample = cut(sample.join(rates_here, "_suffix", "left").select("label", *[c.alias(f) for f, c in lexicals.items()], F.coalesce(others, F.lit(0.5)).alias("_suffix_odds")))
    kinds = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        margin = F.lit(9.0 if set(kinds) == {1} else -9.0)
    else:
        margin = F.expr(" + ".join(fit_trees(sample, FEATURES, rounds, depth, bins, rate)) or "0.0D")
    named = ruled.join(rates_here, "_suffix", "left")
    rate_of = (F.col("_blocked") + 1.0) / (F.col("_n") + 2.0)
    featured = named.withColumns(lexicals | {"_suffix_odds": F.coalesce(rate_of, F.lit(0.5))})
    scored = featured.withColumn("_score", 1.0 / (1.0 + F.exp(-margin)))
    verdict = F.coalesce(F.col("_found.verdict"), F.when(F.col("_score") >= threshold, "block").otherwise("allow"))
    kept = [F.col("_page").getField(c).alias(c) for c in pages.columns]
    return scored.select(*kept, "_host", "_path", F.col("_found.name").alias("_rule"), "_score", verdict.alias("_verdict"))


#: The rules of the url query.
RULES = [
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
]
