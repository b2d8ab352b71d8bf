"""Runs rules: selection and order, detection over relations, rewriting to a fixpoint.

A rule has a name, a priority and a detector over named relations, a rewrite of one text, or
both. Detection merges the findings of all chosen detectors in one plan, so that shared
relations are scanned once where Spark reuses them. Rewriting a table of texts runs the
whole pipeline of rules inside one map over the rows; texts are independent of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from coppice.plans.findings import merged, ordered
from coppice.session import ship

MAX_PASSES = 5
DEFAULT_PRIORITY = 100

Relations = dict[str, DataFrame]


@dataclass(frozen=True)
class Rule:
    """``patches`` gives (start, stop, replacement) edits; ``rewrite`` gives the new text."""

    name: str
    detect: Callable[[Relations, dict], DataFrame] | None = None
    rewrite: Callable[[str, dict], str] | None = None
    patches: Callable[[str, dict], list[tuple[int, int, str]]] | None = None
    priority: int = DEFAULT_PRIORITY
    enabled: bool = True
    needs: tuple[str, ...] = ()


@dataclass
class Result:
    text: str
    changed: bool
    converged: bool
    applied: list[tuple[str, str, str]] = field(default_factory=list)


_rules: dict[str, Rule] = {}


def register(rule: Rule) -> Rule:
    _rules[rule.name] = rule
    return rule


def rules() -> list[Rule]:
    """All registered rules, by name."""
    return [_rules[name] for name in sorted(_rules)]


def chosen(only: Iterable[str] = (), skipped: Iterable[str] = (), configured: dict[str, dict] | None = None, among: Sequence[Rule] | None = None) -> list[Rule]:
    """The rules to run: ``only`` less ``skipped``, highest priority first, then by name.

    A configured priority goes before the rule's own; rules that are off by default need
    ``enabled`` in their configuration.
    """
    only, skipped, configured = set(only), set(skipped), configured or {}
    out = [r for r in (among if among is not None else rules()) if (not only or r.name in only) and r.name not in skipped and configured.get(r.name, {}).get("enabled", r.enabled)]
    return sorted(out, key=lambda r: (-configured.get(r.name, {}).get("priority", r.priority), r.name))


def lacking(rule: Rule, relations: Relations) -> list[str]:
    """What a rule needs and the relations do not have: relations, or columns as ``relation.column``."""
    parts = [(n, *n.partition(".")[::2]) for n in rule.needs]
    return [n for n, relation, column in parts if relation not in relations or column and column not in relations[relation].columns]


def detected(relations: Relations, selection: Sequence[Rule] | None = None, configured: dict[str, dict] | None = None) -> DataFrame:
    """Findings of all chosen rules that lack nothing (``lacking`` says what the others lack), in order."""
    parts = [r.detect(relations, (configured or {}).get(r.name, {})) for r in (selection if selection is not None else chosen(configured=configured)) if r.detect and not lacking(r, relations)]
    if not parts:
        raise ValueError("no rule has all the relations and columns that it needs")
    return ordered(merged(parts))


def disjoint(edits: Sequence[tuple[int, int, str]]) -> bool:
    """Whether no two edits overlap; touching ones do not."""
    spans = sorted((a, b) for a, b, _ in edits)
    return all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def most_disjoint(edits: Sequence[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """As many edits as can stand together: always the one that ends first of those that begin after the last."""
    out: list[tuple[int, int, str]] = []
    for edit in sorted(edits, key=lambda e: (e[1], e[0])):
        if not out or edit[0] >= out[-1][1]:
            out.append(edit)
    return out


def spliced(text: str, edits: Sequence[tuple[int, int, str]]) -> str:
    for start, stop, new in sorted(edits, reverse=True):
        text = text[:start] + new + text[stop:]
    return text


def conflicts(patches: DataFrame) -> DataFrame:
    """Patches (path, start, stop) that begin before one before them in their file ends."""
    before = F.max("stop").over(Window.partitionBy("path").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    return patches.withColumn("before", before).filter("start < before").drop("before")


def _apply(rule: Rule, text: str, options: dict) -> str:
    if rule.rewrite is not None:
        return rule.rewrite(text, options)
    return spliced(text, most_disjoint(rule.patches(text, options)))


def run(text: str, selection: Sequence[Rule], configured: dict[str, dict] | None = None, max_passes: int = MAX_PASSES) -> Result:
    """Rewrites one text until nothing changes, at most ``max_passes`` times.

    Neighbouring rules with patches share one pass over the text where all their edits are
    disjoint; else they run one after the other.
    """
    configured, result = configured or {}, Result(text, False, False)
    selection = [r for r in selection if r.rewrite or r.patches]

    def solo(rule: Rule) -> None:
        new = _apply(rule, result.text, configured.get(rule.name, {}))
        if new != result.text:
            result.applied.append((rule.name, result.text, new))
            result.text = new

    for _ in range(max_passes):
        before, i = result.text, 0
        while i < len(selection):
            j = i
            while j < len(selection) and selection[j].patches is not None:
                j += 1
            batch = selection[i:j]
            if len(batch) > 1:
                edits = [(r, r.patches(result.text, configured.get(r.name, {}))) for r in batch]
                flat = [e for _, es in edits for e in es]
                if disjoint(flat):
                    old = result.text
                    result.applied += [(r.name, old, spliced(old, es)) for r, es in edits if es and spliced(old, es) != old]
                    result.text = spliced(old, flat)
                else:
                    for r in batch:
                        solo(r)
                i = j
            else:
                solo(selection[i])
                i += 1
        if result.text == before:
            result.converged = True
            break
    result.changed = result.text != text
    return result


def rewritten(corpus: DataFrame, selection: Sequence[Rule], configured: dict[str, dict] | None = None, key: str = "path", text: str = "source") -> DataFrame:
    """key, text, changed, converged and the applied rules of every row."""
    ship(corpus.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [run(t or "", selection, configured) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([r.text for r in out], pa.string()), pa.array([r.changed for r in out], pa.bool_()), pa.array([r.converged for r in out], pa.bool_()), pa.array([[a[0] for a in r.applied] for r in out], pa.list_(pa.string()))], names=["k", "text", "changed", "converged", "applied"])

    kind = corpus.select(key).dtypes[0][1]
    return corpus.select(F.col(key).alias("k"), F.col(text).cast("string")).mapInArrow(scan, f"k {kind}, text string, changed boolean, converged boolean, applied array<string>").withColumnsRenamed({"k": key, "text": text})
