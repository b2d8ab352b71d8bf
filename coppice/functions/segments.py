"""Blocks of statements: carriers, cuts into phases, canonical order, repeated windows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple


class Segment(NamedTuple):
    reads: frozenset[str]
    writes: frozenset[str]
    key: str = ""
    mass: int = 1


def carriers(block: Sequence[Segment]) -> set[str]:
    """Names written by one statement and read by a later one."""
    out: set[str] = set()
    for i, s in enumerate(block):
        out |= s.writes & frozenset().union(*(t.reads for t in block[i + 1 :]))
    return out


def live_out(block: Sequence[Segment], k: int) -> set[str]:
    """Names written before a cut at ``k`` and read after it."""
    written = frozenset().union(*(s.writes for s in block[:k]))
    read = frozenset().union(*(s.reads for s in block[k:]))
    return set(written & read)


def cuts(block: Sequence[Segment], least: int = 2, most_carriers: int = 3, phases: int = 3) -> list[int]:
    """Cuts into at least ``phases`` phases, the narrowest first, then the earliest; none if there are too few."""
    n = len(block)
    ranked = sorted((len(live_out(block, k)), k) for k in range(least, n - least + 1))
    taken: list[int] = []
    for width, k in ranked:
        if width <= most_carriers and all(abs(c - k) >= least for c in taken):
            taken.append(k)
    return sorted(taken) if len(taken) >= max(1, phases - 1) else []


def canonical_order(block: Sequence[Segment]) -> list[int]:
    """A topological order of the data flow; of what is ready the smallest key, then place, comes first."""
    n = len(block)
    waits: list[set[int]] = [set() for _ in range(n)]
    for j in range(n):
        for i in range(j):
            a, b = block[i], block[j]
            if a.writes & (b.reads | b.writes) or a.reads & b.writes:
                waits[j].add(i)
    out: list[int] = []
    left = set(range(n))
    while left:
        ready = min((block[i].key, i) for i in left if not waits[i] & left)[1]
        out.append(ready)
        left.discard(ready)
    return out


def repeated_windows(blocks: dict[str, Sequence[Segment]], least: int = 2, min_mass: int = 8, savings: int = 12, most_live: int = 3) -> list[tuple[str, int, int]]:
    """Statement windows (block, first, end) that occur elsewhere, best savings first, none overlapping."""
    groups: dict[tuple, list[tuple[str, int, int, int]]] = {}
    for name in sorted(blocks):
        block = blocks[name]
        for i in range(len(block)):
            for j in range(i + least, len(block) + 1):
                mass = sum(s.mass for s in block[i:j])
                inner = frozenset().union(*(s.writes for s in block[i:j]))
                after = frozenset().union(*(s.reads for s in block[j:]))
                if mass >= min_mass and len(inner & after) <= most_live:
                    groups.setdefault((len(inner & after), tuple(s.key for s in block[i:j])), []).append((name, i, j, mass))
    ranked = sorted(((len(g) - 1) * g[0][3], k) for k, g in groups.items() if len(g) > 1)
    taken: list[tuple[str, int, int]] = []
    for saved, key in reversed(ranked):
        free = [w for w in groups[key] if all(w[0] != t[0] or w[2] <= t[1] or t[2] <= w[1] for t in taken)]
        apart: list[tuple[str, int, int, int]] = []
        for w in free:
            if all(w[0] != o[0] or w[1] >= o[2] for o in apart):
                apart.append(w)
        if len(apart) > 1 and (len(apart) - 1) * apart[0][3] >= savings:
            taken += [w[:3] for w in apart]
    return sorted(taken)
