"""Data flow inside a block or between branches: reads after a place, purity, liveness."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from coppice.functions.segments import Segment

#: Calls that are total, free of exceptions and eager.
PURE = frozenset("+ - * == != < > <= >= and or not <> ++ -- |> Map.get Map.put Map.new Map.keys Map.values Enum.map Enum.filter Enum.reject Enum.count Enum.sum Enum.reverse Enum.sort List.first List.last List.wrap String.length String.trim String.downcase String.upcase Keyword.get is_nil is_list is_map is_atom is_binary length".split())


def pure(calls: Iterable[str]) -> bool:
    """Whether every call is known to be pure; division, bang functions and lazy streams are not."""
    return all(c in PURE for c in calls)


def read_after(block: Sequence[Segment], k: int, name: str) -> bool:
    """Whether a statement after ``k`` reads the name before one writes it anew."""
    for s in block[k + 1 :]:
        if name in s.reads:
            return True
        if name in s.writes:
            return False
    return False


def branches_reading(branches: Sequence[Sequence[Segment]], name: str) -> list[int]:
    """The branches that read a name before they write it."""
    return [k for k, b in enumerate(branches) if read_after([Segment(frozenset(), frozenset()), *b], 0, name)]


def live_in_one_branch(branches: Sequence[Sequence[Segment]], after: Sequence[Segment], name: str) -> bool:
    """Whether just one branch reads a name and nothing after the branches does."""
    return len(branches_reading(branches, name)) == 1 and not read_after([Segment(frozenset(), frozenset()), *after], 0, name)


def free_in_order(block: Sequence[Segment], order: Sequence[Sequence[str]] | None = None) -> list[str]:
    """Names that a block reads before it writes them, in order of first read (by ``order`` inside a statement, else by name)."""
    written: set[str] = set()
    out: dict[str, None] = {}
    for k, s in enumerate(block):
        for name in order[k] if order is not None else sorted(s.reads):
            if name not in written:
                out[name] = None
        written |= s.writes
    return list(out)
