"""Names: abbreviations and their expansions, English word forms, words and scales of identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterable

VOWELS = set("aeiouyAEIOUY")


def latch(short: str, parts: list[str]) -> tuple[int, int] | None:
    """How an abbreviation latches onto subtokens: (first subtoken, initials used), or None.

    From some subtoken on, characters are initials of one subtoken after another for as
    long as they fit; the rest is a subsequence of the last subtoken used. Most initials
    win, then the later start.
    """
    found = []
    for start in range(len(parts)):
        n = 0
        while n < len(short) and start + n < len(parts) and parts[start + n][:1] == short[n]:
            n += 1
        if n and _within(short[n:], parts[start + n - 1][1:]):
            found.append((n, start))
    if not found:
        return None
    n, start = max(found)
    return start, n


def _within(chars: str, text: str) -> bool:
    rest = iter(text)
    return all(c in rest for c in chars)


def skips_in_tail(short: str, parts: list[str]) -> bool:
    """Whether two or more characters after the initials lie apart inside the last subtoken."""
    found = latch(short, parts)
    if found is None:
        return False
    start, n = found
    return len(short) - n >= 2 and short[n:] not in parts[start + n - 1][1:]


def latch_score(short: str, parts: list[str], strong: bool = True) -> int:
    """0, 80 or 100.

    100: all subtokens by their initials, or one initial and a tail; 80: some of the
    subtokens by at least two initials. 0: no latch, a weak source with under three
    characters, or over two characters of one subtoken that are not all consonants.
    """
    found = latch(short, parts)
    if found is None or not strong and len(short) < 3:
        return 0
    n = found[1]
    last = short[n - 1 :]
    if len(last) > 2 and VOWELS & set(last):
        return 0
    return 100 if n == 1 or n == len(parts) else 80


def resolve(short: str, candidates: Iterable[tuple[str, bool]], min_score: int = 80) -> str | None:
    """The one best expansion (name, strong source) of an abbreviation; ties between different names decline."""
    scored = [(latch_score(short, name.split("_"), strong), name) for name, strong in candidates if name != short]
    top = max((s for s, _ in scored), default=0)
    best = {name for s, name in scored if s == top}
    return best.pop() if top >= min_score and len(best) == 1 else None


def words(identifier: str) -> list[str]:
    """The underscore parts of the last dotted part, in lower case."""
    return [w for w in identifier.rpartition(".")[2].lower().split("_") if w]


def split_scale(token: str) -> tuple[str, str]:
    """Prefix and trailing number."""
    m = re.fullmatch(r"(.*?)(\d+)", token, re.S)
    return (m[1], m[2]) if m else (token, "")


def same_family(a: str, b: str) -> bool:
    (pa, sa), (pb, sb) = split_scale(a), split_scale(b)
    return bool(sa and sb and pa) and pa == pb and sa != sb


#: Irregular forms.
IRREGULAR_PLURALS = {"person": "people", "child": "children", "man": "men", "woman": "women", "datum": "data", "index": "indices", "index_": "indexes", "foot": "feet", "mouse": "mice"}


def pluralize(word: str) -> str:
    """The plural of an English noun by the regular rules and a short list."""
    if word in IRREGULAR_PLURALS:
        return IRREGULAR_PLURALS[word]
    if re.search("(s|x|z|ch|sh)$", word):
        return word + "es"
    if re.search("[^aeiou]y$", word):
        return word[:-1] + "ies"
    return word + "s"


def singularize(word: str) -> str:
    """The singular of an English noun by three endings: -ies, -es after ss, x and z, and -s.

    A mark at the end goes; words of up to two letters and words without such an ending pass.
    """
    base = word.rstrip("?!")
    if len(base) <= 2 or base.endswith("ss"):
        return base
    if base.endswith("ies"):
        return base[:-3] + "y"
    if base.endswith(("sses", "xes", "zes")):
        return base[:-2]
    return base[:-1] if base.endswith("s") else base


def pluralize_compound(name: str) -> str:
    head, _, last = name.rpartition("_")
    return f"{head}_{pluralize(last)}" if head else pluralize(last)


def past_participle(verb: str) -> str:
    """-e takes -d, consonant and -y becomes -ied, everything else takes -ed."""
    if verb.endswith("e"):
        return verb + "d"
    if re.search("[^aeiou]y$", verb):
        return verb[:-1] + "ied"
    return verb + "ed"


def constant_name(value: str) -> str | None:
    """A constant's stem from a literal: its words joined by underscores; None if nothing is nameable."""
    stem = "_".join(re.findall("[a-z0-9]+", value.lower()))
    return stem if re.match("[a-z]", stem) else None


def unclashed(name: str, taken: set[str]) -> str:
    """The name, or the first free one with a number after it."""
    if name not in taken:
        return name
    k = 2
    while f"{name}_{k}" in taken:
        k += 1
    return f"{name}_{k}"


def glob_regex(pattern: str) -> str:
    """A path glob (``*``, ``?``, ``**``, ``{a,b}``) as an anchored regular expression."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)))
        i += 1
    return "^" + "".join(out) + "$"


def module_tail(module: str) -> str:
    """A readable name from the last part of a dotted module name."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", module.rpartition(".")[2]).lower()


def common_module(names: Iterable[str]) -> str:
    """The longest common dotted prefix."""
    parts = [n.split(".") for n in names]
    out = []
    for column in zip(*parts):
        if len(set(column)) > 1:
            break
        out.append(column[0])
    return ".".join(out)
