"""What a cut-out subtree of a template needs and could be called: types, free assigns, name."""

from __future__ import annotations

import re
from collections import Counter

from coppice.functions.naming import unclashed
from coppice.functions.templates import tokens
from coppice.functions.trees import structure_motif
from coppice.sources.markup import Node, walk


def codes(node: Node) -> list[tuple[str, str]]:
    """(where, code) of a node's own expressions; ``where`` is for, attribute, block or expr."""
    out = [("for" if name == ":for" else "attribute", value) for name, kind, value in node.attributes if kind == "expr"]
    if node.kind in ("expr", "block"):
        out.append((node.kind, node.name))
    return out


def assigns(node: Node) -> list[str]:
    """Assigns of a subtree in order of first use."""
    found = (a for n in walk([node]) for _, code in codes(n) for a in re.findall(r"@([a-z_][a-zA-Z0-9_]*)", code))
    return list(dict.fromkeys(found))


def assign_type(assign: str, root: Node) -> str:
    """list, boolean or string where all strong signals agree, else any.

    Signals: a loop's source or the first argument of Enum or Stream; the operand of a
    negation; a side of a concatenation or the first argument of String.
    """
    name, found = f"@{assign}", set()
    for node in walk([root]):
        for where, code in codes(node):
            t = [x.text for x in tokens(code) if x.kind != "newline"]
            loop = where == "for" or where == "block" and "for " in code
            for k, x in enumerate(t):
                if x != name or k + 1 < len(t) and t[k + 1] == ".":
                    continue
                before, call = t[k - 1] if k else "", t[max(0, k - 4) : k]
                if loop and before == "<-" and t[k + 1 : k + 2] in ([], ["do"], [")"], [","]):
                    found.add("list")
                elif loop and where != "block":
                    continue
                elif before in ("not", "!"):
                    found.add("boolean")
                elif before == "<>" or t[k + 1 : k + 2] == ["<>"]:
                    found.add("string")
                elif len(call) == 4 and call[1] == "." and call[3] == "(" and call[0] in ("String", "Enum", "Stream"):
                    found.add("string" if call[0] == "String" else "list")
    return found.pop() if len(found) == 1 else "any"


def free_variables(root: Node) -> list[str]:
    """Plain variables that a subtree reads and nothing inside it binds (by loop, :let or fn)."""
    used: dict[str, None] = {}
    bound: set[str] = set()
    for node in walk([root]):
        for name, kind, value in node.attributes:
            if name == ":let" and kind == "expr":
                bound |= set(re.findall(r"\b[a-z_]\w*\b", value))
        for where, code in codes(node):
            t = [x for x in tokens(code) if x.kind != "newline"]
            for k, x in enumerate(t):
                if x.text == "<-":
                    j = k - 1
                    while j >= 0 and t[j].text not in (",", "for") or j >= 0 and any(y.text in "}])" for y in t[j:k]) and not any(y.text in "{[(" for y in t[j:k]):
                        if re.fullmatch(r"[a-z_]\w*", t[j].text):
                            bound.add(t[j].text)
                        j -= 1
                if x.text == "fn":
                    for y in t[k + 1 :]:
                        if y.text == "->":
                            break
                        if re.fullmatch(r"[a-z_]\w*", y.text):
                            bound.add(y.text)
                call = k + 1 < len(t) and t[k + 1].text == "(" and t[k + 1].start == x.stop
                field = k and t[k - 1].text == "."
                if re.fullmatch(r"[a-z_]\w*", x.text) and not call and not field and x.text not in KEYWORDS:
                    used[x.text] = None
    return [v for v in used if v not in bound]


#: Words that are no variables, tags and classes that name a part of a page.
KEYWORDS = frozenset("do end fn for if else case cond when and or not in true false nil".split())
SEMANTIC_TAGS = frozenset("section article header footer aside main nav table form dialog fieldset details figure".split())
CLASS_NOUNS = frozenset(
    "card panel sidebar list item row cell modal dialog badge avatar banner hero toolbar menu nav tab breadcrumb pagination alert toast tooltip dropdown accordion stepper timeline grid gallery thumbnail preview summary detail widget tile chip pill".split()
)
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6", ".header"])


def slug(text: str, most: int = 40) -> str:
    """A snake-case name of at most ``most`` characters, cut between words."""
    out = ""
    for word in re.findall("[a-z0-9]+", text.lower()):
        longer = f"{out}_{word}" if out else word
        if len(longer) > most:
            break
        out = longer
    return out if re.match("[a-z]", out) else ""


def component_name(root: Node, taken: set[str] = frozenset(), fallback: str = "component") -> str:
    """A name for a subtree: by motif and collection, semantic tag, class noun, heading, message, dominant assign."""

    def sources():
        motif = structure_motif(root)
        uses = Counter(a for n in walk([root]) for _, code in codes(n) for a in re.findall(r"@([a-z_][a-zA-Z0-9_]*)", code))
        if motif != "unknown":
            looped = next((m[-1] for n in walk([root]) for where, code in codes(n) if (m := re.findall(r"<-\s*@?(?:[a-z_]\w*\.)*([a-z_]\w*)", code)) and where in ("for", "block")), None)
            collection = looped or (uses.most_common(1)[0][0] if uses else "")
            word = motif.rpartition("_")[2] if collection else motif
            yield f"{collection}_{word}" if collection else motif
        if root.kind == "element" and root.name in SEMANTIC_TAGS:
            yield root.name
        for n in walk([root]):
            words = re.findall("[a-z]+", next((v for a, k, v in n.attributes if a == "class" and k == "string"), "").lower())
            yield from (w for w in words if w in CLASS_NOUNS)
        for n in walk([root]):
            if n.name in HEADINGS:
                yield " ".join(c.name for c in walk(n.children) if c.kind == "text")
        for n in walk([root]):
            for _, code in codes(n):
                yield from re.findall(r'gettext\("([^"]*)"', code)
        if uses:
            yield uses.most_common(1)[0][0]

    return unclashed(next((s for s in map(slug, sources()) if s), fallback), set(taken))
