"""Source rules: token templates and line rules, registered with the engine by name.

Each rule leaves the meaning of a text as it is, comes to rest after one application, and
does nothing where its pattern is not met exactly.
"""

from __future__ import annotations

import re

from coppice.functions.templates import Template, edits, tokens
from coppice.plans.engine import Rule, register
from coppice.sources.markup import Node, parse, walk

#: Tests for no elements and for some, and what is a range on its face.
ZERO_TESTS = [("{} == 0", ""), ("0 == {}", ""), ("{} > 0", "not "), ("{} != 0", "not "), ("0 < {}", "not "), ("0 != {}", "not ")]
RANGE = r"[\w.()]+?\.\.[\w()]+(?://\w+)?|Range\.new\(.*\)"

#: Each rule's templates, in order of preference.
TEMPLATES: dict[str, tuple[int, list[tuple[str, str]]]] = {
    "EnumIntoToMapNew": (140, [("Enum.into($a, %{})", "Map.new($a)"), ("|> Enum.into(%{})", "|> Map.new()")]),
    "EnumIntoToMapSet": (140, [("Enum.into($a, MapSet.new())", "MapSet.new($a)"), ("|> Enum.into(MapSet.new())", "|> MapSet.new()")]),
    "EnumMapIntoToMapNew": (145, [("|> Enum.map($f) |> Enum.into(%{})", "|> Map.new($f)"), ("Enum.map($a, $f) |> Enum.into(%{})", "Map.new($a, $f)"), ("Enum.into(Enum.map($a, $f), %{})", "Map.new($a, $f)")]),
    "EnumReduceToSum": (150, [("Enum.reduce($a, 0, fn $x, $acc -> $acc + $x end)", "Enum.sum($a)"), ("Enum.reduce($a, 0, fn $x, $acc -> $x + $acc end)", "Enum.sum($a)"), ("Enum.reduce($a, 0, &+/2)", "Enum.sum($a)")]),
    "EnumReverseConcat": (130, [("Enum.reverse($a) ++ $b", "Enum.reverse($a, $b)")]),
    "FilterCountToCount": (130, [("|> Enum.filter($p) |> Enum.count()", "|> Enum.count($p)"), ("Enum.filter($a, $p) |> Enum.count()", "Enum.count($a, $p)"), ("Enum.count(Enum.filter($a, $p))", "Enum.count($a, $p)")]),
    "FilterFirstToFind": (130, [("|> Enum.filter($p) |> List.first()", "|> Enum.find($p)"), ("|> Enum.filter($p) |> Enum.at(0)", "|> Enum.find($p)"), ("Enum.filter($a, $p) |> List.first()", "Enum.find($a, $p)"), ("Enum.filter($a, $p) |> Enum.at(0)", "Enum.find($a, $p)"), ("List.first(Enum.filter($a, $p))", "Enum.find($a, $p)")]),
    "FlatMapToFilter": (150, [("Enum.flat_map($a, fn $x -> if $c, do: [$x], else: [] end)", "Enum.filter($a, fn $x -> $c end)")]),
    "GraphemesLength": (130, [("String.graphemes($s) |> length()", "String.length($s)"), ("length(String.graphemes($s))", "String.length($s)"), ("|> String.graphemes() |> length()", "|> String.length()")]),
    "LengthZeroToEmpty": (130, [
        *[(test.format(f"{f}($a)"), f"{sign}Enum.empty?($a)", None, False) for f in ("length", "Enum.count") for test, sign in ZERO_TESTS],
        *[(f"|> {f}() == 0", "|> Enum.empty?()", None, False) for f in ("length", "Enum.count")],
        *[(f"$a |> {f}() {test} 0", "not ($a |> Enum.empty?())", None, False) for f in ("length", "Enum.count") for test in (">", "!=")],
        *[(test.format("Enum.count($a, $p)"), f"{'' if sign else 'not '}Enum.any?($a, $p)", None, False) for test, sign in ZERO_TESTS],
        *[(test.format("length($a)"), "is_list($a) and $a != []" if sign else "$a == []", None, True) for test, sign in ZERO_TESTS if ">" not in test and "<" not in test],
    ]),
    "ListLastOfReverse": (130, [("List.last(Enum.reverse($a))", "List.first($a)"), ("Enum.reverse($a) |> List.last()", "List.first($a)"), ("|> Enum.reverse() |> List.last()", "|> List.first()")]),
    "ListWrapConditional": (150, [("if is_list($x), do: $x, else: [$x]", "List.wrap($x)")]),
    "MapGetUnsafePass": (130, [*[(f"{m}.get($m, $k, nil)", f"{m}.get($m, $k)") for m in ("Map", "Keyword")], *[(f"|> {m}.get($k, nil)", f"|> {m}.get($k)") for m in ("Map", "Keyword")]]),
    "MapSumToSumBy": (130, [("|> Enum.map($f) |> Enum.sum()", "|> Enum.sum_by($f)"), ("Enum.map($a, $f) |> Enum.sum()", "Enum.sum_by($a, $f)"), ("Enum.sum(Enum.map($a, $f))", "Enum.sum_by($a, $f)")]),
    "MemberToInOperator": (130, [
        *[(f"{sign} Enum.member?($a, $x)", "$(x) not in $(a)", None, False) for sign in ("not", "!")],
        ("Enum.member?($a, $x)", "$(x) in $(a)", None, False),
        ("$a |> Enum.member?($x)", "$(x) in $a", None, False),
        ("Enum.member?($a, $x)", "$(x) in $a", {"$a": r"\[.*\]|~w.*"}, True),
    ]),
    "RangeToListRedundant": (130, [
        *[(f"Enum.to_list($r) |> {m}.", f"$r |> {m}.", {"$r": RANGE}) for m in ("Enum", "Stream")],
        *[(f"$r |> Enum.to_list() |> {m}.", f"$r |> {m}.", {"$r": RANGE}) for m in ("Enum", "Stream")],
        *[(f"{m}.{f}(Enum.to_list($r), $f)", f"{m}.{f}($r, $f)", {"$r": RANGE}) for m in ("Enum", "Stream") for f in ("each", "filter", "flat_map", "map", "reject")],
    ]),
    "RejectIsNil": (150, [("Enum.reject($a, fn $x -> is_nil($x) end)", "Enum.reject($a, &is_nil/1)"), ("Enum.filter($a, fn $x -> not is_nil($x) end)", "Enum.reject($a, &is_nil/1)"), ("Enum.filter($a, fn $x -> $x != nil end)", "Enum.reject($a, &is_nil/1)"), ("Enum.reject($a, fn $x -> $x == nil end)", "Enum.reject($a, &is_nil/1)")]),
    "ReduceAsMap": (150, [("Enum.reduce($a, [], fn $x, $acc -> [$f | $acc] end) |> Enum.reverse()", "Enum.map($a, fn $x -> $f end)")]),
    "ReduceMapPut": (150, [("Enum.reduce($a, %{}, fn $x, $acc -> Map.put($acc, $k, $v) end)", "Map.new($a, fn $x -> {$k, $v} end)")]),
    "ReduceToNamedAggregate": (150, [
        ("Enum.reduce($a, 1, fn $x, $acc -> $acc * $x end)", "Enum.product($a)"),
        ("Enum.reduce($a, %{}, fn $x, $acc -> Map.update($acc, $x, 1, &(&1 + 1)) end)", "Enum.frequencies($a)"),
        *[(f"Enum.reduce($a, 1, fn $x, $acc -> {e} end)", "Enum.product_by($a, fn $x -> $v end)", {"$v": r"[\w.]+"}) for e in ("$acc * $v", "$v * $acc")],
        *[(f"{call}%{{}}, fn $x, $acc -> Map.update($acc, $k, 1, {more}) end)", f"{to}fn $x -> $k end)") for call, to in (("Enum.reduce($a, ", "Enum.frequencies_by($a, "), ("|> Enum.reduce(", "|> Enum.frequencies_by(")) for more in ("&(&1 + 1)", "fn $c -> $c + 1 end")],
        *[(f"{call}%{{}}, fn $x, $acc -> Map.update($acc, $k, [{v}], {more}) end)", f"{to}fn $x -> $k end{by})")
          for call, to in (("Enum.reduce($a, ", "Enum.group_by($a, "), ("|> Enum.reduce(", "|> Enum.group_by("))
          for v, by in (("$x", ""), ("$v", ", fn $x -> $v end"))
          for more in (f"&[{v} | &1]", f"fn $c -> [{v} | $c] end")],
    ]),
    "SortForTopK": (130, [
        *[(f"|> Enum.sort({o}) |> {take}", f"|> Enum.{m}()") for o, m in (("", "min"), (":desc", "max")) for take in ("hd()", "Enum.take(1)")],
        *[(f"Enum.sort($a{o}) |> hd()", f"Enum.{m}($a)") for o, m in (("", "min"), (", :desc", "max"))],
        *[(f"hd(Enum.sort($a{o}))", f"Enum.{m}($a)") for o, m in (("", "min"), (", :desc", "max"))],
        *[(f"Enum.take(Enum.sort($a{o}), 1)", f"[Enum.{m}($a)]") for o, m in (("", "min"), (", :desc", "max"))],
    ]),
    "SortReverseToDesc": (130, [("|> Enum.sort() |> Enum.reverse()", "|> Enum.sort(:desc)"), ("Enum.sort($a) |> Enum.reverse()", "Enum.sort($a, :desc)"), ("Enum.reverse(Enum.sort($a))", "Enum.sort($a, :desc)")]),
    "UseMapJoin": (130, [("|> Enum.map($f) |> Enum.join($s)", "|> Enum.map_join($s, $f)"), ("Enum.map($a, $f) |> Enum.join($s)", "Enum.map_join($a, $s, $f)"), ("Enum.join(Enum.map($a, $f), $s)", "Enum.map_join($a, $s, $f)")]),
    "UtcNowTruncate": (130, [("DateTime.utc_now() |> DateTime.truncate($p)", "DateTime.utc_now($p)"), ("DateTime.truncate(DateTime.utc_now(), $p)", "DateTime.utc_now($p)")]),
    "RedundantBooleanIf": (120, [("if $c, do: true, else: false", "$c")]),
    "DebugInspectCleanup": (110, [("|> IO.inspect()", "|> dbg()"), ("|> IO.inspect($o)", "|> dbg()", {"$o": r"\w+:.*"}), ("IO.inspect($x)", "dbg($x)", {"$x": r"(?!\w+: ).*"}), ("IO.inspect($x, $o)", "dbg($x)", {"$o": r"\w+:.*"})]),
    "ManualTapToTap": (130, [("|> then(fn $x -> $e; $x end)", "|> tap(fn $x -> $e end)")]),
    "TryRescueWithSafeAlternative": (120, [(f"try do {m}.fetch!($m, $k) rescue $e -> $d end", f"{m}.get($m, $k, $d)", {"$e": r"_\w*"}) for m in ("Map", "Keyword")]),
    "EnumFindToKeyfind": (130, [
        *[(f"{call}fn {{{head}}} -> {test} end)", f"{to}$v, {at})", {"$k": r"[a-z]\w*", "$v": r"(?!.*\b_).*", **{w: r"_\w*" for w in ("$w", "$z") if w in head}})
          for call, to in (("Enum.find($a, ", "List.keyfind($a, "), ("|> Enum.find(", "|> List.keyfind("))
          for head, at in (("$k, $w", 0), ("$w, $k", 1), ("$k, $w, $z", 0), ("$w, $k, $z", 1), ("$w, $z, $k", 2))
          for test in ("$k == $v", "$v == $k")],
        *[(f"Enum.find($a, fn $t -> elem($t, {at}) == $v end)", f"List.keyfind($a, $v, {at})") for at in range(3)],
    ]),
}
#: What may stand in a guard, and one statement on one line.
GUARD = r"(?:is_\w+\(\w+\)|\w+ (?:==|!=|>|<|>=|<=) [\w:.\"]+)(?: (?:and|or) (?:is_\w+\(\w+\)|\w+ (?:==|!=|>|<|>=|<=) [\w:.\"]+))*"
ONE_LINE = r"(?!(?:case|cond|if|with|fn|for|try)\b)[^\n;]+"

CONDITIONALS: dict[str, tuple[int, list[tuple]]] = {
    "CaseTrueFalse": (120, [("case $c do true -> $a false -> $b end", "if $c, do: $a, else: $b", {"$a": ONE_LINE, "$b": ONE_LINE}), ("case $c do false -> $b true -> $a end", "if $c, do: $a, else: $b", {"$a": ONE_LINE, "$b": ONE_LINE})]),
    "IdentityPassthrough": (120, [("case $x do $p -> $p end", "$x", {"$p": r"[a-z]\w*"}), ("case $x do {:ok, $v} -> {:ok, $v} {:error, $e} -> {:error, $e} end", "$x")]),
    "CollapseNestedCaseToWith": (120, [("case $a do {:ok, $x} -> case $b do {:ok, $y} -> $c {:error, $e} -> {:error, $e} end {:error, $f} -> {:error, $f} end", "with {:ok, $x} <- $a, {:ok, $y} <- $b do\n  $c\nend")]),
    "CollapseRichCaseToWithElse": (119, [("case $a do {:ok, $x} -> case $b do {:ok, $y} -> $c {:error, $e} -> $h end {:error, $e} -> $h end", "with {:ok, $x} <- $a, {:ok, $y} <- $b do\n  $c\nelse\n  {:error, $e} -> $h\nend")]),
    "RemoveTrivialElseClause": (121, [("with $h do $b else $e -> $e end", "with $h do\n  $b\nend", {"$e": r"[a-z]\w*"}), ("with $h do $b else {:error, $e} -> {:error, $e} end", "with $h do\n  $b\nend", {"$e": r"[a-z]\w*"})]),
    "WithWithoutElse": (122, [("with $g, $h do $b else $e -> $e end", "with $g, $h do\n  $b\nend", {"$e": r"[a-z]\w*"})]),
    "WithSingleClauseToCase": (115, [("with $p <- $e do $b else $q -> $c end", "case $e do\n  $p -> $b\n  $q -> $c\nend", {"$b": ONE_LINE, "$c": ONE_LINE})]),
    "IfElseToCond": (80, [("if $a do $x else if $b do $y else $z end end", "cond do\n  $a -> $x\n  $b -> $y\n  true -> $z\nend", {"$x": ONE_LINE, "$y": ONE_LINE, "$z": ONE_LINE})]),
    "ExtractCondIfGuardClauses": (60, [("def $h do if $g, do: $x, else: $y end", "def $h when $g, do: $x\ndef $h, do: $y", {"$g": GUARD, "$h": r"\w+\(.*\)"})]),
    "ExtractCondToGuardClauses": (60, [("def $h do cond do $g -> $x true -> $y end end", "def $h when $g, do: $x\ndef $h, do: $y", {"$g": GUARD, "$h": r"\w+\(.*\)", "$x": ONE_LINE, "$y": ONE_LINE})]),
    "IfLiftToClauses": (60, [("def $h do if $g do $x else $y end end", "def $h when $g, do: $x\ndef $h, do: $y", {"$g": GUARD, "$h": r"\w+\(.*\)", "$x": ONE_LINE, "$y": ONE_LINE})]),
    "InlineSingleExpressionDef": (50, [("def $h do $e end", "def $h, do: $e", {"$h": r"\w+(?:\(.*\))?", "$e": ONE_LINE}), ("defp $h do $e end", "defp $h, do: $e", {"$h": r"\w+(?:\(.*\))?", "$e": ONE_LINE})]),
    "LambdaDestructureToHead": (150, [("fn $x -> $p = $x; $b end", "fn $p -> $b end", {"$p": r"[{\[%].*"})]),
    "MergePipelineIntoComprehension": (100, [("$a |> Enum.filter(fn $x -> $p end) |> Enum.map(fn $x -> $f end)", "for $x <- $a, $p, do: $f", {"$x": r"[a-z]\w*"}), ("$a |> Enum.reject(fn $x -> $p end) |> Enum.map(fn $x -> $f end)", "for $x <- $a, not ($p), do: $f", {"$x": r"[a-z]\w*"})]),
}
OFF_BY_DEFAULT = {"RangeLiteralToRangeNew": (150, [("$a..$b", "Range.new($a, $b)")]), "MapNewToPipe": (130, [("Map.new($a)", "$a |> Map.new()")]), "MapNewLambdaToForComprehension": (170, [("Map.new($a, fn $x -> {$k, $v} end)", "for($x <- $a, do: {$k, $v}) |> Map.new()")]), "ExtractToPipeline": (180, [("Enum.map($a, $f)", "$a |> Enum.map($f)"), ("Enum.filter($a, $f)", "$a |> Enum.filter($f)"), ("Enum.reject($a, $f)", "$a |> Enum.reject($f)"), ("Stream.map($a, $f)", "$a |> Stream.map($f)")])}

for _table, _on in ((TEMPLATES, True), (CONDITIONALS, True), (OFF_BY_DEFAULT, False)):
    for _name, (_priority, _pairs) in _table.items():
        register(Rule(_name, patches=lambda text, _, t=[Template(*p) for p in _pairs]: edits(text, t), priority=_priority, enabled=_on))


_LOGGED = [Template("|> IO.inspect()", "|> inspect() |> Logger.debug()"), Template("IO.inspect($x)", "Logger.debug(inspect($x))", {"$x": r"(?!\w+: ).*"}), Template("IO.inspect($x, $o)", "Logger.debug(inspect($x))", {"$o": r"\w+:.*"})]
register(Rule("DebugInspectCleanup", patches=lambda text, options: edits(text, _LOGGED if options.get("target") == "logger" else [Template(*p) for p in TEMPLATES["DebugInspectCleanup"][1]]), priority=110))

_ALIAS = re.compile(r"^([ \t]*)alias [\w.]+(?:,[^\n]*)?$")


def alias_order(text: str, _: dict) -> str:
    """Sorts each run of alias lines."""
    lines = text.split("\n")
    i = 0
    while i < len(lines):
        j = i
        while j < len(lines) and _ALIAS.match(lines[j]):
            j += 1
        if j - i > 1:
            lines[i:j] = sorted(lines[i:j], key=lambda line: line.strip().lower())
        i = max(j, i + 1)
    return "\n".join(lines)


def multi_alias_expand(text: str, _: dict) -> str:
    """One alias a line for each name in braces."""
    expand = lambda m: "\n".join(f"{m[1]}alias {m[2]}.{name.strip()}" for name in m[3].split(",") if name.strip())
    return re.sub(r"^([ \t]*)alias ([\w.]+)\.\{([^}]*)\}[ \t]*$", expand, text, flags=re.M)


def import_after_alias(text: str, _: dict) -> str:
    """Moves import lines of a run of directives behind its aliases."""
    lines = text.split("\n")
    i = 0
    while i < len(lines):
        j = i
        while j < len(lines) and re.match(r"^[ \t]*(alias|import) ", lines[j]):
            j += 1
        if j - i > 1:
            lines[i:j] = sorted(lines[i:j], key=lambda line: line.lstrip().startswith("import"))
        i = max(j, i + 1)
    return "\n".join(lines)


def no_blank_after_attribute(text: str, _: dict) -> str:
    """No blank lines between an attribute of a function and its definition."""
    return re.sub(r"^([ \t]*@(?:spec|doc|impl|deprecated)\b[^\n]*)\n(?:[ \t]*\n)+(?=[ \t]*(?:def|defp|@spec|@doc|@impl)\b)", r"\1\n", text, flags=re.M)


def _clauses(text: str) -> list[tuple[int, int]]:
    """Spans of the function clauses of a text, by the indentation of their heads; the whole text if it has none."""
    heads = [(m.start(), len(m[1])) for m in re.finditer(r"^([ \t]*)defp?\b", text, flags=re.M)]
    if not heads:
        return [(0, len(text))]
    return [(a, heads[k + 1][0] if k + 1 < len(heads) else len(text)) for k, (a, _) in enumerate(heads)]


def negated_boolean_name(text: str, options: dict) -> str:
    """A bound not_<stem> takes the stem's antonym, or the stem itself, in its function clause, unless the name is taken there.

    ``known`` maps whole names and goes first.
    """
    known, out, done = options.get("known", {}), [], 0
    for a, b in _clauses(text):
        body = text[a:b]
        for name in dict.fromkeys(re.findall(r"\b(not_[a-z]\w*)[ \t]*=(?![=~>])", body)):
            stem = name.removeprefix("not_")
            positive = known.get(name, ANTONYMS.get(stem, stem))
            if not re.search(rf"\b{positive}\b(?![?!(:])", body):
                body = re.sub(rf"(?<![.:@])\b{name}\b(?![?!(:])", positive, body)
        out += [text[done:a], body]
        done = b
    return "".join(out) + text[done:]


#: Words and their antonyms, in both directions.
ANTONYM_PAIRS = [("valid", "invalid"), ("authorized", "unauthorized"), ("enabled", "disabled"), ("present", "absent"), ("allowed", "forbidden"), ("active", "inactive"), ("visible", "hidden"), ("empty", "full")]
ANTONYMS = {x: y for one, other in ANTONYM_PAIRS for x, y in ((one, other), (other, one))}


def length_in_guard(text: str, _: dict) -> str:
    """A clause that asks for a list of some length by a guard asks by patterns, where a clause that takes all follows it.

    ``length(x) > n`` and ``>= n`` become a head of n cells and a rest; the shorter lists, which
    the following clause would have taken, get clauses with its body before it.
    """

    def turn(m: re.Match) -> str:
        lead, head, name, test, number, body, other = m["lead"], m["head"], m["name"], m["test"], int(m["n"]), m["body"], m["other"]
        least = number + (test == ">")
        if not 1 <= least <= 4 or m["all"] != "_" and re.search(rf"\b{m['all']}\b", other):
            return m[0]
        bound = lambda n, tail: "[" + ", ".join(["_"] * n) + (" | _" if tail else "") + "]"
        used = f" = {name}" if re.search(rf"\b{name}\b", body) else ""
        out = [f"{lead}{head}({bound(least, True)}{used}), do: {body}"] + [f"{lead}{head}({bound(n, False)}), do: {other}" for n in range(least)]
        return "\n".join([*out, f"{lead}{head}(_), do: {other}"])

    clause = r"^(?P<lead>[ \t]*)(?P<head>defp? \w+[?!]?)\((?P<name>[a-z]\w*)\) when length\((?P=name)\) (?P<test>>=?) (?P<n>\d+), do: (?P<body>[^\n]+)\n(?P=lead)(?P=head)\((?P<all>_\w*)\), do: (?P<other>[^\n]+)$"
    return re.sub(clause, turn, text, flags=re.M)


#: Headings, and elements that only wrap.
WRAPPERS = {"div", "span", "section", "article", "main", "aside"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "header"}


def unwrap_span_in_heading(text: str, _: dict) -> list[tuple[int, int, str]]:
    """Spans without attributes anywhere in a heading give way to what they hold; a class moves to a heading that has no attributes and no other child."""
    out: list[tuple[int, int, str]] = []
    waiting = [(node, False) for node in reversed(parse(text))]
    while waiting:
        node, heading = waiting.pop()
        heading = heading or node.kind == "element" and node.name in HEADINGS
        for child in reversed(node.children):
            if child.kind != "element":
                continue
            raw = text[child.start : child.stop]
            inner = raw[raw.index(">") + 1 : raw.rindex("</") if "</" in raw else len(raw)]
            if heading and child.name == "span" and not child.attributes:
                out.append((child.start, child.stop, inner))
            elif child.name == "span" and [n for n, _, _ in child.attributes] == ["class"] and node.name in HEADINGS and not node.attributes and _only(text, node, child):
                head = text[node.start : child.start]
                out.append((node.start, child.stop, f"<{node.name} {raw[raw.index('class') : raw.index('>')].strip()}>{head[head.index('>') + 1 :]}{inner}"))
            else:
                waiting.append((child, heading))
    return out


def _only(text: str, node: Node, child: Node) -> bool:
    """Whether nothing but blanks stands beside the child."""
    raw = text[node.start : node.stop]
    begin, end = node.start + raw.index(">") + 1, node.start + (raw.rindex("</") if "</" in raw else len(raw))
    return not (text[begin : child.start] + text[child.stop : end]).strip()


def collapse_nesting(text: str, _: dict) -> list[tuple[int, int, str]]:
    """A wrapper without attributes around one element whose only attribute is its class gives way to it."""
    out: list[tuple[int, int, str]] = []
    for node in walk(parse(text)):
        if node.kind == "element" and node.name in WRAPPERS and not node.attributes and len(node.children) == 1:
            (child,) = node.children
            if child.kind == "element" and child.name == node.name and [n for n, _, _ in child.attributes] == ["class"] and all(not (a <= node.start < b) for a, b, _ in out):
                out.append((node.start, node.stop, text[child.start : child.stop]))
    return out


def cond_to_case(text: str, _: dict) -> str:
    """A cond whose arms all compare one variable with a value becomes a case on it."""

    def turn(m: re.Match) -> str:
        arms = [re.fullmatch(r"(\s*)(?:(\w+) == ([^\n]+?)|true) ->([^\n]*)", line) for line in m[2].rstrip("\n").split("\n")]
        if not all(arms) or len({a[2] for a in arms if a[2]}) != 1 or any(a[2] is None for a in arms[:-1]) or len(arms) < 2:
            return m[0]
        name = arms[0][2]
        return f"{m[1]}case {name} do\n" + "".join(f"{a[1]}{a[3] if a[2] else '_'} ->{a[4]}\n" for a in arms) + f"{m[1]}end"

    return re.sub(r"^([ \t]*)cond do\n((?:(?!\s*end\b)[^\n]*\n)+)\1end", turn, text, flags=re.M)


def map_put_chain(text: str, _: dict) -> str:
    """An empty map that the next lines fill key by key becomes a literal."""

    def turn(m: re.Match) -> str:
        puts = re.findall(rf"^[ \t]*{m[2]} = Map\.put\({m[2]}, ([^,\n]+), ([^\n]+)\)$", m[3], flags=re.M)
        if any(re.search(rf"\b{m[2]}\b", v) for _, v in puts):
            return m[0]
        return f"{m[1]}{m[2]} = %{{{', '.join(f'{k} => {v}' for k, v in puts)}}}\n"

    return re.sub(r"^([ \t]*)(\w+) = %\{\}\n((?:[ \t]*\2 = Map\.put\(\2, [^\n]+\)\n)+)", turn, text, flags=re.M)


def clause_lookup(text: str, options: dict) -> str:
    """Three or more clauses from a literal to a constant become a map; the first of a literal wins."""
    least = options.get("least", 3)

    def turn(m: re.Match) -> str:
        arms = re.findall(r"def(p?) (\w+)\((\"[^\"\n]*\"|:\w+|-?\d+)\), do: (\"[^\"\n]*\"|:\w+|-?\d+)\n", m[0])
        if len(arms) < least:
            return m[0]
        table = {k: v for _, _, k, v in reversed(arms)}
        pairs = ", ".join(f"{k} => {table[k]}" for k in dict.fromkeys(k for _, _, k, _ in arms))
        private, name = arms[0][0], arms[0][1]
        return f"{m[1]}@{name}_lookup %{{{pairs}}}\n{m[1]}def{private} {name}(key), do: Map.fetch!(@{name}_lookup, key)\n"

    literal = r"(?:\"[^\"\n]*\"|:\w+|-?\d+)"
    return re.sub(rf"^([ \t]*)(defp? \w+)\({literal}\), do: {literal}\n(?:\1\2\({literal}\), do: {literal}\n)+(?!\1\2\()", turn, text, flags=re.M)


def case_to_clauses(text: str, _: dict) -> str:
    """A function that is one case on its only parameter becomes a clause for each arm."""

    def turn(m: re.Match) -> str:
        arms = [re.fullmatch(r"\s*([^\n]+?) -> ([^\n]+)", line) for line in m[5].rstrip("\n").split("\n")]
        if not all(arms) or any(re.search(rf"\b{m[4]}\b", a[2]) or " when " in a[1] for a in arms):
            return m[0]
        return "\n".join(f"{m[1]}{m[2]} {m[3]}({a[1]}), do: {a[2]}" for a in arms)

    return re.sub(r"^([ \t]*)(defp?) (\w+[?!]?)\((\w+)\) do\n\s*case \4 do\n((?:(?!\s*end\b)[^\n]*\n)+)\s*end\n\1end", turn, text, flags=re.M)


def enum_capture(text: str, _: dict) -> list[tuple[int, int, str]]:
    """A lambda that only calls a function with its argument becomes a capture."""
    stream = [t for t in tokens(text) if t.kind != "newline"]
    out = []
    for k, t in enumerate(stream):
        if t.text != "fn" or k + 3 >= len(stream) or stream[k + 2].text != "->":
            continue
        j = k + 3
        while j + 1 < len(stream) and stream[j + 1].text == ".":
            j += 2
        call = [x.text for x in stream[j + 1 : j + 5]]
        if call == ["(", stream[k + 1].text, ")", "end"] and stream[j].kind == "word":
            out.append((t.start, stream[j + 4].stop, f"&{text[stream[k + 3].start : stream[j].stop]}/1"))
    return out


def socket_to_pipe(text: str, _: dict) -> list[tuple[int, int, str]]:
    """A local call whose first argument is the socket takes it from a pipe."""
    stream = [t for t in tokens(text) if t.kind != "newline"]
    out: list[tuple[int, int, str]] = []
    for k in range(len(stream) - 3):
        name, bracket, first, after = stream[k : k + 4]
        before = stream[k - 1].text if k else ""
        if name.kind == "word" and bracket.text == "(" and bracket.start == name.stop and first.text == "socket" and after.text in (",", ")") and before not in ("def", "defp", ".", "|>", "&") and all(name.start >= o[1] for o in out):
            depth, j = 0, k + 1
            while j < len(stream):
                depth += (stream[j].text in "([{") - (stream[j].text in ")]}")
                if not depth:
                    break
                j += 1
            if j < len(stream):
                rest = text[after.stop : stream[j].start].strip() if after.text == "," else ""
                out.append((name.start, stream[j].stop, f"socket |> {name.text}({rest})"))
    return out


for _rule in (
    Rule("LengthInGuard", rewrite=length_in_guard, priority=120),
    Rule("CondToCase", rewrite=cond_to_case),
    Rule("MapPutChainToLiteral", rewrite=map_put_chain, priority=150),
    Rule("ClauseLookupToMap", rewrite=clause_lookup),
    Rule("CaseToFunctionClauses", rewrite=case_to_clauses),
    Rule("EnumCapture", patches=enum_capture, priority=150),
    Rule("ExtractSocketToPipe", patches=socket_to_pipe, priority=200),
    Rule("AliasOrder", rewrite=alias_order),
    Rule("MultiAliasExpand", rewrite=multi_alias_expand, priority=220),
    Rule("ImportAfterAlias", rewrite=import_after_alias),
    Rule("RemoveBlankBetweenAttrAndDef", rewrite=no_blank_after_attribute, priority=10),
    Rule("NegatedBooleanName", rewrite=negated_boolean_name),
    Rule("UnwrapSpanInHeading", patches=unwrap_span_in_heading),
    Rule("CollapseRedundantHeexNesting", patches=collapse_nesting),
):
    register(_rule)
