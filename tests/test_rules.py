"""The engine, findings, source rules and detectors."""

import pytest
from pyspark.sql import functions as F

import coppice.operators.detectors  # noqa: F401
import coppice.operators.source_rules  # noqa: F401
from coppice.functions.templates import Template, tokens
from coppice.plans import engine
from coppice.plans import findings as fnd

#: Further shapes of the rules: tests reversed, negated, in guards and in pipes.
SHAPES = [
    *[("LengthZeroToEmpty", t.format(f"{f}(q)"), "Enum.empty?(q)") for f in ("length", "Enum.count") for t in ("{} == 0", "0 == {}")],
    *[("LengthZeroToEmpty", t.format(f"{f}(q)"), "not Enum.empty?(q)") for f in ("length", "Enum.count") for t in ("{} > 0", "{} != 0", "0 < {}", "0 != {}")],
    ("LengthZeroToEmpty", "q |> f() |> length() == 0", "q |> f() |> Enum.empty?()"),
    ("LengthZeroToEmpty", "q |> Enum.count() > 0", "not (q |> Enum.empty?())"),
    ("LengthZeroToEmpty", "Enum.count(q, &odd?/1) == 0", "not Enum.any?(q, &odd?/1)"),
    ("LengthZeroToEmpty", "0 != Enum.count(q, &odd?/1)", "Enum.any?(q, &odd?/1)"),
    ("LengthZeroToEmpty", "def f(q) when 0 == length(q), do: 1", "def f(q) when q == [], do: 1"),
    ("LengthZeroToEmpty", "def f(q) when length(q) != 0, do: 1", "def f(q) when is_list(q) and q != [], do: 1"),
    ("LengthInGuard", "def f(q) when length(q) >= 2, do: g(q)\ndef f(_q), do: 0", "def f([_, _ | _] = q), do: g(q)\ndef f([]), do: 0\ndef f([_]), do: 0\ndef f(_), do: 0"),
    ("RangeToListRedundant", "Enum.to_list(a..b//2) |> Stream.map(f)", "a..b//2 |> Stream.map(f)"),
    ("RangeToListRedundant", "Enum.filter(Enum.to_list(a..b), f)", "Enum.filter(a..b, f)"),
    ("RangeToListRedundant", "1..n |> Enum.to_list() |> Enum.each(f)", "1..n |> Enum.each(f)"),
    ("RangeToListRedundant", "Enum.to_list(Range.new(1, n)) |> Enum.map(f)", "Range.new(1, n) |> Enum.map(f)"),
    ("MemberToInOperator", "not Enum.member?(ids, id)", "id not in ids"),
    ("MemberToInOperator", "!Enum.member?(ids, id)", "id not in ids"),
    ("MemberToInOperator", "ids |> Enum.member?(id)", "id in ids"),
    ("MemberToInOperator", "Enum.member?(a ++ b, x || y)", "(x || y) in (a ++ b)"),
    ("MemberToInOperator", "def f(x) when Enum.member?([1, 2], x), do: x", "def f(x) when x in [1, 2], do: x"),
    ("MapGetUnsafePass", "m |> Keyword.get(:k, nil)", "m |> Keyword.get(:k)"),
    ("SortForTopK", "q |> Enum.sort(:desc) |> Enum.take(1)", "q |> Enum.max()"),
    ("SortForTopK", "Enum.take(Enum.sort(q), 1)", "[Enum.min(q)]"),
    ("DebugInspectCleanup", 'IO.inspect(x, label: "here")', "dbg(x)"),
    ("DebugInspectCleanup", 'x |> IO.inspect(label: "here")', "x |> dbg()"),
    ("TryRescueWithSafeAlternative", "try do\n  Map.fetch!(m, :k)\nrescue\n  _e -> 0\nend", "Map.get(m, :k, 0)"),
    ("EnumFindToKeyfind", "Enum.find(q, fn {_, v} -> want == v end)", "List.keyfind(q, want, 1)"),
    ("EnumFindToKeyfind", "Enum.find(q, fn {t, _, _rest} -> t == :b end)", "List.keyfind(q, :b, 0)"),
    ("EnumFindToKeyfind", "q |> g() |> Enum.find(fn {t, _} -> t == w end)", "q |> g() |> List.keyfind(w, 0)"),
    ("EnumFindToKeyfind", "Enum.find(q, fn t -> elem(t, 1) == w end)", "List.keyfind(q, w, 1)"),
    ("ReduceToNamedAggregate", "Enum.reduce(q, 1, fn x, acc -> x.w * acc end)", "Enum.product_by(q, fn x -> x.w end)"),
    ("ReduceToNamedAggregate", "Enum.reduce(q, %{}, fn x, acc -> Map.update(acc, x.k, 1, fn c -> c + 1 end) end)", "Enum.frequencies_by(q, fn x -> x.k end)"),
    ("ReduceToNamedAggregate", "q |> Enum.reduce(%{}, fn x, acc -> Map.update(acc, x.k, [x], &[x | &1]) end)", "q |> Enum.group_by(fn x -> x.k end)"),
    ("ReduceToNamedAggregate", "Enum.reduce(q, %{}, fn x, acc -> Map.update(acc, x.k, [x.v], &[x.v | &1]) end)", "Enum.group_by(q, fn x -> x.k end, fn x -> x.v end)"),
]

#: Texts that a rule must leave as they are.
ALONE = [
    ("LengthZeroToEmpty", "def f(x) when Enum.count(x) == 0, do: 1"),
    ("LengthZeroToEmpty", "Enum.count(x) >= 0"),
    ("LengthZeroToEmpty", "length(x) == 5"),
    ("LengthInGuard", "def f(x) when length(x) == 0, do: 1\ndef f(_), do: 2"),
    ("LengthInGuard", "def f(x) when length(@q) > 0, do: x\ndef f(_), do: nil"),
    ("RangeToListRedundant", "Enum.to_list(some) |> Enum.map(f)"),
    ("RangeToListRedundant", "Enum.to_list(1..n) |> IO.inspect()"),
    ("RangeToListRedundant", "Enum.to_list([1, 2]) |> Enum.map(f)"),
    ("MemberToInOperator", "def f(x, q) when Enum.member?(q, x), do: x"),
    ("MemberToInOperator", "q() |> Enum.filter(&ok?/1) |> Enum.member?(x)"),
    ("MemberToInOperator", "Enum.zip_with(a, b, &Enum.member?/2)"),
    ("TryRescueWithSafeAlternative", "try do\n  Map.fetch!(m, :k)\nrescue\n  KeyError -> 0\nend"),
    ("NegatedBooleanName", "invalid = a\nnot_valid = b\n{invalid, not_valid}"),
    ("UnwrapSpanInHeading", "<p><span>x</span></p>"),
    ("MergePipelineIntoComprehension", "q |> f() |> Enum.filter(fn x -> x end) |> Enum.map(fn x -> x end)"),
]

CASES = [
    ("EnumIntoToMapNew", "Enum.into(xs, %{})", "Map.new(xs)"),
    ("EnumIntoToMapSet", "Enum.into(f(a, b), MapSet.new())", "MapSet.new(f(a, b))"),
    ("EnumMapIntoToMapNew", "xs\n|> Enum.map(fn x -> {x.id, x} end)\n|> Enum.into(%{})", "xs\n|> Map.new(fn x -> {x.id, x} end)"),
    ("EnumReduceToSum", "Enum.reduce(xs, 0, fn x, acc -> acc + x end)", "Enum.sum(xs)"),
    ("EnumReverseConcat", "Enum.reverse(a) ++ b", "Enum.reverse(a, b)"),
    ("FilterCountToCount", "xs |> Enum.filter(&ok?/1) |> Enum.count()", "xs |> Enum.count(&ok?/1)"),
    ("FilterFirstToFind", "Enum.filter(xs, fn x -> x > 1 end) |> List.first()", "Enum.find(xs, fn x -> x > 1 end)"),
    ("FlatMapToFilter", "Enum.flat_map(xs, fn x -> if x > 1, do: [x], else: [] end)", "Enum.filter(xs, fn x -> x > 1 end)"),
    ("GraphemesLength", "String.graphemes(s) |> length()", "String.length(s)"),
    ("LengthZeroToEmpty", "length(xs) == 0", "Enum.empty?(xs)"),
    ("ListLastOfReverse", "List.last(Enum.reverse(xs))", "List.first(xs)"),
    ("ListWrapConditional", "if is_list(x), do: x, else: [x]", "List.wrap(x)"),
    ("MapGetUnsafePass", "Map.get(m, :k, nil)", "Map.get(m, :k)"),
    ("MapSumToSumBy", "Enum.map(xs, & &1.n) |> Enum.sum()", "Enum.sum_by(xs, & &1.n)"),
    ("MemberToInOperator", "Enum.member?(xs, y)", "y in xs"),
    ("RangeToListRedundant", "Enum.to_list(1..10) |> Enum.map(f)", "1..10 |> Enum.map(f)"),
    ("RejectIsNil", "Enum.reject(xs, fn x -> is_nil(x) end)", "Enum.reject(xs, &is_nil/1)"),
    ("ReduceAsMap", "Enum.reduce(xs, [], fn x, acc -> [x * 2 | acc] end) |> Enum.reverse()", "Enum.map(xs, fn x -> x * 2 end)"),
    ("ReduceMapPut", "Enum.reduce(xs, %{}, fn x, acc -> Map.put(acc, x.id, x) end)", "Map.new(xs, fn x -> {x.id, x} end)"),
    ("ReduceToNamedAggregate", "Enum.reduce(xs, 1, fn x, acc -> acc * x end)", "Enum.product(xs)"),
    ("SortForTopK", "Enum.sort(xs) |> hd()", "Enum.min(xs)"),
    ("SortReverseToDesc", "Enum.sort(xs) |> Enum.reverse()", "Enum.sort(xs, :desc)"),
    ("UseMapJoin", 'Enum.map(xs, &f/1) |> Enum.join(", ")', 'Enum.map_join(xs, ", ", &f/1)'),
    ("UtcNowTruncate", "DateTime.utc_now() |> DateTime.truncate(:second)", "DateTime.utc_now(:second)"),
    ("RedundantBooleanIf", "if a == b, do: true, else: false", "a == b"),
    ("DebugInspectCleanup", "x |> IO.inspect()", "x |> dbg()"),
    ("ManualTapToTap", "v |> then(fn x -> log(x); x end)", "v |> tap(fn x -> log(x) end)"),
    ("EnumFindToKeyfind", "Enum.find(xs, fn {k, _} -> k == key end)", "List.keyfind(xs, key, 0)"),
    ("CaseTrueFalse", "case ok?(x) do\n  true -> 1\n  false -> 2\nend", "if ok?(x), do: 1, else: 2"),
    ("IdentityPassthrough", "case f(x) do\n  {:ok, v} -> {:ok, v}\n  {:error, e} -> {:error, e}\nend", "f(x)"),
    ("CollapseNestedCaseToWith", "case a(x) do\n  {:ok, y} ->\n    case b(y) do\n      {:ok, z} -> z + 1\n      {:error, e} -> {:error, e}\n    end\n  {:error, r} -> {:error, r}\nend", "with {:ok, y} <- a(x), {:ok, z} <- b(y) do\n  z + 1\nend"),
    ("CollapseRichCaseToWithElse", "case a(x) do\n  {:ok, y} ->\n    case b(y) do\n      {:ok, z} -> z\n      {:error, e} -> log(e)\n    end\n  {:error, e} -> log(e)\nend", "with {:ok, y} <- a(x), {:ok, z} <- b(y) do\n  z\nelse\n  {:error, e} -> log(e)\nend"),
    ("RemoveTrivialElseClause", "with {:ok, y} <- f(x) do\n  y\nelse\n  other -> other\nend", "with {:ok, y} <- f(x) do\n  y\nend"),
    ("WithWithoutElse", "with {:ok, y} <- f(x), {:ok, z} <- g(y) do\n  z\nelse\n  e -> e\nend", "with {:ok, y} <- f(x), {:ok, z} <- g(y) do\n  z\nend"),
    ("WithSingleClauseToCase", "with {:ok, y} <- f(x) do\n  y\nelse\n  :none -> 0\nend", "case f(x) do\n  {:ok, y} -> y\n  :none -> 0\nend"),
    ("IfElseToCond", "if a > 1 do\n  1\nelse\n  if b do\n    2\n  else\n    3\n  end\nend", "cond do\n  a > 1 -> 1\n  b -> 2\n  true -> 3\nend"),
    ("ExtractCondIfGuardClauses", "def f(x) do\n  if x > 0, do: 1, else: 2\nend", "def f(x) when x > 0, do: 1\ndef f(x), do: 2"),
    ("ExtractCondToGuardClauses", "def f(x) do\n  cond do\n    is_nil(x) -> 0\n    true -> x\n  end\nend", "def f(x) when is_nil(x), do: 0\ndef f(x), do: x"),
    ("IfLiftToClauses", "def f(x) do\n  if x == 1 do\n    :one\n  else\n    :more\n  end\nend", "def f(x) when x == 1, do: :one\ndef f(x), do: :more"),
    ("LengthInGuard", "def go(list) when length(list) > 0, do: :some\ndef go(_), do: :none", "def go([_ | _]), do: :some\ndef go([]), do: :none\ndef go(_), do: :none"),
    ("InlineSingleExpressionDef", "def f(x) do\n  x + 1\nend", "def f(x), do: x + 1"),
    ("LambdaDestructureToHead", "Enum.map(xs, fn t -> {a, b} = t; a + b end)", "Enum.map(xs, fn {a, b} -> a + b end)"),
    ("MergePipelineIntoComprehension", "xs |> Enum.filter(fn x -> x > 1 end) |> Enum.map(fn x -> x * 2 end)", "for x <- xs, x > 1, do: x * 2"),
    ("MapNewLambdaToForComprehension", "Map.new(xs, fn x -> {x.id, x} end)", "for(x <- xs, do: {x.id, x}) |> Map.new()"),
    ("ExtractToPipeline", "Enum.map(xs, f)", "xs |> Enum.map(f)"),
    ("CondToCase", "cond do\n  x == 1 -> :a\n  x == 2 -> :b\n  true -> :c\nend", "case x do\n  1 -> :a\n  2 -> :b\n  _ -> :c\nend"),
    ("MapPutChainToLiteral", "m = %{}\nm = Map.put(m, :a, 1)\nm = Map.put(m, :b, f(2))\nm\n", "m = %{:a => 1, :b => f(2)}\nm\n"),
    ("ClauseLookupToMap", 'def n("a"), do: 1\ndef n("b"), do: 2\ndef n("c"), do: 3\n', '@n_lookup %{"a" => 1, "b" => 2, "c" => 3}\ndef n(key), do: Map.fetch!(@n_lookup, key)\n'),
    ("CaseToFunctionClauses", "def f(x) do\n  case x do\n    :a -> 1\n    _ -> 2\n  end\nend", "def f(:a), do: 1\ndef f(_), do: 2"),
    ("EnumCapture", "Enum.map(xs, fn x -> My.Mod.f(x) end)", "Enum.map(xs, &My.Mod.f/1)"),
    ("ExtractSocketToPipe", "assign(socket, :a, g(1, 2))", "socket |> assign(:a, g(1, 2))"),
    ("AliasOrder", "alias B\nalias A.C\n\nfoo", "alias A.C\nalias B\n\nfoo"),
    ("MultiAliasExpand", "  alias Foo.{A, B}", "  alias Foo.A\n  alias Foo.B"),
    ("ImportAfterAlias", "import X\nalias A", "alias A\nimport X"),
    ("RemoveBlankBetweenAttrAndDef", "@spec f() :: 1\n\n\ndef f, do: 1", "@spec f() :: 1\ndef f, do: 1"),
    ("NegatedBooleanName", "not_valid = x\nif not_valid, do: 1", "invalid = x\nif invalid, do: 1"),
    ("NegatedBooleanName", "def f(x) do\n  not_found = x == []\n  g(not_found)\nend\n\ndef h(not_found), do: not_found", "def f(x) do\n  found = x == []\n  g(found)\nend\n\ndef h(not_found), do: not_found"),
    ("UnwrapSpanInHeading", '<h2><span class="a">Hi</span></h2>', '<h2 class="a">Hi</h2>'),
    ("UnwrapSpanInHeading", "<h2><small><span>Hi</span></small> you</h2>", "<h2><small>Hi</small> you</h2>"),
    ("CollapseRedundantHeexNesting", '<div><div class="x">q</div></div>', '<div class="x">q</div>'),
]


@pytest.mark.parametrize(("name", "text"), ALONE)
def test_leaves_other_shapes_alone(name, text):
    assert engine.run(text, [next(r for r in engine.rules() if r.name == name)]).text == text


def test_options_of_rules():
    rule = {r.name: r for r in engine.rules()}
    assert engine.run("not_ready = f(x)\nnot_ready", [rule["NegatedBooleanName"]], {"NegatedBooleanName": {"known": {"not_ready": "pending"}}}).text == "pending = f(x)\npending"
    assert engine.run("IO.inspect(x)", [rule["DebugInspectCleanup"]], {"DebugInspectCleanup": {"target": "logger"}}).text == "Logger.debug(inspect(x))"


def test_overlapping_edits_keep_as_many_as_can_stand():
    assert engine.most_disjoint([(0, 9, "a"), (1, 2, "b"), (3, 4, "c"), (4, 6, "d")]) == [(1, 2, "b"), (3, 4, "c"), (4, 6, "d")]


@pytest.mark.parametrize(("name", "before", "after"), CASES + SHAPES)
def test_source_rule(name, before, after):
    rule = next(r for r in engine.rules() if r.name == name)
    out = engine.run(before, [rule])
    assert out.text == after and out.changed and out.converged and {a[0] for a in out.applied} == {name}
    assert engine.run(after, [rule]).text == after


@pytest.mark.parametrize("name", [c[0] for c in CASES])
@pytest.mark.parametrize("text", ["", "x = 1", 's = "Enum.into(xs, %{}) |> Enum.sum()"', "# Enum.sort(xs) |> Enum.reverse()", "Map.get(m, :k, 0)", "alias A\nalias B", "<h2>Hi</h2>", "Enum.into(xs, ys)", "My.Enum.into(xs, %{})"])
def test_leaves_alone(name, text):
    rule = next(r for r in engine.rules() if r.name == name)
    assert engine.run(text, [rule]).text == text


def test_tokens_cover_strings_and_sigils():
    assert [t.text for t in tokens('f("a, b", ~w(x y)a) # c') if t.kind == "string"] == ['"a, b"', "~w(x y)a"]
    assert list(Template("f($a, $a)", "g($a)").matches("f(x.y, x.y) + f(x, y)")) == [(0, 11, "g(x.y)")]


def test_selection_order_and_priorities():
    rules = [engine.Rule("b"), engine.Rule("a"), engine.Rule("c", priority=200), engine.Rule("off", enabled=False)]
    names = lambda **k: [r.name for r in engine.chosen(among=rules, **k)]
    assert names() == ["c", "a", "b"]
    assert names(configured={"b": {"priority": 300}, "off": {"enabled": True}}) == ["b", "c", "a", "off"]
    assert names(only=["a", "c"], skipped=["c"]) == ["a"]


def test_fixpoint_says_whether_it_converged():
    grow = engine.Rule("grow", rewrite=lambda t, _: t + "x")
    out = engine.run("", [grow], max_passes=5)
    assert out.text == "xxxxx" and not out.converged
    swap = engine.Rule("swap", patches=lambda t, _: [(0, 1, "b")] if t[:1] == "a" else [])
    also = engine.Rule("also", patches=lambda t, _: [(1, 2, "d")] if t[1:2] == "c" else [])
    out = engine.run("ac", [swap, also])
    assert out.text == "bd" and out.converged and [a[0] for a in out.applied] == ["swap", "also"]
    assert not engine.disjoint([(0, 3, ""), (2, 4, "")]) and engine.disjoint([(2, 4, ""), (0, 2, "")])


def test_patch_conflicts(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("a", 5, 6), ("a", 2, 3), ("b", 0, 9)], "path string, start int, stop int")
    assert [(r.path, r.start) for r in engine.conflicts(rows).collect()] == [("a", 2)]


def test_findings_are_ordered_and_kept(spark):
    rows = spark.createDataFrame([("b", 2, 1), ("a", None, 9), (None, 5, 3)], "path string, line int, n int")
    found = fnd.findings(rows, "R", "k", fnd.first_decline([(F.col("n") > 8, "big"), (F.col("n") > 2, "some")]), {"n": F.col("n")})
    out = fnd.ordered(found).collect()
    assert [(r.path, r.line, r.accepted, r.decline) for r in out] == [(None, 5, False, "some"), ("a", None, False, "big"), ("b", 2, True, None)]
    assert found.schema.simpleString() == fnd.none(spark).schema.simpleString()
    lines = [r.x for r in fnd.ordered(found).select(fnd.to_line().alias("x")).collect()]
    assert lines == ["5 [k] declined: some", "a [k] declined: big", "b:2 [k] accepted"]
    assert fnd.accepted(found).count() == 1 and fnd.declined(found).count() == 2 and fnd.by_path(found).count() == 2


@pytest.fixture(scope="module")
def code(spark):
    """A small corpus of relations."""
    clause = lambda module, name, arity, body, mass=30, public=True, line=1, skeleton="s", literals=(): (module.lower(), line, module, name, arity, body, skeleton, mass, public, 1, 3, list(literals))
    clauses = [
        clause("A.B", "f", 1, "h1"), clause("A.C.D", "f", 1, "h1"), clause("A.B", "g", 2, "h2"), clause("A.E", "k", 2, "h2"),
        clause("A.B", "small", 0, "h3", mass=3), clause("A.E", "small", 0, "h3", mass=3),
        clause("P", "p", 1, "x1", skeleton="sk", literals=["1", "a"]), clause("P", "q", 1, "x2", skeleton="sk", literals=["2", "a"]),
        clause("M", "run", 0, "m1"), clause("M", "used", 0, "m2", public=False), clause("M", "dead", 0, "m3", public=False), clause("M", "a_to_map", 1, "m4"), clause("M", "b_to_map", 1, "m5"), clause("M", "c_to_map", 1, "m6"),
    ]
    call = lambda module, caller, callee, arg="1", pos=0, literal=True: (module.lower(), 1, module, caller, callee, pos, arg, literal, False)
    calls = [call("M", "run", "used"), call("M", "dead", "dead"), call("N", "x", "flag", "true"), call("N", "y", "flag", "false"), call("N", "x", "same", "7"), call("N", "y", "same", "7")]
    literals = [("a", 1, "A", "number", "42", "timeout"), ("a", 2, "A", "number", "42", "timeout"), ("a", 3, "A", "number", "7", "x"), ("a", 4, "A", "number", "9", "x"), ("a", 5, "A", "number", "9", "y"), ("a", 6, "A", "string", "https://example.org/x", "u")]
    seg = lambda block, idx, reads, writes, h, callee="f", mass=6, pure=True, depth=1: ("s", idx, block, idx, callee, list(reads), list(writes), h, mass, pure, depth)
    segments = [seg("b1", 0, "x", "a", "h0"), seg("b1", 1, "a", "c", "h1"), seg("b1", 2, "c", "d", "h2"), seg("b1", 3, "d", "", "h3", callee=None), seg("b2", 0, "q", "z", "h9", depth=4), seg("b2", 1, "v", "v", "h8"), seg("b2", 2, "v", "v", "h7"), seg("b2", 3, "x", "a", "h0"), seg("b2", 4, "a", "c", "h1")]
    branches = [("br", 1, "s1", b, i, h) for b, hs in (("x", ["p", "q", "1", "t"]), ("y", ["p", "q", "2", "3", "t"])) for i, h in enumerate(hs)]
    lists = [("l", 1, ["b", "a"]), ("l", 2, ["a", "b"])]
    return {
        "clauses": spark.createDataFrame(clauses, "path string, line int, module string, name string, arity int, body_hash string, skeleton_hash string, mass int, public boolean, n_clauses int, lines int, literals array<string>"),
        "calls": spark.createDataFrame(calls, "path string, line int, module string, caller string, callee string, pos int, arg string, literal boolean, dynamic boolean"),
        "literals": spark.createDataFrame(literals, "path string, line int, module string, kind string, value string, context string"),
        "segments": spark.createDataFrame(segments, "path string, line int, block string, idx int, callee string, reads array<string>, writes array<string>, hash string, mass int, pure boolean, depth int"),
        "branches": spark.createDataFrame(branches, "path string, line int, site string, branch string, idx int, hash string"),
        "lists": spark.createDataFrame(lists, "path string, line int, items array<string>"),
    }


def verdicts(code, name, **options):
    rule = next(r for r in engine.rules() if r.name == name)
    return sorted(((r.decline or "ok", r.scope.module, r.scope.function, dict(r.evidence or {})) for r in engine.detected(code, [rule], {name: options}).collect()), key=repr)


def test_clone_detectors(code):
    assert [(v[0], v[1]) for v in verdicts(code, "DelegateExactDuplicates")] == [("ok", "A.C.D"), ("too_small", "A.E")]
    assert [v[0] for v in verdicts(code, "ExtractRenamedClone") if v[3]["names"] == "2"] == ["ok"]
    assert ("ok", "1") in [(v[0], "1") for v in verdicts(code, "ExtractParametricClone") if v[1] == "P"]
    assert [v[0] for v in verdicts(code, "SuggestInputStructsForProtocol")] == ["ok"]


def test_call_detectors(code):
    assert [v[2] for v in verdicts(code, "RemoveDeadPrivateFunction")] == ["dead"]
    assert [(v[0], v[2]) for v in verdicts(code, "InlineSingleCallerPrivate")] == [("ok", "used"), ("recursive", "dead")]
    assert [(v[2], v[3]["argument"]) for v in verdicts(code, "PushParamIntoCallee")] == [("same", "7")]
    assert [(v[0], v[2]) for v in verdicts(code, "SplitFlagArgument")] == [("ok", "flag")]


def test_literal_detectors(code):
    assert [(v[0], v[3]["value"]) for v in verdicts(code, "ExtractMagicNumber")] == [("ambiguous", "9"), ("ok", "42"), ("too_few", "7")]
    assert [v[3]["value"] for v in verdicts(code, "HoistHardcodedConfig")] == ["https://example.org/x"]


def test_statement_detectors(code):
    assert {v[3]["name"] for v in verdicts(code, "UnusedVariable")} == {"z", "c"}
    assert ("ok", "a") in {(v[0], v[3]["name"]) for v in verdicts(code, "InlineSingleUseBinding")}
    assert [v[3]["name"] for v in verdicts(code, "DropTrailingReturnBinding")] == ["d"]
    assert [v[3]["length"] for v in verdicts(code, "PipelineFromRebindChain")] == ["2"]
    assert verdicts(code, "MergePipeableAssignments")[0][3]["length"] in ("2", "4")
    assert [v[3]["depth"] for v in verdicts(code, "ExtractNestedBlock")] == ["4"]
    assert [(v[0], v[3]["n"]) for v in verdicts(code, "ExtractExpressionClone")] == [("ok", "2")]
    assert [v[3]["shared"] for v in verdicts(code, "DedupeClausePrologue")] == ["2"]
    assert [v[3]["shared"] for v in verdicts(code, "LiftCommonTailFromBranches")] == ["1"]
    assert [v[3]["sorted"] for v in verdicts(code, "SortKeywords")] == ["a,b"]


def test_line_and_name_detectors(spark):
    lines = spark.createDataFrame([("a", 1, "  where: x.id == ^user.id"), ("a", 2, "      alias Foo.Bar"), ("a", 3, "  defp is_ok(x), do: x"), ("a", 4, "  with {:ok, y} <- f(x) do"), ("a", 5, "A.B.c(A.B.d())"), ("a", 6, "X.B.c(X.B.d(Q.R.e(Q.R.f())))"), ("a", 7, "plain")], "path string, line int, text string")
    kinds = {r.rule: r.evidence["text"] for r in engine.detected({"lines": lines}, [r for r in engine.rules() if r.needs == ("lines",) and r.name != "AliasUsage"]).collect()}
    assert kinds == {"LiftPinnedEctoExpr": "user.id", "LiftDirectives": "alias Foo.Bar", "BooleanFunctionQuestionMark": "is_ok", "LiftWithIntoPipeline": "with {:ok, y} <- f(x) do"}
    assert {(v[0], v[3]["name"]) for v in verdicts({"lines": lines}, "AliasUsage")} == {("last_part_clashes", "A.B"), ("last_part_clashes", "X.B"), ("ok", "Q.R")}
    names = spark.createDataFrame([("a", 1, "binding", "bc", [("build_changeset", True)]), ("a", 2, "binding", "bc", [("build_changeset", True), ("big_cat", True)]), ("a", 3, "param", "x", [])], "path string, line int, kind string, short string, candidates array<struct<name:string,strong:boolean>>")
    assert [(v[0], v[3]["long"]) for v in verdicts({"names": names}, "ExpandShortFormBindings")] == [("no_clear_expansion", None), ("ok", "build_changeset")]


def test_more_statement_detectors(code, spark):
    assert [v[3]["before"] for v in verdicts(code, "FlattenDeepPipeBranch")] == ["2"]
    assert {v[3]["name"] for v in verdicts(code, "HoistInvariantOutOfComprehension")} == {"z"}
    assert verdicts(code, "ExtractCommonProlog") == [] and verdicts(code, "ExtractCaseToHelper") == []
    assert ("ok", "x") in {(v[0], v[3]["params"]) for v in verdicts(code, "ExtractFunctionFromBlock")}
    uses = spark.createDataFrame([("a", 1, "f", "p", ["name", "email"]), ("a", 2, "g", "p", ["name"]), ("a", 3, "h", "p", ["name", "zip"]), ("a", 4, "k", "p", ["x", "y"])], "path string, line int, function string, param string, fields array<string>")
    structs = spark.createDataFrame([("User", ["name", "email", "id"]), ("A", ["x", "y"]), ("B", ["x", "y", "z"])], "struct string, fields array<string>")
    assert {(v[2], v[0]) for v in verdicts({"uses": uses, "structs": structs}, "LiftUntypedParamToStructPattern")} == {("f", "ok"), ("g", "too_few_fields"), ("h", "no_struct"), ("k", "ambiguous")}


def test_markup_detectors(spark):
    from coppice.operators import clones as C
    from coppice.sources.markup import nodes

    box = '<section class="{}"><h2>{}</h2><ul><li>a</li><li>b</li><li>c</li></ul><p>{{@x}}</p><div><span>x</span><span>y</span></div></section>'
    pages = spark.createDataFrame([(k, "<main>\n" + box.format("a b", "T") + "</main>") for k in (1, 2, 3)], "page_id long, html string")
    elements = nodes(pages).withColumn("path", F.col("tree_id").cast("string"))
    fragments = C.fragments(pages, 6, ("exact", "motif"))
    near = C.near_clusters(*C.near_pairs(pages, 0.85, 8))
    declared = spark.createDataFrame([("section", 0, "id"), ("section", 1, "class")], "component string, pos int, attr string")
    relations = {"elements": elements, "fragments": fragments, "near": near, "declared": declared, "defaults": spark.createDataFrame([("section", "class", "a b")], "component string, attr string, default string")}
    assert len(verdicts(relations, "ExtractHeexExactClone")) == 1 and len(verdicts(relations, "ProposeSharedHeexComponent")) == 1
    assert {v[3]["motif"] for v in verdicts(relations, "ExtractToPublicComponent") if v[0] == "ok"} == {"item_list"}
    assert len(verdicts(relations, "DropRedundantAttrDefaults")) == 3
    assert {v[3]["attr"] for v in verdicts(relations, "GenerateHeexAssignContracts")} == {"x"}
    assert {v[0] for v in verdicts(relations, "ExtractHeexComponentBySeam")} == {"too_short"}
    assert {v[0] for v in verdicts(relations, "ExtractHeexComponentBySeam", lines=1)} <= {"ok", "no_assign"}


def test_detect_needs_its_relations(code):
    with pytest.raises(ValueError):
        engine.detected({}, [r for r in engine.rules() if r.name == "SortKeywords"])
    kinds = {r.rule for r in engine.detected(code, [r for r in engine.rules() if r.detect]).select("rule").distinct().collect()}
    assert {"DelegateExactDuplicates", "ExtractMagicNumber", "UnusedVariable"} <= kinds


def test_rules_say_what_they_lack(code):
    rule = {r.name: r for r in engine.rules()}
    assert engine.lacking(rule["ExtractInlineBlock"], code) == ["clauses.kind"] and engine.lacking(rule["SortKeywords"], {}) == ["lists"]
    with pytest.raises(ValueError):
        engine.detected(code, [rule["ExtractInlineBlock"]])
    assert engine.lacking(rule["ExtractInlineBlock"], {"clauses": code["clauses"].withColumn("kind", F.lit("block"))}) == []


def test_findings_see_all_literals(spark, tmp_path):
    """Texts of one skeleton that differ after the eighth literal have holes there."""
    from coppice.plans.rules import relations

    words = [f"Word filler{k}" for k in range(30)]
    text = lambda name, many: " ".join(words[:20] + [w.replace("Word", name) for w in words[20 : 20 + many]] + words[20 + many :])
    docs = [(3 * k + 1, f"src{k}", "en", t.replace("filler", "few") if k < 2 else t) for k, t in enumerate([text("Alpha", 1), text("Beta", 1), text("Alpha", 9), text("Beta", 9)])]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "user_id long, event_id long, event_type string, props string").write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = verdicts(relations(spark, str(tmp_path)), "ExtractParametricClone")
    assert sorted(v[0] for v in got) == ["ok", "too_many_literals"]
