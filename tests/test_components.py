"""Types, free variables and names of template parts; data flow."""

import pytest

from coppice.functions import components as C
from coppice.functions import flow as W
from coppice.functions.segments import Segment
from coppice.sources.markup import parse


@pytest.mark.parametrize(
    ("markup", "assign", "kind"),
    [
        ("<ul><li :for={x <- @xs}>{x}</li></ul>", "xs", "list"),
        ("<%= for x <- @xs do %><p>{x}</p><% end %>", "xs", "list"),
        ("<p>{Enum.count(@xs)}</p>", "xs", "list"),
        ("<p :if={not @on}>a</p>", "on", "boolean"),
        ("<p :if={!@on}>a</p>", "on", "boolean"),
        ('<p>{@a <> "x"}</p>', "a", "string"),
        ("<p>{String.upcase(@a)}</p>", "a", "string"),
        ("<p class={@a}>{@a}</p>", "a", "any"),
        ("<p>{@a > 0}</p>", "a", "any"),
        ("<p :for={x <- @a}>{@a <> x}</p>", "a", "any"),
    ],
)
def test_assign_types(markup, assign, kind):
    assert C.assign_type(assign, parse(markup)[0]) == kind


def test_assigns_and_free_variables():
    (node,) = parse("<div><li :for={{k, v} <- @xs}>{k} {v.name} {other} {f(@y, z)}</li></div>")
    assert C.assigns(node) == ["xs", "y"] and C.free_variables(node) == ["other", "z"]
    assert C.free_variables(parse("<p>{Enum.map(xs, fn x -> x + 1 end)}</p>")[0]) == ["xs"]


@pytest.mark.parametrize(
    ("markup", "name"),
    [
        ("<ul><li :for={x <- @page.entries}>{x}</li></ul>", "entries_list"),
        ("<section><p>a</p></section>", "section"),
        ('<div class="mt-2 card"><p>a</p></div>', "card"),
        ("<div><h2>Your Orders</h2></div>", "your_orders"),
        ('<div><p>{gettext("Sign in")}</p></div>', "sign_in"),
        ("<div><p>{@total} {@total} {@tax}</p></div>", "total"),
        ("<div><p>a</p></div>", "component"),
    ],
)
def test_component_names(markup, name):
    assert C.component_name(parse(markup)[0]) == name
    assert C.component_name(parse(markup)[0], {name}) == f"{name}_2"


def test_flow():
    s = lambda r, w="": Segment(frozenset(r), frozenset(w))
    block = [s("x", "a"), s("a", "b"), s("", "a"), s("ab")]
    assert W.read_after(block, 0, "a") and not W.read_after(block, 1, "a") and W.read_after(block, 1, "b")
    assert W.branches_reading([[s("q")], [s("", "q"), s("q")], []], "q") == [0]
    assert W.live_in_one_branch([[s("q")], []], [], "q") and not W.live_in_one_branch([[s("q")], []], [s("q")], "q")
    assert W.free_in_order(block) == ["x"] and W.free_in_order([s("ba")], [["b", "a"]]) == ["b", "a"]
    assert W.pure(["Enum.map", "+"]) and not W.pure(["/"]) and not W.pure(["Map.fetch!"])
