"""Rewrites of source text by token templates.

A template is source text in which ``$name`` stands for any balanced run of tokens without a
comma or statement break at its own level; the same name stands for the same tokens.
Strings, sigils and comments are single tokens, so nothing inside them ever matches. A
``$name`` outside of brackets that no comma ends stands for one operand only; a pattern that
begins with one never begins within a pipe. In a replacement ``$(name)`` puts brackets around
what an operator roots.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

_TOKEN = re.compile(
    r'''(?P<blank>[ \t\r]+)|(?P<newline>\n)|(?P<comment>\#(?!\{)[^\n]*)|(?P<string>"""(?:[^\\]|\\.)*?"""|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|~[A-Za-z](?:"""(?:[^\\]|\\.)*?"""|"(?:[^"\\]|\\.)*"|/(?:[^/\\]|\\.)*/|\((?:[^)\\]|\\.)*\)|\[(?:[^\]\\]|\\.)*\]|\{(?:[^}\\]|\\.)*\}|\|(?:[^|\\]|\\.)*\|)[a-z]*)'''
    r"""|(?P<meta>\$[a-z_]+)|(?P<word>:?[A-Za-z_@][\w]*[?!]?:?(?=\W|$)|&\d+|\d[\w.]*(?<!\.))|(?P<operator>\|>|\+\+|--|<>|->|<-|=>|==|!=|>=|<=|&&|\|\||\.\.|%\{|.)""",
    re.S,
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}", "%{": "}", "fn": "end", "do": "end"}, {")", "]", "}", "end"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    stop: int


def tokens(source: str) -> list[Token]:
    """Tokens without blanks and comments; line breaks are tokens."""
    out = []
    for m in _TOKEN.finditer(source):
        if m.lastgroup in ("blank", "comment"):
            continue
        out.append(Token(m.lastgroup, m[0], m.start(), m.end()))
    return out


def _closing(stream: list[Token], at: int) -> int:
    """The place after the bracket or block that opens at ``at``; -1 if it never closes."""
    depth = 0
    for k in range(at, len(stream)):
        depth += (stream[k].text in _OPEN and stream[k].kind != "string") - (stream[k].text in _CLOSE and stream[k].kind != "string")
        if not depth:
            return k + 1
    return -1


def _operand(stream: list[Token], at: int) -> int:
    """The place after the operand (a name, literal, call or bracket, with what is chained to it)."""
    if at >= len(stream) or stream[at].kind == "newline" or stream[at].text in _CLOSE:
        return -1
    k = _closing(stream, at) if stream[at].text in _OPEN else at + 1
    while 0 <= k < len(stream):
        if stream[k].text in ("(", "[") and stream[k].start == stream[k - 1].stop:
            k = _closing(stream, k)
        elif stream[k].text == "." and k + 1 < len(stream) and stream[k + 1].kind == "word":
            k += 2
        else:
            break
    return k


def in_guard(stream: list[Token], at: int) -> bool:
    """Whether the token stands between ``when`` and what ends a guard."""
    for t in reversed(stream[:at]):
        if t.text == "when":
            return True
        if t.text in ("do", "->", "do:", "end", ";", "def", "defp", "fn"):
            return False
    return False


def _rooted_by_operator(text: str) -> bool:
    """Whether an operator stands outside of all brackets."""
    stream = [t for t in tokens(text) if t.kind != "newline"]
    return bool(stream) and 0 <= _operand(stream, 0) < len(stream)


class Template:
    """One pattern and its replacement.

    ``where`` has regular expressions that captured texts must fit; ``guard`` asks that the
    match stands in a guard (True) or outside of guards (False).
    """

    def __init__(self, pattern: str, replacement: str, where: dict[str, str] | None = None, guard: bool | None = None) -> None:
        self.guard = guard
        self.pattern = [t for t in tokens(pattern) if t.kind != "newline"]
        self.replacement = replacement
        self.where = {name: re.compile(r, re.S) for name, r in (where or {}).items()}
        depth, self.inside = 0, []
        for t in self.pattern:
            depth -= t.text in _CLOSE
            self.inside.append(depth > 0)
            depth += t.text in _OPEN

    def _match(self, stream: list[Token], at: int, p: int, bound: dict[str, tuple[int, int]]) -> int:
        """The place after a match of the pattern from its token ``p`` on, or -1."""
        while p < len(self.pattern):
            want = self.pattern[p]
            pipe = want.text in ("|>", ")", ",", "->", "end")
            while at < len(stream) and stream[at].kind == "newline" and (pipe or self.inside[p]):
                at += 1
            if at >= len(stream):
                return -1
            if want.kind != "meta":
                if stream[at].text != want.text:
                    return -1
                at, p = at + 1, p + 1
                continue
            if want.text in bound:
                a, b = bound[want.text]
                same = [t.text for t in stream[a:b]]
                if [t.text for t in stream[at : at + len(same)]] != same:
                    return -1
                at, p = at + len(same), p + 1
                continue
            bounded = self.inside[p] or p + 1 < len(self.pattern) and self.pattern[p + 1].text in (",", "do")
            if not bounded:
                end = _operand(stream, at)
                if end < 0:
                    return -1
                bound[want.text] = (at, end)
                at, p = end, p + 1
                continue
            k = at
            while k < len(stream) and stream[k].text not in _CLOSE and stream[k].text != "," and (self.inside[p] or stream[k].kind != "newline"):
                k = _closing(stream, k) if stream[k].text in _OPEN else k + 1
                if k < 0:
                    return -1
                tried = dict(bound)
                tried[want.text] = (at, k)
                if (end := self._match(stream, k, p + 1, tried)) >= 0:
                    bound.clear()
                    bound.update(tried)
                    return end
            return -1
        return at

    @staticmethod
    def _within_pipe(stream: list[Token], at: int) -> bool:
        """Whether the operand that begins here belongs to a pipe, call or operator before it."""
        if stream[at].text in ("(", "[") and stream[at - 1].kind == "word" and stream[at - 1].stop == stream[at].start:
            return True
        k = at - 1
        while k >= 0 and stream[k].kind == "newline":
            k -= 1
        return k >= 0 and stream[k].text in ("|>", ".", "..", "&", "+", "-", "*", "/", "++", "--", "<>", "@")

    def matches(self, source: str, stream: list[Token] | None = None) -> Iterator[tuple[int, int, str]]:
        """Edits (start, stop, replacement) of the places where the pattern stands, from the left, not overlapping."""
        stream = tokens(source) if stream is None else stream
        at = 0
        while at < len(stream):
            bound: dict[str, tuple[int, int]] = {}
            joined = at and (stream[at - 1].text in (".", "&") and stream[at].kind == "word" or self.pattern[0].kind == "meta" and self._within_pipe(stream, at))
            end = -1 if joined or stream[at].kind == "newline" else self._match(stream, at, 0, bound)
            if end < 0:
                at += 1
                continue
            held = {name: source[stream[a].start : stream[b - 1].stop].strip() for name, (a, b) in bound.items()}
            if any(not r.fullmatch(held[name]) for name, r in self.where.items()) or self.guard is not None and in_guard(stream, at) != self.guard:
                at += 1
                continue

            def put(m: re.Match) -> str:
                if m[1]:
                    value = held[f"${m[1]}"]
                    return f"({value})" if _rooted_by_operator(value) else value
                return held[m[0]]

            yield stream[at].start, stream[end - 1].stop, re.sub(r"\$\(([a-z_]+)\)|\$[a-z_]+", put, self.replacement)
            at = end


def edits(source: str, templates: list[Template]) -> list[tuple[int, int, str]]:
    """Edits of all templates; where two overlap, the earlier template's stands."""
    stream, out = tokens(source), []
    for t in templates:
        for e in t.matches(source, stream):
            if all(e[1] <= o[0] or o[1] <= e[0] for o in out):
                out.append(e)
    return sorted(out)
