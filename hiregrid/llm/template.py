"""A compiler for a sandboxed template language: syntax tree, constant folding, Python closures.

    text, {{ expression | filter }}, {% set x = e %}, {% if e %} {% elif e %} {% else %} {% endif %},
    {% for x in e %} {% endfor %} with loop.index, loop.index0, loop.first, loop.last,
    {% generation %} {% endgeneration %} around what a model is trained to write. `-` at a marker trims white space.

Expressions are literals, names, `a.b` and `a["b"]` on mappings and lists, + ~ == != < > <= >= in and or not, parentheses and
filters. There are no calls and no access to attributes of Python objects. A template becomes closures that give
(text, generated) pieces as they are asked for, so an endless iterable renders in bounded memory.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    """The template can't be parsed, or asks for what the sandbox doesn't allow."""


@dataclass(frozen=True)
class Node:
    kind: str
    value: Any = None
    parts: tuple = field(default=())


_MARK = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)\s*(.*?)\s*(-?)%\}|\{#.*?#\}", re.S)
_LEXEME = re.compile(r"""\s*(?:(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-+~<>|.()\[\],]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_COMPARE: dict[str, Callable[[Any, Any], Any]] = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "in": lambda a, b: a in b}


def _shown(x: Any) -> str:  # noqa: ANN401
    return "" if x is None else x if isinstance(x, str) else str(x)


FILTERS: dict[str, Callable[[str], Any]] = {"trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len}


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str, filters: Mapping[str, Callable]) -> None:
        self.filters, self.tokens, at = filters, [], 0
        while source[at:].strip():
            m = _LEXEME.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.tokens.append(("end", ""))

    def take(self, *values: str) -> str | None:
        kind, value = self.tokens[0]
        if kind in ("sign", "name") and value in values:
            self.tokens.pop(0)
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing before {self.tokens[0][1]!r}")

    def whole(self) -> Node:
        node = self.either()
        if self.tokens[0][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Node("or", None, (node, self.both()))
        return node

    def both(self) -> Node:
        node = self.inverse()
        while self.take("and"):
            node = Node("and", None, (node, self.inverse()))
        return node

    def inverse(self) -> Node:
        return Node("not", None, (self.inverse(),)) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.sum()
        while sign := self.take(*_COMPARE):
            node = Node("compare", sign, (node, self.sum()))
        return node

    def sum(self) -> Node:
        node = self.filtered()
        while sign := self.take("+", "~"):
            node = Node("join", sign, (node, self.filtered()))
        return node

    def filtered(self) -> Node:
        node = self.reached()
        while self.take("|"):
            kind, name = self.tokens.pop(0)
            if kind != "name" or name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            node = Node("filter", name, (node,))
        return node

    def reached(self) -> Node:
        node = self.atom()
        while sign := self.take(".", "["):
            if sign == ".":
                kind, name = self.tokens.pop(0)
                if kind != "name" or name.startswith("_"):
                    raise TemplateError(f"no access to {name!r}")
                node = Node("item", None, (node, Node("constant", name)))
            else:
                node = Node("item", None, (node, self.either()))
                self.need("]")
        return node

    def atom(self) -> Node:
        kind, value = self.tokens.pop(0)
        if kind == "text":
            return Node("constant", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return Node("constant", int(value))
        if kind == "name":
            return Node("constant", {"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else Node("name", value)
        if (kind, value) == ("sign", "("):
            node = self.either()
            self.need(")")
            return node
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str, filters: Mapping[str, Callable]) -> Node:
    """The syntax tree of a template."""
    items: list[tuple[str, str]] = []
    at, trim = 0, False
    for m in _MARK.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if trim else text
        text = text.rstrip() if "-" in (m[1], m[4]) else text
        items.append(("text", text))
        items.append(("show", m[2]) if m[2] is not None else ("tag", m[5] or ""))
        at, trim = m.end(), "-" in (m[3], m[6])
    items.append(("text", source[at:].lstrip() if trim else source[at:]))
    expression = lambda s: _Expression(s, filters).whole()

    def block(ends: tuple[str, ...]) -> tuple[Node, str]:
        parts: list[Node] = []
        while items:
            kind, value = items.pop(0)
            if kind == "text":
                parts += [Node("constant", value)] if value else []
            elif kind == "show":
                parts.append(Node("show", None, (expression(value),)))
            elif not value:
                continue
            elif (word := value.split()[0]) in ends:
                return Node("block", None, tuple(parts)), value
            elif word == "if":
                parts.append(branch(value[2:]))
            elif word == "for" and (m := re.fullmatch(r"for\s+(\w+)\s+in\s+(.+)", value, re.S)):
                body, _ = block(("endfor",))
                parts.append(Node("for", m[1], (expression(m[2]), body)))
            elif word == "set" and (m := re.fullmatch(r"set\s+(\w+)\s*=\s*(.+)", value, re.S)):
                parts.append(Node("set", m[1], (expression(m[2]),)))
            elif word == "generation":
                parts.append(Node("generation", None, (block(("endgeneration",))[0],)))
            else:
                raise TemplateError(f"unknown tag {value!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return Node("block", None, tuple(parts)), ""

    def branch(test: str) -> Node:
        body, end = block(("elif", "else", "endif"))
        other = Node("block")
        if end.startswith("elif"):
            other = branch(end[4:])
        elif end == "else":
            other, _ = block(("endif",))
        return Node("if", None, (expression(test), body, other))

    return block(())[0]


def _item(x: Any, key: Any) -> Any:  # noqa: ANN401
    if isinstance(x, Mapping):
        return x.get(key)
    if isinstance(x, list | tuple) and isinstance(key, int):
        return x[key] if -len(x) <= key < len(x) else None
    return None


def fold(node: Node, filters: Mapping[str, Callable]) -> Node:
    """The tree with constant parts computed, adjacent texts joined and branches on constants decided."""
    parts = tuple(fold(p, filters) for p in node.parts)
    node = Node(node.kind, node.value, parts)
    if node.kind == "show" and parts[0].kind == "constant":
        return Node("constant", _shown(parts[0].value))
    if node.kind == "if" and parts[0].kind == "constant":
        return parts[1] if parts[0].value else parts[2]
    if node.kind == "block":
        flat: list[Node] = []
        for p in parts:
            for x in p.parts if p.kind == "block" else (p,):
                if flat and x.kind == "constant" and flat[-1].kind == "constant":
                    flat[-1] = Node("constant", flat[-1].value + x.value)
                else:
                    flat.append(x)
        return Node("block", None, tuple(flat))
    if node.kind in ("or", "and", "not", "compare", "join", "filter", "item") and all(p.kind == "constant" for p in parts):
        return Node("constant", _value(node, filters)({}))
    return node


def _value(node: Node, filters: Mapping[str, Callable]) -> Callable[[Mapping], Any]:
    """The closure of an expression."""
    kind, value = node.kind, node.value
    if kind == "constant":
        return lambda env: value
    if kind == "name":
        return lambda env: env.get(value)
    inner = [_value(p, filters) for p in node.parts]
    a, b = inner[0], inner[-1]
    if kind == "or":
        return lambda env: a(env) or b(env)
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "not":
        return lambda env: not a(env)
    if kind == "compare":
        test = _COMPARE[value]
        return lambda env: test(a(env), b(env))
    if kind == "join":
        return (lambda env: _shown(a(env)) + _shown(b(env))) if value == "~" else (lambda env: a(env) + b(env))
    if kind == "filter":
        change = filters[value]
        return lambda env: change(_shown(a(env)))
    return lambda env: _item(a(env), b(env))


Pieces = Iterator[tuple[str, bool]]


def _writer(node: Node, filters: Mapping[str, Callable]) -> Callable[[dict, bool], Pieces]:
    """The closure of a statement: the pieces that it renders, each with whether it is generated, as they are asked for."""
    kind, value = node.kind, node.value
    if kind == "constant":
        return lambda env, made: iter(((value, made),))
    if kind == "show":
        show = _value(node.parts[0], filters)
        return lambda env, made: iter(((_shown(show(env)), made),))
    if kind == "set":
        to = _value(node.parts[0], filters)

        def assign(env: dict, made: bool) -> Pieces:
            env[value] = to(env)
            return iter(())

        return assign
    if kind == "generation":
        inner = _writer(node.parts[0], filters)
        return lambda env, made: inner(env, True)
    if kind == "if":
        test, then, other = _value(node.parts[0], filters), _writer(node.parts[1], filters), _writer(node.parts[2], filters)
        return lambda env, made: (then if test(env) else other)(env, made)
    if kind == "for":
        over, body = _value(node.parts[0], filters), _writer(node.parts[1], filters)

        def loop(env: dict, made: bool) -> Pieces:
            items = iter(over(env) or ())
            now = next(items, items)
            i = 0
            while now is not items:
                after = next(items, items)
                yield from body(env | {value: now, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": after is items}}, made)
                now, i = after, i + 1

        return loop
    steps = [_writer(p, filters) for p in node.parts]

    def block(env: dict, made: bool) -> Pieces:
        for step in steps:
            yield from step(env, made)

    return block


def compile_template(source: str, filters: Mapping[str, Callable[[str], Any]] | None = None) -> Callable[[Mapping], Pieces]:
    """A function of names that renders the template, piece by piece: (text, generated)."""
    known = FILTERS | dict(filters or {})
    run = _writer(fold(parse(source, known), known), known)
    return lambda env: run(dict(env), False)
