"""Integer expressions of plans: columns, literals, + - *, with * binding tighter."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[ \t]*(?:([A-Za-z0-9_]+)|([-+*]))")


@dataclass(frozen=True)
class Literal:
    value: int


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Binary:
    op: str
    left: Node
    right: Node


Node = Literal | Name | Binary


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    body = text.rstrip(" \t")
    while at < len(body):
        m = _TOKEN.match(body, at)
        if not m:
            raise ValueError(f"unexpected character {body[at:].lstrip()[:1]!r} in {text!r}")
        out.append(m[1] or m[2])
        at = m.end()
    return out


def parse(text: str) -> Node:
    tokens = _tokens(text)
    at = 0

    def operand() -> Node:
        nonlocal at
        if at >= len(tokens) or tokens[at] in "+-*":
            raise ValueError(f"an operand is missing in {text!r}")
        token = tokens[at]
        at += 1
        if token.isascii() and token.isdigit() and int(token) < 2**63:
            return Literal(int(token))
        return Name(token)

    def chain(ops: str, below: Callable[[], Node]) -> Node:
        nonlocal at
        node = below()
        while at < len(tokens) and tokens[at] in ops:
            op = tokens[at]
            at += 1
            node = Binary(op, node, below())
        return node

    tree = chain("+-", lambda: chain("*", operand))
    if at < len(tokens):
        raise ValueError(f"an operator is missing before {tokens[at]!r} in {text!r}")
    return tree


def compile_expr(node: Node, integer: Callable[[str], Column | None]) -> Column:
    """The expression over bigint columns. `integer` gives a column, or None if there is no
    integer column of that name; then, and on overflow, the result is null."""
    if isinstance(node, Literal):
        return F.lit(node.value).cast("bigint")
    if isinstance(node, Name):
        found = integer(node.name)
        return F.lit(None).cast("bigint") if found is None else found.cast("bigint")
    left, right = compile_expr(node.left, integer), compile_expr(node.right, integer)
    return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[node.op](left, right)
