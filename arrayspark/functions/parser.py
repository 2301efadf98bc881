"""The element-wise expression language: text to a tree.

    list   := expr { "," expr }
    expr   := term { ("+" | "-") term }
    term   := factor { ("*" | "/" | "%") factor }
    factor := power { ("^" | "**") power }        from left to right: 2^3^2 is 64
    power  := { "-" | "+" } base                  so -x^2 is (-x)^2
    base   := number | name | f1 power | f2 "(" expr "," expr ")" | "(" list ")"

Names are lower case; a function of one argument needs no parentheses. A bound name shadows a function.
Lists parse, but have no meaning yet and are refused.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection
from dataclasses import dataclass

from ..meta import ArrayError


@dataclass(frozen=True)
class Node:
    """``op``: number, name, call or one of + - * / % ^ neg."""

    op: str
    args: tuple = ()
    value: object = None


#: Other spellings, and what they are spellings of.
ALIASES = {"absolute": "abs", "arcsin": "asin", "arccos": "acos", "arctan": "atan", "arctan2": "atan2", "negative": "negate", "power": "pow"}
ONE = frozenset("abs acos asin atan ceil cos cosh exp floor log log10 negate sin sinh sqrt tan tanh".split())
TWO = frozenset("atan2 max min pow".split())

_TOKEN = re.compile(r"\s*(?:(?P<number>(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)|(?P<name>[a-z][a-z0-9_.]*)|(?P<op>\*\*|[-+*/%^(),]))")


class Parser:
    def __init__(self, text: str, names: Collection[str], is_udf: Callable[[str], bool] = lambda name: False):
        self.text, self.names, self.is_udf = text, names, is_udf
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise ArrayError(f"can't read {text[at:].strip()[:20]!r} in {text!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def parse(self) -> Node:
        out = self.expr()
        if self.peek() == ",":
            raise ArrayError("lists of expressions have no value")
        if self.at < len(self.tokens):
            raise ArrayError(f"{self.tokens[self.at][1]!r} is out of place in {self.text!r}")
        return out

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" else None

    def take(self, *ops: str) -> str | None:
        if (op := self.peek()) in ops:
            self.at += 1
            return op
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            raise ArrayError(f"{op!r} is missing in {self.text!r}")

    def chain(self, below: Callable[[], Node], *ops: str) -> Node:
        out = below()
        while op := self.take(*ops):
            out = Node("^" if op == "**" else op, (out, below()))
        return out

    def expr(self) -> Node:
        return self.chain(self.term, "+", "-")

    def term(self) -> Node:
        return self.chain(self.factor, "*", "/", "%")

    def factor(self) -> Node:
        return self.chain(self.power, "^", "**")

    def power(self) -> Node:
        minus = False
        while sign := self.take("-", "+"):
            minus ^= sign == "-"
        out = self.base()
        return Node("neg", (out,)) if minus else out

    def arguments(self, least: int, most: int, name: str) -> tuple[Node, ...]:
        self.need("(")
        out = [self.expr()]
        while self.take(","):
            out.append(self.expr())
        self.need(")")
        if not least <= len(out) <= most:
            raise ArrayError(f"{name} takes another number of arguments than {len(out)}")
        return tuple(out)

    def base(self) -> Node:
        if self.at >= len(self.tokens):
            raise ArrayError(f"{self.text!r} ends too early")
        kind, word = self.tokens[self.at]
        if kind == "op":
            self.need("(")
            out = self.expr()
            if self.peek() == ",":
                raise ArrayError("lists of expressions have no value")
            self.need(")")
            return out
        self.at += 1
        if kind == "number":
            return Node("number", value=float(word))
        if word in self.names:
            return Node("name", value=word)
        name = ALIASES.get(word, word)
        if name in ONE:
            return Node("call", (self.power(),), name)
        if name in TWO:
            return Node("call", self.arguments(2, 2, name), name)
        if self.is_udf(word):
            return Node("call", self.arguments(1, 7, word), word)
        raise ArrayError(f"nothing is called {word!r}")


def parse(text: str, names: Collection[str] = (), is_udf: Callable[[str], bool] = lambda name: False) -> Node:
    return Parser(text, names, is_udf).parse()
