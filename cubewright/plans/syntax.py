"""Lexer and Pratt parser: DAX text to a syntax tree of frozen nodes."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from cubewright.errors import DaxSyntaxError


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Literal(Node):
    value: object


@dataclass(frozen=True)
class Name(Node):
    """A bare or quoted name: a variable or a table."""

    name: str
    quoted: bool = False


@dataclass(frozen=True)
class Ref(Node):
    """``T[c]`` or ``[name]``."""

    table: str | None
    column: str


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node | None, ...]


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Unary(Node):
    op: str
    arg: Node


@dataclass(frozen=True)
class Let(Node):
    bindings: tuple[tuple[str, Node], ...]
    body: Node


@dataclass(frozen=True)
class Rows(Node):
    """``{a, b}`` or ``{(a, b), (c, d)}``."""

    rows: tuple[tuple[Node, ...], ...]


_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|--[^\n]*|/\*.*?\*/)
      | (?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
      | (?P<string>"(?:[^"]|"")*")
      | (?P<quoted>'(?:[^']|'')*')
      | (?P<column>\[(?:[^\]]|\]\])*\])
      | (?P<name>[^\W\d](?:\w|\.(?=\w))*)
      | (?P<op><=|>=|<>|==|&&|\|\||[-+*/^&=<>(){},])
    """,
    re.VERBOSE | re.DOTALL,
)
_LEVEL = {"||": 1, "&&": 2, "=": 4, "==": 4, "<>": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "IN": 4, "&": 5, "+": 6, "-": 6, "*": 7, "/": 7, "^": 9}
_NOT, _SIGN = 3, 8


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise DaxSyntaxError(f"unexpected {text[at]!r} at {at}")
        at = m.end()
        if m.lastgroup != "space":
            out.append((m.lastgroup, m.group()))
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.at = tokens(text), 0

    @property
    def now(self) -> tuple[str, str]:
        return self.tokens[self.at]

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def word(self) -> str:
        return self.now[1].upper() if self.now[0] == "name" else self.now[1]

    def take(self, what: str) -> None:
        if self.word() != what:
            raise DaxSyntaxError(f"expected {what!r}, found {self.now[1] or 'the end'!r}")
        self.at += 1

    def whole(self) -> Node:
        node = self.expression()
        if self.now[0] != "end":
            raise DaxSyntaxError(f"unexpected {self.now[1]!r}")
        return node

    def expression(self, level: int = 0) -> Node:
        if self.word() == "VAR" and self.now[0] == "name":
            return self.let()
        left = self.prefix()
        while (rank := _LEVEL.get(self.word(), 0)) > level and self.now[0] in ("op", "name"):
            op = self.next()[1].upper()
            left = Binary(op, left, self.expression(rank))
        return left

    def let(self) -> Node:
        bindings = []
        while self.now[0] == "name" and self.word() == "VAR":
            self.next()
            kind, name = self.next()
            if kind != "name":
                raise DaxSyntaxError("a variable needs a name")
            self.take("=")
            bindings.append((name.lower(), self.expression()))
        self.take("RETURN")
        return Let(tuple(bindings), self.expression())

    def prefix(self) -> Node:
        kind, text = self.next()
        if kind == "number":
            return Literal(int(text) if text.isdigit() else float(text))
        if kind == "string":
            return Literal(text[1:-1].replace('""', '"'))
        if kind == "column":
            return Ref(None, text[1:-1].replace("]]", "]"))
        if kind == "quoted":
            return self.table(text[1:-1].replace("''", "'"), True)
        if text in ("-", "+"):
            arg = self.expression(_SIGN)
            return arg if text == "+" else Literal(-arg.value) if isinstance(arg, Literal) and isinstance(arg.value, (int, float)) else Unary("-", arg)
        if text == "(":
            first = self.expression()
            if self.word() == ",":
                raise DaxSyntaxError("a tuple stands only before IN or inside braces")
            self.take(")")
            return first
        if text == "{":
            return self.rows()
        if kind == "name":
            if text.upper() == "NOT":  # binds looser than comparisons: NOT (a) = b negates a = b
                return Unary("NOT", self.expression(_NOT))
            if self.now[1] == "(":
                return Call(text.upper(), self.arguments())
            return self.table(text, False)
        raise DaxSyntaxError(f"unexpected {text or 'end'!r}")

    def table(self, name: str, quoted: bool) -> Node:
        if self.now[0] == "column":
            column = self.next()[1][1:-1].replace("]]", "]")
            return Ref(name, column)
        return Name(name, quoted)

    def arguments(self) -> tuple[Node | None, ...]:
        self.take("(")
        out: list[Node | None] = []
        while self.word() != ")":
            out.append(None if self.word() == "," else self.expression())
            if self.word() == ",":
                self.next()
                if self.word() == ")":
                    out.append(None)
            elif self.word() != ")":
                raise DaxSyntaxError(f"expected ',' or ')', found {self.now[1] or 'the end'!r}")
        self.take(")")
        return tuple(out)

    def rows(self) -> Node:
        out = []
        while self.word() != "}":
            if self.word() == "(":
                start = self.at
                try:
                    row = self.arguments()
                    if self.word() not in (",", "}"):
                        raise DaxSyntaxError("no tuple")
                    out.append(row)
                except DaxSyntaxError:
                    self.at = start
                    out.append((self.expression(),))
            else:
                out.append((self.expression(),))
            if self.word() == ",":
                self.next()
        self.take("}")
        return Rows(tuple(out))


@lru_cache(maxsize=4096)
def parse(text: str) -> Node:
    """The tree of an expression; a leading ``=`` is allowed."""
    text = text.strip()
    # T[d].[Year] is read as YEAR(T[d]) and so on; T[d].[Date] as T[d] itself.
    text = _variations(text)
    return _Parser(text.removeprefix("=") if text.startswith("=") and not text.startswith("==") else text).whole()


_PART = re.compile(r"((?:'(?:[^']|'')*'|[^\W\d]\w*)\[[^\]]*\])\.\[(Date|Year|Month|MonthNo|Quarter|QuarterNo|Day)\]")


def _variations(text: str) -> str:
    as_call = {"Date": "{}", "Year": "YEAR({})", "MonthNo": "MONTH({})", "Month": 'FORMAT({}, "mmmm")', "QuarterNo": "QUARTER({})", "Quarter": '("Qtr " & QUARTER({}))', "Day": "DAY({})"}
    return _PART.sub(lambda m: as_call[m[2]].format(m[1]), text)


def walk(node: Node | None):
    """The node and everything below it."""
    if node is None:
        return
    yield node
    if isinstance(node, Call):
        below = node.args
    elif isinstance(node, Binary):
        below = (node.left, node.right)
    elif isinstance(node, Unary):
        below = (node.arg,)
    elif isinstance(node, Let):
        below = (*(b for _, b in node.bindings), node.body)
    elif isinstance(node, Rows):
        below = tuple(x for row in node.rows for x in row)
    else:
        below = ()
    for x in below:
        yield from walk(x)
