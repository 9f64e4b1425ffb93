"""Expressions over count tables, parsed and compiled to Spark columns.

Grammar, loosest first (all binary operators associate to the left)::

    either := without ('|' mode without)*        without := differ ('-' differ)*
    differ := both ('^' both)*                   both    := limited ('&' mode limited)*
    limited := counted ('[' ranges ']' | '{' ranges '}')*
    counted := '#' atom | atom                   atom    := letter | '(' either ')'

A mode is one of ``* + - < > .``; it may be missing only below a ``#``. A table letter is the count, 0 where absent.
A word is in the result if the operators' logic holds for the tables it is in and its value is positive.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.letters import modulated
from ..functions.ranges import count_ranges

MODES = "*+-<>."
MOST_TABLES = 10


class ExpressionError(ValueError):
    """Wrong syntax, with the place in the text."""

    def __init__(self, what: str, text: str, at: int):
        super().__init__(f"{what}\n    {text}\n    {' ' * at}^")
        self.at = at


@dataclass(frozen=True)
class Table:
    index: int


@dataclass(frozen=True)
class Binary:
    operator: str
    mode: str | None
    left: object
    right: object
    at: int


@dataclass(frozen=True)
class Limited:
    kind: str  # "[" counts, "{" per cent of g and c
    ranges: tuple[tuple[int, int], ...]
    inner: object


@dataclass(frozen=True)
class Member:
    inner: object


class Parser:
    LEVELS = ("|", "-", "^", "&")

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.text[self.at] if self.at < len(self.text) else ""

    def fail(self, what: str, at: int | None = None):
        raise ExpressionError(what, self.text, self.at if at is None else at)

    def whole(self) -> object:
        tree = self.level(0)
        if self.peek():
            self.fail("do not recognise this operator")
        self.check(tree, False, False)
        return tree

    def level(self, depth: int) -> object:
        if depth == len(self.LEVELS):
            return self.limited()
        left = self.level(depth + 1)
        while self.peek() == self.LEVELS[depth]:
            operator, at, mode = self.text[self.at], self.at, None
            self.at += 1
            if operator in "|&" and self.peek() and self.peek() in MODES:
                mode = self.text[self.at]
                self.at += 1
            left = Binary(operator, mode, left, self.level(depth + 1), at)
        return left

    def limited(self) -> object:
        tree = self.counted()
        while self.peek() and self.peek() in "[{":
            kind, start = self.text[self.at], self.at + 1
            end = self.text.find("]" if kind == "[" else "}", start)
            if end < 0:
                self.fail(f"expecting {']' if kind == '[' else '}'}", len(self.text))
            try:
                ranges = count_ranges(self.text[start:end])
            except ValueError as wrong:
                self.fail(str(wrong), start)
            tree, self.at = Limited(kind, tuple(ranges), tree), end + 1
        return tree

    def counted(self) -> object:
        if self.peek() == "#":
            self.at += 1
            return Member(self.atom())
        return self.atom()

    def atom(self) -> object:
        c = self.peek()
        if c == "(":
            self.at += 1
            tree = self.level(0)
            if self.peek() != ")":
                self.fail("expecting )")
            self.at += 1
            return tree
        if c.isascii() and c.isalpha():
            index = ord(c.lower()) - ord("a")
            if index >= MOST_TABLES:
                self.fail(f"the largest argument is {chr(ord('a') + MOST_TABLES - 1)}")
            self.at += 1
            return Table(index)
        self.fail("expecting an argument or (" if c else "premature end of expression")

    def check(self, tree: object, member: bool, limited: bool) -> None:
        """Operators without mode stand below a # only, and never inside a filter's argument."""
        if isinstance(tree, Binary):
            if tree.operator in "|&" and tree.mode is None and (limited or not member):
                self.fail("operator without mode inside the argument of [] or {}" if limited else "operator without mode outside a # argument", tree.at)
            self.check(tree.left, member, limited)
            self.check(tree.right, member, limited)
        elif isinstance(tree, Limited):
            self.check(tree.inner, member, True)
        elif isinstance(tree, Member):
            self.check(tree.inner, True, False)


def parsed(text: str) -> object:
    return Parser(text).whole()


def tables_of(tree: object) -> set[int]:
    if isinstance(tree, Table):
        return {tree.index}
    if isinstance(tree, Binary):
        return tables_of(tree.left) | tables_of(tree.right)
    return tables_of(tree.inner)


def has_limit(tree: object) -> bool:
    if isinstance(tree, Binary):
        return has_limit(tree.left) or has_limit(tree.right)
    return isinstance(tree, Limited) or isinstance(tree, Member) and has_limit(tree.inner)


def presence(tree: object, counts: list[Column]) -> Column:
    """Whether the operators' logic holds for the tables a word is in."""
    if isinstance(tree, Table):
        return counts[tree.index] > 0
    if isinstance(tree, Binary):
        x, y = presence(tree.left, counts), presence(tree.right, counts)
        return {"|": x | y, "&": x & y, "^": x != y, "-": x & ~y}[tree.operator]
    return presence(tree.inner, counts)


def within(value: Column, ranges: Iterable[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for low, high in ranges:
        out = out | value.between(low, high)
    return out


def value(tree: object, counts: list[Column], gc: Column) -> Column:
    """The count of a word, 0 where it is absent."""
    zero = F.lit(0).cast("long")
    if isinstance(tree, Table):
        return counts[tree.index]
    if isinstance(tree, Member):
        inner = value(tree.inner, counts, gc) > 0 if has_limit(tree.inner) else presence(tree.inner, counts)
        return F.when(inner, 1).otherwise(0).cast("long")
    if isinstance(tree, Limited):
        x = value(tree.inner, counts, gc)
        return F.when(within(x if tree.kind == "[" else gc, tree.ranges), x).otherwise(zero)
    x, y = value(tree.left, counts, gc), value(tree.right, counts, gc)
    if (tree.operator, tree.mode) in (("|", "+"), ("|", ">"), ("|", "."), ("&", "<")):
        return modulated(x, y, tree.mode)  # where one is 0, too: arms are not named again, so long chains stay short
    if tree.operator == "|":
        return F.when(x == 0, y).when(y == 0, x).otherwise(modulated(x, y, tree.mode))
    if tree.operator == "&":
        return F.when((x == 0) | (y == 0), zero).otherwise(modulated(x, y, tree.mode))
    if tree.operator == "^":
        return F.when(x == 0, y).when(y == 0, x).otherwise(zero)
    return F.when(y == 0, x).otherwise(zero)


def least_value(tree: object, least: list[int]) -> int:
    """A lower bound of the result's counts, given lower bounds of the tables' counts."""
    if isinstance(tree, Table):
        return least[tree.index]
    if isinstance(tree, Member):
        return 1
    if isinstance(tree, Limited):
        inner = least_value(tree.inner, least)
        return max(inner, tree.ranges[0][0]) if tree.kind == "[" else inner
    x, y = least_value(tree.left, least), least_value(tree.right, least)
    both = {"*": (x + y) >> 1, "+": x + y, "-": 1, "<": min(x, y), ">": max(x, y), ".": x, None: 1}[tree.mode]
    return {"|": min(x, y, both), "&": max(both, 1), "^": min(x, y), "-": x}[tree.operator]
