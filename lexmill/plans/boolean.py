"""The boolean query language: tokens, tree, and its compilation to one Column.

Terms, AND, OR and parentheses. Operators are upper case, take effect from left to right without
precedence, and join exactly two operands. Malformed queries are read leniently: a term without an
operator before it is dropped, a leading or doubled operator waits for its operands (the last one
counts), an unclosed parenthesis ends with the query, and a stray closing one ends the query.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import words


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Pair:
    op: str
    left: Tree
    right: Tree


Tree = Term | Pair | None


def tokenize(query: str) -> list[str]:
    for mark in "()":
        query = query.replace(mark, f" {mark} ")
    return query.split()


class _Level:
    """What has been read since an opening parenthesis: an operand so far and an operator that waits."""

    def __init__(self) -> None:
        self.value: Tree = None
        self.op: str | None = None

    def take(self, operand: Tree) -> None:
        if self.value is None:
            self.value = operand
        elif self.op is not None:
            self.value, self.op = Pair(self.op, self.value, operand), None


def parse(query: str) -> Tree:
    levels = [_Level()]
    for token in tokenize(query):
        match token:
            case "(":
                levels.append(_Level())
            case ")":
                if len(levels) == 1:
                    break
                inner = levels.pop()
                levels[-1].take(inner.value)
            case "AND" | "OR":
                levels[-1].op = token
            case _:
                levels[-1].take(Term(token))
    while len(levels) > 1:
        inner = levels.pop()
        levels[-1].take(inner.value)
    return levels[0].value


def terms(tree: Tree) -> list[str]:
    """Lower-cased terms from left to right; a term that occurs twice is listed twice."""
    if isinstance(tree, Term):
        return [tree.text.lower()]
    if isinstance(tree, Pair):
        return terms(tree.left) + terms(tree.right)
    return []


def simplify(tree: Tree) -> Tree:
    """The same rows with fewer tests: absent operands are folded, equal ones joined."""
    if not isinstance(tree, Pair):
        return tree
    left, right = simplify(tree.left), simplify(tree.right)
    if left == right:
        return left
    if left is None or right is None:
        return None if tree.op == "AND" else left or right
    return Pair(tree.op, left, right)


def condition(tree: Tree, text: Column, exact: bool = False) -> Column:
    """True for texts that match: terms as substrings, or with exact as whole white-space tokens, ignoring case."""
    low, tokens = F.lower(text), words(text)

    def build(t: Tree) -> Column:
        if isinstance(t, Term):
            term = F.lit(t.text.lower())
            return F.array_contains(tokens, term) if exact else F.contains(low, term)
        left, right = build(t.left), build(t.right)
        return left & right if t.op == "AND" else left | right

    tree = simplify(tree)
    return F.lit(False) if tree is None else F.coalesce(build(tree), F.lit(False))


def matches(tree: Tree, text: str, exact: bool = False) -> bool:
    """The same test on one Python string."""
    if tree is None:
        return False
    if isinstance(tree, Term):
        return tree.text.lower() in (text.lower().split() if exact else text.lower())
    both = (matches(side, text, exact) for side in (tree.left, tree.right))
    return all(both) if tree.op == "AND" else any(both)


def random_query(rng: random.Random, vocabulary: list[str], depth: int = 3) -> str:
    """For tests: a well-formed query."""
    if depth == 0 or rng.random() < 0.3:
        return rng.choice(vocabulary)
    return f"({random_query(rng, vocabulary, depth - 1)} {rng.choice(('AND', 'OR'))} {random_query(rng, vocabulary, depth - 1)})"
