"""Bounded arithmetic over a column of expressions: numbers, + - * / // % **, signs and parentheses."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Limits on length, nesting, magnitude and exponent.
MOST_CHARS, MOST_DEPTH, MOST_VALUE, MOST_EXPONENT = 200, 20, 1e100, 12
_LEXEME = re.compile(r"\s*(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\*\*|//|[-+*/%()])")
_BINDING = {"+": 10, "-": 10, "*": 20, "/": 20, "//": 20, "%": 20, "**": 40}
_SIGN = 30


class _Parser:
    """Precedence climbing: each operator takes what binds tighter on its right."""

    def __init__(self, text: str):
        self.lexemes, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _LEXEME.match(text, at)
            if not m:
                raise ValueError("not arithmetic")
            self.lexemes.append(m[1])
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.lexemes[self.at] if self.at < len(self.lexemes) else ""

    def take(self) -> str:
        self.at += 1
        return self.lexemes[self.at - 1] if self.at <= len(self.lexemes) else ""

    def climb(self, least: int, depth: int) -> float:
        if depth > MOST_DEPTH:
            raise ValueError("too deep")
        first = self.take()
        if first in ("+", "-"):
            left = self.climb(_SIGN, depth + 1) * (-1 if first == "-" else 1)
        elif first == "(":
            left = self.climb(0, depth + 1)
            if self.take() != ")":
                raise ValueError("unbalanced")
        elif first and (first[0].isdigit() or first[0] == "."):
            left = float(first) if re.search(r"[.eE]", first) else int(first)
        else:
            raise ValueError("a number is missing")
        while self.peek() in _BINDING and _BINDING[self.peek()] >= least:
            op = self.take()
            right = self.climb(_SIGN if op == "**" else _BINDING[op] + 1, depth + 1)
            left = self.apply(op, left, right)
        if abs(left) > MOST_VALUE:
            raise ValueError("too large")
        return left

    @staticmethod
    def apply(op: str, x: float, y: float) -> float:
        if op == "**" and abs(y) > MOST_EXPONENT:
            raise ValueError("exponent too large")
        return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "//": lambda: x // y, "%": lambda: x % y, "**": lambda: x**y}[op]()


def value_of(expression: str | None) -> float | None:
    """The value, or None for what is not a permitted expression."""
    if not expression or not expression.strip() or len(expression) > MOST_CHARS:
        return None
    try:
        parser = _Parser(expression)
        out = parser.climb(0, 0)
        return float(out) if parser.at == len(parser.lexemes) and not isinstance(out, complex) else None
    except (ValueError, ZeroDivisionError, OverflowError, TypeError):
        return None


@F.pandas_udf(T.DoubleType())
def evaluate(expressions: pd.Series) -> pd.Series:
    return expressions.map(value_of).astype("float64")
