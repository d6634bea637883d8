"""Parsing formulas: infix with the usual precedence, calls, unary minus, aggregations and sets."""

from __future__ import annotations

import re

from bandlens.expr.ast import Aggregation, Constant, FormulaSet, Node, Operation, Variable
from bandlens.functions.guards import operator

_NUMBER = r"(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?:nan|inf)\b"
_WINDOW = r"[a-z]+_sp\(w\d+(?:,\s*f\d+)?\)"
_REDUCTION = r"(?:d\d+_)?(?:[a-z]+|percentile\d+(?:\.\d+)?)\(v\d+-v\d+\)"
_TOKEN = re.compile(rf"\s*(?:(?P<agg>{_WINDOW}(?:_{_REDUCTION})?|{_REDUCTION})|(?P<number>{_NUMBER})|(?P<name>[A-Za-z_]\w*)|(?P<sign>[-+*/^(),]))")
#: Binding strength; ^ is power and groups to the right.
_STRENGTH = {"+": 1, "-": 1, "*": 2, "/": 2, "^": 4}


def aggregation(text: str) -> Aggregation:
    """An aggregation from its written form, bands counted from 1."""
    w = re.match(r"([a-z]+)_sp\(w(\d+)(?:,\s*f(\d+))?\)_?", text)
    rest = text[w.end() :] if w else text
    r = re.fullmatch(r"((?:d\d+_)?[a-z]+(?:\d+(?:\.\d+)?)?)\(v(\d+)-v(\d+)\)", rest) if rest else None
    if rest and not r:
        raise ValueError(f"unknown aggregation {text!r}")
    return Aggregation(
        r[1] if r else None, int(r[2]) - 1 if r else None, int(r[3]) - 1 if r else None,
        w[1] if w else None, int(w[2]) if w else None, int(w[3]) - 1 if w and w[3] else None,
    )


class _Parser:
    def __init__(self, text: str, variables: list[str]) -> None:
        self.text, self.variables, self.tokens, at = text, {v: i for i, v in enumerate(variables)}, [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                if not text[at:].strip():
                    break
                raise ValueError(f"cannot read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str | None, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, "")

    def take(self, sign: str) -> None:
        if self.peek()[1] != sign:
            raise ValueError(f"{sign!r} expected in {self.text!r}")
        self.at += 1

    def infix(self, least: int = 1) -> Node:
        left = self.prefix()
        while (strength := _STRENGTH.get(self.peek()[1], 0)) >= least and self.peek()[0] == "sign":
            sign = self.peek()[1]
            self.at += 1
            right = self.infix(strength if sign == "^" else strength + 1)
            if sign == "/" and left == Constant(1.0):
                left = Operation("inv", (right,))  # as inv is written; 1 / x and inv differ only in their guards
            else:
                left = Operation(sign, (left, right))
        return left

    def prefix(self) -> Node:
        kind, text = self.peek()
        if text == "-" and kind == "sign":
            self.at += 1
            if self.peek()[0] == "number":
                return Constant(-self.number())
            return Operation("neg", (self.infix(3),))
        if text == "(":
            self.at += 1
            inner = self.infix()
            self.take(")")
            return inner
        if kind == "number":
            return Constant(self.number())
        if kind == "agg":
            self.at += 1
            return aggregation(text)
        if kind == "name":
            self.at += 1
            if text in self.variables:
                return Variable(self.variables[text], text)
            if self.peek()[1] != "(":
                raise ValueError(f"unknown variable {text!r}")
            self.at += 1
            operands = [self.infix()]
            while self.peek()[1] == ",":
                self.at += 1
                operands.append(self.infix())
            self.take(")")
            return Operation(operator(text).name, tuple(operands))
        raise ValueError(f"unexpected {text or 'end'!r} in {self.text!r}")

    def number(self) -> float:
        value = float(self.peek()[1])
        self.at += 1
        return value


def parse(text: str, variables: list[str]) -> Node:
    """A formula from text; one missing closing parenthesis is added, one missing opening one too."""
    if not isinstance(text, str) or not text.strip():
        raise ValueError("an empty formula")
    missing = text.count("(") - text.count(")")
    if missing == 1:
        text += ")"
    elif missing == -1:
        text = "(" + text
    p = _Parser(text, variables)
    node = p.infix()
    if p.at < len(p.tokens):
        raise ValueError(f"unexpected {p.peek()[1]!r} in {text!r}")
    return node


def parse_set(text: str, variables: list[str]) -> FormulaSet:
    """``[a; b; None]``; commas outside parentheses separate too, and nan is None."""
    inner = text.strip().removeprefix("[").removesuffix("]")
    parts, level, start = [], 0, 0
    for i, c in enumerate(inner):
        level += (c == "(") - (c == ")")
        if c in ";," and level == 0:
            parts.append(inner[start:i])
            start = i + 1
    parts.append(inner[start:])
    return FormulaSet(tuple(None if p.strip().lower() in ("none", "nan", "") else parse(p, variables) for p in parts))


def parse_any(text: str, variables: list[str]) -> Node | FormulaSet:
    return parse_set(text, variables) if text.strip().startswith("[") else parse(text, variables)
