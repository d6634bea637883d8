"""Rewriting formulas to smaller ones with the same values.

Rules keep the guarded value for finite operands of moderate size. Some do not where a guard
acts (see :func:`simplify`); they apply only with ``loose``.
"""

from __future__ import annotations

import math

import numpy as np

from bandlens.expr.ast import Constant, FormulaSet, Node, Operation, rebuild
from bandlens.functions.guards import operator

CLOSE = 1e-10
PASSES = 10


def _is(node: Node, value: float) -> bool:
    return isinstance(node, Constant) and abs(node.value - value) <= CLOSE


def _step(n: Node, loose: bool) -> Node:
    if isinstance(n, Constant):
        near = next((v for v in (0.0, 1.0) if n.value != v and abs(n.value - v) <= CLOSE), None)
        return n if near is None else Constant(near)
    if not isinstance(n, Operation):
        return n
    if all(isinstance(c, Constant) for c in n.operands):
        value = float(operator(n.name).numpy(*[np.float64(c.value) for c in n.operands]))
        return Constant(value) if math.isfinite(value) else n
    if n.name == "identity":
        return n.operands[0]
    if n.name == "neg":
        x = n.operands[0]
        return x.operands[0] if isinstance(x, Operation) and x.name == "neg" else n
    if len(n.operands) < 2:
        return n
    x, y = n.operands
    if n.name == "add":
        if _is(x, 0):
            return y
        if _is(y, 0):
            return x
        for a, b in ((x, y), (y, x)):
            if isinstance(b, Operation) and b.name == "neg":
                return Operation("sub", (a, b.operands[0]))
            if isinstance(b, Operation) and b.name == "sub" and b.operands[1] == a:
                return b.operands[0]
    elif n.name == "sub":
        if _is(y, 0):
            return x
        if x == y:
            return Constant(0.0)
        if _is(x, 0):
            return Operation("neg", (y,))
        if isinstance(y, Operation) and y.name == "neg":
            return Operation("add", (x, y.operands[0]))
    elif n.name == "mul":
        for a, b in ((x, y), (y, x)):
            if _is(a, 0):
                return Constant(0.0)
            if _is(a, 1):
                return b
            if _is(a, -1):
                return Operation("neg", (b,))
            if loose and isinstance(b, Operation) and b.name == "div" and b.operands[1] == a:
                return b.operands[0]
    elif n.name == "div":
        if _is(y, 1):
            return x
        if _is(y, 0):
            return Constant(1.0)
        if x == y:
            return Constant(1.0)  # also the guard's value at 0
        if loose and _is(x, 0):
            return Constant(0.0)
        if loose and isinstance(x, Operation) and x.name == "mul" and y in x.operands:
            return x.operands[1] if x.operands[0] == y else x.operands[0]
        if loose and isinstance(y, Operation) and y.name == "mul" and x in y.operands:
            return Operation("inv", (y.operands[1] if y.operands[0] == x else y.operands[0],))
    return n


def simplify(node: Node | FormulaSet, loose: bool = False) -> Node | FormulaSet:
    """The rewritten formula after at most ten passes.

    ``loose`` adds rules that change values only where a guard acts: 0 / x to 0, (y / x) * x and
    (x * y) / x to y, x / (x * y) to inv(y).
    """
    if isinstance(node, FormulaSet):
        return FormulaSet(tuple(None if s is None else simplify(s, loose) for s in node.slots))
    for _ in range(PASSES):
        new = rebuild(node, lambda n: _step(n, loose))
        if new == node:
            break
        node = new
    return node
