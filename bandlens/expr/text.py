"""Formulas as text: an infix form that parses back to the same tree, and JSON."""

from __future__ import annotations

import json

from bandlens.expr.ast import Aggregation, Constant, FormulaSet, Node, Operation, Variable

INFIX = {"add": "+", "sub": "-", "mul": "*", "div": "/"}


def show(node: Node | FormulaSet | None, digits: int | None = None) -> str:
    """``(a + b)``, ``(1 / x)`` for inv, ``(-x)``, ``name(a, b)`` else; a set is ``[a; b; None]``. ``digits`` shortens constants."""
    if node is None:
        return "None"
    if isinstance(node, FormulaSet):
        return "[" + "; ".join(show(s, digits) for s in node.slots) + "]"
    if isinstance(node, Constant):
        return repr(node.value) if digits is None else f"{node.value:.{digits}g}"
    if isinstance(node, Variable):
        return node.name
    if isinstance(node, Aggregation):
        return str(node)
    assert isinstance(node, Operation)
    parts = [show(c, digits) for c in node.operands]
    if node.name in INFIX:
        return f"({parts[0]} {INFIX[node.name]} {parts[1]})"
    if node.name == "neg":
        return f"(-{parts[0]})"
    if node.name == "inv":
        return f"(1 / {parts[0]})"
    return f"{node.name}({', '.join(parts)})"


def to_json(node: Node) -> str:
    def encode(n: Node):
        if isinstance(n, Constant):
            return {"c": n.value}
        if isinstance(n, Variable):
            return {"v": n.index, "name": n.name}
        if isinstance(n, Aggregation):
            return {"agg": [n.stat, n.start, n.end, n.spatial, n.half, n.band]}
        return {"op": n.name, "of": [encode(c) for c in n.children]}

    return json.dumps(encode(node))


def from_json(text: str) -> Node:
    def decode(x: dict) -> Node:
        if "c" in x:
            return Constant(float(x["c"]))
        if "v" in x:
            return Variable(x["v"], x["name"])
        if "agg" in x:
            return Aggregation(*x["agg"])
        return Operation(x["op"], tuple(decode(c) for c in x["of"]))

    return decode(json.loads(text))
