"""Formula trees: immutable nodes for variables, constants, aggregations and operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

from bandlens.functions import bands
from bandlens.functions.guards import operator
from bandlens.operators.windows import WINDOW_STATISTICS


@dataclass(frozen=True)
class Node:
    """A part of a formula; equality is by structure, and constants are equal only if identical."""

    @property
    def children(self) -> tuple[Node, ...]:
        return ()

    def with_children(self, children: tuple[Node, ...]) -> Node:
        if children:
            raise ValueError("a leaf has no children")
        return self

    @cached_property
    def size(self) -> int:
        return 1 + sum(c.size for c in self.children)

    @cached_property
    def depth(self) -> int:
        return 1 + max((c.depth for c in self.children), default=0)

    @cached_property
    def census(self) -> tuple[int, int, int, int]:
        """Numbers of constants, variables, aggregations and operators of two operands."""
        if not self.children:
            return int(isinstance(self, Constant)), int(isinstance(self, Variable)), int(isinstance(self, Aggregation)), 0
        parts = [c.census for c in self.children]
        return (*(sum(p[i] for p in parts) for i in range(3)), sum(p[3] for p in parts) + (len(parts) == 2))

    @cached_property
    def spots(self) -> tuple[tuple[tuple[int, ...], Node], ...]:
        """All nodes with their paths from the root."""
        return ((), self), *(((i, *at), n) for i, c in enumerate(self.children) for at, n in c.spots)


@dataclass(frozen=True)
class Variable(Node):
    index: int
    name: str


@dataclass(frozen=True)
class Constant(Node):
    value: float


@dataclass(frozen=True)
class Aggregation(Node):
    """A reduction of bands ``start``..``end`` (``stat``), of a window of half-size ``half`` (``spatial``) on one band (``band``), or of windows over all the bands."""

    stat: str | None = None
    start: int | None = None
    end: int | None = None
    spatial: str | None = None
    half: int | None = None
    band: int | None = None

    def check(self, n_bands: int) -> None:
        """ValueError for an unknown statistic, a half-size below 1, a band out of range, or a band together with a reduction."""
        if self.spatial is not None:
            if self.spatial not in WINDOW_STATISTICS or self.half is None or self.half < 1:
                raise ValueError("a window needs a known statistic and a half-size of at least 1")
            if self.band is not None and not 0 <= self.band < n_bands:
                raise ValueError(f"band {self.band} is not within 0..{n_bands - 1}")
            if (self.band is None) == (self.stat is None):
                raise ValueError("a window works on one band or below a reduction of bands")
        elif self.half is not None or self.band is not None:
            raise ValueError("a half-size or a band needs a window's statistic")
        if self.stat is not None:
            bands.check(self.stat, self.start, self.end, n_bands)

    def __str__(self) -> str:
        window = None
        if self.spatial is not None:
            window = f"{self.spatial}_sp(w{self.half}{'' if self.band is None else f',f{self.band + 1}'})"
        reduction = None if self.stat is None else bands.label(self.stat, self.start, self.end)
        return "_".join(x for x in (window, reduction) if x) or "identity"


@dataclass(frozen=True)
class Operation(Node):
    name: str
    operands: tuple[Node, ...]

    def __post_init__(self) -> None:
        op = operator(self.name)
        if len(self.operands) != op.arity:
            raise ValueError(f"{op.name} takes {op.arity} operands, not {len(self.operands)}")
        object.__setattr__(self, "name", op.name)

    @cached_property
    def _hash(self) -> int:
        return hash((self.name, self.operands))

    def __hash__(self) -> int:
        """Kept, as trees are looked up by their subtrees all the time."""
        return self._hash

    @property
    def children(self) -> tuple[Node, ...]:
        return self.operands

    def with_children(self, children: tuple[Node, ...]) -> Node:
        return Operation(self.name, tuple(children))


def op(name: str, *operands: Node) -> Operation:
    return Operation(name, operands)


def preorder(node: Node) -> Iterator[Node]:
    yield node
    for c in node.children:
        yield from preorder(c)


def postorder(node: Node) -> Iterator[Node]:
    for c in node.children:
        yield from postorder(c)
    yield node


def places(node: Node) -> tuple[tuple[tuple[int, ...], Node], ...]:
    """All nodes with their paths from the root."""
    return node.spots


def get_at(node: Node, at: tuple[int, ...]) -> Node:
    for i in at:
        node = node.children[i]
    return node


def put_at(node: Node, at: tuple[int, ...], new: Node) -> Node:
    """The tree with another subtree at a path."""
    if not at:
        return new
    children = list(node.children)
    children[at[0]] = put_at(children[at[0]], at[1:], new)
    return node.with_children(tuple(children))


def rebuild(node: Node, f: Callable[[Node], Node]) -> Node:
    """``f`` applied from the leaves up."""
    if node.children:
        new = tuple(rebuild(c, f) for c in node.children)
        if any(a is not b for a, b in zip(new, node.children, strict=True)):
            node = node.with_children(new)
    return f(node)


def constants(node: Node) -> list[float]:
    """Values of the constants, in post-order."""
    return [n.value for n in postorder(node) if isinstance(n, Constant)]


def with_constants(node: Node, values: list[float]) -> Node:
    """The tree with its constants replaced in post-order; ValueError if the numbers differ."""
    if len(values) != len(constants(node)):
        raise ValueError(f"{len(constants(node))} constants, {len(values)} values")
    it = iter(values)
    return rebuild(node, lambda n: replace(n, value=float(next(it))) if isinstance(n, Constant) else n)


def regularised_constants(node: Node) -> list[float]:
    """Constants that are no mere offsets: those with anything but add, sub and neg above them."""

    def walk(n: Node, offset: bool) -> Iterator[float]:
        if isinstance(n, Constant) and not offset:
            yield n.value
        for c in n.children:
            yield from walk(c, offset and n.name in ("add", "sub", "neg"))

    return list(walk(node, True))


@dataclass(frozen=True)
class Limits:
    """What makes a formula valid.

    ``weights``: complexity of an operator (by name), ``variable``, ``constant`` or ``aggregation``, 1 by
    default. ``children``: for an operator the largest complexity of its operands (one number, or one
    for each; -1 is no limit). ``nested``: for an operator the operators that may follow each other
    below it: 0 forbids one as a direct operand, k > 0 bounds the length of its chain from there.
    """

    max_complexity: float | None = None
    weights: dict[str, float] | None = None
    children: dict[str, int | tuple[int, ...]] | None = None
    nested: dict[str, dict[str, int]] | None = None

    def weight(self, node: Node) -> float:
        name = node.name if isinstance(node, Operation) else type(node).__name__.lower()
        return (self.weights or {}).get(name, 1.0)

    def complexity(self, node: Node) -> float:
        return sum(self.weight(n) for _, n in node.spots) if self.weights else float(node.size)

    def valid(self, node: Node) -> bool:
        if self.max_complexity is not None and self.complexity(node) > self.max_complexity + 1e-9:
            return False
        for _, n in node.spots if self.children or self.nested else ():
            if not isinstance(n, Operation):
                continue
            most = (self.children or {}).get(n.name)
            if most is not None:
                each = most if isinstance(most, tuple) else (most,) * len(n.operands)
                if any(m >= 0 and self.complexity(c) > m for m, c in zip(each, n.operands, strict=True)):
                    return False
            for inner, allowed in (self.nested or {}).get(n.name, {}).items():
                if any(chain(c, inner) > allowed for c in n.operands):
                    return False
        return True


def chain(node: Node, name: str) -> int:
    """How many operations of one name follow each other from a node down."""
    if not isinstance(node, Operation) or node.name != name:
        return 0
    return 1 + max(chain(c, name) for c in node.operands)


@dataclass(frozen=True)
class FormulaSet:
    """A fixed number of slots, each a formula or None; its value is a vector with one element for each formula."""

    slots: tuple[Node | None, ...]

    @cached_property
    def formulas(self) -> tuple[Node, ...]:
        return tuple(s for s in self.slots if s is not None)

    @property
    def order(self) -> int:
        return len(self.formulas)

    @property
    def size(self) -> int:
        return sum(f.size for f in self.formulas)

    def complexity(self, limits: Limits) -> float:
        return sum(limits.complexity(f) for f in self.formulas)

    def valid(self, limits: Limits) -> bool:
        """Some formula, each valid, and together within the limit."""
        if not self.formulas or (limits.max_complexity is not None and self.complexity(limits) > limits.max_complexity + 1e-9):
            return False
        return all(limits.valid(f) for f in self.formulas)

    def constants(self) -> list[float]:
        return [c for f in self.formulas for c in constants(f)]

    def with_constants(self, values: list[float]) -> FormulaSet:
        values, out = list(values), []
        for s in self.slots:
            n = 0 if s is None else len(constants(s))
            out.append(None if s is None else with_constants(s, values[:n]))
            values = values[n:]
        return FormulaSet(tuple(out))


def count_leaves(node: Node, kind: type) -> int:
    return sum(isinstance(n, kind) for n in preorder(node))
