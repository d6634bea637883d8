"""Random formulas: trees counted by complexity and drawn from the counts."""

from __future__ import annotations

from bisect import bisect_right
from copy import copy
from dataclasses import dataclass, field, replace
from functools import lru_cache
from itertools import accumulate

import numpy as np

from bandlens.expr.ast import Aggregation, Constant, FormulaSet, Limits, Node, Operation, Variable
from bandlens.functions import bands
from bandlens.functions.guards import operator

#: Complexities are counted in steps of a tenth.
GRID = 10


@lru_cache(maxsize=4096)
def count_shapes(size: int, arities: tuple[int, ...]) -> int:
    """Ordered trees with ``size`` nodes whose inner nodes have one of the ``arities``."""
    if size <= 0:
        return 0
    return int(size == 1) + sum(_forests(size - 1, a, arities) for a in arities)


@lru_cache(maxsize=65536)
def _forests(size: int, trees: int, arities: tuple[int, ...]) -> int:
    if trees == 0:
        return int(size == 0)
    return sum(count_shapes(k, arities) * _forests(size - k, trees - 1, arities) for k in range(1, size - trees + 2))


def random_shape(size: int, arities: tuple[int, ...], rng: np.random.Generator) -> tuple | None:
    """A uniformly drawn tree of exactly ``size`` nodes, as nested tuples; None if there is none."""
    total = count_shapes(size, arities)
    if not total:
        return None
    if size == 1:
        return ()
    at = int(rng.random() * total)
    for a in arities:
        n = _forests(size - 1, a, arities)
        if at < n:
            return _random_forest(size - 1, a, arities, rng)
        at -= n
    return _random_forest(size - 1, arities[-1], arities, rng)


def _random_forest(size: int, trees: int, arities: tuple[int, ...], rng: np.random.Generator) -> tuple:
    out = []
    for left in range(trees, 0, -1):
        options = [(k, count_shapes(k, arities) * _forests(size - k, left - 1, arities)) for k in range(1, size - left + 2)]
        total = sum(n for _, n in options)
        at = int(rng.random() * total)
        for k, n in options:
            if at < n:
                break
            at -= n
        out.append(random_shape(k, arities, rng))
        size -= k
    return tuple(out)


def cumulated(weights) -> list[float]:
    return list(accumulate(map(float, weights)))


def drawn(upto: list[float], rng: np.random.Generator) -> int:
    """An index, by weights whose sums up to each are given."""
    return min(bisect_right(upto, rng.random() * upto[-1]), len(upto) - 1)


def _by_weight(weights, rng: np.random.Generator) -> int:
    """An index, by the weights."""
    return drawn(cumulated(weights), rng)


@dataclass
class Space:
    """What formulas are made of.

    ``constants``: the pool random constants come from (a third as many as variables, from N(0, 3), by
    default). Aggregations are drawn if ``stats`` or ``window_stats`` are given: ``stats`` reduce a
    range of bands (of ``lengths`` bands), ``window_stats`` a window of one of the half-sizes
    ``halves``; with both, windows come below a reduction.
    """

    variables: list[str]
    operators: list[str] = field(default_factory=lambda: ["add", "sub", "mul", "div"])
    max_complexity: float = 21
    limits: Limits | None = None
    constants: list[float] | int | None = None
    use_constants: bool = True
    use_variables: bool = True
    stats: list[str] = field(default_factory=list)
    window_stats: list[str] = field(default_factory=list)
    halves: list[int] = field(default_factory=lambda: [1])
    lengths: tuple[int, int] | int | None = None
    mean_share: float = 0.92
    seed: int = 0

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.operators = [operator(o).name for o in self.operators]
        self.by_arity = {a: [o for o in self.operators if operator(o).arity == a] for a in (1, 2)}
        self.limits = self.limits or Limits(self.max_complexity)
        if self.limits.max_complexity is None:
            self.limits = Limits(self.max_complexity, self.limits.weights, self.limits.children, self.limits.nested)
        n = len(self.variables)
        if isinstance(self.constants, int) or self.constants is None:
            self.constants = rng.normal(0, 3, self.constants if self.constants is not None else -(-n // 3)).tolist()
        self.aggregates = bool((self.stats and n >= 2) or self.window_stats)
        if not (self.use_constants or self.use_variables or self.aggregates):
            raise ValueError("formulas need some kind of leaf")
        for s in self.stats:
            bands.parse(s)
        self._count()

    # ---- leaves ----

    def leaf_odds(self, constants: bool = True) -> dict[str, float]:
        n = len(self.variables)
        odds = {}
        if self.use_variables:
            odds["variable"] = float(n)
        if self.use_constants and constants and self.constants:
            odds["constant"] = float(len(self.constants))
        if self.aggregates:
            odds["aggregation"] = n / (2 * (self.limits.weights or {}).get("aggregation", 1.0))
        return odds or {"variable": 1.0}

    def leaf(self, rng: np.random.Generator, constants: bool = True) -> Node:
        odds = self.leaf_odds(constants)
        return self.leaf_of(list(odds)[_by_weight(list(odds.values()), rng)], rng)

    def leaf_of(self, kind: str, rng: np.random.Generator) -> Node:
        if kind == "variable":
            i = int(rng.integers(len(self.variables)))
            return Variable(i, self.variables[i])
        if kind == "constant":
            return Constant(float(self.constants[int(rng.integers(len(self.constants)))]))
        return self.aggregation(rng)

    def aggregation(self, rng: np.random.Generator) -> Aggregation:
        n = len(self.variables)
        window = str(rng.choice(self.window_stats)) if self.window_stats else None
        half = int(rng.choice(self.halves)) if window else None
        if window and (not self.stats or n < 2):
            return Aggregation(spatial=window, half=half, band=int(rng.integers(n)))
        stat = str(rng.choice(self.stats))
        order, name, _ = bands.parse(stat)
        least = max(2, order + (2 if name == "slope" else 1))
        low, high = self.lengths if isinstance(self.lengths, tuple) else (least, self.lengths or n)
        length = int(rng.integers(min(max(low, least), n), min(max(high, least), n) + 1))
        start = int(rng.integers(0, n - length + 1))
        return Aggregation(stat, start, start + length - 1, window, half)

    # ---- counted trees ----

    def _weight(self, name: str) -> int:
        return max(1, int(round((self.limits.weights or {}).get(name, 1.0) * GRID)))

    def _count(self) -> None:
        """Trees by complexity (on the grid) and by state, so that only valid ones are counted.

        A tree's state is what constraints above it can see: whether it is a constant, and for an
        operator whose nesting is limited somewhere its name and the length of its chain (longer ones
        than any limit are one state). Two constants below one operator, and a constant below a unary
        one, don't count.
        """
        self.known: dict[tuple, tuple] = {}  # what drawing needs time and again, by complexity and state
        top = int(round(self.limits.max_complexity * GRID))
        nested, children = self.limits.nested or {}, self.limits.children or {}
        longest: dict[str, int] = {}
        for inner in nested.values():
            for name, allowed in inner.items():
                longest[operator(name).name] = max(longest.get(operator(name).name, 0), allowed)
        self.longest = {n: k + 1 for n, k in longest.items() if n in self.operators}
        self.counts = {("constant", 0): np.zeros(top + 1), ("leaf", 0): np.zeros(top + 1)}
        self.leaf_kinds: dict[int, dict[str, float]] = {}
        for kind, odds in self.leaf_odds().items():
            w = self._weight(kind)
            if w <= top:
                self.counts["constant" if kind == "constant" else "leaf", 0][w] += odds
                self.leaf_kinds.setdefault(w, {})[kind] = odds
        for o in self.operators:
            for k in range(1, self.longest[o] + 1) if o in self.longest else (0,):
                self.counts[o, k] = np.zeros(top + 1)
        limits = {operator(o).name: c for o, c in children.items()}
        rules = {operator(o).name: {operator(n).name: k for n, k in inner.items()} for o, inner in nested.items()}
        #: For each operator and operand: states that may stand there, by the chain they bring along and whether they are the constant.
        self.groups: dict[str, list[dict[tuple[int, bool], list[tuple]]]] = {}
        self.sums: dict[tuple, np.ndarray] = {}
        self.most: dict[tuple[str, int], int] = {}
        for o in self.operators:
            arity, most = operator(o).arity, limits.get(o)
            self.groups[o] = []
            for i in range(arity):
                m = most[i] if isinstance(most, (tuple, list)) else most
                self.most[o, i] = top if m is None or m < 0 else int(round(m * GRID))
                g: dict[tuple[int, bool], list[tuple]] = {}
                for state in self.counts:
                    name, k = state
                    if k > rules.get(o, {}).get(name, k) or (arity == 1 and name == "constant"):
                        continue
                    g.setdefault((k if name == o else 0, name == "constant"), []).append(state)
                self.groups[o].append(g)
                for key in g:
                    self.sums[o, i, key] = np.zeros(top + 1)
        for c in range(top + 1):
            for o in self.operators:
                r = c - self._weight(o)
                if r > 0:
                    for k, n, _ in self._ways(o, r):
                        self.counts[o, k][c] += n if np.isscalar(n) else n.sum()
            for (o, i, key), total in self.sums.items():
                if c <= self.most[o, i]:
                    total[c] = sum(self.counts[s][c] for s in self.groups[o][i][key])
        counts = sum(self.counts.values())
        at = np.flatnonzero(counts)
        if not len(at):
            raise ValueError("no formula fits the limits")
        target = self.mean_share * top

        def odds(alpha: float) -> np.ndarray:
            z = np.log(counts[at]) - alpha / GRID * at
            p = np.exp(z - z.max())
            return p / p.sum()

        # The wanted mean by the price of a complexity; where even free ones are smaller on average, the price is 1.
        low, high = 0.0, 20.0
        if (odds(0.0) * at).sum() < target:
            low = high = 1.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if (odds(mid) * at).sum() > target else (low, mid)
        self.complexities, self.complexity_odds = at, odds((low + high) / 2)

    def _ways(self, o: str, r: int) -> list[tuple[int, np.ndarray | float, tuple]]:
        """Ways to fill operator ``o``'s operands with complexity ``r`` in all: (state's chain, numbers by the first operand's complexity, groups)."""
        out, cap = [], self.longest.get(o)
        chain = lambda *k: 0 if cap is None else min(cap, 1 + max(k))
        groups = self.groups[o]
        if len(groups) == 1:
            return [(chain(key[0]), self.sums[o, 0, key][r], (key,)) for key in groups[0]]
        if r < 2:
            return []
        for a in groups[0]:
            for b in groups[1]:
                if not (a[1] and b[1]):
                    out.append((chain(a[0], b[0]), self.sums[o, 0, a][1:r] * self.sums[o, 1, b][1:r][::-1], (a, b)))
        return out

    def _draw(self, c: int, rng: np.random.Generator, states: list[tuple] | None = None) -> Node:
        """A tree of grid complexity ``c`` in one of the ``states``, each such tree with the same odds."""
        key = (c, None if states is None else tuple(states))
        if key not in self.known:
            options = [s for s in (self.counts if states is None else states) if self.counts[s][c] > 0]
            self.known[key] = options, cumulated(self.counts[s][c] for s in options)
        options, upto = self.known[key]
        name, k = options[drawn(upto, rng)]
        if name in ("constant", "leaf"):
            kinds = {n: w for n, w in self.leaf_kinds[c].items() if (n == "constant") == (name == "constant")}
            return self.leaf_of(list(kinds)[_by_weight(list(kinds.values()), rng)], rng)
        r = c - self._weight(name)
        if (name, k, r) not in self.known:
            ways = [w for w in self._ways(name, r) if w[0] == k]
            self.known[name, k, r] = cumulated(w[1] if np.isscalar(w[1]) else w[1].sum() for w in ways), [(None if np.isscalar(n) else cumulated(n), keys) for _, n, keys in ways]
        upto, ways = self.known[name, k, r]
        first, keys = ways[drawn(upto, rng)]
        if len(keys) == 1:
            return Operation(name, (self._draw(r, rng, self.groups[name][0][keys[0]]),))
        left = 1 + drawn(first, rng)
        return Operation(name, (self._draw(left, rng, self.groups[name][0][keys[0]]), self._draw(r - left, rng, self.groups[name][1][keys[1]])))

    def with_constants(self, pool: list[float]) -> Space:
        """The space with another pool of constants; counts depend on its size alone."""
        if len(pool) != len(self.constants):
            return replace(self, constants=pool)
        own = copy(self)
        own.constants = pool
        return own

    def random(self, rng: np.random.Generator, max_complexity: float | None = None) -> Node:
        """A valid formula of at most ``max_complexity``; a leaf if even the smallest formula is larger.

        Counts know the constraints, so what is drawn is valid; only weights that are no multiples of a
        tenth can make one too large, and then another is drawn (a leaf after a thousand in vain).
        """
        top = self.limits.max_complexity if max_complexity is None else max_complexity
        if ("random", top) not in self.known:
            ok = self.complexities <= top * GRID + 1e-9
            self.known["random", top] = self.complexities[ok].tolist(), cumulated(self.complexity_odds[ok])
        at, upto = self.known["random", top]
        if not at:
            return self.leaf(rng, constants=False)
        for _ in range(1000):
            x = self._draw(at[drawn(upto, rng)], rng)
            if self.limits.valid(x):
                return x
        return self.leaf(rng, constants=False)

    def random_of_size(self, size: int, rng: np.random.Generator) -> Node | None:
        """A formula with exactly ``size`` nodes: a uniform shape, filled; None if the operators allow none."""
        shape = random_shape(size, tuple(a for a in (1, 2) if self.by_arity[a]), rng)

        def fill(s: tuple, constants: bool = True) -> Node:
            if not s:
                return self.leaf(rng, constants)
            name = str(rng.choice(self.by_arity[len(s)]))
            x = fill(s[0], constants=len(s) > 1)
            return Operation(name, (x,) if len(s) == 1 else (x, fill(s[1], not isinstance(x, Constant))))

        return None if shape is None else fill(shape)

    def random_set(self, order: int | tuple[int, int], rng: np.random.Generator) -> FormulaSet:
        """A set of ``order`` formulas, or of up to the larger number with empty slots between; together within the limit."""
        slots = order if isinstance(order, int) else order[1]
        filled = slots if isinstance(order, int) else int(rng.integers(order[0], order[1] + 1))
        share = self.limits.max_complexity / max(filled, 1)
        out: list[Node | None] = [None] * slots
        for i in rng.choice(slots, filled, replace=False):
            out[int(i)] = self.random(rng, share)
        return FormulaSet(tuple(out))
