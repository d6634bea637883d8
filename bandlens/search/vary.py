"""Variation of formulas and sets; every function gives a new one or None where it doesn't apply."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

from bandlens.expr.ast import Aggregation, Constant, FormulaSet, Node, Operation, Variable, places, put_at
from bandlens.expr.simplify import simplify
from bandlens.functions.guards import operator
from bandlens.search.generate import Space, cumulated, drawn

#: Odds of the mutations (fixed values, the defaults of the parameters).
TREE_WEIGHTS = {
    "add_node": 2.47, "insert_node": 0.312, "delete_node": 0.870, "do_nothing_tree": 0.273, "mutate_constant": 0.046, "mutate_variable": 0.042, "mutate_operator": 0.026,
    "mutate_aggregation": 0.093, "swap_operands": 0.198, "rotate_tree": 4.26, "hoist_tree": 0.111, "randomize_tree": 0.502, "simplify_tree": 0.00209,
}
SET_WEIGHTS = {"add_expr": 0.07, "delete_expr": 0.07, "randomize_expr": 0.147, "do_nothing_set": 0.273, "swap_exprs": 0.048, "randomize_set": 0.0502, "simplify_set": 0.00209, "mutate_expr": 7.26}
#: Mutations that either apply to a formula or don't, whatever is drawn.
_CERTAIN = ("rotate_tree", "hoist_tree", "swap_operands", "mutate_constant", "simplify_tree")


def _pick(rng: np.random.Generator, items: list):
    return items[int(rng.integers(len(items)))] if items else None


def _of(node: Node, kind: type | tuple) -> list:
    return [(at, n) for at, n in places(node) if isinstance(n, kind)]


def _odds(weights: dict[str, float], rng: np.random.Generator) -> str | None:
    names = [n for n, w in weights.items() if w > 0]
    if not names:
        return None
    return names[drawn(cumulated(weights[n] for n in names), rng)]


@dataclass
class Variation:
    """All operators of variation over one space."""

    space: Space
    weights: dict[str, float] = field(default_factory=lambda: dict(TREE_WEIGHTS))
    set_weights: dict[str, float] = field(default_factory=lambda: dict(SET_WEIGHTS))
    perturbation: float = 0.129
    negate: float = 0.00743
    set_crossover: str = "multi_point"
    set_crossover_probability: float = 0.0369

    # ---- trees ----

    def add_node(self, x: Node, rng) -> Node | None:
        """A new root above the tree, or an operator in a leaf's place with the leaf as an operand."""
        name = _pick(rng, self.space.operators)
        at, leaf = ((), x) if x.size == 1 or rng.random() < 0.5 else _pick(rng, [(a, n) for a, n in places(x) if not n.children])
        if operator(name).arity == 1:
            return None if isinstance(leaf, Constant) else put_at(x, at, Operation(name, (leaf,)))
        other = self.space.leaf(rng, constants=not isinstance(leaf, Constant))
        pair = (leaf, other) if rng.random() < 0.5 else (other, leaf)
        return put_at(x, at, Operation(name, pair))

    def insert_node(self, x: Node, rng) -> Node | None:
        """An operator around an inner node below the root."""
        found = _pick(rng, [(a, n) for a, n in places(x) if a and n.children])
        if found is None:
            return None
        at, inner = found
        name = _pick(rng, self.space.operators)
        if operator(name).arity == 1:
            return put_at(x, at, Operation(name, (inner,)))
        other = self.space.leaf(rng)
        return put_at(x, at, Operation(name, (inner, other) if rng.random() < 0.5 else (other, inner)))

    def delete_node(self, x: Node, rng) -> Node | None:
        """A leaf is drawn anew; an inner node gives way to one of its operands."""
        at, n = _pick(rng, list(places(x)))
        return put_at(x, at, _pick(rng, list(n.children)) if n.children else self.space.leaf(rng, constants=False))

    def do_nothing_tree(self, x: Node, rng) -> Node | None:
        return x

    def mutate_constant(self, x: Node, rng) -> Node | None:
        """A constant times 1.1 + perturbation x u or divided by it, rarely with its sign changed."""
        found = _pick(rng, _of(x, Constant))
        if found is None:
            return None
        f = 1.1 + self.perturbation * rng.random()
        f = f if rng.random() > 0.5 else 1 / f
        return put_at(x, found[0], Constant(found[1].value * (-f if rng.random() < self.negate else f)))

    def mutate_variable(self, x: Node, rng) -> Node | None:
        """Another variable, near indices by a Gaussian."""
        found = _pick(rng, _of(x, Variable))
        n = len(self.space.variables)
        if found is None or n < 2:
            return None
        others = np.array([i for i in range(n) if i != found[1].index])
        w = np.exp(-0.5 * np.minimum(np.abs(others - found[1].index), 30.0) ** 2)
        i = int(rng.choice(others, p=w / w.sum()))
        return put_at(x, found[0], Variable(i, self.space.variables[i]))

    def mutate_operator(self, x: Node, rng) -> Node | None:
        found = _pick(rng, _of(x, Operation))
        if found is None:
            return None
        name = _pick(rng, [o for o in self.space.by_arity[len(found[1].operands)] if o != found[1].name])
        return None if name is None else put_at(x, found[0], Operation(name, found[1].operands))

    def mutate_aggregation(self, x: Node, rng) -> Node | None:
        """Shifts, widens or narrows the bands, changes the window's half-size, or (rarely) the statistic."""
        found = _pick(rng, _of(x, Aggregation))
        if found is None:
            return None
        a, n = found[1], len(self.space.variables)
        options = neighbours(a, n, self.space)
        if rng.random() < 1e-4 * n and a.stat is not None and len(self.space.stats) > 1:
            options = [replace(a, stat=s) for s in self.space.stats if s != a.stat]
        new = _pick(rng, [o for o in options if _fits(o, n)])
        return None if new is None else put_at(x, found[0], new)

    def swap_operands(self, x: Node, rng) -> Node | None:
        found = _pick(rng, [(a, n) for a, n in _of(x, Operation) if len(n.operands) == 2 and n.operands[0] != n.operands[1]])
        return None if found is None else put_at(x, found[0], Operation(found[1].name, found[1].operands[::-1]))

    def rotate_tree(self, x: Node, rng) -> Node | None:
        """An operator and one of its operator operands change places; the lower one's other operands stay with it."""
        options = [(a, n, i) for a, n in _of(x, Operation) for i, c in enumerate(n.operands) if isinstance(c, Operation)]
        found = _pick(rng, options)
        if found is None:
            return None
        at, top, i = found
        low = top.operands[i]
        j = int(rng.integers(len(low.operands)))
        inner = top.with_children((*top.operands[:i], low.operands[j], *top.operands[i + 1 :]))
        return put_at(x, at, low.with_children((*low.operands[:j], inner, *low.operands[j + 1 :])))

    def randomize_tree(self, x: Node, rng) -> Node | None:
        """A random formula, or one in the place of a subtree."""
        if rng.random() < 0.5:
            return self.space.random(rng)
        at, n = _pick(rng, list(places(x)))
        room = self.space.limits.max_complexity - self.space.limits.complexity(x) + self.space.limits.complexity(n)
        return put_at(x, at, self.space.random(rng, max(1.0, room)))

    def hoist_tree(self, x: Node, rng) -> Node | None:
        found = _pick(rng, [n for a, n in places(x) if a and n.children])
        return found

    def simplify_tree(self, x: Node, rng) -> Node | None:
        new = simplify(x)
        return None if new == x else new

    def conditioned(self, x: Node) -> dict[str, float]:
        """The odds for a formula: what can't apply has none, leaves are changed by how many there are and of how many kinds, long formulas grow no more."""
        w = dict(self.weights)
        n = len(self.space.variables)
        # Leaves in the formula, the number from which there are no more odds, and the choice there is (fixed factors).
        for name, kind, enough, choice in (("mutate_constant", 0, 8, len(self.space.constants)), ("mutate_variable", 1, 8, n), ("mutate_aggregation", 2, 5, n / 2)):
            w[name] *= min(enough, x.census[kind]) / 8 * (np.log(choice + 1) + 1)
        if not self.space.use_constants:
            w["mutate_constant"] = 0
        if not x.census[3]:
            w["swap_operands"] = 0
        if not x.children:
            for n in ("mutate_operator", "swap_operands", "rotate_tree", "insert_node", "delete_node", "simplify_tree", "hoist_tree"):
                w[n] = 0
        if self.space.limits.complexity(x) >= self.space.limits.max_complexity:
            w["add_node"] = w["insert_node"] = 0
        return w

    def mutate(self, x: Node, rng, tries: int = 10) -> tuple[str, Node | None]:
        """(name of the mutation, a valid formula or None)."""
        name = _odds(self.conditioned(x), rng) or "do_nothing_tree"
        for _ in range(tries):
            new = getattr(self, name)(x, rng)
            if new is not None and self.space.limits.valid(new):
                return name, new
            if new is None and name in _CERTAIN:
                break
        return name, None

    def crossover(self, x: Node, y: Node, rng, tries: int = 10) -> tuple[Node, Node] | None:
        """Random subtrees exchanged; None if parents are equal or no exchange is valid."""
        if x == y:
            return None
        for _ in range(tries):
            (a, p), (b, q) = _pick(rng, list(places(x))), _pick(rng, list(places(y)))
            u, v = put_at(x, a, q), put_at(y, b, p)
            if self.space.limits.valid(u) and self.space.limits.valid(v):
                return u, v
        return None

    # ---- sets ----

    def _slot(self, s: FormulaSet, rng, filled: bool = True) -> int | None:
        return _pick(rng, [i for i, f in enumerate(s.slots) if (f is not None) == filled])

    def _with(self, s: FormulaSet, i: int, f: Node | None) -> FormulaSet:
        return FormulaSet((*s.slots[:i], f, *s.slots[i + 1 :]))

    def mutate_expr(self, s: FormulaSet, rng) -> FormulaSet | None:
        return self._mutate_expr(s, rng)[1]

    def _mutate_expr(self, s: FormulaSet, rng) -> tuple[str, FormulaSet | None]:
        """(the name of the formula's own mutation, the set)."""
        i = self._slot(s, rng)
        if i is None:
            return "mutate_expr", None
        name, new = self.mutate(s.slots[i], rng)
        return name, None if new is None else self._with(s, i, new)

    def mutate_set_constant(self, s: FormulaSet, rng) -> FormulaSet | None:
        """One of all the set's constants changed, as in a single formula."""
        i = _pick(rng, [i for i, f in enumerate(s.slots) if f is not None for _ in _of(f, Constant)])
        return None if i is None else self._with(s, i, self.mutate_constant(s.slots[i], rng))

    def delete_expr(self, s: FormulaSet, rng) -> FormulaSet | None:
        return self._with(s, self._slot(s, rng), None) if s.order > 1 else None

    def add_expr(self, s: FormulaSet, rng) -> FormulaSet | None:
        i = self._slot(s, rng, filled=False)
        room = self.space.limits.max_complexity - s.complexity(self.space.limits)
        return None if i is None or room < 1 else self._with(s, i, self.space.random(rng, room))

    def swap_exprs(self, s: FormulaSet, rng) -> FormulaSet | None:
        if len(s.slots) < 2:
            return None
        i, j = (int(k) for k in rng.choice(len(s.slots), 2, replace=False))
        slots = list(s.slots)
        slots[i], slots[j] = slots[j], slots[i]
        return FormulaSet(tuple(slots))

    def randomize_set(self, s: FormulaSet, rng) -> FormulaSet | None:
        return self.space.random_set(s.order if s.order == len(s.slots) else (1, len(s.slots)), rng)

    def randomize_expr(self, s: FormulaSet, rng) -> FormulaSet | None:
        i = self._slot(s, rng)
        limits = self.space.limits
        return None if i is None else self._with(s, i, self.space.random(rng, max(1.0, limits.max_complexity - s.complexity(limits) + limits.complexity(s.slots[i]))))

    def simplify_set(self, s: FormulaSet, rng) -> FormulaSet | None:
        new = simplify(s)
        return None if new == s else new

    def do_nothing_set(self, s: FormulaSet, rng) -> FormulaSet | None:
        return s

    def mutate_set(self, s: FormulaSet, rng, fixed_order: bool = True, tries: int = 10) -> tuple[str, FormulaSet | None]:
        w = dict(self.set_weights)
        if fixed_order:
            w["add_expr"] = w["delete_expr"] = 0
        n = sum(f.census[0] for f in s.formulas) if self.space.use_constants else 0
        w["mutate_set_constant"] = self.weights["mutate_constant"] * min(8, n) / 8 * (np.log(len(self.space.constants) + 1) + 1)
        name = own = _odds(w, rng) or "do_nothing_set"
        for _ in range(tries):
            if name == "mutate_expr":
                own, new = self._mutate_expr(s, rng)
            else:
                new = getattr(self, name)(s, rng)
                own = "mutate_constant" if name == "mutate_set_constant" else name
            if new is not None and new.valid(self.space.limits):
                return own, new
        return own, None

    def crossover_sets(self, s: FormulaSet, t: FormulaSet, rng, tries: int = 10) -> tuple[FormulaSet, FormulaSet] | None:
        """Slots exchanged (single, two or multi point) with the set probability, else subtrees of one slot."""
        n = len(s.slots)
        if s == t or n != len(t.slots):
            return None
        for _ in range(tries):
            if n > 1 and rng.random() < self.set_crossover_probability:
                take = np.zeros(n, bool)
                if self.set_crossover == "single_point":
                    take[int(rng.integers(1, n)) :] = True
                elif self.set_crossover == "two_point":
                    a, b = sorted(int(k) for k in rng.choice(n + 1, 2, replace=False))
                    take[a:b] = True
                else:
                    take = rng.random(n) < 0.5
                u = FormulaSet(tuple(q if k else p for p, q, k in zip(s.slots, t.slots, take, strict=True)))
                v = FormulaSet(tuple(p if k else q for p, q, k in zip(s.slots, t.slots, take, strict=True)))
            else:
                i = _pick(rng, [i for i in range(n) if s.slots[i] is not None and t.slots[i] is not None])
                pair = None if i is None else self.crossover(s.slots[i], t.slots[i], rng)
                if pair is None:
                    continue
                u, v = self._with(s, i, pair[0]), self._with(t, i, pair[1])
            if u.valid(self.space.limits) and v.valid(self.space.limits):
                return u, v
        return None


def neighbours(a: Aggregation, n: int, space: Space, reach: int = 1) -> list[Aggregation]:
    """Aggregations a step away: bands shifted, widened or narrowed by up to ``reach``, the next half-sizes, the next band."""
    out = []
    if a.stat is not None:
        for k in range(1, reach + 1):
            for s, e in ((k, k), (-k, -k), (-k, 0), (0, k), (k, 0), (0, -k)):
                out.append(replace(a, start=a.start + s, end=a.end + e))
    if a.half is not None:
        halves = sorted(space.halves)
        i = halves.index(a.half) if a.half in halves else 0
        out += [replace(a, half=halves[j]) for j in (i - 1, i + 1) if 0 <= j < len(halves)]
    if a.band is not None:
        out += [replace(a, band=a.band + k) for k in (-1, 1)]
    return [o for o in out if _fits(o, n)]


def _fits(a: Aggregation, n: int) -> bool:
    try:
        a.check(n)
    except (ValueError, TypeError):
        return False
    return True


