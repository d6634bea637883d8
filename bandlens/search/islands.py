"""One island: a population that evolves inside one task, over a training sample in memory."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count
from operator import attrgetter

import numpy as np

from bandlens.expr.ast import FormulaSet, Node, constants, regularised_constants
from bandlens.expr.compile_numpy import Memo
from bandlens.expr.simplify import simplify
from bandlens.functions.guards import operator
from bandlens.operators.metrics import METRICS, penalised, penalty
from bandlens.search.generate import Space
from bandlens.search.local import optimise_aggregations, optimise_constants
from bandlens.search.losses import CLIP, LOSSES
from bandlens.search.vary import Variation

Formula = Node | FormulaSet


@dataclass
class Settings:
    """How the search runs; defaults are those of the estimators."""

    metric: str = "mse"
    metric_params: dict = field(default_factory=dict)
    penalty: str | None = None
    c: float = 1.0
    regularise_bias: bool = False
    out_func: str | None = None
    order: int | tuple[int, int] | None = None
    populations: int = 31
    population_size: int = 27
    tournament_n: int = 15
    tournament_p: float = 0.982
    cycles: int = 380
    annealing: bool = False
    alpha: float = 3.17
    crossover_probability: float = 0.0259
    should_simplify: bool = True
    optimise_constants: bool = True
    optimise_aggregations: bool = True
    optimiser: str = "L-BFGS-B"
    optimiser_restarts: int = 2
    optimiser_probability: float = 0.0371
    optimiser_iterations: int = 15
    tolerance: float = 1e-5
    batching: bool = False
    batch_size: int = 256
    migration: bool = True
    fraction_replaced: float = 0.0136
    hof_migration: bool = True
    fraction_replaced_hof: float = 0.0614
    top_n: int = 12
    logging: bool = False
    #: A loss of one's own, (y, prediction, weights or None, **metric_params) -> float, used instead of the metric.
    custom: Callable | None = None
    custom_greater: bool = False

    @property
    def greater(self) -> bool:
        return self.custom_greater if self.custom else METRICS[self.metric].greater

    @property
    def loss(self) -> Callable:
        return self.custom or LOSSES[self.metric]


def out(values: np.ndarray, name: str | None, moments: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The output function on a vector or, for a set, on its matrix. ``moments``: mean and deviation of all rows, where the values are some of them."""
    if name in (None, "identity"):
        return values
    if name in ("softmax", "log_softmax"):
        if values.ndim == 1:
            values = values[:, None]
        z = values - values.max(1, keepdims=True)
        if name == "log_softmax":
            return z - np.log(np.exp(np.maximum(z, -700)).sum(1, keepdims=True))
        e = np.exp(np.maximum(z, -700))
        return e / np.maximum(e.sum(1, keepdims=True), 1e-300)
    if name == "zscore":
        m, s = moments if moments is not None else (values.mean(0), values.std(0))
        return np.where(s > 1e-8, (values - m) / np.where(s > 1e-8, s, 1), 0.0)
    return operator(name).numpy(values)


def with_penalty(f: Formula, value: float, s: Settings) -> float:
    """The metric's value with the penalty of the formula's constants."""
    if not s.penalty:
        return value
    formulas = f.formulas if isinstance(f, FormulaSet) else (f,)
    c = [v for g in formulas for v in (constants(g) if s.regularise_bias else regularised_constants(g))]
    return penalised(value, s.greater, penalty(c, s.penalty, s.c))


def quick_mse(y: np.ndarray, w: np.ndarray | None) -> Callable[[list], float]:
    """The weighted squared error as a function of a formula's value (a list of one), without copies."""
    total = float(len(y)) if w is None else w.sum()
    d, e = np.empty(len(y)), np.empty(len(y))

    def run(values: list, keep: bool = True) -> float:
        np.subtract(values[0], y, out=d)
        return float(np.dot(d if w is None else np.multiply(d, w, out=e), d) / total) if total else 0.0

    return run


class QuickEntropy:
    """The cross-entropy of softmax as a function of the values of a set's formulas.

    A varied set differs from its parent in one formula, so exponentials of each formula are kept. Rows where
    a value is so large that exponentials need the shift by the largest one are computed with it.
    """

    #: Exponentials of so large values, and sums of them, are normal numbers; products of so many clipped probabilities too.
    LARGEST, TOGETHER = 300.0, 32

    def __init__(self, y: np.ndarray, w: np.ndarray | None, kept: int) -> None:
        self.y, self.w, self.kept = y.astype(int), w, kept
        self.total = float(len(y)) if w is None else w.sum()
        self.of = [np.flatnonzero(self.y == k) for k in range(int(self.y.max()) + 1 if len(y) else 0)]
        self.known: OrderedDict[int, tuple] = OrderedDict()
        self.room = np.empty((2, len(y)))

    def exponential(self, v: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Of a value, and where it is too large (None: nowhere). A value that is kept is held, so that its address stays its own."""
        found = self.known.get(id(v))
        if found is not None:
            self.known.move_to_end(id(v))
            return found[1:]
        large = None
        if not (np.max(v) <= self.LARGEST and np.min(v) >= -self.LARGEST):
            large = ~(np.abs(v) <= self.LARGEST)
        e = np.exp(v if large is None else np.where(large, 0.0, v))
        if keep:
            self.known[id(v)] = (v, e, large)
            if len(self.known) > self.kept:
                self.known.popitem(last=False)
        return e, large

    def __call__(self, values: list, keep: bool = True) -> float | None:
        if not self.total or len(self.of) > len(values):
            return None
        found = [self.exponential(v, keep) for v in values]
        total, own = self.room
        total[:] = 0
        for x, _ in found:
            total += x
        for (x, _), rows in zip(found, self.of, strict=False):
            own[rows] = x[rows] if np.ndim(x) else x
        own /= total
        if any(large is not None for _, large in found):
            rows = np.zeros(len(own), bool)
            for _, large in found:
                if large is not None:
                    rows |= large
            rows = np.flatnonzero(rows)
            z = np.stack([v[rows] if np.ndim(v) else np.full(len(rows), v) for v in values])
            z -= z.max(0)
            e = np.exp(np.maximum(z, -700, out=z), out=z)
            own[rows] = e[self.y[rows], np.arange(len(rows))] / e.sum(0)
        np.clip(own, CLIP, 1 - CLIP, out=own)
        if self.w is not None:
            return -float(np.dot(self.w, np.log(own)) / self.total)
        # The logarithm of a product is the sum of its factors' logarithms.
        n = len(own) // self.TOGETHER * self.TOGETHER
        return -float((np.log(own[:n].reshape(self.TOGETHER, -1).prod(0)).sum() + np.log(own[n:]).sum()) / self.total)


class Judge:
    """Errors and costs of formulas over a sample."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None, settings: Settings, patches: np.ndarray | None = None) -> None:
        self.x, self.y, self.w, self.s, self.patches = x, y, w, settings, patches
        self.values, self.errors = Memo(x, patches), {}
        self.quick = None
        if settings.custom is None and not settings.metric_params:
            if settings.metric == "mse" and settings.out_func in (None, "identity"):
                self.quick = quick_mse(y, w)
            elif settings.metric == "cross_entropy" and settings.out_func == "softmax" and isinstance(settings.order, int) and settings.order > 1:
                self.quick = QuickEntropy(y, w, self.values.most)

    def metric(self, values: list, f: Formula, keep: bool = True) -> float:
        """The metric over all rows of a formula's or a set's values (numbers where they are the same everywhere); ``keep``: they will be met again."""
        value = None
        if self.quick is not None and len(values) == (self.s.order or 1):
            value = self.quick(values, keep)
        if value is None:
            p = [np.array(np.broadcast_to(v, len(self.x)), float) for v in values]
            value = self.s.loss(self.y, out(np.stack(p, 1) if isinstance(f, FormulaSet) else p[0], self.s.out_func), self.w, **self.s.metric_params)
        return value

    def of_constants(self, f: Formula) -> Callable[[np.ndarray], float] | None:
        """The cost as a function of the formula's constants (None where these have a penalty)."""
        if self.s.penalty:
            return None
        formulas, numbers = f.formulas if isinstance(f, FormulaSet) else (f,), count()
        with np.errstate(all="ignore"):
            parts = [self.values.of_constants(g, numbers) for g in formulas]

        def run(v: np.ndarray) -> float:
            with np.errstate(all="ignore"):
                e = float(np.float32(self.metric([p(v) for p in parts], f, False)))
            return np.inf if np.isnan(e) else -e if self.s.greater else e

        return run

    def error(self, f: Formula, rows: np.ndarray | None = None) -> float:
        """The metric with its penalty, in single precision as archives keep it; over all rows it is computed once for each formula."""
        if rows is None and f in self.errors:
            return self.errors[f]
        with np.errstate(all="ignore"):
            if rows is None:
                value = self.metric([self.values.value(g) for g in (f.formulas if isinstance(f, FormulaSet) else (f,))], f)
            else:
                some = Memo(self.x[rows], None if self.patches is None else self.patches[rows])
                value = self.s.loss(self.y[rows], out(some(f), self.s.out_func), None if self.w is None else self.w[rows], **self.s.metric_params)
        value = float(np.float32(with_penalty(f, value, self.s)))
        if rows is None:
            if len(self.errors) >= 100_000:
                self.errors.clear()
            self.errors[f] = value
        return value

    def cost(self, f: Formula, rows: np.ndarray | None = None) -> float:
        """Smaller is better; what isn't a number is worst."""
        e = self.error(f, rows)
        if np.isnan(e):
            return np.inf
        return -e if self.s.greater else e


@dataclass
class Member:
    formula: Formula
    cost: float
    complexity: float
    birth: int


_cost = attrgetter("cost")


class Island:
    """Steady-state evolution: winners of tournaments vary and replace the oldest."""

    def __init__(self, space: Space, settings: Settings, judge: Judge, rng: np.random.Generator, variation: Variation | None = None) -> None:
        self.space, self.s, self.judge, self.rng = space, settings, judge, rng
        self.vary = variation or Variation(space)
        self.members: list[Member] = []
        self.best: dict[tuple, Member] = {}
        self.log: list[dict] = []
        self.clock = 0

    def complexity(self, f: Formula) -> float:
        return f.complexity(self.space.limits) if isinstance(f, FormulaSet) else self.space.limits.complexity(f)

    def member(self, f: Formula, rows: np.ndarray | None = None) -> Member:
        self.clock += 1
        m = Member(f, self.judge.cost(f, rows), self.complexity(f), self.clock)
        self.remember(m if rows is None else Member(f, self.judge.cost(f), m.complexity, m.birth))
        return m

    def remember(self, m: Member) -> None:
        """The best member of each complexity (and order) that the island has met."""
        key = (m.formula.order if isinstance(m.formula, FormulaSet) else 1, m.complexity)
        if np.isfinite(m.cost) and (key not in self.best or m.cost < self.best[key].cost):
            self.best[key] = m

    def random(self) -> Formula:
        return self.space.random_set(self.s.order, self.rng) if self.s.order is not None else self.space.random(self.rng)

    def start(self, formulas: list[Formula] | None = None) -> None:
        formulas = list(formulas or [])
        self.members = [self.member(f) for f in formulas + [self.random() for _ in range(self.s.population_size - len(formulas))]]

    def tournament(self) -> Member:
        """The k-th best of n drawn with replacement, with probability p (1 - p)^k."""
        drawn = [self.members[i] for i in self.rng.integers(len(self.members), size=min(self.s.tournament_n, len(self.members))).tolist()]
        k = int(np.log(max(self.rng.random(), 1e-300)) / np.log(max(1 - self.s.tournament_p, 1e-300))) if self.s.tournament_p < 1 else 0
        return min(drawn, key=_cost) if not k else sorted(drawn, key=_cost)[min(k, len(drawn) - 1)]

    def replace_oldest(self, m: Member) -> None:
        i = min(range(len(self.members)), key=lambda i: self.members[i].birth)
        self.members[i] = m

    def accepted(self, old: Member, new: Member, temperature: float) -> tuple[bool, float]:
        if not self.s.annealing or new.cost <= old.cost:
            return True, 1.0
        p = float(np.exp(-(new.cost - old.cost) / max(temperature * self.s.alpha, 1e-12)))
        return bool(self.rng.random() < p), p

    def note(self, generation: int, kind: str, name: str, old: Member, new: Member, accepted: bool, temperature: float, p: float, second: tuple[Member, Member] | None = None) -> None:
        """A record of an operation; ``second``: the other parent and offspring of a crossover."""
        if not self.s.logging:
            return
        sign = -1.0 if self.s.greater else 1.0
        o = [m.formula.order if isinstance(m.formula, FormulaSet) else None for m in (old, new, *(second or ()))]
        if second is not None:
            a, b = second
            other = {"parent2_fitness": sign * a.cost, "parent2_complexity": int(round(a.complexity)), "offspring2_fitness": sign * b.cost, "offspring2_complexity": int(round(b.complexity)), "parent2_order": o[2], "offspring2_order": o[3]}
        else:
            other = {}
        self.log.append(other | {
            "generation": generation, "operation_type": kind, "operation_name": name, "parent_fitness": sign * old.cost, "parent_complexity": int(round(old.complexity)),
            "offspring_fitness": sign * new.cost, "offspring_complexity": int(round(new.complexity)), "fitness_delta": old.cost - new.cost, "complexity_delta": int(round(new.complexity - old.complexity)),
            "accepted": accepted, "temperature": temperature if self.s.annealing else None, "probability": p if self.s.annealing else None, "batch_used": self.s.batching,
            "parent_order": o[0], "offspring_order": o[1], "order_delta": None if o[0] is None else o[1] - o[0],
        })

    def evolve(self, generation: int, temperature: float = 1.0) -> None:
        """One generation: cycles of tournaments, then local optimisation and simplification."""
        n = len(self.judge.y)
        sets = self.s.order is not None
        for cycle in range(self.s.cycles):
            heat = temperature * (1 - cycle / self.s.cycles) if self.s.annealing else 1.0
            rows = self.rng.choice(n, min(n, self.s.batch_size), replace=False) if self.s.batching and n > self.s.batch_size else None
            for _ in range(-(-len(self.members) // max(1, self.s.tournament_n))):
                a = self.tournament()
                if self.rng.random() < self.s.crossover_probability:
                    b = self.tournament()
                    pair = (self.vary.crossover_sets if sets else self.vary.crossover)(a.formula, b.formula, self.rng)
                    if pair is not None:
                        new, other = (self.member(f, rows) for f in pair)
                        self.note(generation, "crossover", "subtree_crossover", a, new, True, heat, 1.0, (b, other))
                        self.replace_oldest(new)
                        self.replace_oldest(other)
                    continue
                if sets:
                    name, f = self.vary.mutate_set(a.formula, self.rng, fixed_order=isinstance(self.s.order, int))
                else:
                    name, f = self.vary.mutate(a.formula, self.rng)
                if f is None:
                    continue
                new = self.member(f, rows)
                ok, p = self.accepted(a, new, heat)
                self.note(generation, "mutation", name, a, new, ok, heat, p)
                if ok:
                    self.replace_oldest(new)
        self.polish(generation)

    def polish(self, generation: int) -> None:
        """Constants, then aggregations, then a simpler form; each step that changes a member is logged under its own name."""
        for i, m in enumerate(self.members):

            def step(kind: str, name: str, f: Formula, m: Member) -> Member:
                if f == m.formula:
                    return m
                new = self.member(f)
                self.note(generation, kind, name, m, new, True, 1.0, 1.0)
                return Member(f, new.cost, new.complexity, m.birth)

            if self.s.optimise_constants and self.rng.random() < self.s.optimiser_probability:
                f, _ = optimise_constants(m.formula, self.judge.cost, self.rng, self.s.optimiser, self.s.optimiser_restarts, self.s.optimiser_iterations, self.s.tolerance, self.judge.of_constants(m.formula))
                m = step("optimize_constants", "constant_optimization", f, m)
            if self.s.optimise_aggregations and self.space.aggregates and self.rng.random() < self.s.optimiser_probability:
                f, _ = optimise_aggregations(m.formula, self.judge.cost, self.space, self.rng)
                m = step("optimize_aggregations", "aggregation_optimization", f, m)
            if self.s.should_simplify:
                simple = simplify(m.formula)
                if self.complexity(simple) < self.complexity(m.formula) and (simple.valid(self.space.limits) if isinstance(simple, FormulaSet) else self.space.limits.valid(simple)):
                    m = step("simplify", "simplify_set" if isinstance(simple, FormulaSet) else "simplify_tree", simple, m)
            self.members[i] = m
        self.refresh_constants()

    def refresh_constants(self) -> None:
        """The pool of random constants: the means of the most frequent constants (in bins of 0.01), as many as before."""
        found = np.array([c for m in self.members for c in (m.formula.constants() if isinstance(m.formula, FormulaSet) else constants(m.formula)) if np.isfinite(c)])
        k = len(self.space.constants)
        if not k or not len(found):
            return
        bins, inverse, n = np.unique(np.round(found / 0.01), return_inverse=True, return_counts=True)
        means = np.bincount(inverse, found) / n
        top = means[np.argsort(-n, kind="stable")][:k].tolist()
        self.space.constants = top + self.space.constants[len(top) :]
