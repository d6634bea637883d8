"""Local optimisation of a formula's constants (BFGS or Nelder-Mead) and aggregations (hill-climbing)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from bandlens.expr.ast import Aggregation, FormulaSet, Node, constants, places, put_at, with_constants
from bandlens.search.generate import Space
from bandlens.search.vary import neighbours


def _finite(f: Callable[[np.ndarray], float]) -> Callable[[np.ndarray], float]:
    def g(x: np.ndarray) -> float:
        v = f(x)
        return v if np.isfinite(v) else 1e300

    return g


def bfgs(f: Callable[[np.ndarray], float], x: np.ndarray, iterations: int = 15, eps: float = 1e-5) -> tuple[np.ndarray, float]:
    """Quasi-Newton steps with forward differences and a halving line search."""
    f = _finite(f)
    n, value, h = len(x), f(x), np.eye(len(x))

    def gradient(x: np.ndarray, value: float) -> np.ndarray:
        step = eps * np.maximum(1.0, np.abs(x))
        return np.array([(f(x + step[i] * np.eye(n)[i]) - value) / step[i] for i in range(n)])

    g = gradient(x, value)
    for _ in range(iterations):
        if not np.isfinite(g).all() or np.abs(g).max() < eps:
            break
        d = -h @ g
        if d @ g >= 0:
            h, d = np.eye(n), -g
        t = 1.0
        for _ in range(25):
            new = f(x + t * d)
            if new <= value + 1e-4 * t * (d @ g):
                break
            t /= 2
        else:
            break
        s = t * d
        g2 = gradient(x + s, new)
        y = g2 - g
        x, value, g = x + s, new, g2
        if (sy := s @ y) > 1e-12:
            r = np.eye(n) - np.outer(s, y) / sy
            h = r @ h @ r.T + np.outer(s, s) / sy
    return x, value


def nelder_mead(f: Callable[[np.ndarray], float], x: np.ndarray, iterations: int = 15, eps: float = 1e-5) -> tuple[np.ndarray, float]:
    """A simplex of n + 1 points; ``iterations`` per dimension."""
    f = _finite(f)
    n = len(x)
    points = [x] + [x + (0.05 * x[i] if x[i] else 0.00025) * np.eye(n)[i] for i in range(n)]
    values = [f(p) for p in points]
    for _ in range(iterations * (n + 1)):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] <= eps * (abs(values[0]) + eps):
            break
        centre = np.mean(points[:-1], axis=0)
        far = points[-1] - centre
        r, vr = (q := centre - far), f(q)
        if vr < values[0]:
            e, ve = (q := centre - 2 * far), f(q)
            points[-1], values[-1] = (e, ve) if ve < vr else (r, vr)
        elif vr < values[-2]:
            points[-1], values[-1] = r, vr
        else:
            c, vc = (q := centre + 0.5 * far if vr >= values[-1] else centre - 0.5 * far), f(q)
            if vc < min(vr, values[-1]):
                points[-1], values[-1] = c, vc
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    i = int(np.argmin(values))
    return points[i], values[i]


METHODS = {"BFGS": bfgs, "L-BFGS-B": bfgs, "CG": bfgs, "Newton-CG": bfgs, "SLSQP": bfgs, "trust-constr": bfgs, "Nelder-Mead": nelder_mead, "COBYLA": nelder_mead, "COBYQA": nelder_mead}


def optimise_constants(x: Node | FormulaSet, cost: Callable[[Node | FormulaSet], float], rng: np.random.Generator, method: str = "L-BFGS-B", restarts: int = 2, iterations: int = 15, tolerance: float = 1e-5, of: Callable[[np.ndarray], float] | None = None):
    """(formula with better constants, cost), or the same formula: the best of a start at its constants and ``restarts`` at noisy ones.

    ``of`` is the cost as a function of the constants, where there is a quicker way than by a new formula each time.
    """
    values = np.array(x.constants() if isinstance(x, FormulaSet) else constants(x), float)
    best = cost(x)
    if not len(values):
        return x, best
    if method not in METHODS:
        raise ValueError(f"unknown optimiser {method!r}")
    put = (lambda v: x.with_constants(v.tolist())) if isinstance(x, FormulaSet) else (lambda v: with_constants(x, v.tolist()))
    out = x
    for k in range(restarts + 1):
        start = values if k == 0 else values * (1 + 0.5 * rng.normal(size=len(values)))
        found, value = METHODS[method](of or (lambda v: cost(put(v))), start, iterations, tolerance)
        if value < best:
            best, out = value, put(found)
    return out, best


def optimise_aggregations(x: Node | FormulaSet, cost: Callable[[Node | FormulaSet], float], space: Space, rng: np.random.Generator, patience: int = 4, first_reach: int = 3, steps: int = 40) -> tuple[Node | FormulaSet, float]:
    """Hill-climbing over the aggregations: the first better neighbour is taken; steps are wide at first, and it ends after ``patience`` rounds in vain.

    A set's formulas are climbed one after the other, by the cost of the set.
    """
    if isinstance(x, FormulaSet):
        best = cost(x)
        for i, slot in enumerate(x.slots):
            if slot is not None:
                put = lambda s, i=i, x=x: FormulaSet((*x.slots[:i], s, *x.slots[i + 1 :]))
                slot, best = optimise_aggregations(slot, lambda s, put=put: cost(put(s)), space, rng, patience, first_reach, steps)
                x = put(slot)
        return x, best
    best, vain, n = cost(x), 0, len(space.variables)
    for step in range(steps):
        spots = [(at, a) for at, a in places(x) if isinstance(a, Aggregation)]
        if not spots or vain >= patience:
            break
        reach = first_reach if step < steps // 4 else 1
        moves = [(at, b) for at, a in spots for b in neighbours(a, n, space, reach)]
        improved = False
        for i in rng.permutation(len(moves)):
            at, b = moves[int(i)]
            new = put_at(x, at, b)
            if (c := cost(new)) < best:
                x, best, improved = new, c, True
                break
        vain = 0 if improved else vain + 1
    return x, best
