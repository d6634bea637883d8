"""Numerically guarded operators, as columns and as numpy functions from one table.

Each operator has a raw value and a guard that replaces what is not finite or too large. Columns
come in two steps (:func:`raw`, :func:`guarded`), so that a compiler can put the raw value in one
projection and its guard in the next: the guard mentions the value several times, and nesting it
would grow the plan exponentially. Nulls behave like NaN in guarded operators; operators without a
guard return null for null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
#: Limits of the guards (fixed values).
LARGE, TINY, NEAR_ZERO, BASE_LIMIT, POWER_LIMIT = 1e10, 1e-10, 0.001, 1e5, 100.0


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < INF)


def _moderate(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGE)


def _keep(value: Column, condition: Column, other: float) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.lit(other))


def _nan_safe(x: Column, value: Column) -> Column:
    return F.when(F.isnan(x), F.lit(NAN)).otherwise(value)


def _clip(x: Column, limit: float) -> Column:
    return F.greatest(F.least(x, F.lit(limit)), F.lit(-limit))


def _ints(y: Column) -> Column:
    return F.abs(y - F.rint(y)) <= TINY


@dataclass(frozen=True)
class Operator:
    """``raw`` and ``guard`` make columns; ``numpy`` is the same on arrays (both take the operands)."""

    name: str
    arity: int
    raw: Callable[..., Column]
    guard: Callable[..., Column] | None
    numpy: Callable[..., np.ndarray]
    symbol: str | None = None


def _np(f):
    def run(*a):
        with np.errstate(all="ignore"):
            return f(*[np.asarray(x, float) for x in a])

    run.plain = f  # for callers that silence warnings themselves and have arrays or numpy's numbers
    return run


def _np_power(x, y):
    r = np.power(x, y)
    ok = np.isfinite(x) & np.isfinite(y) & ((x >= 0) | (np.abs(y - np.rint(y)) <= TINY)) & (np.abs(x) < BASE_LIMIT) & (np.abs(y) < POWER_LIMIT) & np.isfinite(r) & (np.abs(r) < LARGE)
    return np.where(ok, r, 1.0)


def _moderate_all(*arrays) -> bool:
    """Whether every value is surely within the limit: then guards have nothing to replace.

    A sum of squares is never less than one of them, also when rounded; the square of the limit is exact.
    """
    return all(np.vdot(a, a) < LARGE * LARGE for a in arrays)


def _np_bounded(r, other):
    return r if _moderate_all(r) else np.where(np.abs(r) < LARGE, r, other)


def _np_mul(x, y):
    r = x * y
    return r if _moderate_all(r, x, y) else np.where((np.abs(x) < LARGE) & (np.abs(y) < LARGE) & (np.abs(r) < LARGE), r, 0.0)


def _np_div(x, y):
    r = x / y
    if np.size(y) and (y.min() > TINY or y.max() < -TINY) and _moderate_all(r):
        return r
    return np.where((np.abs(y) > TINY) & (np.abs(r) < LARGE), r, 1.0)


def _np_sigmoid(x):
    r = 1 / (1 + np.exp(-np.clip(x, -88, 88)))
    return np.where(x <= -88, 0.0, np.where(x >= 88, 1.0, r)).astype(np.float32).astype(float)


def _sigmoid(x: Column) -> Column:
    r = F.lit(1.0) / (F.lit(1.0) + F.exp(-_clip(x, 88.0)))
    return F.when(F.isnan(x), F.lit(NAN)).when(x <= -88, F.lit(0.0)).when(x >= 88, F.lit(1.0)).otherwise(r).cast("float").cast("double")


_SQUARE = lambda c: c * c

OPERATORS: dict[str, Operator] = {
    o.name: o
    for o in (
        Operator("add", 2, lambda x, y: x + y, lambda r, x, y: _keep(r, _moderate(r), 0.0), _np(lambda x, y: _np_bounded(x + y, 0.0)), "+"),
        Operator("sub", 2, lambda x, y: x - y, lambda r, x, y: _keep(r, _moderate(r), 0.0), _np(lambda x, y: _np_bounded(x - y, 0.0)), "-"),
        Operator("mul", 2, lambda x, y: x * y, lambda r, x, y: _keep(r, _moderate(x) & _moderate(y) & _moderate(r), 0.0), _np(_np_mul), "*"),
        Operator("div", 2, lambda x, y: F.try_divide(x, y), lambda r, x, y: _keep(r, (F.abs(y) > TINY) & _moderate(r), 1.0), _np(_np_div), "/"),
        Operator("sqrt", 1, lambda x: F.sqrt(F.abs(x)), None, _np(lambda x: np.sqrt(np.abs(x)))),
        Operator(
            "power", 2, lambda x, y: F.pow(x, y),
            lambda r, x, y: _keep(r, finite(x) & finite(y) & ((x >= 0) | _ints(y)) & (F.abs(x) < BASE_LIMIT) & (F.abs(y) < POWER_LIMIT) & _moderate(r), 1.0), _np(_np_power),
        ),
        Operator("log", 1, lambda x: F.ln(F.when(F.abs(x) > NEAR_ZERO, F.abs(x))), lambda r, x: _keep(r, ~F.isnan(x) & r.isNotNull(), 0.0), _np(lambda x: np.where(np.abs(x) > NEAR_ZERO, np.log(np.abs(x)), 0.0))),
        Operator("exp", 1, lambda x: _nan_safe(x, F.exp(F.least(x, F.lit(700.0)))), None, _np(lambda x: np.exp(np.minimum(x, 700.0)))),
        Operator("abs", 1, lambda x: F.abs(x), None, _np(np.abs)),
        Operator("neg", 1, lambda x: -x, None, _np(np.negative)),
        Operator("inv", 1, lambda x: F.try_divide(F.lit(1.0), x), lambda r, x: _keep(r, ~F.isnan(x) & (F.abs(x) > NEAR_ZERO), 0.0), _np(lambda x: np.where(np.abs(x) > NEAR_ZERO, 1 / x, 0.0))),
        Operator("maximum", 2, lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.greatest(x, y)), None, _np(np.maximum)),
        Operator("minimum", 2, lambda x, y: F.when(F.isnan(x) | F.isnan(y), F.lit(NAN)).when(x.isNotNull() & y.isNotNull(), F.least(x, y)), None, _np(np.minimum)),
        Operator("sin", 1, F.sin, None, _np(np.sin)),
        Operator("cos", 1, F.cos, None, _np(np.cos)),
        Operator("tan", 1, F.tan, None, _np(np.tan)),
        Operator("sinh", 1, F.sinh, None, _np(np.sinh)),
        Operator("cosh", 1, F.cosh, None, _np(np.cosh)),
        Operator("tanh", 1, F.tanh, None, _np(np.tanh)),
        Operator("identity", 1, lambda x: x, None, _np(lambda x: x)),
        Operator("sigmoid", 1, _sigmoid, None, _np(_np_sigmoid)),
        Operator("softplus", 1, lambda x: _nan_safe(x, F.ln(F.lit(1.0) + F.exp(_clip(x, 88.0)))), None, _np(lambda x: np.log(1 + np.exp(np.clip(x, -88, 88))))),
        Operator("expsq", 1, lambda x: _nan_safe(x, F.exp(-_SQUARE(_clip(x, 30.0)))), None, _np(lambda x: np.exp(-np.clip(x, -30, 30) ** 2))),
    )
}
#: Other spellings of the operators.
ALIASES = {"+": "add", "-": "sub", "*": "mul", "/": "div", "pow": "power", "^": "power", "max": "maximum", "min": "minimum"}


def operator(name: str) -> Operator:
    """The operator of a name or alias; ValueError for an unknown one."""
    found = OPERATORS.get(ALIASES.get(name, name))
    if found is None:
        raise ValueError(f"unknown operator {name!r}")
    return found


def apply(name: str, *operands: Column) -> Column:
    """Guarded value in one expression; for single operators and short formulas."""
    op = operator(name)
    r = op.raw(*operands)
    return r if op.guard is None else op.guard(r, *operands)


def softmax(scores: Column) -> Column:
    """Softmax of an array of scores: shifted by the maximum, exponents clipped at -700, an all-zero sum gives zeros."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda v: F.exp(F.greatest(v - top, F.lit(-700.0))))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: F.coalesce(F.try_divide(v, total), F.lit(0.0)))


def expit(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def argmax(values: Column) -> Column:
    """0-based index of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
