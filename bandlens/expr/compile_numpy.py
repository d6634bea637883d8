"""Formulas on numpy arrays, for batches inside Python workers; guards come from the same table as the columns'."""

from __future__ import annotations

import warnings
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np

from bandlens.expr.ast import Aggregation, Constant, FormulaSet, Node, Operation, Variable
from bandlens.functions import bands
from bandlens.functions.guards import OPERATORS


def reduce_bands(x: np.ndarray, name: str) -> np.ndarray:
    """The statistic over the last axis."""
    order, stat, q = bands.parse(name)
    with np.errstate(all="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore")
        x = np.diff(x, order, axis=-1) if order else x
        if stat == "percentile":
            return np.nanpercentile(x, q, axis=-1)
        if stat == "range":
            return x.max(-1) - x.min(-1)
        if stat == "slope":
            n = x.shape[-1]
            i = np.arange(n) - (n - 1) / 2
            return (x * i).sum(-1) / (n * (n * n - 1) / 12)
        return {"mean": np.mean, "sum": np.sum, "max": np.max, "min": np.min, "median": np.median, "std": np.std, "var": np.var}[stat](x, axis=-1)


def reduce_window(patches: np.ndarray, stat: str, half: int) -> np.ndarray:
    """The statistic of the window of half-size ``half`` in the middle of each patch (n, side, side, ...), NaN (missing) neighbours left out; NaN for none."""
    m = patches.shape[1] // 2
    x = patches[:, m - half : m + half + 1, m - half : m + half + 1]
    x = x.reshape(len(x), (2 * half + 1) ** 2, *x.shape[3:])
    some = ~np.isnan(x).all(1)
    with np.errstate(all="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore")
        if stat == "range":
            out = np.nanmax(x, 1) - np.nanmin(x, 1)
        else:
            out = {"mean": np.nanmean, "max": np.nanmax, "min": np.nanmin, "sum": np.nansum, "median": np.nanmedian}[stat](x, axis=1)
    return np.where(some, out, np.nan)


Step = tuple[Callable[..., np.ndarray], tuple[int, ...]]


def compiled(node: Node | FormulaSet) -> Callable[[np.ndarray], np.ndarray]:
    """A function of the rows ``x`` (n, d): a list of steps over numbered slots, equal subtrees once. Windows raise ValueError."""
    slots: dict[Node, int] = {}
    steps: list[Step | int | float | Aggregation] = []

    def place(n: Node) -> int:
        if n in slots:
            return slots[n]
        if isinstance(n, Constant):
            step = np.float64(n.value)
        elif isinstance(n, Variable):
            step = n.index
        elif isinstance(n, Aggregation):
            if n.spatial is not None:
                raise ValueError("a window needs a grid")
            step = n
        else:
            assert isinstance(n, Operation)
            step = (OPERATORS[n.name].numpy.plain, tuple(place(c) for c in n.operands))
        steps.append(step)
        slots[n] = len(steps) - 1
        return slots[n]

    wanted = [place(f) for f in (node.formulas if isinstance(node, FormulaSet) else (node,))]

    def run(x: np.ndarray) -> np.ndarray:
        values: list[np.ndarray | float] = []
        with np.errstate(all="ignore"):
            for step in steps:
                if isinstance(step, tuple):
                    values.append(step[0](*[values[i] for i in step[1]]))
                elif isinstance(step, float):
                    values.append(step)
                elif isinstance(step, int):
                    values.append(x[:, step])
                else:
                    values.append(reduce_bands(x[:, step.start : step.end + 1], step.stat))
        out = [np.broadcast_to(values[i], len(x)) for i in wanted]
        return np.stack(out, 1) if isinstance(node, FormulaSet) else np.array(out[0], float)

    return run


def evaluate(node: Node | FormulaSet, x: np.ndarray) -> np.ndarray:
    """Values for the rows of ``x`` (n, d): a vector, or a column for each formula of a set."""
    return compiled(node)(np.asarray(x, float))


class Memo:
    """Values of formulas over fixed rows; those of subtrees are kept, the least recently used ones go first.

    A varied formula differs from its parent in one place, so most of its subtrees are known. ``room`` bounds the numbers kept.
    Callers silence numpy's warnings.
    """

    def __init__(self, x: np.ndarray, patches: np.ndarray | None = None, room: int = 8_000_000) -> None:
        self.x, self.patches = np.asfortranarray(x, float), patches
        self.most = max(8, room // max(1, len(x)))
        self.known: OrderedDict[Node, np.ndarray] = OrderedDict()

    def __call__(self, node: Node | FormulaSet) -> np.ndarray:
        if isinstance(node, FormulaSet):
            return np.stack([np.broadcast_to(self.value(f), len(self.x)) for f in node.formulas], 1)
        return np.array(np.broadcast_to(self.value(node), len(self.x)), float)

    def of_constants(self, node: Node, numbers: Iterator[int]) -> Callable[[np.ndarray], np.ndarray | float]:
        """The formula's value as a function of constants, of which its own have the next ``numbers`` in post-order; subtrees without constants are computed once, others not kept."""
        if isinstance(node, Constant):
            i = next(numbers)
            return lambda v: v[i]
        if not node.census[0]:
            known = self.value(node)
            return lambda v: known
        f, parts = OPERATORS[node.name].numpy.plain, [self.of_constants(c, numbers) for c in node.children]
        if len(parts) == 1:
            (a,) = parts
            return lambda v: f(a(v))
        a, b = parts
        return lambda v: f(a(v), b(v))

    def value(self, n: Node) -> np.ndarray | float:
        if isinstance(n, Constant):
            return np.float64(n.value)
        if isinstance(n, Variable):
            return self.x[:, n.index]
        found = self.known.get(n)
        if found is not None:
            self.known.move_to_end(n)
            return found
        if isinstance(n, Aggregation):
            if n.spatial is None:
                out = reduce_bands(self.x[:, n.start : n.end + 1], n.stat)
            elif self.patches is None:
                raise ValueError("a window needs the pixels around each row")
            elif n.band is not None:
                out = reduce_window(self.patches[..., n.band], n.spatial, n.half)
            else:
                out = reduce_bands(reduce_window(self.patches[..., n.start : n.end + 1], n.spatial, n.half), n.stat)
        else:
            out = OPERATORS[n.name].numpy.plain(*[self.value(c) for c in n.operands])
        self.known[n] = out
        if len(self.known) > self.most:
            self.known.popitem(last=False)
        return out
