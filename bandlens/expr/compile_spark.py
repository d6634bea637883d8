"""Formulas as projections: level by level, so that plans stay small and operands are plain columns.

An operator's raw value is one projection and its guard the next; a formula of depth n takes at most
2n projections, whatever its width. Equal subtrees are computed once. Aggregations of bands are
columns over the array; windows shuffle (:mod:`bandlens.operators.windows`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandlens.expr.ast import Aggregation, Constant, FormulaSet, Node, Operation, Variable, postorder
from bandlens.functions import bands
from bandlens.functions.guards import operator
from bandlens.operators import windows

PREFIX = "_f"
#: Levels through which filters on the result are pushed down; filter before scoring where a formula has more.
SHALLOW = 2


def with_formula(df: DataFrame, formula: Node | FormulaSet, out: str, array: str | None = None, row: str = "row", col: str = "col", by: list[str] | None = None) -> DataFrame:
    """``df`` with ``out``: the formula's value, or for a set an array with one element for each formula.

    Variables are columns by their names, or elements of ``array`` by their index. Null variables count
    as NaN. Names of ``df`` must differ by more than case (ValueError).
    """
    names = [c.lower() for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError("column names that differ only by case are ambiguous")
    keep = [F.col(f"`{c}`") for c in df.columns if c != out]
    formulas = formula.formulas if isinstance(formula, FormulaSet) else (formula,)
    nodes: dict[Node, int] = {}
    level: dict[Node, int] = {}
    for f in formulas:
        for n in postorder(f):
            nodes.setdefault(n, len(nodes))
            level[n] = 1 + max((level[c] for c in n.children), default=-1)

    def column(n: Node) -> Column:
        return F.lit(float(n.value)) if isinstance(n, Constant) else F.col(f"{PREFIX}{nodes[n]}")

    windowed = {n: f"{PREFIX}{nodes[n]}" for n in nodes if isinstance(n, Aggregation) and n.spatial is not None}
    if windowed:
        if array is None:
            raise ValueError("windows need an array of bands")
        df = with_windows(df, windowed, array, row, col, by)
    leaves = []
    for n in nodes:
        name = f"{PREFIX}{nodes[n]}"
        if isinstance(n, Variable):
            x = F.col(f"`{n.name}`") if array is None else F.get(F.col(array), F.lit(n.index))
            leaves.append(F.coalesce(x.cast("double"), F.lit(float("nan"))).alias(name))
        elif isinstance(n, Aggregation):
            leaves.append((F.col(name) if n.spatial is not None else bands.reduce(F.col(array), n.stat, n.start, n.end) if n.stat else F.get(F.col(array), F.lit(0)).cast("double")).alias(name))
    df = df.select(*keep, *leaves)
    done = [n for n in nodes if not isinstance(n, (Constant, Operation))]
    for k in range(1, max(level.values(), default=0) + 1):
        now = [n for n in nodes if level[n] == k]
        # Columns that nothing above needs any more are left out.
        needed = {c for n in nodes if level[n] > k for c in n.children} | set(formulas)
        carried = [n for n in done if n in needed or any(n in m.children for m in now)]
        raw = [operator(n.name).raw(*[column(c) for c in n.children]).alias(f"{PREFIX}{nodes[n]}") for n in now]
        df = df.select(*keep, *[column(n) for n in carried], *raw)
        if any(operator(n.name).guard for n in now):
            guarded = [(column(n) if operator(n.name).guard is None else operator(n.name).guard(column(n), *[column(c) for c in n.children])).alias(f"{PREFIX}{nodes[n]}") for n in now]
            df = df.select(*keep, *[column(n) for n in carried if n in needed], *guarded)
        done = [n for n in carried if n in needed] + now
    value = F.array(*[column(f) for f in formulas]) if isinstance(formula, FormulaSet) else column(formula)
    if max(level.values(), default=0) > SHALLOW:
        # Always so. But a projection that isn't deterministic takes no filters: one on the value would be
        # written out through all levels, and guards mention their operands several times.
        value = F.when(F.monotonically_increasing_id() >= 0, value)
    return df.select(*keep, value.alias(out))


def with_windows(df: DataFrame, windowed: dict[Aggregation, str], array: str, row: str = "row", col: str = "col", by: list[str] | None = None) -> DataFrame:
    """``df`` with the value of each aggregation that has a window: all of them in two shuffles."""
    wanted: dict[tuple[str, int, int], str] = {}
    for n in windowed:
        for band in (n.band,) if n.band is not None else range(n.start, n.end + 1):
            wanted.setdefault((n.spatial, n.half, band), f"_w{len(wanted)}")
    df = windows.many(df, [(stat, half, F.get(F.col(array), F.lit(band)), name) for (stat, half, band), name in wanted.items()], row, col, by)
    value = lambda n, band: F.col(wanted[n.spatial, n.half, band])
    out = {name: value(n, n.band) if n.band is not None else bands.reduce(F.array(*[value(n, k) for k in range(n.start, n.end + 1)]), n.stat, 0, n.end - n.start) for n, name in windowed.items()}
    return df.withColumns(out).drop(*wanted.values())


def expression(formula: Node, array: str | None = None) -> Column:
    """The formula as one column, for shallow formulas inside other expressions (guards nest)."""
    if isinstance(formula, Constant):
        return F.lit(float(formula.value))
    if isinstance(formula, Variable):
        x = F.col(f"`{formula.name}`") if array is None else F.get(F.col(array), F.lit(formula.index))
        return F.coalesce(x.cast("double"), F.lit(float("nan")))
    if isinstance(formula, Aggregation):
        if formula.spatial is not None:
            raise ValueError("a window is no column expression")
        return bands.reduce(F.col(array), formula.stat, formula.start, formula.end)
    operands = [expression(c, array) for c in formula.children]
    o = operator(formula.name)
    r = o.raw(*operands)
    return r if o.guard is None else o.guard(r, *operands)
