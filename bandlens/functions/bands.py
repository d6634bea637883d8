"""Reductions over the bands of an array column, after an optional finite difference.

Names are ``[d<k>_]<stat>``: mean, sum, max, min, median, std, var, range, slope or percentile<q>.
All but percentile propagate NaN; percentile ignores NaN and interpolates linearly. std and var
divide by n. Bands are counted from 0 and both ends are included.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
#: Statistics offered by default (fixed values).
STATISTICS = ("mean", "max", "min", "median", "std", "var", "sum", "range", "slope")
DEFAULT_PERCENTILES = (25, 50, 75, 95)
_NAME = re.compile(r"^(?:d([1-9]\d*)_)?(mean|sum|max|min|median|std|var|range|slope|percentile(\d+(?:\.\d+)?))$")


def listed() -> list[str]:
    """The names of the default statistics."""
    return [*STATISTICS, *(f"percentile{q}" for q in DEFAULT_PERCENTILES)]


def parse(name: str) -> tuple[int, str, float | None]:
    """(difference order, statistic, percentile); ValueError for an unknown name or a percentile over 100."""
    m = _NAME.match(name)
    if not m or (m[3] is not None and float(m[3]) > 100):
        raise ValueError(f"unknown band statistic {name!r}")
    return int(m[1] or 0), ("percentile" if m[3] is not None else m[2]), (float(m[3]) if m[3] is not None else None)


def check(name: str, start: int, end: int, n_bands: int) -> None:
    """ValueError unless 0 <= start < end < n_bands and enough bands are left after the difference."""
    order, stat, _ = parse(name)
    if not 0 <= start < end < n_bands:
        raise ValueError(f"bands {start}..{end} are not within 0..{n_bands - 1}")
    left = end - start + 1 - order
    if left < (2 if stat == "slope" else 1):
        raise ValueError(f"{name} needs more bands than {start}..{end}")


def sliced(bands: Column, start: int, end: int) -> Column:
    return F.transform(F.slice(bands, start + 1, end - start + 1), lambda v: v.cast("double"))


def difference(values: Column, n: int, order: int) -> Column:
    """The ``order``-th finite difference of an array of ``n`` values."""
    for k in range(order):
        m = n - k
        values = F.zip_with(F.slice(values, 2, m - 1), F.slice(values, 1, m - 1), lambda a, b: a - b)
    return values


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once: a let-binding by a one-element transform."""
    return F.transform(F.array(value), use)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _has_nan(values: Column) -> Column:
    return F.exists(values, lambda v: F.isnan(v))


def reduce(bands: Column, name: str, start: int, end: int) -> Column:
    """The statistic of bands ``start``..``end`` of an array column."""
    order, stat, q = parse(name)
    n = end - start + 1 - order
    values = difference(sliced(bands, start, end), end - start + 1, order)
    if stat == "sum":
        return _sum(values)
    if stat == "mean":
        return _sum(values) / n
    if stat == "max":
        return F.array_max(values)
    if stat == "min":
        return _bound(values, lambda a: F.when(_has_nan(a), F.lit(NAN)).otherwise(F.array_min(a)))
    if stat == "range":
        return _bound(values, lambda a: F.array_max(a) - F.array_min(a))
    if stat == "median":
        return _bound(F.array_sort(values), lambda a: F.when(_has_nan(a), F.lit(NAN)).otherwise((F.get(a, F.lit((n - 1) // 2)) + F.get(a, F.lit(n // 2))) / 2))
    if stat in ("var", "std"):
        var = _bound(values, lambda a: _bound(_sum(a) / n, lambda m: F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / n))
        return var if stat == "var" else F.sqrt(var)
    if stat == "slope":
        centre, scale = (n - 1) / 2, n * (n * n - 1) / 12
        return _sum(F.transform(values, lambda v, i: (i - F.lit(centre)) * v)) / scale
    kept = F.array_sort(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v)))

    def at(a: Column) -> Column:
        rank = (F.size(a) - 1) * F.lit(q / 100)
        low = F.floor(rank).cast("int")
        below, above = F.get(a, low), F.get(a, F.least(low + 1, F.size(a) - 1))
        return F.when(F.size(a) > 0, below + (above - below) * (rank - low)).otherwise(F.lit(NAN))

    return _bound(kept, at)


def label(name: str, start: int, end: int) -> str:
    """How the aggregation is written, with bands from 1: ``mean(v2-v5)``."""
    return f"{name}(v{start + 1}-v{end + 1})"


def valid(bands: Column) -> Column:
    """The data mask: an array without null and NaN bands."""
    return F.coalesce(~F.exists(bands, lambda v: v.isNull() | F.isnan(v)), F.lit(False))
