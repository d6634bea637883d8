"""Two-dimensional neighbourhood windows over a pixel table (one row for each pixel).

A square window is two one-dimensional passes, along the columns of a row and then along the rows of
a column, with value-based range frames, so gaps in the grid need no filling. NaN neighbours are
skipped; a window without values gives NaN. At the grid's edge windows are clamped; patches
(:func:`patches`) mirror the grid instead. A pass shuffles by row or by column: partitions are as
many as the raster has rows, and a task's frame holds 2w + 1 pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAN = float("nan")
WINDOW_STATISTICS = ("mean", "max", "min", "sum", "median", "range")


def check(stat: str, half: int, allowed: tuple[str, ...] = WINDOW_STATISTICS) -> None:
    if stat not in allowed:
        raise ValueError(f"unknown window statistic {stat!r}")
    if half < 1:
        raise ValueError("the window's half-size must be at least 1")


def _present(value: str) -> Column:
    return F.when(~F.isnan(value), F.col(value).cast("double"))


def _frames(row: str, col: str, half: int, by: list[str]) -> tuple:
    return (Window.partitionBy(*by, row).orderBy(col).rangeBetween(-half, half), Window.partitionBy(*by, col).orderBy(row).rangeBetween(-half, half))


def _median(values: Column) -> Column:
    n = F.size(values)
    s = F.array_sort(values)
    return F.when(n > 0, (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2)


def many(df: DataFrame, specs: list[tuple[str, int, Column, str]], row: str = "row", col: str = "col", by: list[str] | None = None, where: str | None = None) -> DataFrame:
    """``df`` with one column for each of ``specs`` (statistic, half-size, value, name of the result), in two passes together.

    All windows along the rows share one shuffle and one sort, and so do all those along the columns,
    whatever the number of statistics, half-sizes and bands; values are columns of ``df``.
    """
    for stat, half, _, _ in specs:
        check(stat, half)
    by, keep = by or [], df.columns
    #: The parts a statistic is made of: how values are combined along a row, and then along a column.
    kinds = {"sum": ("sum", "count"), "mean": ("sum", "count"), "max": ("max",), "min": ("min",), "range": ("max", "min"), "median": ("list",)}
    first = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "list": F.collect_list}
    then = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min, "list": F.collect_list}
    d = df.withColumns({f"_v{i}": F.when(~F.isnan(v.cast("double")), v.cast("double")) for i, (_, _, v, _) in enumerate(specs)})
    across, down = {}, {}
    for i, (stat, half, _, _) in enumerate(specs):
        along, below = _frames(row, col, half, by)
        for part in kinds[stat]:
            across[f"_a{i}_{part}"] = first[part](f"_v{i}").over(along)
            down[f"_b{i}_{part}"] = then[part](f"_a{i}_{part}").over(below)
    d = d.withColumns(across).drop(*[f"_v{i}" for i in range(len(specs))]).withColumns(down)
    results = {}
    for i, (stat, _, _, name) in enumerate(specs):
        b = lambda part, i=i: F.col(f"_b{i}_{part}")
        if stat in ("sum", "mean"):
            result = F.when(b("count") > 0, b("sum") if stat == "sum" else F.try_divide(b("sum"), b("count")))
        elif stat == "range":
            result = b("max") - b("min")
        else:
            result = _median(F.flatten(b("list"))) if stat == "median" else b(stat)
        results[name] = F.coalesce(result, F.lit(NAN))
    d = d.select(*[F.col(f"`{c}`") for c in keep if c not in results], *[v.alias(n) for n, v in results.items()])
    return d.filter(where) if where else d


def window(df: DataFrame, stat: str, half: int, value: str, out: str, row: str = "row", col: str = "col", by: list[str] | None = None, where: str | None = None) -> DataFrame:
    """``df`` with ``out``: the statistic over the (2 half + 1) x (2 half + 1) window around each pixel.

    ``by`` separates rasters or bands; ``where``, a condition, keeps only flagged pixels of the
    result (all pixels still count as neighbours). Two rows at one place are two neighbours.
    """
    return many(df, [(stat, half, F.col(value), out)], row, col, by, where)


def bands_window(df: DataFrame, stat: str, half: int, bands: str, out: str, start: int, end: int, row: str = "row", col: str = "col", by: list[str] | None = None, where: str | None = None) -> DataFrame:
    """``df`` with ``out``, an array: the window's statistic of each of the bands ``start``..``end``, each band as a column of the same two passes."""
    names = [f"_w{i}" for i in range(start, end + 1)]
    d = many(df, [(stat, half, F.get(F.col(bands), F.lit(i)), n) for i, n in zip(range(start, end + 1), names, strict=True)], row, col, by, where)
    return d.withColumn(out, F.array(*names)).drop(*names)


def patches(df: DataFrame, size: int, method: str, value: str, out: str, row: str = "row", col: str = "col", skip_nan: bool = True, pad: str = "reflect") -> DataFrame:
    """``df`` with ``out``: the statistic of the ``size`` x ``size`` patch around each pixel of a full grid.

    ``size`` is odd (else ValueError); 1 gives the value itself. Rows and columns are mirrored beyond the
    edge without repeating the edge ('reflect'), repeated ('edge') or absent ('clamp'). Methods: mean,
    max, min, sum, median, range, std (dividing by n). ``skip_nan`` False gives NaN for a patch with a NaN.
    """
    check(method, 1, (*WINDOW_STATISTICS, "std"))
    if size < 1 or size % 2 == 0:
        raise ValueError("the patch size must be odd")
    if size == 1:
        return df.withColumn(out, F.col(value).cast("double"))
    half = size // 2
    if pad not in ("reflect", "edge", "clamp"):
        raise ValueError(f"unknown padding {pad!r}")
    ends = df.agg(F.min(row).alias("r0"), F.max(row).alias("r1"), F.min(col).alias("c0"), F.max(col).alias("c1"))

    def copies(position: str, low: str, high: str) -> Column:
        # Where a pixel also appears beyond the edge, besides its own place.
        x, a, b = F.col(position), F.col(low), F.col(high)
        own = F.array(x)
        if pad == "clamp":
            return own
        if pad == "reflect":
            before = F.when((x > a) & (x - a <= half), F.array(2 * a - x)).otherwise(F.array().cast("array<int>"))
            after = F.when((x < b) & (b - x <= half), F.array(2 * b - x)).otherwise(F.array().cast("array<int>"))
        else:
            before = F.when(x == a, F.sequence(a - half, a - 1)).otherwise(F.array().cast("array<int>"))
            after = F.when(x == b, F.sequence(b + 1, b + half)).otherwise(F.array().cast("array<int>"))
        return F.concat(own, before, after)

    rest = [c for c in df.columns if c not in (row, col, value)]
    d = df.withColumns({row: F.col(row).cast("int"), col: F.col(col).cast("int")}).crossJoin(F.broadcast(ends))  # one row
    d = d.withColumn("_row", F.explode(copies(row, "r0", "r1"))).withColumn("_col", F.explode(copies(col, "c0", "c1")))
    d = d.withColumn("_own", (F.col("_row") == F.col(row)) & (F.col("_col") == F.col(col)))
    across, down = _frames("_row", "_col", half, [])
    v = _present(value) if skip_nan else F.col(value).cast("double")
    if method == "std":
        # Moments of each row of the patch first, then of their means: values far from 0 lose no digits.
        d = d.withColumns({"_s": F.avg(v).over(across), "_q": F.var_pop(v).over(across), "_n": F.count(v).over(across)})
        d = d.withColumns({"_parts": F.collect_list(F.struct("_n", "_s", "_q")).over(down), "_n2": F.sum("_n").over(down)})
        parts = F.filter("_parts", lambda p: p["_n"] > 0)
        add = lambda f: F.aggregate(parts, F.lit(0.0), lambda a, p: a + f(p))
        d = d.withColumn("_m2", F.try_divide(add(lambda p: p["_n"] * p["_s"]), F.col("_n2")))
        spread = add(lambda p: p["_n"] * (p["_q"] + (p["_s"] - F.col("_m2")) * (p["_s"] - F.col("_m2"))))
        d = d.withColumn("_out", F.sqrt(F.try_divide(spread, F.col("_n2"))))
    elif method == "median":
        d = d.withColumn("_s", F.collect_list(v).over(across)).withColumn("_s2", F.flatten(F.collect_list("_s").over(down))).withColumn("_out", _median(F.col("_s2")))
    else:
        if method in ("sum", "mean"):
            d = d.withColumns({"_s": F.sum(v).over(across), "_n": F.count(v).over(across)}).withColumns({"_s2": F.sum("_s").over(down), "_n2": F.sum("_n").over(down)})
            d = d.withColumn("_out", F.col("_s2") if method == "sum" else F.try_divide(F.col("_s2"), F.col("_n2")))
        else:
            d = d.withColumns({"_s": F.max(v).over(across), "_n": F.min(v).over(across)}).withColumns({"_s2": F.max("_s").over(down), "_n2": F.min("_n").over(down)})
            d = d.withColumn("_out", {"max": F.col("_s2"), "min": F.col("_n2"), "range": F.col("_s2") - F.col("_n2")}[method])
    if not skip_nan:
        bad = F.when(F.isnan(value), 1).otherwise(0)
        d = d.withColumn("_b", F.sum(bad).over(across)).withColumn("_b2", F.sum("_b").over(down)).withColumn("_out", F.when(F.col("_b2") > 0, F.lit(NAN)).otherwise(F.col("_out")))
    return d.filter("_own").select(*rest, row, col, value, F.coalesce("_out", F.lit(NAN)).alias(out))


def exclude_near(pixels: DataFrame, blocked: DataFrame, buffer: int, row: str = "row", col: str = "col") -> DataFrame:
    """Pixels farther than ``buffer`` (the larger of row and column distance) from every row of ``blocked``.

    Blocked pixels are spread over the square around them and anti-joined by place.
    """
    grown = blocked.select(F.explode(F.sequence(F.col(row) - buffer, F.col(row) + buffer)).alias(row), col).select(row, F.explode(F.sequence(F.col(col) - buffer, F.col(col) + buffer)).alias(col)).distinct()
    return pixels.join(grown, [row, col], "left_anti")
