"""A varied subset: max-sum dispersion by local search over composable core-sets.

A *kind* is a group (label) and a cell of the value space whose side is the tolerance: values in one
cell differ by less than it in every dimension.

1. Core-set of each partition: of each kind its count and ``keep`` records, the first by a hash of the
   id and then always the one farthest from those kept. Core-sets compose: the union of some is cut
   in the same way. So kinds are never lost and what is kept of one doesn't grow with the rows.
2. A record is alone if no other record of its group lies within the tolerance in every dimension.
   Such a record is its cell's only one; the neighbouring cells are then probed in all records. Alone
   records are always selected (by the search, should they be more than the size).
3. Every group gets a share of the rest by its number of kinds, every kind of a group nearly the same
   number of records (so dense kinds are not over-represented).
   Where a group's kinds are far more than its share, parts of them are searched first, each for as many
   records as the whole group is to have: unions of such local optima are core-sets of the group.
4. Local search on the group's core-set: an unselected candidate replaces a selected one of its kind,
   or of a kind that has more selected, until no such swap raises the sum of all pairwise distances
   (dimensions scaled by their range); sums are updated with one distance column for each swap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandlens.plans.stages import small, staged

#: A record's cell is found by floor(value / side + 1e-9), so that quantised values fall where their decimal form says.
EDGE = 1e-9
#: Groups (labels): the driver divides the size among up to so many.
GROUPS = 1_000_000
#: A search takes at most so many candidates for each record it is to select; more are searched in parts first.
CANDIDATES = 16


def disperse(x: np.ndarray, kind: np.ndarray, fixed: np.ndarray, size: int, swaps: int | None = None) -> np.ndarray:
    """Selected rows (a mask): all ``fixed``, then ``size`` in total, kinds served evenly, dispersion raised by swaps.

    Rows must come in the order in which they are preferred at equal dispersion. Where the size doesn't
    reach all kinds of a turn, those whose records are the most distant from what is selected come
    first. A swap within a kind is always allowed; one between kinds only if the giving kind has more
    than the taking one: kinds stay as even as they were, and all covered if the size reaches all.
    Ends when no swap raises the sum (or after ``swaps``).
    """
    n = len(x)
    if n <= size:
        return np.ones(n, bool)
    span = np.ptp(x, axis=0)
    x = x / np.where(span > 0, span, 1)
    chosen = fixed.copy()

    def column(i: int) -> np.ndarray:
        return np.sqrt(((x - x[i]) ** 2).sum(1))

    if chosen.sum() > size:  # a search among the fixed ones alone
        only = np.flatnonzero(fixed)
        chosen[:] = False
        chosen[only[disperse(x[only], np.unique(kind[only], return_inverse=True)[1], np.zeros(len(only), bool), size, swaps)]] = True
        return chosen
    if chosen.sum() == size:  # nothing is left to choose
        return chosen
    # A kind's m-th record comes before any kind's (m + 1)-th.
    order = np.lexsort((np.arange(n), kind))
    first = np.concatenate([[True], kind[order][1:] != kind[order][:-1]])
    turn = np.empty(n, np.int64)
    turn[order] = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    whole = np.cumsum(np.bincount(turn[~fixed])) <= size - fixed.sum()  # turns that the size reaches as a whole
    last = int(whole.sum())
    chosen |= turn < last
    sums = np.zeros(n)
    for i in np.flatnonzero(chosen):
        sums += column(i)
    if not chosen.any():
        sums += np.sqrt(((x - x.mean(0)) ** 2).sum(1)) * 1e-9  # only to begin with the most distant one
    waiting = np.flatnonzero((turn == last) & ~chosen)
    for _ in range(size - int(chosen.sum())):
        j = int(sums[waiting].argmax())
        if not chosen.any():
            sums[:] = 0
        chosen[waiting[j]] = True
        sums += column(waiting[j])
        waiting = np.delete(waiting, j)
    counts = np.bincount(kind[chosen], minlength=int(kind.max()) + 1)
    done = 0
    while swaps is None or done < swaps:
        outs = np.flatnonzero(chosen & ~fixed)
        ins = np.flatnonzero(~chosen)
        if not len(outs) or not len(ins):
            break
        # No swap of o gains more than the largest sum it may take less its own: the rest needn't be tried.
        largest = np.full(len(counts), -np.inf)
        np.maximum.at(largest, kind[ins], sums[ins])
        below = np.full(int(counts.max()) + 2, -np.inf)
        np.maximum.at(below, counts + 1, largest)
        bound = np.maximum(largest[kind[outs]], np.maximum.accumulate(below)[counts[kind[outs]]]) - sums[outs]
        best, pair = 1e-9, None
        for tried, j in enumerate(np.argsort(-bound, kind="stable")):
            if bound[j] <= best or (pair is not None and tried >= 8):
                break
            o = outs[j]
            gain = sums[ins] - column(o)[ins] - sums[o]
            allowed = (kind[ins] == kind[o]) | (counts[kind[ins]] < counts[kind[o]])
            gain = np.where(allowed, gain, -np.inf)
            k = int(gain.argmax())
            if gain[k] > best:
                best, pair = float(gain[k]), (o, ins[k])
        if pair is None:
            break
        o, i = pair
        chosen[o], chosen[i] = False, True
        counts[kind[o]] -= 1
        counts[kind[i]] += 1
        sums += column(i) - column(o)
        done += 1
    return chosen


def shares(rows: list[int], kinds: list[int], size: int, lone: list[int] | None = None) -> list[int]:
    """Each group's part of ``size``: its alone records, and of the rest a part by its kinds, at most its rows."""
    n, k = np.array(rows, float), np.array(kinds, float)
    floor = np.array(lone if lone is not None else [0] * len(rows), float)
    if not len(n):
        return []
    if floor.sum() > size:
        part = size * floor / floor.sum()
    else:
        part, left = floor.copy(), min(size, n.sum()) - floor.sum()
        for _ in range(len(n)):  # what a group can't fill goes to the others
            open_groups = part < n - 1e-9
            if left <= 1e-9 or not open_groups.any():
                break
            add = np.minimum(np.where(open_groups, left * k / k[open_groups].sum(), 0), n - part)
            part, left = part + add, left - add.sum()
    ends = np.floor(np.cumsum(part) + 0.5 + 1e-9)
    return np.diff(np.concatenate([[0], ends])).astype(int).tolist()


def farthest(x: np.ndarray, kind: np.ndarray, keep: int) -> np.ndarray:
    """Each row's turn in its kind (``keep`` for those never taken): the first row, then always the one farthest from those taken.

    ``kind`` numbers the kinds, rows of one kind in a row; all kinds take their turns together.
    """
    first = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    size = np.diff(np.append(first, len(kind)))
    place = np.arange(len(kind)) - np.repeat(first, size)
    turn = np.where(np.repeat(size, size) <= keep, place, keep)
    turn[first] = 0
    some = np.flatnonzero(np.repeat(size, size) > keep)  # only these have a choice
    if not len(some):
        return turn
    x, kind = x[some], kind[some]
    at = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    size = np.diff(np.append(at, len(kind)))
    near, newest = np.full(len(x), np.inf), at
    for t in range(1, keep):
        near = np.minimum(near, np.sqrt(((x - np.repeat(x[newest], size, axis=0)) ** 2).sum(1)))
        near[newest] = -1
        top = np.repeat(np.maximum.reduceat(near, at), size)
        hits = np.flatnonzero(near == top)
        newest = hits[np.concatenate([[True], kind[hits][1:] != kind[hits][:-1]])]
        turn[some[newest]] = t
    return turn


def core_set(df: DataFrame, key: str, group: str, cells: list[str], values: list[str], keep: int, sides: list[float]) -> DataFrame:
    """One row for each candidate kept: group, cells, ``kind_n``, ``turn`` (0 for the first), key and values."""
    types = dict(df.dtypes)
    kind = [group, *cells]
    columns = [*kind, key, *values]
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + ", h long, part_n long, kind_n long, turn int"

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*kind, "h", key], kind="stable", ignore_index=True)
        g = rows.groupby(kind, sort=False, dropna=False)
        total = g["part_n"].transform("sum").to_numpy()
        turn = farthest(rows[values].to_numpy(float) / sides, g.ngroup().to_numpy(), keep)
        rows = rows.assign(part_n=np.where(turn == 0, total, 0), kind_n=total, turn=turn.astype(np.int32))
        return rows[turn < keep].reset_index(drop=True)

    def composer(whole: bool):
        """Core-sets of what a partition has; ``whole``: its rows are sorted by kind, and a kind must not be handed over in parts."""

        def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = None
            for b in batches:
                held = b if held is None else pd.concat([held, b], ignore_index=True)
                if len(held) > 200_000:
                    if whole:
                        last = (held[kind] == held[kind].iloc[-1]).all(axis=1)
                        if not last.all():
                            yield cut(held[~last])
                        held = cut(held[last])
                    else:
                        held = cut(held)
                        # A partition may have more kinds than fit: hand over what there is and begin anew.
                        if len(held) > 100_000:
                            yield held
                            held = None
            if held is not None and len(held):
                yield cut(held)

        return compose

    parts = df.select(*columns, F.xxhash64(key).alias("h"), F.lit(1).cast("long").alias("part_n"), F.lit(0).cast("long").alias("kind_n"), F.lit(0).alias("turn")).mapInPandas(composer(False), schema)
    # Compose in two steps, so that no task gets a kind's candidates of all partitions.
    salted = parts.repartition(*kind, F.pmod(F.col("h"), F.lit(16))).sortWithinPartitions(*kind).mapInPandas(composer(True), schema)
    rows = salted.repartition(*kind).sortWithinPartitions(*kind).mapInPandas(composer(True), schema)
    return rows.select(*columns, "kind_n", "turn")


def alone(df: DataFrame, candidates: DataFrame, key: str, group: str, sides: dict[str, float]) -> DataFrame:
    """Keys of the candidates that have no other row of ``df`` within the tolerance in every dimension."""
    cells = [f"_{c}" for c in sides]
    probe = candidates.select(F.col(key).alias("_key"), F.col(group).alias(group), *[F.col(c).alias(f"_v_{c}") for c in sides])
    for c, side in sides.items():
        reach = [F.floor((F.col(f"_v_{c}") + s * F.lit(side)) / F.lit(side) + EDGE).cast("int") for s in (-1, 1)]
        probe = probe.withColumn(f"_{c}", F.explode(F.sequence(*reach)))
    # The candidates are single-record cells, but their neighbours may be the hottest cells: rows stay where they are.
    near = df.select(key, group, *sides, *[F.floor(F.col(c) / F.lit(side) + EDGE).cast("int").alias(f"_{c}") for c, side in sides.items()])
    met = near.join(small(staged(probe, "probe")), [group, *cells]).filter(F.col(key) != F.col("_key"))
    for c, side in sides.items():
        met = met.filter(F.abs(F.col(c) - F.col(f"_v_{c}")) < F.lit(side))
    return candidates.select(F.col(key).alias("_key")).join(met.select("_key").distinct(), "_key", "left_anti").withColumnRenamed("_key", key)


def _celled(df: DataFrame, key: str, group: str, sides: dict[str, float]) -> tuple[DataFrame, list[str]]:
    """The usable rows with the cells of their values, and the cells' names."""
    values = list(sides)
    cells = [f"cell_{i}" for i in range(len(values))]
    usable = F.col(key).isNotNull() & F.col(group).isNotNull()
    for c in values:
        usable &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e9)
    rows = df.filter(usable).select(key, group, *values, *[F.floor(F.col(c) / F.lit(s) + EDGE).cast("int").alias(x) for x, (c, s) in zip(cells, sides.items(), strict=True)])
    return staged(rows, "varied-rows"), cells


def varied_subset(df: DataFrame, size: int, key: str, group: str, sides: dict[str, float], grow: bool = False) -> DataFrame:
    """A subset of ``size`` rows: key, group, values, ``kind_n`` (records of its kind), ``alone``.

    With ``grow`` the size is at least the number of alone records, so that all of them are in the subset.

    ``df`` has one row for each key; rows with a null key, group or value, or a NaN or infinite value,
    are left out, and extra columns are ignored. Fewer rows than ``size`` are all selected. A kind is covered if
    ``size`` allows. ``sides`` are the tolerances of the dimensions.
    """
    values = list(sides)
    rows, cells = _celled(df, key, group, sides)
    per_kind = rows.groupBy(group, *cells).agg(F.count(F.lit(1)).alias("n"))
    depths = [2**j for j in range(0, max(1, size).bit_length() + 1)]
    per_group = per_kind.groupBy(group).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), *[F.sum(F.least("n", F.lit(m))).alias(f"d{j}") for j, m in enumerate(depths)])
    groups = per_group.orderBy(group).limit(GROUPS + 1).collect()
    if len(groups) > GROUPS:
        raise ValueError(f"more than {GROUPS} groups")
    budgets = shares([g["n"] for g in groups], [g["kinds"] for g in groups], size)
    # So deep must a group's kinds be kept that its budget can be filled; twice that leaves the search a choice.
    keep = 2 * max([1, *(next((m for j, m in enumerate(depths) if g[f"d{j}"] >= b), depths[-1]) for g, b in zip(groups, budgets, strict=True))])
    core = staged(core_set(rows, key, group, cells, values, keep, list(sides.values())), "varied-core")
    single = staged(alone(rows, core.filter("kind_n = 1"), key, group, sides), "varied-alone")
    lone = {r[group]: r["n"] for r in core.select(key, group).join(single, key, "left_semi").groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}
    size = max(size, sum(lone.values())) if grow else size
    budgets = dict(zip((g[group] for g in groups), shares([g["n"] for g in groups], [g["kinds"] for g in groups], size, [lone.get(g[group], 0) for g in groups]), strict=True))
    core = core.join(small(single.withColumn("alone", F.lit(True))), key, "left").withColumn("alone", F.coalesce("alone", F.lit(False)))
    types, names = dict(core.dtypes), core.columns
    schema = ", ".join(f"`{c}` {types[c]}" for c in names)

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*cells, "turn"], ignore_index=True)
        kind = rows.groupby(cells, sort=False).ngroup().to_numpy()
        budget = budgets[rows[group].iloc[0].item() if hasattr(rows[group].iloc[0], "item") else rows[group].iloc[0]]
        chosen = disperse(rows[values].to_numpy(float), kind, rows["alone"].to_numpy(bool), budget)
        return rows.loc[chosen, names]

    # A group's core-set has at most ``keep`` rows for each kind; parts of it are searched until what is left fits one search.
    spark = df.sparkSession
    while True:
        held = {r[group]: r["n"] for r in core.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}
        parts = [(g, -(-n // (CANDIDATES // 2 * max(1, budgets[g])))) for g, n in held.items() if n > CANDIDATES * max(1, budgets[g])]
        if not parts:
            break
        split = small(spark.createDataFrame(parts, f"`{group}` {types[group]}, _parts long"), len(parts))
        core = core.join(split, group, "left").withColumn("_part", F.pmod(F.xxhash64(*cells), F.coalesce("_parts", F.lit(1)))).drop("_parts")
        core = staged(core.groupBy(group, "_part").applyInPandas(search_part(search), schema), "varied-parts")
    return core.groupBy(group).applyInPandas(search, schema).select(key, group, *values, "kind_n", "alone")


def search_part(search):
    """A search of a part of a group (its rows have the part's number besides)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return search(rows.drop(columns="_part"))

    return run


def alone_records(df: DataFrame, size: int, key: str, group: str, sides: dict[str, float]) -> DataFrame:
    """Keys of all records that are alone in ``df``, however many: those of its varied subset of ``size``, or of as many as there are."""
    return varied_subset(df, size, key, group, sides, grow=True).filter("alone").select(key)
