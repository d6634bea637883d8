"""Percentiles per group with a probabilistic error bound, by mergeable compactor hierarchies.

A sketch holds levels of values; a value of level h stands for 2^h values. When a level holds more
than ``k`` values it is sorted and every other one, from a random start, moves to the next level
(a last odd one stays). Sketches merge levelwise. Each compaction of level h shifts any rank by at
most 2^h, with mean 0; ``err2`` sums their squares, so that by Hoeffding's inequality a rank is off
by more than t with probability at most 2 exp(-t^2 / (2 err2)). The bound given is 4 sqrt(err2)
(probability below 0.0007); groups with at most ``k`` values are never compacted and are exact.

As rows: the group's columns, ``n``, ``err2``, ``sizes`` (values by level) and ``items``. Rows of
separate files, runs or days can be united and merged again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandlens.plans.ordered import cumulated
from bandlens.plans.stages import small, staged

K = 400
#: Values a worker sketches at a time.
AT_ONCE = 1_000_000


def compact(levels: list[np.ndarray], err2: float, k: int, rng: np.random.Generator) -> tuple[list[np.ndarray], float]:
    """Levels of at most ``k`` values (level h may keep one odd value more while it is compacted)."""
    out, h = [], 0
    levels = list(levels)
    while h < len(levels):
        x = levels[h]
        if len(x) > k:
            x = np.sort(x)
            odd, x = x[len(x) - len(x) % 2 :], x[: len(x) - len(x) % 2]
            up = x[int(rng.integers(2)) :: 2]
            if h + 1 == len(levels):
                levels.append(up)
            else:
                levels[h + 1] = np.concatenate([levels[h + 1], up])
            err2 += 4.0**h
            x = odd
        out.append(x)
        h += 1
    return out, err2


def _rng(seed: int) -> np.random.Generator:
    """Random numbers of a task: the same ones if it runs again. Each step has its own ``seed``, so that its coins are independent of those of the steps before."""
    task = TaskContext.get()
    return np.random.default_rng([seed, task.partitionId() if task else 0])


def _schema(keys: list[T.StructField]) -> T.StructType:
    return T.StructType([*keys, T.StructField("n", T.LongType()), T.StructField("err2", T.DoubleType()), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.DoubleType()))])


def _batch(keys: list[pa.Array], names: list[str], n: np.ndarray, err2: np.ndarray, sizes: list, items: list, counts: np.ndarray) -> pa.RecordBatch:
    """``counts``: items of each row; ``items``: their arrays in order."""
    flat = np.concatenate([np.zeros(0), *items])
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return pa.RecordBatch.from_arrays([*keys, pa.array(n, pa.int64()), pa.array(err2, pa.float64()), pa.array(sizes, pa.list_(pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float64()))], names=[*names, "n", "err2", "sizes", "items"])


def _codes(columns: list[pa.Array]) -> np.ndarray:
    """Equal numbers for rows that are equal in all columns (nulls are equal)."""
    frame = pd.DataFrame({i: pd.factorize(c.to_pandas(), use_na_sentinel=True)[0] for i, c in enumerate(columns)})
    return frame.groupby(list(frame.columns), sort=False).ngroup().to_numpy() if len(columns) > 1 else frame[0].to_numpy() + 1


def sketched(values: DataFrame, keys: list[str], value: str, k: int = K, seed: int = 0) -> DataFrame:
    """Sketches of each partition of ``values`` (not merged between partitions; see :func:`merged`).

    Null and NaN values are left out; infinities are values. Null keys are a group.
    """
    fields = [values.schema[c] for c in keys]
    names = list(keys)

    def build(table: pa.Table, rng: np.random.Generator) -> pa.RecordBatch | None:
        v = table.column(len(names)).to_numpy().astype(float)
        if not len(v):
            return None
        columns = [table.column(i).combine_chunks() for i in range(len(names))]
        gid = _codes(columns)
        order = np.lexsort((v, gid))
        gid, v = gid[order], v[order]
        at = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]]))
        n = np.diff(np.append(at, len(v)))
        first = pa.array(order[at], pa.int64())
        err2, sizes, items, counts = np.zeros(len(at)), [[int(c)] for c in n], [], n.copy()
        large, done = np.flatnonzero(n > k), 0
        for g in large:  # the small groups between two large ones are one slice
            items.append(v[done : at[g]])
            levels, err2[g] = compact([v[at[g] : at[g] + n[g]]], 0.0, k, rng)
            sizes[g], counts[g] = [len(x) for x in levels], sum(map(len, levels))
            items += levels
            done = at[g] + n[g]
        items.append(v[done:])
        return _batch([c.take(first) for c in columns], names, n, err2, sizes, items, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = _rng(seed)
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= AT_ONCE:
                if (out := build(pa.Table.from_batches(held), rng)) is not None:
                    yield out
                held, rows = [], 0
        if held and (out := build(pa.Table.from_batches(held), rng)) is not None:
            yield out

    v = F.col(value).cast("double")
    return values.filter(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_v")).mapInArrow(run, _schema(fields))


def merged(sketches: DataFrame, keys: list[str], k: int = K, seed: int = 1) -> DataFrame:
    """One sketch for each combination of ``keys``, which may be fewer than the sketches have.

    Rows are shuffled by the keys, sorted and merged as they come, so a task holds one open group.
    For few groups of many sketches, merge first with one more key (a salt) and then without it.
    """
    fields = [sketches.schema[c] for c in keys]
    names = list(keys)

    def merge(table: pa.Table, rng: np.random.Generator) -> pa.RecordBatch:
        columns = [table.column(i).combine_chunks() for i in range(len(names))]
        gid = _codes(columns)
        at = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]]))
        ends = np.append(at[1:], len(gid))
        n_rows, err_rows = table.column("n").to_numpy(), table.column("err2").to_numpy()
        flat, sizes_rows = table.column("items").combine_chunks(), table.column("sizes").to_pylist()
        lengths = np.fromiter((sum(s) for s in sizes_rows), np.int64, len(sizes_rows))
        v = flat.flatten().to_numpy()
        start = np.cumsum(lengths) - lengths
        n, err2, counts = np.add.reduceat(n_rows, at), np.add.reduceat(err_rows, at), np.add.reduceat(lengths, at)
        single = np.add.reduceat(np.fromiter((len(s) > 1 for s in sizes_rows), np.int64, len(sizes_rows)), at) == 0
        simple = single & (counts <= k)
        sizes, items, done = [[int(c)] for c in counts], [], 0
        for g in np.flatnonzero(~simple):
            items.append(v[done : start[at[g]]])
            levels: list[np.ndarray] = []
            for r in range(at[g], ends[g]):
                p = start[r]
                for h, size in enumerate(sizes_rows[r]):
                    if h == len(levels):
                        levels.append([])
                    levels[h].append(v[p : p + size])
                    p += size
            new, err2[g] = compact([np.concatenate(x) for x in levels], err2[g], k, rng)
            sizes[g], counts[g] = [len(x) for x in new], sum(map(len, new))
            items += new
            done = start[ends[g] - 1] + lengths[ends[g] - 1]
        items.append(v[done:])
        first = pa.array(at, pa.int64())
        return _batch([c.take(first) for c in columns], names, n, err2, sizes, items, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = _rng(seed)
        open_group: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            out = merge(pa.Table.from_batches([*open_group, b]), rng)
            if out.num_rows > 1:
                yield out.slice(0, out.num_rows - 1)
            open_group = [pa.RecordBatch.from_arrays(out.slice(out.num_rows - 1).columns, schema=b.schema) if out.schema == b.schema else pa.Table.from_batches([out.slice(out.num_rows - 1)]).cast(b.schema).to_batches()[0]]
        yield from open_group

    s = sketches.select(*keys, "n", "err2", "sizes", "items")
    return s.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, _schema(fields))


def _at_rank(sizes: list[int], items: np.ndarray, n: int, ranks: np.ndarray) -> np.ndarray:
    weights = np.repeat(2.0 ** np.arange(len(sizes)), sizes)
    order = np.argsort(items, kind="stable")
    upto = np.cumsum(weights[order])
    return items[order][np.minimum(np.searchsorted(upto, np.clip(ranks, 0, n - 1), side="right"), len(items) - 1)]


def estimated(sketches: DataFrame, keys: list[str], quantiles: list[float]) -> DataFrame:
    """Sketches' answers: keys, ``n``, ``rank_error`` (a bound, as a share of n), and for each quantile ``value``, ``low``, ``high``.

    One row for each group and quantile. Without compactions the value interpolates linearly between
    the two ranks next to (n - 1) q; ``low`` and ``high`` are then the value itself.
    """
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, rows = [], []
            flat = b.column("items").flatten().to_numpy()
            done = 0
            for r, (n, err2, sizes) in enumerate(zip(b.column("n").to_pylist(), b.column("err2").to_pylist(), b.column("sizes").to_pylist(), strict=True)):
                items = flat[done : done + sum(sizes)]
                done += sum(sizes)
                if not len(items):
                    continue
                bound = 4 * err2**0.5
                for q in quantiles:
                    rank = (n - 1) * q
                    if err2 == 0 and len(sizes) == 1:
                        s = np.sort(items)
                        lo, hi = s[int(rank)], s[min(int(rank) + 1, n - 1)]
                        f = rank - int(rank)
                        value = lo if f == 0 or lo == hi else lo * (1 - f) + hi * f
                        low = high = value
                    else:
                        low, value, high = _at_rank(sizes, items, n, np.array([rank - bound - 1, rank, rank + bound + 1]))
                        low = -np.inf if rank - bound - 1 <= 0 else low
                        high = np.inf if rank + bound + 1 >= n - 1 else high
                    index.append(r)
                    rows.append((n, min(1.0, bound / n), q, value, low, high))
            take = pa.array(index, pa.int64())
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(take) for i in range(len(names))], pa.array(cols[0], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[1:]]], names=[*names, "n", "rank_error", "q", "value", "low", "high"])

    fields = [sketches.schema[c] for c in keys]
    doubles = [T.StructField(c, T.DoubleType()) for c in ("rank_error", "q", "value", "low", "high")]
    return sketches.select(*keys, "n", "err2", "sizes", "items").mapInArrow(run, T.StructType([*fields, T.StructField("n", T.LongType()), *doubles]))


def exact(values: DataFrame, keys: list[str], value: str, bounds: DataFrame) -> DataFrame:
    """Exact percentiles (linear interpolation) of the groups of ``bounds``: keys, ``q``, ``exact``.

    ``bounds`` has keys, ``n``, ``q``, ``low`` and ``high`` from :func:`estimated`. One pass counts the
    values below ``low`` and keeps those between: a few times the rank error of a group. Should the
    wanted ranks lie outside (the bound is probabilistic), the group is done again between its
    infinities.
    """
    v = F.col(value).cast("double")

    def within(b: DataFrame) -> DataFrame:
        b = staged(b.select(*keys, "q", "n", "low", "high"), "bounds")
        joined = values.filter(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_v")).join(small(b), keys)
        # Equal values are one row, and all those below the bounds another; ranks come from range partitions, so no task holds a group.
        low = F.col("_v") < F.col("low")
        counted = joined.filter(F.col("_v") <= F.col("high")).groupBy(*keys, "q", "n", F.when(low, F.lit(float("-inf"))).otherwise(F.col("_v")).alias("_v"), low.alias("_low")).agg(F.count(F.lit(1)).alias("c"))
        counted = counted.withColumn("_place", F.struct((~F.col("_low")).alias("x"), "_v"))
        placed = cumulated(counted, "_place", ["c"], [*keys, "q"]).filter("not _low")
        rank: Column = (F.col("n") - 1) * F.col("q")
        has = lambda r: F.max(F.when((F.col("before_c") <= r) & (r < F.col("before_c") + F.col("c")), F.col("_v")))
        ranked = placed.groupBy(*keys, "q").agg(F.max(rank - F.floor(rank)).alias("w"), has(F.floor(rank)).alias("lo"), has(F.ceil(rank)).alias("hi")).filter("lo is not null and hi is not null")
        return ranked.select(*keys, "q", F.when((F.col("w") == 0) | (F.col("lo") == F.col("hi")), F.col("lo")).otherwise(F.col("lo") * (1 - F.col("w")) + F.col("hi") * F.col("w")).alias("exact"))

    found = staged(within(bounds), "exact")
    missed = bounds.join(found.select(*keys, "q"), [*keys, "q"], "left_anti")
    if not missed.isEmpty():
        again = missed.withColumn("low", F.lit(float("-inf"))).withColumn("high", F.lit(float("inf")))
        found = found.unionByName(within(again))
    return found


def log_values(log: DataFrame) -> DataFrame:
    """evolution_log's entries as rows (run_id, operation_name, field, v): each entry once, names normalised.

    Copies of an entry are equal but for log_id and ingested_at, so equal rows of the columns read are
    one entry (a hash aggregate with a map-side combine). Null, NaN and infinite values and null names
    are left out.
    """
    name = F.regexp_replace(F.lower(F.trim("operation_name")), "[ -]", "_")
    entries = log.select("run_id", "entry_no", name.alias("operation_name"), "fitness_delta", F.col("complexity_delta").cast("double").alias("complexity_delta")).filter(F.col("operation_name").isNotNull()).distinct()
    long = entries.selectExpr("run_id", "operation_name", "stack(2, 'fitness_delta', fitness_delta, 'complexity_delta', complexity_delta) as (field, v)")
    return long.filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))


def log_sketches(log: DataFrame, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(values, sketches by run, operation and field) of an evolution log, both written."""
    values = staged(log_values(log), "log-values")
    keys = ["run_id", "operation_name", "field"]
    return values, staged(merged(sketched(values, keys, "v", k), keys, k), "log-sketches")


def rolled(sketches: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Merged to fewer keys, in two steps, each with coins of its own."""
    seed = zlib.crc32(",".join(keys).encode())
    salted = sketches.withColumn("salt", F.pmod(F.xxhash64("run_id"), F.lit(32)).cast("int"))
    return merged(merged(salted, [*keys, "salt"], k, seed), keys, k, seed + 1)


def log_percentiles(log: DataFrame, quantiles: list[float], k: int = K) -> DataFrame:
    """Percentiles of fitness_delta and complexity_delta for each operation, each run and the whole log."""
    _, sketches = log_sketches(log, k)
    out = None
    for scope, keys in (("operation", ["operation_name", "field"]), ("run", ["run_id", "field"]), ("log", ["field"])):
        part = estimated(rolled(sketches, keys, k), keys, quantiles).select(F.lit(scope).alias("scope"), (F.col("operation_name") if "operation_name" in keys else F.lit(None).cast("string")).alias("operation_name"), (F.col("run_id") if "run_id" in keys else F.lit(None).cast("long")).alias("run_id"), "field", "n", "rank_error", "q", "value")
        out = part if out is None else out.unionByName(part)
    return out


def unusual_medians(log: DataFrame, least: int = 25, k: int = K) -> DataFrame:
    """``run_id``, ``operation_name``, ``field``, ``side``: groups of a run and operation whose median lies outside the operation's 10th to 90th percentile.

    The sketches give intervals for the medians and the percentiles; where an interval leaves a
    comparison open, exact values (see :func:`exact`) decide it.
    """
    values, sketches = log_sketches(log, k)
    group, op = ["run_id", "operation_name", "field"], ["operation_name", "field"]
    medians = staged(estimated(sketches.filter(F.col("n") >= least), group, [0.5]), "medians")
    ends = staged(estimated(rolled(sketches, op, k), op, [0.1, 0.9]), "ends")
    side = F.when(F.col("q") == 0.9, "high").otherwise("low")
    ends_wide = ends.select(*op, F.col("q").alias("end_q"), side.alias("side"), F.col("low").alias("end_low"), F.col("high").alias("end_high"))
    pairs = medians.select(*group, F.col("low").alias("m_low"), F.col("high").alias("m_high")).join(small(ends_wide), op)
    high = F.col("side") == "high"
    surely = (high & (F.col("m_low") > F.col("end_high"))) | (~high & (F.col("m_high") < F.col("end_low")))
    never = (high & (F.col("m_high") <= F.col("end_low"))) | (~high & (F.col("m_low") >= F.col("end_high")))
    pairs = staged(pairs.withColumn("state", F.when(surely, 1).when(never, 0).otherwise(2)), "pairs")
    sure = pairs.filter("state = 1").select(*group, "side")
    doubt = pairs.filter("state = 2")
    open_medians = doubt.filter("m_low < m_high").select(*group).distinct()
    open_ends = doubt.select(*op, F.col("end_q").alias("q")).distinct()
    exact_medians = exact(values, group, "v", medians.join(open_medians, group, "left_semi")).select(*group, F.col("exact").alias("m_exact"))
    exact_ends = exact(values, op, "v", ends.join(open_ends, [*op, "q"], "left_semi")).select(*op, F.col("q").alias("end_q"), F.col("exact").alias("end_exact"))
    checked = doubt.join(exact_medians, group, "left").join(exact_ends, [*op, "end_q"], "left")
    m = F.coalesce("m_exact", "m_low")
    checked = checked.filter((high & (m > F.col("end_exact"))) | (~high & (m < F.col("end_exact")))).select(*group, "side")
    return sure.unionByName(checked)
