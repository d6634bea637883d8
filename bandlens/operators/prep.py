"""Preparing data without leaks: standardising, splitting, blocks, thresholds, mini-batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandlens.functions.guards import finite
from bandlens.plans.ordered import cumulated
from bandlens.plans.stages import small, staged


def labelled(df: DataFrame, label: str) -> DataFrame:
    """``df`` with NaN labels as null: unlabelled either way."""
    if dict(df.dtypes)[label] not in ("double", "float"):
        return df
    return df.withColumn(label, F.when(~F.isnan(label), F.col(label)))


def encode_labels(df: DataFrame, label: str, out: str) -> tuple[DataFrame, DataFrame]:
    """(df with ``out``, the class's place among the sorted labels, null for none; the classes as ``label``, ``out``).

    Places come from range partitions of the different labels, however many.
    """
    classes = df.filter(F.col(label).isNotNull()).select(label).distinct().withColumn("_one", F.lit(1))
    table = staged(cumulated(classes, label, ["_one"]).select(label, F.col("before__one").cast("int").alias(out)), "classes")
    return df.join(small(table), label, "left"), table


def moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and standard deviation (dividing by n) of each column over its finite values; (0, 1) for none, and 1 for a zero deviation."""
    row = df.agg(*[f(F.when(finite(F.col(c).cast("double")), F.col(c).cast("double"))).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def standardise(df: DataFrame, columns: list[str], train: Column, valid: Column | None = None) -> DataFrame:
    """``df`` with the columns as (x - mean) / deviation of the training rows; NaN where ``valid`` does not hold.

    Training rows must be valid (ValueError otherwise). One aggregate fits; the rest is a projection.
    """
    valid = F.lit(True) if valid is None else valid
    if df.filter(train & ~valid).limit(1).count():
        raise ValueError("training rows must be valid rows")
    fitted = moments(df.filter(train), columns)
    return df.withColumns({c: F.when(valid, (F.col(c) - F.lit(m)) / F.lit(s)).otherwise(F.lit(float("nan"))) for c, (m, s) in fitted.items()})


def zscore(df: DataFrame, columns: list[str], train: Column | None = None, least: float = 1e-6, limit: float = 1e3) -> DataFrame:
    """(x - mean) / deviation with moments of the training rows: 0 for a deviation up to ``least``, within ±``limit``, single precision."""
    rows = df if train is None else df.filter(train)
    got = rows.agg(*[f(F.col(c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    out = {}
    for i, c in enumerate(columns):
        m, s = got[f"m{i}"], got[f"s{i}"]
        z = F.lit(0.0) if s is None or s <= least else F.greatest(F.least((F.col(c) - F.lit(m)) / F.lit(s), F.lit(limit)), F.lit(-limit))
        out[c] = z.cast("float")
    return df.withColumns(out)


# ---- splits ------------------------------------------------------------------------------------


def quotas(counts: DataFrame, train_size: float, mode: str) -> DataFrame:
    """``counts`` (``_g``, ``_n``) with ``_quota``, the training rows of each class: 'class' gives each ``train_size`` (at most 1: a share of the class); 'proportional' shares a total by floors and largest remainders."""
    if mode == "class":
        return counts.withColumn("_quota", F.floor(F.col("_n") * F.lit(float(train_size))).cast("long") if train_size <= 1 else F.lit(int(train_size)).cast("long"))
    counts = staged(counts, "counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    want = int(total * train_size) if train_size <= 1 else int(train_size)
    exact = F.lit(want) * F.col("_n") / F.lit(float(max(total, 1)))
    counts = counts.withColumn("_base", F.floor(exact).cast("long")).withColumn("_order", F.struct((F.col("_base") - exact).alias("rest"), F.col("_g").cast("string").alias("g"))).withColumn("_one", F.lit(1))
    missing = want - (counts.agg(F.sum("_base")).first()[0] or 0)
    placed = cumulated(counts, "_order", ["_one"])
    return placed.select("_g", "_n", (F.col("_base") + F.when(F.col("before__one") < missing, 1).otherwise(0)).alias("_quota"))


def ranked(d: DataFrame, key: list[str], seed: int) -> DataFrame:
    """``d`` with ``_rank`` (from 1) in a shuffle of each group ``_g`` by a hash of ``key``; equal hashes are ranked by it.

    Ranks come from range-partitioned offsets: no task sorts a group.
    """
    d = staged(d.withColumn("_h", F.xxhash64(*key, F.lit(seed))), "split")
    place = cumulated(d.groupBy("_g", "_h").agg(F.count(F.lit(1)).alias("_same")), "_h", ["_same"], ["_g"]).select("_g", "_h", "before__same")
    return d.join(place, ["_g", "_h"]).withColumn("_rank", F.col("before__same") + F.row_number().over(Window.partitionBy("_g", "_h").orderBy(*key))).drop("before__same", "_h")


def split(df: DataFrame, key: str, label: str, train_size: float, mode: str = "class", seed: int = 0, insufficient: str = "error", min_test: int = 0) -> DataFrame:
    """``df`` with ``split``: 'train' or 'test' (null for unlabelled rows).

    Classes are shuffled by a hash of the key. ``insufficient`` says what happens to a class with fewer
    rows than its quota: 'error', or 'both' (all its rows are in both splits, as repeated rows).
    ``min_test``: so many test rows of each class at least, taken from its training rows again (as
    repeated rows) where it has fewer. ``mode`` 'random' ignores the classes. The training rows of each
    class are its first by the shuffle.
    """
    if mode not in ("class", "proportional", "random"):
        raise ValueError(f"unknown split mode {mode!r}")
    d = labelled(df, label)
    group = F.lit(0) if mode == "random" else F.col(label)
    has = d.filter(F.col(label).isNotNull()).withColumn("_g", group)
    per = staged(quotas(has.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")), train_size, "proportional" if mode == "random" else mode), "quotas")
    if insufficient != "both" and (short := per.filter("_quota > _n").limit(5).collect()):
        raise ValueError(f"classes with too few rows: {sorted(str(r['_g']) for r in short)}")
    d = ranked(has, [key], seed).join(small(per), "_g").unionByName(d.filter(F.col(label).isNull()), allowMissingColumns=True)
    both, one = F.array(F.lit("train"), F.lit("test")), lambda s: F.array(F.lit(s))
    again = F.lit(min_test) - F.greatest(F.col("_n") - F.col("_quota"), F.lit(0))
    parts = F.when(F.col("_rank").isNull(), F.array(F.lit(None).cast("string"))).when(F.col("_quota") > F.col("_n"), both).when(F.col("_rank") > F.col("_quota"), one("test")).when(F.col("_rank") <= again, both).otherwise(one("train"))
    return d.withColumn("split", F.explode_outer(parts)).drop("_rank", "_g", "_n", "_quota")


def blocks(pixels: DataFrame, label: str, size: int, row: str = "row", col: str = "col") -> DataFrame:
    """Labelled pixels of each class in each square block: ``block_row``, ``block_col``, ``label``, ``n``."""
    d = labelled(pixels, label).filter(F.col(label).isNotNull())
    return d.groupBy(F.floor(F.col(row) / size).cast("int").alias("block_row"), F.floor(F.col(col) / size).cast("int").alias("block_col"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def choose_blocks(by: dict[tuple[int, int], dict], quota: dict, penalty: float, rng: np.random.Generator) -> set[tuple[int, int]]:
    """Greedy choice of training blocks until each class has its quota in them.

    A block's gain is what it adds to the classes still short, divided by 1 + penalty x chosen
    neighbours; ties are broken at random. ``by``: pixels of each class in each block.
    """
    got, chosen = dict.fromkeys(quota, 0), set()
    while any(got[k] < quota[k] for k in quota):
        best, options = 0.0, []
        for b, ks in by.items():
            if b in chosen:
                continue
            gain = sum(min(n, max(quota[k] - got[k], 0)) for k, n in ks.items())
            if gain <= 0:
                continue
            gain /= 1 + penalty * sum((b[0] + i, b[1] + j) in chosen for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)
            if gain > best + 1e-12:
                best, options = gain, [b]
            elif abs(gain - best) <= 1e-12:
                options.append(b)
        if not options:
            break
        b = sorted(options)[int(rng.integers(len(options)))]
        chosen.add(b)
        for k, n in by[b].items():
            got[k] += n
    return chosen


def spatial_split(pixels: DataFrame, label: str, train_size: int, per_class: bool = True, size: int = 10, buffer: int = 3, neighbour_penalty: float = 0.0, seed: int = 0, insufficient: bool = False, min_test: int = 0, attempts: int = 100, row: str = "row", col: str = "col") -> DataFrame:
    """``pixels`` with ``split``: 'train', 'test' or null, the two sides farther apart than ``buffer`` pixels.

    Whole blocks of ``size`` x ``size`` pixels are chosen until they hold each class's quota (``train_size``, or its
    part of that number by floors and largest remainders); exactly the quota is drawn from them. Test
    pixels are all labelled ones outside the chosen blocks and farther than ``buffer`` from them (the
    larger of row and column distance). Seeds are tried until every class has its quota and a test
    pixel (ValueError after ``attempts``). ``insufficient``: a class with too few pixels gives all that
    the chosen blocks have of it, and may have no test pixel. ``min_test``: so many test pixels of each
    class at least; missing ones come from its pixels in the chosen blocks, undrawn ones first (drawn
    ones are then repeated rows, in both splits).

    All attempts are judged on a table of the blocks' pixels by class and by how far the chosen blocks
    may be in each direction, which the driver holds (at most a million rows, else ValueError).
    """
    d = labelled(pixels, label)
    far = lambda p: F.greatest(F.floor((F.lit(buffer) - p - 1) / size) + 1, F.lit(0)).cast("int")
    d = d.withColumns({"_br": F.floor(F.col(row) / size).cast("int"), "_bc": F.floor(F.col(col) / size).cast("int")})
    r, c = F.col(row) - F.col("_br") * size, F.col(col) - F.col("_bc") * size
    # So many blocks above, below, to the left and to the right are within the buffer of a pixel.
    zone = ["_up", "_down", "_left", "_right"]
    d = d.withColumns({"_up": far(r), "_down": far(size - 1 - r), "_left": far(c), "_right": far(size - 1 - c)})
    d = staged(d.withColumn("_g", F.col(label)), "pixels")
    counts = d.filter(F.col(label).isNotNull()).groupBy("_br", "_bc", *zone, F.col(label).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    table = [tuple(x) for x in counts.orderBy("_br", "_bc", *zone, "k").limit(1_000_001).collect()]
    if len(table) > 1_000_000:
        raise ValueError("more than a million blocks and classes: choose larger blocks")
    by: dict[tuple[int, int], dict] = {}
    total: dict = {}
    for x in table:
        at, k, n = x[:2], x[6], x[7]
        by.setdefault(at, {})[k] = by.get(at, {}).get(k, 0) + n
        total[k] = total.get(k, 0) + n
    if per_class:
        quota = dict.fromkeys(total, int(train_size))
    else:
        exact = {k: train_size * n / sum(total.values()) for k, n in total.items()}
        quota = {k: int(x) for k, x in exact.items()}
        for k in sorted(exact, key=lambda k: (quota[k] - exact[k], str(k)))[: int(train_size) - sum(quota.values())]:
            quota[k] += 1
    short = sorted(str(k) for k, n in total.items() if n < 2 or (n <= quota[k] and not insufficient))
    if short or not total:
        raise ValueError(f"classes with too few pixels for training and test: {short}")
    target = {k: min(q, total[k] - 1) if insufficient else q for k, q in quota.items()}
    for attempt in range(attempts):
        chosen = choose_blocks(by, target, neighbour_penalty, np.random.default_rng(seed + attempt))
        inside, test, state = dict.fromkeys(total, 0), dict.fromkeys(total, 0), {}
        for x in table:
            (br, bc, up, down, left, right), k, n = x[:6], x[6], x[7]
            if (br, bc) in chosen:
                state[x[:6]] = 0
                inside[k] += n
            elif any((i, j) in chosen for i in range(br - up, br + down + 1) for j in range(bc - left, bc + right + 1)):
                state[x[:6]] = 1
            else:
                state[x[:6]] = 2
                test[k] += n
        enough = insufficient or all(inside[k] >= quota[k] for k in quota)
        if chosen and enough and (insufficient or all(test[k] + min(max(min_test - test[k], 0), inside[k]) > 0 for k in total)):
            break
    else:
        raise ValueError(f"no split with every class on both sides in {attempts} attempts")
    spark = pixels.sparkSession
    states = spark.createDataFrame([(*k, v) for k, v in state.items()], ", ".join(f"{c} int" for c in ["_br", "_bc", *zone]) + ", _state int")
    kind = dict(d.dtypes)[label]
    plan = spark.createDataFrame([(k, quota[k], inside[k], max(min_test - test[k], 0)) for k in total], f"_g {kind}, _quota long, _inside long, _more long")
    d = d.join(small(states), ["_br", "_bc", *zone], "left").withColumn("_state", F.when(F.col(label).isNotNull(), F.col("_state")))
    drawn = ranked(d.filter("_state = 0"), [row, col], seed).join(small(plan), "_g")
    train, again = F.col("_rank") <= F.col("_quota"), F.col("_rank") > F.col("_inside") - F.col("_more")
    parts = F.when(train & again, F.array(F.lit("train"), F.lit("test"))).when(train, F.array(F.lit("train"))).when(again, F.array(F.lit("test"))).otherwise(F.array(F.lit(None).cast("string")))
    rest = d.filter("_state is null or _state <> 0").withColumn("split", F.when(F.col("_state") == 2, "test"))
    drop = ["_br", "_bc", *zone, "_state", "_g"]
    return drawn.withColumn("split", F.explode(parts)).drop(*drop, "_rank", "_quota", "_inside", "_more").unionByName(rest.drop(*drop))


# ---- thresholds ----------------------------------------------------------------------------------


def histogram(df: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """``bin`` (from 0), ``n``, ``centre``: equal-width bins over the finite values, the last one closed; empty bins are absent."""
    x = F.col(value).cast("double")
    d = df.filter(finite(x)).select(x.alias("x"))
    ends = d.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    # A constant column gets the range of half a unit to either side.
    ends = ends.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    b = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    g = d.crossJoin(F.broadcast(ends)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))  # one row
    return g.select("bin", "n", (F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins).alias("centre"))


def otsu(df: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """``threshold``, ``variance``: the centre of the bin that begins the upper class where between-class variance is largest (the first such).

    Empty bins can only tie with the next occupied one, so they are added for the first largest to be theirs.
    """
    h = histogram(df, value, bins)
    spark = df.sparkSession
    ends = h.agg(F.min(F.struct("bin", "centre")).alias("a"), F.max(F.struct("bin", "centre")).alias("b"), F.sum("n").alias("total"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(h), "bin", "left").crossJoin(F.broadcast(ends))
    width = F.try_divide(F.col("b.centre") - F.col("a.centre"), F.col("b.bin") - F.col("a.bin"))
    grid = grid.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("centre", F.coalesce("centre", F.col("a.centre") + (F.col("bin") - F.col("a.bin")) * F.coalesce(width, F.lit(1.0 / bins))))
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # over ``bins`` rows
    g = grid.select("bin", "centre", "total", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n0"), F.coalesce(F.sum(F.col("n") * F.col("centre")).over(w), F.lit(0.0)).alias("s0"), F.sum(F.col("n") * F.col("centre")).over(Window.partitionBy()).alias("s"))
    w0, w1 = F.col("n0") / F.col("total"), 1 - F.col("n0") / F.col("total")
    diff = F.try_divide(F.col("s0"), F.col("n0")) - F.try_divide(F.col("s") - F.col("s0"), F.col("total") - F.col("n0"))
    g = g.withColumn("variance", F.coalesce(w0 * w1 * diff * diff, F.lit(0.0))).withColumn("key", F.round("variance", 12))
    best = g.agg(F.max(F.struct("key", -F.col("bin"), "centre", "variance")).alias("m"))
    return best.select(F.col("m.centre").alias("threshold"), F.col("m.variance").alias("variance"))


# ---- mini-batches ----------------------------------------------------------------------------------


def mini_batches(df: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """``df`` with ``batch``: consecutive rows of a shuffle by a hash of the key, ``size`` to a batch.

    Places in the shuffle come from range-partitioned offsets, so no task sorts the table.
    """
    d = staged(df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))), "batches")
    same = d.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    place = cumulated(same, "_h", ["_n"]).select("_h", "before__n")
    w = Window.partitionBy("_h").orderBy(key)
    return d.join(place, "_h").withColumn("batch", F.floor((F.col("before__n") + F.row_number().over(w) - 1) / size).cast("long")).drop("_h", "before__n")


def rectangles(height: int, width: int, tall: int, wide: int, seed: int = 0, share: float = 0.15, least: int = 20, most: int = 100) -> list[tuple[int, int, int, int]]:
    """A pool of random rectangles (r0, c0, r1, c1; the ends excluded): 15 % of all positions, between 20 and 100; all if there are no more than 20."""
    n, across = max(1, height - tall + 1) * max(1, width - wide + 1), max(1, width - wide + 1)
    k = n if n <= least else int(min(most, max(least, share * n)))
    at = np.random.default_rng(seed).choice(n, k, replace=False)
    return [(int(i) // across, int(i) % across, min(height, int(i) // across + tall), min(width, int(i) % across + wide)) for i in at]


def within(rectangle: tuple[int, int, int, int], row: str = "row", col: str = "col") -> Column:
    """The pixels of a rectangle, as a condition that scans can be pruned by."""
    r0, c0, r1, c1 = rectangle
    return (F.col(row) >= r0) & (F.col(row) < r1) & (F.col(col) >= c0) & (F.col(col) < c1)


def poisson(mean: float, rng: np.random.Generator) -> int:
    """A Poisson number by multiplying uniforms until they fall below exp(-mean)."""
    n, p, floor = 0, float(rng.random()), float(np.exp(-mean))
    while p > floor:
        n += 1
        p *= float(rng.random())
    return n
