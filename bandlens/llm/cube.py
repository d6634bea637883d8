"""Samples whose categories have target shares, by the cube method.

Each record has an inclusion probability: what its plan is to take of its category, divided by the
records the category has. The flight phase changes probabilities along a vector of the kernel of the
balancing columns (the category indicators): among more records than categories two share one, and
the vector raises one of them by what it lowers the other, so that every category's expected count
stays as it is, until one of the two is 0 or 1. Each partition flies its own records as they come
and holds one unresolved record for each plan and category; those merge upward into a partition for
each plan, which flies them again. The landing phase drops the categories' columns and keeps the
total: the last unresolved records of a plan, at most one for each category, are paired across
categories; a last one is drawn by its probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandlens.plans.stages import small, staged

NEAR = 1e-9


def fly(group: np.ndarray, pi: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that came to 1, rows that stay open, their probabilities): all groups flown at once, in the order of their rows.

    A row meets the one that is open: the vector (1, -1) moves both until one is 0 or 1, and expected
    values stay. Done row by row, of two whose sum is below 1 one goes on with the sum, by its share
    of it; at a sum of 1 or more one is taken and the other goes on with what is over. So a group's
    cumulated probabilities cut it at whole numbers into strata that give one row each, and all rows'
    steps follow from the place of a random number in a stratum (``v``) and a choice at its end
    (``u``), both of the row that ends it. At most one row of a group stays open.
    """
    sure, flown = np.flatnonzero(pi >= 1 - NEAR), np.flatnonzero((pi > NEAR) & (pi < 1 - NEAR))
    at = flown[np.argsort(group[flown], kind="stable")]
    if not len(at):
        return sure, at, np.zeros(0)
    g, p = group[at], pi[at]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    size = np.diff(np.append(first, len(g)))
    total = np.cumsum(p)
    upto = total - np.repeat(total[first] - p[first], size)
    before = upto - p
    low, high = np.floor(before + NEAR), np.floor(upto + NEAR)
    # The rows that end a stratum, and each group's last row where something is left over after it.
    ends = high > low
    last = np.zeros(len(g), bool)
    last[first + size - 1] = True
    rest = np.where(last & (upto - high > NEAR), upto - high, 0.0)
    k = np.flatnonzero(ends)
    a, over = high[k] - before[k], np.maximum(upto[k] - high[k], 0.0)
    # A number below the end's own part, from the stratum's begin: the row it falls on won until then.
    origin = np.repeat(np.arange(len(first)), size)
    base = np.concatenate([[0], np.cumsum(np.ceil(upto[first + size - 1]) + 1)])[:-1]
    ladder = base[origin] + upto
    begin = high[k] - 1
    start = first[origin[k]]
    won_at = lambda spot, lo, hi: np.clip(np.searchsorted(ladder, spot, side="right"), lo, hi)
    winner = won_at(base[origin[k]] + begin + v[at[k]] * (1 - a), start, k)
    alone = 1 - a <= NEAR  # nothing before it in its stratum
    winner = np.where(alone, k, np.minimum(winner, np.maximum(k - 1, start)))
    takes = alone | (u[at[k]] * (1 - over) >= 1 - a - over)  # the end itself is taken, and the winner goes on
    # The winner is a row of the stratum, or what the stratum before handed on.
    same = np.concatenate([[False], origin[k][1:] == origin[k][:-1]]) if len(k) else np.zeros(0, bool)
    previous = np.concatenate([[-1], k[:-1]]) if len(k) else k
    handed = same & (winner == previous) & ~alone
    # What each end hands on: itself, the winner, or what it was handed; the nearest known one backwards.
    known = ~(takes & handed)
    source = np.maximum.accumulate(np.where(known, np.arange(len(k)), 0)) if len(k) else k
    handing = np.where(takes & ~alone, winner, k)[source]
    before_it = np.concatenate([[-1], handing[:-1]]) if len(k) else k
    real = np.where(handed, before_it, winner)
    taken = np.where(takes, k, real)
    # The open row of each group: the winner of what is over.
    tail = np.flatnonzero(rest > 0)
    spot = base[origin[tail]] + high[tail] + v[at[tail]] * rest[tail]
    left = won_at(spot, first[origin[tail]], tail)
    end_before = np.searchsorted(k, tail, side="right") - 1
    inherits = (end_before >= 0) & (k[np.maximum(end_before, 0)] == left) if len(k) else np.zeros(len(tail), bool)
    left = np.where(inherits, handing[np.maximum(end_before, 0)], left) if len(k) else left
    return np.concatenate([sure, at[taken]]), at[left], rest[tail]


def draw(units: DataFrame, plan: str, category: str, key: str, pi: str, seed: int = 0) -> DataFrame:
    """The records of a balanced sample: ``plan``, ``category``, ``key``. ``units`` has these and ``pi``."""
    types = dict(units.dtypes)
    names = [plan, category, key]

    def uniform(phase: int) -> list:
        # Each phase has its own numbers: an unresolved record's first ones have already decided that it is unresolved.
        return [(F.pmod(F.xxhash64(F.col(plan), F.col(key), F.lit(4 * seed + 2 * phase + i)), F.lit(2**52)) / F.lit(float(2**52))).alias(c) for i, c in enumerate("uv")]

    schema = f"`{plan}` {types[plan]}, `{category}` {types[category]}, `{key}` {types[key]}, pi double"

    def step(b: pd.DataFrame, by: list[str]) -> tuple[pd.DataFrame, pd.DataFrame]:
        """(rows taken, rows open with their probabilities) of a flight along the kernel of the groups ``by``."""
        group = b.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
        taken, left, p = fly(group, b["pi"].to_numpy(float), b["u"].to_numpy(float), b["v"].to_numpy(float))
        return b.iloc[taken][names].assign(pi=1.0), b.iloc[left].assign(pi=p)

    def flight(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for b in batches:
            taken, waiting = step(b if waiting is None else pd.concat([waiting, b], ignore_index=True), [plan, category])
            # The open row has used its numbers; the next one that ends a stratum brings its own.
            yield taken
        if waiting is not None:
            yield waiting[[*names, "pi"]]

    def landing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for b in batches:
            taken, waiting = step(b if waiting is None else pd.concat([waiting, b], ignore_index=True), [plan, category])
            yield taken
        if waiting is not None and len(waiting):
            # Only a plan's total is kept now: the open rows of its categories meet, and a last one is drawn.
            rng = np.random.default_rng([seed, len(waiting)])
            waiting = waiting.sort_values([plan, category, key], ignore_index=True).assign(u=rng.random(len(waiting)), v=rng.random(len(waiting)))
            taken, waiting = step(waiting, [plan])
            yield taken
            yield waiting[rng.random(len(waiting)) < waiting["pi"].to_numpy()][names].assign(pi=1.0)

    first = units.select(*names, F.col(pi).cast("double").alias("pi"), *uniform(0)).filter("pi > 0")
    flown = staged(first.mapInPandas(flight, schema), "flown")
    open_units = flown.filter("pi < 1").select("*", *uniform(1)).repartition(plan)
    landed = staged(open_units.mapInPandas(landing, schema), "landed")
    return flown.filter("pi = 1").unionByName(landed).drop("pi")


def sample_to_targets(records: DataFrame, plans: DataFrame, key: str = "sample_id", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sample, report).

    ``records``: ``key``, ``scene_id``, ``label``, one row for each record; ``plans``: one row for each
    plan and label with ``plan_id``, ``scene_id``, ``sample_size``, ``label``, ``target_share``,
    ``min_count``. A label's need is the larger of min_count and sample_size x target_share rounded to
    the nearest whole number (halves up); nulls count as 0. It takes its need or all its records; where
    minimum counts make a plan exceed sample_size, labels above their minimum are lowered in proportion
    to what they have above it. Rows with a null plan or label are left out of both sides, repeated
    plan rows count once, and a plan without records is reported with nothing drawn.

    sample: ``plan_id``, ``label``, ``key``. report: for each plan and label ``need``, ``available``,
    ``expected``, ``drawn``, ``target_share``, ``drawn_share`` (of what the plan drew), ``residual``
    (drawn minus sample_size x target_share) and ``short``: the sample fell short of the need, and an
    exact count shows that there are fewer records than that (landing alone may leave one record out).
    """
    size, share = F.coalesce("sample_size", F.lit(0)), F.coalesce("target_share", F.lit(0.0))
    minimum = F.coalesce("min_count", F.lit(0))
    plans = plans.filter(F.col("plan_id").isNotNull() & F.col("label").isNotNull()).dropDuplicates(["plan_id", "label"])
    plans = plans.select("plan_id", "scene_id", "label", share.alias("target_share"), (size * share).alias("target"), size.alias("sample_size"), minimum.alias("least"), F.greatest(minimum, F.floor(size * share + 0.5).cast("int")).alias("need"))
    records = records.filter(F.col("label").isNotNull()).select(key, "scene_id", "label")
    wanted = small(plans.select("scene_id", "label").distinct())
    records = staged(records.join(wanted, ["scene_id", "label"], "left_semi"), "plan-records")
    counts = records.groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("available"))
    w = Window.partitionBy("plan_id")  # a plan has one row for each label
    take = F.least("need", "available")
    plans = (
        plans.join(counts, ["scene_id", "label"], "left")
        .withColumn("available", F.coalesce("available", F.lit(0)))
        .withColumn("take", take)
        .withColumn("spare", F.col("take") - F.least("least", "take"))
        .withColumn("over", F.greatest(F.sum("take").over(w) - F.col("sample_size"), F.lit(0)))
        .withColumn("spare_all", F.sum("spare").over(w))
        # Only minimum counts can lower others; rounding alone leaves a plan as it is.
        .withColumn("forced", F.max(F.when(F.col("least") > F.floor(F.col("target") + 0.5), 1).otherwise(0)).over(w))
        .withColumn("expected", F.when((F.col("forced") == 1) & (F.col("over") > 0) & (F.col("spare_all") > 0), F.col("take") - F.least("over", "spare_all") * F.col("spare") / F.greatest("spare_all", F.lit(1))).otherwise(F.col("take").cast("double")))
        .select("plan_id", "scene_id", "label", "sample_size", "target_share", "target", "need", "available", "expected")
    )
    plans = staged(plans, "plans")
    rates = small(plans.filter("expected > 0 and available > 0").select("plan_id", "scene_id", "label", (F.col("expected") / F.greatest("available", F.lit(1))).alias("pi")))
    sample = draw(records.join(rates, ["scene_id", "label"]), "plan_id", "label", key, "pi", seed)
    drawn = sample.groupBy("plan_id", "label").agg(F.count(F.lit(1)).alias("drawn"))
    report = (
        plans.join(drawn, ["plan_id", "label"], "left")
        .withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        .withColumn("drawn_share", F.col("drawn") / F.greatest(F.sum("drawn").over(w), F.lit(1)))
        .withColumn("residual", F.col("drawn") - F.col("target"))
        .withColumn("short", (F.col("available") < F.col("need")) & (F.col("drawn") < F.col("need")))
        .drop("target")
    )
    return sample, report
