"""Mixing sources to target shares of a total size, by Pareto order sampling.

Of each source a mix first takes whole copies of all its documents, as many as fit its target and
at most ``max_repeats``. What is left of the target is a sample with unequal probabilities: a
document of size s has the inclusion probability p = min(1, k s), with k such that the expected size
is what is left. Those with p = 1 are taken (one more whole copy); the others have a uniform number u
from a hash of their id and the rank ``u / (1 - u) / (p / (1 - p))``, and are taken in the order of
their ranks as long as they fit. Of the others the one whose size is nearest to what is then missing
follows, if that brings the size nearer to the target.

No task holds a source. k comes from sums of sizes and of their squares in classes of sizes (eight
to a doubling: a few hundred rows for a source, whatever its documents); the order of the ranks is
found in two passes, first by 4096 bands (their sums again are a table of bounded size), then exactly
within the one band in which the size is reached, by range partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandlens.plans.ordered import cumulated
from bandlens.plans.stages import small, staged

BANDS, CLASSES = 4096, 8


def _name(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def prices(plan: DataFrame, classes: DataFrame) -> DataFrame:
    """``plan`` with ``k`` and ``certain``: the class of sizes above which documents are taken for sure.

    ``classes``: ``term``, ``source``, ``class``, ``tokens``, ``squares`` and the largest size, ``top``. Of
    the classes from the largest one down, the first is found below which k s is at most 1 for all (or
    taking which as a whole would be too much).
    """
    upto = Window.partitionBy("mix_id", "source").orderBy("class")  # a few hundred classes
    d = plan.filter("rest > 0").select("mix_id", "term", "source", "rest").join(classes, ["term", "source"])
    d = d.withColumn("above", F.sum("tokens").over(Window.partitionBy("mix_id", "source")) - F.sum("tokens").over(upto)).withColumn("below", F.sum("squares").over(upto))
    d = d.withColumn("k", F.try_divide(F.col("rest") - F.col("above"), F.col("below")))
    fits = (F.col("k") * F.col("top") <= 1) | (F.col("rest") - F.col("above") - F.col("tokens") <= 0)
    found = d.filter(fits).groupBy("mix_id", "source").agg(F.max(F.struct("class", "k")).alias("m")).select("mix_id", "source", F.col("m.class").alias("certain"), F.greatest("m.k", F.lit(0.0)).alias("k"))
    return plan.join(found, ["mix_id", "source"], "left")


def mix_sources(sizes: DataFrame, mixes: DataFrame, key: str = "doc_id", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sample, report).

    ``sizes``: one row for each document with ``key``, ``term``, ``source`` and ``n_tokens``; every
    row counts, repeated ones too (those of one key have one random number), and rows with a null key
    are documents of their own. ``mixes``: ``mix_id``, ``term``, ``total_tokens``, ``source``,
    ``target_share``, ``max_repeats``; nulls count as 0, repeated rows as one. Sources are compared
    trimmed and in lower case; documents whose source or term is null are in no mix. Documents without
    tokens come with whole copies only.

    sample: ``mix_id``, ``source``, ``key``, ``n_tokens``, ``copies`` (at least 1), ``p`` (the probability of
    the last copy) and ``rank``. report: one row for each row of ``mixes``, with ``target_tokens``,
    ``available_tokens`` (of one copy of each document), ``reached_tokens``, ``target_share``,
    ``reached_share`` (of what the mix reached) and ``unmet``: the sample stayed below the target, and
    an exact sum shows that all repeats of the source hold fewer tokens than that.
    """
    mixes = (
        mixes.filter(F.col("source").isNotNull() & F.col("mix_id").isNotNull())
        .select("mix_id", "term", _name("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), (F.coalesce("target_share", F.lit(0.0)) * F.coalesce("total_tokens", F.lit(0))).alias("target_tokens"))
        .dropDuplicates(["mix_id", "source"])
    )
    # Row numbers are fixed by writing the rows; they tell apart what is equal in all else.
    docs = sizes.select(key, F.col("term"), _name("source").alias("source"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"), F.monotonically_increasing_id().alias("_row"))
    docs = docs.filter(F.col("term").isNotNull() & F.col("source").isNotNull())
    docs = staged(docs.join(small(mixes.select("term").distinct()), "term", "left_semi"), "mix-docs")
    h = F.when(F.col(key).isNull(), F.xxhash64("_row", F.lit(seed))).otherwise(F.xxhash64(F.col(key), F.lit(seed)))
    docs = docs.withColumn("u", (F.pmod(h, F.lit(2**52)) + 0.5) / F.lit(float(2**52))).withColumn("class", F.when(F.col("n_tokens") > 0, F.floor(F.log2("n_tokens") * CLASSES).cast("int")).otherwise(-1))

    n = F.col("n_tokens").cast("double")
    classes = staged(docs.groupBy("term", "source", "class").agg(F.sum("n_tokens").alias("tokens"), F.sum(n * n).alias("squares"), F.max("n_tokens").alias("top")), "mix-classes")
    total = classes.groupBy("term", "source").agg(F.sum("tokens").alias("available_tokens"))
    plan = (
        mixes.join(total, ["term", "source"], "left")
        .withColumn("available_tokens", F.coalesce("available_tokens", F.lit(0)))
        .withColumn("ratio", F.when(F.col("available_tokens") > 0, F.col("target_tokens") / F.greatest("available_tokens", F.lit(1))).otherwise(0.0))
        .withColumn("whole", F.least(F.floor("ratio"), F.col("max_repeats")).cast("int"))
        .withColumn("rest", F.when((F.col("whole") < F.col("max_repeats")) & (F.col("available_tokens") > 0), F.col("target_tokens") - F.col("whole") * F.col("available_tokens")).otherwise(0.0))
    )
    plan = staged(prices(staged(plan, "mix-plan"), classes), "mix-prices")

    # Each document under each mix of its term and source, with its rank; certain ones come first.
    placed = docs.join(small(plan.select("mix_id", "term", "source", "whole", "rest", "k", "certain")), ["term", "source"])
    sure = F.col("class") > F.col("certain")
    placed = placed.withColumn("p", F.when(F.col("rest") > 0, F.when(sure, 1.0).otherwise(F.least(F.col("k") * F.col("n_tokens"), F.lit(1.0)))).otherwise(0.0))
    odds = F.col("u") / (1 - F.col("u")) * (1 - F.col("p")) / F.col("p")
    placed = placed.withColumn("rank", F.when(F.col("p") >= 1, 0.0).when(F.col("p") > 0, odds))
    placed = placed.withColumn("band", F.when(F.col("p") >= 1, -1).when(F.col("p") > 0, F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * BANDS), F.lit(BANDS - 1))).otherwise(BANDS).cast("int"))
    by_band = staged(placed.filter("rest > 0").groupBy("mix_id", "source", "band").agg(F.sum("n_tokens").alias("tokens")), "mix-bands")
    upto = Window.partitionBy("mix_id", "source").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)  # at most BANDS + 2 rows
    edge = (
        by_band.join(plan.select("mix_id", "source", "rest"), ["mix_id", "source"])
        .withColumn("before", F.coalesce(F.sum("tokens").over(upto), F.lit(0)))
        .filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("tokens") >= F.col("rest")))
        .select("mix_id", "source", F.col("band").alias("edge_band"), "before")
    )
    placed = placed.join(small(staged(edge, "mix-edges")), ["mix_id", "source"], "left")
    columns = ["mix_id", "source", "_row", key, "n_tokens", "p", "rank", "whole", "more"]
    inside = placed.filter(F.col("band") == F.col("edge_band")).withColumn("_order", F.struct("rank", "u", "_row"))
    inside = cumulated(inside, "_order", ["n_tokens"], ["mix_id", "source"]).withColumn("more", F.when(F.col("before") + F.col("before_n_tokens") + F.col("n_tokens") <= F.col("rest"), 1).otherwise(0))
    inside = staged(inside.select(*columns, "rest", "before"), "mix-edge")
    outside = placed.filter(F.col("edge_band").isNull() | (F.col("band") != F.col("edge_band"))).withColumn("more", F.when(F.col("band") < F.col("edge_band"), 1).otherwise(0)).select(*columns)
    # What is still missing, and of the documents not taken the one nearest to it in size.
    gap = inside.groupBy("mix_id", "source").agg((F.max("rest") - F.max("before") - F.sum(F.col("n_tokens") * F.col("more"))).alias("gap")).filter("gap > 0")
    every = outside.unionByName(inside.select(*columns))
    off = F.abs(F.col("n_tokens") - F.col("gap"))
    last = every.filter("more = 0 and p > 0").join(small(staged(gap, "mix-gaps")), ["mix_id", "source"]).filter(off < F.col("gap")).groupBy("mix_id", "source").agg(F.min(F.struct(off.alias("off"), "rank", "_row")).alias("m")).select("mix_id", "source", F.col("m._row").alias("last_row"))
    every = every.join(small(staged(last, "mix-last")), ["mix_id", "source"], "left").withColumn("more", F.when(F.col("_row") == F.col("last_row"), 1).otherwise(F.col("more")))
    chosen = every.withColumn("copies", F.col("whole") + F.col("more")).filter("copies > 0")
    sample = staged(chosen.select("mix_id", "source", key, "n_tokens", "copies", "p", "rank"), "mix-sample")
    reached = sample.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("reached_tokens"), F.sum("copies").alias("documents_used"))
    in_mix = Window.partitionBy("mix_id")
    short = F.col("reached_tokens") < F.col("target_tokens")
    report = (
        plan.join(reached, ["mix_id", "source"], "left")
        .withColumn("reached_tokens", F.coalesce("reached_tokens", F.lit(0)))
        .withColumn("mix_tokens", F.sum("reached_tokens").over(in_mix))
        .select(
            "mix_id", "term", "source", "target_share", "target_tokens", "max_repeats", "available_tokens", "reached_tokens",
            F.coalesce("documents_used", F.lit(0)).alias("documents_used"),
            F.when(F.col("mix_tokens") > 0, F.col("reached_tokens") / F.greatest("mix_tokens", F.lit(1))).otherwise(0.0).alias("reached_share"),
            (short & (F.col("max_repeats") * F.col("available_tokens") < F.col("target_tokens"))).alias("unmet"),
        )
    )
    return sample, report
