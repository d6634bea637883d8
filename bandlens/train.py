"""``spark-submit -m bandlens.train``: fit a classifier on a table and write its archive, report and run summary."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from bandlens.estimators import FormulaClassifier, duration
from bandlens.operators.metrics import confusion
from bandlens.operators.prep import spatial_split, split, standardise
from bandlens.sources.formulas import write_archive


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    data = p.add_argument_group("dataset")
    data.add_argument("--table", required=True)
    data.add_argument("--out", required=True)
    data.add_argument("--key", default="sample_id")
    data.add_argument("--label", default="label")
    data.add_argument("--features", nargs="+", required=True)
    data.add_argument("--train-size", type=float, default=100)
    space = p.add_argument_group("spatial", "a split by whole blocks of pixels, and windows")
    space.add_argument("--spatial", action="store_true", help="pixels: split by blocks instead of by rows")
    space.add_argument("--row", default="row")
    space.add_argument("--col", default="col")
    space.add_argument("--by", nargs="*", default=[], help="columns that separate rasters")
    space.add_argument("--block-size", type=int, default=10)
    space.add_argument("--buffer", type=int, default=3)
    space.add_argument("--neighbour-penalty", type=float, default=0.0)
    space.add_argument("--min-test", type=int, default=0)
    space.add_argument("--window-stats", nargs="*", default=[])
    space.add_argument("--halves", nargs="*", type=int, default=[1])
    engine = p.add_argument_group("engine")
    engine.add_argument("--iterations", type=int, default=100)
    engine.add_argument("--populations", type=int, default=31)
    engine.add_argument("--population-size", type=int, default=27)
    engine.add_argument("--cycles", type=int, default=380)
    engine.add_argument("--max-complexity", type=float, default=25)
    engine.add_argument("--operators", nargs="+", default=["add", "sub", "mul", "div"])
    tune = p.add_argument_group("optimisation")
    tune.add_argument("--optimiser", default="L-BFGS-B")
    tune.add_argument("--stats", nargs="*", default=[])
    system = p.add_argument_group("system")
    system.add_argument("--seed", type=int, default=0)
    system.add_argument("--save-every", type=int, default=0, help="generations after which the archive so far is written")
    system.add_argument("--verbose", action="store_true")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = arguments(argv)
    spark = spark or SparkSession.builder.appName("bandlens.train").getOrCreate()
    began = time.time()
    raster = bool(a.window_stats)
    place = [*a.by, a.row, a.col] if a.spatial or raster else []
    rows = spark.read.parquet(a.table).select(*dict.fromkeys([a.key, a.label, *place, *a.features]))
    if a.spatial:
        rows = spatial_split(rows, a.label, int(a.train_size), size=a.block_size, buffer=a.buffer, neighbour_penalty=a.neighbour_penalty, insufficient=True, min_test=a.min_test, seed=a.seed, row=a.row, col=a.col)
    else:
        rows = split(rows, a.key, a.label, a.train_size, insufficient="both", min_test=a.min_test, seed=a.seed)
    rows = standardise(rows, a.features, F.coalesce(F.col("split") == "train", F.lit(False)))
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")

    def save(search) -> None:
        write_archive(e.archive(spark, True), f"{a.out}/generation={search.generation}")

    windows = {"window_stats": a.window_stats, "halves": a.halves, "row": a.row, "col": a.col, "by": a.by} if raster else {}
    e = FormulaClassifier(a.features, iterations=a.iterations, populations=a.populations, population_size=a.population_size, cycles=a.cycles, max_complexity=a.max_complexity, operators=a.operators, optimiser=a.optimiser, stats=a.stats, seed=a.seed, verbose=a.verbose, callbacks=[save] if a.save_every else None, callback_every=max(1, a.save_every), **windows)
    # With windows all pixels are given, those that don't train without their labels: they are neighbours.
    e.fit(rows.withColumn(a.label, F.when(F.col("split") == "train", F.col(a.label))) if raster else train, a.label)
    if raster:
        # Windows need all pixels: classes are predicted on the raster, and sides are taken afterwards.
        scored = e.predict(rows, "_class_found")
        train, test = scored.filter("split = 'train'"), scored.filter("split = 'test'")
    write_archive(e.archive(spark, True), f"{a.out}/archive")
    e.save(spark, f"{a.out}/model")
    hit = lambda d: d.agg(F.avg((F.col("_class_found") == F.col(a.label)).cast("double"))).first()[0]
    accuracy = hit if raster else lambda d: e.score(d, a.label)
    report = confusion(test, a.label, "_class_found") if raster else e.report(test, a.label)
    result = {"train_accuracy": accuracy(train), "test_accuracy": accuracy(test), "time": duration(time.time() - began), "config": vars(a), "classes": [r.asDict() for r in report.collect()]}
    spark.createDataFrame([(json.dumps(result, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.out}/summary")
    return result


if __name__ == "__main__":
    print(json.dumps(main(), default=str))
