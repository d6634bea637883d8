"""The search over islands as Spark jobs.

State is a small table: one row for each island, its formulas as JSON. A generation is one job: every
island evolves in its own task over a bounded training sample (broadcast once), so parallelism is
over islands. Candidates for the archive are then evaluated over *all* training rows: one
``mapInPandas`` pass gives partial sums for all candidates at once, and a small aggregate finishes
them; metrics that are no mean over rows are computed from a scored table. Migration and the archive
are handled by the driver; both are tiny.

On rasters the islands' sample holds the pixels around each of its rows, so that windows have the
values they have on the whole raster; for the archive, the windows of all candidates are columns that
two shuffles compute together.
"""

from __future__ import annotations

import ctypes
import json
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandlens.expr.ast import Aggregation, FormulaSet, Variable, places, rebuild
from bandlens.expr.compile_numpy import Memo, compiled
from bandlens.expr.compile_spark import with_windows
from bandlens.expr.simplify import simplify
from bandlens.expr.text import from_json, to_json
from bandlens.operators.metrics import METRICS
from bandlens.operators.prep import poisson
from bandlens.plans.ship import ship
from bandlens.plans.stages import discard, staged
from bandlens.search.generate import Space
from bandlens.search.islands import Formula, Island, Judge, QuickEntropy, Settings, out, with_penalty
from bandlens.search.losses import LOSSES
from bandlens.search.vary import Variation

#: Training rows that islands search on; the archive is judged on all rows.
SAMPLE_ROWS = 20_000
#: Numbers (rows x neighbours x bands) that a sample of pixels with their surroundings may have; it has fewer rows where they would be more.
PATCH_NUMBERS = 40_000_000
#: Formulas of each complexity (the best ones of the islands on the sample) that compete on all rows in a generation.
CANDIDATES = 5
#: Losses that are a weighted mean over rows, so that sums of partitions add up.
SUMMABLE = ("mae", "mse", "rmse", "cross_entropy", "nll_loss", "focal_loss", "hinge_loss", "accuracy", "pearson")


def encode(f: Formula) -> str:
    return json.dumps([None if s is None else json.loads(to_json(s)) for s in f.slots]) if isinstance(f, FormulaSet) else to_json(f)


def decode(text: str) -> Formula:
    x = json.loads(text)
    return FormulaSet(tuple(None if s is None else from_json(json.dumps(s)) for s in x)) if isinstance(x, list) else from_json(text)


def training_sample(df: DataFrame, features: list[str], y: str, weight: str | None, rows: int = SAMPLE_ROWS, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """At most ``rows`` labelled rows without missing features: the first by a hash of their values."""
    d = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(y).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    ok = F.col("y").isNotNull() & ~F.isnan("y") & F.col("w").isNotNull()
    for i in range(len(features)):
        ok &= F.col(f"x{i}").isNotNull() & ~F.isnan(f"x{i}")
    p = d.filter(ok).orderBy(F.xxhash64(*d.columns, F.lit(seed)), *d.columns).limit(rows).toPandas()
    x = p[[f"x{i}" for i in range(len(features))]].to_numpy(float)
    return x, p["y"].to_numpy(float), p["w"].to_numpy(float) if weight else None


def training_patches(df: DataFrame, features: list[str], y: str, weight: str | None, rows: int, seed: int, half: int, row: str, col: str, by: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """(features, labels, weights, patches) of at most ``rows`` labelled pixels; a patch (2 half + 1 square) has NaN where there is no pixel.

    ``df`` has all pixels, unlabelled ones too: they are neighbours. One join gives the neighbours of the chosen pixels.
    """
    d, side = len(features), 2 * half + 1
    rows = max(1, min(rows, PATCH_NUMBERS // (side * side * d)))
    place = [*by, row, col]
    pixels = df.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(place)], *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(y).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    ok = F.col("y").isNotNull() & ~F.isnan("y") & F.col("w").isNotNull()
    for i in range(d):
        ok &= F.col(f"x{i}").isNotNull() & ~F.isnan(f"x{i}")
    p = pixels.filter(ok).orderBy(F.xxhash64(*pixels.columns, F.lit(seed)), *pixels.columns).limit(rows).toPandas()
    at = [f"_p{i}" for i in range(len(place))]
    patches = np.full((len(p), side, side, d), np.nan)
    if len(p):
        types = dict(pixels.dtypes)
        chosen = df.sparkSession.createDataFrame(p[at].assign(_i=np.arange(len(p))), ", ".join(f"{c} {types[c]}" for c in at) + ", _i long")
        reach = F.sequence(F.lit(-half), F.lit(half))
        around = chosen.withColumn("_dr", F.explode(reach)).withColumn("_dc", F.explode(reach)).withColumns({at[-2]: F.col(at[-2]) + F.col("_dr"), at[-1]: F.col(at[-1]) + F.col("_dc")})
        near = pixels.join(around, at).select("_i", "_dr", "_dc", *[f"x{i}" for i in range(d)]).toPandas()  # at most PATCH_NUMBERS numbers
        patches[near["_i"], near["_dr"] + half, near["_dc"] + half] = near[[f"x{i}" for i in range(d)]].to_numpy(float)
    x = p[[f"x{i}" for i in range(d)]].to_numpy(float)
    return x, p["y"].to_numpy(float), p["w"].to_numpy(float) if weight else None, patches


def windowed(df: DataFrame, formulas: list[Formula], features: list[str], row: str, col: str, by: list[str]) -> tuple[DataFrame, list[Formula], list[str]]:
    """``df`` with a column for each window in the formulas, the formulas with variables in their place, and all features."""
    found: dict[Aggregation, str] = {}
    for f in formulas:
        for t in f.formulas if isinstance(f, FormulaSet) else (f,):
            for _, n in places(t):
                if isinstance(n, Aggregation) and n.spatial is not None:
                    found.setdefault(n, f"_window{len(found)}")
    if not found:
        return df, formulas, features
    df = df.withColumn("_bands", F.array(*[F.col(c).cast("double") for c in features]))
    df = with_windows(df, found, "_bands", row, col, by).drop("_bands")
    at = {n: Variable(len(features) + i, name) for i, (n, name) in enumerate(found.items())}
    put = lambda t: None if t is None else rebuild(t, lambda n: at.get(n, n))
    changed = [FormulaSet(tuple(put(t) for t in f.slots)) if isinstance(f, FormulaSet) else put(f) for f in formulas]
    return df, changed, [*features, *found.values()]


def _columns(df: DataFrame, features: list[str], y: str, weight: str | None, formulas: int) -> DataFrame:
    """The columns that formulas are judged on."""
    d = df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)], F.col(y).cast("double").alias("_y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"))
    # Work is candidates x rows, all of it CPU: the few splits of a small input must not leave cores idle.
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = not getattr(df, "_spread", False) and formulas >= 16 and int(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * 32 * 2**20
    return d.repartition(cores) if few else d


def _spread(df: DataFrame, features: list[str], y: str, weight: str | None) -> DataFrame:
    """The columns of the labelled rows that formulas are judged on, staged once for all generations; a small table in a file for each core."""
    names = list(dict.fromkeys([*features, y, *([weight] if weight else [])]))
    d = df.select(*names)
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * 32 * 2**20:
        d = d.repartition(cores)
    d = staged(d, "judged")
    d._spread = True
    return d


def _complete(b: pd.DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, label and weight of the rows that lack none."""
    x, t, w = b.iloc[:, :n].to_numpy(float), b["_y"].to_numpy(float), b["_w"].to_numpy(float)
    ok = ~(np.isnan(x).any(1) | np.isnan(t) | np.isnan(w))
    return np.asfortranarray(x[ok]), t[ok], w[ok]


def output_moments(df: DataFrame, formulas: list[Formula], features: list[str], y: str, weight: str | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and deviation of each formula's values (of each slot of a set) over all labelled rows: a pass for the means, one for the deviations."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast([encode(f) for f in formulas])
    widths = [len(f.formulas) if isinstance(f, FormulaSet) else 1 for f in formulas]
    d = _columns(df, features, y, weight, len(formulas))

    def summed(power: int, centres: list[np.ndarray]) -> list[np.ndarray]:
        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            candidates, n = [compiled(decode(t)) for t in sent.value], 0
            total = [np.zeros(k) for k in widths]
            for b in batches:
                x, t, _ = _complete(b, len(features))
                n += len(t)
                for i, f in enumerate(candidates if len(t) else []):
                    with np.errstate(all="ignore"):
                        total[i] += ((f(x).reshape(len(x), -1) - centres[i]) ** power).sum(0)
            yield pd.DataFrame([(i, j, v, n) for i, x in enumerate(total) for j, v in enumerate(x)], columns=["i", "j", "s", "n"])

        got = [np.zeros(k) for k in widths]
        for r in d.mapInPandas(sums, "i int, j int, s double, n long").groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
            got[r["i"]][r["j"]] = r["s"] / r["n"] if r["n"] else 0.0
        return got

    means = summed(1, [np.zeros(k) for k in widths])
    flat = lambda v, f: v if isinstance(f, FormulaSet) else v[0]
    return [(flat(m, f), flat(np.sqrt(v), f)) for m, v, f in zip(means, summed(2, means), formulas, strict=True)]


def evaluate_tables(df: DataFrame, formulas: list[Formula], features: list[str], y: str, weight: str | None, metric: str, out_func: str | None = None) -> list[float]:
    """The metric of each formula over all labelled rows where it is no mean over rows: one scored pass, then the exact DataFrame metric of each column."""
    if not formulas:
        return []
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast([encode(f) for f in formulas])
    given = output_moments(df, formulas, features, y, weight) if out_func == "zscore" else [None] * len(formulas)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        candidates = [compiled(decode(t)) for t in sent.value]
        for b in batches:
            x, t, w = _complete(b, len(features))
            with np.errstate(all="ignore"):
                yield pd.DataFrame({"_y": t, "_w": w} | {f"_p{i}": out(f(x), out_func, given[i]).ravel() for i, f in enumerate(candidates)})

    schema = ", ".join(f"{c} double" for c in ("_y", "_w", *[f"_p{i}" for i in range(len(formulas))]))
    scored = staged(_columns(df, features, y, weight, len(formulas)).mapInPandas(score, schema), "scored")
    result = []
    for i in range(len(formulas)):
        d = scored.select("_y", F.col(f"_p{i}").alias("_p"), "_w")
        r = (METRICS[metric].function(d, "_y", "_p", "_w") if metric == "spearman" else METRICS[metric].function(d, "_y", "_p")).first()[0]
        result.append(np.nan if r is None else float(r))
    discard(scored)
    return result


def _centred(w: np.ndarray, p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Sum of weights, means, and sums of weighted products of the deviations from them."""
    n = w.sum()
    if n == 0:
        return np.zeros(6)
    mp, mt = (w * p).sum() / n, (w * t).sum() / n
    return np.array([n, mp, mt, (w * (p - mp) * (t - mt)).sum(), (w * (p - mp) ** 2).sum(), (w * (t - mt) ** 2).sum()])


def _together(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of two parts (see :func:`_centred`) as those of both."""
    n = a[0] + b[0]
    if n == 0 or b[0] == 0:
        return a
    dp, dt, k = b[1] - a[1], b[2] - a[2], a[0] * b[0] / n
    return np.array([n, a[1] + dp * b[0] / n, a[2] + dt * b[0] / n, a[3] + b[3] + k * dp * dt, a[4] + b[4] + k * dp * dp, a[5] + b[5] + k * dt * dt])


def evaluate_batch(df: DataFrame, formulas: list[Formula], features: list[str], y: str, weight: str | None, metric: str, out_func: str | None = None, params: dict | None = None) -> list[float]:
    """The metric of each formula over all labelled rows, in one pass. Only for metrics in SUMMABLE (ValueError otherwise).

    A partition sends six sums for each formula, whatever its rows; for a correlation these are means
    and centred moments, which merge without losing digits. Rows with a missing feature, label or
    weight are left out.
    """
    if metric not in SUMMABLE:
        raise ValueError(f"{metric} is no mean over rows")
    if not formulas:
        return []
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast([encode(f) for f in formulas])
    loss = LOSSES["mse" if metric == "rmse" else metric]
    kw = params or {}
    given = output_moments(df, formulas, features, y, weight) if out_func == "zscore" else [None] * len(formulas)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        candidates = [decode(t) for t in sent.value]
        total = np.zeros((len(candidates), 6))
        for b in batches:
            x, t, w = _complete(b, len(features))
            if not len(t):
                continue
            values = Memo(x)  # candidates have much in common
            quick = QuickEntropy(t, w, values.most) if metric == "cross_entropy" and out_func == "softmax" else None
            for i, f in enumerate(candidates):
                with np.errstate(all="ignore"):
                    if quick is not None and isinstance(f, FormulaSet) and len(f.formulas) > 1:
                        value = quick([values.value(g) for g in f.formulas])
                        if value is not None:
                            total[i, :2] += [w.sum(), w.sum() * value]
                            continue
                    p = out(values(f), out_func, given[i])
                    if metric == "pearson":
                        total[i] = _together(total[i], _centred(w, p, t))
                    else:
                        total[i, :2] += [w.sum(), w.sum() * loss(t, p, w, **kw)]
        yield pd.DataFrame(total, columns=list("abcdef")).assign(i=np.arange(len(candidates)))

    d = _columns(df, features, y, weight, len(formulas))
    parts = d.mapInPandas(sums, ", ".join(f"{c} double" for c in "abcdef") + ", i int")
    result = [0.0] * len(formulas)
    if metric == "pearson":
        c = {x: F.col(x) for x in "abcdef"}
        n = parts.groupBy("i").agg(F.sum("a").alias("n"), F.try_divide(F.sum(c["a"] * c["b"]), F.sum("a")).alias("mp"), F.try_divide(F.sum(c["a"] * c["c"]), F.sum("a")).alias("mt"))
        parts = parts.join(F.broadcast(n), "i")  # one row for each formula
        dp, dt = c["b"] - F.col("mp"), c["c"] - F.col("mt")
        rows = parts.groupBy("i").agg(F.sum(c["d"] + c["a"] * dp * dt).alias("d"), F.sum(c["e"] + c["a"] * dp * dp).alias("e"), F.sum(c["f"] + c["a"] * dt * dt).alias("f")).collect()
    else:
        rows = parts.groupBy("i").agg(*[F.sum(x).alias(x) for x in "ab"]).collect()
    for r in rows:
        if metric == "pearson":
            r2 = (r["d"] or 0.0) / np.sqrt(r["e"] * r["f"]) if r["e"] and r["f"] and r["e"] > 0 and r["f"] > 0 else 0.0
            result[r["i"]] = float(abs(r2)) if np.isfinite(r2) else 0.0
        else:
            n = r["a"]
            v = r["b"] / n if n else 0.0
            result[r["i"]] = float(np.sqrt(v)) if metric == "rmse" else v
    return result


def pareto(entries: dict[tuple, tuple[Formula, float]]) -> set[tuple]:
    """Keys (order, complexity) of entries that no entry of at most that order and complexity matches or beats."""
    keys = []
    for k, (_, cost) in entries.items():
        if not any(j != k and j[0] <= k[0] and j[1] <= k[1] and c <= cost for j, (_, c) in entries.items()):
            keys.append(k)
    return set(keys)


def _hold_memory() -> None:
    """Freed arrays stay with the process (glibc): an island makes and drops thousands of arrays of one size, each else new pages of the system."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
        mallopt(-3, 2**26)  # M_MMAP_THRESHOLD
        mallopt(-1, 2**28)  # M_TRIM_THRESHOLD
    except (AttributeError, OSError):
        pass


def _evolver(space: Space, settings: Settings, variation: dict, sent, states, seed: int, generation: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A generation of the islands whose numbers a task is given. ``states``: formulas and pool of constants of each."""

    def evolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _hold_memory()
        for b in batches:
            for i in b["id"].tolist():
                formulas, pool = states.value[i]
                own = space.with_constants(list(pool or space.constants))
                x, t, w, patches = sent.value
                island = Island(own, settings, Judge(x, t, w, settings, patches), np.random.default_rng([seed, generation, i]), Variation(own, **variation))
                island.start([decode(s) for s in formulas])
                island.evolve(generation, 1.0)
                best = [(list(k), encode(m.formula), m.cost) for k, m in island.best.items()]
                members = [(encode(m.formula), m.cost) for m in sorted(island.members, key=lambda m: m.birth)]
                yield pd.DataFrame([{"island": i, "members": json.dumps(members), "best": json.dumps(best), "log": json.dumps(island.log), "constants": json.dumps(own.constants)}])

    return evolve


class Search:
    """A run of the search: its archive, states, log and history."""

    def __init__(self, space: Space, settings: Settings, seed: int = 0, variation: dict | None = None) -> None:
        self.space, self.s, self.seed, self.variation = space, settings, seed, variation or {}
        self.archive: dict[tuple, tuple[Formula, float]] = {}
        self.states: list[list[str]] = [[] for _ in range(settings.populations)]
        #: Each island's own pool of random constants (empty: that of the space).
        self.pools: list[list[float]] = [[] for _ in range(settings.populations)]
        self.log: list[dict] = []
        self.history: list[dict] = []
        self.generation = 0
        self.judged: set[str] = set()
        #: Whether the islands' sample has all rows, so that their errors are those of the data.
        self.whole = False
        #: Columns of the pixels' places (row, col, by), where formulas have windows.
        self.place: dict | None = None

    def run(self, df: DataFrame, features: list[str], y: str, weight: str | None = None, iterations: int = 100, stop: float | Callable | None = None, callbacks: list[Callable] | None = None, every: int = 1, sample_rows: int = SAMPLE_ROWS, place: dict | None = None) -> Search:
        """Evolve for ``iterations`` generations, or until the best error reaches ``stop`` (or ``stop(self)`` holds).

        ``place`` (``row``, ``col``, ``by``) is needed for windows; ``df`` then has all pixels, labelled or not.
        """
        spark = df.sparkSession
        ship(spark)
        if self.space.window_stats:
            if place is None:
                raise ValueError("windows need the places of the pixels")
            self.place = place
            x, t, w, patches = training_patches(df, features, y, weight, sample_rows, self.seed, max(self.space.halves), **place)
        else:
            (x, t, w), patches = training_sample(df, features, y, weight, sample_rows, self.seed), None
        if not len(t):
            raise ValueError("no labelled rows without missing features")
        self.whole = patches is None and len(t) < sample_rows
        sent = spark.sparkContext.broadcast((x, t, w, patches))  # bounded by sample_rows and PATCH_NUMBERS
        self.judged = set()
        judged = df if self.place is not None else _spread(df, features, y, weight)
        settings, began, n = self.s, time.time(), len(self.states)
        for _ in range(iterations):
            generation = self.generation
            states = spark.sparkContext.broadcast(list(zip(self.states, self.pools, strict=True)))  # bounded by the islands' sizes
            # One partition for each island: no shuffle, and a lost task is that island's generation again.
            evolve = _evolver(self.space, settings, self.variation, sent, states, self.seed, generation)
            done = sorted(spark.range(0, n, 1, n).mapInPandas(evolve, "island int, members string, best string, log string, constants string").collect(), key=lambda r: r["island"])
            states.unpersist()
            self.merge(judged, features, y, weight, [b for r in done for b in json.loads(r["best"])])
            self.pools = [json.loads(r["constants"]) for r in done]
            now = time.time() - began
            self.log += [{**e, "timestamp": now, "island": r["island"]} for r in done for e in json.loads(r["log"])]
            self.migrate([json.loads(r["members"]) for r in done])
            best = min((c for _, c in self.archive.values()), default=np.inf)
            self.history.append({"generation": generation, "best_error": -best if settings.greater else best, "archive": len(self.archive), "seconds": now})
            self.generation += 1
            for f in callbacks or []:
                if self.generation % every == 0:
                    f(self)
            if callable(stop):
                if stop(self):
                    break
            elif stop is not None and best <= (-stop if settings.greater else stop):
                break
        if judged is not df:  # the caller's own table stays
            discard(judged)
        return self

    def merge(self, df: DataFrame, features: list[str], y: str, weight: str | None, found: list) -> None:
        """The islands' best formulas that could improve the archive, judged over all rows.

        Only a loss of one's own, and a metric of one column on a set of several formulas, are judged on the sample.
        The sample only nominates: of each complexity, up to CANDIDATES different formulas compete.
        """
        costs: dict[tuple, dict[str, float]] = {}
        for _, text, cost in found:
            f = decode(text)
            simple = simplify(f) if self.s.should_simplify else f
            ok = simple.valid(self.space.limits) if isinstance(simple, FormulaSet) else self.space.limits.valid(simple)
            f = simple if ok else f
            order = f.order if isinstance(f, FormulaSet) else 1
            key = (order, f.complexity(self.space.limits) if isinstance(f, FormulaSet) else self.space.limits.complexity(f))
            same, text = costs.setdefault(key, {}), encode(f)
            same[text] = min(cost, same.get(text, np.inf))
        new = [(k, t, c) for k, same in costs.items() for t, c in sorted(same.items(), key=lambda x: x[1])[:CANDIDATES] if t not in self.judged]
        self.judged |= {t for _, t, _ in new}
        new = [(k, decode(t), c) for k, t, c in new]
        summable, formulas = self.s.metric in SUMMABLE, [f for _, f, _ in new]
        errors, own = None, formulas
        if self.place is not None:
            df, formulas, features = windowed(df, formulas, features, **self.place)
        if self.s.custom is None and summable:
            errors = evaluate_batch(df, formulas, features, y, weight, self.s.metric, self.s.out_func, self.s.metric_params)
        elif self.s.custom is None and not self.whole and not any(isinstance(f, FormulaSet) and len(f.formulas) > 1 for f in formulas):
            errors = evaluate_tables(df, formulas, features, y, weight, self.s.metric, self.s.out_func)
        if errors is not None:
            errors = [with_penalty(f, e, self.s) for f, e in zip(own, errors, strict=True)]
            new = [(k, f, -e if self.s.greater else e) for (k, f, _), e in zip(new, errors, strict=True)]
        for k, f, cost in new:
            cost = float(np.float32(cost))
            if np.isfinite(cost) and (k not in self.archive or cost < self.archive[k][1]):
                self.archive[k] = (f, cost)

    def migrate(self, members: list[list]) -> None:
        """Ring migration of the best to the next island, and of the archive's front to all; each replaces the oldest."""
        rng = np.random.default_rng([self.seed, self.generation, 10**6])
        n = len(members)
        front = [encode(self.archive[k][0]) for k in sorted(pareto(self.archive))]
        out_states = []
        for i, own in enumerate(members):
            state = [t for t, _ in own]
            arrivals: list[str] = []
            if self.s.migration and n > 1:
                q = min(poisson(self.s.fraction_replaced * len(state), rng), len(state))
                top = [t for t, _ in sorted(members[i - 1], key=lambda m: m[1])[: self.s.top_n]]
                arrivals += [top[int(rng.integers(len(top)))] for _ in range(q)]
            if self.s.hof_migration and front:
                q = min(poisson(self.s.fraction_replaced_hof * len(state), rng), len(state))
                arrivals += [front[int(rng.integers(len(front)))] for _ in range(q)]
            out_states.append([*state[len(arrivals) :], *arrivals][-len(state) :])
        self.states = out_states
