"""Estimators: fit formulas to a DataFrame, choose one, and score other DataFrames with it.

``fit`` searches (:mod:`bandlens.search`); everything after it is a projection that Catalyst
compiles: predicting prunes columns and pushes filters like any other query.
"""

from __future__ import annotations

import html
import json
from dataclasses import asdict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandlens.expr.ast import Aggregation, FormulaSet, Limits, places
from bandlens.expr.compile_spark import with_formula
from bandlens.expr.text import show
from bandlens.functions import guards
from bandlens.operators import metrics, runlog
from bandlens.operators.prep import encode_labels, labelled, moments
from bandlens.search.generate import Space
from bandlens.search.islands import Formula, Settings
from bandlens.search.train import SAMPLE_ROWS, Search, decode, encode, pareto
from bandlens.search.vary import SET_WEIGHTS, TREE_WEIGHTS

_SPACE = ("operators", "constants", "use_constants", "use_variables", "stats", "window_stats", "halves", "lengths", "mean_share")
_LIMITS = ("weights", "children", "nested")
#: Parameters of variation besides the odds of the mutations, and their names there.
_VARIATION = {"set_crossover_method": "set_crossover", "set_crossover_probability": "set_crossover_probability", "perturbation_factor": "perturbation", "probability_negate_constant": "negate"}


def duration(seconds: float) -> str:
    """``1d:2h:3m:4s``; parts of 0 are left out."""
    s, out = int(seconds), []
    for unit, n in (("d", 86400), ("h", 3600), ("m", 60), ("s", 1)):
        if s // n:
            out.append(f"{s // n}{unit}")
        s %= n
    return ":".join(out) or "0s"


class Estimator:
    """What all estimators share. Parameters are those of Space, Limits and Settings, and:

    ``iterations``, ``max_complexity``, ``selection`` ('accuracy', 'score' or 'best'), ``stop`` (an error
    to reach, or a function of the search), ``callbacks`` with ``callback_every``, ``warm_start``,
    ``sample_rows``, ``seed``, ``digits`` (of shown constants), ``verbose`` (prints a line for each
    generation). The odds of the mutations go by their names (``add_node`` ...); ``set_crossover_method``,
    ``set_crossover_probability``, ``perturbation_factor`` and ``probability_negate_constant`` too. A loss of one's
    own is ``custom`` (with ``custom_greater``); it reaches the workers by value and is not saved with a model.

    The features are the bands of ``stats``. With ``window_stats`` rows are pixels: ``row`` and ``col`` name
    the columns of their places, ``by`` those that separate rasters; unlabelled pixels are neighbours.
    """

    metric, out_func = "mse", None

    def __init__(self, features: list[str] | None = None, *, iterations: int = 100, max_complexity: float = 21, selection: str = "accuracy", stop=None, callbacks: list | None = None, callback_every: int = 1, warm_start: bool = False, sample_rows: int = SAMPLE_ROWS, seed: int = 0, digits: int = 7, row: str = "row", col: str = "col", by: list[str] | None = None, verbose: bool = False, **params) -> None:
        self.features, self.iterations, self.max_complexity, self.selection = features, iterations, max_complexity, selection
        self.stop, self.callbacks, self.callback_every, self.warm_start = stop, callbacks, callback_every, warm_start
        self.sample_rows, self.seed, self.digits, self.verbose = sample_rows, seed, digits, verbose
        self.place = {"row": row, "col": col, "by": list(by or [])}
        params.setdefault("metric", self.metric)
        params.setdefault("out_func", self.out_func)
        settings = {k: params.pop(k) for k in list(params) if k in Settings.__dataclass_fields__}
        self.settings = Settings(**settings)
        metrics.metric(self.settings.metric)
        if self.settings.out_func not in (None, "identity", "softmax", "log_softmax", "zscore"):
            guards.operator(self.settings.out_func)
        self.space_params = {k: params.pop(k) for k in list(params) if k in _SPACE}
        self.limit_params = {k: params.pop(k) for k in list(params) if k in _LIMITS}
        self.variation = {k: params.pop(k) for k in list(params) if k in TREE_WEIGHTS or k in SET_WEIGHTS or k in _VARIATION}
        if self.variation.get("set_crossover_method", "multi_point") not in ("single_point", "two_point", "multi_point"):
            raise ValueError(f"unknown crossover {self.variation['set_crossover_method']!r}")
        if params:
            raise ValueError(f"unknown parameters {sorted(params)}")
        self.search: Search | None = None
        self.zscores: dict[str, list[tuple[float, float]]] = {}
        self.classes: list | None = None

    # ---- fitting ----

    def _check(self, df: DataFrame) -> None:
        missing = [c for c in self.features if c not in df.columns]
        if missing:
            raise ValueError(f"missing features {missing}")

    def fit(self, df: DataFrame, label: str, weight: str | None = None, features: list[str] | None = None) -> Estimator:
        """Search on the labelled rows of ``df``; null and NaN labels are left out."""
        self.features = features or self.features or [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint") and c not in (label, weight)]
        self._check(df)
        train = labelled(df, label)
        if not self.space_params.get("window_stats"):  # pixels without a label are neighbours of others
            train = train.filter(F.col(label).isNotNull())
        train, y = self._prepare(train, label)
        if not (self.warm_start and self.search):
            limits = Limits(self.max_complexity, **self.limit_params)
            self.search = Search(Space(self.features, max_complexity=self.max_complexity, limits=limits, seed=self.seed, **self.space_params), self.settings, self.seed, self._variation())
        raster = bool(self.space_params.get("window_stats"))
        self.search.run(train, self.features, y, weight, self.iterations, self.stop, [*(self.callbacks or []), *([self._progress] if self.verbose else [])], self.callback_every, self.sample_rows, **({"place": self.place} if raster else {}))
        if self.settings.out_func == "zscore":
            self._fit_zscores(train)
        return self

    def _variation(self) -> dict:
        """Arguments of Variation."""
        odds = lambda names: {**names, **{k: v for k, v in self.variation.items() if k in names}}
        return {"weights": odds(TREE_WEIGHTS), "set_weights": odds(SET_WEIGHTS), **{to: self.variation[k] for k, to in _VARIATION.items() if k in self.variation}}

    def _progress(self, search: Search) -> None:
        """A line of the progress table: generation, seconds, best error, size of the archive, best formula."""
        h = search.history[-1]
        if len(search.history) == 1:
            print(f"{'generation':>10} {'seconds':>9} {'best error':>12} {'archive':>7}  formula")
        print(f"{h['generation']:>10} {h['seconds']:>9.1f} {h['best_error']:>12.6g} {h['archive']:>7}  {show(self.best(), self.digits) if search.archive else ''}")

    def _with_value(self, df: DataFrame, f: Formula, out: str, **place) -> DataFrame:
        """The formula's value; without an array of bands for its aggregations, the features are the bands."""
        trees = f.formulas if isinstance(f, FormulaSet) else (f,)
        if place.get("array") is None and any(isinstance(n, Aggregation) for t in trees for _, n in places(t)):
            d = df.withColumn("_bands", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in self.features]))
            return with_formula(d, f, out, **{**self.place, **place, "array": "_bands"}).drop("_bands")
        return with_formula(df, f, out, **{**self.place, **place})

    def _prepare(self, train: DataFrame, label: str) -> tuple[DataFrame, str]:
        return train, label

    def _fit_zscores(self, train: DataFrame) -> None:
        for f, _ in self.search.archive.values():
            n = f.order if isinstance(f, FormulaSet) else 1
            v = self._with_value(train, f, "_v")
            v = v.select(*[(F.get("_v", F.lit(i)) if isinstance(f, FormulaSet) else F.col("_v")).alias(f"v{i}") for i in range(n)])
            got = moments(v, v.columns)
            self.zscores[encode(f)] = [got[c] for c in v.columns]

    # ---- the archive ----

    def entries(self, include_dominated: bool = False) -> list[dict]:
        """Rows of the archive: order, complexity, expression, score, error, is_pareto, by order and complexity."""
        if self.search is None:
            raise ValueError("not fitted")
        greater, a = self.settings.greater, self.search.archive
        front = pareto(a)
        out, last = [], {}
        for k in sorted(a):
            if not include_dominated and k not in front:
                continue
            f, cost = a[k]
            error, score = (-cost if greater else cost), 0.0
            if k[0] in last:
                e, c = last[k[0]]
                if k[1] > c and (error > e if greater else error < e):
                    if greater:
                        score = np.log(error / e) / (k[1] - c) if e > 0 else np.inf
                    else:
                        score = -np.log(error / e) / (k[1] - c) if error > 0 else np.inf
            last[k[0]] = (error, k[1])
            out.append({"order": int(k[0]), "complexity": float(k[1]), "expression": show(f), "score": float(score), "error": float(error), "is_pareto": k in front, "json": encode(f)})
        return out

    def archive(self, spark: SparkSession, include_dominated: bool = False) -> DataFrame:
        schema = T.StructType([T.StructField("order", T.IntegerType()), T.StructField("complexity", T.DoubleType()), T.StructField("expression", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("error", T.DoubleType()), T.StructField("is_pareto", T.BooleanType()), T.StructField("json", T.StringType())])
        return spark.createDataFrame([tuple(e.values()) for e in self.entries(include_dominated)], schema)

    def best(self, index: int | None = None, include_dominated: bool = False) -> Formula:
        """The chosen formula, or the ``index``-th of the archive's rows."""
        e = self.entries(include_dominated)
        if not e:
            raise ValueError("the archive is empty")
        if index is not None:
            return decode(e[index]["json"])
        sign = -1 if self.settings.greater else 1
        if self.selection == "accuracy":
            key = lambda r: (sign * r["error"], r["complexity"])
        elif self.selection == "score":
            key = lambda r: (-r["score"], r["complexity"])
        elif self.selection == "best":
            top = min(sign * r["error"] for r in e)
            e = [r for r in e if (sign * r["error"] <= top * 1.5 if sign * top >= 0 else sign * r["error"] <= top / 1.5)]
            key = lambda r: (-r["score"], r["complexity"])
        else:
            raise ValueError(f"unknown model selection {self.selection!r}")
        return decode(min(e, key=key)["json"])

    # ---- scoring ----

    def scored(self, df: DataFrame, out: str, index: int | None = None, **place) -> DataFrame:
        """``df`` with the chosen formula's value after the output function: a double, or an array for a set."""
        self._check(df)
        f = self.best(index)
        df = self._with_value(df, f, out, **place)
        return df.withColumn(out, self._out(F.col(out), f))

    def _out(self, v: Column, f: Formula) -> Column:
        name, many = self.settings.out_func, isinstance(f, FormulaSet)
        if name in (None, "identity"):
            return v
        if name in ("softmax", "log_softmax"):
            s = guards.softmax(v if many else F.array(v))
            return F.transform(s, F.ln) if name == "log_softmax" else s
        if name == "zscore":
            ms = self.zscores.get(encode(f), [(0.0, 1.0)])
            z = lambda x, m, s: F.lit(0.0) if s <= 1e-6 else F.greatest(F.least((x - m) / s, F.lit(1e3)), F.lit(-1e3)).cast("float").cast("double")
            return F.array(*[z(F.get(v, F.lit(i)), m, s) for i, (m, s) in enumerate(ms)]) if many else z(v, *ms[0])
        return F.transform(v, lambda x: guards.apply(name, x)) if many else guards.apply(name, v)

    # ---- log ----

    def log(self, spark: SparkSession) -> DataFrame:
        """The operation log (with ``logging``), fields as in the log's schema, and the island."""
        schema = T.StructType([*runlog.FIELDS.fields, T.StructField("island", T.IntegerType())])
        return spark.createDataFrame([tuple(e.get(f.name) for f in schema) for e in (self.search.log if self.search else [])], schema)

    def history(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(h.values()) for h in self.search.history], "generation int, best_error double, archive int, seconds double")

    # ---- text ----

    def __repr__(self) -> str:
        if self.search is None:
            return f"{type(self).__name__}(not fitted)"
        rows = [f"  {e['complexity']:>6g} {e['error']:>12.6g} {e['score']:>10.4g}  {show(decode(e['json']), self.digits)}" for e in self.entries()]
        return "\n".join([f"{type(self).__name__}(", "  complexity error score expression", *rows, ")"])

    def _repr_html_(self) -> str:
        if self.search is None:
            return html.escape(repr(self))
        cells = "".join(f"<tr><td>{e['complexity']:g}</td><td>{e['error']:.6g}</td><td>{e['score']:.4g}</td><td><code>{html.escape(show(decode(e['json']), self.digits))}</code></td></tr>" for e in self.entries())
        return f"<table><tr><th>complexity</th><th>error</th><th>score</th><th>expression</th></tr>{cells}</table>"

    # ---- saving ----

    def save(self, spark: SparkSession, path: str, keep_populations: bool = False, keep_log: bool = False) -> None:
        """``archive`` (Parquet), ``params`` (JSON) and, if kept, ``states`` and ``log``; no pickles."""
        self.archive(spark, True).write.mode("overwrite").parquet(f"{path}/archive")
        params = {"kind": type(self).__name__, "features": self.features, "classes": self.classes, "iterations": self.iterations, "max_complexity": self.max_complexity, "selection": self.selection, "seed": self.seed, "digits": self.digits, "settings": {k: v for k, v in asdict(self.settings).items() if k not in ("custom", "custom_greater")}, "space": self.space_params, "limits": self.limit_params, "variation": self.variation, "place": self.place, "zscores": self.zscores}
        spark.createDataFrame([(json.dumps(params),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/params")
        if keep_populations:
            spark.createDataFrame([(i, json.dumps(s), json.dumps(c)) for i, (s, c) in enumerate(zip(self.search.states, self.search.pools, strict=True))], "island int, state string, constants string").write.mode("overwrite").parquet(f"{path}/states")
        if keep_log:
            self.log(spark).write.mode("overwrite").parquet(f"{path}/log")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Estimator:
        """What :meth:`save` wrote; fit again with ``warm_start`` continues from kept populations."""
        p = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/params").collect()))
        settings = p["settings"]
        if isinstance(settings.get("order"), list):
            settings["order"] = tuple(settings["order"])
        e = KINDS[p["kind"]](p["features"], iterations=p["iterations"], max_complexity=p["max_complexity"], selection=p["selection"], seed=p["seed"], digits=p["digits"], **settings, **{k: tuple(v) if k == "lengths" and isinstance(v, list) else v for k, v in p["space"].items()}, **p["limits"], **p["variation"], **p["place"])
        e.classes, e.zscores = p["classes"], {k: [tuple(m) for m in v] for k, v in p["zscores"].items()}
        e._restore([(r["json"], r["order"], r["complexity"], r["error"]) for r in spark.read.parquet(f"{path}/archive").collect()])
        try:
            kept = spark.read.parquet(f"{path}/states").orderBy("island").collect()
            e.search.states, e.search.pools = [json.loads(r["state"]) for r in kept], [json.loads(r["constants"]) for r in kept]
            e.warm_start = True
        except Exception as missing:  # noqa: BLE001 - a path that does not exist
            if "PATH_NOT_FOUND" not in str(missing):
                raise
        return e

    def _restore(self, rows: list[tuple[str, int, float, float]]) -> None:
        self.search = Search(Space(self.features, max_complexity=self.max_complexity, limits=Limits(self.max_complexity, **self.limit_params), seed=self.seed, **self.space_params), self.settings, self.seed, self._variation())
        self.search.archive = {(o, c): (decode(t), -e if self.settings.greater else e) for t, o, c, e in rows}

    def from_csv(self, spark: SparkSession, path: str, expression: str = "expression", error: str = "error") -> Estimator:
        """The archive rebuilt from a CSV of expressions and errors over this estimator's features."""
        from bandlens.sources.formulas import load_formulas

        rows = []
        for f, e in load_formulas(spark, path, self.features, expression, error):
            if f is None:
                continue
            limits = Limits(self.max_complexity, **self.limit_params)
            rows.append((encode(f), f.order if isinstance(f, FormulaSet) else 1, f.complexity(limits) if isinstance(f, FormulaSet) else limits.complexity(f), e))
        self._restore(rows)
        return self


class FormulaRegressor(Estimator):
    """Predicts a number; ``mse`` by default."""

    def predict(self, df: DataFrame, out: str = "prediction", **place) -> DataFrame:
        return self.scored(df, out, **place)

    def score(self, df: DataFrame, label: str) -> float:
        """R squared over labelled rows."""
        d = labelled(self.predict(df, "_p"), label).filter(F.col(label).isNotNull())
        return d.agg(metrics.r_squared(F.col(label).cast("double"), F.col("_p")).alias("r")).first()["r"]


class FormulaTransformer(Estimator):
    """Adds the chosen formula as a column; ``pearson`` by default."""

    metric = "pearson"

    def transform(self, df: DataFrame, out: str = "feature", **place) -> DataFrame:
        return self.scored(df, out, **place)


class FormulaClassifier(Estimator):
    """Predicts a class; ``cross_entropy`` with softmax by default.

    Two classes with sigmoid (or hinge and a single order) use one formula, else one for each class;
    more than two classes use softmax, unless the loss is hinge.
    """

    metric, out_func = "cross_entropy", "softmax"

    def _variation(self) -> dict:
        """Arguments of Variation."""
        odds = lambda names: {**names, **{k: v for k, v in self.variation.items() if k in names}}
        return {"weights": odds(TREE_WEIGHTS), "set_weights": odds(SET_WEIGHTS), **{to: self.variation[k] for k, to in _VARIATION.items() if k in self.variation}}

    def _progress(self, search: Search) -> None:
        """A line of the progress table: generation, seconds, best error, size of the archive, best formula."""
        h = search.history[-1]
        if len(search.history) == 1:
            print(f"{'generation':>10} {'seconds':>9} {'best error':>12} {'archive':>7}  formula")
        print(f"{h['generation']:>10} {h['seconds']:>9.1f} {h['best_error']:>12.6g} {h['archive']:>7}  {show(self.best(), self.digits) if search.archive else ''}")

    def _with_value(self, df: DataFrame, f: Formula, out: str, **place) -> DataFrame:
        """The formula's value; without an array of bands for its aggregations, the features are the bands."""
        trees = f.formulas if isinstance(f, FormulaSet) else (f,)
        if place.get("array") is None and any(isinstance(n, Aggregation) for t in trees for _, n in places(t)):
            d = df.withColumn("_bands", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in self.features]))
            return with_formula(d, f, out, **{**self.place, **place, "array": "_bands"}).drop("_bands")
        return with_formula(df, f, out, **{**self.place, **place})

    def _prepare(self, train: DataFrame, label: str) -> tuple[DataFrame, str]:
        train, table = encode_labels(train, label, "_class")
        self.classes = [r[label] for r in table.orderBy("_class").collect()]
        k = len(self.classes)
        if k < 2:
            raise ValueError("a classifier needs two classes")
        s = self.settings
        if s.metric == "hinge_loss":
            s.out_func = None
        elif k > 2 and s.out_func not in ("softmax", "log_softmax"):
            s.out_func = "softmax"
        if s.metric == "nll_loss" and s.out_func == "softmax":
            s.out_func = "log_softmax"
        s.order = None if k == 2 and s.out_func in ("sigmoid", None) else k
        return train, "_class"

    def _class(self, index: Column) -> Column:
        return F.get(F.array(*[F.lit(c) for c in self.classes]), index)

    def predict(self, df: DataFrame, out: str = "prediction", **place) -> DataFrame:
        """``df`` with the class; null where a feature is missing. One score is class 1 above 0 (hinge) or 0.5."""
        d = self.scored(df, "_s", **place)
        if isinstance(self.best(), FormulaSet):
            index, bad = guards.argmax(F.col("_s")), F.exists("_s", lambda v: F.isnan(v))
        else:
            index, bad = F.when(F.col("_s") > (0.0 if self.settings.metric == "hinge_loss" else 0.5), 1).otherwise(0), F.isnan("_s")
        missing = F.lit(False)
        for c in self.features:
            missing |= F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
        return d.withColumn(out, F.when(~missing & ~bad, self._class(index))).drop("_s")

    def predict_proba(self, df: DataFrame, out: str = "probability", **place) -> DataFrame:
        """``df`` with an array of the classes' probabilities: the output itself for softmax and sigmoid, expit or softmax of raw scores."""
        d = self.scored(df, "_s", **place)
        s, name = F.col("_s"), self.settings.out_func
        if isinstance(self.best(), FormulaSet):
            p = s if name == "softmax" else F.transform(s, F.exp) if name == "log_softmax" else guards.softmax(s)
        else:
            one = s if name == "sigmoid" else guards.expit(s)
            p = F.array(1 - one, one)
        return d.withColumn(out, p).drop("_s")

    def score(self, df: DataFrame, label: str, weight: str | None = None) -> float:
        """Accuracy over labelled rows."""
        d = labelled(self.predict(df, "_p"), label).filter(F.col(label).isNotNull())
        right = F.when(F.col("_p") == F.col(label), 1.0).otherwise(0.0)
        return d.agg(metrics.weighted_mean(right, F.col(weight) if weight else None).alias("r")).first()["r"]

    def report(self, df: DataFrame, label: str) -> DataFrame:
        """Precision, recall and F1 of each class."""
        return metrics.confusion(labelled(self.predict(df, "_p"), label).filter(F.col(label).isNotNull()), label, "_p")


KINDS = {c.__name__: c for c in (FormulaRegressor, FormulaClassifier, FormulaTransformer)}
