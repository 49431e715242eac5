"""Tree regressors on MLlib, the two ensembles MLlib lacks, and grid search on keyed folds."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.draws import uniform
from tabwright.operators import grove
from tabwright.operators.quality import report
from tabwright.operators.scaling import fit_minmax
from tabwright.operators.worth import average_rank
from tabwright.session import dealt, stage

# Fixed search grids: 72, 900, 27 and 6 points (a repeated fit of a bagging model is the same fit).
GRIDS: dict[str, dict[str, list]] = {
    "forest": {"numTrees": [10, 30, 50], "minInstancesPerNode": [1, 2, 4], "minRowsToSplit": [2, 5],
               "maxDepth": [5, 10, 20, 30]},
    "boosting": {"stepSize": [0.05, 0.1, 0.2], "maxIter": [10, 30, 50],
                 "minFractionToSplit": [0.1, 0.2, 0.3, 0.4, 0.5], "minWeightFractionPerNode": [0.1, 0.2, 0.3, 0.4, 0.5],
                 "maxDepth": [3, 5], "featureSubsetStrategy": ["log2", "sqrt"]},
    "adaboost": {"n_estimators": [10, 30, 50], "learning_rate": [0.05, 0.1, 0.2],
                 "loss": ["linear", "square", "exponential"]},
    "bagging": {"numTrees": [10, 30, 50], "bootstrap": [True, False]},
}
MAX_BINS = 64


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """Feature vectors of all rows; missing values become NaN, see ``complete``."""
    return VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="keep").transform(df)


def complete(features) -> F.Column:
    """Whether a row has every feature; rows that don't keep a NULL prediction."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in features])


def estimator(name: str, target: str, seed: int, weight: str | None = None, **params):
    common = {"featuresCol": "_v", "labelCol": target, "predictionCol": "prediction", "seed": seed,
              "maxBins": MAX_BINS}
    if weight:
        common["weightCol"] = weight
    if name == "tree":
        return DecisionTreeRegressor(**common, **{"maxDepth": 10, **params})
    if name == "forest":
        return RandomForestRegressor(**common, **{"numTrees": 10, "maxDepth": 10,
                                                  "featureSubsetStrategy": "all", **params})
    if name == "bagging":
        bootstrap = params.pop("bootstrap", True)
        return RandomForestRegressor(**common, **{"numTrees": 10, "maxDepth": 10, **params},
                                     featureSubsetStrategy="all").setBootstrap(bootstrap)
    if name == "boosting":
        return GBTRegressor(**common, **{"maxIter": 30, "stepSize": 0.1, "maxDepth": 3, **params})
    raise ValueError(f"unknown model {name!r}")


@dataclass(frozen=True)
class TreeModel:
    """An MLlib model that takes plain columns."""

    features: tuple[str, ...]
    model: object

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(assembled(df, list(self.features))).drop("_v").withColumn(
            "prediction", F.when(complete(self.features), F.col("prediction")))

    @property
    def importances(self) -> list[float]:
        return [float(x) for x in self.model.featureImportances.toArray()]


def _trainable(df: DataFrame, features: list[str], target: str, *more: str) -> DataFrame:
    cols = [*features, target, *more]
    return df.na.drop(subset=[*features, target]).select(*[F.col(c).cast("double").alias(c) for c in cols])


def fit_model(name: str, df: DataFrame, features: list[str], target: str, seed: int = 0,
              weight: str | None = None, **params):
    """Fit ``tree``, ``forest``, ``bagging``, ``boosting``, ``extra_trees`` or ``adaboost``."""
    if name == "extra_trees":
        return fit_extra_trees(df, features, target, seed, **params)
    if name == "adaboost":
        return fit_adaboost(df, features, target, seed, **params)
    rows = assembled(dealt(_trainable(df, features, target, *([weight] if weight else []))), features)
    return TreeModel(tuple(features), estimator(name, target, seed, weight, **params).fit(rows))


# --- extra trees ------------------------------------------------------------------------------------


def fit_extra_trees(df: DataFrame, features: list[str], target: str, seed: int = 0, n_trees: int = 10,
                    maxDepth: int = 10, minInstancesPerNode: int = 1) -> grove.GrownTrees:
    """All trees grow together; each node of each tree draws its cuts inside its own ranges."""
    rows = stage(_trainable(df, features, target).select(
        F.lit(0).cast("long").alias("key"), F.lit(0).alias("fold"), F.col(target).alias("y"), *features), "extra")
    mean = rows.agg(F.avg("y")).first()[0] or 0.0
    plans = [grove.Plan(i, -1, seed * 1009 + i, False, float(minInstancesPerNode), depth=maxDepth) for i in range(n_trees)]
    tops = grove.grow_random(rows, plans, len(features), mean)
    return grove.GrownTrees(tuple(features), None, mean, (1 / n_trees,) * n_trees, tuple(tops[p.tree] for p in plans))


# --- AdaBoost.R2 ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class AdaBoost:
    """Weighted median of trees fitted to reweighted rows."""

    features: tuple[str, ...]
    models: tuple
    weights: tuple[float, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        out = assembled(df, list(self.features))
        for i, m in enumerate(self.models):
            out = m.transform(out).withColumnRenamed("prediction", f"_a{i}")
        pairs = F.array_sort(F.array(*[F.struct(F.col(f"_a{i}").alias("p"), F.lit(w).alias("w"))
                                       for i, w in enumerate(self.weights)]))
        half = sum(self.weights) / 2.0
        median = F.aggregate(
            pairs, F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at")),
            lambda s, x: F.struct((s["sum"] + x["w"]).alias("sum"), F.coalesce(
                s["at"], F.when(s["sum"] + x["w"] >= half, x["p"])).alias("at")), lambda s: s["at"])
        return out.withColumn("prediction", median).drop("_v", *[f"_a{i}" for i in range(len(self.models))])


def fit_adaboost(df: DataFrame, features: list[str], target: str, seed: int = 0, n_estimators: int = 10,
                 learning_rate: float = 0.1, loss: str = "linear", max_depth: int = 3) -> AdaBoost:
    """Each round: one weighted tree, one aggregate of its errors, one weight update. The weight
    is a column; it is written out every few rounds so that the plan does not grow."""
    if loss not in ("linear", "square", "exponential"):
        raise ValueError(f"unknown loss {loss!r}")
    rows = stage(assembled(_trainable(df, features, target), features).select("_v", target).withColumn(
        "_w", F.lit(1.0)), "adaboost")
    models, weights = [], []
    for i in range(n_estimators):
        model = estimator("tree", target, seed + i, "_w", maxDepth=max_depth).fit(rows)
        e = F.abs(F.col(target) - F.col("prediction"))
        predicted = model.transform(rows)
        worst = predicted.agg(F.max(e)).first()[0]
        if not worst:
            models.append(model), weights.append(1.0)
            break
        share = e / worst
        share = {"linear": share, "square": share * share, "exponential": 1.0 - F.exp(-share)}[loss]
        error = predicted.agg(F.sum(F.col("_w") * share) / F.sum("_w")).first()[0]
        if error <= 0 or (error >= 0.5 and models):
            if error <= 0:
                models.append(model), weights.append(1.0)
            break
        beta = min(error, 1 - 1e-9) / (1.0 - min(error, 1 - 1e-9))
        models.append(model), weights.append(learning_rate * math.log(1.0 / beta))
        if error >= 0.5:
            break
        rows = predicted.select("_v", target, (F.col("_w") * F.pow(
            F.lit(beta), (1.0 - share) * learning_rate)).alias("_w"))
        if i % 5 == 4 and i + 1 < n_estimators:
            rows = stage(rows, "adaboost")
    if len(weights) == 1 or sum(weights) <= 0:
        weights = [1.0] * len(models)
    return AdaBoost(tuple(features), tuple(models), tuple(weights))


# --- importances, tuning, scores ----------------------------------------------------------------------------


def importance_rank(name: str, df: DataFrame, features: list[str], target: str, seed: int = 0, **params) -> DataFrame:
    """(feature, importance, rank) of a tree model on min-max scaled features."""
    scaled = fit_minmax(df, features).transform(df)
    model = fit_model(name, scaled, features, target, seed, **params)
    table = report(df.sparkSession, list(zip(features, model.importances)), "feature string, importance double")
    return average_rank(table, "importance", "rank")


def hashed_folds(df: DataFrame, key: str, folds: int, seed: int) -> DataFrame:
    return df.withColumn("_fold", F.least(F.floor(uniform(key, seed + 101) * folds), F.lit(folds - 1)).cast("int"))


def grid_errors(name: str, grid: dict[str, list], df: DataFrame, features: list[str], target: str, key: str, fold: str,
                folds: int, seed: int = 0) -> DataFrame | None:
    """Error of every grid point on every fold of a column with folds, all trees of the grid grown together (see ``grove``).

    None for models and parameters that are not grown that way.
    """
    if name == "extra_trees" and not grid:
        return grove.random_errors(df, features, target, fold, folds, seed=seed)
    node = {"maxDepth": [10], "minInstancesPerNode": [1], "minRowsToSplit": [2]}
    own = {"forest": {"numTrees": [10], **node}, "bagging": {"numTrees": [10], "bootstrap": [True], **node}, "tree": node,
           "boosting": {"maxIter": [30], "stepSize": [0.1], "maxDepth": [3], "minWeightFractionPerNode": [0.0],
                        "minFractionToSplit": [0.0], "featureSubsetStrategy": ["all"]}}.get(name)
    if own is None or set(grid) - set(own):
        return None
    own |= grid
    if name == "boosting":
        return grove.boosting_errors(df, features, target, key, fold, folds, own["maxIter"], own["stepSize"], own["maxDepth"],
                                     own["minWeightFractionPerNode"], own["minFractionToSplit"],
                                     own["featureSubsetStrategy"], seed)
    bags = {"forest": [True], "tree": [False]}.get(name) or own["bootstrap"]
    return grove.forest_errors(df, features, target, key, fold, folds, own.get("numTrees", [1]), own["maxDepth"],
                               own["minInstancesPerNode"], bags, own["minRowsToSplit"], seed)


def _fit_best(name: str, best: dict, df: DataFrame, features: list[str], target: str, key: str, seed: int):
    """The best point on all rows: by MLlib, or by ``grove`` where MLlib has no parameter for what binds a node."""
    split = best.pop("minRowsToSplit", 2)
    if split > 2 * best.get("minInstancesPerNode", 1):
        return grove.fit_forest(df, features, target, key, seed, minRowsToSplit=split, **best)
    split, share = best.pop("minFractionToSplit", 0.0), best.get("minWeightFractionPerNode", 0.0)
    if split > 2 * share or share >= 0.5:
        return grove.fit_boosting(df, features, target, key, seed, minFractionToSplit=split, **best)
    return fit_model(name, df, features, target, seed, **best)


def tune(name: str, grid: dict[str, list], df: DataFrame, features: list[str], target: str, key: str,
         folds: int = 5, seed: int = 0, parallelism: int = 4):
    """Exhaustive search for the lowest mean absolute error over keyed folds, refitted on all rows."""
    rows = stage(hashed_folds(df.na.drop(subset=[*features, target]).select(
        *dict.fromkeys([key, *features, target])), key, folds, seed), "folded")
    errors = grid_errors(name, grid, rows, features, target, key, "_fold", folds, seed)
    if errors is not None:
        best = grove.mean_errors(errors).first().asDict()
        return _fit_best(name, {k: best[k] for k in grid}, rows, features, target, key, seed)
    if name in ("adaboost", "extra_trees"):
        best, best_error = None, math.inf
        for values in product(*grid.values()):
            params = dict(zip(grid, values))
            error = float(np.mean([-s for *_, s in cross_val_rows(
                name, rows, features, target, "_fold", folds, "mae", seed, **params)]))
            if error < best_error:
                best, best_error = params, error
        return fit_model(name, rows, features, target, seed, **(best or {}))
    base = estimator(name, target, seed)
    builder = ParamGridBuilder()
    for p, values in grid.items():
        builder = builder.addGrid(base.getParam(p), values)
    ready = assembled(_trainable(rows, features, target, "_fold").withColumn(
        "_fold", F.col("_fold").cast("int")), features).select("_v", target, "_fold")
    cv = CrossValidator(estimator=base, estimatorParamMaps=builder.build(), foldCol="_fold", numFolds=folds,
                        parallelism=parallelism, evaluator=RegressionEvaluator(
                            metricName="mae", labelCol=target, predictionCol="prediction"))
    return TreeModel(tuple(features), cv.fit(ready).bestModel)


_SCORES = {
    "mse": lambda y, p: -F.avg((y - p) * (y - p)),
    "mae": lambda y, p: -F.avg(F.abs(y - p)),
    "explained_variance": lambda y, p: 1.0 - F.try_divide(F.var_pop(y - p), F.var_pop(y)),
}


def cross_val_rows(name: str, df: DataFrame, features: list[str], target: str, fold: str, folds: int,
                   scoring: str = "mse", seed: int = 0, **params) -> list[tuple]:
    """(model, fold, score) of a tree model on an existing fold column."""
    out = []
    score: Column = _SCORES[scoring](F.col(target), F.col("prediction"))
    for f in range(folds):
        model = fit_model(name, df.filter(F.col(fold) != f), features, target, seed, **params)
        out.append((name, f, model.transform(df.filter(F.col(fold) == f)).agg(score).first()[0]))
    return out


def cross_val_score(names: list[str], df: DataFrame, features: list[str], target: str, key: str, folds: int,
                    scoring: str = "mse", seed: int = 0) -> DataFrame:
    """(model, fold, score): models of one growth where they have one (``grid_errors``), the others fold by fold."""
    rows = stage(hashed_folds(df.na.drop(subset=[*features, target]).select(
        *dict.fromkeys([key, *features, target])), key, folds, seed), "cv")
    out = report(df.sparkSession, [], "model string, fold int, score double")
    for name in names:
        errors = grid_errors(name, {}, rows, features, target, key, "_fold", folds, seed) if scoring in ("mse", "mae") else None
        out = out.unionByName(errors.select(F.lit(name).alias("model"), "fold", (-F.col(scoring)).alias("score"))
                              if errors is not None else
                              report(df.sparkSession, cross_val_rows(name, rows, features, target, "_fold", folds, scoring, seed),
                                     "model string, fold int, score double"))
    return out
