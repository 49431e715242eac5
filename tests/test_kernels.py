"""Ordering, quantiles, cross products, folds and neighbours against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwright.functions.draws import uniform
from tabwright.operators import (decompose, gram, linear, model_impute, neighbours, ordering, quality, quantiles,
                                 scaling, splits, worth)
from tabwright.sources.fixtures import OBS_KEY

COLS = ["f_tax", "f_size", "f_retail", "f_order", "f_spiky", "f_size2"]


@pytest.mark.parametrize("limit", [10, 300, 10 ** 7])
def test_quantiles_are_exact(obs, obs_pdf, limit):
    probs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = quantiles.quantiles(obs, ["f_qty", "f_order", "f_spiky", "f_tax"], probs, limit)
    for c, v in got.items():
        np.testing.assert_allclose(v, np.quantile(obs_pdf[c].dropna(), probs), rtol=1e-12)


def test_quantiles_with_a_hot_value(spark):
    x = np.r_[np.full(4000, 7.0), np.arange(8000) / 13.0]
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(5)
    got = quantiles.quantiles(df, ["x"], [0.1, 0.2, 0.3, 0.9], limit=50)["x"]
    np.testing.assert_allclose(got, np.quantile(x, [0.1, 0.2, 0.3, 0.9]), rtol=1e-12)


def test_empty_column_has_no_quantile(obs):
    df = obs.withColumn("none", F.lit(None).cast("double"))
    assert quantiles.quantiles(df, ["none"], [0.5])["none"] == [None]


def test_running_numbers_and_sums(obs, obs_pdf):
    got = ordering.running(obs.select(*OBS_KEY, "f_tax"), [F.col(c) for c in OBS_KEY],
                           {"upto": F.col("f_tax")}).toPandas().sort_values("position")
    want = obs_pdf.sort_values(OBS_KEY)
    assert got["position"].tolist() == list(range(1, len(want) + 1))
    assert got["l_partkey"].tolist() == want["l_partkey"].tolist()
    np.testing.assert_allclose(got["upto"], want["f_tax"].cumsum(), rtol=1e-9)


def test_value_ranks_average_ties(obs, obs_pdf):
    got = ordering.value_ranks(obs, "f_spiky").toPandas().set_index("f_spiky")["rank"]
    want = obs_pdf["f_spiky"].rank()
    np.testing.assert_allclose(got.loc[obs_pdf["f_spiky"]].to_numpy(), want.to_numpy())


@pytest.mark.parametrize("k", [3, 20, 100])
def test_folds_are_contiguous_whatever_the_partitioning(obs, obs_pdf, k):
    want = obs_pdf.sort_values(OBS_KEY).reset_index(drop=True)
    sizes = splits.fold_sizes(len(want), k)
    want["fold"] = np.repeat(np.arange(k), sizes)
    got = splits.kfold(obs.select(*OBS_KEY).repartition(3), OBS_KEY, k).toPandas().sort_values(OBS_KEY)
    assert got["fold"].tolist() == want["fold"].tolist()


def test_validation_flag_is_exact_and_repeatable(obs):
    a = splits.validation_flag(obs.select(*OBS_KEY, "k"), "k", OBS_KEY, 5, 0.25)
    b = splits.validation_flag(obs.select(*OBS_KEY, "k").repartition(2), "k", OBS_KEY, 5, 0.25)
    assert a.filter("is_val").count() == int(0.25 * obs.count())
    assert a.exceptAll(b).count() == 0


def test_native_and_arrow_moments_agree(obs, obs_pdf, monkeypatch):
    one = gram.fold_moments(obs.withColumn("f", F.col("gender")), COLS, "f")
    monkeypatch.setattr(gram, "NATIVE_AGGREGATES", 0)
    two = gram.fold_moments(obs.withColumn("f", F.col("gender")), COLS, "f")
    for f in one:
        np.testing.assert_allclose(one[f].ss, two[f].ss, rtol=1e-9)
    np.testing.assert_allclose(gram.total(one).covariance(), obs_pdf[COLS].cov(), rtol=1e-9)


def test_linear_cross_validation(obs, obs_pdf):
    got = linear.cross_validate(obs, COLS, "signal", OBS_KEY, 5, ["linear", "ridge"], absolute=True).toPandas()
    pdf = obs_pdf.sort_values(OBS_KEY).reset_index(drop=True)
    fold = np.repeat(np.arange(5), splits.fold_sizes(len(pdf), 5))
    x, y = pdf[COLS].to_numpy(), pdf["signal"].to_numpy()
    for f in range(5):
        tr = fold != f
        a = np.c_[np.ones(tr.sum()), x[tr]]
        b = np.linalg.lstsq(a, y[tr], rcond=None)[0]
        e = y[~tr] - np.c_[np.ones((~tr).sum()), x[~tr]] @ b
        row = got[(got.method == "linear") & (got.fold == f)].iloc[0]
        np.testing.assert_allclose([row.neg_mse, row.neg_mae, row.explained_variance],
                                   [-(e ** 2).mean(), -np.abs(e).mean(), 1 - e.var() / y[~tr].var()], rtol=1e-6)


def test_bayesian_models_come_close_to_least_squares(obs):
    m = gram.moments(obs, ["f_spiky", "f_size", "signal"])
    base = linear.from_moments(m, "linear")
    for name in ("bayesian_ridge", "ard"):
        np.testing.assert_allclose(linear.from_moments(m, name).coef, base.coef, rtol=1e-2)


def test_vif_and_pruning(obs, obs_pdf):
    got = dict(worth.vif(obs, COLS).collect())
    g = obs_pdf[COLS].to_numpy().T @ obs_pdf[COLS].to_numpy()
    want = np.diag(g) * np.diag(np.linalg.inv(g))
    np.testing.assert_allclose([got[c] for c in COLS], want, rtol=1e-5)
    kept = worth.vif_prune(gram.moments(obs, COLS))
    assert not {"f_size", "f_size2"} <= set(kept)


def test_singular_columns_give_no_vif(obs):
    df = obs.select("f_tax", (F.col("f_tax") * 2).alias("twice"))
    assert {r.vif for r in worth.vif(df, ["f_tax", "twice"]).collect()} == {None}


def test_correlation_pruning_rules():
    corr = {("a", "b"): 0.9, ("b", "c"): 0.8, ("a", "c"): 0.1, ("a", "d"): -0.95, ("c", "d"): 0.0}
    assert worth.correlation_prune(corr, ["a", "b", "c", "d"]) == ["a"]
    assert worth.correlation_prune(corr, ["a", "b", "c", "d"], drop_last=False) == ["a", "d"]
    assert worth.correlation_prune(corr, ["a", "b", "c", "d"], absolute=True, drop_last=False) == ["a"]


def _brute_knn(points, queries, features, target, key, k):
    p = points.sort_values(key)
    x, y = p[features].to_numpy(), p[target].to_numpy()
    out = []
    for q in queries[features].to_numpy():
        d = np.sqrt(((x - q) ** 2).sum(axis=1))
        out.append(y[np.argsort(np.round(d, 12), kind="stable")[:k]].mean())
    return np.array(out)


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    n = 3000
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.random(n), "b": rng.normal(size=n), "y": rng.random(n)})
    pdf.loc[:999, ["a", "b"]] = [0.5, 0.0]                 # a third of all points coincide
    queries = pd.DataFrame({"id": np.arange(300), "a": rng.random(300), "b": rng.normal(size=300)})
    queries.loc[:99, ["a", "b"]] = [0.5, 0.0]
    got = neighbours.knn_mean(spark.createDataFrame(pdf), spark.createDataFrame(queries), ["a", "b"], "y", ["id"], 5)
    got = got.toPandas().sort_values("id")["prediction"].to_numpy()
    np.testing.assert_allclose(got, _brute_knn(pdf, queries, ["a", "b"], "y", ["id"], 5), rtol=1e-9)


def test_neighbours_with_fewer_points_than_k(spark):
    pts = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, 3.0)], "id int, a double, y double")
    qs = spark.createDataFrame([(9, 0.2)], "id int, a double")
    assert neighbours.knn_mean(pts, qs, ["a"], "y", ["id"], 5).first().prediction == 2.0


def test_principal_components(obs):
    obs = scaling.fit_minmax(obs, COLS).transform(obs)        # as in use: the raw units span 14 digits
    pca = decompose.fit_pca(obs, COLS)
    value = np.sort(np.linalg.eigvalsh(obs.select(*COLS).toPandas().cov()))[::-1]
    np.testing.assert_allclose(pca.variance, value, rtol=1e-6, atol=1e-9)
    scores = pca.map.transform(obs).select(*pca.map.names).toPandas()
    np.testing.assert_allclose(scores.mean(), 0, atol=1e-6)
    np.testing.assert_allclose(scores.var(), value, rtol=1e-6, atol=1e-9)
    assert pca.enough(80) == int(np.searchsorted(np.cumsum(value) / value.sum(), 0.8) + 1)


def test_factor_model_reproduces_the_covariance(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(4000, 1))
    x = z @ np.array([[1.0, 2.0, -1.5, 0.5]]) + rng.normal(size=(4000, 4)) * [0.5, 0.7, 0.6, 0.4]
    cols = list("abcd")
    fit = decompose.fit_factors(spark.createDataFrame(pd.DataFrame(x, columns=cols)), cols, 1)
    model = fit.loadings @ fit.loadings.T + np.diag(fit.noise)
    np.testing.assert_allclose(model, np.cov(x.T, ddof=0), atol=0.08)
    np.testing.assert_allclose(np.sqrt(fit.noise), [0.5, 0.7, 0.6, 0.4], atol=0.08)


def test_ica_separates_independent_sources(spark):
    rng = np.random.default_rng(2)
    s = np.c_[rng.uniform(-1, 1, 6000), rng.laplace(size=6000)]
    x = s @ np.array([[1.0, 0.6], [-0.4, 1.0]])
    out = decompose.fit_ica(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"])), ["a", "b"], 2)
    got = (x - out.centre) @ out.weights
    c = np.abs(np.corrcoef(np.c_[got, s].T)[:2, 2:])
    assert np.sort(c.max(axis=1))[0] > 0.98


def test_ward_joins_the_alike_columns(obs):
    df = obs.select("f_size", (F.col("f_size") + 0.1 * F.col("f_tax")).alias("near"), "f_order")
    label = decompose.agglomerate_from(gram.moments(df, df.columns), 2)
    assert label["f_size"] == label["near"] != label["f_order"]


def test_representations_match_a_direct_fit(obs):
    pca = decompose.fit_pca(obs, COLS)
    direct = linear.cross_validate(pca.map.transform(obs), pca.map.names, "signal", OBS_KEY, 4)
    selected = linear.cross_validate(obs, COLS, "signal", OBS_KEY, 4)
    a = sorted(r.neg_mse for r in direct.collect())
    b = sorted(r.neg_mse for r in selected.collect())
    np.testing.assert_allclose(a, b, rtol=1e-5)


def test_mode_and_early_distinct(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 3, 2), (1, 3, 1), (2, 9, None)], "g int, a int, b int")
    rows = {r.g: (r.a, r.b) for r in quality.group_modes(df, "g", ["a", "b"]).collect()}
    assert rows == {1: (3, 1), 2: (9, None)}
    assert quality.distinct_counts(df, ["a", "b"], more_than=2) == {"a": 3, "b": 2}
    assert quality.distinct_counts(df, ["a"], more_than=1) == {"a": 2}


def test_constant_column_has_no_correlation(obs):
    df = obs.select("f_tax", F.lit(1.0).alias("one"))
    assert quality.correlations(df, ["f_tax", "one"]).first().r is None


def test_draws_do_not_depend_on_partitions(obs):
    a = obs.select(F.sum(uniform("k", 3))).first()[0]
    assert abs(a / obs.count() - 0.5) < 0.02


def test_impute_with_models_fills_everything(spark):
    rng = np.random.default_rng(3)
    n = 600
    a, b = rng.random(n), rng.random(n)
    pdf = pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "c": 3 * a - b})
    truth = pdf["c"].copy()
    df = spark.createDataFrame(pdf).withColumn("c", F.when(F.col("id") % 7 != 0, F.col("c")))
    train, test = df.filter("id < 500"), df.filter("id >= 500")
    x, t, scores = model_impute.impute_with_models(
        train, test, ["a", "b", "c"], ["id"], 3, ("bayesian_ridge", "tree", "knn"))
    assert x.count() == 500 and t.count() == 100
    both = x.unionByName(t).toPandas().sort_values("id")
    np.testing.assert_allclose(both["c"], truth, atol=1e-3)
    table = model_impute.score_report(scores).toPandas()
    assert set(table.model) == {"bayesian_ridge", "tree", "knn"} and (table.error <= 0).all()


def test_nearest_outside_the_own_fold(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"id": np.arange(700), "a": rng.integers(0, 12, 700) / 3.0, "b": rng.normal(size=700), "y": rng.normal(size=700)})
    pdf.loc[pdf.id % 5 == 0, ["a", "b"]] = [1.0, 0.5]                     # one point that holds a fifth of the rows
    pdf["fold"] = np.where(pdf.id < 500, 0, 1 + pdf.id % 6)               # a fold that holds most of them
    df = spark.createDataFrame(pdf).repartition(5)
    got = neighbours.knn_mean(df, df, ["a", "b"], "y", ["id"], 5, fold="fold").toPandas().sort_values("id")["prediction"]
    want = np.full(len(pdf), np.nan)
    for f in pdf.fold.unique():
        own = (pdf.fold == f).to_numpy()
        want[own] = _brute_knn(pdf[~own], pdf[own], ["a", "b"], "y", ["id"], 5)
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_neighbouring_keys_draw_independently(spark):
    rows = spark.range(20_000).select("id", uniform("id", 3).alias("a"), uniform("id", 4).alias("b"),
                                      uniform(F.col("id") + F.lit(1 << 31), 3).alias("c"), uniform(-F.col("id") - 1, 3).alias("d"))
    pdf = rows.toPandas().sort_values("id")
    for x, y in ((pdf.a[1:], pdf.a[:-1]), (pdf.a, pdf.b), (pdf.a, pdf.c), (pdf.a, pdf.d), (pdf.a[16:], pdf.a[:-16])):
        assert abs(np.corrcoef(x, y)[0, 1]) < 0.03
    assert ((pdf[["a", "b", "c", "d"]] >= 0) & (pdf[["a", "b", "c", "d"]] < 1)).all().all() and abs(pdf.a.mean() - 0.5) < 0.01
    counts = np.bincount((pdf.a * 100).astype(int), minlength=100)
    assert ((counts - 200) ** 2 / 200).sum() < 160


def test_random_forests_of_all_folds(obs):
    from tabwright.operators import grove, trees
    rows = trees.hashed_folds(obs.select("k", "f_size", "f_spiky", "signal"), "k", 3, 1).cache()
    errors = grove.random_errors(rows, ["f_size", "f_spiky"], "signal", "_fold", 3, 4, 5, 2).orderBy("fold").collect()
    for r in errors:
        model = trees.fit_extra_trees(rows.filter(F.col("_fold") != r["fold"]), ["f_size", "f_spiky"], "signal", 2, 4, 5)
        got = model.transform(rows.filter(F.col("_fold") == r["fold"])).agg(
            F.avg(F.abs(F.col("signal") - F.col("prediction")))).first()[0]
        assert r["mae"] == pytest.approx(got, rel=1e-9)
