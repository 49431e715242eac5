"""Bins, tails, trees, studies, sources and streams."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwright.functions.tails import chi2_tail, normal_two_sided, t_two_sided
from tabwright.operators import impute, outliers, scaling, significance, synthetic, trees, worth
from tabwright.plans import study
from tabwright.sources import tables
from tabwright.sources.fixtures import OBS_EXEMPT, OBS_KEY
from tabwright.streaming.transforms import apply_stream, read_stream


def test_tails():
    assert abs(chi2_tail(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(chi2_tail(18.307038053275146, 10) - 0.05) < 1e-9
    assert abs(chi2_tail(2.0, 2) - math.exp(-1)) < 1e-12
    assert abs(t_two_sided(2.2281388519649385, 10) - 0.05) < 1e-9
    assert abs(t_two_sided(-12.706204736432095, 1) - 0.05) < 1e-9
    assert abs(normal_two_sided(1.959963984540054) - 0.05) < 1e-9
    assert chi2_tail(1e5, 3) == 0.0


def test_woe_shares_sum_to_one_and_counts_to_n(spark):
    rng = np.random.default_rng(0)
    n = 4000
    x = rng.normal(size=n)
    pdf = pd.DataFrame({"x": x, "y": (rng.random(n) < 1 / (1 + np.exp(-2 * x))).astype(float)})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.rand(1) < 0.9, F.col("x")))
    bins, iv = worth.data_vars(df, ["x"], "y")
    t = bins.toPandas()
    assert t["count"].sum() == n and abs(t.dist_event.sum() - 1) < 1e-9 and t.min_value.isna().sum() == 1
    rates = t.dropna(subset=["max_value"]).sort_values("max_value").event_rate
    assert rates.is_monotonic_increasing and iv.first().iv > 0.5
    with pytest.raises(ValueError):
        worth.data_vars(df.withColumn("y", F.col("y") + 0.5), ["x"], "y")


def test_forced_bins_when_nothing_is_monotone(spark):
    rows = [(float(i), float((i // 50) % 2)) for i in range(1000)]
    t = worth.mono_bin(spark.createDataFrame(rows, "x double, y double"), ["x"], "y").toPandas()
    assert 1 <= len(t) <= 10 and t["count"].sum() == 1000


def test_winsorized_values_stay_inside(obs):
    b = outliers.winsor_bounds(obs, ["f_qty", "f_order"], 10, 90)
    out = b.clip(obs)
    assert b.flagged(out).count() == 0
    assert out.filter("f_qty is null").count() == obs.filter("f_qty is null").count()


def test_isolation_forest_finds_planted_outliers(spark):
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(size=(990, 2)), rng.normal(12, 1, size=(10, 2))]
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(1000), "a": x[:, 0], "b": x[:, 1]}))
    got = outliers.isolation_rows(df, ["id"], ["a", "b"], 1, contamination=0.02, n_trees=40).toPandas()
    assert set(range(990, 1000)) <= set(got.id) and len(got) == 20
    again = outliers.isolation_rows(df.repartition(4), ["id"], ["a", "b"], 1, contamination=0.02, n_trees=40).toPandas()
    assert set(again.id) == set(got.id)


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "a double, b double")
    m = scaling.fit_minmax(df, ["a", "b"])
    assert [tuple(r) for r in m.transform(df).orderBy("b").collect()] == [(0.0, 0.0), (0.0, 1.0)]
    assert m.inverse(m.transform(df)).exceptAll(df).count() == 0


def test_shape_fill_prefers_the_median_for_normal_columns(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"n": rng.normal(size=2000), "e": rng.exponential(size=2000)})
    v = impute.fit_by_shape(spark.createDataFrame(pdf), ["n", "e"]).values
    assert abs(v["n"] - pdf.n.median()) < 1e-12 and abs(v["e"] - pdf.e.mean()) < 1e-12


@pytest.mark.parametrize("name,params", [("tree", {}), ("forest", {"numTrees": 5}), ("bagging", {"numTrees": 5}),
                                         ("boosting", {"maxIter": 5}), ("extra_trees", {"n_trees": 3}),
                                         ("adaboost", {"n_estimators": 6, "loss": "square"})])
def test_tree_models_beat_the_mean(obs, name, params):
    model = trees.fit_model(name, obs, ["f_size", "f_spiky"], "signal", 1, **params)
    mean = obs.agg(F.avg("signal")).first()[0]
    got = model.transform(obs).agg(F.avg(F.abs(F.col("signal") - F.col("prediction"))),
                                   F.avg(F.abs(F.col("signal") - mean))).first()
    assert got[0] < 0.6 * got[1]


def test_tuning_and_cross_validation(obs):
    model = trees.tune("forest", {"numTrees": [3], "maxDepth": [2, 6]}, obs, ["f_size", "f_spiky"], "signal", "k", 3, 1)
    assert model.model.getOrDefault("maxDepth") == 6
    best = trees.tune("adaboost", {"n_estimators": [2], "loss": ["linear"]}, obs, ["f_size", "f_spiky"], "signal", "k", 2)
    assert len(best.models) <= 2
    t = trees.cross_val_score(["tree"], obs, ["f_size", "f_spiky"], "signal", "k", 3, "mae")
    assert t.count() == 3 and t.filter("score > 0").count() == 0


def test_generalisation_table(obs):
    t = study.generalisation(obs, "k", OBS_KEY, ["f_qty", "f_tax", "f_size", *OBS_EXEMPT], "target", OBS_EXEMPT, [0, 1],
                             [(False, False, False, False), (True, True, True, True)],
                             {"forest": {"numTrees": [3], "maxDepth": [3]}}, 3, 2)
    assert t.count() == 4 and {r.combination for r in t.collect()} == {"FFFF", "TTTT"}
    assert study.score_table(t, ["forest"]).count() == 4


def test_outlier_benchmark(obs):
    t = study.outlier_benchmark(obs, OBS_KEY, ["f_size", "f_spiky"], ["f_spiky"], "signal", 5, forest=False)
    assert t.groupBy("method").count().filter("count = 5").count() == 9


def test_synthetic_rows_lie_between_point_and_centroid(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": np.arange(500), "cluster": np.arange(500) % 3, "x": rng.random(500), "y": rng.random(500)})
    df = spark.createDataFrame(pdf)
    made = synthetic.interpolate(df, "cluster", ["id"], ["x", "y"], 0.5, 4).toPandas().set_index("id")
    centre = pdf.groupby("cluster")[["x", "y"]].mean()
    for i, r in made.iterrows():
        for c in ("x", "y"):
            a, b = sorted([pdf.loc[i, c], centre.loc[pdf.loc[i, "cluster"], c]])
            assert a - 1e-12 <= r[c] <= b + 1e-12
    assert len(made) == sum(int(n * 0.5) for n in pdf.groupby("cluster").size())
    assert set(made.index) == set(pdf.groupby("cluster").head(83).query("index in @made.index").id)


def test_synthetic_benchmark_and_clusters(obs):
    t = synthetic.compare_synthetic(obs, OBS_KEY, ["f_size", "f_spiky"], "signal", 4, [2], [0.5], 1)
    assert {r.method for r in t.collect()} == {"original", "2_0.5"}


def test_wilcoxon_drops_zero_differences(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, 9.0], [1.0, 1.0, 5.0, 3.0, 5.0]
    rows = [("a", i, v) for i, v in enumerate(a)] + [("b", i, v) for i, v in enumerate(b)]
    r = significance.wilcoxon(spark.createDataFrame(rows, "m string, fold int, v double"), "m", "fold", "v", "a", "b").first()
    assert r.n == 4 and r.w == 3.0 and 0 < r.p < 1


def test_sources(spark, tmp_path, obs):
    small = obs.select(*OBS_KEY, "f_tax", "target").limit(50)
    path = str(tmp_path / "t")
    tables.export(small, path)
    assert tables.read_table(spark, path, OBS_KEY).count() == 50
    with pytest.raises(ValueError):
        tables.read_table(spark, path, ["missing"])
    with pytest.raises(ValueError):
        tables.read_table(spark, path, OBS_KEY, "csv")
    csv = str(tmp_path / "c")
    tables.export(small, csv, "csv")
    back = tables.read_table(spark, csv, OBS_KEY, "csv", schema=small.schema, header="true")
    assert back.exceptAll(small).count() == 0
    df = tables.nan_to_null(spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "a double, b int"))
    assert df.filter("a is null").count() == 1


def test_fitted_models_apply_to_a_stream(spark, tmp_path, obs):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    cols = obs.select(*OBS_KEY, "f_qty", "f_order")
    cols.write.parquet(src)
    fill = impute.fit_means(cols, ["f_qty"])
    clip = outliers.winsor_bounds(cols, ["f_order"], 5, 95)
    scale = scaling.fit_minmax(cols, ["f_order"])
    q = apply_stream(read_stream(spark, src, cols.schema), [fill.transform, clip.clip, scale.transform], out,
                     checkpoint=str(tmp_path / "cp"))
    q.awaitTermination(120)
    want = scale.transform(clip.clip(fill.transform(cols)))
    assert spark.read.parquet(out).exceptAll(want).count() == 0
