"""How often a table is read, and what one task holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright import session
from tabwright.operators import grove, outliers, quantiles, splits, synthetic, trees, worth
from tabwright.plans.queries import REGISTRY


def counted(spark, df):
    """``df`` and an accumulator of the rows that were read from it."""
    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    return df.mapInArrow(tell, df.schema), seen


def test_quantiles_read_the_rows_a_few_times_whatever_the_number_of_ranks(spark):
    x = np.random.default_rng(5).normal(size=(3000, 2)).round(3)
    x[:700, 1] = 0.25
    df, seen = counted(spark, spark.createDataFrame(x.tolist(), "a double, b double").repartition(4))
    probs = [i / 40 for i in range(41)]
    got = quantiles.quantiles(df, ["a", "b"], probs, limit=100)
    assert seen.value <= 5 * len(x)                  # it was a pass for every ten cuts
    for j, c in enumerate("ab"):
        assert got[c] == pytest.approx(np.quantile(x[:, j], probs).tolist(), rel=1e-12)


@pytest.mark.parametrize("name", ["pca80", "winsorize_5_95", "outlier_iqr17", "quantile_bins", "ica", "isolation_forest"])
def test_queries_of_several_passes_join_the_tables_once(spark, sf_dir, name):
    assert "Join" not in REGISTRY[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_records_of_boosted_rows_stay_small(spark, obs, monkeypatch):
    sizes = []

    def kept(df):
        found = real(df)
        sizes.extend(r[0] for r in found[0].selectExpr("octet_length(state)").collect())
        return found
    real = grove._written
    monkeypatch.setattr(grove, "_written", kept)
    rows = trees.hashed_folds(obs.filter("signal is not null").select("k", "f_size", "f_tax", "signal"), "k", 2, 1)
    grove.boosting_errors(rows, ["f_size", "f_tax"], "signal", "k", "_fold", 2, [1], [i / 100 for i in range(1, 31)], [2])
    # 60 sequences: whole blocks of rows were megabytes a record
    assert len(sizes) > 2 and max(sizes) <= 8 * grove.RECORD_CELLS


def test_grid_points_with_the_same_trees_share_rows_and_growths(spark, obs, monkeypatch):
    shipped, growths = [], spark.sparkContext.accumulator(0)

    def kept(df, name="stage"):
        found = real(df, name)
        if name == "branches":
            shipped.append(found.selectExpr("sum(octet_length(pos)) / 4").first()[0])
        return found
    real, grow = grove.stage, grove.grow_branch
    monkeypatch.setattr(grove, "stage", kept)
    monkeypatch.setattr(grove, "grow_branch", lambda *a, **more: growths.add(1) or grow(*a, **more))
    rows = trees.hashed_folds(obs.filter("signal is not null").select("k", "f_size", "f_tax", "signal"), "k", 2, 1).cache()
    grid = dict(counts=[3], depths=[2, 8])
    plain = grove.forest_errors(rows, ["f_size", "f_tax"], "signal", "k", "_fold", 2, **grid).collect()
    assert growths.value == 6
    whole = grove.forest_errors(rows, ["f_size", "f_tax"], "signal", "k", "_fold", 2, **grid, leaves=[1, 2], split_rows=[2, 9]).cache()
    assert whole.count() == 4 * len(plain)
    assert shipped[1] == shipped[0]                  # the rows were shipped for each of the four kinds of tree
    assert growths.value == 6 + 2 * 6                # and grown for each: now a leaf size, stopped earlier for more rows to split
    for leaf, split in ((1, 2), (1, 9), (2, 2), (2, 9)):
        alone = grove.forest_errors(rows, ["f_size", "f_tax"], "signal", "k", "_fold", 2, **grid, leaves=[leaf], split_rows=[split])
        key = lambda df: [(r.maxDepth, r.fold, r.mae) for r in df.orderBy("maxDepth", "fold").collect()]             # noqa: E731
        assert key(whole.filter(f"minInstancesPerNode = {leaf} and minRowsToSplit = {split}")) == key(alone)


def test_isolation_scores_are_mean_depths(spark):
    x = np.random.default_rng(3).normal(size=(300, 2))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i long, a double, b double")
    model = outliers.fit_isolation_forest(df, ["i"], ["a", "b"], 3, n_trees=7, sample=64)
    got = [r[0] for r in df.withColumn("s", model.score()).orderBy("i").select("s").collect()]

    def reached(v, feature, cut, left, reach):
        node = 0
        while feature[node] >= 0:
            node = left[node] + (v[feature[node]] > cut[node])
        return reach[node]
    depths = np.array([sum(reached(v, *t) for t in model.trees) for v in x])
    assert len(model.trees) == 7 and got == pytest.approx(np.exp2(-depths / 7 / outliers._mean_path(64)).tolist(), rel=1e-12)


def test_monotone_bins_read_the_rows_once(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(float(v) if i % 9 else None, float(i % 4 == 0), float(r.random() < 0.5 + 0.1 * v)) for i, v in enumerate(r.normal(size=800))]
    plain = spark.createDataFrame(rows, "x double, z double, y double").repartition(4)
    df, seen = counted(spark, plain)
    real = worth.quantiles
    monkeypatch.setattr(worth, "quantiles", lambda _, *more: real(plain, *more))
    got = worth.monotone_bins(df, ["x", "z"], "y").collect()
    assert seen.value == len(rows)                   # it was twice, and a record a row, feature and number of bins
    for name, own in (("x", [(a, y) for a, _, y in rows]), ("z", [(b, y) for _, b, y in rows])):
        for g in (g for g in got if g.var_name == name):
            inside = [y for v, y in own if (v is None if g.min_value is None else v is not None and g.min_value <= v <= g.max_value)]
            assert (g["count"], g.event) == (len(inside), sum(inside))
        assert sum(g["count"] for g in got if g.var_name == name) == len(rows)


def test_clusters_of_several_k_move_together(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(600, 2)) + np.repeat([[0, 0], [6, 0], [0, 6]], 200, axis=0)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x] + [(None, 1.0)], "a double, b double").coalesce(1)
    rounds = []
    real = synthetic._nearest
    monkeypatch.setattr(synthetic, "_nearest", lambda centres, middle: rounds.append(len(centres)) or real(centres, middle))
    got, model = synthetic.kmeans_sweep(df, ["a", "b"], [1, 3, 4, 5], 2)
    assert rounds[0] == 3                            # a pass serves all k; there was one a round and k
    cost = {r.k: r.inertia for r in got.collect()}
    for k in (3, 4, 5):
        alone, fitted = synthetic.kmeans_sweep(df, ["a", "b"], [k], 2)
        assert alone.first().inertia == pytest.approx(cost[k], rel=1e-9)
    assert np.array(model.clusterCenters()) == pytest.approx(np.array(fitted.clusterCenters()), rel=1e-9)
    a, b = ([r.cluster for r in synthetic.assign_clusters(df, ["a", "b"], m).collect()] for m in (model, fitted))
    assert a == b and a[-1] is None


def test_mllib_gets_rows_in_bounded_partitions(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(600, 3))
    df = spark.createDataFrame(x.tolist(), "a double, b double, y double").coalesce(1)
    held = []
    for kind in (synthetic.KMeans, trees.RandomForestRegressor):
        def fit(self, rows, real=kind.fit):
            held.append([r[0] for r in rows.groupBy(F.spark_partition_id()).count().select("count").collect()])
            return real(self, rows)
        monkeypatch.setattr(kind, "fit", fit)
    for most, parts in ((session.TASK_ROWS, 1), (100, max(6, spark.sparkContext.defaultParallelism))):
        monkeypatch.setattr(session, "TASK_ROWS", most)
        held.clear()
        synthetic.kmeans_sweep(df, ["a", "b"], [3], 1)
        trees.fit_model("forest", df, ["a", "b"], "y", 1, numTrees=2, maxDepth=2)
        # it was one task with all rows, however many
        assert [sum(h) for h in held] == [600, 600] and all(len(h) == parts for h in held)


def test_folds_come_from_generated_code(spark):
    rows = [(i % 7 if i % 11 else None, float(i % 5), str(i)) for i in range(200)]
    df = splits.kfold(spark.createDataFrame(rows, "a int, b double, c string"), ["a", "b", "c"], 60)
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()      # interpreted, row by row
    ordered = sorted(df.collect(), key=lambda r: (r.a is not None, r.a or 0, r.b, r.c))
    ends = np.cumsum(splits.fold_sizes(200, 60))
    assert [r.fold for r in ordered] == [int(np.searchsorted(ends, i, "right")) for i in range(200)]
