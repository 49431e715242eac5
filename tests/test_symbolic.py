"""Expressions, scoring, breeding and the estimators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwright.functions.protected import BUILT_IN, Scalar, make_function
from tabwright.operators import breeding, expressions, population, scoring, splits, symbolic
from tabwright.sources.fixtures import OBS_FEATURES, OBS_KEY

EDGES = [0.0, 0.001, -0.001, 0.0011, -0.0011, 1.0, -1.0, 2.5, 1e308, -1e308, float("inf"), float("-inf"), float("nan"), None]


def _same(a, b):
    a = float("nan") if a is None else a
    return (np.isnan(a) and np.isnan(b)) or a == b or abs(a - b) <= 1e-9 * max(1.0, abs(b))


@pytest.mark.parametrize("name", sorted(BUILT_IN))
def test_column_and_vector_forms_agree_on_edges(spark, name):
    fn = BUILT_IN[name]
    rows = [(a, b) for a in EDGES for b in EDGES] if fn.arity == 2 else [(a, 0.0) for a in EDGES]
    if name in ("sin", "cos", "tan"):
        rows = [r for r in rows if r[0] is None or abs(r[0]) < 1e300]       # huge arguments are not comparable
    args = [F.col("a"), F.col("b")][:fn.arity]
    got = [r.r for r in spark.createDataFrame(rows, "a double, b double").coalesce(1).select(
        fn.column(*args).cast("double").alias("r")).collect()]
    nan = [[np.nan if v is None else v for v in r] for r in rows]
    x = np.array(nan, dtype=float)
    with np.errstate(all="ignore"):
        want = fn.vector(*[x[:, i] for i in range(fn.arity)])
    for r, g, w in zip(rows, got, want):
        assert _same(g, float(w)), (name, r, g, w)


def test_user_functions_are_checked(spark):
    ok = make_function(spark, lambda a: a * a, "square", 1, np.square)
    assert isinstance(ok, Scalar)
    with pytest.raises(ValueError):
        make_function(spark, lambda a: a, "x", 2)
    with pytest.raises(ValueError):
        make_function(spark, lambda a: F.try_divide(F.lit(1.0), a), "one_over", 1)
    with pytest.raises(ValueError):
        make_function(spark, lambda a: a, 3, 1)


def test_user_metric_is_checked(spark):
    m = scoring.make_fitness(spark, lambda y, f, w: F.max(F.abs(y - f) * w), False, "worst")
    assert m.sign == -1
    with pytest.raises(ValueError):
        scoring.make_fitness(spark, lambda y, f, w: F.max(y), 1)
    with pytest.raises(ValueError):
        scoring.make_fitness(spark, lambda y, f: F.max(y), True)
    with pytest.raises(ValueError):
        scoring.make_fitness(spark, lambda y, f, w: F.max(F.lit("a")), True)


def _programs():
    from tabwright.plans.queries import PROGRAMS
    return [(i, expressions.prefix(p, OBS_FEATURES)) for i, p in enumerate(PROGRAMS)]


@pytest.mark.parametrize("metric", ["mean absolute error", "mse", "rmse", "pearson"])
@pytest.mark.parametrize("bag", [None, ("k", 4, 0.6)])
def test_both_scoring_paths_agree(obs, metric, bag):
    kw = dict(metric=metric, weight="f_size", bag=bag, val="held")
    df = obs.withColumn("held", F.col("gender") == 1)
    a = {r.program_id: r for r in scoring.score(df, _programs(), OBS_FEATURES, "signal", method="columns", **kw).collect()}
    b = {r.program_id: r for r in scoring.score(df, _programs(), OBS_FEATURES, "signal", method="arrow", **kw).collect()}
    assert set(a) == set(b)
    for i in a:
        for name in a[i].asDict():
            assert _same(a[i][name], b[i][name]) or abs(a[i][name] - b[i][name]) < 1e-6 * abs(b[i][name]), (i, name)


def test_weighted_spearman(obs, obs_pdf):
    got = scoring.score(obs, _programs()[5:6], OBS_FEATURES, "signal", "spearman", weight="f_size").first().raw_fitness
    f = 3 * obs_pdf.f_spiky - 0.5 * obs_pdf.f_size
    a, b, w = obs_pdf.signal.rank(), f.rank(), obs_pdf.f_size
    c = np.cov(np.c_[a, b].T, aweights=w, ddof=0)
    assert abs(got - abs(c[0, 1] / np.sqrt(c[0, 0] * c[1, 1]))) < 1e-9


def test_invalid_programs_are_found(spark):
    good = [("f", "add", None, None), ("x", None, 0, None), ("c", None, None, 1.0)]
    rows = [(1, good), (2, good[:2]), (3, good + [("x", None, 1, None)]), (4, [("f", "nope", None, None)])]
    t = expressions.inspect(spark.createDataFrame(rows, expressions.PROGRAMS))
    assert {r.program_id: r.valid for r in t.collect()} == {1: True, 2: False, 3: False, 4: False}
    with pytest.raises(ValueError):
        expressions.to_column(good[:2], ["a"])


GRAMMAR = breeding.Grammar(["add", "sub", "mul", "div", "sqrt", "log", "max", "min", "neg"], 4)


@pytest.fixture(scope="module")
def pop(spark):
    p = breeding.initial_population(spark, GRAMMAR, 80, [0, 1], 2, 5)
    return breeding.measured(p, GRAMMAR).withColumn("fitness", 1.0 + F.col("length") * 1.0).persist()


@pytest.mark.parametrize("method", ["grow", "full", "half and half"])
def test_initial_programs(spark, method):
    g = breeding.Grammar(["add", "sqrt", "mul"], 3, None, (2, 3), method)
    t = expressions.inspect(breeding.initial_population(spark, g, 200, [0], 1, 1), g.table()).toPandas()
    assert t.valid.all() and t.depth.max() <= 3 and t.depth.min() >= 1
    assert not t.text.str.contains(r"\d\.\d").any()                 # no constants
    if method == "full":
        assert set(t.depth) == {2, 3}


@pytest.mark.parametrize("method", breeding.METHODS)
def test_offspring_are_valid(pop, method):
    v = breeding.Variation({method: 1.0}, "tournament", 3)
    child = breeding.breed(pop, GRAMMAR, v, 1, 9)
    t = expressions.inspect(child, GRAMMAR.table()).toPandas()
    assert len(t) == 320 and t.valid.all() and (t.method == method).all()
    parent = {(r.run_seed, r.deme, r.program_id): r for r in expressions.inspect(pop, GRAMMAR.table()).collect()}
    pairs = [(parent[(r.run_seed, r.deme, r.parent_id)], r) for r in t.itertuples()]
    if method in ("point_mutation", "shake_mutation", "reverse_mutation", "swap_mutation", "uniform_crossover"):
        assert all(p.length == c.length for p, c in pairs)
    if method == "hoist_mutation":
        assert all(c.length <= p.length for p, c in pairs)
    if method == "graft_mutation":
        assert all(c.length >= p.length for p, c in pairs)
    if method in breeding.TWO_PARENTS:
        assert t.donor_id.notna().all() and (t.donor_id != t.parent_id).any()
    if method != "point_mutation":
        assert any(p.text != c.text for p, c in pairs)


@pytest.mark.parametrize("selection", sorted(breeding.SELECTIONS))
def test_selection_fills_every_slot(pop, selection):
    v = breeding.Variation({}, selection, 3)
    t = breeding.breed(pop, GRAMMAR, v, 1, 2).toPandas()
    assert len(t) == 320 and (t.method == "reproduction").all() and t.parent_id.notna().all()


def test_breeding_is_repeatable(pop):
    v = breeding.Variation({"crossover": 0.6, "subtree_mutation": 0.4})
    a = breeding.breed(pop, GRAMMAR, v, 3, 2)
    b = breeding.breed(pop.repartition(5), GRAMMAR, v, 3, 2)
    assert a.exceptAll(b).count() == 0


def test_self_mating_uses_one_draw(pop):
    v = breeding.Variation({"crossover": 1.0}, self_mating=True)
    t = breeding.breed(pop, GRAMMAR, v, 1, 2).toPandas()
    assert (t.parent_id == t.donor_id).all()


def test_bad_settings_are_refused():
    with pytest.raises(ValueError):
        breeding.Variation({"crossover": 0.9, "hoist_mutation": 0.2}).check()
    with pytest.raises(ValueError):
        breeding.Variation({"p2_crossover": 0.1}).check()
    with pytest.raises(ValueError):
        breeding.Grammar(init_depth=(3, 2)).check()


def test_decorrelation_drops_the_less_fit():
    corr = np.array([[1, 0.9, 0.1], [0.9, 1, 0.2], [0.1, 0.2, 1.0]])
    assert population.decorrelated(corr, 2) == [0, 2]


SMALL = dict(population_size=40, generations=4, seed=2)


def test_regressor_learns_and_repeats(obs, tmp_path, spark):
    obs = obs.withColumn("signal", F.col("f_size") + F.col("f_spiky"))          # planted
    kw = dict(features=["f_tax", "f_size", "f_spiky"], target="signal", key="k", unique_key=OBS_KEY)
    est = symbolic.SymbolicRegressor(**SMALL, log_path=str(tmp_path / "log"), history_path=str(tmp_path / "h")).fit(obs, **kw)
    mean = obs.agg(F.avg("signal")).first()[0]
    got = est.transform(obs).agg(F.avg(F.abs(F.col("signal") - F.col("prediction"))),
                                 F.avg(F.abs(F.col("signal") - mean))).first()
    assert got[0] < got[1]
    again = symbolic.SymbolicRegressor(**SMALL).fit(obs.repartition(3), **kw)
    assert again.program_ == est.program_
    from tabwright.sources.tables import read_run_log
    assert read_run_log(spark, str(tmp_path / "log")).count() == 4
    history = spark.read.parquet(str(tmp_path / "h"))
    assert history.groupBy("generation").count().count() == 4
    assert population.prune_ancestors(history, 1).count() <= 40
    est.warm_start, est.generations = True, 5
    est.fit(obs, **kw)
    assert len(est.details_) == 5
    est.generations = 2
    with pytest.raises(ValueError):
        est.fit(obs, **kw)


def test_resume_goes_on_from_the_stored_generation(obs, tmp_path):
    kw = dict(features=["f_tax", "f_size"], target="signal", key="k", unique_key=OBS_KEY)
    path, two = str(tmp_path / "h"), {**SMALL, "generations": 2, "max_samples": 0.7}
    est = symbolic.SymbolicRegressor(**two, history_path=path).fit(obs, **kw)
    other = symbolic.SymbolicRegressor(**{**two, "generations": 3}).fit(obs, **kw, resume=path)
    for a, b in zip(other.details_[:2], est.details_, strict=True):
        assert a[:2] == b[:2] and np.allclose(a[2:6], b[2:6], rtol=1e-12, atol=0)       # sums may differ in the last bit
    est.warm_start, est.generations, est.history_path = True, 3, None
    est.fit(obs, **kw)
    bred = [{(r.generation, r.program_id, str(r.nodes)) for r in e.population_.collect()} for e in (est, other)]
    assert bred[0] == bred[1] and len(bred[0]) == 40
    with pytest.raises(ValueError):
        symbolic.SymbolicRegressor(**{**two, "generations": 1}).fit(obs, **kw, resume=path)


def test_classifier_with_its_own_output(obs):
    half = Scalar("half", 1, lambda a: F.lit(0.5) + F.lit(0.5) * F.tanh(a), lambda a: 0.5 + 0.5 * np.tanh(a))
    est = symbolic.SymbolicClassifier(**{**SMALL, "generations": 2}, output=half)
    p = est.fit(obs, ["f_tax", "f_size"], "gender", "k", OBS_KEY).transform(obs).select(F.col("probability")[1].alias("p"))
    assert p.filter("p < 0 or p > 1 or p is null").count() == 0


def test_bags_never_repeat(spark):
    rows = spark.range(0, 20000, 4)
    inside = lambda program, seed: splits.in_bag("id", program, seed, 0.6)                    # noqa: E731
    others = [inside(20001, 0), inside(2, 0), inside(1, "0/1")]
    got = rows.select(inside(1, 0).alias("a"), *[o.alias(f"b{i}") for i, o in enumerate(others)]).toPandas()
    assert abs(got["a"].mean() - 0.6) < 0.03
    for i in range(len(others)):
        assert 0.4 < (got["a"] != got[f"b{i}"]).mean() < 0.56                               # 0.48 by chance
    far = spark.range(5).select((F.col("id") + (1 << 40)).alias("id")).select(inside(1, 0).alias("a"))
    assert far.count() == 5


def test_early_stop_and_neighbours(obs):
    kw = dict(features=["f_tax", "f_size", "f_spiky"], target="signal", key="k", unique_key=OBS_KEY)
    est = symbolic.SymbolicRegressor(**{**SMALL, "stopping_criteria": 1e9}).fit(obs, **kw)
    assert len(est.details_) == 1
    est = symbolic.SymbolicRegressor(**{**SMALL, "generations": 3, "n_semantic_neighbors": 5, "tie_stopping": 1.1}).fit(obs, **kw)
    assert len(est.details_) == 1 and est.neighbour_log_


def test_classifier(obs):
    df = obs.withColumn("z", F.col("f_size") - 25.5).withColumn("big", (F.col("z") > 0).cast("int"))    # planted
    est = symbolic.SymbolicClassifier(**SMALL).fit(df, ["z", "f_tax"], "big", "k", OBS_KEY)
    out = est.transform(df)
    assert out.filter(F.abs(F.col("probability")[0] + F.col("probability")[1] - 1) > 1e-9).count() == 0
    assert out.filter("prediction = big").count() / out.count() > 0.9
    with pytest.raises(ValueError):
        symbolic.SymbolicClassifier(**SMALL).fit(obs, ["f_size"], "f_tax", "k", OBS_KEY)


def test_transformer(obs):
    est = symbolic.SymbolicTransformer(population_size=40, generations=2, hall_of_fame=12, n_components=3)
    out = est.fit_transform(obs, ["f_tax", "f_size", "f_spiky"], "signal", "k", unique_key=OBS_KEY)
    assert len(est) == 3 and {"S1", "S2", "S3"} <= set(out.columns) and est[0]


def test_islands(obs):
    est = symbolic.SymbolicRegressor(population_size=6, generations=2, seed=1,
                                     islands=symbolic.Islands(deme_size=6, maturation=3, p_gsgp_demes=0.4))
    est.fit(obs, ["f_tax", "f_size", "f_spiky"], "signal", "k", OBS_KEY)
    assert est.population_.count() == 6


def test_wheel_intervals_meet(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(x)) for i, x in enumerate(rng.exponential(size=1000))] + [(1000, None), (1001, -2.0), (1002, float("nan"))]
    pop = spark.createDataFrame(rows, "program_id long, fitness double").repartition(7)
    bounds = population.wheel(pop, F.col("fitness")).cache()
    got = bounds.orderBy("program_id").collect()
    assert [r["lo"] for r in got] == [0.0] + [r["hi"] for r in got[:-1]] and got[-1]["hi"] == 1.0
    assert all(r["lo"] == r["hi"] for r in got[1000:])
    ends = bounds.filter("program_id < 1000").select(F.col("program_id").alias("slot"), F.col("hi").alias("u"))
    drawn = population.spin(bounds, ends, 50).collect()
    assert len(drawn) == 1000 and all(r["slot"] == r["program_id"] for r in drawn)


def test_programs_without_error_take_every_draw(spark):
    pop = spark.createDataFrame([(i, float(abs(i - 3))) for i in range(8)], "program_id long, fitness double")
    draws = spark.createDataFrame([(i, i / 200.0) for i in range(200)], "slot long, u double")
    for choose in (population.roulette_selection, population.sus_selection):
        assert {r["program_id"] for r in choose(pop, draws, 8).collect()} == {3}
    group = pop.select(*[F.lit(0).alias(c) for c in population.GROUP], "*")
    slots = draws.select(*[F.lit(0).alias(c) for c in population.GROUP], "slot", F.lit(0).alias("turn"), "u", F.lit(8).alias("n"))
    for method in ("roulette", "sus"):
        got = breeding.SELECTIONS[method](group, slots, None, False).collect()
        assert len(got) == 200 and {r["chosen"] for r in got} == {3}


def test_wheel_without_positive_shares_is_even(spark):
    pop = spark.createDataFrame([(i, 0.0) for i in range(4)], "program_id long, fitness double")
    got = population.wheel(pop, F.col("fitness")).orderBy("program_id").collect()
    assert [r["hi"] for r in got] == [0.25, 0.5, 0.75, 1.0]
    assert population.wheel(pop.limit(0), F.col("fitness")).count() == 0


SEMANTIC = dict(population_size=30, generations=5, probabilities={"gs_crossover": 0.6, "gs_mutation": 0.3}, selection="tournament",
                tournament_size=3, init_depth=(1, 2), val_share=0.2, seed=11)


@pytest.mark.parametrize("more", [{}, {"max_samples": 0.8, "metric": "rmse", "gsm_ms": 0.3}, {"metric": "pearson", "function_set": (
    "add", "mul", "sqrt"), "generations": 1}])
def test_vectors_give_the_fitness_of_the_trees(obs, more, monkeypatch):
    from tabwright.operators import semantics
    monkeypatch.setattr(semantics, "BLOCK_BYTES", 8 * 30 * 100)                # blocks of a hundred rows
    kw = dict(features=["f_tax", "f_size"], target="signal", key="k", unique_key=OBS_KEY)
    # programs that differ by a factor tie in their correlation, and rounding breaks such ties: one generation there
    trees = symbolic.SymbolicRegressor(**{**SEMANTIC, **more}).fit(obs, **kw)
    vectors = symbolic.SymbolicRegressor(**{**SEMANTIC, **more}, vectors=True).fit(obs, **kw)
    columns = ["program_id", "method", "parent_id", "donor_id", "length", "depth", "raw_fitness", "val_fitness"]
    a, b = (e.population_.select(*columns).toPandas().sort_values("program_id", ignore_index=True) for e in (trees, vectors))
    if "max_samples" not in more:                                              # bags follow the place, which trees do not sort
        pd.testing.assert_frame_equal(a[columns[:6]].fillna(-1), b[columns[:6]].fillna(-1), check_dtype=False)
        np.testing.assert_allclose(b[columns[6:]].to_numpy(float), a[columns[6:]].to_numpy(float), rtol=1e-9)
    if not more:
        got, want = (e.transform(obs).select(*OBS_KEY, "prediction").orderBy(*OBS_KEY).toPandas().prediction for e in (vectors, trees))
        np.testing.assert_allclose(got, want, rtol=1e-9)
    best = b.raw_fitness.max() if vectors._metric.greater_is_better else b.raw_fitness.min()
    train = vectors._rows.filter(~F.col("is_val"))
    if "max_samples" not in more and more.get("metric") != "pearson":
        mae = vectors.transform(train).agg(F.avg(F.abs(F.col("signal") - F.col("prediction")))).first()[0]
        assert mae == pytest.approx(best, rel=1e-9)


def test_vectors_evaluate_each_fresh_program_once(obs, monkeypatch):
    est = symbolic.SymbolicRegressor(**{**SEMANTIC, "generations": 12}, vectors=True).fit(
        obs, ["f_tax", "f_size"], "signal", "k", OBS_KEY)
    last = est.population_.agg(F.max("length")).first()[0]
    stored = sum(len(o.nodes) for origins in est._store.lineage for o in origins)
    assert last > 20 * stored / 12 and est.program_ is None            # the trees would be far larger than what was evaluated
    assert est.transform(obs).filter("prediction is null").count() == 0
    with pytest.raises(ValueError):
        symbolic.SymbolicRegressor(vectors=True).fit(obs, ["f_tax"], "signal", "k", OBS_KEY)
