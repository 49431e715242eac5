"""Operators on a table of scored programs: penalties, summaries, selection, stopping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.protected import BUILT_IN
from tabwright.operators.expressions import gs_mutation_tanh, to_column
from tabwright.operators.ordering import running
from tabwright.operators.scoring import metric_of

GROUP = ["run_seed", "deme"]


def penalise(pop: DataFrame, coefficient, greater_is_better: bool = False) -> DataFrame:
    """fitness = raw - coefficient * length * sign: longer is worse either way."""
    c = coefficient if isinstance(coefficient, Column) else F.lit(float(coefficient))
    sign = 1 if greater_is_better else -1
    return pop.withColumn("fitness", F.col("raw_fitness") - c * F.col("length") * sign)


def auto_parsimony(pop: DataFrame, group: list[str] = ()) -> DataFrame:
    """cov(length, fitness) / var(length): sample covariance over population variance."""
    return pop.groupBy(*group).agg(F.try_divide(
        F.covar_samp("length", "raw_fitness"), F.var_pop("length")).alias("coefficient"))


def penalise_auto(pop: DataFrame, group: list[str], greater_is_better: bool = False) -> DataFrame:
    coef = auto_parsimony(pop, group)
    joined = pop.join(F.broadcast(coef), list(group)) if group else pop.withColumn(
        "coefficient", F.lit(coef.first()[0]))
    return penalise(joined, F.coalesce(F.col("coefficient"), F.lit(0.0)), greater_is_better).drop("coefficient")


def _best(score: str, greater: bool) -> Column:
    return F.struct((F.col(score) * (-1 if greater else 1)).alias("s"), F.col("program_id").alias("i"))


def summary(pop: DataFrame, group: list[str] = (), greater_is_better: bool = False) -> DataFrame:
    """Average length and fitness, and the best program's numbers; the first id wins ties."""
    extra = [c for c in ("val_fitness", "oob_fitness") if c in pop.columns]
    picked = F.struct("program_id", "length", "raw_fitness", *extra)
    out = pop.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_programs"), F.avg("length").alias("average_length"),
        F.avg("raw_fitness").alias("average_fitness"),
        F.min_by(picked, _best("raw_fitness", greater_is_better)).alias("b"))
    return out.select(*group, "n_programs", "average_length", "average_fitness",
                      F.col("b.program_id").alias("best_id"), F.col("b.length").alias("best_length"),
                      F.col("b.raw_fitness").alias("best_fitness"),
                      *[F.col(f"b.{c}").alias(f"best_{c}") for c in extra])


def hall_of_fame(pop: DataFrame, k: int, greater_is_better: bool = False) -> DataFrame:
    order = F.col("fitness").desc() if greater_is_better else F.col("fitness").asc()
    return pop.orderBy(order, "program_id").limit(k)


# --- wheels: cumulative shares and draws ----------------------------------------------------------


def _better(greater: bool) -> Column:
    return F.col("fitness") if greater else F.try_divide(F.lit(1.0), F.col("fitness"))


def _share(pop: DataFrame, greater: bool) -> Column:
    """Part of the wheel: the fitness, or one over the error. Programs without error share the whole wheel."""
    if greater or not pop.filter("fitness = 0").limit(1).count():
        return _better(greater)
    return F.when(F.col("fitness") == 0, 1.0).otherwise(0.0)


def ordinal_ranks(pop: DataFrame, greater_is_better: bool = False) -> DataFrame:
    """Position from the worst (1) to the best; the smaller id ranks lower on ties."""
    worst_first = F.col("fitness").asc() if greater_is_better else F.col("fitness").desc()
    return running(pop, [worst_first, F.col("program_id")], position="rank")


def wheel_part(share: Column) -> Column:
    """A share as it counts on a wheel: missing, undefined and negative shares have no part."""
    return F.greatest(F.coalesce(F.nanvl(share.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def wheel(pop: DataFrame, share: Column, order: str = "program_id") -> DataFrame:
    """Interval ``(lo, hi]`` of each program on [0, 1], proportional to ``share``, in id order.

    Each interval begins exactly where the one before ends, and the last one ends at 1. Missing and negative
    shares give empty intervals; where no share is positive all programs get the same.
    """
    parts = pop.withColumn("_s", wheel_part(share))
    total = parts.agg(F.sum("_s")).first()[0]
    if total == 0:
        return wheel(pop, F.lit(1.0), order)
    up = running(parts, [F.col(order)], {"_hi": F.col("_s")})
    top = up.agg(F.max("_hi")).first()[0]            # may differ from the total in its last digit
    before = up.select((F.col("position") + 1).alias("position"), F.col("_hi").alias("_lo"))
    place = lambda c: F.when(F.col(c) == F.lit(top), 1.0).otherwise(F.col(c) / F.lit(total))          # noqa: E731
    return up.join(before, "position", "left").withColumns(
        {"lo": F.coalesce(place("_lo"), F.lit(0.0)), "hi": place("_hi")}).drop("_lo", "_hi", "_s", "position")


def spin(bounds: DataFrame, draws: DataFrame, slots: int | Column, keep: list[str] = ("program_id",),
         group: list[str] = ()) -> DataFrame:
    """For every draw ``u`` the program whose interval holds it: ``lo < u <= hi``.

    [0, 1] is cut into ``slots`` equal cells; intervals are laid over the cells they touch and
    draws fall into one, so the range condition becomes an equi-join on the cell. ``slots`` may be
    a column present on both sides.
    """
    slots = slots if isinstance(slots, Column) else F.lit(slots)
    cell = F.least(F.floor(F.col("u") * slots), slots - 1).cast("int")
    span = F.sequence(F.greatest(F.floor(F.col("lo") * slots) - 1, F.lit(0)).cast("int"),
                      F.least(F.floor(F.col("hi") * slots) + 1, slots - 1).cast("int"))
    laid = bounds.select(*group, *keep, "lo", "hi", F.explode(span).alias("_cell"))
    inside = (F.col("u") > F.col("lo")) & (F.col("u") <= F.col("hi")) | (
        (F.col("u") == 0) & (F.col("lo") == 0) & (F.col("hi") > 0))
    return draws.withColumn("_cell", cell).join(laid, [*group, "_cell"]).filter(inside).drop(
        "_cell", "lo", "hi")


def rank_selection(pop: DataFrame, draws: DataFrame, n: int, greater_is_better: bool = False) -> DataFrame:
    """(slot, u, program_id): probability proportional to the ordinal rank."""
    return spin(wheel(ordinal_ranks(pop, greater_is_better), F.col("rank")), draws, n)


def roulette_selection(pop: DataFrame, draws: DataFrame, n: int, greater_is_better: bool = False) -> DataFrame:
    return spin(wheel(pop, _share(pop, greater_is_better)), draws, n)


def sus_selection(pop: DataFrame, draws: DataFrame, n: int, greater_is_better: bool = False,
                  pointers: int = 5) -> DataFrame:
    """Stochastic universal sampling; only the first of the equally spaced pointers is used."""
    return spin(wheel(pop, _share(pop, greater_is_better)), draws.withColumn("u", F.col("u") / pointers), n)


def numbered(pop: DataFrame) -> DataFrame:
    """Programs with their 0-based place in id order."""
    return running(pop, [F.col("program_id")]).withColumn("place", F.col("position") - 1).drop("position")


def tournament(pop: DataFrame, contenders: DataFrame, by: str = "fitness",
               greater_is_better: bool = False) -> DataFrame:
    """(slot, program_id): the best of each slot's contenders (``slot, place`` rows).

    ``by`` may be ``length`` or ``depth``, where smaller always wins.
    """
    greater = greater_is_better and by == "fitness"
    entry = numbered(pop).select("place", "program_id", by)
    return contenders.join(entry, "place").groupBy("slot").agg(
        F.min_by("program_id", _best(by, greater)).alias("program_id"))


def random_selection(pop: DataFrame, draws: DataFrame, n: int) -> DataFrame:
    placed = draws.withColumn("place", F.least(F.floor(F.col("u") * n), F.lit(n - 1)))
    return placed.join(numbered(pop).select("place", "program_id"), "place").drop("place")


def bloat_control(pop: DataFrame, k: int, greater_is_better: bool = False) -> DataFrame:
    """The fittest of the k shortest programs."""
    short = pop.orderBy("length", "program_id").limit(k)
    return short.agg(F.min_by(F.struct("program_id", "length", "fitness"),
                              _best("fitness", greater_is_better)).alias("b")).select("b.*")


# --- stopping, history, components -------------------------------------------------------------------


def neighbour_statistics(df: DataFrame, elite: list, neighbours: list[tuple[list, float]],
                         features: list[str], target: str, metric="mean absolute error",
                         functions=BUILT_IN, weight: str | None = None, per_job: int = 20) -> DataFrame:
    """Share of semantic neighbours better than the elite, and of those the share whose absolute
    error varies less. Each neighbour is the elite mutated by (random program, step)."""
    m = metric_of(metric)
    y = F.col(target).cast("double")
    w = F.col(weight) if weight else F.lit(1.0)
    base = to_column(elite, features, functions)
    outs = [base] + [gs_mutation_tanh(base, to_column(p, features, functions), s) for p, s in neighbours]
    found = []
    for at in range(0, len(outs), per_job):
        row = df.agg(*[e.alias(f"a{at}_{i}_{j}") for i, f in enumerate(outs[at:at + per_job])
                       for j, e in enumerate((m.column(y, f, w), F.stddev_samp(F.abs(f - y))))]).first()
        found += [(row[2 * i], row[2 * i + 1]) for i in range(len(row) // 2)]
    (fit, spread), rest = found[0], found[1:]
    better = [(a, b) for a, b in rest if (a > fit if m.greater_is_better else a < fit)]
    steadier = sum(b < spread for _, b in better)
    return df.sparkSession.createDataFrame(
        [(len(rest), len(better), steadier, len(better) / len(rest) if rest else None,
          steadier / len(better) if better else None)],
        "n bigint, n_better bigint, n_steadier bigint, tie double, edv double")


def prune_ancestors(history: DataFrame, generation: int) -> DataFrame:
    """Programs of one generation that a later generation names as parent or donor."""
    group = [c for c in GROUP if c in history.columns]
    later = history.filter(F.col("generation") == generation + 1)
    used = later.select(*group, F.explode(F.array("parent_id", "donor_id")).alias("program_id")).filter(
        "program_id is not null").distinct()
    return history.filter(F.col("generation") == generation).join(used, [*group, "program_id"], "left_semi")


def reached(summary_row, stopping: float, greater_is_better: bool = False) -> bool:
    best = summary_row["best_fitness"]
    return best is not None and (best >= stopping if greater_is_better else best <= stopping)


def decorrelated(corr: np.ndarray, n_components: int) -> list[int]:
    """Indices left after dropping, again and again, the less fit of the most alike pair.
    Rows come in fitness order, so the later index of a pair is the less fit."""
    left = list(range(len(corr)))
    c = corr.copy()
    np.fill_diagonal(c, -1.0)
    while len(left) > n_components:
        sub = c[np.ix_(left, left)]
        i, j = np.unravel_index(np.argmax(sub), sub.shape)
        left.pop(int(max(i, j)))
    return left
