"""Scoring programs against a target: metrics, and one pass for many programs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.draws import PRIME, coefficients, cubic
from tabwright.functions.protected import BUILT_IN, Scalar
from tabwright.operators.expressions import sigmoid, to_column, to_vector
from tabwright.operators.ordering import running
from tabwright.operators.quality import long_form, pearson
from tabwright.operators.splits import in_bag
from tabwright.session import attach, stage

#: Aggregates per job on the Column path; more would leave code generation.
PER_JOB = 48
#: Nodes shipped to the tasks at once on the Arrow path (a few MB).
BROADCAST_NODES = 200_000
#: Fixed value: probabilities are kept this far from 0 and 1.
CLIP = 1e-15


@dataclass(frozen=True)
class Metric:
    """``column(y, f, w)`` is an aggregate; ``w`` may be a Column with zeros."""

    name: str
    greater_is_better: bool
    column: Callable[[Column, Column, Column], Column]
    moment: str | None = None          # how the Arrow path accumulates it

    @property
    def sign(self) -> int:
        return 1 if self.greater_is_better else -1


def _mean(e: Column, w: Column) -> Column:
    return F.try_divide(F.sum(w * e), F.sum(w))


def _pearson(y: Column, f: Column, w: Column) -> Column:
    """Correlation of (y, f) for 0/1 weights; general weights go through ``score``."""
    keep = w > 0
    r = F.abs(pearson(F.when(keep, y), F.when(keep, f)))
    return F.coalesce(F.when(~F.isnan(r) & _varies(y, keep) & _varies(f, keep), r), F.lit(0.0))


def _varies(e: Column, keep: Column) -> Column:
    """Whether the rows kept have two different values: moments of a constant may leave rounding residue."""
    return F.min(F.when(keep, e)) < F.max(F.when(keep, e))


def _log_loss(y: Column, p: Column, w: Column) -> Column:
    low = F.greatest(p, F.lit(CLIP))
    high = F.greatest(1.0 - p, F.lit(CLIP))
    return _mean(-(y * F.log(low) + (1.0 - y) * F.log(high)), w)


METRICS: dict[str, Metric] = {m.name: m for m in [
    Metric("mean absolute error", False, lambda y, f, w: _mean(F.abs(y - f), w), "abs"),
    Metric("mse", False, lambda y, f, w: _mean((y - f) * (y - f), w), "square"),
    Metric("rmse", False, lambda y, f, w: F.sqrt(_mean((y - f) * (y - f), w)), "root"),
    Metric("log loss", False, _log_loss, "log"),
    Metric("pearson", True, _pearson, "pearson"),
    Metric("spearman", True, None),
]}


def make_fitness(spark, column: Callable, greater_is_better: bool, name: str = "custom") -> Metric:
    """User metric as an aggregate builder ``(y, f, w) -> Column`` (a grouped pandas UDF fits too)."""
    if not isinstance(greater_is_better, bool):
        raise ValueError("greater_is_better must be a bool")
    probe = spark.createDataFrame([(1.0, 2.0, 1.0)] * 2, "y double, f double, w double")
    try:
        agg = column(F.col("y"), F.col("f"), F.col("w"))
    except TypeError as err:
        raise ValueError("a metric takes (y, f, w)") from err
    value = probe.agg(agg.alias("r")).first().r
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError("a metric must give a number")
    return Metric(name, greater_is_better, column)


def metric_of(metric: str | Metric) -> Metric:
    if isinstance(metric, Metric):
        return metric
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    return METRICS[metric]


def score(df: DataFrame, programs: list[tuple[int, list]], features: list[str], target: str,
          metric: str | Metric = "mean absolute error", weight: str | None = None,
          functions: dict[str, Scalar] = BUILT_IN, transform: Callable[[Column], Column] | None = None,
          val: str | None = None, bag: tuple[str, int | str, float] | None = None,
          method: str | None = None) -> DataFrame:
    """Fitness of each program: ``(program_id, raw_fitness[, val_fitness, oob_fitness])``.

    ``val`` names a boolean column: its rows count only for ``val_fitness``. ``bag`` is
    ``(key, seed, share)``: rows outside a program's bag count only for ``oob_fitness``.
    ``method`` is ``columns`` (one aggregate per program) or ``arrow`` (one pass whatever the
    number of programs, the default wherever the metric allows it). Rows must be complete.
    """
    m = metric_of(metric)
    if m.name == "spearman":
        return _spearman(df, programs, features, target, weight, functions, transform, val, bag)
    arrow_ok = m.moment is not None and transform in (None, sigmoid)
    if method is None:
        method = "arrow" if arrow_ok else "columns"
    if method == "arrow":
        if not arrow_ok:
            raise ValueError(f"{m.name} with this output needs method='columns'")
        return _score_arrow(df, programs, features, target, m, weight, functions, transform, val, bag)
    return _score_columns(df, programs, features, target, m, weight, functions, transform, val, bag)


def _parts(weight, val, bag, pid) -> dict[str, Column]:
    """Row weight of each reported fitness."""
    w = F.col(weight) if weight else F.lit(1.0)
    held = F.col(val) if val else None
    bagged = in_bag(bag[0], pid, bag[1], bag[2]) if bag and bag[2] < 1.0 else None
    train = w if held is None else F.when(held, 0.0).otherwise(w)
    out = {"raw_fitness": train if bagged is None else F.when(bagged, train).otherwise(0.0)}
    if val:
        out["val_fitness"] = F.when(held, w).otherwise(0.0)
    if bagged is not None:
        out["oob_fitness"] = F.when(bagged, 0.0).otherwise(train)
    return out


def _score_columns(df, programs, features, target, m, weight, functions, transform, val, bag):
    y = F.col(target).cast("double")
    names = list(_parts(weight, val, bag, 0))
    per = max(1, PER_JOB // len(names))
    frames = []
    for at in range(0, len(programs), per):
        cells, exprs = [], []
        chunk = programs[at:at + per]
        needs_mean = m.name == "pearson" and weight is not None
        outputs = {}
        for pid, nodes in chunk:
            f = to_column(nodes, features, functions)
            outputs[pid] = transform(f) if transform else f
        means = _weighted_means(df, y, outputs, weight, val, bag) if needs_mean else {}
        for i, (pid, _) in enumerate(chunk):
            for name, w in _parts(weight, val, bag, pid).items():
                e = (_centred_pearson(y, outputs[pid], w, *means[(pid, name)]) if needs_mean
                     else m.column(y, outputs[pid], w))
                exprs.append(e.alias(f"{name}_{i}"))
            cells.append((pid, *[F.col(f"{name}_{i}") for name in names]))
        frames.append(long_form(df.agg(*exprs), cells, ["program_id", *names]))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _weighted_means(df, y, outputs, weight, val, bag) -> dict:
    exprs, keys = [], []
    for pid, f in outputs.items():
        for name, w in _parts(weight, val, bag, pid).items():
            keys.append((pid, name))
            exprs += [_mean(y, w), _mean(f, w)]
    row = df.agg(*[e.alias(f"a{i}") for i, e in enumerate(exprs)]).first()
    return {k: (row[2 * i] or 0.0, row[2 * i + 1] or 0.0) for i, k in enumerate(keys)}


def _centred_pearson(y, f, w, my, mf) -> Column:
    a, b = y - my, f - mf
    r = F.abs(F.try_divide(F.sum(w * a * b), F.sqrt(F.sum(w * a * a)) * F.sqrt(F.sum(w * b * b))))
    return F.coalesce(F.when(~F.isnan(r) & _varies(y, w > 0) & _varies(f, w > 0), r), F.lit(0.0))


# --- one pass over Arrow batches -----------------------------------------------------------------


def _chunks_by_nodes(programs: list[tuple[int, list]]):
    held, size = [], 0
    for p in programs:
        if held and size + len(p[1]) > BROADCAST_NODES:
            yield held
            held, size = [], 0
        held.append(p)
        size += len(p[1])
    if held:
        yield held


def _score_arrow(df, programs, features, target, m, weight, functions, transform, val, bag):
    frames = [_arrow_chunk(df, c, features, target, m, weight, functions, transform, val, bag)
              for c in _chunks_by_nodes(programs)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _draw_vector(key: np.ndarray, *parts) -> np.ndarray:
    """The row draw of ``functions.draws.drawn`` on an array."""
    key = key.astype(np.int64)
    return cubic(key % PRIME, (key >> 31) % PRIME, coefficients(*parts)) / float(PRIME)


def _arrow_chunk(df, programs, features, target, m, weight, functions, transform, val, bag):
    used = sorted({n[2] for _, nodes in programs for n in nodes if n[0] == "x"})
    cols = [F.col(features[i]).cast("double").alias(f"x{i}") for i in used]
    rows = df.select(*cols, F.col(target).cast("double").alias("y"),
                     (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
                     (F.col(val) if val else F.lit(False)).alias("v"),
                     (F.col(bag[0]).cast("bigint") if bag else F.lit(0).cast("bigint")).alias("k"))
    names = list(_parts(weight, val, bag, 0))
    d, kind, squash = len(features), m.moment, transform is not None
    sig = BUILT_IN["sig"].vector

    def partial(batches):
        held: dict = {}
        for pdf in batches:
            x = [pdf[f"x{i}"].to_numpy(dtype=float) if i in used else None for i in range(d)]
            y, w = pdf["y"].to_numpy(dtype=float), pdf["w"].to_numpy(dtype=float)
            v, k = pdf["v"].to_numpy(dtype=bool), pdf["k"].to_numpy()
            train = np.where(v, 0.0, w)
            for pid, nodes in programs:
                f = np.broadcast_to(np.asarray(to_vector(nodes, x, functions), dtype=float), y.shape)
                if squash:
                    f = sig(f)
                accumulate(held, pid, kind, y, f, row_weights(pid, train, w, v, k, val, bag))
        if held:
            yield sums_frame(held)

    return fitness(rows.mapInPandas(partial, SUMS), kind, names)


SUMS = "program_id int, part int, sw double, my double, mf double, yy double, ff double, yf double"


def row_weights(pid, train, w, v, k, val, bag) -> list[np.ndarray]:
    """Weights of the rows for each reported fitness of a program, on arrays (see ``_parts``)."""
    masks, inside = [train], None
    if bag and bag[2] < 1.0:
        inside = _draw_vector(k, pid, bag[1]) < bag[2]
        masks = [np.where(inside, train, 0.0)]
    if val:
        masks.append(np.where(v, w, 0.0))
    if inside is not None:
        masks.append(np.where(inside, 0.0, train))
    return masks


def accumulate(held: dict, pid: int, kind: str, y, f, masks: list[np.ndarray]) -> None:
    for part, wt in enumerate(masks):
        held[(pid, part)] = _merge(held.get((pid, part)), _sums(kind, y, f, wt))


def sums_frame(held: dict) -> pd.DataFrame:
    return pd.DataFrame([(p, q, *s) for (p, q), s in held.items()],
                        columns=["program_id", "part", "sw", "my", "mf", "yy", "ff", "yf"])


def fitness(sums: DataFrame, kind: str, names: list[str]) -> DataFrame:
    """Fitness of each program from the sums of all tasks (``SUMS``)."""
    if kind == "pearson":
        # centre every task's sums on the common mean before adding them (rows: programs x tasks)
        g = Window.partitionBy("program_id", "part")
        all_w = F.sum("sw").over(g)
        a = F.col("my") - F.sum(F.col("sw") * F.col("my")).over(g) / all_w
        b = F.col("mf") - F.sum(F.col("sw") * F.col("mf")).over(g) / all_w
        sums = sums.filter("sw > 0").select(
            "program_id", "part", (F.col("sw") * F.col("my") * F.col("my")).alias("y2"),
            (F.col("sw") * F.col("mf") * F.col("mf")).alias("f2"), (F.col("yy") + F.col("sw") * a * a).alias("yy"),
            (F.col("ff") + F.col("sw") * b * b).alias("ff"), (F.col("yf") + F.col("sw") * a * b).alias("yf"))
        r = F.abs(F.try_divide(F.sum("yf"), F.sqrt(F.sum("yy")) * F.sqrt(F.sum("ff"))))
        # below this share of the squared means a variance is the rounding of a constant
        varies = (F.sum("yy") > 1e-26 * F.sum("y2")) & (F.sum("ff") > 1e-26 * F.sum("f2"))
        value = F.coalesce(F.when(~F.isnan(r) & varies, r), F.lit(0.0))
    else:
        value = F.try_divide(F.sum("yf"), F.sum("sw"))
        if kind == "root":
            value = F.sqrt(value)
    by_part = sums.groupBy("program_id", "part").agg(value.alias("s"))
    return by_part.groupBy("program_id").agg(*[
        F.max(F.when(F.col("part") == i, F.col("s"))).alias(n) for i, n in enumerate(names)])


def _sums(kind: str, y, f, w):
    sw = w.sum()
    if sw == 0:
        return (0.0,) * 6
    if kind == "pearson":
        my, mf = np.average(y, weights=w), np.average(f, weights=w)
        a, b = y - my, f - mf
        return (sw, my, mf, (w * a * a).sum(), (w * b * b).sum(), (w * a * b).sum())
    with np.errstate(all="ignore"):
        if kind == "abs":
            e = np.abs(y - f)
        elif kind == "log":
            e = -(y * np.log(np.maximum(f, CLIP)) + (1 - y) * np.log(np.maximum(1 - f, CLIP)))
        else:
            e = np.square(y - f)
        return (sw, 0.0, 0.0, 0.0, 0.0, float((w * e).sum()))


def _merge(a, b):
    """Join the sums of two row sets (centred sums move to the common mean)."""
    if a is None or a[0] == 0:
        return b
    if b[0] == 0:
        return a
    sw = a[0] + b[0]
    dy, df = b[1] - a[1], b[2] - a[2]
    k = a[0] * b[0] / sw
    return (sw, a[1] + dy * b[0] / sw, a[2] + df * b[0] / sw, a[3] + b[3] + k * dy * dy,
            a[4] + b[4] + k * df * df, a[5] + b[5] + k * dy * df)


# --- rank correlation -------------------------------------------------------------------------------


def _spearman(df, programs, features, target, weight, functions, transform, val, bag):
    """All programs, and all parts of their rows, in one ranking: the number of jobs depends on neither (``PER_JOB`` at a time)."""
    groups, entries = [], []
    for pid, nodes in programs:
        f = to_column(nodes, features, functions)
        f = (transform(f) if transform else f).cast("double")
        for name, w in _parts(weight, val, bag, pid).items():
            groups.append((len(groups), pid, name))
            entries.append((f, w.cast("double")))
    table = None
    for k in range(0, len(entries), PER_JOB):
        own = [F.struct(F.lit(k + i).alias("g"), f.alias("f"), w.alias("w")) for i, (f, w) in enumerate(entries[k:k + PER_JOB])]
        some = _rank_correlations(df.select(F.col(target).cast("double").alias("y"), F.explode(F.array(*own)).alias("e")).select(
            "e.g", "y", "e.f", "e.w").filter("w > 0"))
        table = some if table is None else table.unionByName(some)
    names = list(dict.fromkeys(n for *_, n in groups))
    known = df.sparkSession.createDataFrame(groups, "g int, program_id long, part string")
    # one row a program and part
    return known.join(table, "g", "left").groupBy("program_id").agg(
        *[F.max(F.when(F.col("part") == n, F.coalesce("r", F.lit(0.0)))).alias(n) for n in names])


def _ranks(values: DataFrame) -> tuple[DataFrame, dict]:
    """(g, value, n, rank, _pairs) with the average rank of each distinct value inside its group, from
    ``values(g, value, c, _pairs)``, and the rows of each group. One range sort by (g, value) ranks all groups."""
    counts = stage(values.groupBy("g", "value").agg(F.sum("c").cast("bigint").alias("n"), F.sum("_pairs").alias("_pairs")), "values")
    # one number a group
    sizes = {r["g"]: r["n"] for r in counts.groupBy("g").agg(F.sum("n").alias("n")).collect()}
    before, seen = [], 0
    for g in sorted(sizes):
        before.append((g, float(seen)))
        seen += sizes[g]
    run = running(counts, [F.col("g"), F.col("value")], {"_upto": F.col("n").cast("double")})
    starts = df_of(counts, before, "g int, _before double")
    return run.join(F.broadcast(starts), "g").select(
        "g", "value", "n", (F.col("_upto") - F.col("_before") - (F.col("n") - 1) / 2.0).alias("rank"), "_pairs"), sizes


def df_of(like: DataFrame, rows: list, schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def _rank_correlations(pairs: DataFrame) -> DataFrame:
    """(g, r): |weighted correlation of average ranks| in each group of ``pairs(g, y, f, w)``; equal pairs are merged before
    anything moves."""
    merged = stage(pairs.na.drop().groupBy("g", "y", "f").agg(
        F.sum("w").alias("w"), F.count(F.lit(1)).alias("c")), "pairs")
    total = merged.count()
    both = merged.select("c", F.explode(F.array(*[
        F.struct((2 * F.col("g") + i).alias("g"), F.col(v).alias("value")) for i, v in enumerate("yf")])).alias("e")).select(
        "e.g", "e.value", "c", F.lit(1).cast("bigint").alias("_pairs"))
    ranks, sizes = _ranks(both)
    middle = df_of(merged, [(g, (n + 1) / 2.0) for g, n in sizes.items()], "g int, _middle double")
    ranks = stage(ranks.join(F.broadcast(middle), "g").select(
        "g", "value", (F.col("rank") - F.col("_middle")).alias("rank"), "_pairs"), "ranks")
    joined = merged
    for i, v in enumerate("yf"):
        # how many merged pairs share a value decides whether its rank is broadcast
        own = ranks.filter(F.col("g") % 2 == i).select(
            (F.col("g") / 2).cast("int").alias("g"), F.col("value").alias(v), F.col("rank").alias(f"r{v}"), "_pairs")
        joined = attach(joined, own, ["g", v], "_pairs", total).drop("_pairs")
    s = joined.groupBy("g").agg(*[F.sum(e).alias(n) for n, e in {
        "w": F.col("w"), "a": F.col("w") * F.col("ry"), "b": F.col("w") * F.col("rf"),
        "aa": F.col("w") * F.col("ry") * F.col("ry"), "bb": F.col("w") * F.col("rf") * F.col("rf"),
        "ab": F.col("w") * F.col("ry") * F.col("rf")}.items()])
    c = F.col
    top = c("ab") - c("a") * c("b") / c("w")
    low = (c("aa") - c("a") * c("a") / c("w")) * (c("bb") - c("b") * c("b") / c("w"))
    return s.select("g", F.when(low > 0, F.abs(top / F.sqrt(low))).otherwise(0.0).alias("r"))


def _ranked(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns replaced by their average ranks, over the rows that have a value in all of them; one ranking for all."""
    rows = stage(df.na.drop().select(F.monotonically_increasing_id().alias("_id"), *names), "outputs")
    long = rows.select("_id", F.posexplode(F.array(*names)).alias("g", "value"))
    ranks, _ = _ranks(long.select("g", "value", F.lit(1).alias("c"), F.lit(1).cast("bigint").alias("_pairs")))
    placed = attach(long, stage(ranks.select("g", "value", "rank", "n"), "ranks"), ["g", "value"], "n",
                    max(1, rows.count() * len(names)))
    wide = placed.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("g", "rank"))).alias("_r"))
    return wide.select(*[F.col("_r")[i]["rank"].alias(n) for i, n in enumerate(names)])


def program_correlations(df: DataFrame, programs: list[tuple[int, list]], features: list[str],
                         functions: dict[str, Scalar] = BUILT_IN, ranks: bool = False) -> np.ndarray:
    """|correlation| between the outputs of every pair of programs, from one moments pass; ``ranks``: of their ranks, over the
    rows where every program has a value."""
    from tabwright.operators.gram import moments
    names = [f"p{i}" for i in range(len(programs))]
    out = df.select(*[to_column(p, features, functions).cast("double").alias(n)
                      for n, (_, p) in zip(names, programs)])
    if ranks:
        out = _ranked(out, names)
    s = moments(out, names).scatter()
    d = np.sqrt(np.clip(np.diag(s), 0.0, None))
    with np.errstate(all="ignore"):
        corr = np.abs(s / np.outer(d, d))
    corr = np.nan_to_num(corr, nan=0.0, posinf=0.0)
    np.fill_diagonal(corr, 1.0)
    return corr
