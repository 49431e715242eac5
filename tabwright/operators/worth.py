"""How much each feature says about the target: statistics, ranks, votes, pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.tails import chi2_p, t_p
from tabwright.operators.columns import merge_reports
from tabwright.operators.gram import Moments, inverse, moments, solve
from tabwright.operators.quality import distinct_counts, report
from tabwright.operators.quantiles import quantiles
from tabwright.operators.scaling import (PowerModel, equal_width_bins, fit_minmax, power_bins,
                                         quantile_edges, right_closed)
from tabwright.session import stage

MAX_BIN = 10
FORCE_BIN = 3
VALID_P = 0.05


def average_rank(table: DataFrame, value: str, out: str, descending: bool = True,
                 truncate: bool = True) -> DataFrame:
    """Rank of a report table (one row per feature): ties share their mean rank, truncated."""
    col = F.col(value)
    w = Window.orderBy(col.desc() if descending else col.asc())
    doubled = 2 * F.rank().over(w) + F.count(F.lit(1)).over(Window.partitionBy(col)) - 1
    return table.withColumn(out, F.floor(doubled / 2).cast("bigint") if truncate else doubled / 2.0)


# --- chi squared --------------------------------------------------------------------------------


def chi_squared(long: DataFrame, keys: list[str], left: str = "bin", right: str = "t") -> DataFrame:
    """Statistic and degrees of freedom per key from a long (keys, left, right) table.

    Counts first, then ``n * sum(o*o / (row * column)) - n``; neither margin is ever gathered
    in one place. A 2 x 2 table gets the half-unit continuity correction.
    """
    counts = long.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(
        *keys, left, right).agg(F.count(F.lit(1)).alias("o"))
    rows = counts.groupBy(*keys, left).agg(F.sum("o").alias("row"))
    cells = counts.join(rows, [*keys, left])
    cols = cells.groupBy(*keys, right).agg(
        F.sum(F.col("o") * F.col("o") / F.col("row")).alias("q"), F.sum("o").alias("col"))
    by_key = cols.groupBy(*keys).agg(
        F.sum(F.col("q") / F.col("col")).alias("share"), F.sum("col").alias("n"),
        F.count(F.lit(1)).alias("n_cols"), F.sum(1.0 / F.col("col")).alias("inv_cols"))
    by_row = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(1.0 / F.col("row")).alias("inv_rows"))
    both = by_key.join(by_row, keys)
    plain = F.greatest(F.col("n") * F.col("share") - F.col("n"), F.lit(0.0))
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    unit = F.col("n") * F.col("inv_rows") * F.col("inv_cols")
    gap = F.sqrt(plain / unit) - 0.5
    return both.select(*keys, F.when(dof == 1, gap * gap * unit).otherwise(plain).alias("chi2"),
                       dof.alias("dof"))


def binned_long(df: DataFrame, bins: list[Column], target: str) -> DataFrame:
    """(which, bin, t) rows for all binned columns at once; ``which`` is the place in the list."""
    cells = F.array(*[F.struct(F.lit(i).alias("which"), b.alias("bin")) for i, b in enumerate(bins)])
    return df.select(F.explode(cells).alias("s"), F.col(target).alias("t")).select("s.which", "s.bin", "t")


def chisq_rank(df: DataFrame, continuous: list[str], target: str, categorical: list[str] = (),
               n_bins: int = 10, strategy: str = "uniform") -> DataFrame:
    """chi2, p, validity and rank of each feature against the raw target values."""
    rows = df.filter(F.col(target).isNotNull())
    if strategy == "uniform":
        bins = equal_width_bins(rows, continuous, n_bins) if continuous else {}
    else:
        edges = quantile_edges(rows, continuous, n_bins) if continuous else {}
        bins = {c: right_closed(F.col(c), e) for c, e in edges.items()}
    if categorical:
        bins = {c: b.cast("string") for c, b in bins.items()}
        bins.update({c: F.col(c).cast("string") for c in categorical})
    stat = chi_squared(binned_long(rows, list(bins.values()), target), ["which"])
    names = F.array(*[F.lit(c) for c in bins])
    full = stat.select(F.element_at(names, F.col("which") + 1).alias("feature"), "chi2", "dof").withColumn(
        "p", chi2_p(F.col("chi2"), F.col("dof").cast("double"))).withColumn("valid", F.col("p") <= VALID_P)
    return average_rank(full, "chi2", "rank")


def best_powers(df: DataFrame, cols: list[str], target: str, n_bins: int = 10):
    """The transform with the largest chi2 per scaled feature: ``(model, table)``."""
    scaler = fit_minmax(df, cols)
    tried = [(c, name, b) for c in scaler.ranges
             for name, b in power_bins(scaler.column(c), n_bins).items()]
    long = binned_long(df.filter(F.col(target).isNotNull()), [b for *_, b in tried], target)
    stats = {r.which: r.chi2 for r in chi_squared(long, ["which"]).collect()}     # one per transform
    best: dict[str, tuple] = {}
    for i, (c, name, _) in enumerate(tried):
        if i in stats and (c not in best or stats[i] > best[c][1]):
            best[c] = (name, stats[i])
    table = report(df.sparkSession, [(c, *v) for c, v in best.items()],
                   "feature string, power string, chi2 double")
    return PowerModel(scaler, {c: v[0] for c, v in best.items()}), table


# --- one regression per feature --------------------------------------------------------------------


def univariate_ols(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """R2, slope, p of the slope and rank of a one-variable regression per feature."""
    rows = []
    for i in range(0, len(cols), 15):
        part = cols[i:i + 15]
        got = df.agg(*[e for c in part for e in (
            F.regr_r2(target, c), F.regr_slope(target, c), F.regr_count(target, c))]).first()
        rows += [(c, *got[3 * j:3 * j + 3]) for j, c in enumerate(part)]
    table = report(df.sparkSession, rows, "feature string, r2 double, slope double, n bigint")
    r2, dof = F.col("r2"), (F.col("n") - 2).cast("double")
    t = F.when(r2 < 1, F.sqrt(r2 * dof / (1 - r2)))
    full = table.select("feature", "r2", F.round("slope", 3).alias("slope"),
                        F.coalesce(t_p(t, dof), F.when(r2 >= 1, F.lit(0.0))).alias("p"))
    return average_rank(full.withColumn("valid", F.col("p") <= VALID_P), "r2", "rank")


# --- weight of evidence ------------------------------------------------------------------------------


def _evidence(bins: DataFrame) -> DataFrame:
    """Rates, shares, weight of evidence and information value from (var_name, ..., count, event)."""
    b = bins.withColumn("nonevent", F.col("count") - F.col("event"))
    sums = b.groupBy("var_name").agg(F.sum("event").alias("_e"), F.sum("nonevent").alias("_n"))
    b = b.join(F.broadcast(sums), "var_name")      # one row per variable
    de = F.when(F.col("_e") != 0, F.col("event") / F.col("_e"))
    dn = F.when(F.col("_n") != 0, F.col("nonevent") / F.col("_n"))
    b = b.withColumns({"event_rate": F.col("event") / F.col("count"),
                       "non_event_rate": F.col("nonevent") / F.col("count"),
                       "dist_event": de, "dist_non_event": dn})
    ratio = F.when((F.col("dist_event") > 0) & (F.col("dist_non_event") > 0),
                   F.log(F.col("dist_event") / F.col("dist_non_event")))
    one_sided = ((F.col("dist_event") == 0) & (F.col("dist_non_event") > 0)) | (
        (F.col("dist_non_event") == 0) & (F.col("dist_event") > 0))
    b = b.withColumn("woe", F.when(one_sided, 0.0).otherwise(ratio))
    b = b.withColumn("_iv", F.when(one_sided, 0.0).otherwise(
        (F.col("dist_event") - F.col("dist_non_event")) * ratio))
    iv = b.groupBy("var_name").agg(F.coalesce(F.sum("_iv"), F.lit(0.0)).alias("iv"))
    return b.join(F.broadcast(iv), "var_name").select(
        "var_name", "category", "min_value", "max_value", "count", "event", "event_rate", "nonevent",
        "non_event_rate", "dist_event", "dist_non_event", "woe", "iv")


def _forced_edges(at: dict[float, float]) -> list[float]:
    """Fallback edges at minimum, median and maximum, with the fixed rule for coinciding ones."""
    edges = [at[0.0], at[0.5], at[1.0]]
    if len(set(edges)) == 2:
        edges = [1.0, edges[0] / 2.0, edges[1], edges[2]]
    return sorted(set(edges))


def _place_sums(df: DataFrame, cols: list[str], points: list[np.ndarray], target: str) -> DataFrame:
    """Rows, events and extremes of each column (``which``) by place: 0 for NULL, 2i + 2 at point i, odd ones between points."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [2 * len(p) + 2 for p in points]
        held = [(np.zeros(n, dtype=np.int64), np.zeros(n), np.full(n, np.nan), np.full(n, -np.inf)) for n in sizes]
        for batch in batches:
            y = batch.column(len(points)).to_numpy(zero_copy_only=False)
            for j, (count, event, low, high) in enumerate(held):
                column = batch.column(j)
                x = column.to_numpy(zero_copy_only=False)
                place = 1 + np.searchsorted(points[j], x, "left") + np.searchsorted(points[j], x, "right")
                place[column.is_null().to_numpy(zero_copy_only=False)] = 0
                order = place.astype(np.int16).argsort(kind="stable")
                found, first = np.unique(place[order], return_index=True)
                count += np.bincount(place, minlength=sizes[j])
                event += np.bincount(place, y, sizes[j])
                low[found] = np.fmin(low[found], np.fmin.reduceat(x[order], first))
                high[found] = np.maximum(high[found], np.maximum.reduceat(x[order], first))
        for j, (count, event, low, high) in enumerate(held):
            own = np.flatnonzero(count)
            none = own == 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(own), j, dtype=np.int32)), pa.array(own.astype(np.int32)), pa.array(count[own]),
                 pa.array(event[own]), pa.array(low[own], mask=none), pa.array(high[own], mask=none)],
                ["which", "place", "count", "event", "min_value", "max_value"])

    rows = df.filter(F.col(target).isNotNull()).select(
        *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(cols)], F.col(target).cast("double").alias("y"))
    return rows.mapInArrow(run, "which int, place int, count long, event double, min_value double, max_value double").groupBy(
        "which", "place").agg(F.sum("count").alias("count"), F.sum("event").alias("event"),
                              F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"))


def _bins_of_places(points: np.ndarray, edges: list[float]) -> list[int | None]:
    """For each place the bin that ``right_closed`` gives its values, or 0 for all of them if there is one edge only."""
    if len(edges) == 1:
        return [None] + [0] * (2 * len(points) + 1)
    below = np.searchsorted(edges, points, "left")             # edges below each point
    below[points == edges[0]] = 1                              # the first edge belongs to the first bin
    between = np.searchsorted(edges, points, "right")          # edges below what follows each point
    at = [0, *np.stack([below, between], axis=1).ravel().tolist()]
    return [None] + [b - 1 if 0 < b < len(edges) else None for b in at]


def monotone_bins(df: DataFrame, cols: list[str], target: str, max_bin: int = MAX_BIN) -> DataFrame:
    """Counts and events in the finest quantile bins whose mean targets are strictly monotone.

    All bin numbers of all features are tried in one pass: each task sums its rows between and at the edges of all bin numbers
    of a feature, and bins are put together from these sums.
    """
    probs = sorted({i / n for n in range(1, max_bin + 1) for i in range(n + 1)})
    q = quantiles(df, cols, probs)
    tried = []
    for c in cols:
        at = dict(zip(probs, q[c]))
        if at[0.0] is None:
            continue
        fine = [[at[i / n] for i in range(n + 1)] for n in range(2, max_bin + 1)]
        tried.append((c, [(1, _forced_edges(at)), *((len(e) - 1, e) for e in fine if len(set(e)) == len(e))]))
    points = [np.unique(np.concatenate([e for _, e in kinds])) for _, kinds in tried]
    sums = stage(_place_sums(df, [c for c, _ in tried], points, target), "places")
    places = [(i, p, c, n, b) for i, (c, kinds) in enumerate(tried)
              for n, at in [(0, [0] + [None] * (2 * len(points[i]) + 1)), *((n, _bins_of_places(points[i], e)) for n, e in kinds)]
              for p, b in enumerate(at) if b is not None]
    # at most a few hundred places per feature
    grouped = sums.join(F.broadcast(report(df.sparkSession, places, "which int, place int, var_name string, bins int, bin int")),
                        ["which", "place"]).groupBy("var_name", "bins", "bin").agg(
        F.sum("count").alias("count"), F.sum("event").alias("event"), F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"))
    # at most max_bin rows per (feature, bin number)
    w = Window.partitionBy("var_name", "bins").orderBy("bin")
    step = F.col("event") / F.col("count") - F.lag(F.col("event") / F.col("count")).over(w)
    verdict = grouped.withColumn("step", step).groupBy("var_name", "bins").agg(
        F.count(F.lit(1)).alias("found"), F.count_if(F.col("step") > 0).alias("up"),
        F.count_if(F.col("step") < 0).alias("down"))
    steps = F.col("found") - 1
    fine = (F.col("bins") > 1) & ((F.col("up") == steps) | (F.col("down") == steps)
                                  | (F.col("up") + F.col("down") == 0)
                                  | (F.col("found") < F.col("bins")))
    chosen = verdict.groupBy("var_name").agg(
        F.coalesce(F.max(F.when(fine, F.col("bins"))), F.lit(1)).alias("chosen"))
    return grouped.join(F.broadcast(chosen), "var_name").filter(
        (F.col("bins") == F.col("chosen")) | (F.col("bins") == 0)).select(
        "var_name", F.lit(None).cast("string").alias("category"), "min_value", "max_value",
        "count", "event")


def value_bins(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """One bin per value, and one for the missing."""
    cells = F.array(*[F.struct(F.lit(c).alias("var_name"), F.col(c).cast("string").alias("category"))
                      for c in cols])
    long = df.filter(F.col(target).isNotNull()).select(
        F.explode(cells).alias("s"), F.col(target).cast("double").alias("y")).select("s.*", "y")
    none = F.lit(None).cast("double")
    return long.groupBy("var_name", "category").agg(
        F.count(F.lit(1)).alias("count"), F.sum("y").alias("event")).select(
        "var_name", "category", none.alias("min_value"), none.alias("max_value"), "count", "event")


def mono_bin(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    return _evidence(monotone_bins(df, cols, target))


def char_bin(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    return _evidence(value_bins(df, cols, target))


def data_vars(df: DataFrame, cols: list[str], target: str) -> tuple[DataFrame, DataFrame]:
    """Bin table of all features and their information values; the target must be 0/1."""
    bad = df.filter(~F.col(target).isin(0, 1)).limit(1).count()
    if bad:
        raise ValueError(f"{target} must be 0/1; see binarise()")
    numeric = [f.name for f in df.schema.fields if f.name in cols and f.dataType.typeName() in
               ("double", "float", "integer", "long", "short", "byte")]
    many = distinct_counts(df, numeric, more_than=2) if numeric else {}
    smooth = [c for c in numeric if many[c] > 2]
    plain = [c for c in cols if c not in smooth]
    parts = ([monotone_bins(df, smooth, target)] if smooth else []) + (
        [value_bins(df, plain, target)] if plain else [])
    bins = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    table = _evidence(bins)
    return table, table.groupBy("var_name").agg(F.max("iv").alias("iv"))


def binarise(df: DataFrame, target: str, out: str) -> DataFrame:
    """0/1 target: above the median or not."""
    mid = quantiles(df, [target], [0.5])[target][0]
    return df.withColumn(out, F.when(F.col(target).isNotNull(), (F.col(target) > mid).cast("double")))


# --- elimination, voting and pruning on d-by-d numbers ---------------------------------------------------


def rfe_order(m: Moments, features: list[str], target: str, ranges: dict | None = None) -> list[str]:
    """Features from the last one eliminated to the first: drop the smallest squared coefficient."""
    left = list(features)
    gone = []
    scale = {c: (ranges[c][1] - ranges[c][0]) if ranges else 1.0 for c in features}
    while len(left) > 1:
        s = m.pick(left + [target]).scatter()
        k = len(left)
        b = solve(s[:k, :k], s[:k, k]) * np.array([scale[c] for c in left])
        worst = left[int(np.argmin(b * b))]
        left.remove(worst)
        gone.append(worst)
    return left + gone[::-1]


def rfe(df: DataFrame, features: list[str], target: str, n_features: int = 1) -> DataFrame:
    """Elimination ranking of min-max scaled features: 1 for the ``n_features`` kept."""
    m = moments(df, [*features, target])
    full = df.na.drop(subset=[*features, target])
    order = rfe_order(m, features, target, fit_minmax(full, features).ranges)
    rows = [(c, max(1, i + 2 - n_features)) for i, c in enumerate(order)]
    return report(df.sparkSession, rows, "feature string, rank bigint")


def vif_values(m: Moments) -> dict[str, float | None]:
    g = m.raw()
    inv = inverse(g)
    return {c: (float(g[i, i] * inv[i, i]) if inv is not None else None)
            for i, c in enumerate(m.names)}


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """Variance inflation of each column against the others, without intercept."""
    return report(df.sparkSession, list(vif_values(moments(df, cols)).items()),
                  "feature string, vif double")


def vif_prune(m: Moments, limit: float = 10.0) -> list[str]:
    """Drop the most inflated column while any exceeds ``limit``; no further pass is needed."""
    kept = list(m.names)
    while len(kept) > 1:
        v = vif_values(m.pick(kept))
        scored = {c: float("inf") if x is None else x for c, x in v.items()}
        worst = max(kept, key=lambda c: scored[c])
        if scored[worst] <= limit:
            break
        kept.remove(worst)
    return kept


def correlation_prune(corr: dict[tuple[str, str], float], ordered: list[str], not_valid: list[str] = (),
                      limit: float = 0.7, absolute: bool = False, drop_last: bool = True) -> list[str]:
    """Walk features in vote order and drop every later one correlated at or above ``limit``.

    Dropped features still drop others; the last one kept is removed too (``drop_last``).
    """
    out = dict.fromkeys(ordered, True)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1:]:
            r = corr.get((a, b), corr.get((b, a)))
            if r is not None and (abs(r) if absolute else r) >= limit:
                out[b] = False
    kept = [c for c in ordered if out[c]]
    if drop_last:
        kept = kept[:-1]
    return [c for c in kept if c not in set(not_valid)]


def vote(ranks: dict[str, DataFrame], valid: DataFrame | None = None) -> DataFrame:
    """Sum of per-method ranks, ranked again; tables hold (feature, rank)."""
    merged = merge_reports([t.select("feature", F.col("rank").alias(n)) for n, t in ranks.items()])
    total = None
    for n in ranks:
        total = F.col(n) if total is None else total + F.col(n)
    out = average_rank(merged.withColumn("_sum", total), "_sum", "ranking", descending=False).drop("_sum")
    if valid is not None:
        out = out.join(valid.select("feature", "valid"), "feature", "left")
    return out.orderBy("ranking", "feature")
