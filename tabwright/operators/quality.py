"""Profiling aggregates over a wide table; each report has one row per column or group."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.operators.quantiles import quantiles

#: Share of missing cells (in percent) above which a column is flagged.
MISSING_LIMIT = 3.0


def report(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A report table from driver-held numbers (its size is fixed by the column list)."""
    return spark.createDataFrame(rows, schema)


def long_form(df: DataFrame, cells: list[tuple], names: list[str]) -> DataFrame:
    """Turn a one-row aggregate into rows; each cell is (constant, ..., column)."""
    made = [F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n)
                       for v, n in zip(cell, names)]) for cell in cells]
    return df.select(F.explode(F.array(*made)).alias("c")).select("c.*")


def missing_report(df: DataFrame, cols: list[str] | None = None,
                   limit: float = MISSING_LIMIT) -> DataFrame:
    cols = cols or df.columns
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    rows = long_form(one, [(c, F.col(c), F.col("_n")) for c in cols], ["feature", "n_missing", "n"])
    share = 100.0 * F.col("n_missing") / F.col("n")
    return rows.filter("n_missing > 0").select(
        "feature", "n_missing", F.round(share, 2).alias("pct_missing"),
        (share > limit).alias("above_threshold"))


def describe(df: DataFrame, cols: list[str], probs: list[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """count, mean, std, min, percentiles and max of each column (percentile columns ``p25``..)."""
    probs = list(probs)
    stats = []
    for i in range(0, len(cols), 10):
        part = cols[i:i + 10]
        row = df.agg(*[e for c in part for e in (
            F.count(c), F.avg(c), F.stddev_samp(c),
            F.min(c).cast("double"), F.max(c).cast("double"))]).first()
        stats += [tuple(row[5 * j:5 * j + 5]) for j in range(len(part))]
    q = quantiles(df, cols, probs, counts={c: r[0] for c, r in zip(cols, stats)})
    rows = [(c, n, mean, std, low, *q[c], high)
            for c, (n, mean, std, low, high) in zip(cols, stats)]
    names = ", ".join(f"p{round(p * 100)} double" for p in probs)
    return report(df.sparkSession, rows, "feature string, count bigint, mean double, std double, "
                                         f"min double, {names}, max double")


def quantile_report(df: DataFrame, cols: list[str],
                    probs: list[float] = (0.2, 0.4, 0.5, 0.6, 0.8)) -> DataFrame:
    q = quantiles(df, cols, list(probs))
    return report(df.sparkSession, [(c, float(p), v) for c in cols for p, v in zip(probs, q[c])],
                  "feature string, prob double, value double")


def target_rate(df: DataFrame, target: str) -> DataFrame:
    return df.agg(F.round(F.avg(target), 2).alias("target_rate"))


def pearson(a, b) -> Column:
    """Correlation over the rows where both are present; NULL when either is constant there."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlations(df: DataFrame, cols: list[str], digits: int | None = None) -> DataFrame:
    """Pearson correlation of every column pair (pairwise complete rows), long form.

    One pass for all pairs: tasks multiply their Arrow batches (values about the column mean,
    and presence masks) and emit one small matrix each.
    """
    cols = list(cols)
    d = len(cols)
    means = df.agg(*[F.avg(c) for c in cols]).first()
    centre = np.array([0.0 if m is None else float(m) for m in means])
    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])

    def partial(batches):
        held = np.zeros((4, d, d))
        for pdf in batches:
            z = pdf.to_numpy(dtype=float) - centre
            here = np.isfinite(z)
            z = np.where(here, z, 0.0)
            m = here.astype(float)
            held += np.stack([m.T @ m, z.T @ m, z.T @ z, (z * z).T @ m])
        yield pd.DataFrame({"p": np.arange(held.size), "v": held.ravel()})

    cells = rows.mapInPandas(partial, "p int, v double").groupBy("p").agg(F.sum("v").alias("v"))
    n, s, ss, sq = np.array([r.v for r in cells.orderBy("p").collect()] or [0.0] * 4 * d * d).reshape(4, d, d)
    out = []
    for i, j in combinations(range(d), 2):
        k = n[i, j]
        r = None
        if k > 1:
            va = sq[i, j] - s[i, j] ** 2 / k
            vb = sq[j, i] - s[j, i] ** 2 / k
            if va > 1e-14 * sq[i, j] and vb > 1e-14 * sq[j, i]:
                r = float((ss[i, j] - s[i, j] * s[j, i] / k) / np.sqrt(va * vb))
        out.append((cols[i], cols[j], r))
    table = report(df.sparkSession, out, "col_a string, col_b string, r double")
    return table.withColumn("r", F.round("r", digits)) if digits is not None else table


def grouped_mean(df: DataFrame, keys: list[str], value: str, out: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(out or value))


def grouped_max(df: DataFrame, keys: list[str], value: str, out: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(value).alias(out or value))


def contingency(df: DataFrame, left: str, right: str) -> DataFrame:
    """Counts per pair of values, long form (never one column per value)."""
    return df.groupBy(left, right).agg(F.count(F.lit(1)).alias("n"))


def group_modes(df: DataFrame, group: str, cols: list[str]) -> DataFrame:
    """Most frequent value per group; the smallest wins ties. Values are counted before the
    groups are formed, so a hot group arrives as its few distinct values."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in cols]))
    counts = df.select(group, pairs.alias("s")).select(group, "s.col", "s.v").filter(
        F.col("v").isNotNull()).groupBy(group, "col", "v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(group, "col").agg(
        F.max_by("v", F.struct("n", (-F.col("v")).alias("m"))).alias("v"))
    types = {f.name: f.dataType for f in df.schema.fields}
    return best.groupBy(group).pivot("col", cols).agg(F.first("v")).select(
        group, *[F.col(c).cast(types[c]).alias(c) for c in cols])


def distinct_counts(df: DataFrame, cols: list[str], more_than: int | None = None) -> dict[str, int]:
    """Distinct non-null values per column. With ``more_than`` the count may stop early at
    ``more_than + 1``, which keeps the state of each aggregate tiny whatever the column holds."""
    if more_than is None:
        row = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in cols]).first()
        return row.asDict()
    found: dict[str, list] = {c: [] for c in cols}
    for _ in range(more_than + 1):
        open_cols = [c for c in cols if len(found[c]) == _]
        if not open_cols:
            break
        row = df.agg(*[F.min(F.when(~F.col(c).isin(found[c]), F.col(c)) if found[c] else F.col(c))
                       .alias(c) for c in open_cols]).first()
        for c in open_cols:
            if row[c] is not None:
                found[c].append(row[c])
    return {c: len(v) for c, v in found.items()}


def arg_best(df: DataFrame, score: str, tie: str, greater_is_better: bool = False) -> DataFrame:
    """The row with the best score; the smallest ``tie`` wins."""
    rest = F.struct(*[F.col(c) for c in df.columns])
    sign = -1 if greater_is_better else 1
    return df.agg(F.min_by(rest, F.struct((F.col(score) * sign).alias("s"), F.col(tie).alias("t")))
                  .alias("r")).select("r.*")


def box_statistics(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles and whisker ends per group, for groups of fold errors."""
    five = df.groupBy(group).agg(F.percentile(value, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"))
    bounds = five.select(group, F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"),
                         F.col("q")[2].alias("q75"))
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = F.col(value).between(F.col("q25") - reach, F.col("q75") + reach)
    return df.join(bounds, group).groupBy(group).agg(
        F.min(value).alias("min"), F.first("q25").alias("q25"), F.first("median").alias("median"),
        F.first("q75").alias("q75"), F.max(value).alias("max"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"))
