"""Scaling, binning and power transforms; every fitted model is a stateless projection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.operators.quantiles import quantiles
from tabwright.session import lookup_join


@dataclass(frozen=True)
class MinMax:
    """(x - min) / (max - min); a constant column maps to 0."""

    ranges: dict[str, tuple[float, float]]

    def column(self, name: str) -> Column:
        lo, hi = self.ranges[name]
        return (F.col(name) - lo) / (hi - lo if hi > lo else 1.0)

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns({c + suffix: self.column(c) for c in self.ranges if c in df.columns})

    def inverse(self, df: DataFrame, suffix: str = "") -> DataFrame:
        out = {}
        for c, (lo, hi) in self.ranges.items():
            if c + suffix in df.columns:
                out[c] = F.col(c + suffix) * (hi - lo if hi > lo else 1.0) + lo
        return df.withColumns(out)


def fit_minmax(df: DataFrame, cols: list[str]) -> MinMax:
    row = df.agg(*[e for c in cols for e in (F.min(c).cast("double"), F.max(c).cast("double"))]).first()
    return MinMax({c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(cols)
                   if row[2 * i] is not None})


def equal_width(x: Column, lo: float, hi: float, n_bins: int = 10) -> Column:
    """Ordinal bin of n equal widths over [lo, hi]; the maximum falls in the last bin."""
    if not hi > lo:
        return F.when(x.isNotNull(), F.lit(0))
    at = F.floor((x - lo) / (hi - lo) * n_bins)
    return F.when(x.isNotNull(), F.greatest(F.least(at, F.lit(n_bins - 1)), F.lit(0)).cast("int"))


def equal_width_bins(df: DataFrame, cols: list[str], n_bins: int = 10) -> dict[str, Column]:
    ranges = fit_minmax(df, cols).ranges
    return {c: equal_width(F.col(c), lo, hi, n_bins) for c, (lo, hi) in ranges.items()}


def right_closed(x: Column, edges: list[float]) -> Column:
    """Bin of (e0, e1], (e1, e2], ... with e0 itself in the first; outside gives NULL."""
    out = F.when(x < edges[0], F.lit(None).cast("int"))
    for i, e in enumerate(edges[1:]):
        out = out.when(x <= e, F.lit(i))
    return out


def quantile_edges(df: DataFrame, cols: list[str], n_bins: int) -> dict[str, list[float]]:
    """Edges of equal-count bins; while two coincide the number of bins is reduced."""
    want = {c: n_bins for c in cols}
    probs = sorted({i / n for n in range(1, n_bins + 1) for i in range(n + 1)})
    q = quantiles(df, cols, probs)
    out = {}
    for c, n in want.items():
        at = dict(zip(probs, q[c]))
        if at[0.0] is None:
            continue
        while n > 1 and len({at[i / n] for i in range(n + 1)}) < n + 1:
            n -= 1
        out[c] = [at[i / n] for i in range(n + 1)]
    return out


def quantile_bins(df: DataFrame, cols: list[str], n_bins: int) -> dict[str, Column]:
    return {c: right_closed(F.col(c), e) for c, e in quantile_edges(df, cols, n_bins).items()}


def edge_bins(name: str, edges: list[float]) -> Column:
    """Explicit edges, repeated edges removed, lowest included."""
    return right_closed(F.col(name), sorted(set(edges)))


# --- power transforms ------------------------------------------------------------------------

LOG_FLOOR = -50.0


def _root(n: int) -> Callable[[Column], Column]:
    return lambda x: F.pow(x, F.lit(1.0 / n))


#: Fixed set of transforms, in the order in which ties are decided.
POWERS: dict[str, Callable[[Column], Column]] = {
    "x": lambda x: x,
    "log": lambda x: F.when(x > 0, F.log(x)).when(x.isNotNull(), F.lit(LOG_FLOOR)),
    "sqrt": F.sqrt,
    "exp": F.exp,
    "**1/3": _root(3), "**1/4": _root(4), "**1/5": _root(5), "**1/6": _root(6), "**1/7": _root(7),
    "**2": lambda x: x * x,
    "**4": lambda x: x * x * x * x,
}
#: Image of [0, 1] under each transform: all are increasing, so no extra pass finds the bins.
POWER_RANGE = {name: (0.0, 1.0) for name in POWERS}
POWER_RANGE.update({"log": (LOG_FLOOR, 0.0), "exp": (1.0, 2.718281828459045)})


def power_bins(scaled: Column, n_bins: int = 10) -> dict[str, Column]:
    """Equal-width bin of every transform of a column scaled to [0, 1]."""
    return {name: equal_width(fn(scaled), *POWER_RANGE[name], n_bins) for name, fn in POWERS.items()}


@dataclass(frozen=True)
class PowerModel:
    """Scale with the training ranges, then apply the transform chosen per feature."""

    scaler: MinMax
    chosen: dict[str, str]

    def transform(self, df: DataFrame, suffix: str = "_01T") -> DataFrame:
        return df.withColumns({c + suffix: POWERS[name](self.scaler.column(c))
                               for c, name in self.chosen.items()})


# --- weight of evidence ------------------------------------------------------------------------


def woe_numeric(x: Column, bins: list[tuple[float, float]]) -> Column:
    """Weight of the first bin (sorted by its maximum) with x <= maximum, else 0."""
    out = F.lit(0.0)
    for top, weight in sorted(bins, reverse=True):
        out = F.when(x <= top, F.lit(weight)).otherwise(out)
    return out


def woe_encode(df: DataFrame, bins: DataFrame, numeric: list[str], categorical: list[str] = (),
               prefix: str = "WOE_") -> DataFrame:
    """Add ``WOE_<name>`` columns from a bin table (see ``worth.data_vars``)."""
    rows = bins.filter(F.col("var_name").isin(list(numeric)) & F.col("max_value").isNotNull()
                       & F.col("woe").isNotNull()).select("var_name", "max_value", "woe").collect()
    out = df.withColumns({prefix + c: woe_numeric(
        F.col(c), [(r.max_value, r.woe) for r in rows if r.var_name == c]) for c in numeric})
    for c in categorical:
        table = bins.filter((F.col("var_name") == c) & F.col("category").isNotNull()).select(
            F.col("category").alias(f"_v_{c}"), F.col("woe").alias(prefix + c))
        out = lookup_join(out, table, F.col(c).cast("string") == F.col(f"_v_{c}"), "left").drop(
            f"_v_{c}").withColumn(prefix + c, F.coalesce(F.col(prefix + c), F.lit(0.0)))
    return out
