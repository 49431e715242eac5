"""Cross products of columns: one pass over the rows, then d-by-d algebra on the driver.

For columns ``x`` and a fixed centre ``m`` (the column means) the pass returns per fold the
count, ``sum(x-m)`` and ``sum((x-m)(x-m)')``. Linear models, their cross-validation, variance
inflation, principal components and factor models all follow from these numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.operators.columns import complete_rows

#: Up to this many aggregate columns the pass stays inside Spark SQL code generation.
NATIVE_AGGREGATES = 90


@dataclass(frozen=True)
class Moments:
    """Count, sums and cross products of centred columns over one set of rows."""

    names: tuple[str, ...]
    centre: np.ndarray
    n: float
    s: np.ndarray
    ss: np.ndarray

    def __sub__(self, other: "Moments") -> "Moments":
        return Moments(self.names, self.centre, self.n - other.n, self.s - other.s, self.ss - other.ss)

    def __add__(self, other: "Moments") -> "Moments":
        return Moments(self.names, self.centre, self.n + other.n, self.s + other.s, self.ss + other.ss)

    def pick(self, names: list[str]) -> "Moments":
        at = [self.names.index(c) for c in names]
        return Moments(tuple(names), self.centre[at], self.n, self.s[at], self.ss[np.ix_(at, at)])

    @property
    def mean(self) -> np.ndarray:
        return self.centre + self.s / self.n

    def scatter(self) -> np.ndarray:
        """Cross products about the rows' own mean."""
        return self.ss - np.outer(self.s, self.s) / self.n

    def covariance(self) -> np.ndarray:
        return self.scatter() / (self.n - 1)

    def raw(self) -> np.ndarray:
        """Uncentred cross products."""
        cross = np.outer(self.centre, self.s)
        return self.ss + cross + cross.T + self.n * np.outer(self.centre, self.centre)

    def mapped(self, names: list[str], weights: np.ndarray, centre: np.ndarray) -> "Moments":
        """Moments of the linear images ``(x - centre) @ weights``."""
        shift = self.centre - centre
        s = self.s + self.n * shift
        cross = np.outer(self.s, shift)
        ss = self.ss + cross + cross.T + self.n * np.outer(shift, shift)
        return Moments(tuple(names), np.zeros(weights.shape[1]), self.n, s @ weights,
                       weights.T @ ss @ weights)


def column_means(df: DataFrame, cols: list[str]) -> np.ndarray:
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return np.array([0.0 if v is None else float(v) for v in row])


def fold_moments(df: DataFrame, cols: list[str], fold: str | None = None,
                 centre: np.ndarray | None = None) -> dict[int, Moments]:
    """Moments per fold over the rows where all ``cols`` are present."""
    cols = list(cols)
    d = len(cols)
    rows = complete_rows(df, cols).select(
        (F.col(fold) if fold else F.lit(0)).cast("int").alias("_fold"),
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    if centre is None:
        centre = column_means(rows, [f"x{i}" for i in range(d)])
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    if 1 + d + len(upper) <= NATIVE_AGGREGATES:
        z = rows.select("_fold", *[(F.col(f"x{i}") - float(centre[i])).alias(f"z{i}") for i in range(d)])
        summed = z.groupBy("_fold").agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            *[F.sum(f"z{i}") for i in range(d)],
            *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")) for i, j in upper]).collect()
        flat = {r[0]: list(r[1:]) for r in summed}
    else:
        flat = _arrow_sums(rows, d, centre, upper)
    out = {}
    for f, v in flat.items():
        ss = np.zeros((d, d))
        for (i, j), x in zip(upper, v[1 + d:]):
            ss[i, j] = ss[j, i] = x
        out[f] = Moments(tuple(cols), centre, float(v[0]), np.array(v[1:1 + d], float), ss)
    return out


def _arrow_sums(rows: DataFrame, d: int, centre: np.ndarray, upper: list) -> dict:
    """Wide tables: each task multiplies its Arrow batches and emits one row per fold."""
    left = [i for i, _ in upper]
    right = [j for _, j in upper]

    def partial(batches):
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            folds = pdf["_fold"].to_numpy()
            z = pdf.drop(columns="_fold").to_numpy(dtype=float) - centre
            for f in np.unique(folds):
                part = z[folds == f]
                cross = part.T @ part
                vec = np.concatenate([[len(part)], part.sum(axis=0), cross[left, right]])
                held[int(f)] = held.get(int(f), 0.0) + vec
        if held:
            yield pd.DataFrame({"_fold": list(held), "v": [v.tolist() for v in held.values()]})

    sums = rows.mapInPandas(partial, "_fold int, v array<double>")
    cells = sums.select("_fold", F.posexplode("v").alias("p", "x")).groupBy("_fold", "p").agg(
        F.sum("x").alias("x"))
    packed = cells.groupBy("_fold").agg(F.sort_array(F.collect_list(F.struct("p", "x"))).alias("v"))
    return {r["_fold"]: [c["x"] for c in r["v"]] for r in packed.collect()}


def moments(df: DataFrame, cols: list[str]) -> Moments:
    found = fold_moments(df, cols)
    if not found:
        raise ValueError("no complete rows")
    return found[0]


def total(parts: dict[int, Moments]) -> Moments:
    items = list(parts.values())
    out = items[0]
    for m in items[1:]:
        out = out + m
    return out


def inverse(a: np.ndarray) -> np.ndarray | None:
    """Inverse of a symmetric matrix, or None when it is singular to working precision."""
    scale = np.sqrt(np.clip(np.diag(a), 1e-300, None))
    b = a / np.outer(scale, scale)
    if not np.all(np.isfinite(b)) or np.linalg.cond(b) > 1e12:
        return None
    return np.linalg.inv(b) / np.outer(scale, scale)


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least-squares solution of a symmetric system; a pseudo-inverse when it is singular."""
    scale = np.sqrt(np.clip(np.diag(a), 1e-300, None))
    return (np.linalg.pinv(a / np.outer(scale, scale), rcond=1e-12, hermitian=True) @ (b / scale)) / scale
