"""Projections, filters and row-set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame, exclude: list[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]


def add_suffix(df: DataFrame, cols: list[str], suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: c + suffix for c in cols})


def add_prefix(df: DataFrame, cols: list[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in cols})


def any_null(cols: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols], F.lit(False))


def complete_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.na.drop(how="any", subset=cols)


def incomplete_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.filter(any_null(cols or df.columns))


def any_negative(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row, one boolean: is any number negative?"""
    cols = cols or numeric_columns(df)
    found = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) < 0, F.lit(False)) for c in cols])
    return df.agg(F.coalesce(F.max(found), F.lit(False)).alias("any_negative"))


def first_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows in key order (a per-task top-n, merged)."""
    return df.orderBy(*order).limit(n)


def near_constant(df: DataFrame, cols: list[str], below: float = 0.01) -> list[str]:
    """Columns whose sample deviation is under ``below`` (or undefined); one aggregate."""
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is not None and row[c] < below]


def drop_near_constant(train: DataFrame, test: DataFrame | None, cols: list[str],
                       below: float = 0.01):
    """Drop the columns that hardly vary in ``train`` from both frames."""
    gone = near_constant(train, cols, below)
    return train.drop(*gone), (test.drop(*gone) if test is not None else None), gone


def align(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Column concat by key: outer, so unmatched keys keep NULLs."""
    return left.join(right, key, "full_outer")


def without_rows(df: DataFrame, removed: DataFrame, key: list[str]) -> DataFrame:
    return df.join(removed.select(*key), key, "left_anti")


def only_rows(df: DataFrame, kept: DataFrame, key: list[str]) -> DataFrame:
    return df.join(kept.select(*key), key, "left_semi")


def merge_reports(tables: list[DataFrame], on: str = "feature") -> DataFrame:
    """Inner merge of per-feature report tables (one row per feature each)."""
    return reduce(lambda a, b: a.join(b, on), tables)


def stack_rows(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
