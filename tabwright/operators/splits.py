"""Holdouts, validation flags, bags and folds: functions of the row key and a seed."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.draws import drawn, uniform
from tabwright.operators.ordering import after, keys_at, keys_at_each, with_slot


def test_flag(key: str, seed, test_size: float = 0.1) -> Column:
    """True for the rows of the holdout; ``seed`` is an int >= 1 or a Column of such."""
    return uniform(key, seed) < test_size


def train_test_split(df: DataFrame, key: str, seed: int, test_size: float = 0.1):
    flag = test_flag(key, seed, test_size)
    return df.filter(~flag), df.filter(flag)


def repeated_holdout(df: DataFrame, key: str, seeds: list[int], test_size: float = 0.1) -> DataFrame:
    """One copy of each row per seed with its ``is_test`` flag. The copies are made inside the
    scan stage, so grouped aggregates over ``seed`` combine them before any shuffle."""
    copies = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    return copies.withColumn("is_test", test_flag(key, F.col("seed"), test_size))


def holdout_means(df: DataFrame, key: str, cols: list[str], seeds: list[int],
                  test_size: float = 0.1) -> DataFrame:
    """Training means of every column for every seed in one job."""
    copies = repeated_holdout(df.select(*dict.fromkeys([key, *cols])), key, seeds, test_size)
    return copies.filter(~F.col("is_test")).groupBy("seed").agg(
        F.count(F.lit(1)).alias("n_train"), *[F.avg(c).alias(c) for c in cols])


def validation_flag(df: DataFrame, key: str, unique_key: list[str], seed: int, share: float,
                    out: str = "is_val") -> DataFrame:
    """Flag exactly ``int(share * n)`` rows, drawn without replacement."""
    drawn = df.withColumn("_u", uniform(key, seed))
    order = ["_u", *unique_key]
    cut, n = keys_at(drawn, order, lambda n: [int(share * n)])
    last = cut.get(int(share * n))
    flag = ~after(order, last) if last is not None else F.lit(False)
    return drawn.withColumn(out, flag).drop("_u")


def in_bag(key: str, program: int, seed: int | str, share: float) -> Column:
    """Row-by-program membership of a bag holding ``share`` of the rows; every (program, seed) has its own bag."""
    if share >= 1.0:
        return F.lit(True)
    return drawn(key, program, seed) < share


def fold_sizes(n: int, k: int) -> list[int]:
    return [n // k + (1 if i < n % k else 0) for i in range(k)]


def kfold(df: DataFrame, order: list[str], k: int, out: str = "fold") -> DataFrame:
    """Contiguous folds in key order, the first ``n % k`` one row larger.

    Only the keys are sorted; the fold of a row is then a comparison with the k - 1 keys that
    end a fold, so the rows themselves are never moved.
    """
    def ends(n):
        return [sum(fold_sizes(n, k)[:i + 1]) for i in range(k - 1)]

    cuts, n = keys_at(df, order, ends)
    if n < k:
        raise ValueError(f"{k} folds need at least {k} rows, got {n}")
    return with_slot(df, order, [cuts[p] for p in ends(n)], out)


def kfold_each(df: DataFrame, order: list[str], k: int, flags: list[str], out: str = "fold") -> list[DataFrame]:
    """``kfold`` of the rows under each flag: the keys are sorted once for all."""
    def ends(n):
        return [sum(fold_sizes(n, k)[:i + 1]) for i in range(k - 1)]

    frames = []
    for flag, (cuts, n) in zip(flags, keys_at_each(df, order, flags, ends)):
        if n < k:
            raise ValueError(f"{k} folds need at least {k} rows, got {n}")
        frames.append(with_slot(df.filter(flag), order, [cuts[p] for p in ends(n)], out))
    return frames


def random_subset(df: DataFrame, key: str, row_share: float, col_share: float, seed: int,
                  keep: list[str] = ()) -> DataFrame:
    """A random share of the rows and of the columns (``keep`` always stays)."""
    free = [c for c in df.columns if c not in set(keep)]
    chosen = set(random.Random(seed).sample(free, int(len(free) * col_share)))
    rows = df.filter(uniform(key, seed) < row_share)
    return rows.select(*[c for c in df.columns if c in chosen or c in set(keep)])
