"""Scalar functions of symbolic expressions, closed over the doubles.

Each has a Column form (whole-stage codegen) and a numpy form (used on Arrow batches when
very many expressions are scored in one pass). NULL and NaN both mean "missing": a guard
that cannot be decided takes the fallback branch in either form.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed value: operands this close to zero take the fallback branch.
NEAR_ZERO = 0.001


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def _beyond_zero(c: Column) -> Column:
    return (F.abs(c) > NEAR_ZERO) & ~F.isnan(c)


def _both(a: Column, b: Column, pick) -> Column:
    gone = F.isnan(a) | F.isnan(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(
        gone, F.lit(float("nan"))).otherwise(pick(a, b))


def _guarded(safe, fallback):
    with np.errstate(all="ignore"):
        out = safe()
    return np.where(np.isfinite(out), out, fallback)


def _np_div(a, b):
    with np.errstate(all="ignore"):
        return np.where(np.abs(b) > NEAR_ZERO, np.divide(a, b), 1.0)


def _np_log(a):
    with np.errstate(all="ignore"):
        return np.where(np.abs(a) > NEAR_ZERO, np.log(np.abs(a)), 0.0)


def _np_inv(a):
    with np.errstate(all="ignore"):
        return np.where(np.abs(a) > NEAR_ZERO, np.divide(1.0, a), 0.0)


@dataclass(frozen=True)
class Scalar:
    """A named function: ``column`` builds the Spark expression, ``vector`` works on arrays."""

    name: str
    arity: int
    column: Callable[..., Column]
    vector: Callable


def _sig_column(a: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-a))


def _sig_vector(a):
    with np.errstate(all="ignore"):
        return 1.0 / (1.0 + np.exp(-a))


def _quiet(fn):
    def run(*args):
        with np.errstate(all="ignore"):
            return fn(*args)
    return run


BUILT_IN: dict[str, Scalar] = {s.name: s for s in [
    Scalar("add", 2, lambda a, b: a + b, _quiet(np.add)),
    Scalar("sub", 2, lambda a, b: a - b, _quiet(np.subtract)),
    Scalar("mul", 2, lambda a, b: a * b, _quiet(np.multiply)),
    Scalar("div", 2, lambda a, b: F.when(_beyond_zero(b), a / b).otherwise(1.0), _np_div),
    Scalar("sqrt", 1, lambda a: F.sqrt(F.abs(a)), _quiet(lambda a: np.sqrt(np.abs(a)))),
    Scalar("power", 1, lambda a: F.when(finite(a * a), a * a).otherwise(1.0),
           lambda a: _guarded(lambda: np.square(a), 1.0)),
    Scalar("log", 1, lambda a: F.when(_beyond_zero(a), F.log(F.abs(a))).otherwise(0.0), _np_log),
    Scalar("exp", 1, lambda a: F.when(finite(F.exp(a)), F.exp(a)).otherwise(1.0),
           lambda a: _guarded(lambda: np.exp(a), 1.0)),
    Scalar("neg", 1, lambda a: -a, np.negative),
    Scalar("abs", 1, F.abs, np.abs),
    Scalar("inv", 1, lambda a: F.when(_beyond_zero(a), 1.0 / a).otherwise(0.0), _np_inv),
    Scalar("max", 2, lambda a, b: _both(a, b, F.greatest), np.maximum),
    Scalar("min", 2, lambda a, b: _both(a, b, F.least), np.minimum),
    Scalar("sin", 1, F.sin, _quiet(np.sin)),
    Scalar("cos", 1, F.cos, _quiet(np.cos)),
    Scalar("tan", 1, F.tan, _quiet(np.tan)),
    Scalar("sig", 1, _sig_column, _sig_vector),
    Scalar("tanh", 1, F.tanh, np.tanh),
]}

#: Names a user may ask for; ``sig`` is kept for the semantic operators.
PUBLIC_NAMES = [n for n in BUILT_IN if n != "sig"]

#: Pairs exchanged by the reverse edit.
OPPOSITES = {"add": "sub", "mul": "div", "max": "min", "sqrt": "power", "log": "exp", "abs": "neg"}
OPPOSITES.update({b: a for a, b in list(OPPOSITES.items())})


def make_function(spark: SparkSession, column: Callable[..., Column], name: str, arity: int,
                  vector: Callable | None = None) -> Scalar:
    """Register a user function given as a Column builder (or a pandas UDF).

    The function must return one finite double for all-one, all-zero and all-minus-one input.
    """
    if not isinstance(arity, int) or isinstance(arity, bool) or arity < 1:
        raise ValueError("arity must be a positive int")
    if not isinstance(name, str) or not name:
        raise ValueError("name must be a non-empty string")
    args = [f"a{i}" for i in range(arity)]
    probe = spark.createDataFrame([[v] * arity for v in (1.0, 0.0, -1.0)],
                                  ", ".join(f"{a} double" for a in args))
    try:
        out = column(*[F.col(a) for a in args])
    except TypeError as err:
        raise ValueError(f"{name} does not take {arity} arguments") from err
    rows = probe.select(out.cast("double").alias("r")).collect()
    if any(r.r is None or not np.isfinite(r.r) for r in rows):
        raise ValueError(f"{name} is not closed: it must be finite for 1, 0 and -1")
    if vector is None:
        def vector(*_):
            raise ValueError(f"{name} has no vector form; score it with method='columns'")
    return Scalar(name, arity, column, vector)


def resolve(function_set) -> dict[str, Scalar]:
    """Names and Scalar objects to a name -> Scalar map, in the given order."""
    out = {}
    for item in function_set:
        if isinstance(item, Scalar):
            out[item.name] = item
        elif item in PUBLIC_NAMES:
            out[item] = BUILT_IN[item]
        else:
            raise ValueError(f"unknown function {item!r}")
    if not out:
        raise ValueError("function_set is empty")
    return out
