"""Symbolic expressions over table columns.

A program is a prefix list of nodes ``(kind, name, idx, value)``: ``f`` a function, ``x`` a
feature by number, ``c`` a constant. It is applied by compiling it to one Column. Tables of
programs keep the list in a ``nodes`` array and are inspected with array functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.protected import BUILT_IN, Scalar

NODES = "array<struct<kind:string,name:string,idx:int,value:double>>"
PROGRAMS = f"program_id int, nodes {NODES}"


def prefix(expr, features: list[str]) -> list[tuple]:
    """Nodes of a nested tuple such as ``("add", "f_tax", 0.5)``."""
    if isinstance(expr, tuple):
        return [("f", expr[0], None, None)] + [n for e in expr[1:] for n in prefix(e, features)]
    if isinstance(expr, str):
        return [("x", None, features.index(expr), None)]
    return [("c", None, None, float(expr))]


def _walk(nodes: Iterable, leaf: Callable, combine: Callable, functions: dict[str, Scalar]):
    stack: list = []
    for kind, name, idx, value in reversed([tuple(n) for n in nodes]):
        if kind == "f":
            fn = functions[name]
            if len(stack) < fn.arity:
                raise ValueError("incomplete program")
            args = [stack.pop() for _ in range(fn.arity)]
            stack.append(combine(fn, args))
        else:
            stack.append(leaf(kind, idx, value))
    if len(stack) != 1:
        raise ValueError("incomplete program")
    return stack[0]


def to_column(nodes, features: list[str], functions: dict[str, Scalar] = BUILT_IN) -> Column:
    """Compile a program to one Column of the table holding ``features``."""
    return _walk(nodes, lambda kind, idx, value: F.col(features[idx]) if kind == "x" else F.lit(float(value)),
                 lambda fn, args: fn.column(*args), functions)


def to_vector(nodes, columns: list[np.ndarray], functions: dict[str, Scalar] = BUILT_IN):
    """Evaluate a program on arrays (one per feature)."""
    return _walk(nodes, lambda kind, idx, value: columns[idx] if kind == "x" else float(value),
                 lambda fn, args: fn.vector(*args), functions)


def apply_programs(df: DataFrame, programs: dict[str, list], features: list[str],
                   functions: dict[str, Scalar] = BUILT_IN) -> DataFrame:
    """Add one column per named program; batch or streaming."""
    return df.withColumns({n: to_column(p, features, functions) for n, p in programs.items()})


# --- tables of programs --------------------------------------------------------------------------


def arities(nodes: Column, functions: dict[str, Scalar] = BUILT_IN) -> Column:
    """Arity of every node; unknown function names give NULL."""
    known = F.create_map(*[F.lit(v) for fn in functions.values() for v in (fn.name, fn.arity)])
    return F.transform(nodes, lambda n: F.when(
        n["kind"] == "f", F.try_element_at(known, n["name"])).otherwise(F.lit(0)))


def is_valid(ar: Column) -> Column:
    """True when the open-argument count reaches zero exactly at the end."""
    return F.coalesce(F.aggregate(
        ar, F.struct(F.lit(1).alias("need"), F.lit(True).alias("ok")),
        lambda s, a: F.struct((s["need"] - 1 + a).alias("need"), (s["ok"] & (s["need"] > 0)).alias("ok")),
        lambda s: s["ok"] & (s["need"] == 0)), F.lit(False))


def depth(ar: Column) -> Column:
    """Largest nesting: read from the right, a function takes one more than its deepest argument."""
    def step(stack, a):
        return F.when(a == 0, F.concat(F.array(F.lit(0)), stack)).otherwise(F.concat(
            F.array(F.array_max(F.slice(stack, 1, a)) + 1), F.slice(stack, a + 1, F.size(stack))))
    return F.element_at(F.aggregate(F.reverse(ar), F.array().cast("array<int>"), step), 1)


def text(nodes: Column, ar: Column, feature_names: list[str] | None = None) -> Column:
    """``add(X0, 0.500)``; features by name or as X<number>, constants with three digits."""
    if feature_names:
        named = F.array(*[F.lit(n) for n in feature_names])

        def feature(i):
            return F.element_at(named, i + 1)
    else:
        def feature(i):
            return F.concat(F.lit("X"), i.cast("string"))

    def step(stack, pair):
        n, a = pair["n"], pair["a"]
        leaf = F.when(n["kind"] == "x", feature(n["idx"])).otherwise(
            F.format_string("%.3f", n["value"]))
        call = F.concat(n["name"], F.lit("("), F.array_join(F.slice(stack, 1, a), ", "), F.lit(")"))
        return F.when(a == 0, F.concat(F.array(leaf), stack)).otherwise(
            F.concat(F.array(call), F.slice(stack, a + 1, F.size(stack))))

    pairs = F.zip_with(nodes, ar, lambda n, a: F.struct(n.alias("n"), a.alias("a")))
    return F.element_at(F.aggregate(F.reverse(pairs), F.array().cast("array<string>"), step), 1)


def inspect(programs: DataFrame, functions: dict[str, Scalar] = BUILT_IN,
            feature_names: list[str] | None = None) -> DataFrame:
    """Validity, length, depth and text of every program of a table."""
    ar = F.col("_ar")
    with_ar = programs.withColumn("_ar", arities(F.col("nodes"), functions))
    ok = is_valid(ar)
    return with_ar.withColumns({
        "valid": ok, "length": F.size("nodes"),
        "depth": F.when(ok, depth(ar)),
        "text": F.when(ok, text(F.col("nodes"), ar, feature_names))}).drop("_ar")


# --- semantic operators on computed columns --------------------------------------------------------


def sigmoid(c: Column) -> Column:
    return BUILT_IN["sig"].column(c)


def gs_crossover(first: Column, second: Column, random: Column) -> Column:
    """r * first + (1 - r) * second with r the sigmoid of a random program's output."""
    r = sigmoid(random)
    return r * first + (1.0 - r) * second


def gs_mutation_tanh(parent: Column, random: Column, step: float, draw: float | None = None) -> Column:
    """parent + step * tanh(random); a step of -1 means: use the draw."""
    return parent + (draw if step == -1 else step) * F.tanh(random)


def gs_mutation_sigmoid(parent: Column, first: Column, second: Column, step: float) -> Column:
    return parent + step * (sigmoid(first) - sigmoid(second))
