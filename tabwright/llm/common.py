"""Shared pieces: the word definition, let-bindings for array expressions, connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.session import stage

#: White space between words, and the characters of a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"


def text_of(column: str = "text") -> Column:
    """The text, empty where it is NULL."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for a text without words."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def carried(column: str) -> Column:
    """A long id as a string: pandas makes a long column with a NULL in it float64, which rounds ids beyond 2^53."""
    return F.col(column).cast("string").alias(column)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value`` evaluated once per row (lambda bodies re-evaluate outer expressions)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tables(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, component)``.

    ``component`` is the smallest node of the component. Large-star and small-star steps alternate until
    the edge set stands still; each step is one partial aggregate and one join, no group is gathered, and
    each round is written to the shared folder, so that lineage stays short and lost executors cost one
    round. Loops and NULL ends are ignored; an empty edge set gives an empty result.
    """
    now = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")) \
        .filter(F.col("a") != F.col("b")) \
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = stage(now, "edges"), None
    for _ in range(rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
        now = stage(_small_star(_large_star(now)), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")) \
        .union(now.select("b", "b").distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) \
        .filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b") \
        .union(low).distinct()
