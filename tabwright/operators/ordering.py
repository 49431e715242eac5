"""Row numbers and running totals over a whole table, without a single-task window.

The rows are range-partitioned on the ordering (Spark samples the cut points, so a hot
leading value is split by the later keys), each partition is numbered on its own, and the
partitions' sizes -- one row per partition -- give the offsets. The sorted rows are persisted,
so both steps see the same partitions; lost blocks are rebuilt from the same shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL_BITS = 33


def _sorted_blocks(df: DataFrame, order: list) -> DataFrame:
    code = F.monotonically_increasing_id()
    return (df.repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn("_code", code)
            .withColumn("_block", F.shiftright("_code", _LOCAL_BITS).cast("int"))
            .withColumn("_local", F.col("_code").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
            .drop("_code").persist())


def _numbered(df: DataFrame, order: list, totals: dict[str, Column], position: str):
    blocks = _sorted_blocks(df, order)
    sums = [F.sum(e).alias(f"_t_{n}") for n, e in totals.items()]
    sizes = blocks.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"), *sums).orderBy(
        "_block").collect()                       # one row per partition
    offsets, seen, carried = [], 0, [0.0] * len(totals)
    for row in sizes:
        offsets.append((row["_block"], seen, *carried))
        seen += row["_n"]
        carried = [a + float(row[f"_t_{n}"] or 0.0) for a, n in zip(carried, totals)]
    schema = "_block int, _before bigint" + "".join(f", _b_{n} double" for n in totals)
    lookup = df.sparkSession.createDataFrame(offsets, schema)
    out = blocks.join(F.broadcast(lookup), "_block").withColumn(
        position, F.col("_before") + F.col("_local") + 1)
    if totals:
        w = Window.partitionBy("_block").orderBy("_local").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        for n, e in totals.items():
            out = out.withColumn(n, F.col(f"_b_{n}") + F.coalesce(F.sum(e).over(w), F.lit(0.0)))
    return out.drop("_block", "_local", "_before", *[f"_b_{n}" for n in totals]), seen, blocks


def running(df: DataFrame, order: list, totals: dict[str, Column] | None = None,
            position: str = "position") -> DataFrame:
    """Add the 1-based ``position`` in ``order`` and, per entry of ``totals``, the sum of that
    expression over this row and all rows before it. ``order`` must be a total order."""
    return _numbered(df, order, totals or {}, position)[0]


def keys_at(df: DataFrame, order: list[str], positions) -> tuple[dict[int, tuple], int]:
    """The key tuples at the given 1-based positions, and the row count.

    ``positions`` is a list, or a function of the row count. Only key columns are shuffled and
    only the wanted rows reach the driver.
    """
    numbered, n, blocks = _numbered(df.select(*order), [F.col(c) for c in order], {}, "position")
    wanted = sorted({p for p in (positions(n) if callable(positions) else positions) if 1 <= p <= n})
    rows = numbered.filter(F.col("position").isin(wanted)).collect() if wanted else []
    blocks.unpersist()
    return {r["position"]: tuple(r[c] for c in order) for r in rows}, n


def keys_at_each(df: DataFrame, order: list[str], flags: list[str], positions) -> list[tuple[dict[int, tuple], int]]:
    """``keys_at`` of the rows under each of several boolean columns (without NULLs), from one sort of all rows.

    ``positions`` is a function of the number of flagged rows.
    """
    blocks = _sorted_blocks(df.select(*order, *flags), [F.col(c) for c in order])
    sizes = blocks.groupBy("_block").agg(*[F.sum(F.col(f).cast("bigint")).alias(f) for f in flags]).orderBy("_block").collect()
    counts = [sum(row[f] for row in sizes) for f in flags]
    wanted: dict[tuple[int, int], list[int]] = {}           # (block, flag): places among the block's flagged rows, from 0
    before = {}
    for i, f in enumerate(flags):
        asked, seen = sorted({p for p in positions(counts[i]) if 1 <= p <= counts[i]}), 0
        for row in sizes:
            before[row["_block"], i] = seen
            wanted[row["_block"], i] = [p - 1 - seen for p in asked if seen < p <= seen + row[f]]
            seen += row[f]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [0] * len(flags)
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(batch.num_columns - 1)[0].as_py()
            which, place, at = [], [], []
            for i in range(len(flags)):
                rows = np.flatnonzero(batch.column(len(order) + i).to_numpy(zero_copy_only=False))
                for p in wanted[block, i]:
                    if seen[i] <= p < seen[i] + len(rows):
                        which.append(i), place.append(p), at.append(int(rows[p - seen[i]]))
                seen[i] += len(rows)
            found = batch.select(list(range(len(order)))).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(at), pa.int32()), pa.array(which, pa.int32()),
                                              pa.array(place, pa.int64()), *found.columns], ["_block", "_flag", "_place", *order])

    schema = T.StructType([T.StructField("_block", T.IntegerType()), T.StructField("_flag", T.IntegerType()),
                           T.StructField("_place", T.LongType()), *[df.schema[c] for c in order]])
    rows = blocks.select(*order, *flags, "_block").mapInArrow(pick, schema).collect() if any(wanted.values()) else []
    blocks.unpersist()
    out: list[tuple[dict, int]] = [({}, n) for n in counts]
    for r in rows:
        out[r["_flag"]][0][before[r["_block"], r["_flag"]] + r["_place"] + 1] = tuple(r[c] for c in order)
    return out


def after(order: list[str], cut: tuple) -> Column:
    """True where the row's key comes strictly after ``cut`` (lexicographic, built from plain
    comparisons so that it can be pushed to the scan)."""
    result = F.lit(False)
    for name, value in reversed(list(zip(order, cut))):
        result = (F.col(name) > F.lit(value)) | ((F.col(name) == F.lit(value)) & result)
    return result


def with_slot(df: DataFrame, order: list[str], cuts: list[tuple], out: str) -> DataFrame:
    """Add ``out``: how many of the sorted ``cuts`` the row's key lies strictly after.

    A binary search over one literal array, a column a step: all of it is generated code (a fold over the steps is
    interpreted, and a CASE chain over 100 composite keys no longer compiles).
    """
    steps = [f"_at{i}" for i in reversed(range(len(cuts).bit_length()))]
    table = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(order, cut)]) for cut in cuts])
    df, at = df.withColumn("_key", F.struct(*[F.col(c).alias(c) for c in order])), F.lit(0)
    for name in steps:
        to = at + (1 << int(name[3:]))
        df = df.withColumn(name, F.when((to <= len(cuts)) & (F.col("_key") > F.try_element_at(table, to)), to).otherwise(at))
        at = F.col(name)
    return df.withColumn(out, at).drop("_key", *steps)


def value_ranks(df: DataFrame, value: str, weight: Column | None = None) -> DataFrame:
    """Average rank of each distinct value: ``(value, n, rank)``.

    Equal values are counted before anything is sorted, so a hot value is one row here.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(
        F.sum(weight if weight is not None else F.lit(1)).cast("bigint").alias("n"))
    run = running(counts, [F.col(value)], {"_upto": F.col("n").cast("double")})
    return run.select(value, "n", (F.col("_upto") - (F.col("n") - 1) / 2.0).alias("rank"))
