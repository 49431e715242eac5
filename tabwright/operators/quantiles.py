"""Exact linearly interpolated percentiles for many columns at once.

Small columns go through Spark's exact ``percentile``, whose state holds the distinct values.
Above ``limit`` values each wanted order statistic is enclosed by a bracket from the
approximate sketch; each round one pass counts the values below and inside the brackets and
narrows them, until the inside fits a grouped count. A hot value closes its own bracket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values per column up to which the one-pass exact aggregate is used.
ONE_PASS_VALUES = 1_000_000
#: Values over all columns whose exact state may meet in one task of one job.
ONE_JOB_VALUES = 6_000_000
ACCURACY = 10_000
_WIDTH = 3.0 / ACCURACY
_PER_JOB = 60


def _chunks(items, size=_PER_JOB):
    for i in range(0, len(items), size):
        yield items[i:i + size]


def _aggregate(df: DataFrame, exprs: list, per_job: int = _PER_JOB) -> list:
    out = []
    for part in _chunks(exprs, per_job):
        out.extend(df.agg(*[e.alias(f"a{i}") for i, e in enumerate(part)]).first())
    return out


def quantiles(df: DataFrame, cols: list[str], probs: list[float],
              limit: int = ONE_PASS_VALUES, counts: dict[str, int] | None = None) -> dict[str, list[float | None]]:
    """``{column: [value per probability]}``; a column without values gives NULLs. ``counts`` are
    the columns' numbers of values, where the caller knows them."""
    cols, probs = list(cols), [float(p) for p in probs]
    counts = counts or dict(zip(cols, _aggregate(df, [F.count(c) for c in cols])))
    if max(counts.values(), default=0) <= limit:
        got = _aggregate(df, [F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, probs)))
                              for c in cols],
                         max(1, ONE_JOB_VALUES // max(1, *counts.values(), 1)))
        return {c: (list(v) if v is not None else [None] * len(probs)) for c, v in zip(cols, got)}
    ranks = {}
    for c in cols:
        for p in probs:
            if counts[c]:
                at = (counts[c] - 1) * p
                ranks[(c, p)] = (math.floor(at), math.ceil(at), at - math.floor(at))
    wanted = sorted({(c, r) for (c, _), (lo, hi, _) in ranks.items() for r in (lo, hi)})
    stats = order_statistics(df, wanted, counts, limit)
    out = {}
    for c in cols:
        row = []
        for p in probs:
            if (c, p) not in ranks:
                row.append(None)
                continue
            lo, hi, share = ranks[(c, p)]
            a, b = stats[(c, lo)], stats[(c, hi)]
            row.append(a if a == b else (1 - share) * a + share * b)
        out[c] = row
    return out


def order_statistics(df: DataFrame, wanted: list[tuple[str, int]], counts: dict[str, int],
                     limit: int) -> dict[tuple[str, int], float]:
    """The 0-based ``rank``-th smallest value of a column for each (column, rank).

    One sketch a column serves all its ranks, and one pass counts the values below and at all cuts of all columns.
    """
    names = sorted({c for c, _ in wanted})
    value = {c: F.col(c).cast("double") for c in names}
    grids = {c: sorted({q for r in {r for d, r in wanted if d == c} for q in _near(r, counts[c])}) for c in names}
    first = dict(zip(names, zip(*[iter(_aggregate(df, [e for c in names for e in (
        F.min(value[c]), F.max(value[c]), F.percentile_approx(value[c], F.array(*map(F.lit, grids[c])), F.lit(ACCURACY)))]))] * 3)))
    # bracket of each target: closed value range, values below it, values inside it
    state = {t: (*first[t[0]][:2], 0, counts[t[0]]) for t in wanted}
    cuts = {t: first[t[0]][2] for t in wanted}
    done: dict = {}
    while True:
        for t, (lo, hi, below, inside) in list(state.items()):
            if lo == hi:
                done[t] = lo
                del state[t]
        wide = [t for t in state if state[t][3] > limit]
        if not wide:
            break
        if cuts is None:
            exprs = []
            for c, r in wide:
                lo, hi, below, inside = state[(c, r)]
                exprs.append(F.percentile_approx(F.when(value[c].between(lo, hi), value[c]),
                                                 F.array(*map(F.lit, _near(r - below, inside))), F.lit(ACCURACY)))
            cuts = dict(zip(wide, _aggregate(df, exprs)))
        at = {c: sorted({x for t in wide if t[0] == c for x in cuts[t]}) for c in {t[0] for t in wide}}
        got = _count_at(df, at)
        for t in wide:
            lo, hi, below, inside = state[t]
            upto = below + inside
            for x in at[t[0]]:
                less, at_most = got[t[0], x]
                if less <= t[1] < at_most:        # the value itself
                    lo, hi, below, upto = x, x, less, at_most
                    break
                if at_most <= t[1] and at_most > below:
                    lo, below = math.nextafter(x, math.inf), at_most
                elif less > t[1] and less < upto:
                    hi, upto = math.nextafter(x, -math.inf), less
            if (lo, hi) == state[t][:2]:          # sketch gave no progress: halve the range
                mid = lo / 2 + hi / 2
                less = df.filter(value[t[0]] <= mid).count()
                if less > t[1]:
                    hi, upto = mid, less
                else:
                    lo, below = math.nextafter(mid, math.inf), less
            state[t] = (lo, hi, below, upto - below)
        cuts = None
    if state:
        done.update(_count_inside(df, state))
    return done


def _near(rank: int, n: int) -> list[float]:
    """The shares just below, at and just above the 0-based ``rank`` of ``n`` values."""
    p = rank / max(n - 1, 1)
    return [max(0.0, p - _WIDTH), min(1.0, max(p, 0.0)), min(1.0, p + _WIDTH)]


def _count_at(df: DataFrame, cuts: dict[str, list[float]]) -> dict[tuple[str, float], tuple[int, int]]:
    """How many values lie below, and at most at, each of the sorted cuts of each column: each task counts what lies between
    them, in one pass for all columns."""
    names = list(cuts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(2 * len(cuts[c]) + 1, dtype=np.int64) for c in names]
        for batch in batches:
            for j, c in enumerate(names):
                values, edges = batch.column(j).drop_null().to_numpy(), np.array(cuts[c])
                # even places lie between cuts, odd ones at a cut
                place = np.searchsorted(edges, values, "left") + np.searchsorted(edges, values, "right")
                held[j] += np.bincount(place, minlength=len(held[j]))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(names), dtype=np.int32), [len(h) for h in held])),
            pa.array(np.concatenate([np.arange(len(h), dtype=np.int32) for h in held])), pa.array(np.concatenate(held))],
            ["c", "place", "n"])

    rows = df.select(*[F.col(c).cast("double").alias(f"v{j}") for j, c in enumerate(names)])
    found = rows.mapInArrow(count, "c int, place int, n long").groupBy("c", "place").agg(F.sum("n").alias("n")).collect()
    held = [np.zeros(2 * len(cuts[c]) + 1, dtype=np.int64) for c in names]
    for r in found:
        held[r["c"]][r["place"]] = r["n"]
    upto = [np.cumsum(h) for h in held]
    return {(c, x): (int(upto[j][2 * i]), int(upto[j][2 * i + 1])) for j, c in enumerate(names) for i, x in enumerate(cuts[c])}


def _count_inside(df: DataFrame, state: dict) -> dict:
    """Finish brackets that hold at most ``limit`` values: count per value, then run up. Ranks with one bracket share its count."""
    out, ranks = {}, {}
    for (c, rank), (lo, hi, below, _) in state.items():
        ranks.setdefault((c, lo, hi, below), []).append(rank)
    for part in _chunks(sorted(ranks)):
        structs = []
        for i, (c, lo, hi, _) in enumerate(part):
            v = F.col(c).cast("double")
            structs.append(F.when(v.between(lo, hi), F.struct(F.lit(i).alias("t"), v.alias("v"))))
        long = df.select(F.explode(F.array_compact(F.array(*structs))).alias("s")).select("s.t", "s.v")
        counted = long.groupBy("t", "v").agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("t").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        goals = F.element_at(F.array(*[F.array(*[F.lit(rank - b[3]) for rank in ranks[b]]) for b in part]), F.col("t") + 1)
        upto = counted.withColumn("u", F.sum("n").over(w))
        hit = upto.filter(F.exists(goals, lambda g: (F.col("u") > g) & (F.col("u") - F.col("n") <= g)))
        for r in hit.collect():
            c, _, _, below = b = part[r["t"]]
            out.update({(c, rank): r["v"] for rank in ranks[b] if r["u"] > rank - below >= r["u"] - r["n"]})
    return out
