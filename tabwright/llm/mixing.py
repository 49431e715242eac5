"""Mixing sources to target weights by balanced (cube) sampling.

A source's target divided by its size says how often each of its documents is taken: the whole part is
taken outright, the fraction is an inclusion probability. The cube method's flight moves these
probabilities along directions in the null space of the constraints (number of documents, number of
words), so that both totals stay as they are while probabilities turn into 0 or 1. Flights run in blocks
of a source; each leaves two open documents at most, which meet in ever fewer blocks until two a source
remain. This landing problem is solved by trying its outcomes.

Defined cases: a NULL text has size 0, a NULL source is a source of its own (sorted last), sources without
words take nothing. Rows equal in id, source and text share one draw. An empty table gives an empty result.
Draws are hashes of the seed and the block, so reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import WORD, text_of
from tabwright.session import stage

#: Weights dealt to the sources in order, again and again; share of all words; most times a word is taken.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Units aimed at in a block of a flight, and how many blocks meet in one of the next round.
BLOCK = 20_000
FAN_IN = 32
STATE = "doc_id long, no_id boolean, source string, mark long, n_rows long, size long, pi double, block long"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, mark (hash of the text) and size (words) of each row."""
    text = text_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.xxhash64(text).alias("mark"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Targets of ``sources(source, source_size)``: shares by weight, held at ``most`` times a source's size.

    What held sources leave over is reshared by weight among the others until none is above. Each round is
    one aggregate over the table of sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())             # one row per source
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int"))
    table = stage(sources.withColumn("weight", weight.cast("long")), "sources")
    wanted = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    unit, held = 0.0, -1
    ceiling = most * F.col("source_size")
    while True:
        over = ceiling <= F.lit(unit) * F.col("weight")
        n, kept, free = table.agg(
            F.coalesce(F.sum(F.when(over, 1)), F.lit(0)), F.coalesce(F.sum(F.when(over, ceiling)), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if n == held or not free:
            break
        held, unit = n, (wanted - kept) / free
    return table.withColumn("target", F.when(ceiling <= F.lit(unit) * F.col("weight"), ceiling.cast("double"))
                            .otherwise(F.lit(unit) * F.col("weight")))


def flight(pi: np.ndarray, size: np.ndarray, draws) -> np.ndarray:
    """Move ``pi`` along null-space directions of (1, size) until two entries at most lie inside (0, 1)."""
    out = pi.tolist()
    sizes = size.tolist()
    waiting = [i for i, p in enumerate(out) if 0.0 < p < 1.0][::-1]
    if len(waiting) < 2:
        return np.array(out)
    open_ = [waiting.pop() for _ in range(min(3, len(waiting)))]
    while len(open_) >= 2:
        if len(open_) == 3:
            a, b, c = (sizes[i] for i in open_)
            move = (c - b, a - c, b - a)
            if move == (0, 0, 0):
                move = (1, -1, 0)
        elif sizes[open_[0]] == sizes[open_[1]]:
            move = (1, -1)
        else:
            break
        up = down = math.inf
        for i, u in zip(open_, move, strict=True):
            if u > 0:
                up, down = min(up, (1.0 - out[i]) / u), min(down, out[i] / u)
            elif u < 0:
                up, down = min(up, out[i] / -u), min(down, (1.0 - out[i]) / -u)
        step = up if draws() * (up + down) < down else -down
        for i, u in zip(open_, move, strict=True):
            p = out[i] + step * u
            out[i] = 0.0 if p < 1e-9 else 1.0 if p > 1.0 - 1e-9 else p
        open_ = [i for i in open_ if 0.0 < out[i] < 1.0]
        while len(open_) < 3 and waiting:
            open_.append(waiting.pop())
    return np.array(out)


def landing(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide what flights left open (two entries): the outcome closest in words, then in documents."""
    out = pi.copy()
    left = np.flatnonzero((pi > 0) & (pi < 1))
    best = None
    for bits in range(1 << len(left)):
        chosen = np.array([(bits >> k) & 1 for k in range(len(left))], dtype=float)
        gap = (abs(float(((chosen - pi[left]) * size[left]).sum())), abs(float((chosen - pi[left]).sum())), bits)
        if best is None or gap < best[0]:
            best = gap, chosen
    out[left] = best[1]
    return out


def _fly(last: bool, seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["no_id", "doc_id", "mark"], kind="stable").reset_index(drop=True)
        words = np.frombuffer(f"{key[0]}".encode(), dtype=np.uint8).tolist()
        rng = np.random.default_rng([seed, int(key[1]), len(rows), int(last), *words])
        draws = iter(rng.random(4 * len(rows) + 8).tolist()).__next__
        pi = flight(rows["pi"].to_numpy(float), rows["size"].to_numpy(float), draws)
        rows["pi"] = landing(pi, rows["size"].to_numpy(float)) if last else pi
        return rows
    return run


def mix(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 7,
        block: int = BLOCK) -> DataFrame:
    """How often each row of ``rows`` (from ``sized``) is taken.

    One row per distinct (doc_id, source, mark): n_rows, size of one row, source_size, target, times.
    """
    rows = stage(rows, "sizes")
    units = stage(rows.groupBy("doc_id", "source", "mark").agg(F.max("size").alias("size"),
                                                               F.count("*").alias("n_rows")), "units")
    sources = targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size")),
                      weights, share, most).withColumnRenamed("source", "its_source")
    aimed = units.join(sources, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source", "weight")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aimed = stage(aimed.withColumn("ratio", ratio), "aimed")
    whole = F.floor("ratio")
    blocks = max(1, math.ceil(aimed.count() / block))
    # ids without NULLs: pandas would make a column with one float64, which rounds ids beyond 2^53
    own = F.when(~F.col("no_id"), F.col("doc_id"))
    state = aimed.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "source", "mark", "n_rows", (F.col("size") * F.col("n_rows")).alias("size"),
                         (F.col("ratio") - whole).alias("pi"), F.lit(0).cast("long").alias("block"))
    decided = []
    while True:
        dealt = state.withColumn("block", F.pmod(F.xxhash64(own, "mark", F.lit(seed)), F.lit(blocks)))
        flown = stage(dealt.groupBy("source", "block").applyInPandas(_fly(blocks == 1, seed), STATE), "flight")
        if blocks == 1:
            decided.append(flown)
            break
        inside = (F.col("pi") > 0) & (F.col("pi") < 1)
        decided.append(flown.filter(~inside))
        state, blocks = flown.filter(inside), math.ceil(blocks / FAN_IN)
    drawn = decided[0]
    for more in decided[1:]:
        drawn = drawn.unionByName(more)
    drawn = drawn.select(own.alias("d"), F.col("source").alias("s"), F.col("mark").alias("m"),
                         F.col("pi").cast("long").alias("extra"))
    same = (F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s"))
            & (F.col("mark") == F.col("m")))
    return aimed.join(drawn, same).select("doc_id", "source", "mark", "n_rows", "size", "source_size", "target",
                                          (whole + F.col("extra")).cast("long").alias("times"))


def taken_rows(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words, repeats counted) of each row of ``docs``."""
    units = mix(sized(docs), **settings)
    each = units.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return each.select("doc_id", "source", "size", "source_size", "target",
                       (F.col("times") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns."""
    units = stage(mix(sized(docs), **settings).filter("times > 0"), "mix").select(
        F.col("doc_id").alias("__tw_d"), F.col("source").alias("__tw_s"), F.col("mark").alias("__tw_m"),
        F.col("times").alias("__tw_times"))
    same = (F.col("doc_id").cast("long").eqNullSafe(F.col("__tw_d"))
            & F.col("source").cast("string").eqNullSafe(F.col("__tw_s"))
            & (F.col("__tw_mark") == F.col("__tw_m")))
    rows = docs.withColumn("__tw_mark", F.xxhash64(text_of())).join(units, same)
    return rows.withColumn("__tw_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__tw_times")))) \
        .select(*docs.columns)
