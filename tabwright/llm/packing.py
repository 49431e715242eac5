"""Packing token sequences into bins by best-two-fit.

A bin is filled greedily, largest fitting piece first. When nothing fits any more, its smallest piece is
taken out and, if two unpacked pieces fill the widened gap more tightly, they replace it. Only lengths matter:
a block of pieces is packed as a table of how many pieces have each length. Pieces are dealt to blocks of
bounded size, packed in parallel; each block leaves one loosely filled bin or so.

Defined cases: a NULL or empty text is the end id alone; rows repeating a document are packed each for itself; an
empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import text_of
from tabwright.llm.token_output import text_batches
from tabwright.llm.tokens import encoder
from tabwright.session import stage

#: Pieces aimed at in a block.
BLOCK = 60_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", no_id boolean, block long, sequence_id long, offset long"


class Pool:
    """Unpacked pieces by length."""

    def __init__(self, lengths: np.ndarray):
        sizes, counts = np.unique(lengths, return_counts=True)
        self.sizes = sizes.tolist()
        self.count = dict(zip(self.sizes, counts.tolist(), strict=True))
        self._array = None

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            del self.count[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))
            self._array = None

    def give(self, size: int) -> None:
        if size in self.count:
            self.count[size] += 1
        else:
            self.count[size] = 1
            bisect.insort(self.sizes, size)
            self._array = None

    def fitting(self, gap: int) -> int:
        """Largest unpacked length up to ``gap``; 0 if there is none."""
        k = bisect.bisect_right(self.sizes, gap)
        return self.sizes[k - 1] if k else 0

    def pair(self, gap: int, above: int) -> tuple[int, int] | None:
        """Two unpacked lengths with the largest sum in (above, gap]."""
        if self._array is None:
            self._array = np.array(self.sizes)
        sizes = self._array[:bisect.bisect_left(self.sizes, gap)]
        mate = np.searchsorted(self._array, gap - sizes, "right") - 1
        own = np.arange(len(sizes))
        mate = np.minimum(mate, own)                       # the mate is the smaller one
        alone = np.array([self.count[s] == 1 for s in self.sizes[:len(sizes)]], dtype=bool)
        mate = np.where((mate == own) & alone, mate - 1, mate)
        total = np.where(mate >= 0, sizes + self._array[np.maximum(mate, 0)], 0) if len(sizes) else np.zeros(0)
        if not len(total) or total.max() <= above:
            return None
        k = int(total.argmax())
        return int(sizes[k]), int(self._array[mate[k]])


def pack(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins as lists of lengths; every length must be in 1..capacity."""
    pool, bins = Pool(lengths), []
    while pool.sizes:
        held, gap = [], capacity
        while gap and (size := pool.fitting(gap)):
            pool.take(size)
            held.append(size)
            gap -= size
        if gap and pool.sizes and len(held) > 1:
            least = held[-1]
            if two := pool.pair(gap + least, least):
                for size in two:
                    pool.take(size)
                held[-1:] = two
                pool.give(least)
        bins.append(held)
    return bins


def _pieces(path: str, end_id: int, capacity: int):
    tail = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path, False).encode
        for rows in batches:
            for doc_ids, texts in text_batches(rows, ["doc_id"], "text"):
                out = []
                for doc_id, data in zip(doc_ids, encode(texts), strict=True):
                    data += tail
                    doc_id = None if doc_id is None else int(doc_id)
                    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[at:at + 4 * capacity]
                        out.append((doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own)))
                made = pd.DataFrame([x[1:] for x in out], columns=["piece", "start", "length", "ids_crc32"])
                made.insert(0, "doc_id", pd.array([x[0] for x in out], "Int64"))
                yield made
    return cut


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of at most ``capacity`` token ids; only documents longer than that are cut."""
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), text_of().alias("text"))
    return rows.mapInPandas(_pieces(tokenizer, end_id, capacity), PIECES)


def _fill(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "no_id", "doc_id", "piece"], kind="stable", ignore_index=True)
        lengths = rows["length"].to_numpy()
        bins = pack(lengths, capacity)
        sizes = np.array([s for held in bins for s in held], dtype=np.int64)
        sequence = np.repeat(np.arange(len(bins)), [len(held) for held in bins])
        ends = np.cumsum(sizes)
        first = np.concatenate([[0], np.flatnonzero(np.diff(sequence)) + 1])
        offset = ends - sizes - (ends - sizes)[first][sequence]
        order = np.argsort(sizes, kind="stable")           # the k-th place for a length goes to its k-th piece
        rows["sequence_id"] = sequence[order] + (int(key[0]) << 32)
        rows["offset"] = offset[order]
        return rows
    return run


def best_two_fit(pieces: DataFrame, capacity: int, block: int = BLOCK) -> DataFrame:
    """``pieces`` (columns of ``PIECES``) with sequence_id and offset."""
    dealt = stage(pieces.withColumn("deal", F.xxhash64("doc_id", "piece", F.spark_partition_id())), "pieces")
    blocks = max(1, math.ceil(dealt.count() / block))
    # ids without NULLs: pandas would make a column with one float64, which rounds ids beyond 2^53
    return dealt.withColumn("block", F.pmod("deal", F.lit(blocks)).cast("long")).drop("deal") \
        .withColumns({"no_id": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0).cast("long")),
                      "sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}) \
        .groupBy("block").applyInPandas(_fill(capacity), PACKED) \
        .withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("block", "no_id")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, block: int = BLOCK) -> DataFrame:
    return best_two_fit(pieces(docs, tokenizer, end_id, capacity), capacity, block)
