"""Exact deduplication over a cuckoo-filter index.

Digests of normalised texts are dealt to shards. A shard holds a cuckoo filter (four 16-bit fingerprints
a bucket) and, bucketed alike, the full digests it stands for. A digest that misses the filter is new; a
hit is verified against the bucket's stored digests; an insertion that finds no place doubles the filter
and refills it from the stored keys; deleting a live digest removes its fingerprint and key.

Defined cases: a NULL text counts as empty. Of rows with equal texts the smallest ``doc_id`` stays, NULL
ids being largest. Rows repeating id and text count as separate rows of which one stays. An empty table
gives an empty index. Extra columns are carried untouched where rows are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import SPACE, carried, text_of
from tabwright.session import attach, stage

SLOTS = 4
KICKS = 256
#: Live digests aimed at per shard; a parameter of ``build_index``.
SHARD_KEYS = 40_000
INDEX = "shard int, digest binary, keep_id long, group_size long, n_least long, filter binary"


class CuckooFilter:
    """Approximate membership with deletion; keys are digests of at least 12 bytes."""

    def __init__(self, buckets: int = 64):
        self.buckets = max(2, 1 << (buckets - 1).bit_length())
        self.table = np.zeros(self.buckets * SLOTS, dtype="<u2")
        self.moves = 1

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls(len(data) // (2 * SLOTS))
        out.table = np.frombuffer(data, dtype="<u2").copy()
        return out

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @staticmethod
    def fingerprint(digest: bytes) -> int:
        return int.from_bytes(digest[8:10], "little") or 1

    def home(self, digest: bytes) -> int:
        return int.from_bytes(digest[4:8], "little") & (self.buckets - 1)

    def other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def _slot(self, bucket: int, mark: int) -> int:
        found = np.flatnonzero(self.table[bucket * SLOTS:(bucket + 1) * SLOTS] == mark)
        return bucket * SLOTS + int(found[0]) if len(found) else -1

    def __contains__(self, digest: bytes) -> bool:
        mark, home = self.fingerprint(digest), self.home(digest)
        return self._slot(home, mark) >= 0 or self._slot(self.other(home, mark), mark) >= 0

    def insert(self, digest: bytes) -> bool:
        """False if no place was found; the filter must then be rebuilt larger from the stored keys."""
        mark, bucket = self.fingerprint(digest), self.home(digest)
        for place in (bucket, self.other(bucket, mark)):
            if (slot := self._slot(place, 0)) >= 0:
                self.table[slot] = mark
                return True
        for _ in range(KICKS):
            self.moves = (self.moves * 1103515245 + 12345) & 0x7FFFFFFF
            slot = bucket * SLOTS + (self.moves >> 16) % SLOTS
            mark, self.table[slot] = int(self.table[slot]), mark
            bucket = self.other(bucket, mark)
            if (free := self._slot(bucket, 0)) >= 0:
                self.table[free] = mark
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        mark, home = self.fingerprint(digest), self.home(digest)
        for place in (home, self.other(home, mark)):
            if (slot := self._slot(place, mark)) >= 0:
                self.table[slot] = 0
                return True
        return False


class CuckooIndex:
    """A filter with the content it stands for: bucket -> digest -> (keep_id, group_size, n_least)."""

    def __init__(self, buckets: int = 64):
        self.filter = CuckooFilter(buckets)
        self.content: dict[int, dict[bytes, tuple]] = {}
        self.resizes = 0

    def _bucket(self, digest: bytes) -> dict[bytes, tuple]:
        return self.content.setdefault(self.filter.home(digest), {})

    def get(self, digest: bytes):
        """The entry of a live digest, else None: filter first, then the stored digests of the bucket."""
        if digest not in self.filter:
            return None
        return self.content.get(self.filter.home(digest), {}).get(digest)

    def insert(self, digest: bytes, doc_id, n: int, n_least: int) -> None:
        old = self.get(digest)
        if old is not None:
            self._bucket(digest)[digest] = _merged(old, (doc_id, n, n_least))
            return
        self._bucket(digest)[digest] = (doc_id, n, n_least)
        if not self.filter.insert(digest):
            self._resize()

    def delete(self, digest: bytes) -> bool:
        if self.get(digest) is None:
            return False
        del self._bucket(digest)[digest]
        self.filter.delete(digest)
        return True

    def _resize(self) -> None:
        keys = [(d, e) for bucket in self.content.values() for d, e in bucket.items()]
        size = self.filter.buckets
        while True:
            size *= 2
            self.filter = CuckooFilter(size)
            self.resizes += 1
            if all(self.filter.insert(d) for d, _ in keys):
                break
        self.content = {}
        for d, e in keys:
            self._bucket(d)[d] = e

    def rows(self, shard: int) -> Iterator[tuple]:
        yield shard, None, None, None, None, self.filter.to_bytes()
        for bucket in self.content.values():
            for digest, entry in bucket.items():
                yield (shard, digest, *entry, None)

    @classmethod
    def load(cls, rows: pd.DataFrame, room: int = 0) -> CuckooIndex:
        out = cls(max(64, math.ceil(room / (SLOTS * 0.9))))
        stored = rows[rows["filter"].notna()]
        if len(stored):
            out.filter = CuckooFilter.from_bytes(bytes(stored["filter"].iloc[0]))
        for r in rows[rows["digest"].notna()].itertuples(index=False):
            out._bucket(bytes(r.digest))[bytes(r.digest)] = (_int(r.keep_id), int(r.group_size), int(r.n_least))
        return out


def _int(value):
    return None if value is None or value is pd.NA or value != value else int(value)


def _merged(a: tuple, b: tuple) -> tuple:
    """Smaller id (NULL largest), rows in all, rows that carry the smaller id."""
    n = a[1] + b[1]
    if a[0] == b[0]:
        return a[0], n, a[2] + b[2]
    least = b if a[0] is None or (b[0] is not None and b[0] < a[0]) else a
    return least[0], n, least[2]


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the SHA-256 of each whole text with every run of white space as one space."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"))


def _digest():
    return F.unhex(F.sha2(F.regexp_replace(text_of(), SPACE, " "), 256))


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per digest and batch, so that a hot digest reaches its shard as a few rows."""
    for rows in batches:
        found: dict[bytes, tuple] = {}
        for digest, doc_id in zip(rows["digest"], rows["doc_id"], strict=True):
            entry = (_int(doc_id), 1, 1)
            digest = bytes(digest)
            old = found.get(digest)
            found[digest] = entry if old is None else _merged(old, entry)
        yield pd.DataFrame({"digest": list(found), "keep_id": pd.array([e[0] for e in found.values()], "Int64"),
                            "n": [e[1] for e in found.values()], "n_least": [e[2] for e in found.values()]})


def _shards(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int"))


def _frame(index: CuckooIndex, shard: int) -> pd.DataFrame:
    columns = dict(zip(["shard", "digest", "keep_id", "group_size", "n_least", "filter"], zip(*index.rows(shard), strict=True),
                       strict=True))
    return pd.DataFrame({name: pd.array(values, "Int64") if name in ("keep_id", "group_size", "n_least") else list(values)
                         for name, values in columns.items()})


def _carried(index: DataFrame) -> DataFrame:
    return index.withColumn("keep_id", carried("keep_id"))


def insert(index: DataFrame | None, found: DataFrame, n_shards: int) -> DataFrame:
    """The index (None: a new one of ``n_shards``) with the digests of ``found`` added."""
    rows = found.select(carried("doc_id"), "digest").mapInPandas(_summaries, "digest binary, keep_id long, n long, n_least long")
    new = _shards(rows, n_shards).withColumn("keep_id", carried("keep_id"))

    def fill(key: tuple, old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = CuckooIndex.load(old, rows["digest"].nunique() if len(old) == 0 else 0)
        for r in rows.itertuples(index=False):
            out.insert(bytes(r.digest), _int(r.keep_id), int(r.n), int(r.n_least))
        return _frame(out, int(key[0]))

    if index is None:
        index = found.sparkSession.createDataFrame([], INDEX)
    return _carried(index).groupBy("shard").cogroup(new.groupBy("shard")).applyInPandas(fill, INDEX)


def delete(index: DataFrame, gone: DataFrame, n_shards: int) -> DataFrame:
    """The index without the digests of ``gone`` (column ``digest``); digests it doesn't hold are ignored."""
    def drop(key: tuple, old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = CuckooIndex.load(old)
        for digest in rows["digest"]:
            out.delete(bytes(digest))
        return _frame(out, int(key[0]))

    dropped = _shards(gone.filter(F.col("digest").isNotNull()).select("digest").distinct(), n_shards)
    return _carried(index).groupBy("shard").cogroup(dropped.groupBy("shard")).applyInPandas(drop, INDEX)


def shard_count(n_rows: int, shard_keys: int = SHARD_KEYS) -> int:
    return max(1, math.ceil(n_rows / shard_keys))


def build_index(found: DataFrame, n_rows: int, shard_keys: int = SHARD_KEYS) -> DataFrame:
    return insert(None, found, shard_count(n_rows, shard_keys))


def live(index: DataFrame) -> DataFrame:
    """The index's keys: digest, keep_id, group_size, n_least."""
    return index.filter(F.col("digest").isNotNull()).select("digest", "keep_id", "group_size", "n_least")


def assign(docs: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, keep_id, group_size, n_least, kept."""
    found = stage(digests(docs), "digests")
    n = found.count()
    index = stage(build_index(found, n, shard_keys), "cuckoo")
    rows = attach(found, live(index), ["digest"], "group_size", n)
    least = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    once = rows.filter(~least | (F.col("n_least") == 1)).withColumn("kept", least)
    # rows that repeat the staying id: one of them stays
    order = Window.partitionBy("digest").orderBy("doc_id")
    again = rows.filter(least & (F.col("n_least") > 1)).withColumn("kept", F.row_number().over(order) == 1)
    return once.unionByName(again)


def keep_first(docs: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    stays = stage(assign(docs, shard_keys).filter("kept"), "kept").select(
        F.col("doc_id").alias("__tw_id"), F.col("digest").alias("__tw_digest"), F.col("n_least").alias("__tw_least"))
    keyed = docs.withColumn("__tw_own", _digest())
    rows = keyed.join(stays, F.col("__tw_own").eqNullSafe(F.col("__tw_digest"))
                      & F.col("doc_id").cast("long").eqNullSafe(F.col("__tw_id")))
    out = rows.filter("__tw_least = 1").unionByName(
        rows.filter("__tw_least > 1").dropDuplicates(["__tw_digest"]))
    return out.select(*docs.columns)
