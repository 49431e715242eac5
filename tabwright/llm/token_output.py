"""Token ids as Simple-8b files in document order, and their reader.

The output is a Parquet folder of chunks. A chunk holds whole documents in ascending id: their ids, the
number of token ids of each, and one Simple-8b sequence of all of them with per-block offsets, so that a
document's ids can be decoded without the rest. Spark's committer writes the folder, so lost executors and
repeated tasks leave no half-written files.

Defined cases: a NULL or empty text is the end id alone; documents with NULL id come first; rows repeating an id
stand side by side, ordered by a hash of their text; an empty table gives an empty folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.llm import simple8b
from tabwright.llm.common import carried, text_of
from tabwright.llm.tokens import encoder

#: Token ids after which a chunk is closed.
CHUNK = 1 << 20
#: Characters encoded at a time.
BATCH_CHARS = 4 << 20
CHUNKS = "part int, chunk int, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"
SCHEMA = "doc_id long, part int, chunk int, start long, n_tokens long, ids_crc32 long"


def text_batches(rows: pd.DataFrame, columns: list[str], text: str, limit: int = BATCH_CHARS) -> Iterator[tuple]:
    """Runs of rows whose texts hold about ``limit`` characters together, as lists."""
    texts = rows[text].tolist()
    lists = [rows[c].tolist() for c in columns]
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= limit or i + 1 == len(texts):
            yield (*[x[begin:i + 1] for x in lists], texts[begin:i + 1])
            begin, held = i + 1, 0


def _writer(path: str, end_id: int):
    tail = np.array([end_id], dtype="<u4").tobytes()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path, True).encode
        part, chunk, held, ids, lengths, pieces = TaskContext.get().partitionId(), 0, 0, [], [], []

        def close():
            payload = simple8b.encode(np.frombuffer(b"".join(pieces), dtype="<u4"))
            return pd.DataFrame({"part": [part], "chunk": [chunk], "n_ids": [held],
                                 "doc_ids": [ids], "lengths": [lengths], "payload": [payload]})

        for rows in batches:
            for doc_ids, texts in text_batches(rows, ["doc_id"], "text"):
                for doc_id, data in zip(doc_ids, encode(texts), strict=True):
                    ids.append(None if doc_id is None else int(doc_id))
                    lengths.append(len(data) // 4 + 1)
                    pieces += [data, tail]
                    held += lengths[-1]
                    if held >= CHUNK:
                        yield close()
                        chunk, held, ids, lengths, pieces = chunk + 1, 0, [], [], []
        if ids:
            yield close()
    return write


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, parts: int) -> None:
    """Encode every whole text, append ``end_id`` and write chunks in ascending document order below ``path``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()) \
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows.select(carried("doc_id"), "text").mapInPandas(_writer(tokenizer, end_id), CHUNKS).write.parquet(path)


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for r in rows.itertuples(index=False):
            ids = simple8b.decode(bytes(r.payload)).astype("<u4")
            lengths = np.asarray(r.lengths, dtype=np.int64)
            starts = np.cumsum(lengths) - lengths
            yield pd.DataFrame({
                "doc_id": pd.array([None if x is None else int(x) for x in r.doc_ids], "Int64"),
                "part": r.part, "chunk": r.chunk, "start": starts, "n_tokens": lengths,
                "ids_crc32": [zlib.crc32(ids[a:a + n].tobytes()) for a, n in zip(starts, lengths, strict=True)]})


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks with their ids as strings (see ``carried``)."""
    return spark.read.schema(CHUNKS).parquet(path).withColumn("doc_ids", F.col("doc_ids").cast("array<string>"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: start (ids of all documents before), n_tokens and the checksum of its ids.

    Chunk sizes are summed per part and parts are summed in a table of one row per part.
    """
    chunks = _chunks(spark, path)
    sizes = chunks.select("part", "chunk", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = sizes.select("part", "chunk", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("chunk"))
                                            - F.col("n_ids")).alias("chunk_start"))
    offsets = inside.join(before, "part")
    return chunks.mapInPandas(_documents, SCHEMA).join(offsets, ["part", "chunk"]).select(
        "doc_id", (F.col("start") + F.col("chunk_start") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The ids themselves: doc_id, ids array<long>."""
    def ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                at = 0
                for doc_id, n in zip(r.doc_ids, r.lengths, strict=True):
                    yield pd.DataFrame({"doc_id": pd.array([None if doc_id is None else int(doc_id)],
                                                           "Int64"),
                                        "ids": [simple8b.decode(bytes(r.payload), at, at + n).astype(np.int64)]})
                    at += int(n)
    return _chunks(spark, path).mapInPandas(ids, "doc_id long, ids array<long>")
