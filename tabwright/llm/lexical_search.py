"""Ranked lexical search: posting lists in geometric blocks with coordinatewise-maximum summaries.

Terms are runs of letters, digits and characters beyond ASCII, with only A-Z lower-cased. A document scores, for each term of
a query (repeats included), weight(term) times saturation(term, document); both are integers (``weight_of``, ``saturations``).

The index is cut into shards of documents, one row each, written to the shared folder. Within a shard every term's posting
list is clustered by document similarity (nearest of some of its own documents in a random projection) into blocks, and each
block stores the largest saturation of each term over its documents. A search walks a query's lists in descending order of
what their term can still add, bounds each block by its summary and scores only the documents of blocks whose bound reaches
the k-th best score so far. It stops when the lists not yet walked cannot reach it together. Bounds are exact integers and ties are
not skipped, so the result is that of scoring everything.

Queries are searched in blocks of about ``QUERY_CHARS`` characters; a summary keeps the coordinates that stand beside the
list's term in some query of the block, no other can enter a bound. Shards are bounded in documents and in cells, so memory is
bounded; nothing is grouped by term, so frequent words make no hot key. Each task keeps its k best per query, Spark ranks those.

Defined cases: a NULL or empty text has no terms and is found by no query; a query without terms gives no rows; rows that
repeat a doc_id are ranked each for itself, a NULL doc_id after the others; rows that repeat an item_id (also a NULL one) are
queries of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.llm.common import text_of
from tabwright.session import new_path, stage

#: Characters of queries searched together, and documents and matrix cells of a shard.
QUERY_CHARS, SHARD_DOCS, SHARD_CELLS = 100_000, 8192, 1 << 22
#: Summary entries of a list (a list with more coordinates has one block), and dimensions of the projection.
LIST_ENTRIES, DIMENSIONS = 8192, 16
#: Bytes of shards sent to a worker at a time.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20)
_BINARY = ["doc_ids", "no_id", "start", "term", "value", "lists", "list_block", "block_doc", "docs", "summary"]
INDEX = "shard long, " + ", ".join(f"{c} binary" for c in _BINARY)
VECTORS = "doc_id long, n long, terms array<int>, tfs array<long>"
#: Letters and digits, A-Z lower-cased; other ASCII separates.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TERMS).split()


def weight_of(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def saturations(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """How much a term that occurs ``tf`` times counts in a document of ``n`` terms, in millionths."""
    m = 100 - 75 + (75 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass
class QueryBlock:
    """The terms of a block of queries; ``weights`` once the documents have been counted."""

    items: list                                    # item ids, a query each
    queries: list[dict[int, int]]                  # term -> times, for each
    vocabulary: dict[bytes, int]
    n_docs: int = 0
    n_terms: int = 0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    def coordinates(self) -> list[np.ndarray]:
        """For each term the terms that some query has beside it, ascending."""
        beside: list[set[int]] = [set() for _ in self.vocabulary]
        for query in self.queries:
            for t in query:
                beside[t].update(query)
        return [np.array(sorted(x), dtype=np.int64) for x in beside]


def query_blocks(queries: DataFrame, chars: int = QUERY_CHARS) -> Iterator[QueryBlock]:
    """The queries in blocks of about ``chars`` characters; the driver holds one block at a time."""
    rows = queries.select("item_id", text_of().alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / chars))
    for k in range(blocks):
        found = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        vocabulary: dict[bytes, int] = {}
        counted = [{vocabulary.setdefault(t, len(vocabulary)): c for t, c in Counter(terms_of(r.text)).items()} for r in found]
        if vocabulary:
            yield QueryBlock([r.item_id for r in found], counted, vocabulary)


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document with at least one term: its number of terms, and how often it holds which terms of the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for batch in batches:
            keep, n, terms, tfs, ends = [], [], [], [], [0]
            for i, text in enumerate(batch.column(1)):
                words = terms_of(text.as_py())
                if words:
                    counted = Counter(words)
                    mine = counted.keys() & known
                    keep.append(i)
                    n.append(len(words))
                    terms += [vocabulary[t] for t in mine]
                    tfs += [counted[t] for t in mine]
                    ends.append(len(terms))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(terms, pa.int32())),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tfs, pa.int64()))], ["doc_id", "n", "terms", "tfs"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, VECTORS)


def _clusters(sketch: np.ndarray, docs: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents of a list, block by block, and where blocks begin."""
    if wanted <= 1:
        return docs, np.zeros(1, dtype=np.int64)
    centres = docs[np.linspace(0, len(docs) - 1, wanted).astype(np.int64)]
    own = (sketch[docs] @ sketch[centres].T).argmax(axis=1)
    order = np.argsort(own, kind="stable")
    own = own[order]
    return docs[order], np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])


def _shard(number: int, ids: list, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray,
           block: QueryBlock, coordinates: list[np.ndarray], axes: np.ndarray) -> list:
    n_docs, width = len(sizes), len(block.vocabulary)
    start = np.concatenate([[0], np.cumsum(sizes)])
    rows = np.repeat(np.arange(n_docs), sizes)
    value = saturations(tfs, np.repeat(n, sizes), block.n_docs, block.n_terms).astype(np.int32)
    cells = np.zeros((n_docs, width), dtype=np.int32)
    cells[rows, terms] = value
    sketch = np.zeros((n_docs, axes.shape[1]), dtype=np.float32)
    there = np.flatnonzero(sizes)
    if len(there):
        moved = (value * (block.weights[terms] / 1e9)).astype(np.float32)[:, None] * axes[terms]
        sketch[there] = np.add.reduceat(moved, start[there], axis=0)
    sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-12)
    by_term = np.argsort(terms, kind="stable")
    lists, first = np.unique(terms[by_term], return_index=True)
    ends = np.append(first, len(terms))[1:]
    list_block, block_doc, docs, summary = [0], [], [], []
    at = 0
    for t, a, b in zip(lists.tolist(), first.tolist(), ends.tolist(), strict=True):
        beside = coordinates[t]
        wanted = max(1, min(math.ceil(math.sqrt(b - a)), LIST_ENTRIES // len(beside)))
        held, begins = _clusters(sketch, rows[by_term[a:b]], wanted)
        summary.append(np.maximum.reduceat(cells[np.ix_(held, beside)], begins, axis=0).ravel())
        docs.append(held)
        block_doc.append(begins + at)
        at += len(held)
        list_block.append(list_block[-1] + len(begins))
    join = lambda parts, kind: (np.concatenate(parts) if parts else np.zeros(0)).astype(kind).tobytes()       # noqa: E731
    return [number, np.array([0 if i is None else i for i in ids], dtype=np.int64).tobytes(),
            np.array([i is None for i in ids], dtype=bool).tobytes(), start.astype(np.int64).tobytes(),
            terms.astype(np.int32).tobytes(), value.tobytes(), lists.astype(np.int32).tobytes(),
            np.array(list_block, dtype=np.int64).tobytes(), join([*block_doc, [at]], np.int64), join(docs, np.int32),
            join(summary, np.int32)]


def _arrow(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
                                      ["shard", *_BINARY])


def build_index(counted: DataFrame, block: QueryBlock) -> DataFrame:
    """Index rows (``INDEX``), one a shard, of the vectors ``counted``."""
    width = len(block.vocabulary)
    limit = max(1, min(SHARD_DOCS, SHARD_CELLS // width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coordinates = block.coordinates()
        axes = np.random.default_rng(7).standard_normal((width, DIMENSIONS)).astype(np.float32)
        part, shards = TaskContext.get().partitionId(), 0
        for batch in _regrouped(batches, limit):
            ids, n, terms, tfs = (batch.column(c).combine_chunks() for c in ("doc_id", "n", "terms", "tfs"))
            yield _arrow([_shard((part << 32) + shards, ids.to_pylist(), n.to_numpy(), terms.value_lengths().to_numpy(),
                                 terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy(), block,
                                 coordinates, axes)])
            shards += 1
    return counted.mapInArrow(run, INDEX)


def _regrouped(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """The rows of the batches in tables of ``limit`` rows, the last one shorter."""
    held, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            own = batch.slice(0, limit - rows)
            held.append(own)
            rows += own.num_rows
            batch = batch.slice(own.num_rows)
            if rows == limit:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


class _Best:
    """The k best documents of a query so far."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1
        self.score = np.zeros(0, dtype=np.int64)
        self.doc = np.zeros(0, dtype=np.int64)
        self.no_id = np.zeros(0, dtype=bool)

    def add(self, score: np.ndarray, doc: np.ndarray, no_id: np.ndarray) -> None:
        good = score >= self.floor
        score = np.concatenate([self.score, score[good]])
        doc, no_id = np.concatenate([self.doc, doc[good]]), np.concatenate([self.no_id, no_id[good]])
        order = np.lexsort((doc, no_id, -score))[:self.k]
        self.score, self.doc, self.no_id = score[order], doc[order], no_id[order]
        if len(order) == self.k:
            self.floor = max(1, int(self.score[-1]))


class _Reader:
    """One shard of the index."""

    def __init__(self, row: dict, coordinates: list[np.ndarray], width: int):
        kinds = dict(doc_ids=np.int64, no_id=bool, start=np.int64, term=np.int32, value=np.int32, lists=np.int32,
                     list_block=np.int64, block_doc=np.int64, docs=np.int32, summary=np.int32)
        for name, kind in kinds.items():
            setattr(self, name, np.frombuffer(row[name], dtype=kind))
        self.cells = np.zeros((len(self.doc_ids), width), dtype=np.int32)
        self.cells[np.repeat(np.arange(len(self.doc_ids)), np.diff(self.start)), self.term] = self.value
        self.summaries, at = {}, 0
        for i, t in enumerate(self.lists.tolist()):
            size = int(self.list_block[i + 1] - self.list_block[i]), len(coordinates[t])
            self.summaries[t] = i, self.summary[at:at + size[0] * size[1]].reshape(size)
            at += size[0] * size[1]

    def search(self, terms: np.ndarray, weights: np.ndarray, places: dict[int, np.ndarray], best: _Best) -> int:
        """Add this shard's documents to ``best``; the number of documents scored."""
        walk = []
        for t in terms.tolist():
            if t in self.summaries:
                number, summary = self.summaries[t]
                bounds = summary[:, places[t]].astype(np.int64) @ weights
                own = int(np.searchsorted(terms, t))
                walk.append((int(summary[:, places[t][own]].max()) * int(weights[own]), number, bounds))
        walk.sort(key=lambda x: (-x[0], x[1]))
        left = sum(w[0] for w in walk)
        seen = np.zeros(len(self.doc_ids), dtype=bool)
        for most, number, bounds in walk:
            if left < best.floor:
                break
            left -= most
            order, at, step = np.argsort(-bounds, kind="stable"), 0, 2
            first = self.list_block[number]
            while at < len(order) and bounds[order[at]] >= best.floor:
                chosen = [b for b in order[at:at + step].tolist() if bounds[b] >= best.floor]
                docs = np.concatenate([self.docs[self.block_doc[first + b]:self.block_doc[first + b + 1]] for b in chosen])
                docs = docs[~seen[docs]]
                seen[docs] = True
                if len(docs):
                    best.add(self.cells[np.ix_(docs, terms)].astype(np.int64) @ weights, self.doc_ids[docs], self.no_id[docs])
                at, step = at + step, step * 2
        return int(seen.sum())


def stored(index: DataFrame) -> DataFrame:
    """The index, written with a row group a shard, so that a reader holds no more than one of them."""
    spark, path = index.sparkSession, new_path(index.sparkSession, "index")
    index.write.option("parquet.block.row.count.limit", 1).option("compression", "zstd").parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def search_index(index: DataFrame, block: QueryBlock, k: int) -> DataFrame:
    """(query, doc_id, score): at least the k best of each query, at most k from each task."""
    width = len(block.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coordinates = block.coordinates()
        asked = []
        for query in block.queries:
            terms = np.array(sorted(t for t in query if block.weights[t] > 0), dtype=np.int64)
            weights = np.array([query[t] for t in terms.tolist()], dtype=np.int64) * block.weights[terms]
            asked.append((terms, weights, {t: np.searchsorted(coordinates[t], terms) for t in terms.tolist()}, _Best(k)))
        for batch in batches:
            for i in range(batch.num_rows):
                shard = _Reader({c: batch.column(c)[i].as_buffer() for c in _BINARY}, coordinates, width)
                for query in asked:
                    shard.search(*query)
        for number, (*_, best) in enumerate(asked):
            if len(best.doc):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(best.doc), number, dtype=np.int32)), pa.array(best.doc, mask=best.no_id),
                    pa.array(best.score)], ["query", "doc_id", "score"])
    return index.mapInArrow(run, "query int, doc_id long, score long")


def _counted(docs: DataFrame, block: QueryBlock) -> DataFrame:
    """The staged vectors; fills in the block's counts and weights."""
    counted = stage(vectors(docs, block.vocabulary), "vectors")
    n, total = counted.agg(F.count("*"), F.sum("n")).first()
    block.n_docs, block.n_terms = n, max(1, total or 0)
    df = np.zeros(len(block.vocabulary), dtype=np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    block.weights = np.array([weight_of(n, d) for d in df.tolist()], dtype=np.int64)
    return counted


def search(spark: SparkSession, docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k documents with the highest scores above 0 for each row of ``queries(item_id, text)``: item_id, rank, doc_id, score."""
    item_type = queries.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    for block in query_blocks(queries):
        index = stored(build_index(_counted(docs, block), block))
        found = search_index(index, block, k)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        # one row for each query of the block
        names = spark.createDataFrame(list(enumerate(block.items)), f"query int, item_id {item_type}")
        ranked = ranked.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        before = spark.conf.get(BATCH_KEY)
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
        try:
            out = out.unionByName(stage(ranked, "ranked"))
        finally:
            spark.conf.set(BATCH_KEY, before)
    return out
