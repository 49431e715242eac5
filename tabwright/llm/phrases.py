"""Collocations by dynamic itemset counting: lengths are interleaved in cyclic scans of shards.

The documents are cut into blocks of numbered words once, dealt to ``SHARDS`` shards, which are scanned one after the other, round
and round. Words are counted from the start. A longer phrase becomes active in the scan after both its subphrases (without its
last, without its first word) have reached ``minimum`` in the counts so far, and is counted for the next ``SHARDS`` scans, one full
cycle; then it is complete. The scans end when nothing has been reached for a cycle.

Counts of a scan are written as they are (the log). Most phrases are rare, so only counts of some size (``floor``, chosen so that a
phrase with ``minimum`` has one in some shard) are added up in the table of counters after each scan; the small counts of phrases
that these could lift to the minimum are looked up in the log at the end of each cycle. All sums are exact.

A scan asks whether a subphrase was reached, and when, in a table of hashed slots (``_gate``) whose size is bounded by
``MOST_SLOTS``. A slot shared by phrases that were reached at different times counts as ambiguous: what hangs on it is counted in
every scan. Slots hit by accident do the same for phrases that are not active. Either way a shard adds to a counter at most
once, so the gate decides how much is counted and never what the counts are.

Pieces, words and scores: ``split_words`` and ``score_phrases``. Defined cases: a NULL or empty text has no words, a NULL language
is ``und``; rows that repeat an id are counted each for itself; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import text_of
from tabwright.session import BROADCAST_ROWS, new_path, stage

SHARDS, LONGEST = 3, 5
#: Words of a block, and the largest gate in slots (one byte each).
BLOCK_WORDS, MOST_SLOTS = 2_000_000, 1 << 26
AMBIGUOUS = 255
_MIX, _SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BREAK = b"\n"
_LETTERS = bytearray(range(256))
for _c in range(65, 91):
    _LETTERS[_c] = _c + 32
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _LETTERS[_c] = 10
_LETTERS[9] = 32
BLOCKS = "shard int, words binary, langs binary, names string, x binary"
COUNTERS = "lang string, phrase string, k int, c long"


def split_words(text: str) -> list[bytes]:
    """The words of a text in order, ``_BREAK`` between pieces (and empty strings, which count for nothing)."""
    return text.encode("utf-8", "replace").translate(bytes(_LETTERS)).replace(_BREAK, b" \n ").split(b" ")


def _word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def _slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(_SPREAD)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _extend(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (hashes ^ (hashes >> np.uint64(31))) * np.uint64(_MIX) + words


class _Words(dict):
    """Numbers of the words of one language, from a counter that all languages share."""

    def __init__(self, names: list[bytes], langs: list[int], lang: int):
        super().__init__({_BREAK: 0, b"": -1})
        self.names, self.langs, self.lang = names, langs, lang

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.names)
        self.names.append(word)
        self.langs.append(self.lang)
        return number


def _blocks(shards: int, block_words: int):
    """Documents to blocks: ``x`` numbers the words (0: a break), ``words`` and ``langs`` are by number, ``names`` the languages."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, held, words, langs, seen, known = TaskContext.get().partitionId(), [], 0, [_BREAK], [0], [], {}

        def close() -> pa.RecordBatch:
            x = np.concatenate(parts)
            return pa.RecordBatch.from_arrays([
                pa.array([shard % shards], pa.int32()), pa.array([b"".join(w + _BREAK for w in words[1:])], pa.binary()),
                pa.array([np.array(langs, dtype="<i4").tobytes()], pa.binary()), pa.array([json.dumps(seen)]),
                pa.array([x[x >= 0].astype("<i4").tobytes()], pa.binary())], ["shard", "words", "langs", "names", "x"])

        for rows in batches:
            for lang, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                if lang not in known:
                    known[lang] = _Words(words, langs, len(seen))
                    seen.append(lang)
                cut = split_words(text.as_py())
                parts += [np.fromiter(map(known[lang].__getitem__, cut), dtype=np.int32, count=len(cut)),
                          np.zeros(1, dtype=np.int32)]
                held += len(cut)
                if held >= block_words:
                    yield close()
                    shard, parts, held, words, langs, seen, known = shard + 1, [], 0, [_BREAK], [0], [], {}
        if parts:
            yield close()
    return run


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes and their numbers."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.diff(first, append=len(codes))


def _count(x: np.ndarray, hashes: np.ndarray, seeds: np.ndarray, scan: int, shards: int, longest: int,
           gate: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers of each phrase, counts) of the phrases active in this scan, one length after the other; ``hashes`` and
    ``seeds`` (of the language) are by word number."""
    n_words = len(hashes)
    if scan <= shards:
        counted = np.bincount(x, minlength=n_words)
        counted[0] = 0
        own = np.flatnonzero(counted)
        yield own[:, None], counted[own]
    if gate is None:
        return
    bits = len(gate).bit_length() - 1
    with np.errstate(over="ignore"):
        word = _extend(seeds, hashes)
        by_word = gate[_slot(word, bits)]
        by_word[0] = 0
        # per position: when the phrase of the present length that begins there was reached (0: not), its hash and its code
        reached = by_word[x]
        at = np.flatnonzero(reached)
        codes = x[at].astype(np.int64)
        mixed = word[codes]
        for k in range(2, longest + 1):
            both = np.flatnonzero(np.diff(at) == 1)
            if not len(both):
                return
            start = at[both]
            one, two = reached[start].astype(np.int16), reached[start + 1].astype(np.int16)
            since = np.maximum(one, two)
            last = x[start + k - 1]
            codes = codes[both] * np.int64(n_words) + last
            now = np.flatnonzero((since == AMBIGUOUS) | (since + shards >= scan))
            if k == 2:
                found, counts = _distinct(codes[now])
                yield np.stack([found // n_words, found % n_words], axis=1), counts
            elif len(now):
                _, first, counts = np.unique(codes[now], return_index=True, return_counts=True)
                yield x[start[now[first]][:, None] + np.arange(k)], counts
            if k == longest:
                return
            mixed = _extend(mixed[both], hashes[last])
            own = gate[_slot(mixed, bits)]
            reached = np.zeros(len(x), dtype=np.uint8)
            reached[start] = own
            left = np.flatnonzero(own)
            at, mixed = start[left], mixed[left]
            # numbers instead of codes, so that the next ones stay within 64 bits
            codes = np.unique(codes[left], return_inverse=True)[1].astype(np.int64)


def _scanner(scan: int, shards: int, longest: int, gate):
    def batch(lang, phrase, k: int, counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(counts), k, dtype=np.int32)),
                                           pa.array(counts.astype(np.int64))], ["lang", "phrase", "k", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if gate is None else np.frombuffer(gate.value, dtype=np.uint8)
        for rows in batches:
            for words, langs, names, x in zip(*(rows.column(j).to_pylist() for j in range(4)), strict=True):
                words, seen = [_BREAK, *words.split(_BREAK)[:-1]], json.loads(names)
                x, langs = np.frombuffer(x, dtype="<i4"), np.frombuffer(langs, dtype="<i4")
                texts, names = pa.array(words, pa.binary()).cast(pa.string()), pa.array(seen, pa.string())
                if scan <= shards:
                    whole = np.bincount(langs[x[x > 0]], minlength=len(seen))
                    yield batch(names, pa.array([""] * len(seen)), 0, whole)
                hashes = np.array([_word_hash(w) for w in words], dtype=np.uint64)
                seeds = np.array([_word_hash(n.encode()) for n in seen], dtype=np.uint64)[langs]
                for phrase, counts in _count(x, hashes, seeds, scan, shards, longest, table):
                    for a in range(0, len(counts), 200_000):
                        own = phrase[a:a + 200_000]
                        parts = [texts.take(pa.array(own[:, i])) for i in range(own.shape[1])]
                        yield batch(names.take(pa.array(langs[own[:, 0]])), pc.binary_join_element_wise(*parts, " "),
                                    own.shape[1], counts[a:a + 200_000])
    return run


def _gate(reached: DataFrame, how_many: int):
    """The slots of the ``how_many`` phrases of ``reached(lang, phrase, reach)``, broadcast."""
    bits = max(16, min(MOST_SLOTS.bit_length() - 1, (16 * how_many).bit_length()))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            hashes = np.zeros(rows.num_rows, dtype=np.uint64)
            for i, (lang, phrase) in enumerate(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)):
                words = np.array([_word_hash(w.encode()) for w in (lang, *phrase.split(" "))], dtype=np.uint64)
                with np.errstate(over="ignore"):
                    own = words[:1]
                    for j in range(1, len(words)):
                        own = _extend(own, words[j:j + 1])
                hashes[i] = own[0]
            with np.errstate(over="ignore"):
                found = _slot(hashes, bits)
            yield pa.RecordBatch.from_arrays([pa.array(found), rows.column(2)], ["slot", "reach"])

    # at most one row a slot, whatever the corpus
    rows = reached.mapInArrow(slots, "slot long, reach int").groupBy("slot").agg(
        F.min("reach").alias("lo"), F.max("reach").alias("hi")).select(
        F.col("slot").cast("int"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(AMBIGUOUS).cast("int").alias("v")).toPandas()
    table = np.zeros(1 << bits, dtype=np.uint8)
    table[rows["slot"].to_numpy()] = rows["v"].to_numpy()
    return reached.sparkSession.sparkContext.broadcast(table.tobytes())


class _Counts:
    """The log of all scans, and the counters: (lang, phrase, k, c, mask of the shards counted, reach)."""

    def __init__(self, spark, minimum: int, shards: int):
        self.spark, self.minimum, self.shards = spark, minimum, shards
        # a phrase with ``minimum`` has a count of twice the floor in some shard
        self.floor = max(1, minimum // (2 * shards))
        self.log, self.counters = [], None

    def add(self, fresh: DataFrame, shard: int) -> None:
        """Add the counts of one shard; one that has been added already does not count again."""
        fresh = stage(fresh.groupBy("lang", "phrase").agg(F.max("k").alias("k"), F.sum("c").alias("c")), "counts")
        self.log.append(fresh.filter(f"c < {self.floor} and k > 0").select("lang", "phrase", F.lit(shard).alias("shard"), "c"))
        rows = fresh.filter(f"c >= {self.floor} or k = 0").select(
            "lang", "phrase", "k", F.col("c").alias("new"), F.lit(0).cast("long").alias("c"), F.lit(0).alias("mask"),
            F.lit(None).cast("int").alias("reach"))
        if self.counters is not None:
            rows = rows.unionByName(self.counters.withColumn("new", F.lit(0).cast("long")))
        rows = rows.groupBy("lang", "phrase").agg(F.max("k").alias("k"), F.sum("new").alias("new"), F.max("c").alias("c"),
                                                  F.max("mask").alias("mask"), F.max("reach").alias("reach"))
        bit = 1 << shard
        first = (F.col("new") > 0) & (F.col("mask").bitwiseAND(F.lit(bit)) == 0)
        self.counters = rows.select("lang", "phrase", "k", (F.col("c") + F.when(first, F.col("new")).otherwise(0)).alias("c"),
                                    F.when(first, F.col("mask").bitwiseOR(F.lit(bit))).otherwise(F.col("mask")).alias("mask"), "reach")

    def liftable(self, counters: DataFrame) -> DataFrame:
        """Phrases that small counts, in the shards where they have no other, may lift to the minimum."""
        missing = self.shards - F.bit_count("mask")
        return counters.filter((F.col("k") > 0) & (missing > 0) & (F.col("c") + missing * (self.floor - 1) >= self.minimum))

    def small(self, which: DataFrame, scans: int) -> DataFrame:
        """What the small counts in the log of the last ``scans`` scans add to the phrases of ``which``: (lang, phrase, more)."""
        log, which = reduce(DataFrame.unionByName, self.log[-scans:]), which.select("lang", "phrase")
        if which.count() <= BROADCAST_ROWS:
            which = F.broadcast(which)
        return log.join(which, ["lang", "phrase"], "left_semi") \
            .groupBy("lang", "phrase", "shard").agg(F.max("c").alias("c")) \
            .groupBy("lang", "phrase").agg(F.sum("c").alias("more"))

    def close(self, scan: int, longest: int, with_log: bool) -> DataFrame:
        """Write the counters, with the phrases reached by this scan marked; those that can have longer ones after them."""
        rows, total = self.counters, F.col("c")
        if with_log:
            rows = stage(rows, "counters")
            # a cycle that ended since the last look lies within two
            open_ = self.liftable(rows).filter(f"reach is null and k < {longest} and c < {self.minimum}")
            rows = rows.join(self.small(open_, 2 * self.shards), ["lang", "phrase"], "left")
            total = F.col("c") + F.coalesce("more", F.lit(0))
        now = F.when((total >= self.minimum) & (F.col("k") > 0), F.lit(scan))
        self.counters = stage(rows.withColumn("reach", F.coalesce("reach", now)).drop("more"), "counters")
        return self.counters.filter(f"reach is not null and k between 1 and {longest - 1}").select("lang", "phrase", "reach")

    def totals(self) -> DataFrame:
        more = self.small(self.liftable(self.counters), len(self.log))
        exact = self.counters.filter("k > 0").join(more, ["lang", "phrase"], "left").select(
            "lang", "phrase", "k", (F.col("c") + F.coalesce("more", F.lit(0))).alias("c")).filter(f"c >= {self.minimum}")
        return exact.unionByName(self.counters.filter("k = 0").select("lang", "phrase", "k", "c"))


def count_phrases(docs: DataFrame, minimum: int, longest: int = LONGEST, shards: int = SHARDS,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """(lang, phrase, k, c) of all phrases of up to ``longest`` words that occur at least ``minimum`` times in their language;
    k = 0 holds the words of the language altogether."""
    spark = docs.sparkSession
    path = new_path(spark, "blocks")
    docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text")) \
        .mapInArrow(_blocks(shards, block_words), BLOCKS).write.option("compression", "zstd").partitionBy("shard").parquet(path)
    blocks = spark.read.schema("words binary, langs binary, names string, x binary, shard int").parquet(path)
    counts, gate, last, scan, settled = _Counts(spark, minimum, shards), None, 0, 0, False
    while scan < shards or scan < last + shards or not settled:
        scan += 1
        shard = (scan - 1) % shards
        counts.add(blocks.filter(F.col("shard") == shard).drop("shard").mapInArrow(
            _scanner(scan, shards, longest, gate), COUNTERS), shard)
        # at the end of a cycle, and before the end of all, the log may lift phrases to the minimum
        settled = shard == shards - 1 or scan >= max(shards, last + shards)
        reached = counts.close(scan, longest, settled)
        how_many, latest = reached.agg(F.count("*"), F.max("reach")).first()
        if latest == scan:
            last = scan
            if gate is not None:
                gate.destroy()
            gate = _gate(reached, how_many)
    return counts.totals()


def _part(first: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice("words", first, length), " ")


def score_phrases(counted: DataFrame, best: int) -> DataFrame:
    """The ``best`` candidates of each language by score: lang, rank, phrase, a, l, r, n, score.

    A candidate's score is the least floor(1000 * a * n / (l * r)) over its cuts. Candidates that stand inside a longer one
    of the same count are left out; the longer one by one word decides, as counts never rise with length.
    """
    found = counted.filter("k >= 2").withColumn("words", F.split("phrase", " ")).withColumnRenamed("c", "a")
    inside = found.filter("k >= 3").select("lang", "a", F.explode(F.array(
        _part(1, F.col("k") - 1), _part(2, F.col("k") - 1))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = found.join(inside, ["lang", "phrase"], "left").filter("longer is null or longer < a")
    cuts = kept.select("lang", "phrase", "a", "k", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", _part(1, F.col("cut")).alias("first"),
        _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    parts = counted.filter("k >= 1").select("lang", F.col("phrase").alias("part"), "c")
    sizes = counted.filter("k = 0").select("lang", F.col("c").alias("n"))
    joined = cuts.join(parts.withColumnsRenamed({"part": "first", "c": "l"}), ["lang", "first"]) \
        .join(parts.withColumnsRenamed({"part": "rest", "c": "r"}), ["lang", "rest"]).join(sizes, "lang")
    wide = {x: F.col(x).cast("decimal(19,0)") for x in "alrn"}
    joined = joined.withColumns({"above": F.lit(1000).cast("decimal(4,0)") * (wide["a"] * wide["n"]), "below": wide["l"] * wide["r"]})
    scored = joined.withColumn("score", F.expr("above div below")).groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", F.row_number().over(order)) \
        .filter(F.col("rank") <= best).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, minimum: int = 100, best: int = 2000, longest: int = LONGEST, shards: int = SHARDS,
                 block_words: int = BLOCK_WORDS) -> DataFrame:
    counted = stage(count_phrases(docs, minimum, longest, shards, block_words), "phrases")
    return score_phrases(counted, best)
