"""N-gram Jaccard join by an LSH forest of MinHash signatures, with exact verification.

Documents with the same set of five-word shingles form a class. A class's signature is cut into trees; a tree is
the sorted list of its labels (``DEPTH`` hash values each), read as a prefix trie. Candidates are sought from the longest common
prefix upwards: prefixes are shortened level by level until classes of the threshold's similarity meet with the target
recall. Subtrees deeper than that join first, so that shallow levels only compare what is not joined yet. Candidates joined
by their signatures form groups; within groups the shingle sets decide exactly, all pairs counted in tiles.

Buckets and groups beyond ``TILE`` members are split into blocks, each pair of blocks being a task of its own: nothing
is dropped and no task grows with a hot group. Only counts and spanning links leave a task, never all pairs.

Defined cases: a text of one to four words is one shingle of all its words; a NULL or empty text has no shingles and links to
nothing; rows repeating an id and a text count as separate documents of one class; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import components, text_of
from tabwright.session import stage

N = 5
THRESHOLD = 0.8
#: Trees, label depth, and the recall at the threshold for which prefixes are shortened.
TREES, DEPTH, RECALL = 16, 6, 0.9999
#: Share of equal signature values from which two classes go to exact verification.
SCREEN = 0.6
#: Most members of a block of a bucket or group.
TILE = 1024


def least_depth(trees: int = TREES, depth: int = DEPTH, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with the target recall."""
    for d in range(depth, 0, -1):
        if 1 - (1 - threshold ** d) ** trees >= recall:
            return d
    return 1


def shingles(text: str, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams."""
    import xxhash
    words = text.translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ")
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words if w), dtype=np.uint64)
    if not len(h):
        return h
    size = min(n, len(h))
    out = h[:len(h) - size + 1].copy()
    for k in range(1, size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - size + 1 + k]
    out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(marks: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The low 16 bits of the MinHash values, one per seed pair (odd multiplier, summand)."""
    low = (marks ^ (marks >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(seeds), np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(low), 2048):
        part = low[at:at + 2048]
        mixed = part[None, :] * seeds[:, :1] + seeds[:, 1:]
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x85EBCA6B)
        np.minimum(out, (mixed ^ (mixed >> np.uint32(13))).min(axis=1), out=out)
    return out.astype(np.uint16)


def seed_pairs(k: int) -> np.ndarray:
    rng = np.random.default_rng(20260501)
    out = rng.integers(0, 1 << 32, (k, 2), dtype=np.uint32)
    out[:, 0] |= 1
    return out


def digest(marks: np.ndarray) -> bytes | None:
    """What documents with the same shingle set have in common; None without shingles."""
    import xxhash
    return xxhash.xxh3_128_digest(marks.tobytes()) if len(marks) else None


def _signed(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = seed_pairs(TREES * DEPTH)
        for rows in batches:
            sets = [shingles(text, n) for text in rows["text"]]
            ids = pd.array([None if x is None else int(x) for x in rows["doc_id"]], "Int64")
            yield pd.DataFrame({"doc_id": ids, "mark": rows["mark"],
                                "class": [digest(s) for s in sets],
                                "signature": [signature(s, seeds).tobytes() if len(s) else None for s in sets]})
    return run


def signatures(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, mark (hash of the text), class (digest of the shingle set; NULL without shingles) and signature."""
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.xxhash64(text_of()).alias("mark"),
                       text_of().alias("text"))
    return rows.mapInPandas(_signed(n), "doc_id long, mark long, class binary, signature binary")


def _keys(least: int):
    """Tree keys of each class: a hash of (tree, first ``least`` label values)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            labels = np.frombuffer(b"".join(rows["signature"]), dtype=np.uint16).reshape(len(rows), TREES, DEPTH)
            key = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), (len(rows), TREES)).copy()
            for k in range(least):
                key = (key ^ (key >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + labels[:, :, k]
            key ^= key >> np.uint64(32)
            yield pd.DataFrame({"node": np.repeat(rows["node"].to_numpy(), TREES), "key": key.reshape(-1).view(np.int64),
                                "tree": np.tile(np.arange(TREES, dtype=np.int32), len(rows))})
    return run


def tiled(rows: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with a column ``tile``: members of a large ``key`` go to each pair of blocks they are part of."""
    blocks = F.ceil(F.col(count) / TILE).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(
        F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    dealt = rows.withColumn("pair", F.explode(F.when(blocks > 1, pairs).otherwise(
        F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))))
    return dealt.withColumns({"tile": F.xxhash64(key, "pair.i", "pair.j"), "within": F.expr("pair.i = pair.j")}).drop("pair")


def _groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Whole groups out of batches sorted by ``key``; the last group waits for the next batch."""
    held: list[pd.DataFrame] = []
    for rows in batches:
        if not len(rows):
            continue
        at = rows[key].to_numpy()
        if held and held[0][key].iloc[0] == at[0] and at[0] == at[-1]:
            held.append(rows)
            continue
        if held:
            cut = int(np.searchsorted(at, held[0][key].iloc[0], "right")) if held[0][key].iloc[0] == at[0] else 0
            yield pd.concat([*held, rows.iloc[:cut]], ignore_index=True)
            rows, at = rows.iloc[cut:], at[cut:]
        start = int(np.searchsorted(at, at[-1], "left"))
        if start:
            yield rows.iloc[:start]
        held = [rows.iloc[start:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _joined(least: int):
    """Spanning links between members of a bucket whose signatures agree, longest prefixes first."""
    need = math.ceil(SCREEN * TREES * DEPTH)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _groups(batches, "tile"):
            tile = rows["tile"].to_numpy()
            sigs = np.frombuffer(b"".join(rows["signature"]), dtype=np.uint16).reshape(len(rows), TREES * DEPTH)
            nodes, tree = rows["node"].to_numpy(), rows["tree"].to_numpy()
            edges = [np.flatnonzero(np.diff(tile)) + 1]
            bounds = np.concatenate([[0], edges[0], [len(tile)]])
            size = np.diff(bounds)
            a, b = [], []
            first = bounds[:-1][size == 2]                                # pairs, all at once
            if len(first):
                same = (sigs[first] == sigs[first + 1]).sum(axis=1) >= need
                a.append(nodes[first[same]])
                b.append(nodes[first[same] + 1])
            for k in np.flatnonzero(size > 2):
                part = slice(bounds[k], bounds[k + 1])
                x, y = _descend(nodes[part], sigs[part], int(tree[bounds[k]]), least, need)
                a.append(x)
                b.append(y)
            if a:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})
    return run


def _descend(nodes: np.ndarray, sigs: np.ndarray, tree: int, least: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within one bucket: the label trie from its longest prefixes up to ``least`` values."""
    labels = sigs[:, tree * DEPTH:(tree + 1) * DEPTH]
    order = np.lexsort(labels.T[::-1])
    nodes, sigs, labels = nodes[order], sigs[order], labels[order]
    group = np.arange(len(nodes))                                          # who is joined with whom so far
    common = np.cumprod(labels[1:] == labels[:-1], axis=1).sum(axis=1)     # common prefix with the one before
    a, b = [], []
    for depth in range(DEPTH, least - 1, -1):
        cuts = np.concatenate([[0], np.flatnonzero(common < depth) + 1, [len(nodes)]])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - lo < 2 or (group[lo:hi] == group[lo]).all():
                continue
            waiting = list(range(lo, hi))
            while waiting:                                                 # grow a joined group member by member
                front, waiting = [waiting[0]], np.array(waiting[1:])
                while front and len(waiting):
                    x = front.pop()
                    near = (sigs[waiting] == sigs[x]).sum(axis=1) >= need
                    for y in waiting[near]:
                        if group[y] != group[x]:
                            a.append(nodes[x])
                            b.append(nodes[y])
                            group[group == group[y]] = group[x]
                        front.append(int(y))
                    waiting = waiting[~near]
                waiting = waiting.tolist()
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def _verified(threshold: float):
    """Exact links within one tile of a group: per member the number of linked documents, and spanning links."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _groups(batches, "tile"):
            tile = rows["tile"].to_numpy()
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(tile)) + 1, [len(tile)]])
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo > 1:
                    yield _links(rows.iloc[lo:hi], threshold)
    return run


def _links(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    rows = rows.drop_duplicates("node")
    sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["marks"]]
    nodes, weight = rows["node"].to_numpy(), rows["n_docs"].to_numpy()
    block, within = rows["block"].to_numpy(), bool(rows["within"].iloc[0])
    size = np.array([len(s) for s in sets], dtype=np.float64)
    inverse = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    shared = np.zeros((len(sets), len(sets)), dtype=np.float32)
    column, order = inverse, np.argsort(inverse, kind="stable")
    column, owner = column[order], owner[order]
    often = np.bincount(column)[column] > 1                                # shingles of one member share nothing
    column, owner = column[often], owner[often]
    if len(column):
        column = np.concatenate([[0], np.cumsum(np.diff(column) > 0)])
        for at in range(0, int(column[-1]) + 1, 4096):
            lo, hi = np.searchsorted(column, [at, at + 4096])
            part = np.zeros((len(sets), 4096), dtype=np.float32)
            part[owner[lo:hi], column[lo:hi] - at] = 1
            shared += part @ part.T
    linked = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-6
    np.fill_diagonal(linked, False)
    # a pair within one block meets in every tile of the block: it counts in one
    once = linked if within else linked & (block[:, None] != block[None, :])
    reached, a, b = np.zeros(len(sets), dtype=bool), [], []
    for root in range(len(sets)):
        if reached[root]:
            continue
        reached[root], front = True, [root]
        while front:
            x = front.pop()
            for y in np.flatnonzero(linked[x] & ~reached):
                reached[y] = True
                a.append(nodes[x])
                b.append(nodes[y])
                front.append(int(y))
    counts = once @ weight
    return pd.DataFrame({
        "a": np.concatenate([nodes, np.array(a, dtype=np.int64)]),
        "b": pd.array([None] * len(nodes) + [int(x) for x in b], "Int64"),
        "links": np.concatenate([counts, np.zeros(len(a))]).astype(np.int64)})


def _marked(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sets = [shingles(t, n) for t in rows["text"]]
            right = [digest(s) == bytes(c) for s, c in zip(sets, rows["class"], strict=True)]    # ids may repeat
            out = pd.DataFrame({"node": rows["node"], "part": rows["part"], "marks": [s.tobytes() for s in sets]})
            yield out[right]
    return run


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``grouped`` without its group."""
    return grouped(docs, n, threshold).drop("group")


def grouped(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, mark (hash of its text), class_id, n_links and component_id.

    ``class_id`` is the smallest doc_id with the same shingle set, ``n_links`` the number of other documents of
    similarity ``threshold`` or more, ``component_id`` the smallest doc_id reachable over such links.
    ``group`` numbers linked documents whatever their ids; it is NULL for texts without shingles.
    """
    signed = stage(signatures(docs, n), "signatures")
    classes = stage(signed.filter("class is not null").groupBy("class").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("n_docs")), "classes")
    # a class is a node; its number is the hash of its digest, so NULL ids don't matter
    number = F.xxhash64("class")
    first = signed.filter("class is not null").select("class", "signature", number.alias("node")) \
        .dropDuplicates(["class"])
    nodes = stage(first.select("node", "signature"), "nodes")
    least = least_depth(threshold=threshold)
    keys = stage(nodes.mapInPandas(_keys(least), "node long, key long, tree int"), "keys")
    full = keys.groupBy("key").agg(F.count("*").alias("n_key")).filter("n_key > 1")
    crowded = stage(keys.join(full, "key"), "crowded")
    buckets = tiled(crowded.join(nodes, "node"), "key", "n_key").select("tile", "node", "tree", "signature")
    met = stage(_by(buckets, "tile").mapInPandas(_joined(least), "a long, b long"), "met")
    groups = stage(components(met).withColumnRenamed("component", "part"), "parts")
    exact = stage(_verify(docs, classes, groups, n, threshold), "verified")
    counts = exact.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    linked = stage(components(exact.filter("b is not null").select("a", "b")), "linked")
    return _report(signed, classes.withColumn("node", number), counts, linked)


def _by(rows: DataFrame, key: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key).sortWithinPartitions(key)


def _verify(docs: DataFrame, classes: DataFrame, groups: DataFrame, n: int, threshold: float) -> DataFrame:
    sizes = groups.groupBy("part").agg(F.count("*").alias("n_part"))
    wanted = groups.join(sizes, "part").join(
        classes.select(F.xxhash64("class").alias("node"), "class", "class_id", "n_docs"), "node")
    wanted = stage(wanted, "wanted")
    # one document per class gives the class's shingles
    text = docs.select(F.col("doc_id").cast("long").alias("class_id"), text_of().alias("text"))
    # what is wanted grows with the documents, so it is never broadcast
    some = wanted.select("class_id", "class", "node", "part").hint("merge")
    read = text.join(some, text["class_id"].eqNullSafe(some["class_id"])) \
        .select("node", "part", "class", "text")
    marks = read.mapInPandas(_marked(n), "node long, part long, marks binary")
    blocks = F.ceil(F.col("n_part") / TILE).cast("int")
    rows = marks.join(wanted.select("node", "n_part", "n_docs"), "node").withColumns(
        {"block": F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int")})
    tiles = tiled(rows, "part", "n_part").select("tile", "node", "marks", "n_docs", "block", "within")
    return _by(tiles, "tile").mapInPandas(_verified(threshold), "a long, b long, links long")


def _report(signed: DataFrame, classes: DataFrame, counts: DataFrame, linked: DataFrame) -> DataFrame:
    known = classes.join(counts, "node", "left").join(linked, "node", "left")
    roots = known.filter("component is not null").groupBy("component").agg(F.min("class_id").alias("component_id"))
    known = known.join(roots, "component", "left").select(
        F.col("class").alias("its_class"), "class_id", "n_docs", F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("component_id", "class_id").alias("component_id"),
        F.coalesce("component", "node").alias("group"))
    rows = signed.join(known, F.col("class") == F.col("its_class"), "left")
    lone = F.col("its_class").isNull()
    return rows.select("doc_id", "mark", F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                       F.when(lone, 0).otherwise(F.col("n_docs") - 1 + F.col("links")).cast("long").alias("n_links"),
                       F.when(lone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "group")


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each group of linked documents, with all its columns: the first by id (NULL last), then hash of the text.

    Of rows that repeat that id and text one stays. Texts without shingles have no group and stay.
    """
    rows = stage(grouped(docs, n, threshold).filter("group is not null").select("doc_id", "mark", "group"), "groups")
    head = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("head")
    rows = rows.join(rows.groupBy("group").agg(head), "group")
    first = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("mark") == F.col("head.mark"))
    told = rows.groupBy("doc_id", "mark").agg(F.max(first).alias("__tw_first"), F.count("*").alias("__tw_n")) \
        .filter("not __tw_first or __tw_n > 1").withColumnsRenamed({"doc_id": "__tw_id", "mark": "__tw_mark"})
    told = stage(told, "near")
    own = docs.join(told, F.col("doc_id").cast("long").eqNullSafe(F.col("__tw_id"))
                    & (F.xxhash64(text_of()) == F.col("__tw_mark")), "left")
    once = own.filter("__tw_first is null")
    again = own.filter("__tw_first").dropDuplicates(["__tw_id", "__tw_mark"])
    return once.unionByName(again).select(*docs.columns)
