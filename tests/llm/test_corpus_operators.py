"""Corpus operators against brute force on sf0.001 and on a table of odd rows."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwright.llm import (common, exact_dedup, line_dedup, mixing, ngram_join, packing, pii, quality_rules, queries,
                           simple8b, token_output, tokens, toxicity, warc)
from tabwright.session import new_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "word " * 30_000 + "\n" + "1.2.3.4 +1 (555) 010-2030 a@b.c " * 50


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def pdf(docs):
    return docs.toPandas().sort_values("doc_id", ignore_index=True)


ODD = [(1, "one two three four five six", "en", "b", 5, "x"), (1, "one two three four five six", "en", "b", 5, "x"),
       (2, None, None, None, None, None), (3, "", "en", "a", 0, "y"), (None, "one two three four five six", "en", "b", 1, "z"),
       (4, "one  two three\tfour five six", "en", None, 1, "z"), (5, LONG, "en", "a", 9, "q"), (6, "hi", "en", "a", 2, None),
       (None, None, None, None, None, None)]
COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, mark string")


@pytest.fixture(scope="module", params=["odd", "empty"])
def odd(request, spark):
    return spark.createDataFrame(ODD if request.param == "odd" else [], COLUMNS)


def words(t):
    return WORDS.findall(t or "")


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_odd_rows_pass_every_operator(spark, odd):
    n = odd.count()
    assert exact_dedup.assign(odd).count() == n
    assert exact_dedup.keep_first(odd).columns == odd.columns
    assert ngram_join.join(odd).count() == n
    assert ngram_join.keep_one(odd).columns == odd.columns
    assert line_dedup.report(odd).count() == n
    assert line_dedup.dedup_lines(odd).columns == odd.columns
    assert mixing.taken_rows(odd).count() == n
    assert mixing.mixture(odd).columns == odd.columns
    assert quality_rules.verdicts(odd).count() == n
    assert quality_rules.keep(odd).columns == odd.columns
    assert pii.report(odd).count() == n
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(odd, labels).collect()} <= {0.0}
    packed = packing.pack_documents(odd, queries.tokenizer_path("word_bpe_49k.json"), 0, 64)
    assert packed.select("doc_id", "piece").distinct().count() <= packed.count()


def test_odd_rows_have_defined_results(spark):
    odd = spark.createDataFrame(ODD, COLUMNS)
    rows = exact_dedup.assign(odd).toPandas()
    same = rows[rows["group_size"] == 4]
    assert len(same) == 4 and set(same["keep_id"]) == {1} and same["kept"].sum() == 1
    assert rows[rows["group_size"] == 3]["keep_id"].tolist() == [2, 2, 2]
    kept = exact_dedup.keep_first(odd).toPandas()
    assert len(kept) == 4
    mixed = mixing.taken_rows(odd).toPandas()
    assert (mixed["taken"] <= 2 * mixed["size"]).all()
    assert quality_rules.verdicts(odd).filter("n_words < 10").filter("kept").count() == 0


def test_exact_dedup(docs, pdf):
    rows = exact_dedup.assign(docs).toPandas().set_index("doc_id")
    text = pdf["text"].map(normal)
    least, size = pdf.groupby(text)["doc_id"].transform("min"), pdf.groupby(text)["doc_id"].transform("size")
    for i, t, keep, n in zip(pdf["doc_id"], text, least, size, strict=True):
        r = rows.loc[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, n, keep == i)
        assert bytes(r["digest"]) == hashlib.sha256(t.encode()).digest()


def test_cuckoo_index_inserts_deletes_resizes(spark):
    index, keys = exact_dedup.CuckooIndex(2), [hashlib.sha256(str(i).encode()).digest() for i in range(500)]
    for i, k in enumerate(keys):
        index.insert(k, i, 1, 1)
    assert index.resizes > 0 and all(index.get(k) == (i, 1, 1) for i, k in enumerate(keys))
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert [index.get(k) is None for k in keys] == [i % 2 == 0 for i in range(500)]
    found = spark.createDataFrame([(i, bytearray(k)) for i, k in enumerate(keys)], "doc_id long, digest binary")
    built = exact_dedup.build_index(found, 500, 100)
    less = exact_dedup.delete(built, found.filter("doc_id < 100"), exact_dedup.shard_count(500, 100))
    again = exact_dedup.insert(less, found.filter("doc_id between 50 and 120"), exact_dedup.shard_count(500, 100))
    live = {r.keep_id: r.group_size for r in exact_dedup.live(again).collect()}
    assert live == {i: 2 if 100 <= i <= 120 else 1 for i in range(50, 500)}


def test_quality_measures(docs, pdf):
    rows = quality_rules.verdicts(docs).toPandas().set_index("doc_id")
    for i, t in zip(pdf["doc_id"], pdf["text"], strict=True):
        w = words(t)
        windows = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        count, covered = Counter(windows), set()
        for k, x in enumerate(windows):
            covered.update(range(k, k + 5)) if count[x] > 1 else None
        lines = [x for x in t.split("\n") if words(x)]
        r = rows.loc[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])


def linked(pdf):
    sets = {}
    for i, t in zip(pdf["doc_id"], pdf["text"], strict=True):
        w = words(t)
        n = min(5, len(w))
        sets[i] = frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if w else frozenset()
    owners, links, parent = defaultdict(list), Counter(), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            owners[x].append(i)

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in owners[x] if j > i).items():
            if k >= 0.8 * (len(s) + len(sets[j]) - k) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return links, {i: root(i) for i in sets}


@pytest.mark.parametrize("tile", [1024, 2])
def test_ngram_join(docs, pdf, tile, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", tile)               # blocks of two: every group is tiled
    rows = ngram_join.join(docs).toPandas().set_index("doc_id")
    links, root = linked(pdf)
    assert {i: r["n_links"] for i, r in rows.iterrows()} == {i: links[i] for i in root}
    assert rows["component_id"].to_dict() == root


def test_one_of_a_group_stays_whatever_its_ids(spark):
    base = [f"w{k}" for k in range(60)]
    near = [" ".join([*base, f"end{i}"]) for i in range(3)]
    other = " ".join(f"v{k}" for k in range(30))
    rows = [(None, t) for t in near]
    table = lambda x: spark.createDataFrame(x, "doc_id long, text string")          # noqa: E731
    assert len(ngram_join.keep_one(table([*rows, (None, other), (None, None), (None, "")])).collect()) == 4
    assert len(ngram_join.keep_one(table([(7, t) for t in near] + [(7, other)])).collect()) == 2
    mixed = ngram_join.keep_one(table([*rows, (9, near[0]), (9, near[0]), (8, other)])).collect()
    assert sorted(r.doc_id for r in mixed) == [8, 9]
    big = 2 ** 60 + 1
    some = table([(None, other), (big, near[0]), (big + 2, near[1])]).coalesce(1)
    assert {r.doc_id for r in ngram_join.keep_one(some).collect()} == {None, big}


def test_prefix_length_meets_recall():
    d = ngram_join.least_depth()
    assert 1 - (1 - 0.8 ** d) ** ngram_join.TREES >= ngram_join.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** ngram_join.TREES


def near_pairs(lines):
    """All pairs of different lines with edit similarity 0.9, by brute force: letters that differ bound the edits from below."""
    import duckdb
    letters = sorted({c for x in lines for c in x})
    bags = np.array([[x.count(c) for c in letters] for x in lines], dtype=np.int32)
    size = bags.sum(axis=1)
    found = []
    for i in range(len(lines)):
        most = np.maximum(size[i], size[i + 1:]) // 10
        off = bags[i + 1:] - bags[i]
        least = np.maximum(np.maximum(off, 0).sum(axis=1), np.maximum(-off, 0).sum(axis=1))
        found += [(lines[i], lines[i + 1 + j]) for j in np.flatnonzero(least <= most)]
    pairs = pd.DataFrame(found, columns=["a", "b"])
    return duckdb.sql("SELECT a, b FROM pairs WHERE levenshtein(a, b) <= greatest(length(a), length(b)) // 10").fetchall()


def test_line_dedup(docs, pdf):
    where = defaultdict(list)
    for i, t in zip(pdf["doc_id"], pdf["text"], strict=True):
        for n, x in enumerate(t.split("\n")):
            if line := re.sub(r"[\W_]+", " ", re.sub("[1-9]", "0", x.lower())).strip():
                where[line].append((i, n))
    parent = {n: n for n in where}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    pairs = near_pairs(list(where))
    for a, b in pairs:
        parent[root(b)] = root(a)
    groups, size_of = defaultdict(list), {}
    for n, places in where.items():
        groups[root(n)] += places
        size_of |= dict.fromkeys(places, len(n))
    want = {p for places in groups.values() for p in sorted(places)[1:]}
    got = {(r.doc_id, int(n)) for r in line_dedup.report(docs).collect() for n in r.dropped.split(",") if n}
    equal = {p for places in where.values() for p in sorted(places)[1:]}
    near = want - equal
    print(len(where), "lines,", len(pairs), "near pairs; found", {
        f"{lo} to {hi}": f"{len([p for p in near & got if lo <= size_of[p] < hi])} of {len([p for p in near if lo <= size_of[p] < hi])}"
        for lo, hi in ((10, 30), (30, 60), (60, 120), (120, 10 ** 9))})
    assert got <= want and equal <= got
    assert len(near & got) >= 0.95 * len(near) and near


def test_line_dedup_reaches_its_recall_by_edit_similarity_alone(spark):
    rng = np.random.default_rng(5)
    rows, pairs = [], defaultdict(list)
    for size in (10, 19, 20, 29, 30, 45, 59, 60, 70, 120, 300, 900):
        for _ in range(60):
            a = rng.choice(list("etaoinshrdlucfgmwy"), size)
            a[5::7] = " "
            a[[0, -1]] = "x"
            b = a.copy()
            at = rng.choice(np.arange(1, size - 1), size // 10, replace=False)
            b[at] = rng.choice(list("zvkjpb"), len(at))
            one, two = "".join(a), re.sub(" +", " ", "".join(b))
            most = int(0.1 * max(len(one), len(two)) + 1e-9)
            assert distance(one, two) <= most
            rows += [(len(rows), one), (len(rows) + 1, two)]
            pairs[size].append(len(rows) - 1)
    got = {r.doc_id: r.n_dropped for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = {size: np.mean([got[i] for i in ids]) for size, ids in pairs.items()}
    assert all(r == 1 for size, r in recall.items() if size < line_dedup.SHORT), recall
    assert np.mean([r for size, r in recall.items() if size >= line_dedup.SHORT]) >= 0.95, recall
    assert not any(got[i - 1] for size, ids in pairs.items() for i in ids if size > 10)


def test_line_dedup_of_short_and_unspaced_lines(spark):
    rows = [(1, "Yes\n- -\n\n同じ文がここにもう一度書かれている"), (2, "yes!\n- -\n\n同じ文がここにもう一度書かれている。"),
            (3, "no\n同じ文がここにもう一度書かれてゐる")]
    got = {r.doc_id: r.dropped for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "0,3", 3: "1"}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def test_mixture_meets_targets(docs, pdf):
    rows = mixing.taken_rows(docs).toPandas()
    again = mixing.taken_rows(docs).toPandas()
    key = ["doc_id"]
    pd.testing.assert_frame_equal(rows.sort_values(key, ignore_index=True), again.sort_values(key, ignore_index=True))
    assert rows["size"].sum() == sum(len(words(t)) for t in pdf["text"])
    by = rows.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert by["target"].sum() == pytest.approx(1.5 * by["size"].sum())
    assert (by["target"] <= 2 * by["size"] + 1e-9).all()
    assert ((by["taken"] - by["target"]).abs() <= by["most"]).all()
    free = by[by["target"] < 2 * by["size"] - 1e-6]
    rank = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(by.index))}
    unit = {round(t / rank[s], 6) for s, t in free["target"].items()}
    assert len(unit) <= 1


@pytest.mark.parametrize("high", [2, 300, 60_000, 1 << 40, 1 << 63])
def test_simple8b_round_trip(high):
    rng = np.random.default_rng(high % 97)
    for n in (0, 1, 511, 512, 513, 5000):
        v = rng.integers(0, high, n, dtype=np.uint64) >> rng.integers(0, 20, n).astype(np.uint64)
        data = simple8b.encode(v)
        assert (simple8b.decode(data) == v).all()
        assert (simple8b.decode(data, n // 3, n // 2) == v[n // 3:n // 2]).all()


def test_token_files(spark, docs, pdf):
    from tokenizers import Tokenizer
    odd = docs.select("doc_id", "text").unionByName(spark.createDataFrame(
        [(-3, None), (-2, " a  b \n\n c d "), (-1, "it's\t(x) ... <|endoftext|> end ")], "doc_id long, text string"))
    path, tk = new_path(spark, "t"), queries.tokenizer_path("byte_bpe_50k.json")
    token_output.write_tokens(odd, path, tk, 2, 3)
    plain, start = Tokenizer.from_file(tk), 0
    texts = {r.doc_id: r.text for r in odd.collect()}
    ids = {r.doc_id: r.ids for r in token_output.read_ids(spark, path).collect()}
    for r in token_output.read_tokens(spark, path).orderBy("doc_id").collect():
        text = texts[r.doc_id]
        want = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        assert ids[r.doc_id] == want.tolist()
        start += len(want)


def test_packing(docs, pdf):
    from tokenizers import Tokenizer
    tk = queries.tokenizer_path("word_bpe_49k.json")
    plain = Tokenizer.from_file(tk)
    want = {i: np.array([*plain.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
            for i, t in zip(pdf["doc_id"], pdf["text"], strict=True)}
    rows = packing.pack_documents(docs, tk, 0, 2048).toPandas().sort_values(["sequence_id", "offset"])
    for r in rows.itertuples():
        assert r.start == 2048 * r.piece and zlib.crc32(want[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32
    assert rows["length"].sum() == sum(map(len, want.values()))
    groups = rows.groupby("sequence_id")["length"]
    assert groups.sum().max() <= 2048 and (groups.cumsum() - rows["length"] == rows["offset"]).all()
    assert groups.ngroups <= 1.02 * rows["length"].sum() / 2048 + 2


def test_large_ids_beside_a_missing_one(spark):
    big = 2 ** 60
    rows = [(None, "one two three", "a"), (None, "alone", "a")] + [(big + 2 * i + 1, f"text {i // 2} of the row", "a") for i in range(40)]
    some = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    ids = Counter(r[0] for r in rows)
    got = exact_dedup.assign(some).collect()
    assert Counter(r.doc_id for r in got if r.kept) == Counter({None: 2} | {big + 4 * i + 1: 1 for i in range(20)})
    assert exact_dedup.keep_first(some).count() == 22
    found = exact_dedup.digests(some)
    index = exact_dedup.build_index(found, 42)
    index = exact_dedup.delete(exact_dedup.insert(index, found, 1), found.limit(0), 1)
    assert {r.keep_id for r in exact_dedup.live(index).collect()} == {r.keep_id for r in got}
    assert Counter(r.doc_id for r in mixing.taken_rows(some).collect()) == ids
    path = new_path(spark, "t")
    token_output.write_tokens(some, path, queries.tokenizer_path("byte_bpe_50k.json"), 2, 1)
    assert Counter(r.doc_id for r in token_output.read_tokens(spark, path).collect()) == ids
    assert Counter(r.doc_id for r in token_output.read_ids(spark, path).collect()) == ids
    packed = packing.pack_documents(some, queries.tokenizer_path("word_bpe_49k.json"), 0, 64)
    assert Counter(r.doc_id for r in packed.collect()) == ids


@pytest.mark.parametrize("name, keeps_space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@pytest.mark.parametrize("room", [0, 3, 500_000])
def test_encoder_with_a_full_memo(name, keeps_space, room):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(queries.tokenizer_path(name))
    encode = tokens.Encoder(plain, tokens.Recent(room), keeps_space).encode
    texts = ["a \t b", "a \r b", "a \u00a0 b", "a \u3000 b", "a \t\t\r b", "end. of, it. \t of,", "\t", "", " ", "a b a b."]
    for _ in range(2):
        for text, data in zip(texts, encode(texts), strict=True):
            assert np.frombuffer(data, dtype="<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name, keeps_space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_forgets_by_use(name, keeps_space, pdf):
    """More distinct chunks than the memo holds: the ids stay the library's, the memo stays bounded."""
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(queries.tokenizer_path(name))
    memo = tokens.Recent(500)
    encode = tokens.Encoder(plain, memo, keeps_space).encode
    texts = pdf["text"].tolist()
    want = [e.ids for e in plain.encode_batch_fast(texts, add_special_tokens=False)]
    for _ in range(2):
        got = [x for a in range(0, len(texts), 3) for x in encode(texts[a:a + 3])]
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == want
    assert memo.old and "the" in {**memo, **memo.old}


@pytest.mark.parametrize("name, keeps_space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_keeps_nul_characters(name, keeps_space):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(queries.tokenizer_path(name))
    encode = tokens.Encoder(plain, tokens.Recent(tokens.MEMO), keeps_space).encode
    texts = ["a \0b c", "\0a b", "a \0. b. c", "a b. \0", "a\0 b", "\0", "a \0\0 b", "x \0b, y, \0, z"]
    for _ in range(2):
        for text, data in zip(texts, encode(texts), strict=True):
            assert np.frombuffer(data, dtype="<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name, keeps_space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_at_cuts(name, keeps_space):
    """Newlines, punctuation, letters beyond ASCII and special tokens side by side: the library's ids."""
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(queries.tokenizer_path(name))
    encode = tokens.Encoder(plain, tokens.Recent(50), keeps_space).encode
    texts = ["ab.\nCd, ef!!\n\nGh", "a\n\n\nb c", "a b\n\n", "\na b\n", "\n\na b", "a\n\n<|endoftext|> b", "\u0130. \u0130!? b", "\u00e9t\u00e9, \u00e0.\n\u00e9.",
             "a\x1fb c", "a\x1e, b", "d'\u00e9t\u00e9's, 's. 't,\n's", "\u0441\u043b\u043e\u0432\u043e, \u4e2d\u6587. 1,2, 3.", "a.\t\nb, c"]
    for _ in range(2):
        for text, data in zip(texts, encode(texts), strict=True):
            assert np.frombuffer(data, dtype="<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name, keeps_space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_puts_new_words_together(name, keeps_space):
    """Words with punctuation, behind a newline or with letters beyond ASCII are known by their letters and encoded many at a time."""
    from tokenizers import Tokenizer
    plain, asked = Tokenizer.from_file(queries.tokenizer_path(name)), []
    encoder = tokens.Encoder(plain, tokens.Recent(tokens.MEMO), keeps_space)
    direct = encoder._direct
    encoder._direct = lambda texts: asked.extend(texts) or direct(texts)
    words = [f"{a}{b}\u00e9{c}" for a in "bcdfghjk" for b in "aeiou" for c in "lmnpqrst"]
    texts = ["Go " + " ".join(words), "Go " + ", ".join(words), "Go\n" + ".\n".join(words)]
    got = encoder.encode(texts)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert len(asked) < len(words) / 10


def test_best_two_fit_replaces_the_smallest():
    assert sorted(map(sorted, packing.pack(np.array([60, 30, 20, 17]), 100))) == [[17, 20, 60], [30]]


def test_archives(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    more = [(10 ** 6 + i, None, h) for i, h in enumerate([None, "", "same", "same", "é" * 2000])] + [(None, "u", "same")]
    pages = pages.unionByName(spark.createDataFrame(more, pages.schema))
    got = {r.page_id: r for r in warc.archive_pages(pages).collect()}
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    best = {}
    for i, p in rows:
        best[p] = max(best.get(p, -1), -1 if i is None else i)
    assert len(got) == len(rows)
    for i, p in rows:
        r, revisit = got[i], best[p] != i
        assert (r.payload_bytes, r.payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (r.record_type, r.refers_to) == (("revisit", best[p]) if revisit else ("response", None))


def test_zip_directory_with_zip64(tmp_path):
    import zipfile
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"stored bytes")
        z.writestr("packed", b"x" * 100, zipfile.ZIP_DEFLATED)
    with open(path, "rb") as f:
        found = warc.members(f, path.stat().st_size)
        at, n = found["big"]
        f.seek(at)
        assert f.read(n) == b"stored bytes" and "packed" not in found
    extra = b"\x01\x00\x10\x00" + (5 << 33).to_bytes(8, "little") + (7 << 33).to_bytes(8, "little")
    assert warc._wide(extra, 1, 0xFFFFFFFF, 0xFFFFFFFF) == (5 << 33, 7 << 33)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TRAPS = ["a@b.c..d@e.f a@b.c_x@y.z @x.y a@b a@b. x%@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0255.0.0.00 1..2.3.4.5",
         "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1", "+1 (555) 010-2030) +1-2 ++49 30 1234567 +1.",
         "é 😀 4111111111111111 a@b.co\n+4930123456789\r", "9" * 5000, "a@" + "b." * 5000 + "c", "1." * 5000, None, ""]


def test_personal_data_base_spans(spark, docs, pdf):
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(
        [(-1 - i, t) for i, t in enumerate(TRAPS)], "doc_id long, text string"))
    texts = dict(zip(pdf["doc_id"], pdf["text"], strict=True)) | {-1 - i: t for i, t in enumerate(TRAPS)}
    for r in pii.report(rows).collect():
        spans, t = [], texts[r.doc_id] or ""
        for k, (kind, pattern) in enumerate(BASE.items()):
            own = [(m.start(), k, m.end()) for m in re.finditer(pattern, t) if fits(kind, m.group())]
            assert r[f"n_{kind}"] == len(own), (r.doc_id, kind)
            spans += own
        told = ",".join(f"{list(BASE)[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(r.spans.split(","))


def fits(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        total = sum((x := int(c) * (1 + i % 2)) - 9 * (x > 9) for i, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return True


def test_personal_data_added_spans(spark):
    rows = spark.createDataFrame([(i, f"Please call ({200 + i}) 555-01{i:02d} or mail jo{i} (at) site (dot) org now. a{i}@b.com")
                                  for i in range(40)], "doc_id long, text string")
    for r in pii.report(rows).collect():
        assert r.n_email == 1 and r.n_phone == 0 and r.spans.startswith("phone:12:") and r.spans.count("email:") == 2


def test_capitals_mean_the_same_at_every_length():
    rate = lambda text: toxicity._measure(text, {}, frozenset())[toxicity.FEATURES.index("capitals")]     # noqa: E731
    assert rate("SHOUT now 123 !!! ") == pytest.approx(rate("SHOUT now 123 !!! " * 50)) == pytest.approx(5 / 8)
    assert rate("1 2 3 " * 50) == 0


def test_toxicity_held_out(spark, sf_dir):
    # sf0.01 holds 6 toxic rows out of reach of the training, too few to tell
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.1") + "/documents.parquet")
    labels = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.1") + "/labels.parquet")
    rows = toxicity.score(docs, labels).toPandas()
    assert rows["score"].between(0, 1).all() and ((rows["score"] >= 0.5) == rows["predicted"].astype(bool)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(rows["doc_id"], rows["held_out"], strict=True))
    both = rows[rows["held_out"]].merge(labels.toPandas(), on="doc_id")
    bad, good = (both[both["toxic"] == k]["score"].to_numpy() for k in (1, 0))
    wins = (bad[:, None] > good[None, :]).mean() + 0.5 * (bad[:, None] == good[None, :]).mean()
    assert len(bad) > 50 and wins > 0.95
    assert (bad >= 0.5).mean() > 0.85 and (good >= 0.5).mean() < 0.02


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline
    frame = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = frame
        frame = common.stage(stage(spark, frame, sf_dir), "piped")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert frame.columns == docs.columns
        if k < 3:
            assert frame.count() <= before.count() and frame.exceptAll(before).count() == 0
        if k == 2:
            texts = frame.toPandas()
            assert not linked(texts)[0]
    assert frame.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
