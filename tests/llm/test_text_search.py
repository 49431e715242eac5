"""Token counts of prefixes, phrases and lexical search against brute force, and on odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.llm import lexical_search, phrases, prefix_counts, queries

LONG = "word " * 20_000 + "\n\n" + "x" * 5000 + ". Yes, no; " * 3000
ODD = [(1, "one two three", "en", "b"), (1, "one two three", "en", "b"), (2, None, None, None), (3, "", "en", "y"),
       (None, "one two four", None, "z"), (4, LONG, "en", "q"), (5, "\t \n", "de", "q"), (None, None, "en", None),
       (6, "ÀB é　ab <|endoftext|> x", "fr", "w")]
COLUMNS = "doc_id long, text string, lang string, word string, score long, rank int, count long, n long"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def pdf(docs):
    return docs.toPandas().sort_values("doc_id", ignore_index=True)


@pytest.fixture(scope="module", params=["odd", "empty"])
def odd(request, spark):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in ODD] if request.param == "odd" else [], COLUMNS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def counter():
    return prefix_counts.PrefixCounter(queries.tokenizer_path("byte_bpe_50k.json"))


def brute_counts(library, text):
    return [len(e.ids) for e in library.encode_batch([text[:i] for i in range(len(text) + 1)], add_special_tokens=False)]


PIECES = ["a", "b", "the", "'s", "'", "'re", "'l", "l", " ", "  ", "\n", "\t", "1", "23", ".", "...", "é", "中文", "😀", "é",
          "<|endoftext|>", "<|endo", "xx", "aaaa", "\x1c", "　", "\x85", "ing", "Don't", "-", "_", "՘", "࢏", "\U00031350"]


def test_every_prefix_counts_as_the_library_counts_it(library, counter):
    draw = random.Random(3)
    for _ in range(700):
        text = "".join(draw.choice(PIECES) for _ in range(draw.randint(0, 14)))
        assert counter.counts(text).tolist() == brute_counts(library, text), repr(text)


def test_prefixes_of_documents(library, counter, pdf):
    for text in pdf["text"][:12]:
        assert counter.counts(text[:1500]).tolist() == brute_counts(library, text[:1500])
    whole = library.encode_batch(pdf["text"].tolist(), add_special_tokens=False)
    assert [int(counter.steps(t).sum()) for t in pdf["text"]] == [len(e.ids) for e in whole]


def test_a_full_memo_changes_nothing(library, pdf, monkeypatch):
    monkeypatch.setattr(prefix_counts, "UNITS", 5)
    monkeypatch.setattr(prefix_counts, "SEAMS", 5)
    small = prefix_counts.PrefixCounter(queries.tokenizer_path("byte_bpe_50k.json"))
    texts = pdf["text"].tolist()[:40]
    assert [int(small.steps(t).sum()) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(small.memo) <= 5 and len(small.memo.old) <= 5


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        prefix_counts.PrefixCounter(queries.tokenizer_path("word_bpe_49k.json"))


def test_limits_and_budgets_are_read_off_the_table(docs, library):
    rows = docs.filter("doc_id < 30")
    table = rows.join(prefix_counts.prefix_table(rows, queries.tokenizer_path("byte_bpe_50k.json")), "doc_id").select(
        "text", prefix_counts.tokens_at(F.col("counts"), 25).alias("at"), prefix_counts.longest_within(F.col("counts"), 40).alias("kept"),
        prefix_counts.truncated(F.col("text"), F.col("counts"), 40).alias("cut"), F.element_at("counts", -1).alias("n"))
    for r in table.collect():
        counts = brute_counts(library, r.text[:600])
        assert r.at == (counts[25] if len(r.text) >= 25 else None)
        assert r.kept == max(i for i, c in enumerate(counts) if c <= 40) and r.cut == r.text[:r.kept]
        assert r.n == len(library.encode(r.text, add_special_tokens=False).ids)


def test_token_counts_of_odd_rows(odd, library):
    got = prefix_counts.totals(odd, queries.tokenizer_path("byte_bpe_50k.json")).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids))
            for r in odd.collect()]
    key = lambda x: tuple(-1 if v is None else v for v in x)                                          # noqa: E731
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert prefix_counts.prefix_table(odd, queries.tokenizer_path("byte_bpe_50k.json")).count() == odd.count()


# --- phrases ---------------------------------------------------------------------------------------------


def brute_phrases(rows, minimum, best, longest):
    counts, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            counts.update((lang, tuple(w[i:i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {p: c for p, c in counts.items() if c >= minimum}
    out = []
    for (lang, w), a in often.items():
        inside = any(len(v) > len(w) and x == lang and often[x, v] >= a and any(v[i:i + len(w)] == w for i in range(len(v)))
                     for x, v in often)
        if len(w) > 1 and not inside:
            score, _, l, r = min((1000 * a * n[lang] // (often[lang, w[:i]] * often[lang, w[i:]]), i, often[lang, w[:i]],
                                  often[lang, w[i:]]) for i in range(1, len(w)))
            out.append((lang, " ".join(w), a, l, r, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:best]
        ranked += [(x[0], i + 1, *x[1:]) for i, x in enumerate(own)]
    return sorted(ranked)


@pytest.mark.parametrize("shards,block", [(1, 10 ** 9), (3, 2000), (4, 50)])
def test_phrases(docs, pdf, shards, block):
    rows = list(zip(pdf["text"], pdf["lang"], strict=True))
    got = phrases.collocations(docs, 12, 60, 5, shards, block)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 12, 60, 5)


def test_phrases_when_the_gate_is_too_small(docs, pdf, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_SLOTS", 1 << 16)
    monkeypatch.setattr(phrases, "_slot", lambda hashes, bits: (hashes >> np.uint64(58)).astype(np.int64))
    counted = phrases.count_phrases(docs, 25, 4, 3)
    want = brute_counts_of_phrases(pdf, 25, 4)
    assert {(r.lang, r.phrase): r.c for r in counted.filter("k > 0").collect()} == want


def brute_counts_of_phrases(pdf, minimum, longest):
    counts = Counter()
    for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            counts.update((lang, " ".join(w[i:i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    return {p: c for p, c in counts.items() if c >= minimum}


def test_phrases_of_odd_rows(odd):
    rows = [(r.text, r.lang) for r in odd.collect()]
    assert sorted(map(tuple, phrases.collocations(odd, 2, 10).collect())) == brute_phrases(rows, 2, 10, 5)


def test_scores_stay_exact_beyond_64_bits(spark):
    big = 3 * 10 ** 13 + 7
    counted = spark.createDataFrame([("en", "", 0, 10 ** 15 + 1), ("en", "a", 1, big), ("en", "b", 1, big + 2), ("en", "a b", 2, big - 1)],
                                    "lang string, phrase string, k int, c long")
    row = phrases.score_phrases(counted, 5).first()
    assert row.score == 1000 * (big - 1) * (10 ** 15 + 1) // (big * (big + 2)) and (row.l, row.r) == (big, big + 2)


# --- search ------------------------------------------------------------------------------------------------


def brute_search(rows, items, k):
    term = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    cut = lambda t: term.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))                # noqa: E731
    held = [(d, Counter(w), len(w)) for d, w in ((d, cut(t)) for d, t in rows) if w]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in held:
            m = 100 - 75 + (75 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in cut(text) if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if no else d, -s) for i, (s, no, d) in enumerate(sorted(found)[:k])]
    return out


ORDER = lambda x: tuple((v is None, v or 0) for v in x)                                              # noqa: E731


@pytest.mark.parametrize("chars,shard", [(100_000, 8192), (700, 16)])
def test_search(spark, docs, pdf, sf_dir, chars, shard, monkeypatch):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").toPandas()
    texts = list(zip(items["item_id"].tolist(), items["text"].tolist(), strict=True)) + [(500, pdf["text"][3]), (501, "the of"), (502, None),
                                                                                         (503, "zzzzqq"), (None, "the the of")]
    asked = spark.createDataFrame(texts, "item_id long, text string")
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical_search.query_blocks, "__defaults__", (chars,))
    got = lexical_search.search(spark, docs, asked, 10)
    rows = list(zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True))
    assert sorted(map(tuple, got.collect()), key=ORDER) == sorted(brute_search(rows, texts, 10), key=ORDER)


def test_search_skips_blocks(spark, docs, sf_dir):
    """The bounds spare most documents; what is skipped cannot matter (``test_search``)."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    block = next(lexical_search.query_blocks(items))
    index = lexical_search.build_index(lexical_search._counted(docs, block), block).toPandas()
    coordinates, scored, held = block.coordinates(), 0, 0
    for query in block.queries:
        terms = np.array(sorted(t for t in query if block.weights[t] > 0))
        weights = np.array([query[t] for t in terms.tolist()]) * block.weights[terms]
        best = lexical_search._Best(3)
        for row in index.to_dict("records"):
            shard = lexical_search._Reader(row, coordinates, len(block.vocabulary))
            places = {t: np.searchsorted(coordinates[t], terms) for t in terms.tolist()}
            scored += shard.search(terms, weights, places, best)
            held += int((shard.cells[:, terms].max(axis=1) > 0).sum())
    assert scored < 0.8 * held


def test_search_over_odd_rows(spark, odd):
    asked = spark.createDataFrame([(1, "ONE two"), (1, "one two"), (None, "word x Àb"), (2, None), (3, "")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted(map(tuple, lexical_search.search(spark, odd, asked, 4).collect()), key=ORDER)
    assert got == sorted(brute_search(rows, [tuple(r) for r in asked.collect()], 4), key=ORDER)
    assert lexical_search.search(spark, odd, asked.limit(0), 4).count() == 0
