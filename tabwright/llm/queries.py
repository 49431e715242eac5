"""Registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm import (
    exact_dedup,
    lexical_search,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    phrases,
    pii,
    prefix_counts,
    quality_rules,
    token_output,
    toxicity,
    warc,
)
from tabwright.llm.common import tables
from tabwright.session import new_path

#: Rows in an Arrow batch: whole texts travel in them.
ARROW_ROWS = "1000"
CAPACITY = 2048
TOKEN_LIMIT = 512


def _read(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(tables(sf_dir, name))


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_read(spark, sf_dir)).drop("mark")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_read(spark, sf_dir))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_rows(_read(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(_read(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = _read(spark, sf_dir), new_path(spark, "tokens")
    token_output.write_tokens(docs, path, tokenizer_path("byte_bpe_50k.json"), 2, docs.rdd.getNumPartitions())
    return token_output.read_tokens(spark, path)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir), _read(spark, sf_dir, "labels"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), 0, CAPACITY)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(_read(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op10_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_read(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.totals(_read(spark, sf_dir), tokenizer_path("byte_bpe_50k.json")).withColumn(
        "over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir), 100, 2000)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(spark, _read(spark, sf_dir), _read(spark, sf_dir, "benchmark"), 10)


REGISTRY = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_line_dedup, op3_mix_sources, op4_exact_dedup, op5_token_output, op6_toxicity, op7_personal_data,
    op8_best_fit_packing, op9_quality_rules,
    op10_warc_archives, op11_token_counts, op12_phrase_mining, op13_lexical_search)}

#: ASCII letters in lower case.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op12_phrase_mining": rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
spans AS (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
counted AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS c FROM spans GROUP BY ALL HAVING count(*) >= 100),
found AS (SELECT lang, phrase, k, c AS a, string_split(phrase, ' ') AS w FROM counted WHERE k >= 2),
inside AS (
  SELECT p.lang, p.phrase FROM found p JOIN found q ON p.lang = q.lang AND q.k > p.k AND q.a >= p.a
    AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' ')),
cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM found WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM inside))),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.c AS l, y.c AS r, s.n, c.cut,
    CAST((1000::HUGEINT * c.a * s.n) // (x.c::HUGEINT * y.c) AS BIGINT) AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.head JOIN counted y ON y.lang = c.lang AND y.phrase = c.tail
    JOIN sizes s ON s.lang = c.lang),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM least)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000""",
    "op13_lexical_search": rf"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
docs AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY ALL),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, total GROUP BY term),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
scored AS (
  SELECT a.item_id, t.doc_id, CAST(sum(a.times * w.w * ((1000000000 * t.tf) //
    (1000 * t.tf + 8 * (100 - 75 + ((75 * d.n * total.docs) // total.terms))))) AS BIGINT) AS score
  FROM asked a JOIN tfs t ON t.term = a.term JOIN weights w ON w.term = a.term JOIN docs d ON d.doc_id = t.doc_id, total
  GROUP BY a.item_id, t.doc_id),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
}
