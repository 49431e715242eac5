"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features are rates, so that they mean the same at every length: hits of a lexicon (whole words and stems), hits close to a
second-person word, capitals, marks, obfuscated words, and hits among words read without their obfuscation. The lexicon is
a short fixed list plus entries that the labelled rows mark as toxic. Labelled rows are a bounded, repeatable sample
(``MAX_ROWS`` rows in hash order); one fold of them calibrates. Every document's whole text is scored.

Defined cases: NULL and empty texts have all features 0 and are scored like any other; rows repeating an id are scored each;
without both classes among the labelled rows every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import text_of
from tabwright.session import stage

#: Labelled rows that lexicon, trees and calibration are fitted on; entries of the learned lexicon.
MAX_ROWS, MAX_ENTRIES = 20_000, 400
FOLDS = 5
STEMS = (4, 5)
#: Insults and second-person words (fixed values).
INSULTS = ("idiot idiots stupid moron morons scum trash loser losers pathetic worthless disgusting clown dumb imbecile "
           "jerk bastard dummkopf abschaum crétin débile imbécile estúpido basura").split()
SECOND = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted vosotros".split()
#: Signs written for letters (fixed values).
PLAIN = str.maketrans("01345789@$!|", "oieastbgasil")
REACH = 5
FEATURES = ["word_rate", "word_hits", "stem_rate", "stem_hits", "near_rate", "hidden_rate", "hidden_hits", "capitals",
            "shouted", "marks", "mixed_rate", "weight", "words"]
_WORD = re.compile(r"\w+")
_LETTERS = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\s]+")
_MIXED = re.compile(r"(?=\S*[^\W\d_])\S*[0-9@$!|*](?=\S*[^\W\d_])\S*")


def _measure(text: str, lexicon: dict[str, float], second: frozenset) -> tuple:
    words = _WORD.findall(text.lower())
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    hits = [i for i, w in enumerate(words) if w in lexicon]
    stems = [s for w in words for k in STEMS if len(w) > k and (s := w[:k] + "*") in lexicon]
    near = sum(not second.isdisjoint(words[max(0, i - REACH):i + REACH + 1]) for i in hits)
    mixed = _MIXED.findall(text)
    hidden = sum(w in lexicon for m in mixed for w in (m.lower().strip(".,;:!?").translate(PLAIN),
                                                       re.sub(r"[^\w]", "", m.lower())))
    letters = sum(map(len, _LETTERS.findall(text)))
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    shouted = len(re.findall(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b", text))
    weight = sum(lexicon[words[i]] for i in hits) + sum(lexicon[s] for s in stems)
    return (len(hits) / n, min(len(hits), 10.0), len(stems) / n, min(len(stems), 10.0), near / n, hidden / n,
            min(hidden, 10.0), upper / max(letters, 1), shouted / n, (text.count("!") + text.count("?")) / n,
            len(mixed) / n, min(weight, 50.0), math.log1p(n))


def features(docs: DataFrame, lexicon: dict[str, float], more: str = "") -> DataFrame:
    """doc_id, the columns in ``more`` ("name type, ...") and the features of each whole text."""
    names = ["doc_id", *[x.split()[0] for x in more.split(", ") if x]]
    second = frozenset(SECOND)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = rows[names].copy()
            out["doc_id"] = out["doc_id"].astype("Int64")
            made = np.array([_measure(t, lexicon, second) for t in rows["text"]], dtype=float).reshape(len(rows), len(FEATURES))
            for k, name in enumerate(FEATURES):
                out[name] = made[:, k]
            yield out

    schema = "doc_id long, " + (more + ", " if more else "") + ", ".join(f"{x} double" for x in FEATURES)
    return docs.mapInPandas(run, schema)


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For a batch of labelled texts: entry, toxic texts with it, texts with it."""
    for rows in batches:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(rows["text"], rows["toxic"], strict=True):
            words = set(_WORD.findall(text.lower()))
            for entry in words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}:
                held = counts.setdefault(entry, [0, 0])
                held[0] += int(toxic)
                held[1] += 1
        yield pd.DataFrame({"entry": list(counts), "bad": [c[0] for c in counts.values()],
                            "n": [c[1] for c in counts.values()]})


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Entries (words, and stems written with ``*``) that toxic texts hold far more often, with their log-odds."""
    bad, n = labelled.agg(F.sum("toxic"), F.count("*")).first()
    out = dict.fromkeys(INSULTS, 3.0)
    if not bad or bad == n:
        return out
    counts = labelled.select("text", "toxic").mapInPandas(_entries, "entry string, bad long, n long") \
        .groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    p = (F.col("n") + 1) / F.lit(n + 2)
    z = (F.col("bad") - bad * p) / F.sqrt(bad * p * (1 - p))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (n - bad + 1))
    found = counts.filter(F.col("bad") >= 3).withColumns({"z": z, "odds": odds}).filter("z > 4 and odds > 1.5") \
        .orderBy(F.desc("z"), "entry").limit(MAX_ENTRIES).collect()
    out.update({r.entry: r.odds for r in found})
    return out


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Labelled texts outside the held-out fold: at most ``max_rows``, the first in hash order."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__tw_id")) \
        .agg(F.max("toxic").cast("int").alias("toxic")).filter(fold("__tw_id") != 0)
    some = known.orderBy(F.xxhash64("__tw_id"), "__tw_id").limit(max_rows)      # bounded, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.join(F.broadcast(some), rows["doc_id"] == some["__tw_id"]) \
        .select("doc_id", "text", "toxic", (fold("doc_id") == 1).cast("int").alias("calibrates"))


def score(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, trees: int = 20, depth: int = 4) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted."""
    labelled = stage(training_rows(docs, labels, max_rows), "labelled")
    lexicon = learn_lexicon(labelled.filter("calibrates = 0"))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="x")
    known = stage(features(labelled, lexicon, "toxic int, calibrates int"), "known")
    known = vector.transform(known.withColumn("y", F.col("toxic").cast("double"))).coalesce(4)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    held = F.coalesce(fold("doc_id") == 0, F.lit(False))
    shape = {(r.calibrates, r.toxic): r["count"] for r in known.groupBy("calibrates", "toxic").count().collect()}
    if not all(shape.get((0, k)) for k in (0, 1)):
        return rows.select("doc_id", held.alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=11,
                          minInstancesPerNode=3).fit(known.filter("calibrates = 0"))
    raw = lambda df: df.withColumn("raw", vector_to_array("probability")[1])       # noqa: E731
    scored = raw(model.transform(vector.transform(features(rows, lexicon))))
    if all(shape.get((1, k)) for k in (0, 1)):
        fitted = IsotonicRegression(featuresCol="raw", labelCol="y").fit(
            raw(model.transform(known.filter("calibrates = 1"))).select("raw", "y"))
        scored = fitted.setPredictionCol("calibrated").transform(scored.drop("prediction"))
        # a hundredth of the uncalibrated score keeps the order within the steps of the calibration
        final = 0.99 * F.col("calibrated") + 0.01 * F.col("raw")
    else:
        final = F.col("raw")
    return scored.select("doc_id", held.alias("held_out"), final.alias("score"), (final >= 0.5).cast("int").alias("predicted"))
