"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Everything that touches rows is DataFrame expressions. The text is read once: its measures are staged as
numbers. Rules turn measures into votes (1 good, -1 bad, 0 abstain); votes are counted by pattern, so that
expectation-maximisation works on at most 3^rules counts whatever the corpus holds, and the fitted model
is again a column: the posterior probability of a good document.

Defined cases: a NULL or empty text has no words, all measures 0, and fails the base rule. Repeated rows
are judged alike. An empty table gives an empty result. ``keep`` carries extra columns untouched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import SPACE, bind, text_of, words_of
from tabwright.session import stage

WINDOW = 5
#: Characters counted as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_chars", "n_upper", "n_lower", "n_digits", "n_marks", "n_short", "n_long"]


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; ``hashes`` in text order."""
    def covered(s: Column) -> Column:
        mine = lambda k: F.get(s, k)["h"]                                          # noqa: E731
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                         lambda k: F.coalesce(mine(k) == mine(k - 1), F.lit(False))
                         | F.coalesce(mine(k) == mine(k + 1), F.lit(False)))
        return bind(F.sort_array(F.transform(twice, lambda k: F.get(s, k)["p"])), lambda at: F.aggregate(
            F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))),
            F.lit(0), lambda a, x: a + x))

    placed = F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p")))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0) \
        .otherwise(bind(F.sort_array(placed), covered)).cast("long")


def measures(docs: DataFrame, carry: bool = False) -> DataFrame:
    """One row per document: doc_id and the numbers in ``MEASURES``; with ``carry`` also the whole row, as ``row``."""
    t = F.col("t")
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    more = ["row"] if carry else []
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"), *own)
    split = base.select("doc_id", "t", words_of(t).alias("w"), *more)
    n = F.size("w")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(
        *[F.get(F.col("w"), i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")
    wide = split.select("doc_id", "t", "w", windows.alias("h"), lines.alias("lines"), *more)
    without = lambda chars: F.length(F.translate(t, chars, ""))                    # noqa: E731
    length = F.length(t)
    return wide.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (length - without(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("h")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        length.cast("long").alias("n_chars"),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(t, r"[^\p{Ll}]+", "")).cast("long").alias("n_lower"),
        (length - without("0123456789")).cast("long").alias("n_digits"),
        (length - without("!?")).cast("long").alias("n_marks"),
        F.size(F.filter("w", lambda x: F.length(x) <= 3)).cast("long").alias("n_short"),
        F.size(F.filter("w", lambda x: F.length(x) > 30)).cast("long").alias("n_long"), *more)


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _band(value: Column, good: tuple[float, float], fair: tuple[float, float]) -> Column:
    """1 within ``good``, -1 outside ``fair``, else abstain."""
    return F.when(value.between(*good), 1).when(~value.between(*fair), -1).otherwise(0)


def _flag(value: Column, above: float) -> Column:
    """-1 above a bound, else abstain: not being junk of one kind says little."""
    return F.when(value > above, -1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes over the measures. Each looks at another trait, so that errors are nearly independent."""
    return {
        "length": _band(F.col("n_words"), (40, 1e12), (12, 1e12)),
        "word_length": _band(_share("word_chars", "n_words"), (3.0, 9.0), (2.0, 14.0)),
        "short_words": F.when(F.col("n_words") < 30, 0).otherwise(
            _band(_share("n_short", "n_words"), (0.12, 0.8), (0.04, 0.95))),
        "symbols": _flag(_share("n_symbols", "n_words"), 0.15),
        "dup_lines": _flag(_share("n_dup_lines", "n_lines"), 0.3),
        "repeats": _flag(_share("n_repeat_words", "n_words"), 0.15),
        "capitals": _flag(F.col("n_upper") / F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1)), 0.4),
        "marks": _flag(_share("n_marks", "n_words"), 0.3),
        "digits": _flag(_share("n_digits", "n_chars"), 0.25),
        "long_words": _flag(_share("n_long", "n_words"), 0.15),
    }


@dataclass
class Weights:
    """Log-odds of a good document: prior plus, per rule, what its vote says."""
    prior: float
    votes: dict[str, dict[int, float]]

    def posterior(self) -> Column:
        total = F.lit(self.prior)
        for name, odds in self.votes.items():
            v = F.col(name)
            total = total + F.when(v == 1, odds[1]).when(v == -1, odds[-1]).otherwise(odds[0])
        return 1 / (1 + F.exp(-total))


def fit(patterns: list[tuple[tuple[int, ...], int]], names: list[str], prior: float = 0.85,
        rounds: int = 100, strength: float = 0.1) -> Weights:
    """Expectation-maximisation over vote patterns with their counts (at most 3^rules rows).

    Each class has, per rule, a distribution over good, bad and abstain. Pseudo-counts worth ``strength``
    of the rows say that rules are right rather than wrong, which fixes what the two classes mean. A rule
    may make the verdict worse or better, never turn a vote round: a good vote counts at least nothing for
    good, a bad one at least nothing against.
    """
    total = sum(n for _, n in patterns)
    both = {True: {1: 0.75, 0: 0.23, -1: 0.02}, False: {1: 0.5, 0: 0.3, -1: 0.2}}
    flag = {True: {1: 0.001, 0: 0.994, -1: 0.005}, False: {1: 0.001, 0: 0.699, -1: 0.3}}
    sided = [any(votes[k] == 1 for votes, _ in patterns) for k in range(len(names))]
    hint = {c: [(both if two else flag)[c] for two in sided] for c in (True, False)}
    table = {c: [dict(x) for x in hint[c]] for c in (True, False)}
    good = prior
    weight = max(1.0, strength * total)
    for _ in range(rounds if total else 0):
        sums = {c: [dict.fromkeys((1, 0, -1), 0.0) for _ in names] for c in (True, False)}
        mass = 0.0
        for votes, n in patterns:
            score = math.log(good / (1 - good)) + sum(
                math.log(table[True][k][v] / table[False][k][v]) for k, v in enumerate(votes))
            p = 1 / (1 + math.exp(-max(-60.0, min(60.0, score))))
            mass += n * p
            for k, v in enumerate(votes):
                sums[True][k][v] += n * p
                sums[False][k][v] += n * (1 - p)
        for c in (True, False):
            for k in range(len(names)):
                base = {v: sums[c][k][v] + weight * hint[c][k][v] for v in (1, 0, -1)}
                whole = sum(base.values())
                table[c][k] = {v: x / whole for v, x in base.items()}
        before, good = good, min(0.99, max(0.01, (mass + weight * prior) / (total + weight)))
        if abs(before - good) < 1e-9:
            break
    votes = {}
    for k, name in enumerate(names):
        odds = {v: math.log(table[True][k][v] / table[False][k][v]) for v in (1, 0, -1)}
        votes[name] = {1: max(0.0, odds[1]), 0: 0.0, -1: min(0.0, odds[-1])}
    return Weights(math.log(good / (1 - good)), votes)


def judge(measured: DataFrame, prior: float = 0.85) -> DataFrame:
    """Measures with votes, posterior ``quality``, ``base_failed`` and ``kept``.

    ``measured`` should be a staged table: it is read for the counts and again for the verdicts.
    """
    named = {f"vote_{k}": v for k, v in rules().items()}
    voted = measured.withColumns(named)
    names = list(named)
    counts = voted.groupBy(*names).count().collect()                   # at most 3^rules rows
    model = fit(sorted((tuple(r[n] for n in names), r["count"]) for r in counts), names, prior)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return voted.withColumns({"quality": model.posterior(), "base_failed": failed}) \
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def verdicts(docs: DataFrame, prior: float = 0.85) -> DataFrame:
    return judge(stage(measures(docs), "measures"), prior)


def keep(docs: DataFrame, prior: float = 0.85) -> DataFrame:
    """The rows of ``docs`` whose document is kept, with all their columns."""
    judged = judge(stage(measures(docs, carry=True), "measures"), prior)
    return judged.filter("kept").select("row.*")
