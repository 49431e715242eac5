"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them.

Base spans follow fixed patterns and always stay. Further candidates (written-out mail addresses, phone numbers without a
country code) and the base spans are put before labelers: strict forms, gazetteers, words in front, digit variety.
Votes are counted by pattern; expectation-maximisation estimates each labeler's reliability from the counts, its posteriors
train a logistic span classifier on votes and kind, and candidates that it accepts join the result.

Everything that touches rows is DataFrame expressions; what the driver fits is a table of vote patterns, bounded by kinds x
3^labelers. Patterns are written so that the matcher loops over characters without recursion or rescanning: long digit runs
and long host names cost linear time. Positions count code points, ends are exclusive.

Defined cases: a NULL or empty text has no spans; rows repeating an id are treated each; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import bind, text_of
from tabwright.session import stage

KINDS = ["email", "ip", "card", "phone"]
#: Base patterns. The starts are those of the plain forms: the beginning of a run, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.(?=[A-Za-z0-9-])"
             r"[A-Za-z0-9.-]*?(?=\.(?![A-Za-z0-9-])|[^A-Za-z0-9.-]|\z)",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=[ -]?[0-9])[0-9 -]*?(?=[ -](?![0-9])|[^0-9 -]|\z)",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must contain to be searched at all.
SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": r"\+[0-9]"}
#: Candidates beyond the base: kind, pattern, sign.
EXTRAS = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{2,63} ?"
              r"(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,10}(?![A-Za-z0-9])", r"[( \[]dot[) \]]"),
    ("phone", r"(?<![0-9+().-])(?<![0-9+] )\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9.-])", r"[0-9]{3}[.-][0-9]{4}"),
]
#: Words in front that speak for and against (fixed values), and how far in front they are sought.
FOR = r"(?i)(?:e-?mail|mail|contact|write|phone|tel|call|mobile|cell|fax|card|visa|credit|ip|host|address|adresse|kontakt|correo)"
AGAINST = r"(?i)(?:version|ver\.|release|isbn|order|invoice|serial|sku|ticket|build|chapter|section|page)\W*$"
AHEAD = 40
#: Top-level domains taken as known (fixed values).
DOMAINS = r"(?i)[. ](?:com|org|net|edu|gov|mil|int|info|biz|io|co|de|fr|es|uk|us|eu|it|nl|at|ch|example|invalid|test)$"
LABELERS = ["form", "gazetteer", "context", "variety", "check"]


def _found(t: Column, pattern: str, sign: str, keep) -> Column:
    """Matches as array<struct<s,e,m>>: lengths of gaps and matches added up; ``keep`` filters by the match."""
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def placed(ms: Column) -> Column:
        gaps = F.split(t, pattern, -1)
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return bind(gaps, lambda g: F.aggregate(F.sequence(F.lit(0), F.size(ms) - 1), start, lambda a, i: _step(a, ms, g, i))["out"])

    def _step(a: Column, ms: Column, g: Column, i: Column) -> Column:
        s = a["at"] + F.length(F.get(g, i))
        e = s + F.length(F.get(ms, i))
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(
            s.alias("s"), e.alias("e"), F.get(ms, i).alias("m")))).alias("out"))

    has = F.contains(t, F.lit(sign)) if sign == "@" else t.rlike(sign)
    return F.when(has, bind(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda ms: F.when(
        F.size(ms) > 0, F.filter(placed(ms), lambda x: keep(x["m"]))).otherwise(none))).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _ip(m: Column) -> Column:
    part = lambda p: F.coalesce(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))).try_cast("int"), F.lit(999)) <= 255
    return F.forall(F.split(m, r"\."), part)


def _card(m: Column) -> Column:
    def luhn(d: Column) -> Column:
        def one(a: Column, i: Column) -> Column:
            x = F.substr(d, F.length(d) - i, F.lit(1)).cast("int") * (1 + i % 2)
            return a + F.when(x > 9, x - 9).otherwise(x)
        return F.length(d).between(12, 19) & (F.aggregate(
            F.sequence(F.lit(0), F.least(F.length(d), F.lit(19)) - 1), F.lit(0), one) % 10 == 0)
    return bind(_digits(m), luhn)


def _phone(m: Column) -> Column:
    return F.length(_digits(m)).between(9, 15)


KEEP = {"email": lambda m: F.lit(True), "ip": _ip, "card": _card, "phone": _phone}


def _votes(kind: str, base: bool, t: Column, x: Column) -> list[Column]:
    """One vote per labeler on a candidate: 1 for, -1 against, 0 abstains."""
    m, s = x["m"], x["s"]
    front = F.substr(t, F.greatest(s - AHEAD + 1, F.lit(1)), F.least(s, F.lit(AHEAD)))
    vote = lambda good, bad: F.when(good, 1).when(bad, -1).otherwise(0)            # noqa: E731
    no = F.lit(False)
    form = {"email": vote(m.rlike(r"^[A-Za-z0-9][^@]*[@ (\[].*[. )\]][A-Za-z]{2,10}$"), m.rlike(r"[0-9]$")),
            "ip": vote(~m.rlike(r"(?:^|\.)0[0-9]"), m.rlike(r"(?:^|\.)0[0-9]")),
            "card": vote(m.rlike(r"^[0-9]{12,19}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$"), no),
            "phone": vote(m.rlike(r"^\+[0-9]{1,3}[ (-]|^\([0-9]{3}\) "), no)}[kind]
    known = {"email": vote(m.rlike(DOMAINS), no), "ip": vote(~m.rlike(r"^(?:0|127|255)\."), m.rlike(r"^0+\.")),
             "card": vote(m.rlike(r"^[3456]"), m.rlike(r"^[01789]")),
             "phone": vote(m.rlike(r"^\+(?:1|7|20|27|3[0-69]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|555"), no)}[kind]
    context = vote(front.rlike(FOR) & ~front.rlike(AGAINST), front.rlike(AGAINST))
    kinds = F.size(F.array_distinct(F.split(_digits(m), "")))
    variety = F.lit(0) if kind == "email" else vote(kinds >= 4, kinds <= 2)
    check = F.lit(1 if base else 0)
    return [form, known, context, variety, check]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array<struct<s, k (place of the kind), e, base, votes>> in text order."""
    t = F.col("t")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    wide = rows.select("doc_id", "t", *[_found(t, PATTERNS[k], SIGNS[k], KEEP[k]).alias(k) for k in KINDS],
                       *[_found(t, p, sign, lambda m: F.lit(True)).alias(f"extra_{i}") for i, (_, p, sign) in enumerate(EXTRAS)])

    def told(column: str, kind: str, base: bool) -> Column:
        return F.transform(F.col(column), lambda x: F.struct(
            x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), F.lit(base).alias("base"),
            F.concat_ws(",", *[v.cast("string") for v in _votes(kind, base, t, x)]).alias("votes")))

    own = F.concat(*[told(k, k, True) for k in KINDS])
    more = F.concat(*[told(f"extra_{i}", k, False) for i, (k, _, _) in enumerate(EXTRAS)])
    free = F.filter(more, lambda x: ~F.exists(F.col("own"), lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
    return wide.withColumn("own", own).select("doc_id", F.sort_array(F.concat("own", free)).alias("spans"))


def reliabilities(counts: dict[tuple[int, tuple[int, ...]], int], rounds: int = 60) -> tuple[dict, float, dict]:
    """Expectation-maximisation over (kind, votes) -> count.

    Returns per labeler P(vote | personal) / P(vote | not), the prior, and the posterior of each pattern. Pseudo-counts
    worth one candidate in twenty say that labelers are right rather than wrong.
    """
    total = sum(counts.values())
    hint = {1: {1: 0.6, 0: 0.35, -1: 0.05}, 0: {1: 0.15, 0: 0.5, -1: 0.35}}
    table = {c: [dict(hint[c]) for _ in LABELERS] for c in (1, 0)}
    prior, weight, post = 0.7, max(2.0, 0.05 * total), {}
    for _ in range(rounds if total else 0):
        for pattern in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[1][j][v] / table[0][j][v]) for j, v in enumerate(pattern[1]))
            post[pattern] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        for c in (1, 0):
            for j in range(len(LABELERS)):
                mass = {v: weight * hint[c][v] for v in (1, 0, -1)}
                for pattern, n in counts.items():
                    mass[pattern[1][j]] += n * (post[pattern] if c else 1 - post[pattern])
                whole = sum(mass.values())
                table[c][j] = {v: x / whole for v, x in mass.items()}
        prior = min(0.98, max(0.02, (sum(n * post[k] for k, n in counts.items()) + weight * 0.7) / (total + weight)))
    return {name: {v: table[1][j][v] / table[0][j][v] for v in (1, 0, -1)} for j, name in enumerate(LABELERS)}, prior, post


def train(counts: dict, post: dict, steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """Weights of the span classifier: intercept, one per kind, two per labeler (for, against); soft labels ``post``."""
    total = sum(counts.values()) or 1
    rows = [(_inputs(k, votes), post[k, votes], n / total) for (k, votes), n in counts.items()]
    w = [0.0] * (1 + len(KINDS) + 2 * len(LABELERS))
    for _ in range(steps if rows else 0):
        g = [decay * x for x in w]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(w[i] for i in x)))))
            for i in x:
                g[i] += n * (p - y)
        w = [a - rate * b for a, b in zip(w, g, strict=True)]
    return w


def _inputs(kind: int, votes: tuple[int, ...]) -> list[int]:
    """Places of the inputs that are 1."""
    base = 1 + len(KINDS)
    return [0, 1 + kind] + [base + 2 * j + (v < 0) for j, v in enumerate(votes) if v]


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base and all spans as arrays of struct<s, k, e>."""
    held = stage(candidates(docs), "spans")
    seen = held.select(F.explode("spans").alias("x")).groupBy("x.k", "x.votes").count().collect()   # bounded patterns
    counts = {(r.k, tuple(int(v) for v in r.votes.split(","))): r["count"] for r in seen}
    _, _, post = reliabilities(counts)
    weights = train(counts, post)
    taken = [f"{k}:{','.join(map(str, votes))}" for k, votes in counts
             if sum(weights[i] for i in _inputs(k, votes)) >= 0]
    accepted = F.array(*[F.lit(x) for x in sorted(taken)]).cast("array<string>")
    bare = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    own = F.filter("spans", lambda x: x["base"])
    every = F.filter("spans", lambda x: x["base"] | F.array_contains(
        accepted, F.concat_ws(":", x["k"].cast("string"), x["votes"])))
    return held.select("doc_id", bare(own).alias("base"), bare(every).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """The digest columns: base counts by kind, the base spans' checksum, all spans."""
    count = lambda i: F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")
    return find(docs).select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                             F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
