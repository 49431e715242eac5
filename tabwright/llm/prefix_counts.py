"""Exact token counts of every prefix of a text under a byte-level BPE tokenizer, by dynamic programming.

The last token of a text's encoding is the one token that ends it and gets on with the last token of what stands before it
(no merge across the seam would have come first). So with the last token and the count of every shorter prefix known, those
of the next one follow in a few look-ups, and the whole table costs one walk over the text. Limits, truncation and budgets
are then answered from the table, without encoding again.

A text is first cut into units that no merge crosses and whose tables do not depend on what precedes them; a worker remembers
the tables of units it has met (bounded, see ``Recent``; it only saves time). A prefix counts as the library would count it
as a text of its own: white space at its end is one run, an apostrophe not yet followed by its letters stands alone, a
special string is one token as soon as it is complete. Prefixes end at code points.

Defined cases: a NULL text counts as empty; an empty text has one prefix, of 0 tokens; rows repeating an id are counted each for
itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import carried, text_of
from tabwright.llm.token_output import text_batches
from tabwright.llm.tokens import Recent, worker_memory

#: Units a worker remembers in each of two generations.
UNITS = 250_000
#: Seams between tokens a worker remembers.
SEAMS = 1_000_000
NEVER = 1 << 60

#: The pre-tokenizer's classes; white space as the Unicode property, not as Python's wider class.
_WHITE, _LETTER, _DIGIT = r"\p{White_Space}", r"\p{L}", r"\p{N}"
_ENDINGS = "'(?:[sdmt]|ll|ve|re)"


def _pattern(white: str, letter: str, digit: str) -> str:
    words = f"[{letter}]+|[{digit}]+|[^{white}{letter}{digit}]+"
    # a run of white space takes the piece after it along: its last character may belong to that piece
    return (f"{_ENDINGS}| ?(?:{words})"
            f"|[{white}]{{2,}}(?:(?<= )(?:{words})|(?<! )(?:{_ENDINGS}|{words}))?|[{white}]")


_UNIT = regex.compile(_pattern(_WHITE, _LETTER, _DIGIT))
_ASCII_UNIT = re.compile(_pattern(r"\t-\r ", "A-Za-z", "0-9"))
_RUN = regex.compile(f"{_WHITE}{{2,}}")
_CONTRACTION = re.compile(_ENDINGS)
#: A character of each class, for those that the library's Unicode tables hold to be of another class than Python's do.
_STANDS_FOR = {"letter": "\u00e9", "digit": "\u00b2", "other": "\u00a7", "white": "\u2003"}


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes are themselves, the others follow
    from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixCounter:
    """Counts for the tokenizer file at ``path`` (byte-level BPE; a ValueError says what is not supported)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") \
                or not before.get("use_regex", True) or spec["normalizer"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("not a plain byte-level BPE tokenizer")
        letters, vocab = _byte_letters(), model["vocab"]
        spelled = {token: bytes(letters[c] for c in token) for token in vocab if all(c in letters for c in token)}
        self.joined: dict[tuple[int, int], tuple[int, int]] = {}       # pair -> (rank, token)
        self.born: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, token = vocab[a], vocab[b], vocab[a + b]
            if token in self.parts or any(len(spelled[x]) > 1 and vocab[x] not in self.parts for x in (a, b)):
                raise ValueError("merges are not in order, or two make the same token")
            self.joined[left, right] = rank, token
            self.born[token], self.parts[token] = rank, (left, right)
        #: Every beginning of a token's bytes, with the token where the beginning is one.
        self.trie: dict[bytes, int | None] = {}
        single = {s: vocab[t] for t, s in spelled.items() if len(s) == 1}
        if len(single) < 256:
            raise ValueError("some bytes have no token")
        for token, data in spelled.items():
            if len(data) == 1 or (vocab[token] in self.parts and self._whole(vocab[token])):
                for end in range(1, len(data)):
                    self.trie.setdefault(data[:end], None)
                self.trie[data] = vocab[token]
        from tokenizers import pre_tokenizers
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.known, self.differs = {chr(i) for i in range(128)}, {}
        self.seams: dict[tuple[int, int], bool] = {}
        self.memo = Recent(UNITS)
        added = [t for t in spec.get("added_tokens") or []]
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            raise ValueError("special strings with conditions")
        strings = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, strings))) if strings else None
        self.special_strings = strings

    def _learn_classes(self, letters: set[str]) -> None:
        """Ask the library for the class of characters not met before."""
        for c in letters:
            theirs = next((k for k, x in (("letter", "a"), ("digit", "1"), ("other", "."))
                           if len(self.library.pre_tokenize_str(x + c)) == 1), "white")
            ours = next((k for k, x in (("letter", "a"), ("digit", "1"), ("other", "."))
                         if len(_UNIT.findall(x + c)) == 1), "white")
            if ours != theirs:
                self.differs[ord(c)] = _STANDS_FOR[theirs]
        self.known |= letters

    def units(self, text: str) -> list[str]:
        """The text cut into units."""
        if text.isascii():
            return _ASCII_UNIT.findall(text)
        if new := set(text) - self.known:
            self._learn_classes(new)
        shadow = text.translate(self.differs) if self.differs else text
        cut = _UNIT.findall(shadow)
        if shadow != text:
            ends = list(accumulate(map(len, cut), initial=0))
            cut = [text[a:b] for a, b in pairwise(ends)]
        return cut

    def _crossing(self, left: int, right: int, before: int) -> bool:
        """Whether a merge of rank below ``before`` joins the end of token ``left`` with the beginning of ``right``.

        Going down the trees, each token at the seam lives until its parent is merged. Of equal merges the leftmost comes
        first: it takes the seam's left token away from it, but not the right one."""
        a, a_until = left, NEVER
        while True:
            b, b_until = right, NEVER
            while True:
                rank, _ = self.joined.get((a, b), (NEVER, 0))
                if rank < before and rank < a_until and rank <= b_until:
                    return True
                if b not in self.parts:
                    break
                b, b_until = self.parts[b][0], self.born[b]
            if a not in self.parts:
                return False
            a, a_until = self.parts[a][1], self.born[a]

    def _whole(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as that one token (parts come before their token)."""
        stack = [token]
        while stack:
            one = stack.pop()
            if one in self.parts:
                left, right = self.parts[one]
                if self._crossing(left, right, self.born[one]):
                    return False
                stack += [left, right]
        return True

    def _meets(self, left: int, right: int) -> bool:
        found = self.seams.get((left, right))
        if found is None:
            if len(self.seams) >= SEAMS:
                self.seams.clear()
            found = self.seams[left, right] = not self._crossing(left, right, NEVER)
        return found

    def _table(self, piece: str) -> list[int]:
        """Tokens of each prefix of a piece that merges stay within; index 0 is the empty prefix."""
        data = piece.encode("utf-8", "replace")
        n, trie = len(data), self.trie
        last: list[int | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        for at in range(n):
            own, end = last[at], at + 1
            while end <= n:
                token = trie.get(data[at:end], -1)
                if token == -1:
                    break
                if token is not None and last[end] is None and (own is None or self._meets(own, token)):
                    last[end], count[end] = token, count[at] + 1
                end += 1
        if n == len(piece):
            return count
        ends = [i for i in range(1, n) if data[i] & 0xC0 != 0x80]
        return [0, *[count[i] for i in ends], count[n]]

    def _unit(self, unit: str) -> list[int]:
        run = _RUN.match(unit.translate(self.differs) if self.differs else unit)
        if run is None:
            if _CONTRACTION.fullmatch(unit):
                # before it is complete, the apostrophe is a piece of its own
                alone = self._table(unit[0])[1]
                return [0, alone, *[alone + c for c in self._table(unit[1:])[1:-1]], self._table(unit)[-1]]
            return self._table(unit)
        white, rest = unit[:run.end()], unit[run.end():]
        spaces = self._table(white)
        if not rest:
            return spaces
        if white[-1] == " ":
            return spaces + [spaces[-2] + c for c in self._table(" " + rest)[2:]]
        before = spaces[-2] + self._table(white[-1])[1]
        return spaces + [before + c for c in self._unit(rest)[1:]]

    def _steps(self, unit: str) -> bytes:
        """How the count changes at each code point of the unit, as 32-bit integers."""
        found = self.memo.old.get(unit)
        if found is None:
            found = np.array([b - a for a, b in pairwise(self._unit(unit))], dtype="<i4").tobytes()
        self.memo.put(unit, found)
        return found

    def _plain(self, text: str) -> bytes:
        cut = self.units(text)
        found = list(map(self.memo.get, cut))
        if None in found:
            found = [self._steps(u) if x is None else x for u, x in zip(cut, found, strict=True)]
        return b"".join(found)

    def steps(self, text: str) -> np.ndarray:
        """Change of the count at each code point: the running sum is the count of each prefix."""
        if not any(s in text for s in self.special_strings):
            return np.frombuffer(self._plain(text), dtype="<i4")
        out, at = [], 0
        for hit in self.special.finditer(text):
            start, end = hit.span()
            # until its last character it is ordinary text
            own = np.frombuffer(self._plain(text[at:end - 1]), dtype="<i4")
            out += [own, np.array([1 - own[start - at:].sum()], dtype="<i4")]
            at = end
        return np.concatenate([*out, np.frombuffer(self._plain(text[at:]), dtype="<i4")])

    def counts(self, text: str) -> np.ndarray:
        """Tokens of each prefix, from the empty one to the whole text."""
        return np.concatenate([[0], np.cumsum(self.steps(text), dtype=np.int64)])


def counter(path: str) -> PrefixCounter:
    memory, key = worker_memory(), f"prefixes {path}"
    if key not in memory:
        memory[key] = PrefixCounter(path)
    return memory[key]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")) \
        .select(carried("doc_id"), "text")


def _per_document(path: str, name: str, value):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = counter(path)
        for rows in batches:
            for doc_ids, texts in text_batches(rows, ["doc_id"], "text"):
                yield pd.DataFrame({
                    "doc_id": pd.array([None if i is None else int(i) for i in doc_ids], "Int64"),
                    "n_bytes": [len(t.encode("utf-8", "replace")) for t in texts], name: [value(own, t) for t in texts]})
    return run


def prefix_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes and ``counts``: the tokens of each prefix, by its number of code points."""
    return _rows(docs).mapInPandas(_per_document(tokenizer, "counts", lambda own, t: own.counts(t)),
                                   "doc_id long, n_bytes long, counts array<long>")


def totals(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens, the last entry of each table, where the tables themselves are not wanted."""
    return _rows(docs).mapInPandas(_per_document(tokenizer, "n_tokens", lambda own, t: int(own.steps(t).sum())),
                                   "doc_id long, n_bytes long, n_tokens long")


def tokens_at(counts: Column, length: Column | int) -> Column:
    """Tokens of the prefix of ``length`` code points; NULL outside the text."""
    return F.get(counts, length if isinstance(length, Column) else F.lit(length))


def longest_within(counts: Column, budget: int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens (counts may fall as a prefix grows)."""
    return F.array_max(F.transform(counts, lambda c, i: F.when(c <= budget, i)))


def truncated(text: Column, counts: Column, budget: int) -> Column:
    """The text cut to its longest prefix of at most ``budget`` tokens; a NULL text counts as empty."""
    return F.substring(F.coalesce(text, F.lit("")), F.lit(1), longest_within(counts, budget))
