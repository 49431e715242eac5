"""Token ids of whole texts by the ``tokenizers`` library, with a memo of the chunks between spaces.

A space between two other characters is always a boundary of the tokenizers used here, so ids of the
chunks between such spaces put together are the ids of the text. Each worker remembers the ids of chunks. The memo is bounded
and forgets by use (``Recent``); it only saves time, what it does not hold is encoded anew. New words are
encoded many at a time, put together with spaces: which token begins or ends a word shows in the token itself.
Byte-level texts whose white space is single spaces and at most two newlines in a row are also cut before each newline, and
punctuation at a chunk's end is cut off, so that words are known by their letters.
"""

from __future__ import annotations

import os
import re
import sys
import types
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks a worker remembers in each of two generations (about 200 bytes each).
MEMO = 400_000
#: New words encoded as one text.
TOGETHER = 128

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space next to a space, among the common kinds; any of the others.
_DOUBLE = [x + " " for x in " \n\t\r\x0b\x0c"] + [" " + x for x in "\n\t\r\x0b\x0c"]
_RARE = re.compile(r"[^\S \n\t\r\x0b\x0c]")
_RARE_ASCII = "\x1c\x1d\x1e\x1f"
#: Marks cuts inside texts, and pieces that stand right behind the one before; a text that holds either is encoded as one piece.
_MARK, _BEHIND = "\x1f", "\x1e"
#: Letters (no capital I with dot: lower-casing ends it in a mark). Between one and punctuation is always a boundary.
_LATIN = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}"
#: Punctuation that may be cut off: never part of a contraction (fixed values).
_TAIL = rf"([0-9{_LATIN}])([.,;:!?%$&*#|]+)(\x1f|$)"
_LETTERS = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), _LATIN) + "]+")
_UINT = array("I")


def worker_memory() -> dict:
    """A dict that lasts as long as the worker process, beyond the task and its copy of this module."""
    name = "_tabwright_worker_memory"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name].__dict__


class Recent(dict):
    """A bounded memo that forgets by use: two generations; what is asked for moves to the young one (``put``), and when that is
    full it becomes the old one and the old one goes."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def put_all(self, entries: dict) -> None:
        """All of ``entries``; the limit may be passed by as many."""
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self.update(entries)


def encoder(path: str, keeps_space: bool) -> Encoder:
    """An encoder for the tokenizer file at ``path``; it shares tokenizer and memo with this worker's earlier tasks.

    ``keeps_space``: the space before a chunk belongs to it (byte-level); otherwise white space is dropped.
    """
    memory, key = worker_memory(), f"{path} {keeps_space}"
    if key not in memory:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        memory[key] = Encoder(Tokenizer.from_file(path), Recent(MEMO), keeps_space)
    return memory[key]


def _rare(text: str) -> bool:
    return any(x in text for x in _RARE_ASCII) if text.isascii() else _RARE.search(text) is not None


class Encoder:
    def __init__(self, tokenizer, memo: Recent, keeps_space: bool):
        self.tokenizer, self.memo, self.keeps_space = tokenizer, memo, keeps_space
        vocab = tokenizer.get_vocab(with_added_tokens=False)
        #: By what stands before a word: whether a token is the first (byte-level: it holds that) or the last (word ends) one of it.
        self.edge = {}
        for lead, mark in {" ": "\u0120", "\n": "\u010a"}.items() if keeps_space else [("", "</w>")]:
            self.edge[lead] = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
            self.edge[lead][[i for t, i in vocab.items() if (t.startswith(mark) if keeps_space else t.endswith(mark))]] = True
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def _by_lines(self, text: str) -> bool:
        """Whether a text without white space next to a space may be cut before each newline: up to two newlines in a row are
        single pieces to the byte-level tokenizer, longer runs and two at the end (or before a special token) are not."""
        return "\n" in text and "\n\n\n" not in text and text[-2:] != "\n\n" \
            and not any(x in text for x in "\t\r\x0b\x0c") and not any(x in text for x in self.added)

    def _direct(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        if sys.byteorder == "little" and _UINT.itemsize == 4:
            return [array("I", e.ids).tobytes() for e in found]
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _words(self, words: list[str], lead: str) -> list[bytes]:
        """Ids of words without white space at their ends, each as if after ``lead``; without one, of words of plain letters."""
        out, edge = [], self.edge[lead]
        parts = [words[i:i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for part, data in zip(parts, self._direct([lead + (lead or " ").join(p) for p in parts]), strict=True):
            ids = np.frombuffer(data, dtype="<u4")
            cuts = np.flatnonzero(edge[ids] if len(ids) and ids.max() < len(edge) else ids < 0)
            ends = [*cuts[1:].tolist(), len(ids)] if lead else (cuts + 1).tolist()
            # every word has an edge, so as many edges as words are one a word
            if len(ends) == len(part) and ends[-1] == len(ids) and (not lead or cuts[0] == 0):
                out += [data[4 * a:4 * b] for a, b in zip([0, *ends], ends)]
            else:
                out += self._direct([lead + w for w in part])
        return out

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that are not young in the memo; they are afterwards."""
        out = list(map(self.memo.old.get, chunks)) if self.memo.old else [None] * len(chunks)
        entries = {c: own for c, own in zip(chunks, out, strict=True) if own is not None}
        new = [c for c, own in zip(chunks, out, strict=True) if own is None]
        if self.keeps_space:
            groups = {" ": [c for c in new if not (c[0].isspace() or c[-1].isspace())],
                      "\n": [c[1:] for c in new if c[0] == "\n" and len(c) > 1]}
        else:
            groups = {"": [c for c in new if _LETTERS.fullmatch(c)]}
        for lead, words in groups.items():
            ids = self._words(words, lead)
            entries.update(zip(words if lead != "\n" else ["\n" + w for w in words], ids, strict=True))
        rest, lead = [c for c in new if c not in entries], " " if self.keeps_space else ""
        entries.update(zip(rest, self._direct([c.lstrip(_BEHIND) if c[0] in _BEHIND + "\n" else lead + c for c in rest]),
                           strict=True))
        self.memo.put_all(entries)
        return [entries[c] if own is None else own for c, own in zip(chunks, out, strict=True)]

    def _marked(self, text: str) -> str:
        """The text with marks where it is cut; what stands before the first one has no space before it."""
        if not self.keeps_space:
            return _MARK + text.replace("\n", _MARK).replace(" ", _MARK)
        if any(x in text for x in _DOUBLE) or _rare(text) or text[:1] == " " or text[-1:] == " ":
            return _CUT.sub(_MARK, text)
        if self._by_lines(text):
            text = text.replace("\n", _MARK + "\n")
        return text.replace(" ", _MARK)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not texts:
            return []
        whole = {i: t for i, t in enumerate(texts) if _MARK in t or _BEHIND in t}
        marked = pa.array(["" if i in whole else self._marked(t) for i, t in enumerate(texts)], pa.string())
        lists = pc.split_pattern(pc.replace_substring_regex(marked, _TAIL, rf"\1{_MARK}{_BEHIND}\2\3"), _MARK)
        bounds, words = lists.offsets.to_numpy().astype(np.int64), lists.flatten().dictionary_encode()
        codes, chunks = words.indices.to_numpy().astype(np.int64), words.dictionary.to_numpy(zero_copy_only=False).tolist()
        # chunks of the whole batch are looked up once each; a text's first one is encoded for itself
        heads = [whole.get(i, chunks[c]) for i, c in enumerate(codes[bounds[:-1]].tolist())]
        used = np.zeros(len(chunks), dtype=bool)
        used[np.delete(codes, bounds[:-1])] = True
        held = [self.memo.get(c) if u and c else b"" for c, u in zip(chunks, used.tolist(), strict=True)]
        missing = [i for i, own in enumerate(held) if own is None]
        for i, own in zip(missing, self._learn([chunks[i] for i in missing]) if missing else (), strict=True):
            held[i] = own
        filled = [h for h in heads if h]
        own = iter(self._direct(filled) if filled else ())
        held += [next(own) if h else b"" for h in heads]
        codes[bounds[:-1]] = len(chunks) + np.arange(len(texts))
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        lengths = sizes[codes]
        ends = np.cumsum(lengths)
        at = np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - lengths), lengths) + np.arange(ends[-1])
        data = np.frombuffer(b"".join(held), dtype="<u4")[at].tobytes()
        cuts = (4 * ends[bounds[1:] - 1]).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]
