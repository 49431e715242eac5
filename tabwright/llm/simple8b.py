"""Simple-8b word-aligned coding of integer sequences, vectorised over blocks.

A 64-bit word holds a 4-bit selector and as many values as its selector says (fixed table below). Values
of 2^60 and more are escapes: their place in the stream holds 0 and the values follow the words. A coded
sequence is cut into blocks of ``BLOCK`` values; the header gives each block's first word, so blocks
decode on their own.

Layout (little-endian): magic "S8B1", u32 0, u64 values, u32 block
size, u32 blocks, u32 escapes, u32 words; u32 first word per block; u64 words; u64 escape places; u64
escape values.
"""

from __future__ import annotations

import struct

import numpy as np

#: Values per word and bits per value, by selector (fixed values of the coding).
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 512
MAGIC = b"S8B1"
HEAD = "<4sIQIIII"
HEAD_SIZE = struct.calcsize(HEAD)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits needed by each value below 2^60."""
    # beyond 2^53 rounding may ask for one bit more than needed, which still fits the 60 there are
    return np.minimum(np.frexp(values.astype(np.float64))[1], 60).astype(np.uint8)


def encode(values: np.ndarray) -> bytes:
    """The coded form of a sequence of unsigned integers."""
    values = np.asarray(values, dtype=np.uint64)
    escaped = np.flatnonzero(values >= np.uint64(1) << np.uint64(60)).astype("<u8")
    kept = values[escaped.astype(np.int64)].astype("<u8")
    if len(escaped):
        values = values.copy()
        values[escaped.astype(np.int64)] = 0
    n, blocks = len(values), -(-len(values) // BLOCK)
    padded = np.zeros(blocks * BLOCK, dtype=np.uint64)
    padded[:n] = values
    bits = _bits(padded).reshape(blocks, BLOCK)
    lengths = np.full(blocks, BLOCK)
    if blocks:
        lengths[-1] = n - (blocks - 1) * BLOCK
    choice = _choices(bits, lengths)
    step = np.minimum(COUNTS[choice], BLOCK).astype(np.int64)
    at, live, begins = np.zeros(blocks, dtype=np.int64), np.arange(blocks), []
    while len(live):                                    # where the next word of every block begins
        begins.append(live * BLOCK + at[live])
        at[live] += step[live, at[live]]
        live = live[at[live] < lengths[live]]
    begin = np.sort(np.concatenate(begins)) if begins else np.zeros(0, dtype=np.int64)
    owner, chosen = begin // BLOCK, choice.reshape(-1)[begin]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        for k in range(COUNTS[s]):
            words[rows] |= padded[begin[rows] + k] << np.uint64(k * WIDTHS[s])
    first = np.searchsorted(owner, np.arange(blocks)).astype("<u4")
    return b"".join([struct.pack(HEAD, MAGIC, 0, n, BLOCK, blocks, len(escaped), len(words)), first.tobytes(),
                     words.astype("<u8").tobytes(), escaped.tobytes(), kept.tobytes()])


def _choices(bits: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each place the selector that packs most of the values from there on, within the block."""
    blocks, size = bits.shape
    choice = np.full((blocks, size), len(COUNTS) - 1, dtype=np.int8)
    room = lengths[:, None] - np.arange(size)
    for s in range(len(COUNTS) - 2, -1, -1):            # wide to narrow: the fullest fitting word wins
        fits = bits <= WIDTHS[s]
        if np.count_nonzero(fits) < COUNTS[s]:
            continue
        run, span = fits, 1
        while span < COUNTS[s]:
            step = min(span, COUNTS[s] - span)
            longer = np.zeros_like(run)
            np.logical_and(run[:, :size - step], run[:, step:], out=longer[:, :size - step])
            run, span = longer, span + step
        choice[run & (room >= COUNTS[s])] = s
    return choice


def header(data: bytes) -> tuple[int, int, int, int, int]:
    """Values, block size, blocks, escapes, words."""
    magic, _, n, block, blocks, escapes, words = struct.unpack_from(HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b sequence")
    return n, block, blocks, escapes, words


def decode(data: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Values ``start`` to ``stop``; only the blocks they lie in are decoded."""
    n, block, blocks, escapes, n_words = header(data)
    stop = n if stop is None else min(stop, n)
    start = min(max(start, 0), stop)
    if start == stop:
        return np.zeros(0, dtype=np.uint64)
    first = np.frombuffer(data, "<u4", blocks, HEAD_SIZE)
    base = HEAD_SIZE + 4 * blocks
    low, high = start // block, -(-stop // block)
    begin, end = int(first[low]), int(first[high]) if high < blocks else n_words
    words = np.frombuffer(data, "<u8", end - begin, base + 8 * begin)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    sizes = COUNTS[chosen]
    place = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(place[-1], dtype=np.uint64)
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        shifts = np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(WIDTHS[s])
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        out[place[rows][:, None] + np.arange(COUNTS[s])] = (words[rows][:, None] >> shifts) & mask
    if escapes:
        tail = base + 8 * n_words
        places = np.frombuffer(data, "<u8", escapes, tail).astype(np.int64) - low * block
        inside = (places >= 0) & (places < len(out))
        out[places[inside]] = np.frombuffer(data, "<u8", escapes, tail + 8 * escapes)[inside]
    return out[start - low * block:stop - low * block]
