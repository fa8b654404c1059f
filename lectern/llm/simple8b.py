"""Simple-8b: integers in 64-bit words, a 4-bit selector and as many equal fields as the values allow.

Values are coded in runs of ``RUN``; each run starts a new word and its word
offset is stored, so all runs are coded and decoded side by side by array
operations.  A value of more than 60 bits is an escape: a word with selector 0,
then the value as a whole word; the places of escapes are stored too.
"""

from __future__ import annotations

import struct

import numpy as np

from lectern.llm.common import ragged

RUN = 128
#: Fields in a word and bits of a field, by selector; selector 0 is the escape.
FIELDS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_HEAD = struct.Struct("<4sIII")


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    high = values >> np.uint64(32)
    if not high.any():
        return np.frexp(values.astype(np.float64))[1].astype(np.uint8)  # exact: a float holds 53 bits
    low = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, low).astype(np.uint8)


def _selectors(values: np.ndarray) -> np.ndarray:
    """For a word that would start at each value: the selector with the most fields that holds what follows in its run.

    What fits a selector fits all later ones, which have fewer and wider fields, so
    the number of selectors that fit tells the first of them.
    """
    most, span = _bits(values).reshape(-1, RUN), 1  # most: the maximum over ``span`` values
    fit = np.zeros(most.shape, np.uint8)
    for s in range(15, 0, -1):
        while span < FIELDS[s]:
            step = min(span, int(FIELDS[s]) - span)
            most[:, :-step] = np.maximum(most[:, :-step], most[:, step:])
            span += step
        ok = most <= BITS[s]
        if not ok.any():
            break
        fit += ok
    return np.where(fit > 0, 16 - fit, 0).ravel()


def pack(values: np.ndarray) -> bytes:
    values = np.asarray(values).astype(np.uint64)
    n = len(values)
    padded = np.zeros(-(-n // RUN) * RUN, np.uint64)
    padded[:n] = values
    chosen, runs = _selectors(padded), len(padded) // RUN
    at, steps = np.arange(runs) * RUN, []
    end = np.minimum(at + RUN, n)
    while (open_ := at < end).any():
        steps.append(np.where(open_, at, -1))
        at = np.where(open_, at + FIELDS[chosen[np.minimum(at, max(len(padded) - 1, 0))]], at)
    starts = np.stack(steps, 1) if steps else np.zeros((0, 0), np.int64)
    real = starts >= 0
    run_words, starts = real.sum(1), starts[real]
    sel = chosen[starts]
    far = sel == 0
    place = np.arange(len(starts)) + np.cumsum(far) - far  # an escape takes two words
    words = np.zeros(len(starts) + int(far.sum()), np.uint64)
    limit = np.repeat(end, run_words)
    for s in range(1, 16):
        own = np.flatnonzero(sel == s)
        word = np.full(len(own), s << 60, np.uint64)
        if BITS[s]:
            for k in range(FIELDS[s]):
                i = starts[own] + k
                word |= np.where(i < limit[own], padded[np.minimum(i, len(padded) - 1)], np.uint64(0)) << np.uint64(k * BITS[s])
        words[place[own]] = word
    words[place[far] + 1] = padded[starts[far]]
    first = np.cumsum(run_words) - run_words
    offsets = place[first] if runs else np.zeros(0, np.int64)
    return b"".join((_HEAD.pack(b"S8b1", n, len(words), int(far.sum())), offsets.astype("<u4").tobytes(), place[far].astype("<u4").tobytes(), words.astype("<u8").tobytes()))


def unpack(data: bytes) -> np.ndarray:
    mark, n, n_words, n_far = _HEAD.unpack_from(data)
    if mark != b"S8b1":
        raise ValueError("not a Simple-8b block")
    runs = -(-n // RUN)
    offsets = np.frombuffer(data, "<u4", runs, _HEAD.size).astype(np.int64)
    far = np.frombuffer(data, "<u4", n_far, _HEAD.size + 4 * runs)
    words = np.frombuffer(data, "<u8", n_words, _HEAD.size + 4 * (runs + n_far))
    real = np.ones(n_words, bool)
    real[far + 1] = False
    at = np.flatnonzero(real)
    sel = (words[at] >> np.uint64(60)).astype(np.int64)
    sel[np.searchsorted(at, far)] = 0
    counts = FIELDS[sel]
    if runs:
        first = np.searchsorted(at, offsets)
        over = np.add.reduceat(counts, first) - np.minimum(RUN, n - RUN * np.arange(runs))
        counts[np.append(first[1:], len(at)) - 1] -= over  # the last word of a run may hold fewer
    ends = np.cumsum(counts)
    begin, out = ends - counts, np.zeros(n, np.uint64)
    for s in range(2, 16):
        own = np.flatnonzero(sel == s)
        if len(own):
            i = ragged(begin[own], counts[own])
            k = ragged(np.zeros(len(own), np.int64), counts[own]).astype(np.uint64)
            out[i] = np.repeat(words[at[own]], counts[own]) >> (k * np.uint64(BITS[s])) & np.uint64((1 << int(BITS[s])) - 1)
    own = np.flatnonzero(sel == 0)
    out[begin[own]] = words[at[own] + 1]
    return out
