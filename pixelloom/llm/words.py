"""Words of many texts at once: bounds and 64-bit hashes, computed on whole byte buffers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from pixelloom.llm.common import mixed

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x51_7C_C1_B7_27_22_0A_95))
_BASE = np.uint64(0x5851F42D4C957F2D)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CHUNK = 1 << 18
_powers: dict[str, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. n-1 modulo 2 ** 64, kept for the next call."""
    known = _powers.get(str(base))
    if known is None or len(known) < n:
        steps = np.full(max(n, _CHUNK * 2), base, np.uint64)
        steps[0] = 1
        known = _powers[str(base)] = np.multiply.accumulate(steps)
        if n > _CHUNK * 64:  # one huge word: do not keep the table
            del _powers[str(base)]
    return known[:n]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; the spans are in order and do not overlap."""
    out = np.zeros(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _CHUNK, "right")))
        low = int(starts[first])
        part = buf[low : int(ends[last - 1])]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_CODES[part] * powers(_BASE, len(part)), out=total[1:])
        a, b = starts[first:last] - low, ends[first:last] - low
        own = (total[b] - total[a]) * powers(_BASE_INVERSE, len(part) + 1)[a]
        out[first:last] = mixed(own + (b - a).astype(np.uint64))
        first = last
    return out


@dataclass
class Words:
    """Words [^ \\t-\\r]+ of a row of texts, with A-Z lower-cased before hashing."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # index of the text of each word
    first: np.ndarray  # index of the first word of each text, and the number of words at the end
    hashes: np.ndarray


def words_of(buf: np.ndarray, at: np.ndarray) -> Words:
    n = len(at) - 1
    space = SPACE[buf]
    before = np.ones(len(buf) + 1, bool)
    before[1:] = space
    after = np.ones(len(buf) + 1, bool)
    after[:-1] = space
    inner = at[1:-1]
    before[inner] = True  # a text begins here
    after[inner] = True
    starts = np.flatnonzero(~space & before[:-1])
    ends = np.flatnonzero(~space & after[1:]) + 1
    first = np.searchsorted(starts, at).astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(first))
    return Words(starts, ends, doc, first, span_hashes(LOWER[buf], starts, ends))


_STEPS = np.array([0x9E6C63D0876A9A47, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and the bounds of each text's run (n + 1).

    A text of 1 .. k-1 words has its whole sequence as the only one.
    """
    if not 1 <= k <= len(_STEPS):
        raise ValueError("k must be 1 .. 5")
    count = np.diff(words.first)
    runs = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    bounds = np.zeros(len(count) + 1, np.int64)
    np.cumsum(runs, out=bounds[1:])
    out = np.zeros(bounds[-1], np.uint64)
    h = words.hashes
    long = np.repeat(count >= k, runs)
    if len(h) >= k:
        rolled = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            rolled += mixed(h[i : len(h) - k + 1 + i] + _STEPS[i]) * _STEPS[i]
        begin = np.repeat(words.first[:-1], runs) + np.arange(bounds[-1]) - np.repeat(bounds[:-1], runs)
        out[long] = mixed(rolled[begin[long]])
    for i in np.flatnonzero((count > 0) & (count < k)):
        own = h[words.first[i] : words.first[i + 1]]
        whole = mixed(own + _STEPS[: len(own)]) * _STEPS[: len(own)]
        out[bounds[i]] = mixed(whole.sum(dtype=np.uint64, keepdims=True) ^ np.uint64(0xA5A5A5A5A5A5A5A5 + len(own)))[0]
    return out, bounds
