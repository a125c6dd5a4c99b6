"""Byte-level BPE: ids of texts and back, from the rank file of a public tokenizer.

Two tiers. A minimal perfect hash over the vocabulary, looked up for all
different pre-tokens of a piece of text at once, resolves those that are
vocabulary entries as a whole. The others are merged one by one with a heap of
ranked pairs over linked bytes. Pre-tokens are cut by array operations on
character classes; the result is that of the published pattern.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import mixed, pieces
from pixelloom.llm.words import span_hashes

OTHER, LETTER, NUMBER, BLANK = range(4)
MEMORY = 500_000  # merged pre-tokens that a worker keeps (about 80 MB)

# The white space of the pattern, and the endings of its contractions.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary entries by rank; ranks must be 0 .. n-1 and hold all single bytes."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    entries: dict[int, bytes] = {int(rank): base64.b64decode(entry) for entry, rank in pairs}
    out = [entries.get(i) for i in range(len(entries))]
    if None in out or len(set(out)) != len(out) or not {bytes([b]) for b in range(256)} <= set(out):
        raise ValueError(f"{path}: ranks must number different entries from 0, with every byte among them")
    return out


@dataclass(frozen=True)
class PerfectHash:
    """Minimal: n keys fill n slots. A bucket's shift sends its keys to free slots."""

    shifts: np.ndarray  # per bucket; negative: the only key sits at slot -shift - 1
    ids: np.ndarray  # per slot
    keys: np.ndarray  # per slot, the 64-bit hash

    @staticmethod
    def place(keys: np.ndarray, shifts: np.ndarray, n: int) -> np.ndarray:
        moved = (mixed(keys + shifts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)
        return np.where(shifts < 0, -shifts - 1, moved)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        if len(np.unique(keys)) != n:
            raise ValueError("two entries share a hash")
        bucket = (keys % np.uint64(max(1, n // 3))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(max(1, n // 3) + 1))
        members = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        shifts, used, ids = np.zeros(len(members), np.int64), np.zeros(n, bool), np.zeros(n, np.int64)
        lone = []
        for b in sorted(range(len(members)), key=lambda i: -len(members[i])):
            own = members[b]
            if len(own) == 1:
                lone.append(b)
                continue
            tried = 0
            while len(own):
                tries = np.arange(tried, tried + 64)
                slots = np.stack([cls.place(np.full(64, k), tries, n) for k in keys[own]])
                apart = (np.diff(np.sort(slots, axis=0), axis=0) > 0).all(axis=0)
                good = np.flatnonzero(apart & ~used[slots].any(axis=0))
                if len(good):
                    shifts[b] = tries[good[0]]
                    used[slots[:, good[0]]] = True
                    ids[slots[:, good[0]]] = own
                    break
                tried += 64
        for b, slot in zip(lone, np.flatnonzero(~used)):
            shifts[b] = -slot - 1
            ids[slot] = members[b][0]
        return cls(shifts, ids, keys[ids])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The id of each key, or -1."""
        shift = self.shifts[(keys % np.uint64(len(self.shifts))).astype(np.int64)]
        slot = self.place(keys, shift, len(self.ids))
        return np.where(self.keys[slot] == keys, self.ids[slot], -1)


@dataclass(frozen=True)
class Vocabulary:
    entries: list[bytes]
    table: PerfectHash

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        entries = read_ranks(path)
        ends = np.cumsum([len(e) for e in entries])
        starts = ends - np.array([len(e) for e in entries])
        buf = np.frombuffer(b"".join(entries), np.uint8)
        return cls(entries, PerfectHash.build(span_hashes(buf, starts, ends)))


_classes: list[np.ndarray] = []


def character_classes() -> np.ndarray:
    """The class of every code point, built once per process from Unicode properties."""
    if not _classes:
        table = np.zeros(0x110000, np.uint8)
        points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
        text = "".join(map(chr, points))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, text):
                table[points[m.start()] : points[m.end() - 1] + 1] = kind
        table[0xD800:0xE000] = OTHER
        table[WHITE_SPACE] = BLANK
        _classes.append(table)
    return _classes[0]


def pretokens(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where pre-tokens start, and each text's first one (n + 1)."""
    lead = (buf & 0xC0) != 0x80
    place = np.flatnonzero(lead)
    if len(place) == len(buf):
        code = buf
    else:
        code = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(code)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    kind = character_classes()[code]
    text_start = np.zeros(n + 1, bool)
    text_start[np.concatenate([[0], np.cumsum(lead)])[at]] = True  # also the end of the last
    same_text = ~text_start[1:n]  # characters i and i + 1
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | ~same_text
    blank, space = kind == BLANK, code == 32
    # a space before other characters belongs to them; another last blank stands alone
    joins = same_text & space[:-1] & ~blank[1:]
    start[1:] &= ~joins
    start[:-1] |= same_text & blank[:-1] & ~blank[1:]
    mark = np.flatnonzero(start & (code == 39))
    for ending in (*SHORT_ENDINGS, *LONG_ENDINGS):
        if not len(mark):
            break
        size = len(ending)
        fits = mark[mark + size < n]
        for i, letter in enumerate(ending):
            fits = fits[(code[fits + 1 + i] == ord(letter)) & same_text[fits + i]]
        start[fits + 1] = False
        after = fits[fits + size + 1 < n] + size + 1
        start[after] |= kind[after] == LETTER
    starts = place[start]
    return starts, np.searchsorted(starts, at)


def merge(word: bytes, ranks: dict[bytes, int], first: list[int]) -> list[int]:
    """Join the neighbours of lowest rank, leftmost first, until none has a rank.

    first holds the rank of every two bytes (256 a + b), or -1.
    """
    n = len(word)
    bits = n.bit_length()
    low = (1 << bits) - 1
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    pair = [first[a << 8 | b] for a, b in zip(word, word[1:])]
    pair.append(-1)
    heap = [r << bits | i for i, r in enumerate(pair) if r >= 0]
    heapify(heap)
    rank = ranks.get
    while heap:
        top = heappop(heap)
        i = top & low
        if pair[i] != top >> bits:
            continue
        j = end[i]
        e = end[i] = end[j]
        pair[j] = -1
        if e < n:
            before[e] = i
            r = pair[i] = rank(word[i : end[e]], -1)
            if r >= 0:
                heappush(heap, r << bits | i)
        else:
            pair[i] = -1
        p = before[i]
        if p >= 0:
            r = pair[p] = rank(word[p:e], -1)
            if r >= 0:
                heappush(heap, r << bits | p)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


_merged: dict[int, dict[bytes, bytes]] = {}


class Encoder:
    """Merged pre-tokens stay in the worker process for its next tasks, MEMORY of them at most."""

    def __init__(self, vocabulary: Vocabulary):
        self.entries = vocabulary.entries
        self.table = vocabulary.table
        self.ranks = {e: i for i, e in enumerate(vocabulary.entries)}
        self.first = [self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.single = [np.int32(i).tobytes() for i in range(len(self.entries))]
        own = hash(tuple(vocabulary.entries))
        if own not in _merged:
            _merged.clear()
            _merged[own] = {}
        self.known = _merged[own]

    def encode(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the bounds of each text's ids (n + 1)."""
        starts, first = pretokens(buf, at)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        ends = np.append(starts[1:], len(buf))
        number, different = pd.factorize(span_hashes(buf, starts, ends).view(np.int64))
        example = np.zeros(len(different), np.int64)
        example[number[::-1]] = np.arange(len(number))[::-1]
        found = self.table.find(different.view(np.uint64))
        raw = buf.tobytes()
        lists: list[bytes] = []
        known, entries, single = self.known, self.entries, self.single
        for a, b, entry in zip(starts[example].tolist(), ends[example].tolist(), found.tolist()):
            word = raw[a:b]
            if entry >= 0 and entries[entry] == word:
                lists.append(single[entry])
                continue
            ids = known.get(word)
            if ids is None:
                ids = np.array(merge(word, self.ranks, self.first), np.int32).tobytes()
                if b - a <= 64:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[word] = ids
            lists.append(ids)
        size = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
        flat = np.frombuffer(b"".join(lists), np.int32)
        taken = ranges(np.cumsum(size) - size, size, number)
        bounds = np.concatenate([[0], np.cumsum(size[number])])[first]
        return flat[taken], bounds


def ranges(begin: np.ndarray, size: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Positions of the chosen spans (begin, size), one span after the other."""
    count = size[chosen]
    done = np.cumsum(count)
    total = int(done[-1]) if len(done) else 0
    return np.repeat(begin[chosen] - (done - count), count) + np.arange(total)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>: one row per row of docs(doc_id, text), as BPE without special tokens.

    path is a rank file that the driver reads; its entries (a vocabulary, so of
    fixed size) travel with the tasks. Null and empty texts have no ids. Repeated
    rows stay repeated; other columns are ignored; null doc_ids stay null.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    def run(batches):
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            for part, buf, at in pieces(batch):
                ids, bounds = encoder.encode(buf, at)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))],
                    names=["doc_id", "ids"],
                )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded binary: the bytes of the ids array; an id outside the vocabulary raises.

    Null arrays and null ids in them decode to nothing.
    """
    entries = read_ranks(path)
    size = np.array([len(e) for e in entries])
    shared = encoded.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(entries), np.uint8), np.cumsum(size) - size, size))

    def run(batches):
        data, begin, size = shared.value
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                lists = part.column(1)
                ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(count)), count)
                owner, ids = owner[ids >= 0], ids[ids >= 0]
                out = data[ranges(begin, size, ids)]
                bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, size[ids], len(count)).astype(np.int64))])
                decoded = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(count), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out.tobytes())]
                )
                yield pa.RecordBatch.from_arrays([part.column(0), lists, decoded.cast(pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
