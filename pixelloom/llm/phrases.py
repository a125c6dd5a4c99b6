"""Phrase collocations from sorted count streams.

Layout of an external n-gram estimation: only the longest phrase that starts at
each word is shipped, at most LONGEST words, and sorted in prefix order. All
occurrences of a shorter phrase then lie in one run of that stream, so one pass
counts every length. The resulting counts are kept as two streams, one in prefix
order and one in suffix order (words reversed); sorted merge-joins of a phrase's
parts with them give the counts left and right of each cut, and a part that is
as frequent as its phrase has an extension of equal count. No counts are hashed
by phrase.

What keeps it bounded:
* a word below the least count is in no candidate, so shipped phrases end before
  it; the words that reach it are told by a bitmap of 16 bits or more per word,
  up to FILTER_BITS in all (wrong hits cost rows, never results);
* ranges of the stream are cut by sampled quantiles, also inside a frequent
  word; the phrases at the ends of a range are summed across ranges;
* the CODES most frequent words are shipped as three bytes each (they only
  shorten the rows);
* a task holds one piece of texts or one Arrow batch of the stream.

Keys are `lang 00 word 00 word 00 ...` in bytes, a coded word being `FF hi lo`,
so that every prefix of whole words is a prefix of the bytes, sorts as one run
and is told apart exactly (FF is in no UTF-8 text).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.common import mixed, pieces, raw, saved, texts_of
from pixelloom.llm.words import LOWER, span_hashes

LONGEST = 5
FILTER_BITS = 1 << 27
BITMAP_BITS = 1 << 15  # of one row of Spark's bitmap aggregate
CODES = 254 * 254  # pairs of bytes 01 .. FE
TEXT_BYTES, TEXT_ROWS = 1 << 21, 1 << 13  # of a piece of texts
ROWS = 1 << 14  # phrases of an Arrow batch
SAMPLED_TEXTS, SAMPLED_KEYS, BOUND_BYTES = 1 << 13, 1 << 17, 64  # of the sample that cuts the ranges

STOP = np.zeros(256, bool)
STOP[list(b".,;:!?\n\x0b\x0c\r")] = True
BLANK = np.zeros(256, bool)
BLANK[list(b" \t")] = True
END = "\u0000"


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language.

    Texts are lower-cased (A-Z), split at `[.,;:!?\\x0A-\\x0D]` and then into
    words `[^\\x20\\x09]+`. Per language (null: `und`), n counts the words, a the
    occurrences of a phrase of 2 to `longest` words within its pieces, overlaps
    included; phrases with a >= least are candidates. A cut after k words has
    l and r, the counts of both parts, and the score floor(1000 a n / (l r));
    the lowest-scoring cut holds, the one after fewer words among equal ones.
    A candidate inside a longer candidate of the same count is dropped. Rank
    goes by score and a (descending), then by the phrase in UTF-8 byte order.

    Counts are exact; arithmetic is in decimals of 38 digits. Null and empty
    texts have no words. Repeated rows count again; other columns, ids among
    them, are ignored. An empty table gives an empty table.
    """
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"longest must be 2 .. {LONGEST}")
    counts, totals = phrase_counts(docs, least, longest)
    return _ranked(_scored(counts), totals, top)


def phrase_counts(docs: DataFrame, least: int, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(key, f) of every phrase of 1 to `longest` words with f >= least, and (lang, n)."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    words = texts.mapInArrow(_words, "key binary, hash long, f long").groupBy("key", "hash").agg(F.sum("f").alias("f"))
    words = saved(words, "words")
    totals = words.groupBy(_parts()[0].alias("lang")).agg(F.sum("f").alias("n"))
    frequent = words.filter(F.col("f") >= least)
    shared = docs.sparkSession.sparkContext.broadcast((_bitmap(frequent), _coded(frequent)))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.sparkSession.sparkContext.broadcast(_bounds(texts, shared, longest, partitions))
    # one step: two would hold two Python workers a core
    placed = texts.mapInArrow(_placed_starts(shared, longest, bounds), "range int, key binary, f long")
    ordered = placed.repartitionById(partitions, "range").drop("range").sortWithinPartitions("key")
    found = ordered.mapInArrow(_runs(shared, least, longest), "key binary, f long")
    longer = found.groupBy("key").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return saved(frequent.select("key", "f").unionByName(longer), "counts"), totals


def _bounds(texts: DataFrame, shared, longest: int, partitions: int) -> np.ndarray:
    """Quantiles of the stream's keys (their first bytes), from the phrases of some texts.

    They only cut the stream into ranges of like size: every key goes to one range,
    in key order, whatever the sample. A range partitioner would make the whole
    stream a second time for them.
    """
    share = min(1.0, SAMPLED_TEXTS / max(1, texts.count()))
    some = texts if share == 1.0 else texts.sample(share, seed=1)
    keys = some.mapInArrow(_starts(shared, longest), "key binary, f long").select(F.substring("key", 1, BOUND_BYTES).alias("key"))
    some_keys = keys.filter(F.pmod(F.xxhash64("key", F.monotonically_increasing_id()), F.lit(64)) == 0)
    kept = some_keys.limit(SAMPLED_KEYS).collect()
    ordered = np.sort(np.array([bytes(r[0]) for r in kept], f"S{BOUND_BYTES}"))
    return ordered[np.arange(1, partitions) * len(ordered) // partitions] if len(ordered) else ordered


def _placed(bounds):
    """The range of each key; equal first bytes share one, so ranges follow each other in key order."""

    def run(batches):
        place = np.arange(BOUND_BYTES)
        for batch in batches:
            data, offsets = raw_bytes(batch.column(0).cast(pa.large_binary()))
            head = np.zeros((batch.num_rows, BOUND_BYTES), np.uint8)
            inside = place < np.diff(offsets)[:, None]
            head[inside] = data[(offsets[:-1, None] + place)[inside]]
            at = np.searchsorted(bounds.value, head.view(f"S{BOUND_BYTES}")[:, 0], "right")
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *batch.columns], names=["range", "key", "f"])

    return run


def _placed_starts(shared, longest: int, bounds):
    """The phrases of `_starts` with their ranges."""
    starts, placed = _starts(shared, longest), _placed(bounds)
    return lambda batches: placed(starts(batches))


def _parts(key: str = "key") -> Column:
    """The language and the words of a key, still escaped."""
    split = F.split(F.decode(F.col(key), "UTF-8"), END)
    return F.slice(split, 1, F.size(split) - 1)


def _scored(counts: DataFrame) -> DataFrame:
    """phrase words, a, l, r of the kept candidates; the lowest cut by exact comparison of l * r."""
    parts = counts.select("f", _parts().alias("parts")).select(
        "f", F.col("parts")[0].alias("lang"), F.slice("parts", 2, LONGEST).alias("words")
    )
    # the two count streams; a phrase is found in one by its first words, in the other by its last
    prefix = parts.select("lang", F.array_join("words", END).alias("front"), F.col("f").alias("l"))
    suffix = parts.select("lang", F.array_join(F.reverse("words"), END).alias("back"), F.col("f").alias("r"))
    cuts = parts.filter(F.size("words") > 1).select(
        "lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    )
    size = F.size("words")
    cuts = cuts.withColumn("front", F.array_join(F.slice("words", F.lit(1), F.col("k")), END)).withColumn(
        "back", F.array_join(F.reverse(F.slice("words", F.col("k") + 1, size - F.col("k"))), END)
    )
    cuts = cuts.join(prefix.hint("merge"), ["lang", "front"]).join(suffix.hint("merge"), ["lang", "back"])
    cuts = saved(cuts.select("lang", "words", "a", "k", "l", "r"), "cuts")
    # one word shorter and of the same count: the longer phrase is its extension
    first = cuts.filter((F.col("k") == size - 1) & (F.col("l") == F.col("a"))).select("lang", F.slice("words", F.lit(1), size - 1).alias("words"))
    last = cuts.filter((F.col("k") == 1) & (F.col("r") == F.col("a"))).select("lang", F.slice("words", F.lit(2), size - 1).alias("words"))
    extended = first.unionByName(last).filter(size > 1)
    kept = cuts.join(extended.hint("merge"), ["lang", "words"], "left_anti")
    return kept


def _ranked(cuts: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    scored = cuts.join(totals, "lang").withColumn(
        "score", F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    )
    lowest = F.min(F.struct("score", "k", "l", "r"))
    best = scored.groupBy("lang", "words", "a", "n").agg(lowest.alias("cut"))
    plain = F.transform("words", _unescaped)
    rows = best.select(
        _unescaped(F.col("lang")).alias("lang"), F.array_join(plain, " ").alias("phrase"), "a", F.col("cut.l").alias("l"),
        F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # Spark keeps the first `top` of a language in each task before the window's shuffle
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


def _unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\u0001\u0001"), F.lit(END)), F.lit("\u0001\u0002"), F.lit("\u0001"))


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """Bits of the hashes of the given words, built on the executors from rows of BITMAP_BITS."""
    n = frequent.count()
    bits = BITMAP_BITS
    while bits < min(16 * n, FILTER_BITS):
        bits *= 2
    slot = F.col("hash").bitwiseAND(F.lit(bits - 1))
    rows = frequent.groupBy(F.shiftright(slot, 15).cast("int").alias("at")).agg(
        F.bitmap_construct_agg(slot.bitwiseAND(F.lit(BITMAP_BITS - 1))).alias("bits")
    )
    out = np.zeros(bits // 8, np.uint8)
    for at, part in rows.collect():  # FILTER_BITS / 8 bytes at most
        out[at * BITMAP_BITS // 8 : (at + 1) * BITMAP_BITS // 8] = np.frombuffer(bytes(part), np.uint8)
    return out


def _coded(frequent: DataFrame) -> list[bytes]:
    """Keys of the most frequent words, CODES at most; the place in the list is the code."""
    n = frequent.count()
    if n > CODES:
        cut = frequent.agg(F.percentile_approx("f", 1 - CODES / n, 10_000)).first()[0]
        frequent = frequent.filter(F.col("f") > cut)
    return sorted(bytes(r[0]) for r in frequent.select("key").limit(CODES).collect())


def _code(i: int) -> bytes:
    return bytes((255, 1 + i // 254, 1 + i % 254))


def gathered(data: np.ndarray, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans data[low : low + size] one after the other, and their offsets."""
    offsets = np.zeros(len(low) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    return data[np.arange(offsets[-1]) + np.repeat(low - offsets[:-1], size)], offsets


class Tokens:
    """The words of a piece of texts: exact ids by language, and which words follow each other."""

    def __init__(self, langs: pa.Array, buf: np.ndarray, at: np.ndarray):
        lower = LOWER[buf]
        stop = STOP[lower]
        word = ~(stop | BLANK[lower])
        before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        inner = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(buf))]
        before[inner], after[inner - 1] = False, False  # a text begins here
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        doc = np.searchsorted(at, starts, "right") - 1
        piece = np.cumsum(stop, dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int64)
        self.n = len(starts)
        size = ends - starts + 1
        self.offsets = np.zeros(self.n + 1, np.int64)
        np.cumsum(size, out=self.offsets[1:])
        # every word followed by a zero byte
        self.data = np.zeros(self.offsets[-1], np.uint8)
        filled = np.ones(len(self.data), bool)
        filled[self.offsets[1:] - 1] = False
        self.data[filled] = lower[word]
        self.joined = np.zeros(self.n, bool)  # the next word follows in the same piece
        if self.n > 1:
            self.joined[:-1] = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
        coded = langs.dictionary_encode()
        self.langs = [x.encode() + b"\0" for x in coded.dictionary.to_pylist()]
        self.lang = coded.indices.to_numpy()[doc].astype(np.int64)
        shared = _binary(self.data, self.offsets).dictionary_encode()
        self.words = shared.dictionary
        # one id per language and word, compared by their bytes
        self.ids = self.lang * len(self.words) + shared.indices.to_numpy()
        self.span = len(self.langs) * len(self.words)

    def word_keys(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = raw_bytes(self.words.take(pa.array(ids % max(1, len(self.words)))))
        return self._keyed(data, offsets[:-1], np.diff(offsets), ids // max(1, len(self.words)))

    def respell(self, own: np.ndarray, spelled: list[bytes]) -> None:
        """Write every word as the spelling of its id's index."""
        size = np.array([len(x) for x in spelled], np.int64)
        data = np.frombuffer(b"".join(spelled), np.uint8)
        self.data, self.offsets = gathered(data, (np.cumsum(size) - size)[own], size[own])

    def phrase_keys(self, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = self.offsets[first]
        return self._keyed(self.data, low, self.offsets[first + length] - low, self.lang[first])

    def _keyed(self, data, low, size, lang) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the language and the span of each row."""
        head = np.array([len(x) for x in self.langs], np.int64)[lang] if len(lang) else np.zeros(0, np.int64)
        spans, _ = gathered(data, low, size)
        offsets = np.zeros(len(low) + 1, np.int64)
        np.cumsum(head + size, out=offsets[1:])
        out = np.empty(offsets[-1], np.uint8)
        inside = np.ones(len(out), bool)
        for i, name in enumerate(self.langs):
            at = offsets[:-1][lang == i][:, None] + np.arange(len(name))
            out[at], inside[at] = np.frombuffer(name, np.uint8), False
        out[inside] = spans
        return out, offsets


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def _tokens(batches):
    for batch in batches:
        langs, texts = batch.column(0).cast(pa.string()), texts_of(batch.column(1))
        low, _ = raw(texts)
        if (low < 2).any():  # bytes that separate words in keys are escaped
            texts = _escaped(texts)
        names, _ = raw(texts_of(langs))
        if (names < 2).any():
            langs = _escaped(langs)
        plain = pa.RecordBatch.from_arrays([langs, texts], names=["lang", "text"])
        for part, buf, at in pieces(plain, size=TEXT_BYTES, rows=TEXT_ROWS):
            yield Tokens(part.column(0), buf, at)


def _escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(texts, "\u0001", "\u0001\u0002"), END, "\u0001\u0001")


def _hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return mixed(span_hashes(data, offsets[:-1], offsets[1:])).view(np.int64)


def _words(batches):
    """Counts of the words of each piece."""
    for tokens in _tokens(batches):
        ids, own = _dense(tokens.ids, tokens.span)
        count = np.bincount(own, minlength=len(ids))
        data, offsets = tokens.word_keys(ids)
        yield pa.RecordBatch.from_arrays(
            [_binary(data, offsets).cast(pa.binary()), pa.array(_hashes(data, offsets)), pa.array(count.astype(np.int64))],
            names=["key", "hash", "f"],
        )


def _starts(shared, longest: int):
    """The longest phrase of frequent words from each word on, if it has two, counted in each piece."""

    def run(batches):
        bitmap, words = shared.value
        codes = {key: _code(i) for i, key in enumerate(words)}
        for tokens in _tokens(batches):
            ids, own = _dense(tokens.ids, tokens.span)
            data, offsets = tokens.word_keys(ids)
            slot = _hashes(data, offsets) & (len(bitmap) * 8 - 1)
            frequent = (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)[own]
            reach = frequent.astype(np.int64)
            follows = tokens.joined.astype(np.int64)
            for _ in range(longest - 1):
                reach[:-1] = frequent[:-1] * (1 + follows[:-1] * reach[1:])
            reach = np.minimum(reach, longest)
            first = np.flatnonzero(reach > 1)
            first, count = _distinct(own, first, reach[first])
            keys = _binary(data, offsets).to_pylist()
            tokens.respell(own, [codes.get(key) or key[key.index(0) + 1 :] for key in keys])
            for i in range(0, len(first), ROWS):
                part = first[i : i + ROWS]
                names = _binary(*tokens.phrase_keys(part, reach[part])).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([names, pa.array(count[i : i + ROWS])], names=["key", "f"])

    return run


def _distinct(ids: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One start of each different phrase and its count; phrases are compared by their word ids."""
    if not len(first):
        return first, np.zeros(0, np.int64)
    base = int(ids.max()) + 2
    if base * len(first) >= 1 << 62:
        raise ValueError("too many words in one text")
    key, span = np.zeros(len(first), np.int64), 1
    for i in range(int(length.max())):
        if span * base >= 1 << 62:  # as many words in one number as fit
            found, key = np.unique(key, return_inverse=True)
            span = len(found)
        key = key * base + np.where(length > i, ids[np.minimum(first + i, len(ids) - 1)] + 1, 0)
        span *= base
    _, at, count = np.unique(key, return_index=True, return_counts=True)
    return first[at], count.astype(np.int64)


def _dense(ids: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The different ids in order, and the index of each id among them."""
    if span > 8 * len(ids):
        return np.unique(ids, return_inverse=True)
    found = np.flatnonzero(np.bincount(ids, minlength=span))
    index = np.zeros(span, np.int64)
    index[found] = np.arange(len(found))
    return found, index[ids]


def _runs(shared, least: int, longest: int):
    """Counts of the phrases of 2 .. longest words from the sorted stream; partial ones at both ends of a range."""

    def run(batches):
        words_of_codes = shared.value[1]
        held = {m: None for m in range(2, longest + 1)}  # the run that is open at the end of a batch
        opened = {m: True for m in held}  # it is the first one of the range
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).cast(pa.large_binary())
            data, offsets = raw_bytes(keys)
            weight = batch.column(1).to_numpy()
            closes = data == 0
            closes[np.flatnonzero(data == 255) + 2] = True
            zeros = np.flatnonzero(closes)  # the last byte of each word
            before = np.searchsorted(zeros, offsets)
            words = np.diff(before) - 1
            for m in held:
                rows = np.flatnonzero(words >= m)
                if not len(rows):
                    continue
                ends = zeros[before[rows] + m] + 1
                starts = offsets[rows]
                mark = span_hashes(data, starts, ends)
                size = ends - starts
                heads = np.flatnonzero(np.concatenate([[True], (mark[1:] != mark[:-1]) | (size[1:] != size[:-1])]))
                sums = np.add.reduceat(weight[rows], heads)
                names = [bytes(data[starts[i] : ends[i]]) for i in heads[_reported(sums, least)]]
                shown = sums[_reported(sums, least)]
                yield from _closed(names, shown, held, opened, m, least, words_of_codes)
        last = [(name, f) for x in held.values() if x for name, f in [x]]
        yield _pairs(last, words_of_codes)

    return run


def _reported(sums: np.ndarray, least: int) -> np.ndarray:
    """The first and the last run of a batch, and those that reach the least count."""
    own = sums >= least
    own[[0, -1]] = True
    return np.flatnonzero(own)


def _closed(names: list[bytes], sums: np.ndarray, held: dict, opened: dict, m: int, least: int, words: list[bytes]):
    """Rows of the runs that end within the batch; the last one stays open."""
    sums = [int(x) for x in sums]
    out = []
    if held[m]:
        if held[m][0] == names[0]:
            sums[0] += held[m][1]
        else:
            out.append(held[m])
    out += list(zip(names[:-1], sums[:-1]))
    held[m] = (names[-1], sums[-1])
    kept = [(name, f) for i, (name, f) in enumerate(out) if f >= least or (opened[m] and i == 0)]
    if out:
        opened[m] = False
    if kept:
        yield _pairs(kept, words)


def _spelled(key: bytes, words: list[bytes]) -> bytes:
    """The key with its coded words written out."""
    head, *rest = key.split(b"\xff")
    out = [head]
    for part in rest:
        word = words[(part[0] - 1) * 254 + part[1] - 1]
        out += [word[word.index(0) + 1 :], part[2:]]
    return b"".join(out)


def _pairs(rows: list[tuple[bytes, int]], words: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([_spelled(k, words) for k, _ in rows], pa.binary()), pa.array([f for _, f in rows], pa.int64())], names=["key", "f"]
    )


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_binary array and its offsets (n + 1)."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8), at - at[0]
