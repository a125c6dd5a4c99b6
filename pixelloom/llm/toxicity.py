"""Toxicity by compression distance: the shorter of two zstandard encodings wins.

Two dictionaries are trained, one on toxic and one on ordinary text. A
document is cut into windows of a few words, each window is compressed with
either dictionary, and the difference of the two lengths says which kind of
text it is like. A window threshold and a logistic calibration over the
windows of a document are fitted on the same bounded sample of labelled rows.

A dictionary holds the byte runs that its own texts have far more often than
the other's. Occurrences are counted once per pair of neighbouring words: what
comes back only inside copies of one passage counts once, what a writer used in
many places counts often. All windows begin with the same primer, which both
dictionaries hold: it gives every block one match, so a further match shortens
it at once instead of disappearing in an uncompressed block.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import arrow_texts, fold, labelled_sample, logistic, pieces, sigmoid
from pixelloom.llm.words import LOWER, SPACE

SAMPLE_ROWS = 3000
WINDOW_WORDS = 8
WINDOW_BYTES = 256
RUN_BYTES = 6  # shortest match of the compressor, and the unit of the contrast
PRIMER = b"\x01the primer of every window\x02"
LEAST_CONTEXTS = 6

_TO_SPACE = LOWER.copy()
_TO_SPACE[SPACE] = 32


@dataclass(frozen=True)
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    threshold: int
    weights: tuple[float, ...]
    prior: float | None  # the score of every text where one class has no sample


def _windows(buf: np.ndarray, at: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Primed windows of all texts, and the bounds of each text's windows (n + 1)."""
    flat = _TO_SPACE[buf]
    space = flat == 32
    before = np.ones(len(buf) + 1, bool)
    before[1:] = space
    before[at[1:-1]] = True
    starts = np.flatnonzero(~space & before[:-1])
    first = np.searchsorted(starts, at)
    raw = flat.tobytes()
    out: list[bytes] = []
    bounds = np.zeros(len(at), np.int64)
    for d in range(len(at) - 1):
        own = starts[first[d] : first[d + 1] : WINDOW_WORDS].tolist()
        own.append(int(at[d + 1]))
        for a, b in zip(own[:-1], own[1:]):
            if b - a <= WINDOW_BYTES:
                out.append(b"%b %b " % (PRIMER, raw[a:b]))
            else:  # very long words: pieces that overlap by two runs
                for c in range(a, b, WINDOW_BYTES - 2 * RUN_BYTES):
                    out.append(b"%b %b " % (PRIMER, raw[c : min(b, c + WINDOW_BYTES)]))
        bounds[d + 1] = len(out)
    return out, bounds


def _compressor(content: bytes, size: int) -> zstandard.ZstdCompressor:
    """Fast strategy, so literals stay whole bytes and lengths compare evenly; both dictionaries have one size."""
    log = max(13, (size + len(PRIMER) + 2 * WINDOW_BYTES).bit_length())
    params = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, strategy=zstandard.STRATEGY_FAST, target_length=1,
        min_match=RUN_BYTES, window_log=log, hash_log=log, chain_log=log, search_log=3,
        write_checksum=False, write_content_size=True, write_dict_id=False,
    )
    whole = content.rjust(size, b"\x00") + PRIMER
    dictionary = zstandard.ZstdCompressionDict(whole, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=dictionary)


class _Scorer:
    def __init__(self, toxic: bytes, ordinary: bytes):
        size = max(len(toxic), len(ordinary), 256)
        self.compressors = _compressor(ordinary, size), _compressor(toxic, size)

    def lengths(self, which: int, windows: list[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, windows), np.uint64, len(windows))
        ends = np.cumsum(sizes, dtype=np.uint64)
        spans = np.column_stack([ends - sizes, sizes]).astype(np.uint64)
        source = zstandard.BufferWithSegments(b"".join(windows), spans.tobytes())
        packed = self.compressors[which].multi_compress_to_buffer(source, threads=1)
        return np.fromiter(map(len, packed), np.int64, len(windows))

    def gains(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that the toxic dictionary saves per window, and the bounds of the texts."""
        windows, bounds = _windows(buf, at)
        if not windows:
            return np.zeros(0, np.int64), bounds
        return self.lengths(0, windows) - self.lengths(1, windows), bounds


def _features(gains: np.ndarray, bounds: np.ndarray, threshold: int) -> np.ndarray:
    """Per text: best window, windows over the threshold (as a log, and as a share), net saving."""
    n = len(bounds) - 1
    out = np.zeros((n, 4))
    count = np.diff(bounds)
    full = np.flatnonzero(count)
    if len(full):
        begin = bounds[:-1][full]
        over = np.add.reduceat((gains >= threshold).astype(np.int64), begin)
        out[full, 0] = np.maximum.reduceat(gains, begin).clip(-4, 12) / 4
        out[full, 1] = np.log1p(over)
        out[full, 2] = np.minimum(over / count[full] * 10, 3)
        out[full, 3] = np.clip(np.add.reduceat(gains, begin) / count[full], -3, 3)
    return out


def _contexts(texts: list[str]) -> tuple[Counter, Counter, int]:
    """Of each word and each byte run in it, the number of different neighbourhoods."""
    seen: set[int] = set()
    words: Counter = Counter()
    for text in texts:
        own = text.encode().lower().split()
        for i, word in enumerate(own):
            place = hash((own[i - 1] if i else b"", word, own[i + 1] if i + 1 < len(own) else b""))
            if place not in seen:
                seen.add(place)
                words[b" %b " % word] += 1
    runs: Counter = Counter()
    for word, n in words.items():
        for i in range(len(word) - RUN_BYTES + 2):
            runs[word[i : i + RUN_BYTES - 1]] += n
    return words, runs, max(1, len(seen))


def _content(own: tuple[Counter, Counter, int], other: tuple[Counter, Counter, int]) -> bytes:
    """The runs of one class that stand out against the other's, the most frequent last."""
    (words, runs, n), (_, theirs, m) = own, other
    picked = set()
    for run, count in runs.items():
        expected = theirs[run] * n / m
        if count >= LEAST_CONTEXTS and count >= 4 * (expected + 1) and count - expected > 3.5 * (count + expected) ** 0.5:
            picked.add(run)
    k = RUN_BYTES - 1
    found: Counter = Counter()
    for word, count in words.items():
        i = 0
        while i <= len(word) - k:
            if word[i : i + k] not in picked:
                i += 1
                continue
            j = i
            while word[j + 1 : j + 1 + k] in picked:
                j += 1
            found[word[i : j + k]] += count
            i = j + k
    chosen: list[bytes] = []
    for run, _ in sorted(found.items(), key=lambda x: (-x[1], x[0])):
        if not any(run in x for x in chosen):
            chosen.append(run)
    return b"".join(reversed(chosen))


def fit(sample: list[tuple[str, int]], shares: dict[int, float]) -> ToxicityModel:
    """Dictionaries, threshold and calibration from (text, 0 or 1) rows.

    Without rows of both labels every text gets the share of label 1 (0 when
    there are none) as its score.
    """
    label = np.array([y for _, y in sample], float)
    if not 0 < label.sum() < len(label):
        return ToxicityModel(b"", b"", 1, (), float(label.mean()) if len(label) else 0.0)
    own = _contexts([x for x, y in sample if y])
    other = _contexts([x for x, y in sample if not y])
    toxic, ordinary = _content(own, other), _content(other, own)
    scorer = _Scorer(toxic, ordinary)
    gains, bounds, done = [], [np.zeros(1, np.int64)], 0
    for _, buf, at in pieces(arrow_texts([x for x, _ in sample])):
        g, b = scorer.gains(buf, at)
        gains.append(g)
        bounds.append(b[1:] + done)
        done += len(g)
    all_gains, all_bounds = np.concatenate(gains), np.concatenate(bounds)
    plain = all_gains[np.repeat(label == 0, np.diff(all_bounds))]
    # the smallest saving that at most one ordinary window in a thousand has
    threshold = next((t for t in range(1, 13) if (plain >= t).mean() <= 1e-3), 13) if len(plain) else 1
    weight = np.where(label == 1, shares[1] / label.mean(), shares[0] / (1 - label.mean()))
    weights = logistic(_features(all_gains, all_bounds, threshold), label, weight)
    return ToxicityModel(toxic, ordinary, threshold, tuple(weights.tolist()), None)


def _scores(scorer: _Scorer, model: ToxicityModel, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, windows and windows over the threshold of each text."""
    gains, bounds = scorer.gains(buf, at)
    features = _features(gains, bounds, model.threshold)
    if model.prior is None:
        score = sigmoid(features @ np.array(model.weights[:-1]) + model.weights[-1])
    else:
        score = np.full(len(at) - 1, model.prior)
    over = np.concatenate([[0], np.cumsum(gains >= model.threshold)])[bounds]
    return score, np.diff(bounds), np.diff(over)


def score_texts(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, n_windows, n_over: one row per row of docs(doc_id, text); null texts are empty."""

    def run(batches):
        scorer = _Scorer(model.toxic, model.ordinary)
        for batch in batches:
            for part, buf, at in pieces(batch):
                score, windows, over = _scores(scorer, model, buf, at)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(score), pa.array(windows), pa.array(over)],
                    names=["doc_id", "score", "n_windows", "n_over"],
                )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, score double, n_windows long, n_over long")


def ordinary_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, modulus: int = 5, held: int = 0) -> DataFrame:
    """The rows of docs that toxicity() gives a score below 0.5, each by its own text, with all columns."""
    model = fit(*labelled_sample(docs, labels, "toxic", rows, modulus, held))

    def run(batches):
        scorer = _Scorer(model.toxic, model.ordinary)
        for batch in batches:
            for part, buf, at in pieces(batch):
                yield part.filter(pa.array(_scores(scorer, model, buf, at)[0] < 0.5))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, modulus: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, n_windows, n_over for every row of docs.

    Fits on at most `rows` labelled documents with crc32(doc_id) mod modulus <>
    held. Labels other than 0 and 1 and null ids are not learned from. Whole
    texts are scored; null and empty texts have no windows and get the score of
    that. Repeated rows stay repeated; other columns are ignored; a null doc_id
    has held_out null. Empty tables give empty results.
    """
    model = fit(*labelled_sample(docs, labels, "toxic", rows, modulus, held))
    return score_texts(docs, model).select(
        "doc_id", (fold("doc_id", modulus) == held).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_windows", "n_over",
    )
