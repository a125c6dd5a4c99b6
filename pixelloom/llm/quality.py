"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + w.x + 1/2 sum_f((V_f.x)^2 - (V_f^2).(x^2))): the
sum-of-squares identity makes all pairwise interactions linear in the features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import arrow_texts, fold, labelled_sample, pieces, sigmoid
from pixelloom.llm.words import words_of

SAMPLE_ROWS = 6000
WORD_BUCKETS = 1024
RANK = 8
EPOCHS = 25
STRUCTURE = (
    "log_words", "log_bytes", "word_length", "distinct_words", "top_word", "repeated_pairs",
    "upper", "digit", "symbol", "mark", "high", "line_length", "short_lines", "bang", "bars", "no_text",
)

_CLASS = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "symbol": np.isin(np.arange(256), list(b"#$%&*+/<=>@[\\]^_`{}~")),
    "mark": np.isin(np.arange(256), list(b".,;:?'\"()-")),
    "high": np.arange(256) >= 128,
    "bang": np.arange(256) == 33,
    "bars": np.arange(256) == 124,
    "line": np.arange(256) == 10,
}


@dataclass(frozen=True)
class QualityModel:
    bias: float
    linear: np.ndarray
    factors: np.ndarray  # features x RANK
    center: np.ndarray
    scale: np.ndarray
    prior: float | None


def features(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One float32 row per text: WORD_BUCKETS hashed words (unit length), then STRUCTURE."""
    n = len(at) - 1
    words = words_of(buf, at)
    count = np.diff(words.first)
    bucket = (words.hashes >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS
    bag = np.bincount(words.doc * WORD_BUCKETS + bucket, minlength=n * WORD_BUCKETS).reshape(n, WORD_BUCKETS)
    out = np.zeros((n, WORD_BUCKETS + len(STRUCTURE)), np.float32)
    np.log1p(bag, out=out[:, :WORD_BUCKETS], casting="unsafe")
    out[:, :WORD_BUCKETS] /= np.maximum(np.linalg.norm(out[:, :WORD_BUCKETS], axis=1, keepdims=True), 1e-9)
    size = np.diff(at)
    s = dict.fromkeys(STRUCTURE)
    s["log_words"], s["log_bytes"] = np.log1p(count), np.log1p(size)
    length = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
    s["word_length"] = np.diff(length[words.first]) / np.maximum(count, 1)
    s["distinct_words"], s["top_word"], s["repeated_pairs"] = _repetition(words)
    totals = {k: np.diff(np.concatenate([[0], np.cumsum(v[buf])])[at]) for k, v in _CLASS.items()}
    for k in ("upper", "digit", "symbol", "mark", "high", "bang", "bars"):
        s[k] = totals[k] / np.maximum(size, 1)
    s["line_length"] = np.log1p(size / (totals["line"] + 1))
    s["short_lines"] = totals["line"] / np.maximum(count, 1)
    s["no_text"] = (count == 0).astype(float)
    out[:, WORD_BUCKETS:] = np.column_stack([s[k] for k in STRUCTURE])
    return out


def _repetition(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares: different words, the most frequent word, word pairs seen before in the text."""
    n = len(words.first) - 1
    distinct, top, pairs = np.ones(n), np.zeros(n), np.zeros(n)
    for d in range(n):
        own = words.hashes[words.first[d] : words.first[d + 1]]
        if not len(own):
            continue
        counts = np.diff(np.append(np.flatnonzero(np.append(True, np.diff(np.sort(own)) != 0)), len(own)))
        distinct[d], top[d] = len(counts) / len(own), counts.max() / len(own)
        if len(own) > 1:
            both = np.sort(own[1:] * np.uint64(3) + own[:-1])
            pairs[d] = (both[1:] == both[:-1]).sum() / (len(own) - 1)
    return distinct, top, pairs


def _raw_score(x: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray) -> np.ndarray:
    mixed = x @ factors
    return bias + x @ linear + 0.5 * ((mixed**2).sum(axis=1) - (x**2) @ (factors**2).sum(axis=1))


def fit(sample: list[tuple[str, int]], shares: dict[int, float], seed: int = 7) -> QualityModel:
    """Adam on the logistic loss, rows weighted to the label shares of all labelled documents.

    Without rows of both labels every text gets the share of label 1 (1 when
    there are none: nothing is rejected unlearned).
    """
    width = WORD_BUCKETS + len(STRUCTURE)
    y = np.array([label for _, label in sample], np.float32)
    if not 0 < y.sum() < len(y):
        prior = float(y.mean()) if len(y) else 1.0
        return QualityModel(0.0, np.zeros(width), np.zeros((width, RANK)), np.zeros(width), np.ones(width), prior)
    x = np.concatenate([features(buf, at) for _, buf, at in pieces(arrow_texts([t for t, _ in sample]))])
    center, scale = np.zeros(width, np.float32), np.ones(width, np.float32)
    center[WORD_BUCKETS:] = x[:, WORD_BUCKETS:].mean(axis=0)
    scale[WORD_BUCKETS:] = np.maximum(x[:, WORD_BUCKETS:].std(axis=0), 1e-3) * 2
    x = np.clip((x - center) / scale, -4, 4)
    weight = np.where(y == 1, shares[1] / y.mean(), shares[0] / (1 - y.mean())).astype(np.float32)
    rng = np.random.default_rng(seed)
    p = [np.zeros(1, np.float32), np.zeros(width, np.float32), rng.normal(0, 0.02, (width, RANK)).astype(np.float32)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    decay = np.full(width, 1e-3, np.float32)
    decay[WORD_BUCKETS:] = 1e-5
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        rate = 0.02 * (1 - epoch / EPOCHS) + 0.001
        for i in range(0, len(y), 128):
            b = order[i : i + 128]
            xb = x[b]
            mixed = xb @ p[2]
            raw = p[0] + xb @ p[1] + 0.5 * ((mixed**2).sum(axis=1) - (xb**2) @ (p[2] ** 2).sum(axis=1))
            g = (weight[b] * (sigmoid(raw) - y[b]) / len(b)).astype(np.float32)
            grads = [
                g.sum(keepdims=True),
                xb.T @ g + decay * p[1],
                xb.T @ (g[:, None] * mixed) - ((xb**2).T @ g)[:, None] * p[2] + decay[:, None] * p[2],
            ]
            step += 1
            for j in range(3):
                m[j] = 0.9 * m[j] + 0.1 * grads[j]
                v[j] = 0.999 * v[j] + 0.001 * grads[j] ** 2
                p[j] -= rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    return QualityModel(float(p[0][0]), p[1], p[2], center, scale, None)


def _scores(model: QualityModel, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    if model.prior is not None:
        return np.full(len(at) - 1, model.prior)
    x = np.clip((features(buf, at) - model.center) / model.scale, -4, 4)
    return sigmoid(_raw_score(x, model.bias, model.linear, model.factors).astype(float))


def score_texts(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score: one row per row of docs(doc_id, text); null texts are empty."""

    def run(batches):
        for batch in batches:
            for part, buf, at in pieces(batch):
                score = _scores(model, buf, at)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, score double")


def good_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, modulus: int = 4, held: int = 2) -> DataFrame:
    """The rows of docs that quality() gives a score of 0.7 or more, each by its own text, with all columns."""
    model = fit(*labelled_sample(docs, labels, "quality", rows, modulus, held))

    def run(batches):
        for batch in batches:
            for part, buf, at in pieces(batch):
                yield part.filter(pa.array(_scores(model, buf, at) >= 0.7))

    return docs.mapInArrow(run, docs.schema)


def quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7) for every row of docs.

    Metadata are the byte and word counts, taken from the text itself, so a
    wrong n_chars column does no harm. Fits on at most `rows` labelled documents
    with crc32(doc_id) mod modulus <> held; labels other than 0 and 1 and null
    ids are not learned from. Null and empty texts are scored as texts without
    words. Repeated rows stay repeated; other columns are ignored; a null doc_id
    has held_out null. Empty tables give empty results.
    """
    model = fit(*labelled_sample(docs, labels, "quality", rows, modulus, held))
    return score_texts(docs, model).select(
        "doc_id", (fold("doc_id", modulus) == held).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
