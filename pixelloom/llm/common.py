"""Helpers shared by the corpus operators: work folders, samples, Arrow columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.session import checkpoint_dir, ship_package

# Texts are handled in pieces of about this many bytes, so a task's memory does not follow its input.
PIECE_BYTES = 1 << 20
PIECE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/pixelloom/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to a new folder in the shared checkpoint folder and read back: cuts the lineage."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(key: str, modulus: int):
    """crc32 of the id written as text, modulo the number of folds."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, modulus: int, held: int
) -> tuple[list[tuple[str, int]], dict[int, float]]:
    """(text, label) of at most `rows` labelled documents outside the held-out fold, and the label shares.

    The ids are chosen among all labelled ones by a seeded hash, half of them of
    each label where there are enough, so the bound holds for every corpus size.
    The shares are those among all labelled documents outside the fold.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold("doc_id", modulus) != held)
    ).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    order = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    half = max(1, rows // 2)
    chosen = saved(
        known.filter("label = 1").orderBy(order, "doc_id").limit(half)
        .unionByName(known.filter("label = 0").orderBy(order, "doc_id").limit(half)),
        "sample",
    )
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values()) or 1
    # at most `rows` ids and labels are broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    got = texts.orderBy("doc_id").select("text", "label").toArrow()
    return (
        list(zip(got.column(0).to_pylist(), got.column(1).to_pylist())),
        {c: counts.get(c, 0) / total for c in (0, 1)},
    )


def arrow_texts(texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression (the last one is the intercept), by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.diag(np.append(np.full(x.shape[1] - 1, ridge), 1e-6)) * max(1.0, weight.sum()) / 100
    for _ in range(rounds):
        p = sigmoid(x @ w)
        slope = x.T @ (weight * (p - y)) + penalty @ w
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column without nulls and in one chunk."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a large_string array and the offsets of its texts (n + 1)."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(
    batch: pa.RecordBatch, text: str = "text", size: int = PIECE_BYTES, rows: int = PIECE_ROWS
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of a batch of about `size` bytes of text and `rows` rows at most, with bytes and offsets."""
    buf, at = raw(texts_of(batch.column(batch.schema.get_field_index(text))))
    first, n = 0, len(at) - 1
    while first < n:
        last = int(np.searchsorted(at, at[first] + size, "right")) - 1
        last = min(n, max(first + 1, last), first + rows)
        yield batch.slice(first, last - first), buf[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last
    pa.default_memory_pool().release_unused()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
