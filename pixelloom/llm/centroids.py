"""Centroid clustering with scalar lookup tables.

A component is a small integer after scaling, so in a block of vectors each
dimension holds few different values. Blocks keep, per dimension, the values
that occur and one code per vector. A round tabulates the squared difference of
every dimension, occurring value and centroid, and the distances of a block are
table gathers and sums in NumPy.

A task never holds more than its block; a round brings k * dims sums per task to
a Spark aggregate and k * dims totals to the driver, whatever the row count.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import saved

BLOCK = 4096
# squared distances of vectors within this bound fit 64 bits for up to 64 dimensions
BOUND = 1 << 27
ENCODED = "vec_id array<long>, codes binary, found array<long>, counts array<int>"


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """vec_id long, embedding array<double>: the rows with exactly `dims` components, none null or non-finite."""
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return plain.filter((F.size("embedding") == dims) & finite)


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, seed: str = "1"
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per usable vector.

    A component x is the integer floor(scale * x). The first centroids are the k
    usable vectors with the least sha256 of `seed:vec_id`; each of `rounds`
    rounds assigns every vector to the nearest centroid (squared Euclidean
    distance, ties to the smaller number) and replaces a centroid that has
    vectors by floor(sum / count) of each component. Everything is exact in
    integers.

    Vectors that are null, of another length, or with null or non-finite
    components are left out. Repeated rows are vectors of their own; where a
    vec_id is repeated, its smaller vector comes first as a centroid. Rows
    without vec_id take part and are centroids only after all others. Fewer than
    k usable vectors give fewer centroids, none an empty table. Other columns
    are ignored. Integers beyond 2**27 raise an error, as their squares would
    not fit the sums.
    """
    spark = vectors.sparkSession
    kept = usable(vectors, dims)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(F.col("vec_id").isNull(), drawn, "embedding").limit(k).select("embedding").collect()
    centroids = [[int(np.floor(scale * x)) for x in row[0]] for row in first]
    blocks = saved(kept.mapInArrow(_encode(dims, scale), ENCODED), "blocks")
    for _ in range(rounds):
        sums = blocks.mapInArrow(_sums(dims, centroids), "cluster int, dim int, n long, total long").groupBy("cluster", "dim").agg(
            F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(20,0)")).alias("total")
        )
        for row in sums.collect():  # k * dims rows at most
            centroids[row["cluster"]][row["dim"]] = int(row["total"]) // row["n"]
    assigned = saved(blocks.mapInArrow(_assign(dims, centroids), "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)"))).collect()}
    total = sum(inertia.values())
    facts = [
        (i, inertia.get(i, 0), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)
    ]
    # one row per centroid
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _encode(dims: int, scale: float):
    """Vectors to blocks: per dimension the occurring integers and the code of each vector."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for first in range(0, batch.num_rows, BLOCK):
                part = batch.column(1).slice(first, BLOCK)
                ints = np.floor(scale * part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), dims))
                if len(part) and np.abs(ints).max(initial=0) > BOUND:
                    raise ValueError(f"a scaled component is beyond {BOUND}")
                ints = ints.astype(np.int64)
                found, codes = zip(*(np.unique(ints[:, d], return_inverse=True) for d in range(dims)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids.slice(first, BLOCK).to_pylist()], pa.list_(pa.int64())),
                        pa.array([np.stack(codes).astype(np.uint16).tobytes()], pa.binary()),
                        pa.array([np.concatenate(found)], pa.list_(pa.int64())),
                        pa.array([[len(v) for v in found]], pa.list_(pa.int32())),
                    ],
                    names=["vec_id", "codes", "found", "counts"],
                )

    return run


def _decoded(batches, dims: int):
    """(ids, codes (dims, n), occurring integers of each dimension) of every block."""
    for batch in batches:
        for i in range(batch.num_rows):
            counts = batch.column(3)[i].values.to_numpy()
            found = np.split(batch.column(2)[i].values.to_numpy(), np.cumsum(counts)[:-1])
            codes = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint16).reshape(dims, -1)
            yield batch.column(0)[i].values, codes, found


def distances(codes: np.ndarray, found: list[np.ndarray], centroids: np.ndarray) -> np.ndarray:
    """Squared distances (n, k): of each dimension one table (occurring integer, centroid), gathered by code."""
    out = np.zeros((codes.shape[1], len(centroids)), np.int64)
    for code, values, middle in zip(codes, found, centroids.T):
        out += ((values[:, None] - middle[None, :]) ** 2)[code]
    return out


def _nearest(codes, found, centroids):
    far = distances(codes, found, centroids)
    own = far.argmin(axis=1)  # the first of equal ones
    return own, far[np.arange(len(own)), own]


def _sums(dims: int, centroids: list[list[int]]):
    middles = np.array(centroids, np.int64).reshape(-1, dims)

    def run(batches):
        n, total = np.zeros(len(middles), np.int64), np.zeros((len(middles), dims), np.int64)
        for _, codes, found in _decoded(batches, dims):
            own, _ = _nearest(codes, found, middles)
            n += np.bincount(own, minlength=len(middles))
            for d in range(dims):
                # occurrences of each (centroid, integer), times the integer
                seen = np.bincount(own * len(found[d]) + codes[d], minlength=len(middles) * len(found[d]))
                total[:, d] += seen.reshape(len(middles), -1) @ found[d]
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(held, dims), pa.int32()), pa.array(np.tile(np.arange(dims), len(held)), pa.int32()),
                pa.array(np.repeat(n[held], dims)), pa.array(total[held].ravel()),
            ],
            names=["cluster", "dim", "n", "total"],
        )

    return run


def _assign(dims: int, centroids: list[list[int]]):
    middles = np.array(centroids, np.int64).reshape(-1, dims)

    def run(batches):
        for ids, codes, found in _decoded(batches, dims):
            own, far = _nearest(codes, found, middles)
            yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.int32()), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return run
