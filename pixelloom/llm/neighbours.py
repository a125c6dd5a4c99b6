"""Near-duplicate vectors by Euclidean p-stable hashing with exact cosine checks.

Vectors are normalised and projected on Gaussian directions; each projection is
quantised with a random offset and one width, and the cells of one table's
directions are the bucket of that table. On unit vectors cosine >= c is distance
<= r = sqrt(2 - 2c), at which two projections share a cell with a known
probability, as they do at the distance sqrt(2) of unrelated vectors.

`layout` takes width, directions per table and tables from both and from the
number of vectors: unrelated vectors bring RIVALS others per bucket at any
number of vectors, and a pair just at the threshold is missed by all tables with
probability MISS, a nearer one more rarely. What meets in a bucket is compared by its cosine in
double precision. The first table in which a pair meets counts it, so no pair
counts twice and no pairs need to be shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import mixed, saved
from pixelloom.llm.components import components

MISS = 1e-4
RIVALS = 0.25
WIDTHS = (0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0)
MOST_TABLES = 256  # beyond it, tables take fewer directions: more is compared, nothing more is missed
BLOCK = 512


def same_cell(distance: float, width: float) -> float:
    """Probability that a Gaussian projection puts two points of this distance into one cell."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def layout(rows: int, threshold: float) -> tuple[float, int, int]:
    """(width, directions per table, tables) for so many vectors of one label, by the fewest tables."""
    near = max(1e-3, math.sqrt(2 - 2 * threshold))

    def tables(width: float, directions: int) -> int:
        return math.ceil(math.log(MISS) / math.log1p(-min(same_cell(near, width) ** directions, 1 - 1e-9)))

    found = []
    for width in WIDTHS:
        directions = max(1, math.ceil(math.log(max(rows, 2) / RIVALS) / -math.log(same_cell(math.sqrt(2), width))))
        while directions > 1 and tables(width, directions) > MOST_TABLES:
            directions -= 1
        rivals = rows * same_cell(math.sqrt(2), width) ** directions
        found.append((max(rivals, RIVALS), tables(width, directions), width, directions))
    _, most, width, directions = min(found)
    return width, directions, most


class Projections:
    """Directions and offsets of all tables for one dimension."""

    def __init__(self, dim: int, seed: int, width: float, directions: int, tables: int):
        rng = np.random.default_rng([seed, dim])
        self.width, self.directions, self.tables = width, directions, tables
        self.basis = rng.standard_normal((dim, tables * directions))
        self.offset = rng.uniform(0, width, tables * directions)

    def keys(self, v: np.ndarray) -> np.ndarray:
        """The bucket of every row in every table: (rows, tables)."""
        cells = np.floor((v @ self.basis + self.offset) / self.width).astype(np.int64).view(np.uint64)
        cells = cells.reshape(len(v), self.tables, self.directions)
        h = np.broadcast_to(np.arange(1, self.tables + 1, dtype=np.uint64), cells.shape[:2])
        for i in range(self.directions):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, i])
        return h.view(np.int64)


def unit(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and which rows have a direction."""
    v = values.astype(np.float64)
    good = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
    top = np.where(good, np.abs(np.where(np.isfinite(v), v, 0)).max(axis=1, initial=0), 1.0)
    v = np.where(good[:, None], v / np.maximum(top, 5e-324)[:, None], 0)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300), good


def near_vectors(
    vectors: DataFrame, threshold: float = 0.98, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors.

    Rows link when their labels are equal and not null, their lengths are equal
    and their cosine (double precision) is at least the threshold. Vectors that
    are null, empty, zero or hold null or non-finite components, and rows
    without id, link with nothing. n_links counts the other rows linked directly;
    component_id is the smallest id reachable (the row's own id when alone);
    kept says whether it is the row's own. Repeated rows are rows of their own
    and link with each other; a vec_id on several vectors does not join them.
    Of the pairs just at the threshold the tables miss one in 10,000 on average
    (MISS), of nearer ones fewer; none below it is linked. An empty table gives an empty table; other columns
    are ignored. The threshold must be above 0.5 and at most 1.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("threshold must be above 0.5 and at most 1")
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"), F.col(label_col).cast("string").alias("label")
    )
    # equal vectors are one point with a count and a number of its own
    point = saved(
        rows.filter("vec_id is not null and label is not null and size(v) > 0").groupBy("label", "v").agg(
            F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")
        ).withColumn("point", F.monotonically_increasing_id()),
        "points",
    )
    largest = point.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    drawn = (seed, *layout(largest, threshold))

    def place(batches):
        known: dict[int, Projections] = {}
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                sizes = part.column("v").value_lengths().to_numpy(zero_copy_only=False)
                for dim in np.unique(sizes):
                    own = part.filter(pa.array(sizes == dim))
                    values = own.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
                    v, good = unit(values)
                    own, v = own.filter(pa.array(good)), v[good]
                    if len(v):
                        if int(dim) not in known:
                            known[int(dim)] = Projections(int(dim), *drawn)
                        keys = known[int(dim)].keys(v)
                        ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * keys.shape[1])
                        keys = pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1)))
                        yield pa.RecordBatch.from_arrays(
                            [own.column("point"), own.column("label"), pa.array(np.full(len(v), dim, np.int32)), keys, own.column("copies"), own.column("v")],
                            names=["point", "label", "dim", "keys", "copies", "v"],
                        )

    kind = point.schema["v"].dataType.simpleString()
    placed = saved(
        point.select("point", "label", "copies", "v").mapInArrow(
            place, f"point long, label string, dim int, keys array<long>, copies long, v {kind}"
        ),
        "keys",
    )
    bucket = ["label", "dim", "tab", "key"]
    met = placed.select("point", "label", "dim", F.posexplode("keys").alias("tab", "key"))
    counts = met.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = met.join(counts, bucket)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    cells = met.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("n", "blocks", "other")
    keys = [*bucket, "i", "j"]
    # the vectors come last: one shuffle carries them, for rows of buckets with others only
    cells = cells.join(placed.select("point", "keys", "copies", "v"), "point")
    dealt = cells.repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches):
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            marks = _changes(held, keys)
            if len(marks):
                done, held = held.slice(0, marks[-1]), held.slice(marks[-1])
                yield from _cells(done.combine_chunks(), marks[:-1], threshold)
        if held is not None and held.num_rows:
            yield from _cells(held.combine_chunks(), _changes(held, keys), threshold)

    found = saved(dealt.mapInArrow(compare, "kind int, a long, b long"), "links")
    # kind 0: point a gets b links from this cell; kind 1: an edge a - b of the cell's spanning forest
    linked = found.filter("kind = 0").groupBy(F.col("a").alias("point")).agg(F.sum("b").alias("others"))
    joined = components(found.filter("kind = 1").select("a", "b")).withColumnRenamed("node", "point")
    least = joined.join(point.select("point", "vec_id"), "point").groupBy("component").agg(F.min("vec_id").alias("least"))
    pointed = point.join(linked, "point", "left").join(joined.join(least, "component"), "point", "left").select(
        "label", "v", "copies", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("least", "vec_id").alias("component")
    )
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    out = rows.join(pointed, ["label", "v"], "left")
    links = F.when(F.col("vec_id").isNotNull() & sound, F.coalesce(F.col("copies") - 1 + F.col("others"), F.lit(0))).otherwise(0)
    component = F.when(links > 0, F.col("component")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id", links.cast("long").alias("n_links"), component.alias("component_id")
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    changed = np.zeros(max(0, table.num_rows - 1), bool)
    for c in keys:
        column = table.column(c)
        values = column.combine_chunks().dictionary_encode().indices.to_numpy() if pa.types.is_string(column.type) else column.to_numpy()
        changed |= values[1:] != values[:-1]
    return np.flatnonzero(changed) + 1


def _cells(table: pa.Table, marks: np.ndarray, threshold: float):
    dims, tabs, blocks, points, copies, i, j = (
        table.column(c).to_numpy() for c in ("dim", "tab", "block", "point", "copies", "i", "j")
    )
    edges = [0, *marks.tolist(), table.num_rows]
    counted: list[np.ndarray] = []
    forest: list[np.ndarray] = []
    vectors, keys = table.column("v").combine_chunks(), table.column("keys").combine_chunks()
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a < 2:
            continue
        v, _ = unit(vectors.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, int(dims[a])))
        close = v @ v.T >= threshold
        if i[a] != j[a]:
            close &= blocks[a:b][:, None] != blocks[a:b][None, :]
        np.fill_diagonal(close, False)
        if not close.any():
            continue
        close &= ~_met_before(keys.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)[:, : tabs[a]])
        total = close @ copies[a:b]
        hit = np.flatnonzero(total)
        if len(hit):
            counted.append(np.column_stack([np.zeros(len(hit), np.int64), points[a:b][hit], total[hit]]))
            forest.append(_forest(close, points[a:b]))
    if counted:
        out = np.concatenate(counted + forest)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[:, 0].astype(np.int32)), pa.array(out[:, 1]), pa.array(out[:, 2])], names=["kind", "a", "b"]
        )


def _met_before(keys: np.ndarray) -> np.ndarray:
    """Which pairs of rows share a bucket of these (earlier) tables."""
    _, codes, often = np.unique(keys, return_inverse=True, return_counts=True)
    codes = codes.reshape(keys.shape)
    column = np.cumsum(often > 1) - 1
    row, tab = np.nonzero((often > 1)[codes])
    shared = np.zeros((len(keys), int((often > 1).sum())), np.float32)
    shared[row, column[codes[row, tab]]] = 1
    return shared @ shared.T > 0


def _forest(close: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Edges (1, a, b) that join what the matrix joins, at most one per vector."""
    n, seen, out = len(ids), np.zeros(len(ids), bool), []
    for s in range(n):
        if seen[s]:
            continue
        seen[s] = True
        stack = [s]
        while stack:
            x = stack.pop()
            new = np.flatnonzero(close[x] & ~seen)
            seen[new] = True
            out.extend((1, int(ids[x]), int(ids[y])) for y in new)
            stack.extend(new.tolist())
    return np.array(out, np.int64).reshape(-1, 3)
