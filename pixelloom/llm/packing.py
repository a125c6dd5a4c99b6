"""Best-fit packing of documents into training sequences of several permitted lengths.

Items are packed in decreasing length into the open bin they fill best. When
none has room, the permitted capacity with the least cost per unit it can still
fill is opened; at the end every bin shrinks to the smallest capacity that holds
its contents. That is done with every permitted capacity as the largest to open,
and the cheapest result is kept, so the capacities are chosen jointly.

Documents longer than the largest capacity give full bins of their own and a
remainder. The remainders are dealt by a hash, equal rows in turn, into groups of
about GROUP, which are packed independently: the loss is a fraction of a bin per
group.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITIES = (2048, 4096, 8192, 16384, 32768)
OVERHEAD = 64  # cost of a sequence besides its capacity
GROUP = 4096


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: float = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Bin of each item, its place in the bin, and the final capacity of each bin.

    Every length must be between 1 and the largest capacity. Ties keep the
    given order.
    """
    caps = sorted(set(capacities))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    best = None
    for largest in caps:
        bins, filled = _fill(lengths, order, [c for c in caps if c <= largest], caps, overhead)
        final = [caps[bisect_left(caps, f)] for f in filled]
        cost = sum(c + overhead for c in final)
        if best is None or cost < best[0]:
            best = cost, bins, final
    if best is None:
        raise ValueError("no capacity is permitted")
    _, bins, final = best
    offset, used = [0] * len(lengths), [0] * len(final)
    for i in order:
        offset[i] = used[bins[i]]
        used[bins[i]] += lengths[i]
    return bins, offset, final


def _fill(lengths, order, preferred, caps, overhead):
    left = sum(lengths)
    bins, filled, room = [0] * len(lengths), [], []  # room: sorted (free, bin)
    for i in order:
        n = lengths[i]
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            fit = [c for c in preferred if c >= n] or [c for c in caps if c >= n][:1]
            if not fit or n < 1:
                raise ValueError(f"length {n} is outside 1 .. {caps[-1]}")
            free, b = min(fit, key=lambda c: ((c + overhead) / min(c, left), c)), len(filled)
            filled.append(0)
        bins[i] = b
        filled[b] += n
        left -= n
        if free > n:
            insort(room, (free - n, b))
    return bins, filled


def pack_documents(
    items: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: float = OVERHEAD, group: int = GROUP
) -> DataFrame:
    """doc_id, piece, start, length, bin_id, bin_offset, capacity: the pieces of every row of items(doc_id, length).

    piece numbers the parts of a row from 0, start is its first unit in the
    row. A bin holds at most `capacity` units, one of the capacities; pieces of
    a bin follow each other by bin_offset from 0. Rows with a null length or one
    below 1 take no room and are left out. Repeated rows are packed each for
    itself, a null doc_id like any other. An empty table gives an empty table;
    other columns are ignored.
    """
    caps = sorted(set(int(c) for c in capacities))
    if not caps or caps[0] < 1:
        raise ValueError("capacities must be positive")
    top = caps[-1]
    rows = items.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("length").cast("long").alias("length")).filter("length > 0")
    groups = max(1, -(-rows.count() // group))
    # equal rows are counted and numbered, so that they are dealt to all groups in turn
    alike = rows.groupBy("doc_id", "length").agg(F.count(F.lit(1)).alias("n"))
    first = alike.withColumn("first", F.explode(F.expr(f"sequence(0L, n - 1, {GROUP}L)")))
    copies = first.withColumn("copy", F.explode(F.expr(f"sequence(first, least(n, first + {GROUP}L) - 1)"))).select("doc_id", "length", "copy")
    part = F.pmod(F.pmod(F.xxhash64(F.lit("packing"), "doc_id", "length"), F.lit(groups)) + F.col("copy"), F.lit(groups))
    whole = F.expr(f"cast((length - 1) div {top} as int)")
    # whole pieces are bins of their own; the last piece of each row is packed
    filled = copies.filter(F.col("length") > top).withColumn("piece", F.explode(F.sequence(F.lit(0), whole - 1))).select(
        "doc_id", "piece", (F.col("piece").cast("long") * top).alias("start"), F.lit(top).cast("int").alias("length"),
        F.concat_ws("-", F.lit("whole"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.col("length").cast("string"), F.col("copy").cast("string"), F.col("piece").cast("string")).alias("bin_id"),
        F.lit(0).alias("bin_offset"), F.lit(top).cast("int").alias("capacity"),
    )
    cut = copies.select(
        part.alias("part"), "doc_id", whole.alias("piece"), (whole.cast("long") * top).alias("start"),
        (F.col("length") - whole.cast("long") * top).cast("int").alias("length"),
    )
    sorted_groups = cut.repartition("part").sortWithinPartitions("part", F.desc("length"), "doc_id", "piece")

    def run(batches):
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            part = held.column("part").to_numpy()
            marks = np.flatnonzero(part[1:] != part[:-1]) + 1
            if len(marks):
                yield from packed(held.slice(0, marks[-1]), marks[:-1])
                held = held.slice(marks[-1])
        if held is not None and held.num_rows:
            part = held.column("part").to_numpy()
            yield from packed(held, np.flatnonzero(part[1:] != part[:-1]) + 1)

    def packed(table, marks):
        edges = [0, *marks.tolist(), table.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            own = table.slice(a, b - a).combine_chunks()
            bins, offsets, final = pack(own.column("length").to_pylist(), caps, overhead)
            name = f"{own.column('part')[0].as_py()}-"
            yield pa.RecordBatch.from_arrays(
                [*(own.column(c).combine_chunks() for c in ("doc_id", "piece", "start", "length")), pa.array([name + str(x) for x in bins], pa.string()),
                 pa.array(offsets, pa.int32()), pa.array([final[x] for x in bins], pa.int32())],
                names=["doc_id", "piece", "start", "length", "bin_id", "bin_offset", "capacity"],
            )

    remainders = sorted_groups.mapInArrow(
        run, "doc_id long, piece int, start long, length int, bin_id string, bin_offset int, capacity int"
    )
    return remainders.unionByName(filled)


def text_lengths(docs: DataFrame) -> DataFrame:
    """items(doc_id, length) for byte-level sequences: UTF-8 bytes and one separator (null: none)."""
    size = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.select("doc_id", (size.cast("long") + 1).alias("length"))
