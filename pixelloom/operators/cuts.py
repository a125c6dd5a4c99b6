"""Median cut of images of any size: splits and palette per image.

An image of up to CUT_COLORS pixels is cut from its histogram in one row. The
histogram of a larger one stays in parts of about that many colours: in rounds,
the parts count the colours of the open boxes by axis and value, the counts are
summed by Spark, and one row per image decides the next splits from at most
768 sums per box. No image is gathered, and both ways give the same cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.session import saved

# Colours of one image cut in one row.
CUT_COLORS = 1 << 16
# Images and colours cut at once.
CUT_IMAGES, CUT_ENTRIES = 512, 1 << 18
# A colour occurs at most 2^39 times per image in the packed histogram.
COUNT_BITS = 39

TREE = "image_id string, splits array<int>, colors array<int>"
STATE = (
    "image_id string, splits array<int>, weight array<long>, mean array<int>, "
    "axis array<int>, threshold array<int>, lower array<long>"
)


def list_offsets(lists: pa.ListArray):
    """List boundaries of a column, counted from its own first value."""
    offsets = lists.offsets.to_numpy()
    return offsets - offsets[0]


def bounded(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of at most CUT_IMAGES images and about CUT_ENTRIES list entries.

    A round of the cut holds 256 sums per image, so a full Arrow batch of small
    images would take far more memory than its rows.
    """
    for batch in batches:
        ends = list_offsets(batch.column(column))
        start = 0
        while start < batch.num_rows:
            fits = int(ends.searchsorted(ends[start] + CUT_ENTRIES, "right")) - 1 - start
            size = max(1, min(fits, CUT_IMAGES))
            yield batch.slice(start, size)
            start += size


def histogram_parts(pixels: DataFrame) -> DataFrame:
    """image_id, parts, part, hist: the packed (colour, count) of each image in parts of about CUT_COLORS colours."""
    rgb = (F.col("r").cast("long") * 256 + F.col("g")) * 256 + F.col("b")
    counted = pixels.select("image_id", "width", "height", rgb.alias("rgb")).groupBy("image_id", "width", "height", "rgb").agg(
        F.count(F.lit(1)).alias("n")
    )
    area = F.least(F.col("width").cast("long") * F.col("height"), F.lit(1 << 24))
    parts = F.ceil(area / CUT_COLORS).cast("int")
    entry = F.when(F.col("n") < 1 << COUNT_BITS, F.shiftleft(F.col("rgb"), COUNT_BITS).bitwiseOR(F.col("n"))).otherwise(
        F.raise_error(F.lit("a colour occurs too often")).cast("long")
    )
    return (
        counted.select("image_id", parts.alias("parts"), F.pmod(F.xxhash64("rgb"), parts).alias("part"), entry.alias("entry"))
        .groupBy("image_id", "parts", "part").agg(F.collect_list("entry").alias("hist"))
    )


def cut_trees(pixels: DataFrame, colors: int) -> DataFrame:
    """image_id, splits, colors: the median cut of every image as ``mediancut.paint`` takes it."""
    parts = histogram_parts(pixels)
    whole = parts.filter("parts = 1").select("image_id", "hist").mapInArrow(_cut_whole(colors), TREE)
    area = F.col("width").cast("long") * F.col("height")
    large = pixels.filter((F.col("x") == 0) & (F.col("y") == 0) & (area > CUT_COLORS))
    if large.isEmpty():
        return whole
    return whole.unionByName(_cut_parts(parts.filter("parts > 1"), colors))


def _entries(lists: pa.ListArray):
    packed = lists.flatten().to_numpy()
    return packed >> COUNT_BITS, packed & ((1 << COUNT_BITS) - 1)


def _cut_whole(colors: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pixelloom.functions.mediancut import cut

        for batch in bounded(batches, "hist"):
            if not batch.num_rows:
                continue
            rgb, weight = _entries(batch.column("hist"))
            _, _, splits, palette = cut(rgb, weight, list_offsets(batch.column("hist"))[:-1], colors)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("image_id"), pa.array(splits, pa.list_(pa.int32())),
                    pa.array([p[: len(s) + 1] for s, p in zip(splits, palette)], pa.list_(pa.int32())),
                ],
                ["image_id", "splits", "colors"],
            )

    return run


def _cut_parts(parts: DataFrame, colors: int) -> DataFrame:
    """The cuts of images in parts, in rounds; every round is written, so a lost executor repeats one round."""
    parts = saved(parts.select("image_id", "hist"), "histogram")
    ids = parts.select("image_id").distinct()
    state = saved(ids.mapInArrow(_begun, STATE), "cut")
    while True:
        open_ = F.exists("axis", lambda a: a == -2)
        if state.filter(open_).isEmpty():
            return state.select("image_id", "splits", F.col("mean").alias("colors"))
        asked = state.filter(open_).select("image_id", "splits", "axis")
        counts = parts.join(asked, "image_id").mapInArrow(_count_boxes, "image_id string, cell int, n long").groupBy(
            "image_id", "cell"
        ).agg(F.sum("n").alias("n"))
        summed = counts.groupBy("image_id").agg(F.collect_list("cell").alias("cells"), F.collect_list("n").alias("counts"))
        # one list per image of at most 768 sums for each of its boxes
        state = saved(state.join(summed, "image_id", "left").mapInArrow(_grown(colors), STATE), "cut")


def _rows(grown, ids) -> pa.RecordBatch:
    columns = [pa.array(ids, pa.string())]
    for name, kind in (("splits", pa.int32()), ("weight", pa.int64()), ("mean", pa.int32()), ("axis", pa.int32()), ("threshold", pa.int32()), ("lower", pa.int64())):
        columns.append(pa.array([getattr(g, name) for g in grown], pa.list_(kind)))
    return pa.RecordBatch.from_arrays(columns, ["image_id", "splits", "weight", "mean", "axis", "threshold", "lower"])


def _begun(batches):
    from pixelloom.functions.mediancut import Growing

    for batch in batches:
        yield _rows([Growing.start() for _ in range(batch.num_rows)], batch.column(0).to_pylist())


def _count_boxes(batches):
    """Counts of the open boxes of each part by axis and value."""
    import numpy as np

    from pixelloom.functions.mediancut import CELLS, OPEN, boxes_of, channels_of

    for batch in batches:
        for i in range(batch.num_rows):
            hist = batch.column("hist").slice(i, 1)
            rgb, weight = _entries(hist)
            splits = np.array(batch.column("splits")[i].as_py(), np.int64).reshape(1, -1)
            box = boxes_of(rgb, np.zeros(len(rgb), np.int64), splits)
            wanted = np.array(batch.column("axis")[i].as_py()) == OPEN
            rows = np.flatnonzero(wanted[box])
            cells = (box[rows] * CELLS + np.arange(3)[:, None] * 256 + channels_of(rgb[rows])).ravel()
            found, where = np.unique(cells, return_inverse=True)
            sums = np.zeros(len(found), np.int64)
            np.add.at(sums, where, np.tile(weight[rows], 3))
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column("image_id")[i].as_py()] * len(found), pa.string()), pa.array(found, pa.int32()), pa.array(sums)],
                ["image_id", "cell", "n"],
            )


def _grown(colors: int):
    def run(batches):
        import numpy as np

        from pixelloom.functions.mediancut import CELLS, Growing

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                image = Growing(*(row[c] for c in ("splits", "weight", "mean", "axis", "threshold", "lower")))
                if row["cells"]:
                    counts = np.zeros(len(image.axis) * CELLS, np.int64)
                    counts[row["cells"]] = row["counts"]
                    for box in image.open():
                        image.learn(box, counts[box * CELLS : (box + 1) * CELLS].reshape(3, 256))
                    image.grow(colors)
                out.append(image)
            yield _rows(out, batch.column("image_id").to_pylist())

    return run
