"""Frame sequences and sprite sheets: checks, packing, slicing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.columns import cells, channel, idiv
from pixelloom.functions.ranking import split_row_number
from pixelloom.model import NORMAL
from pixelloom.operators.strips import to_strips

# Frames of one sequence ranked in one task; a longer sequence is split into ranges.
RANGE_ROWS = 100_000


def check_frames(frames: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split sequences into equal-size ones and rejects with a reason.

    ``frames`` (seq_id, frame_no, image_id), ``images`` (image_id, width,
    height). A sequence is rejected when it is empty (a row without an image),
    a frame names an unknown image, or two frames differ in size. Aggregates
    only, so a hot sequence is combined map-side.
    """
    judged = _judge(frames, images, [])
    good = judged.filter(F.col("reason").isNull()).select("seq_id", "frames", "frame_w", "frame_h")
    return good, judged.filter(F.col("reason").isNotNull()).select("seq_id", "frames", "reason")


def _judge(frames: DataFrame, images: DataFrame, further: list[Column]) -> DataFrame:
    """One row per sequence: frame count and size, ``reason`` of a reject, further aggregates."""
    sized = frames.join(
        images.select("image_id", F.col("width").alias("fw"), F.col("height").alias("fh")),
        "image_id",
        "left",
    )
    facts = sized.groupBy("seq_id").agg(
        F.count("image_id").alias("frames"),
        F.count("fw").alias("known"),
        F.min("fw").alias("frame_w"),
        F.max("fw").alias("max_w"),
        F.min("fh").alias("frame_h"),
        F.max("fh").alias("max_h"),
        *further,
    )
    reason = (
        F.when(F.col("frames") == 0, "ValueError: empty frame sequence")
        .when(F.col("known") < F.col("frames"), "KeyError: unknown frame image")
        .when(
            (F.col("frame_w") != F.col("max_w")) | (F.col("frame_h") != F.col("max_h")),
            "ValueError: frames differ in size",
        )
    )
    return facts.withColumn("reason", reason)


def _extent(order: Column) -> list[Column]:
    """Aggregates that ``_number_frames`` needs per sequence."""
    return [F.count(F.lit(1)).alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi")]


def _number_frames(frames: DataFrame, extents: DataFrame, order: Column, range_rows: int) -> DataFrame:
    """Column ``pos`` for the frames of the sequences in ``extents``, whose columns are kept."""
    ranges = F.ceil(F.col("n") / F.lit(float(range_rows)))
    step = F.ceil((F.col("hi") - F.col("lo") + 1) / ranges).cast("long")
    ranged = frames.join(extents.withColumn("step", step).drop("n", "hi"), "seq_id").withColumn(
        "range_no", idiv(order - F.col("lo"), F.col("step"))
    )
    return split_row_number(
        ranged, "seq_id", ["range_no"], [order, "image_id"], ["range_no"], "pos"
    ).drop("lo", "step", "range_no")


def rank_frames(
    frames: DataFrame, order_column: str = "frame_no", range_rows: int = RANGE_ROWS
) -> DataFrame:
    """0-based position ``pos`` of each frame in its sequence, for sequences of any length.

    A window over the whole sequence would sort a hot one in one task. Each
    sequence is cut into equal ranges of the order column, as many as its length
    asks for (one for an ordinary sequence), and numbered range by range.
    """
    order = F.col(order_column).cast("long")
    extents = frames.groupBy("seq_id").agg(*_extent(order))
    return _number_frames(frames, extents, order, range_rows)


def pack_sheet(
    frames: DataFrame, pixels: DataFrame, order_column: str = "frame_no"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lay the frames of each sequence side by side, in order.

    Returns sheets (sheet_id, frames, frame_w, frame_h, width, height), the
    sheet pixels, and the rejected sequences. Normals (nr, ng, nb) travel along.
    Frames meet their images as strips of packed pixels, which are exploded
    after the join, so an image that many frames use is not shuffled per pixel.
    """
    sizes = pixels.filter((F.col("x") == 0) & (F.col("y") == 0)).select("image_id", "width", "height")
    order = F.col(order_column).cast("long")
    judged = _judge(frames, sizes, _extent(order))
    good = judged.filter(F.col("reason").isNull())
    rejected = judged.filter(F.col("reason").isNotNull()).select("seq_id", "frames", "reason")
    sheets = good.select(
        F.col("seq_id").alias("sheet_id"),
        "frames", "frame_w", "frame_h",
        (F.col("frames") * F.col("frame_w")).alias("width"),
        F.col("frame_h").alias("height"),
    )
    # One pass over the frames judges the sequences and measures them for the ranking.
    ranked = _number_frames(
        frames.select("seq_id", "image_id", order_column),
        good.select("seq_id", "frames", "n", "lo", "hi"),
        order,
        RANGE_ROWS,
    )
    placed = ranked.join(to_strips(pixels), "image_id").withColumn(
        "i", F.explode(cells(F.size("px")))
    )
    normals = []
    if "nr" in pixels.columns:
        normals = [channel(F.get("nx", F.col("i")), i).alias(c) for i, c in enumerate(NORMAL)]
    strip = placed.select(
        F.col("seq_id").alias("image_id"),
        (F.col("frames") * F.col("width")).alias("width"),
        "height",
        (F.col("pos") * F.col("width") + F.col("i") % F.col("width")).alias("x"),
        (F.col("top") + idiv(F.col("i"), F.col("width"))).cast("int").alias("y"),
        *[channel(F.get("px", F.col("i")), i).alias(c) for i, c in enumerate("rgba")],
        *normals,
    )
    return sheets, strip, rejected


def sheet_meta(sequences: DataFrame) -> DataFrame:
    """Sequence meta carried onto the sheet, with ``packed=true`` added."""
    kept = F.map_filter(
        F.coalesce(F.col("meta"), F.create_map().cast("map<string,string>")),
        lambda k, _: k != "packed",
    )
    return sequences.withColumn(
        "meta", F.map_concat(kept, F.create_map(F.lit("packed"), F.lit("true")))
    )


def slice_sheet(pixels: DataFrame, frame_w="frame_w", frame_h="frame_h") -> DataFrame:
    """Cut sheets into frames, left to right and top to bottom.

    ``frame_w`` and ``frame_h`` are columns of the pixel rows or numbers.
    Pixels right of the last whole column belong to no frame.
    """
    fw = F.lit(frame_w) if isinstance(frame_w, int) else F.col(frame_w)
    fh = F.lit(frame_h) if isinstance(frame_h, int) else F.col(frame_h)
    columns = F.greatest(F.lit(1), idiv(F.col("width"), fw))
    column, row = idiv(F.col("x"), fw), idiv(F.col("y"), fh)
    return pixels.withColumns({"sheet_column": column, "sheet_columns": columns}).filter(
        F.col("sheet_column") < F.col("sheet_columns")
    ).select(
        F.col("image_id").alias("sheet_id"),
        (row * F.col("sheet_columns") + F.col("sheet_column")).cast("int").alias("frame_no"),
        fw.cast("int").alias("width"),
        fh.cast("int").alias("height"),
        (F.col("x") % fw).cast("int").alias("x"),
        (F.col("y") % fh).cast("int").alias("y"),
        "r", "g", "b", "a",
    )
