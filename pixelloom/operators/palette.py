"""Palettes: median-cut quantisation, pixelisation, palette extraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.columns import dense, channel, idiv, pack_rgba
from pixelloom.functions.ranking import split_row_number
from pixelloom.model import PIXEL
from pixelloom.operators.channels import OPAQUE, hard_alpha
from pixelloom.operators.cuts import bounded, cut_trees, list_offsets
from pixelloom.operators.resample import box_downsample, upscale
from pixelloom.operators.strips import from_strips, to_strips

MIN_COLORS, MAX_COLORS = 2, 256


def palette_size(colors: int) -> int:
    return max(MIN_COLORS, min(MAX_COLORS, int(colors)))


def _rgb(r: Column, g: Column, b: Column) -> Column:
    return (r.cast("long") * 256 + g) * 256 + b


def quantize(pixels: DataFrame, colors: int) -> DataFrame:
    """At most ``colors`` RGB colours per image by median cut, and hard alpha.

    Transparent pixels take part with their RGB. The cut of an image is a few
    splits and colours (``operators.cuts``), found on its colour histogram
    without gathering a large one; strips of packed pixels meet it in a join on
    the image and look their colours up.
    """
    colors = palette_size(colors)
    trees = cut_trees(pixels, colors)
    painted = to_strips(pixels).join(trees, "image_id").mapInArrow(
        _painted, "image_id string, width int, height int, top int, px array<bigint>"
    )
    return hard_alpha(from_strips(painted)).select(*PIXEL)


def _painted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The colours of each strip replaced by those of its image's cut."""
    import numpy as np

    from pixelloom.functions.mediancut import paint

    def table(lists, empty: int):
        offsets, flat = list_offsets(lists), lists.flatten().to_numpy()
        size = np.diff(offsets)
        out = np.full((len(size), size.max(initial=0)), empty, np.int64)
        out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(offsets[:-1], size)] = flat
        return out

    for batch in batches:
        lists = batch.column("px")
        offsets, cells = list_offsets(lists), lists.flatten().to_numpy()
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        rgb = paint((cells >> 8) & 0xFFFFFF, row, table(batch.column("splits"), -1), table(batch.column("colors"), 0))
        px = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array((rgb << 8) | (cells & 0xFF)))
        names = ["image_id", "width", "height", "top"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], px], [*names, "px"])


def quantized_grids(grid: DataFrame, colors: int | str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per image of a small grid: size, content bounds, quantised pixels.

    For grids whose size is a parameter (``box_downsample`` output), so the
    number of cells per image is bounded by it. ``px`` holds the cells in row
    order, luma in the high and colour in the low 32 bits. ``colors`` may name a
    column, constant per image like the integer columns in ``keep``, which stay.
    """
    sizes = F.max(colors) if isinstance(colors, str) else F.lit(colors)
    content = F.col("a") >= OPAQUE
    alpha = F.when(content, F.lit(255)).otherwise(F.lit(0))
    position = F.col("y").cast("long") * F.col("width") + F.col("x")
    packed = F.shiftleft(position, 32).bitwiseOR(
        pack_rgba(F.col("r"), F.col("g"), F.col("b"), alpha)
    )
    # An object aggregate evaluates what it collects row by row, so cells are packed before it.
    cells = grid.withColumns(
        {"packed": packed, "inside_x": F.when(content, F.col("x")), "inside_y": F.when(content, F.col("y"))}
    )
    rows = (
        cells.groupBy("image_id", "width", "height")
        .agg(
            F.min("inside_x").alias("x0"),
            F.min("inside_y").alias("y0"),
            (F.max("inside_x") + 1).alias("x1"),
            (F.max("inside_y") + 1).alias("y1"),
            F.collect_list("packed").alias("px"),
            sizes.cast("int").alias("colors"),
            *[F.max(c).cast("int").alias(c) for c in keep],
        )
        .withColumn("px", dense(F.sort_array("px"), F.col("width").cast("long") * F.col("height")))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from pixelloom.functions.mediancut import median_cut

        for batch in bounded(batches, "px"):
            lists = batch.column("px")
            cells, offsets = lists.flatten().to_numpy(), list_offsets(lists)
            image = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            distinct, where, count = np.unique(
                (image << 24) | ((cells >> 8) & 0xFFFFFF), return_inverse=True, return_counts=True
            )
            asked = np.array([palette_size(n) for n in batch.column("colors").to_pylist()])[distinct >> 24]
            rgb = np.empty_like(distinct)
            for size in np.unique(asked):  # images of one palette size together
                own = np.flatnonzero(asked == size)
                starts = np.flatnonzero(np.diff(distinct[own] >> 24, prepend=-1))
                rgb[own] = median_cut(distinct[own] & 0xFFFFFF, count[own], starts, int(size))
            rgb = rgb[where]
            luma = 299 * (rgb >> 16) + 587 * ((rgb >> 8) & 255) + 114 * (rgb & 255)
            pixels = (luma << 32) | (rgb << 8) | (cells & 0xFF)
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["px"] = pa.ListArray.from_arrays(offsets, pa.array(pixels))
            yield pa.RecordBatch.from_pydict(columns)

    schema = (
        "image_id string, width int, height int, x0 int, y0 int, x1 int, y1 int, px array<bigint>, colors int"
        + "".join(f", {c} int" for c in keep)
    )
    return rows.mapInArrow(cut, schema)


def pixelize(
    pixels: DataFrame,
    target_w: int = 64,
    target_h: int = 64,
    colors: int = 32,
    upscale_by: int = 1,
) -> DataFrame:
    """Area-average onto a target_w x target_h grid, quantise, optionally upscale.

    The grid of an image is one row, so its size must suit a row; an image with
    empty cells raises.
    """
    tw, th, k = max(1, int(target_w)), max(1, int(target_h)), max(1, int(upscale_by))
    small = box_downsample(pixels, tw, th)
    rows = quantized_grids(small, colors).select(
        "image_id", "width", "height", F.posexplode("px").alias("pos", "v")
    )
    out = rows.select(
        "image_id", "width", "height",
        (F.col("pos") % F.col("width")).alias("x"),
        idiv(F.col("pos"), F.col("width")).cast("int").alias("y"),
        *[channel(F.col("v"), i).alias(c) for i, c in enumerate("rgba")],
    )
    return (upscale(out, k) if k > 1 else out).select(*PIXEL)


def pixelize_meta(target_w: int, target_h: int, colors: int) -> dict[str, Column]:
    """Meta entries of ``pixelize`` for ``model.with_meta``."""
    return {
        "pixelized": F.lit("true"),
        "grid": F.lit(f"[{target_w}, {target_h}]"),
        "colors": F.lit(str(colors)),
    }


def palette(pixels: DataFrame) -> DataFrame:
    """The colours of each image with their counts, most frequent first.

    Counting is combined map-side. The histogram of a hot image may still be
    large, so its rank is taken section by section: a section (count, r and g) has
    at most 65536 colours.
    """
    counted = (
        pixels.select("image_id", pack_rgba(*[F.col(c) for c in "rgba"]).alias("rgba"))
        .groupBy("image_id", "rgba")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Both sides of the ranking need exactly these columns and no side gets a filter of
    # its own (the section is never null), so Spark reuses the exchange.
    section = F.coalesce(F.shiftright("rgba", 16), F.lit(0))
    spread = counted.repartition("image_id", "n", section).withColumn("section", section)
    ranked = split_row_number(
        spread, "image_id", [F.desc("n"), "section"], ["rgba"], ["n", "section"], "palette_ix"
    )
    return ranked.select(
        "image_id",
        *[channel(F.col("rgba"), i).alias(c) for i, c in enumerate("rgba")],
        "n",
        "palette_ix",
    )


def color_counts(pixels: DataFrame) -> DataFrame:
    """Number of distinct RGB colours per image, exact."""
    return (
        pixels.select("image_id", _rgb(F.col("r"), F.col("g"), F.col("b")).alias("rgb"))
        .distinct()
        .groupBy("image_id")
        .agg(F.count(F.lit(1)).alias("colors"))
    )


def color_sketches(pixels: DataFrame, *keys: str, lg_k: int = 12) -> DataFrame:
    """A mergeable sketch of the RGB colours per image, or per ``keys``.

    Of constant size (about 2^lg_k bytes) for any number of colours; the
    relative standard error is about 1.04 / sqrt(2^lg_k).
    """
    rgb = _rgb(F.col("r"), F.col("g"), F.col("b"))
    return pixels.groupBy(*(keys or ("image_id",))).agg(F.hll_sketch_agg(rgb, lg_k).alias("sketch"))


def merged_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of unions: per ``keys``, or of all rows without any."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def color_estimates(sketches: DataFrame) -> DataFrame:
    """``estimate``, the number of colours that each sketch has seen."""
    return sketches.withColumn("estimate", F.hll_sketch_estimate("sketch")).drop("sketch")
