"""Images as strips of packed pixels: what joins move instead of pixel rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.columns import channel, idiv, pack_rgba
from pixelloom.model import NORMAL

# Pixels per strip.
STRIP_PIXELS = 4096

STRIP = ("image_id", "width", "height", "top", "px")


def to_strips(pixels: DataFrame, **lists: Column) -> DataFrame:
    """Strips of whole scanlines: at most ``STRIP_PIXELS`` pixels per row, in pixel order.

    ``px`` holds the colours, one long per pixel with the colour in its low 32
    bits; ``lists`` names other arrays and the 32-bit value they hold per pixel.
    Without ``lists``, normals of the table go to ``nx``.
    """
    rows = F.greatest(F.lit(1), idiv(F.lit(STRIP_PIXELS), F.col("width"))).cast("int")
    first = idiv(F.col("y"), rows) * rows
    position = F.shiftleft((F.col("y") - first) * F.col("width") + F.col("x"), 32)
    if not lists:
        lists = {"px": pack_rgba(*[F.col(c) for c in "rgba"])}
        if "nr" in pixels.columns:
            lists["nx"] = packed_normals()
    held = next(iter(lists))
    packed = (
        pixels.select(
            "image_id", "width", "height",
            first.cast("int").alias("top"),
            *[position.bitwiseOR(v).alias(name) for name, v in lists.items()],
        )
        .groupBy("image_id", "width", "height", "top")
        .agg(*[F.collect_list(name).alias(name) for name in lists])
    )
    dense = F.size(held) == F.least(rows, F.col("height") - F.col("top")) * F.col("width")
    checked = F.when(dense, F.sort_array(held)).otherwise(
        F.raise_error(F.concat(F.lit("image is not dense: "), F.col("image_id")))
    )
    ordered = {held: checked} | {n: F.sort_array(n) for n in lists if n != held}
    return packed.select(
        "image_id", "width", "height", "top", *[v.alias(n) for n, v in ordered.items()]
    )


def packed_normals() -> Column:
    return pack_rgba(*[F.col(c) for c in NORMAL], F.lit(0))


def rows_between(strips: DataFrame, low: Column, high: Column) -> DataFrame:
    """Only the scanlines low <= y < high: other strips are dropped, the rest is sliced."""
    held = idiv(F.size("px"), F.col("width")).cast("int")
    from_top = F.greatest(low - F.col("top"), F.lit(0))
    upto = F.least(high - F.col("top"), held)
    cut = strips.filter(from_top < upto).withColumns(
        {
            name: F.slice(name, from_top * F.col("width") + 1, (upto - from_top) * F.col("width"))
            for name in ("px", "nx") if name in strips.columns
        }
        | {"top": (F.col("top") + from_top).cast("int")}
    )
    return cut


def from_strips(strips: DataFrame, *kept: str) -> DataFrame:
    """image_id, width, height, x, y, r, g, b, a, the normals of ``nx`` if there are, and ``kept``."""
    shading = "nx" in strips.columns
    rows = strips.select("image_id", "width", "height", "top", *kept, *(["nx"] if shading else []), F.posexplode("px").alias("i", "v"))
    normals = [channel(F.get("nx", F.col("i")), i).alias(c) for i, c in enumerate(NORMAL)] if shading else []
    return rows.select(
        "image_id", "width", "height",
        (F.col("i") % F.col("width")).cast("int").alias("x"),
        (F.col("top") + idiv(F.col("i"), F.col("width"))).cast("int").alias("y"),
        *[channel(F.col("v"), i).alias(c) for i, c in enumerate("rgba")],
        *normals,
        *kept,
    )
