"""Normal maps from luminance: 3x3 Sobel gradients and their uint8 encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.columns import channel, packed_luma, truncate_u8
from pixelloom.model import NORMAL, PIXEL
from pixelloom.operators.channels import OPAQUE
from pixelloom.operators.tiles import TILE, explode_core, neighbour, pack_tiles

# The normal of a transparent pixel.
FLAT = (128, 128, 255)
MIN_STRENGTH = 0.05

AROUND = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dx, dy) != (0, 0)]


def sobel(height: Callable[[int, int], Column]) -> tuple[Column, Column]:
    """Sobel gradients (left - right, above - below) of an integer height field."""
    gx = (height(-1, -1) + 2 * height(-1, 0) + height(-1, 1)) - (
        height(1, -1) + 2 * height(1, 0) + height(1, 1)
    )
    gy = (height(-1, -1) + 2 * height(0, -1) + height(1, -1)) - (
        height(-1, 1) + 2 * height(0, 1) + height(1, 1)
    )
    return gx, gy


def encode_normals(rows: DataFrame, strength: float) -> DataFrame:
    """Columns nr, ng, nb from the integer gradients gx, gy and alpha."""
    strength = max(MIN_STRENGTH, float(strength))
    nx = -F.col("gx") * F.lit(strength) / F.lit(255000.0)
    ny = -F.col("gy") * F.lit(strength) / F.lit(255000.0)
    rows = rows.withColumns({"nx": nx, "ny": ny}).withColumn(
        "norm", F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.lit(1.0))
    )
    unit = (F.col("nx") / F.col("norm"), F.col("ny") / F.col("norm"), F.lit(1.0) / F.col("norm"))
    opaque = F.col("a") >= OPAQUE
    return rows.withColumns(
        {
            name: F.when(
                opaque, truncate_u8((component * F.lit(0.5) + F.lit(0.5)) * F.lit(255.0))
            ).otherwise(F.lit(flat))
            for name, component, flat in zip(NORMAL, unit, FLAT)
        }
    )


def normal_estimate(pixels: DataFrame, strength: float = 2.0, tile: int = TILE) -> DataFrame:
    """Pixel rows with their tangent-space normal (nr, ng, nb).

    Gradients are taken in integers, so only the final normalisation is
    floating point. Pixels with alpha below 128 get the flat normal.
    """
    rows = explode_core(pack_tiles(pixels, tile, halo=1))
    heights = rows.withColumns(
        {f"h{i}": packed_luma(neighbour(dx, dy)) for i, (dx, dy) in enumerate(AROUND)}
        | {"v": neighbour(0, 0)}
    )
    index = {d: i for i, d in enumerate(AROUND)}
    gx, gy = sobel(lambda dx, dy: F.col(f"h{index[dx, dy]}"))
    graded = heights.select(
        "image_id", "width", "height", "x", "y",
        *[channel(F.col("v"), i).alias(c) for i, c in enumerate("rgba")],
        gx.alias("gx"),
        gy.alias("gy"),
    )
    return encode_normals(graded, strength).select(*PIXEL, *NORMAL)


def normal_meta(strength: float = 2.0) -> dict[str, str]:
    """Meta of a normal map."""
    return {"source": "sobel", "strength": str(float(strength))}
