"""Tiles: bounded groups of neighbouring pixels, for operators that look around a pixel.

A stencil over windows needs all pixels of an image row (or column) in one
sorted group, once per axis. Here pixels are grouped into tiles of at most
(T+2*halo)^2 pixels instead: a border pixel also goes to the tiles next to it.
The group size is bounded for any image, one packed long per pixel is shuffled
(map-side collected), there is one exchange, and neighbours are array reads
inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.columns import MAX_POSITION, cells, idiv, pack_at

TILE = 64


def _tiles_of(pos: Column, size: Column, tile: int, halo: int) -> Column:
    """The tiles along one axis whose core or halo holds ``pos``."""
    first = idiv(F.greatest(pos - halo, F.lit(0)), tile)
    last = idiv(F.least(pos + halo, size - 1), tile)
    return F.sequence(first.cast("int"), last.cast("int"))


def pack_tiles(pixels: DataFrame, tile: int = TILE, halo: int = 1) -> DataFrame:
    """One row per tile: its extent (halo included), its core and its pixels in row order.

    ``px`` holds position, luma and colour packed into longs. A tile that misses
    pixels (the image is not dense) is an error, never a silent shift.
    """
    if (tile + 2 * halo) ** 2 > MAX_POSITION:
        raise ValueError(f"tile {tile} with halo {halo} is too large")
    spread = pixels.withColumn(
        "ty", F.explode(_tiles_of(F.col("y"), F.col("height"), tile, halo))
    ).withColumn("tx", F.explode(_tiles_of(F.col("x"), F.col("width"), tile, halo)))
    left = F.greatest(F.col("tx") * tile - halo, F.lit(0))
    top = F.greatest(F.col("ty") * tile - halo, F.lit(0))
    # Positions need no knowledge of the tile width: a row never exceeds tile + 2*halo.
    stride = tile + 2 * halo
    position = (F.col("y") - top) * stride + (F.col("x") - left)
    packed = (
        spread.withColumn(
            "v", pack_at(position, F.col("r"), F.col("g"), F.col("b"), F.col("a"))
        )
        .groupBy("image_id", "width", "height", "tx", "ty")
        .agg(F.collect_list("v").alias("px"))
    )
    right = F.least(F.col("tx") * tile + tile + halo, F.col("width"))
    bottom = F.least(F.col("ty") * tile + tile + halo, F.col("height"))
    tiles = packed.select(
        "image_id", "width", "height",
        left.alias("left"),
        top.alias("top"),
        (right - left).alias("tw"),
        (bottom - top).alias("th"),
        (F.col("tx") * tile).alias("core_x"),
        (F.col("ty") * tile).alias("core_y"),
        F.least(F.lit(tile), F.col("width") - F.col("tx") * tile).alias("core_w"),
        F.least(F.lit(tile), F.col("height") - F.col("ty") * tile).alias("core_h"),
        F.sort_array("px").alias("px"),
    )
    dense = F.size("px") == F.col("tw") * F.col("th")
    return tiles.withColumn(
        "px",
        F.when(dense, F.col("px")).otherwise(
            F.raise_error(F.concat(F.lit("image is not dense: "), F.col("image_id")))
        ),
    )


def explode_core(tiles: DataFrame) -> DataFrame:
    """Back to one row per core pixel, with x, y and its index ``at`` in ``px``."""
    rows = tiles.withColumn("i", F.explode(cells(F.col("core_w") * F.col("core_h"))))
    x = F.col("core_x") + F.col("i") % F.col("core_w")
    y = F.col("core_y") + idiv(F.col("i"), F.col("core_w")).cast("int")
    return rows.withColumns({"x": x, "y": y})


def neighbour(dx: int, dy: int) -> Column:
    """Packed pixel at (x+dx, y+dy), edges replicated, read from the tile of the row."""
    nx, ny = F.col("x"), F.col("y")
    if dx:
        nx = F.least(F.greatest(nx + dx, F.lit(0)), F.col("width") - 1)
    if dy:
        ny = F.least(F.greatest(ny + dy, F.lit(0)), F.col("height") - 1)
    index = (ny - F.col("top")) * F.col("tw") + (nx - F.col("left"))
    return F.get(F.col("px"), index)
