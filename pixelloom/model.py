"""Data model: which columns an image, a normal map, a frame or a request has.

A pixel row carries the size of its image. Size-dependent operators are then
projections on one frame instead of joins with an image table, which would
shuffle every pixel and put one large image into one task.

Image tables are dense: an image of size (w, h) has exactly w*h pixel rows
(``operators.quality.check_images`` verifies it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The artifact kinds of the data model.
KINDS = (
    "image",
    "image_batch",
    "frame_seq",
    "normal_map",
    "sprite_pair",
    "sprite_sheet",
    "mask",
    "palette",
)

# Kinds that the artifact sink can store.
STORABLE_KINDS = ("image", "normal_map", "sprite_pair", "sprite_sheet")

# Workspace configuration defaults, flattened to parameter names.
WORKSPACE_DEFAULTS = {
    "canvas.width": "96",
    "canvas.height": "96",
    "pivot": "bottom_center",
    "normal.enabled": "true",
    "naming.prefix": "sprite",
}

# Declared parameters of the single-sprite task (name, type, default).
SINGLE_SPRITE_PARAMS = (
    ("prompt", "string", ""),
    ("model_id", "string", "stub-image"),
    ("seed", "int", "0"),
    ("width", "int", "96"),
    ("height", "int", "96"),
    ("grid_w", "int", "64"),
    ("grid_h", "int", "64"),
    ("colors", "int", "32"),
)

SIZE = ("image_id", "width", "height")
PIXEL = (*SIZE, "x", "y", "r", "g", "b", "a")
NORMAL = ("nr", "ng", "nb")

PIXEL_SCHEMA = (
    "image_id string, width int, height int, x int, y int, r int, g int, b int, a int"
)


def images_of(pixels: DataFrame, kind: str = "image") -> DataFrame:
    """The image table of a dense pixel table: one row per image, by a pushed-down filter."""
    return pixels.filter((F.col("x") == 0) & (F.col("y") == 0)).select(
        *SIZE, F.lit(kind).alias("kind"), F.create_map().cast("map<string,string>").alias("meta")
    )


def with_meta(images: DataFrame, **entries: Column) -> DataFrame:
    """Add meta entries; a later entry of the same name wins."""
    old = F.coalesce(F.col("meta"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, _: ~k.isin(*entries))
    added = F.create_map(*[c for k, v in entries.items() for c in (F.lit(k), v.cast("string"))])
    return images.withColumn("meta", F.map_concat(kept, added))
