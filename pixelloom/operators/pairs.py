"""Sprite pairs (diffuse + normal) and their relighting."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.model import NORMAL, PIXEL, SIZE
from pixelloom.operators.strips import from_strips, packed_normals, to_strips

# Fixed values of the light model.
ATTENUATION = 0.35
QUAD = 1.6
MIN_Z, MAX_Z = 0.1, 4.0
MIN_ALPHA = 0.01


@dataclass(frozen=True)
class Light:
    """A point light in quad space; defaults are the viewer's."""

    light_id: str = "default"
    x: float = 0.0
    y: float = 0.0
    z: float = 1.0
    red: int = 255
    green: int = 242
    blue: int = 208
    ambient: float = 0.15
    intensity: float = 1.4


def sprite_pair(diffuse: DataFrame, normals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Join diffuse pixels with optional normals (image_id, width, height, x, y, nr, ng, nb).

    Returns the pairs (``has_normal`` per pixel row) and the rejects: images
    whose normal map has another size. Sizes are compared on one row per image;
    the others meet as strips of packed pixels.
    """
    if normals is None:
        none = {n: F.lit(None).cast("int") for n in NORMAL}
        pairs = diffuse.select(*PIXEL).withColumns(none | {"has_normal": F.lit(False)})
        rejects = diffuse.limit(0).select("image_id", F.lit("").alias("reason"))
        return pairs, rejects
    corner = (F.col("x") == 0) & (F.col("y") == 0)
    sizes = normals.filter(corner).select(
        "image_id", F.col("width").alias("normal_w"), F.col("height").alias("normal_h")
    )
    rejects = (
        diffuse.filter(corner)
        .select("image_id", "width", "height")
        .join(sizes, "image_id")
        .filter((F.col("width") != F.col("normal_w")) | (F.col("height") != F.col("normal_h")))
        .select("image_id", F.lit("ValueError: normal map must match diffuse size").alias("reason"))
    )
    shading = to_strips(normals, nx=packed_normals())
    strips = (
        to_strips(diffuse.select(*PIXEL))
        .join(rejects.select("image_id"), "image_id", "left_anti")
        .join(shading, [*SIZE, "top"], "left")
    )
    pairs = from_strips(strips).withColumn("has_normal", F.col("nr").isNotNull())
    return pairs, rejects


def relight(pairs: DataFrame, lights: Sequence[Light] = (Light(),)) -> DataFrame:
    """Shade every pair under every light: one row per (light, pixel) with lr, lg, lb.

    The lights are a short parameter list and become a literal array that each
    pixel explodes: no join, and nothing is broadcast. Nearly transparent pixels
    are discarded. Channels are used as they are, without colour conversion; the
    lit colour is clipped to 0..1 and rounded to uint8.
    """
    struct = F.array(
        *[
            F.struct(
                F.lit(one.light_id).alias("light_id"),
                F.lit(float(one.x)).alias("x"),
                F.lit(float(one.y)).alias("y"),
                F.lit(min(MAX_Z, max(MIN_Z, float(one.z)))).alias("z"),
                *[
                    F.lit(v / 255.0).alias(c)
                    for c, v in (("r", one.red), ("g", one.green), ("b", one.blue))
                ],
                F.lit(float(one.ambient)).alias("ambient"),
                F.lit(float(one.intensity)).alias("intensity"),
            )
            for one in lights
        ]
    )
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    aspect = w / h
    quad_w = F.when(aspect >= 1, F.lit(QUAD)).otherwise(F.lit(QUAD) * aspect)
    quad_h = F.when(aspect >= 1, F.lit(QUAD) / aspect).otherwise(F.lit(QUAD))
    placed = pairs.filter(F.col("a") / F.lit(255.0) >= MIN_ALPHA).withColumns(
        {
            "px": ((F.col("x") + F.lit(0.5)) / w - F.lit(0.5)) * quad_w,
            "py": (F.lit(0.5) - (F.col("y") + F.lit(0.5)) / h) * quad_h,
            **{
                f"n{axis}": F.when(
                    F.col(name).isNull(), F.lit(1.0 if axis == "z" else 0.0)
                ).otherwise(F.col(name) / F.lit(255.0) * F.lit(2.0) - F.lit(1.0))
                for axis, name in zip("xyz", NORMAL)
            },
        }
    )

    def length(x: str, y: str, z: str) -> Column:
        x, y, z = F.col(x), F.col(y), F.col(z)
        return F.sqrt(x * x + y * y + z * z)

    aimed = (
        placed.withColumn("nlen", length("nx", "ny", "nz"))
        .withColumn("light", F.explode(struct))
        .withColumns(
            {
                "dx": F.col("light.x") - F.col("px"),
                "dy": F.col("light.y") - F.col("py"),
                "dz": F.col("light.z"),
            }
        )
        .withColumn("dist", length("dx", "dy", "dz"))
    )
    dot = sum(
        (F.col(f"n{c}") / F.col("nlen")) * (F.col(f"d{c}") / F.greatest(F.col("dist"), F.lit(0.0001)))
        for c in "yz"
    )
    first = (F.col("nx") / F.col("nlen")) * (
        F.col("dx") / F.greatest(F.col("dist"), F.lit(0.0001))
    )
    shaded = aimed.withColumns(
        {
            "diffuse": F.greatest(first + dot, F.lit(0.0)),
            "atten": F.lit(1.0) / (F.lit(1.0) + F.lit(ATTENUATION) * F.col("dist") * F.col("dist")),
        }
    )

    def lit_channel(c: str) -> Column:
        glow = F.col(f"light.{c}") * F.col("diffuse") * F.col("light.intensity") * F.col("atten")
        value = F.col(c) / F.lit(255.0) * (F.col("light.ambient") + glow)
        clipped = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
        return F.floor(clipped * F.lit(255.0) + F.lit(0.5)).cast("int")

    return shaded.select(
        "image_id",
        F.col("light.light_id").alias("light_id"),
        "width", "height", "x", "y",
        *[lit_channel(c).alias(f"l{c}") for c in "rgb"],
        "a",
    )
