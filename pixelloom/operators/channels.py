"""Per-pixel projections: RGBA coercion, alpha, luminance, re-tinting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.columns import luma1000, prompt_rgb, truncate_u8
from pixelloom.model import PIXEL
from pixelloom.operators.strips import from_strips, to_strips

OPAQUE = 128  # fixed value: alpha from which a pixel counts as content


def ensure_rgba(pixels: DataFrame, channels: int) -> DataFrame:
    """Raw samples to uint8 RGBA.

    ``channels`` 1 reads a gray column ``v``; 3 reads r, g, b; 4 reads r, g, b,
    a. Values are clipped to 0..255 and truncated; missing alpha is 255.
    """
    if channels == 1:
        gray = truncate_u8(F.col("v").cast("double"))
        rgba = {"r": gray, "g": gray, "b": gray, "a": F.lit(255)}
        pixels = pixels.withColumns(rgba).drop("v")
    elif channels == 3:
        pixels = pixels.withColumns(
            {c: truncate_u8(F.col(c).cast("double")) for c in "rgb"} | {"a": F.lit(255)}
        )
    elif channels == 4:
        pixels = pixels.withColumns({c: truncate_u8(F.col(c).cast("double")) for c in "rgba"})
    else:
        raise ValueError(f"cannot coerce {channels} channels to RGBA")
    return pixels


def hard_alpha(pixels: DataFrame, threshold: int = OPAQUE) -> DataFrame:
    """Alpha becomes 255 from the threshold on, else 0."""
    return pixels.withColumn("a", F.when(F.col("a") >= threshold, 255).otherwise(0))


def content_mask(pixels: DataFrame, threshold: int = OPAQUE) -> DataFrame:
    """The single-channel mask of content pixels: ``m`` is 255 or 0."""
    return pixels.select(
        "image_id", "width", "height", "x", "y",
        F.when(F.col("a") >= threshold, 255).otherwise(0).alias("m"),
    )


def content_pixels(pixels: DataFrame, threshold: int = OPAQUE) -> DataFrame:
    """Only the content pixels; the comparison is pushed to the scan."""
    return pixels.filter(F.col("a") >= threshold)


def luminance(pixels: DataFrame) -> DataFrame:
    """Rec. 601 luma in 0..1 as column ``luma``; alpha is ignored."""
    return pixels.withColumn(
        "luma", luma1000(F.col("r"), F.col("g"), F.col("b")) / F.lit(255000.0)
    )


def tint_columns(prompt: Column) -> dict[str, Column]:
    """Per-image factors of ``retint`` (seed 0), to be computed once per image."""
    return {
        f"tint_{c}": F.lit(0.5) + F.lit(0.5) * (v / F.lit(255.0))
        for c, v in zip("rgb", prompt_rgb(prompt, F.lit(0)))
    }


def retint(pixels: DataFrame, prompts: DataFrame) -> DataFrame:
    """Tint every image by the prompt that ``prompts(image_id, prompt)`` gives it.

    Images without a prompt take the empty prompt. The join is on the image and
    moves strips of packed pixels.
    """
    # The join key is unique per image on the prompt side; hashing happens there.
    tints = prompts.select("image_id", *[c.alias(n) for n, c in tint_columns(F.col("prompt")).items()])
    empty = tint_columns(F.lit(""))
    names = [f"tint_{c}" for c in "rgb"]
    rows = from_strips(to_strips(pixels.select(*PIXEL)).join(tints, "image_id", "left"), *names)
    return rows.withColumns(
        {c: truncate_u8(F.col(c) * F.coalesce(F.col(f"tint_{c}"), empty[f"tint_{c}"])) for c in "rgb"}
    ).drop(*names)
