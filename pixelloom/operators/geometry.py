"""Content bounds, cropping, alignment and pasting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.columns import cells, col, floor_half
from pixelloom.model import PIXEL, with_meta
from pixelloom.operators.channels import OPAQUE
from pixelloom.operators.strips import from_strips, rows_between, to_strips

BOUNDS = ("x0", "y0", "x1", "y1")


def alpha_bbox(pixels: DataFrame, threshold: int = OPAQUE) -> DataFrame:
    """Bounds of the content per image, upper ends exclusive; null for an empty image.

    One row per image, combined map-side: a hot image costs one row per task.
    """
    content = F.col("a") >= threshold
    # The null test is what a join on image_id would add; stated here, every use of the
    # bounds has the same plan and Spark runs it once.
    named = pixels.filter(F.col("image_id").isNotNull())
    return named.groupBy("image_id", "width", "height").agg(
        F.min(F.when(content, F.col("x"))).alias("x0"),
        F.min(F.when(content, F.col("y"))).alias("y0"),
        (F.max(F.when(content, F.col("x"))) + 1).alias("x1"),
        (F.max(F.when(content, F.col("y"))) + 1).alias("y1"),
    )


def crop_to_content(pixels: DataFrame, threshold: int = OPAQUE, padding: int = 0) -> DataFrame:
    """Keep the content bounds, moved to 0,0, with a transparent ring of ``padding``.

    A fully transparent image comes back unchanged, without padding.
    """
    padding = max(0, int(padding))
    bounds = alpha_bbox(pixels, threshold).select("image_id", *BOUNDS)
    found = F.col("x0").isNotNull()
    new_w = F.when(found, F.col("x1") - F.col("x0") + 2 * padding).otherwise(F.col("width"))
    new_h = F.when(found, F.col("y1") - F.col("y0") + 2 * padding).otherwise(F.col("height"))
    low = F.coalesce(F.col("y0"), F.lit(0))
    high = F.coalesce(F.col("y1"), F.col("height"))
    # strips of packed pixels meet the bounds; their scanlines outside are cut off before they are unpacked
    strips = rows_between(to_strips(pixels.select(*PIXEL)).join(bounds, "image_id"), low, high)
    kept = (
        from_strips(strips, *BOUNDS)
        .filter(~found | ((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))))
        .select(
            "image_id",
            new_w.alias("width"),
            new_h.alias("height"),
            F.when(found, F.col("x") - F.col("x0") + padding).otherwise(F.col("x")).alias("x"),
            F.when(found, F.col("y") - F.col("y0") + padding).otherwise(F.col("y")).alias("y"),
            "r", "g", "b", "a",
        )
    )
    if not padding:
        return kept
    ring = (
        alpha_bbox(pixels, threshold)
        .filter(found)
        .select(
            "image_id",
            new_w.alias("width"),
            new_h.alias("height"),
            F.lit(padding).alias("ox"),
            F.lit(padding).alias("oy"),
            (F.col("x1") - F.col("x0")).alias("cw"),
            (F.col("y1") - F.col("y0")).alias("ch"),
        )
    )
    return kept.unionByName(transparent_fill(ring))


def crop_meta(images: DataFrame, bounds: DataFrame) -> DataFrame:
    """``cropped=true`` on the images that have content; empty images keep their meta."""
    found = bounds.filter(F.col("x0").isNotNull()).select("image_id")
    cropped = with_meta(images, cropped=F.lit("true")).join(found, "image_id", "left_semi")
    return cropped.unionByName(images.join(found, "image_id", "left_anti"))


def transparent_fill(placed: DataFrame) -> DataFrame:
    """The transparent pixels of a canvas around one opaque-or-not content rectangle.

    ``placed`` has one row per image: canvas width, height, content offset ox,
    oy and content size cw, ch. The complement of the rectangle is generated
    from that row; no canvas grid is joined to the pixels.
    """
    covered = (
        (F.col("x") >= F.col("ox")) & (F.col("x") < F.col("ox") + F.col("cw"))
        & (F.col("y") >= F.col("oy")) & (F.col("y") < F.col("oy") + F.col("ch"))
    )
    zero = F.lit(0)
    return (
        placed.withColumn("y", F.explode(cells(F.col("height"))))
        .withColumn("x", F.explode(cells(F.col("width"))))
        .filter(~covered)
        .select(
            "image_id", "width", "height", "x", "y",
            zero.alias("r"), zero.alias("g"), zero.alias("b"), zero.alias("a"),
        )
    )


def _place(content: DataFrame, canvas_w: Column, canvas_h: Column) -> DataFrame:
    """Move content pixels by (ox, oy) and clip them to the canvas."""
    moved = content.select(
        "image_id",
        canvas_w.cast("int").alias("width"),
        canvas_h.cast("int").alias("height"),
        (F.col("x") + F.col("ox")).cast("int").alias("x"),
        (F.col("y") + F.col("oy")).cast("int").alias("y"),
        "r", "g", "b", "a",
    )
    return moved.filter(
        (F.col("x") >= 0) & (F.col("x") < F.col("width"))
        & (F.col("y") >= 0) & (F.col("y") < F.col("height"))
    )


def paste_onto(
    pixels: DataFrame,
    canvas_w: int,
    canvas_h: int,
    x: int | Column,
    y: int | Column,
) -> DataFrame:
    """Paste every image onto its own transparent canvas at (x, y), clipped, without blending.

    ``x`` and ``y`` may be columns that are constant within an image. One pass
    over the pixels for the content and one pruned pass (first pixel of each
    image) for the fill; no join.
    """
    offsets = {"ox": col(x).cast("int"), "oy": col(y).cast("int")}
    w, h = F.lit(int(canvas_w)), F.lit(int(canvas_h))
    content = _place(pixels.withColumns(offsets), w, h)
    placed = (
        pixels.filter((F.col("x") == 0) & (F.col("y") == 0))
        .withColumns(offsets)
        .select(
            "image_id",
            F.col("width").alias("cw"),
            F.col("height").alias("ch"),
            w.alias("width"),
            h.alias("height"),
            "ox", "oy",
        )
    )
    return content.unionByName(transparent_fill(placed))


def alignment(
    pixels: DataFrame, width: int = 96, height: int = 96, anchor: str = "bottom_center"
) -> DataFrame:
    """Per image: content bounds, paste offset and pivot on a width x height canvas.

    An image without content is placed whole. Any anchor but ``bottom_center``
    centres vertically. Halves are floored, also for content larger than the
    canvas.
    """
    w, h = max(1, int(width)), max(1, int(height))
    whole = {"x0": F.lit(0), "y0": F.lit(0), "x1": F.col("width"), "y1": F.col("height")}
    cw, ch = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    bottom = anchor == "bottom_center"
    placed = (
        alpha_bbox(pixels, OPAQUE)
        .withColumns({k: F.coalesce(F.col(k), v) for k, v in whole.items()})
        .select(
            "image_id",
            *BOUNDS,
            cw.alias("cw"),
            ch.alias("ch"),
            floor_half(F.lit(w) - cw).alias("ox"),
            (F.lit(h) - ch if bottom else floor_half(F.lit(h) - ch)).alias("oy"),
        )
    )
    return placed.select("*", *pivot(w, h, anchor))


def pivot(width: int, height: int, anchor: str) -> tuple[Column, Column]:
    """Pivot of aligned content: centre of the content, bottom row or half height."""
    px = F.col("ox") + floor_half(F.col("cw"))
    py = height - 1 if anchor == "bottom_center" else height // 2
    return px.cast("int").alias("pivot_x"), F.lit(py).alias("pivot_y")


def center_align(
    pixels: DataFrame, width: int = 96, height: int = 96, anchor: str = "bottom_center"
) -> DataFrame:
    """Place the content of every image on a fixed transparent canvas."""
    w, h = max(1, int(width)), max(1, int(height))
    placed = alignment(pixels, w, h, anchor)
    facts = placed.select("image_id", *BOUNDS, "ox", "oy")
    strips = rows_between(to_strips(pixels.select(*PIXEL)).join(facts, "image_id"), F.col("y0"), F.col("y1"))
    content = (
        from_strips(strips, *BOUNDS, "ox", "oy")
        .filter((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")))
        .withColumns({"x": F.col("x") - F.col("x0"), "y": F.col("y") - F.col("y0")})
    )
    fill = placed.select(
        "image_id", F.lit(w).alias("width"), F.lit(h).alias("height"), "ox", "oy", "cw", "ch"
    )
    return _place(content, F.lit(w), F.lit(h)).unionByName(transparent_fill(fill)).select(*PIXEL)


def align_meta(
    images: DataFrame, placed: DataFrame, width: int, height: int, anchor: str
) -> DataFrame:
    """anchor, canvas and pivot of ``alignment`` written into the image meta."""
    pivots = placed.select("image_id", "pivot_x", "pivot_y")
    return with_meta(
        images.join(pivots, "image_id"),
        anchor=F.lit(anchor),
        canvas=F.lit(f"[{width}, {height}]"),
        pivot=F.format_string("[%d, %d]", "pivot_x", "pivot_y"),
    ).drop("pivot_x", "pivot_y").withColumns({"width": F.lit(width), "height": F.lit(height)})


def display_scale(images: DataFrame, stage: int = 256, thumb: int = 48) -> DataFrame:
    """Integer preview scale and fractional thumbnail scale of every image or frame."""
    longest = F.greatest(F.col("width"), F.col("height"))
    return images.select(
        "image_id",
        F.greatest(F.lit(1), F.floor(F.lit(stage) / longest)).cast("int").alias("display_scale"),
        (F.lit(thumb) / longest).alias("thumb_scale"),
    )
