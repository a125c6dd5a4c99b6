"""Changing the pixel grid: area average, nearest neighbour, solid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.columns import col, idiv, round_ratio, shrink_cell, target_range
from pixelloom.model import PIXEL
from pixelloom.operators.channels import hard_alpha


def box_downsample(
    pixels: DataFrame, target_w: int | Column, target_h: int | Column, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Area average onto a target_w x target_h grid, weighted by coverage.

    Alpha is the mean; a colour is sum(c*a)/sum(a), 0 without coverage; both
    round half up. All sums are integers, combined map-side before the shuffle,
    so a large image sends at most one row per cell and task. A growing axis
    groups by its source coordinate and is expanded after the aggregation.
    ``keep`` names further columns that are constant per image and stay.
    """
    tw, th = col(target_w).cast("int"), col(target_h).cast("int")
    sized = pixels.withColumns({"tw": tw, "th": th})
    # A target given as a number needs no place in the sums of every cell.
    given = {n: v for n, v, t in (("tw", tw, target_w), ("th", th, target_h)) if isinstance(t, int)}
    kx = F.when(F.col("tw") <= F.col("width"), shrink_cell(F.col("x"), F.col("width"), F.col("tw")))
    ky = F.when(F.col("th") <= F.col("height"), shrink_cell(F.col("y"), F.col("height"), F.col("th")))
    alpha = F.col("a").cast("long")
    sums = sized.groupBy(
        "image_id", kx.otherwise(F.col("x")).alias("kx"), ky.otherwise(F.col("y")).alias("ky")
    ).agg(
        *[F.max(c).alias(c) for c in ("width", "height", "tw", "th", *keep) if c not in given],  # constant per image
        F.count(F.lit(1)).alias("n"),
        F.sum(alpha).alias("sa"),
        *[F.sum(F.col(c) * alpha).alias(f"s{c}") for c in "rgb"],
    ).withColumns(given)
    x0, x1 = target_range(F.col("kx"), F.col("width"), F.col("tw"))
    y0, y1 = target_range(F.col("ky"), F.col("height"), F.col("th"))
    shrinks_x, shrinks_y = F.col("tw") <= F.col("width"), F.col("th") <= F.col("height")
    placed = sums.withColumn(
        "cx", F.explode(F.when(shrinks_x, F.array("kx")).otherwise(_span(x0, x1)))
    ).withColumn("cy", F.explode(F.when(shrinks_y, F.array("ky")).otherwise(_span(y0, y1))))
    return placed.select(
        "image_id",
        F.col("tw").alias("width"),
        F.col("th").alias("height"),
        F.col("cx").alias("x"),
        F.col("cy").alias("y"),
        *[round_ratio(F.col(f"s{c}"), F.col("sa")).alias(c) for c in "rgb"],
        round_ratio(F.col("sa"), F.col("n")).alias("a"),
        *keep,
    )


def _span(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def nearest_resize(pixels: DataFrame, target_w: int | Column, target_h: int | Column) -> DataFrame:
    """Nearest neighbour: target o reads source floor((2o+1)*size / (2*target)).

    Every source pixel knows the targets that read it, so this is a projection
    and an explode; skipped source rows are filtered out before the explode.
    """
    sized = pixels.withColumns({"tw": col(target_w).cast("int"), "th": col(target_h).cast("int")})
    x0, x1 = target_range(F.col("x"), F.col("width"), F.col("tw"))
    y0, y1 = target_range(F.col("y"), F.col("height"), F.col("th"))
    ranged = sized.withColumns({"x0": x0, "x1": x1, "y0": y0, "y1": y1}).filter(
        (F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1"))
    )
    return (
        ranged.withColumn("ty", F.explode(F.sequence("y0", "y1")))
        .withColumn("tx", F.explode(F.sequence("x0", "x1")))
        .select(
            "image_id",
            F.col("tw").alias("width"),
            F.col("th").alias("height"),
            F.col("tx").alias("x"),
            F.col("ty").alias("y"),
            "r", "g", "b", "a",
        )
    )


def upscale(pixels: DataFrame, factor: int | Column) -> DataFrame:
    """Integer nearest upscale: every pixel becomes a solid factor x factor block."""
    k = col(factor).cast("int")
    return (
        pixels.withColumn("k", k)
        .withColumn("dy", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .withColumn("dx", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .select(
            "image_id",
            (F.col("width") * F.col("k")).alias("width"),
            (F.col("height") * F.col("k")).alias("height"),
            (F.col("x") * F.col("k") + F.col("dx")).alias("x"),
            (F.col("y") * F.col("k") + F.col("dy")).alias("y"),
            "r", "g", "b", "a",
        )
    )


def pixel_perfect(pixels: DataFrame, cell: int = 1) -> DataFrame:
    """Snap to a grid of solid cell x cell blocks with hard alpha.

    The output is (w div cell)*cell wide, so a size that is not a multiple of
    the cell shrinks.
    """
    cell = max(1, int(cell))
    logical_w = F.greatest(F.lit(1), idiv(F.col("width"), cell)).cast("int")
    logical_h = F.greatest(F.lit(1), idiv(F.col("height"), cell)).cast("int")
    return upscale(hard_alpha(box_downsample(pixels, logical_w, logical_h)), cell).select(*PIXEL)
