"""Prompt images: a deterministic picture per (prompt, seed), used as image source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.columns import cells, col, prompt_rgb, truncate_u8
from pixelloom.session import blowup_partitions


def prompt_images(
    requests: DataFrame,
    prompt: Column,
    seed: Column | int = 0,
    width: int | Column = 512,
    height: int | Column = 512,
    image_id: Column | None = None,
    partitions: int | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One width x height picture per request row, as pixel rows.

    A shaded disc in the colour of sha256("prompt:seed") on a transparent wavy
    background. The request rows are spread by ``image_id`` before the blow-up:
    that one small shuffle also co-locates every later per-image aggregate. Sizes
    may be columns of the requests; a picture is made by one task, so they should
    be of one order of magnitude. ``keep`` names request columns (not those of a
    pixel row) that go along with every pixel.
    """
    seed = F.lit(seed) if isinstance(seed, int) else seed
    image_id = F.col("image_id") if image_id is None else image_id
    r, g, b = prompt_rgb(F.coalesce(prompt.cast("string"), F.lit("")), seed)
    sizes = [
        v.cast("int").alias(n) for n, v in (("width", width), ("height", height)) if isinstance(v, Column)
    ]
    seeds = requests.select(
        image_id.cast("string").alias("image_id"), r.alias("pr"), g.alias("pg"), b.alias("pb"), *sizes, *keep
    ).repartition(partitions or blowup_partitions(requests.sparkSession), "image_id")
    w, h = (n if isinstance(v, Column) else v for n, v in (("width", width), ("height", height)))
    return _render(seeds, col(w), col(h), keep)


def _render(seeds: DataFrame, width: Column, height: Column, keep: tuple[str, ...]) -> DataFrame:
    radius = F.least(width, height) * F.lit(0.36)
    one = F.lit(1.0)
    rows = seeds.withColumn("y", F.explode(cells(height))).withColumn(
        "bb", F.lit(26.0) + F.lit(6.0) * F.cos(F.col("y") / F.greatest(one, height) * F.lit(6.28))
    )
    dx = F.col("x") - width / F.lit(2.0)
    dy = F.col("y") - height / F.lit(2.0)
    wave = F.lit(18.0) + F.lit(6.0) * F.sin(F.col("x") / F.greatest(one, width) * F.lit(6.28))
    falloff = F.col("dist") / F.greatest(one, radius)
    shade = F.least(F.greatest(F.lit(1.0) - falloff * falloff, F.lit(0.0)), F.lit(1.0))
    inside = F.col("dist") <= radius
    tone = F.lit(0.4) + F.lit(0.6) * shade
    return (
        rows.withColumn("x", F.explode(cells(width)))
        .withColumn("dist", F.sqrt(dx * dx + dy * dy))
        .select(
            "image_id",
            width.alias("width"),
            height.alias("height"),
            "x",
            "y",
            truncate_u8(F.when(inside, F.col("pr") * tone).otherwise(wave)).alias("r"),
            truncate_u8(F.when(inside, F.col("pg") * tone).otherwise(F.lit(20.0))).alias("g"),
            truncate_u8(F.when(inside, F.col("pb") * tone).otherwise(F.col("bb"))).alias("b"),
            F.when(inside, F.lit(255)).otherwise(F.lit(0)).alias("a"),
            *keep,
        )
    )
