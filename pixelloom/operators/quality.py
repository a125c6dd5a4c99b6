"""Data quality of pixel tables: density, ranges, differences between two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.model import PIXEL


def check_images(pixels: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """One row per image: counts of what breaks the dense uint8 contract, and ``ok``.

    Distinct positions are counted exactly with bits: 64 positions of an image
    are one long, or-ed map-side in a hash aggregate, instead of one shuffled row
    per pixel. With ``images``, an image without pixels is listed, and
    pixels of an undeclared image are not ok.
    """
    placed = F.col("x").between(0, F.col("width") - 1) & F.col("y").between(0, F.col("height") - 1)
    good_values = F.lit(True)
    for c in "rgba":
        good_values = good_values & F.coalesce(F.col(c).between(0, 255), F.lit(False))
    position = F.when(placed, F.col("y").cast("long") * F.col("width") + F.col("x")).otherwise(F.lit(0))
    one_bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("position").bitwiseAND(F.lit(63)).cast("int"))
    ranges = (
        pixels.select(
            "image_id", "width", "height", position.alias("position"), placed.alias("placed"),
            good_values.alias("good"),
        )
        .groupBy("image_id", F.shiftright("position", 6).alias("word"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count(F.when(~F.col("placed"), 1)).alias("misplaced"),
            F.count(F.when(~F.col("good"), 1)).alias("bad"),
            F.min("width").alias("w0"), F.max("width").alias("w1"),
            F.min("height").alias("h0"), F.max("height").alias("h1"),
            F.bit_or(F.when(F.col("placed"), one_bit)).alias("bits"),
        )
    )
    facts = ranges.groupBy("image_id").agg(
        F.sum("n").alias("pixels"),
        F.sum(F.coalesce(F.bit_count("bits"), F.lit(0))).cast("long").alias("positions"),
        F.sum("misplaced").alias("misplaced"),
        F.sum("bad").alias("bad_values"),
        (F.max("w1").cast("long") * F.max("h1")).alias("expected"),
        ((F.min("w0") == F.max("w1")) & (F.min("h0") == F.max("h1"))).alias("one_size"),
    )
    if images is not None:
        wanted = images.select(
            "image_id", (F.col("width").cast("long") * F.col("height")).alias("declared")
        )
        facts = wanted.join(facts, "image_id", "full").withColumns(
            {
                "expected": F.coalesce("declared", "expected"),
                "one_size": F.coalesce("one_size", F.lit(True)) & F.col("declared").isNotNull(),
                **{
                    c: F.coalesce(c, F.lit(0))
                    for c in ("pixels", "positions", "misplaced", "bad_values")
                },
            }
        )
    ok = (
        F.col("one_size")
        & (F.col("pixels") == F.col("expected"))
        & (F.col("positions") == F.col("expected"))
        & (F.col("misplaced") == 0)
        & (F.col("bad_values") == 0)
    )
    return facts.select(
        "image_id", "pixels", "positions", "expected", "misplaced", "bad_values", ok.alias("ok")
    )


def diff_images(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pixel rows whose multiplicity differs: ``delta`` > 0 is more often in ``left``.

    Both differences in one aggregation over the whole row (one shuffle, spread
    by all columns) instead of two EXCEPT ALL.
    """
    signed = left.select(*PIXEL, F.lit(1).alias("sign")).unionByName(
        right.select(*PIXEL, F.lit(-1).alias("sign"))
    )
    return signed.groupBy(*PIXEL).agg(F.sum("sign").alias("delta")).filter(F.col("delta") != 0)


def differing_images(left: DataFrame, right: DataFrame) -> DataFrame:
    """Images that differ, with the number of pixel rows only on either side."""
    return (
        diff_images(left, right)
        .groupBy("image_id")
        .agg(
            F.sum(F.greatest(F.col("delta"), F.lit(0))).alias("only_left"),
            F.sum(F.greatest(-F.col("delta"), F.lit(0))).alias("only_right"),
        )
    )
