"""Arithmetic on columns: integer division, rounding, packing, colour helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(value: ColumnOrName | int) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def idiv(a: Column | int, b: Column | int) -> Column:
    """Integer quotient of non-negative integers (``div`` keeps it in 64-bit integers)."""
    return F.call_function("div", col(a), col(b))


def floor_half(v: Column) -> Column:
    """floor(v / 2), also for negative v."""
    return F.shiftright(v, 1)


def round_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator rounded half up, in integers; 0 where the denominator is 0."""
    return (
        F.when(denominator == 0, F.lit(0))
        .otherwise(idiv(2 * numerator + denominator, 2 * denominator))
        .cast("int")
    )


def truncate_u8(v: Column) -> Column:
    """Clip to 0..255 and truncate.

    The 1e-9 keeps a value that is an integer up to floating-point noise from
    falling to the integer below it.
    """
    return F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)) + F.lit(1e-9)).cast("int")


def hash_byte(text: Column, index: int) -> Column:
    """Byte ``index`` of sha256(text) as an integer."""
    return F.conv(F.substring(F.sha2(text, 256), 2 * index + 1, 2), 16, 10).cast("int")


def prompt_rgb(prompt: Column, seed: Column) -> tuple[Column, Column, Column]:
    """Colour derived from prompt and seed: the first three sha256 bytes of ``prompt:seed``."""
    text = F.concat(prompt, F.lit(":"), seed.cast("string"))
    return hash_byte(text, 0), hash_byte(text, 1), hash_byte(text, 2)


def luma1000(r: Column, g: Column, b: Column) -> Column:
    """Rec. 601 luma times 255000, exact in integers."""
    return 299 * r + 587 * g + 114 * b


def target_range(pos: Column, size: Column | int, target: Column | int) -> tuple[Column, Column]:
    """First and last target index whose centre-sampled source index is ``pos``.

    Target o reads source floor((2o+1)*size / (2*target)); the range is empty
    (last < first) for a source position that a shrinking resize skips.
    """
    size, target = col(size), col(target)

    def first(p: Column) -> Column:
        return idiv(2 * target * p + size - 1, 2 * size)

    return first(pos).cast("int"), (first(pos + 1) - 1).cast("int")


def shrink_cell(pos: Column, size: Column | int, target: Column | int) -> Column:
    """Target cell that holds the centre of source pixel ``pos`` on a shrinking axis."""
    return idiv((2 * pos + 1) * col(target), 2 * col(size)).cast("int")


def pack_rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    """r, g, b, a as the low 32 bits of a long."""
    r, g, b, a = (c.cast("long") for c in (r, g, b, a))
    return ((r * 256 + g) * 256 + b) * 256 + a


def channel(packed: Column, index: int) -> Column:
    """Channel 0..3 (r, g, b, a) of a value packed by ``pack_rgba`` (higher bits ignored)."""
    return F.shiftright(packed, 8 * (3 - index)).bitwiseAND(F.lit(255)).cast("int")


def pack_at(position: Column, r: Column, g: Column, b: Column, a: Column) -> Column:
    """Position (13 bits), luma (18 bits) and colour (32 bits) of a pixel as one long.

    Sorting packed pixels sorts by position, and a stencil reads the luma of a
    neighbour with one array access. Positions must be below ``MAX_POSITION``.
    """
    luma = luma1000(r, g, b).cast("long")
    return (
        F.shiftleft(position.cast("long"), 50)
        + F.shiftleft(luma, 32)
        + pack_rgba(r, g, b, a)
    )


MAX_POSITION = 1 << 13


def packed_luma(packed: Column) -> Column:
    """The luma of a value packed by ``pack_at``: 255000 times the luma in 0..1."""
    return F.shiftright(packed, 32).bitwiseAND(F.lit((1 << 18) - 1)).cast("int")


def cells(count: Column) -> Column:
    """explode-able 0..count-1, empty for count <= 0."""
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


def dense(px: Column, count: Column) -> Column:
    """The array, if it has one entry per pixel; else an error: positions would shift."""
    return F.when(F.size(px) == count, px).otherwise(
        F.raise_error(F.concat(F.lit("image is not dense: "), F.col("image_id")))
    )
