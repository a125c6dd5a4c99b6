"""Composite pipelines: raw image to sprite pair, prompt to sprite pair, animation sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.columns import cells, channel, floor_half, packed_luma
from pixelloom.model import NORMAL, PIXEL
from pixelloom.operators.normals import AROUND, encode_normals, normal_estimate, sobel
from pixelloom.operators.palette import quantized_grids
from pixelloom.operators.resample import box_downsample
from pixelloom.operators.sheets import pack_sheet
from pixelloom.sources.generate import prompt_images


def spritify(
    pixels: DataFrame,
    width: int | Column = 96,
    height: int | Column = 96,
    grid_w: int | Column = 64,
    grid_h: int | Column = 64,
    colors: int | Column = 32,
    strength: float = 2.0,
) -> DataFrame:
    """pixelize -> crop -> align (bottom centre) -> normals -> pair, as one plan.

    Same result as chaining the operators. After the area average an image has
    at most grid_w*grid_h cells, a parameter, so one row per image holds them;
    cropping, aligning and the stencil are then array reads on the exploded
    canvas, with no join or sort. Cropping and aligning use the same threshold,
    and an image without content passes both whole, so the crop needs no step.
    An image with empty cells raises. Sizes and colours may be columns of the
    pixel rows, constant per image, so every image has its own; they go through
    the area average as constants of the image, not through a join.
    """
    given = {"sprite_w": width, "sprite_h": height, "palette_n": colors}
    own = {n: v.cast("int") for n, v in given.items() if isinstance(v, Column)}
    keep = tuple(own)
    gw, gh = (
        F.greatest(F.lit(1), n) if isinstance(n, Column) else max(1, int(n)) for n in (grid_w, grid_h)
    )
    small = box_downsample(pixels.withColumns(own) if own else pixels, gw, gh, keep)
    carried = tuple(n for n in keep if n != "palette_n")
    grids = quantized_grids(small, "palette_n" if "palette_n" in own else colors, carried)
    w, h = (
        F.greatest(F.lit(1), F.col(n)) if n in own else F.lit(max(1, int(given[n])))
        for n in ("sprite_w", "sprite_h")
    )
    whole = {"x0": F.lit(0), "y0": F.lit(0), "x1": F.col("width"), "y1": F.col("height")}
    cw, ch = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    placed = grids.withColumns({k: F.coalesce(F.col(k), v) for k, v in whole.items()}).select(
        "image_id",
        "px",
        F.col("width").alias("grid_w"),
        "x0", "y0",
        cw.alias("cw"),
        ch.alias("ch"),
        floor_half(w - cw).alias("ox"),
        (h - ch).alias("oy"),
        *carried,
    )
    canvas = placed.withColumn("y", F.explode(cells(h))).withColumn("x", F.explode(cells(w)))

    def at(dx: int, dy: int) -> Column:
        """Packed canvas pixel at (x+dx, y+dy), edges replicated; 0 outside the content."""
        nx, ny = F.col("x"), F.col("y")
        if dx:
            nx = F.least(F.greatest(nx + dx, F.lit(0)), w - 1)
        if dy:
            ny = F.least(F.greatest(ny + dy, F.lit(0)), h - 1)
        u, v = nx - F.col("ox"), ny - F.col("oy")
        covered = (u >= 0) & (u < F.col("cw")) & (v >= 0) & (v < F.col("ch"))
        index = (v + F.col("y0")) * F.col("grid_w") + u + F.col("x0")
        return F.when(covered, F.get(F.col("px"), index)).otherwise(F.lit(0).cast("long"))

    read = canvas.withColumns(
        {f"h{i}": packed_luma(at(dx, dy)) for i, (dx, dy) in enumerate(AROUND)} | {"v": at(0, 0)}
    )
    index = {d: i for i, d in enumerate(AROUND)}
    gx, gy = sobel(lambda dx, dy: F.col(f"h{index[dx, dy]}"))
    graded = read.select(
        "image_id",
        w.alias("width"),
        h.alias("height"),
        "x", "y",
        *[channel(F.col("v"), i).alias(c) for i, c in enumerate("rgba")],
        gx.alias("gx"),
        gy.alias("gy"),
    )
    return encode_normals(graded, strength).select(*PIXEL, *NORMAL)


def single_sprite(
    requests: DataFrame,
    prompt: Column,
    seed: Column,
    render: int | Column = 512,
    width: int | Column = 96,
    height: int | Column = 96,
    grid_w: int | Column = 64,
    grid_h: int | Column = 64,
    colors: int | Column = 32,
) -> DataFrame:
    """Prompt to sprite pair: render a square picture, then ``spritify``.

    The request rows are shuffled once (before the pixels exist); every later
    step of an image runs in the task that rendered it. Every size may be a
    column of the requests, as ``operators.requests.integer_params`` gives them.
    """
    sizes = {"to_w": width, "to_h": height, "to_grid_w": grid_w, "to_grid_h": grid_h, "to_colors": colors}
    own = {n: v for n, v in sizes.items() if isinstance(v, Column)}
    side = {"to_render": render} if isinstance(render, Column) else {}
    asked = requests.withColumns({**own, **side, "to_prompt": prompt, "to_seed": seed})
    render = F.col("to_render") if side else render
    images = prompt_images(asked, F.col("to_prompt"), F.col("to_seed"), render, render, keep=tuple(own))
    return spritify(images, *(F.col(n) if n in own else v for n, v in sizes.items()))


def candidate_batch(
    prompts: DataFrame, n: int, width: int = 512, height: int = 512
) -> tuple[DataFrame, DataFrame]:
    """n seeds per prompt: the unordered batch members and their pixels.

    ``prompts`` has batch_id and prompt. An image is ``batch_id#seed``.
    """
    requests = prompts.select(
        F.col("batch_id").cast("string").alias("batch_id"),
        "prompt",
        F.explode(cells(F.lit(int(n)))).alias("seed"),
    ).withColumn("image_id", F.concat_ws("#", "batch_id", "seed"))
    members = requests.select("batch_id", "image_id")
    return members, prompt_images(requests, F.col("prompt"), F.col("seed"), width, height)


def animation_sheet(
    frames: DataFrame, pixels: DataFrame, strength: float = 2.0, order_column: str = "frame_no"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Normals per frame, then diffuse and normal strips of the same layout.

    Every distinct image is shaded once, before the frames that use it are laid
    out. Returns sheets, sheet pixels (diffuse and normal) and rejected sequences.
    """
    return pack_sheet(frames, normal_estimate(pixels, strength), order_column)
