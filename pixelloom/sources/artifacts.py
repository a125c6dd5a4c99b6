"""Storing artifacts, the run manifest, and finding what is missing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions.columns import dense, cells, channel, idiv, pack_rgba
from pixelloom.model import STORABLE_KINDS
from pixelloom.session import blowup_partitions
from pixelloom.sources import files

# Kinds with a diffuse and perhaps a normal file.
COMPOSED = ("sprite_pair", "sprite_sheet")

# Pixels per stored band: bounds a row of the store for an image of any size.
BAND_PIXELS = 1 << 16


def split_storable(artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Artifacts of a kind the sink stores, and the others with a reason."""
    known = F.coalesce(F.col("kind").isin(*STORABLE_KINDS), F.lit(False))
    rejected = artifacts.filter(~known).withColumn(
        "reason", F.concat(F.lit("ValueError: the store takes no "), F.coalesce("kind", F.lit("null")))
    )
    return artifacts.filter(known), rejected


def to_bands(pixels: DataFrame, *labels: str) -> DataFrame:
    """Pixel rows to bands of whole scanlines: (image_id, width, height, band, data as R,G,B,A).

    ``labels`` are further columns that tell apart pictures of one image.

    A band has at most ``BAND_PIXELS`` pixels (one scanline, if that is longer),
    so no image becomes one group. One packed long per pixel is collected
    map-side. A band with a missing pixel raises.
    """
    rows = F.greatest(F.lit(1), idiv(F.lit(BAND_PIXELS), F.col("width"))).cast("int")
    position = F.col("y").cast("long") * F.col("width") + F.col("x")
    color = pack_rgba(F.col("r"), F.col("g"), F.col("b"), F.col("a"))
    first = idiv(F.col("y"), rows) * rows * F.col("width")
    cut = pixels.select(
        "image_id", "width", "height", *labels,
        idiv(F.col("y"), rows).cast("int").alias("band"),
        F.shiftleft(position - first, 32).bitwiseOR(color).alias("pixel"),
    )
    height = F.least(rows, F.col("height") - F.col("band") * rows)
    expected = height.cast("long") * F.col("width")
    eight = lambda v: F.lpad(F.hex(v.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    return (
        cut.groupBy("image_id", "width", "height", *labels, "band")
        .agg(F.collect_list("pixel").alias("px"))
        .select(
            "image_id", "width", "height", *labels, "band",
            F.unhex(F.array_join(F.transform(dense(F.sort_array("px"), expected), eight), "")).alias("data"),
        )
    )


def from_bands(bands: DataFrame) -> DataFrame:
    """Bands back to pixel rows."""
    rows = F.greatest(F.lit(1), idiv(F.lit(BAND_PIXELS), F.col("width"))).cast("int")
    count = idiv(F.length("data"), 4).cast("int")

    color = F.conv(F.hex(F.substring(F.col("data"), F.col("i") * 4 + 1, F.lit(4))), 16, 10)
    return (
        bands.withColumn("i", F.explode(cells(count)))
        .withColumn("v", color.cast("long"))
        .select(
            "image_id", "width", "height",
            (F.col("i") % F.col("width")).alias("x"),
            (F.col("band") * rows + idiv(F.col("i"), F.col("width"))).cast("int").alias("y"),
            *[channel(F.col("v"), i).alias(c) for i, c in enumerate("rgba")],
        )
    )


def artifact_entries(artifacts: DataFrame, pixels: DataFrame) -> DataFrame:
    """Manifest entries: the file id of every layer, sheet geometry and meta.

    Pairs and sheets have a diffuse file and, if their pixels carry normals, a
    normal file; images and normal maps have one file. A file id is the image id
    and the layer.
    """
    with_normal = F.lit(False)
    rows = artifacts
    if "nr" in pixels.columns:
        # not a filter on nr: that would hold the whole formula of a normal several times, too long to be compiled
        shaded = (
            pixels.filter((F.col("x") == 0) & (F.col("y") == 0))
            .groupBy("image_id")
            .agg(F.bool_or(F.col("nr").isNotNull()).alias("with_normal"))
        )
        rows = artifacts.join(shaded, "image_id", "left")
        with_normal = F.coalesce("with_normal", F.lit(False))
    composed = F.col("kind").isin(*COMPOSED)
    file_id = lambda layer: F.concat(F.col("image_id"), F.lit(f"-{layer}"))
    extra = [c for c in ("frames", "frame_w", "frame_h") if c in artifacts.columns]
    return rows.select(
        F.col("image_id").alias("id"),
        "kind",
        F.when(composed, file_id("diffuse")).alias("diffuse"),
        F.when(composed & with_normal, file_id("normal")).alias("normal"),
        F.when(~composed, file_id("image")).alias("image"),
        *extra,
        "meta",
    )


def artifact_layers(artifacts: DataFrame, pixels: DataFrame) -> DataFrame:
    """Pixels of every file to store, with ``kind`` and ``layer`` per row.

    Diffuse and normal of a pixel come out of one pass over the pixels; normal
    maps gain alpha 255.
    """
    composed = F.col("kind").isin(*COMPOSED)
    color = F.struct(
        F.when(composed, "diffuse").otherwise("image").alias("layer"), "r", "g", "b", "a"
    )
    layers = F.array(F.when(F.col("kind") != "normal_map", color))
    if "nr" in pixels.columns:
        normal = F.struct(
            F.when(composed, "normal").otherwise("image").alias("layer"),
            F.col("nr").alias("r"),
            F.col("ng").alias("g"),
            F.col("nb").alias("b"),
            F.lit(255).alias("a"),
        )
        stored = F.col("nr").isNotNull() & F.col("kind").isin(*COMPOSED, "normal_map")
        layers = F.array(F.when(F.col("kind") != "normal_map", color), F.when(stored, normal))
    return (
        pixels.join(artifacts.select("image_id", "kind"), "image_id")
        .select(
            "image_id", "width", "height", "x", "y", "kind",
            F.explode(layers).alias("one"),
        )
        .filter(F.col("one").isNotNull())
        .select("image_id", "width", "height", "x", "y", "kind", "one.*")
    )


def write_artifacts(
    artifacts: DataFrame, pixels: DataFrame, path: str, mode: str = "append"
) -> DataFrame:
    """Store artifacts as Parquet under ``path`` and return the rejected ones.

    ``artifacts``: image_id, kind, meta and, for sheets, frames, frame_w,
    frame_h. ``pixels``: pixel rows, with nr, ng, nb where an artifact has a
    normal. Entries (file ids, geometry, meta) go to ``entries`` and pixel bands
    to ``bands``, both partitioned by kind.
    """
    storable, rejected = split_storable(artifacts)
    entries = artifact_entries(storable, pixels)
    entries.write.mode(mode).partitionBy("kind").parquet(f"{path}/entries")
    bands = to_bands(artifact_layers(storable, pixels), "kind", "layer")
    bands.write.mode(mode).partitionBy("kind").parquet(f"{path}/bands")
    return rejected


def write_png(pixels: DataFrame, path: str, partitions: int | None = None) -> None:
    """One ``<image_id>.png`` per image under ``path``, a folder all executors see."""
    _write_bands(to_bands(pixels), path, partitions)


def encode_png(pixels: DataFrame) -> DataFrame:
    """image_id, png: every image as one PNG value, for payloads and model inputs.

    Bands meet in the task of their image in order and are packed one by one;
    the file itself is one value, so its size must suit a row.
    """
    bands = to_bands(pixels).repartition("image_id").sortWithinPartitions("image_id", "band")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pixelloom.functions.png import png_parts

        rows = (row for batch in batches for row in batch.to_pylist())
        for (name, width, height), same in groupby(rows, key=lambda r: (r["image_id"], r["width"], r["height"])):
            png = b"".join(png_parts(width, height, (r["data"] for r in same)))
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([png], pa.binary())], ["image_id", "png"])

    return bands.mapInArrow(encode, "image_id string, png binary")


def export_png(spark: SparkSession, store: str, path: str, partitions: int | None = None) -> None:
    """A PNG file per stored layer, named by its file id."""
    bands = spark.read.parquet(f"{store}/bands")
    named = bands.withColumn("image_id", F.concat_ws("-", "image_id", "layer"))
    _write_bands(named.select("image_id", "width", "height", "band", "data"), path, partitions)


def _write_bands(bands: DataFrame, path: str, partitions: int | None) -> None:
    """Write bands as PNG files.

    Images are spread by id and arrive as sorted bands; a task compresses one
    band at a time, so memory is bounded by a band, not by the image. A file is
    written in a hidden folder of its task and then moved, which makes a retried
    task harmless; the move is the only change of the common folder, which takes
    the changes of all tasks one by one.
    """
    n = partitions or blowup_partitions(bands.sparkSession)
    ordered = bands.repartition(n, "image_id").sortWithinPartitions("image_id", "band")

    def write(rows: Iterator) -> None:
        import itertools
        import uuid

        from pyarrow import fs

        from pixelloom.functions.png import png_parts

        target, folder = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        own = f"{folder}/.{uuid.uuid4().hex}"
        target.create_dir(own, recursive=True)
        try:
            for image_id, group in itertools.groupby(rows, key=lambda row: row["image_id"]):
                first = next(group)
                data = (bytes(row["data"]) for row in itertools.chain([first], group))
                with target.open_output_stream(f"{own}/part") as out:
                    for piece in png_parts(first["width"], first["height"], data):
                        out.write(piece)
                target.move(f"{own}/part", f"{folder}/{image_id}.png")
        finally:
            target.delete_dir(own)

    ordered.foreachPartition(write)


def append_manifest(runs: DataFrame, path: str) -> None:
    """Append run rows (run_id, task, params, choices, artifacts); concurrent runs never rewrite it."""
    runs.write.mode("append").parquet(path)


def manifest_results(manifest: DataFrame) -> DataFrame:
    """One result row per artifact: URLs, sheet geometry and meta (empty map if none).

    ``artifacts`` is an array of structs with id, kind, diffuse, normal, image,
    frames, frame_w, frame_h, meta; ``pos`` is the place in it.
    """
    rows = manifest.select("run_id", F.posexplode("artifacts").alias("pos", "artifact"))
    url = lambda field: F.when(
        F.col(f"artifact.{field}").isNotNull(),
        F.concat(F.lit("/api/artifacts/"), F.col(f"artifact.{field}")),
    )
    return rows.select(
        "run_id",
        "pos",
        F.col("artifact.id").alias("id"),
        F.col("artifact.kind").alias("kind"),
        url("diffuse").alias("diffuse_url"),
        url("normal").alias("normal_url"),
        url("image").alias("url"),
        *[F.col(f"artifact.{c}").alias(c) for c in ("frames", "frame_w", "frame_h")],
        F.coalesce(F.col("artifact.meta"), F.create_map().cast("map<string,string>")).alias("meta"),
    )


def stored_files(spark: SparkSession, path: str, suffix: str = "png") -> DataFrame:
    """Ids of the stored image files: names only, contents are not read.

    A task lists the names of a folder; Spark's file source, which holds them on
    the driver, lists patterns and other stores.
    """
    folder = files.local_folder(path)
    if folder:
        found = files.listed(spark, folder, f".{suffix}", recursive=False)
    else:
        found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(path)
    # by cuts from the right: a regular expression would be tried from every letter of the path
    name = F.substring_index("path", "/", -1)
    end = F.length(name) - F.length(F.substring_index(name, ".", -1)) - 1
    return found.select(F.when(end > 0, F.left(name, end)).otherwise(name).alias("file_id"))


def missing_artifacts(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(run_id, id, role, file_id) of manifest entries without a stored file."""
    entries = manifest.select("run_id", F.explode("artifacts").alias("artifact"))
    roles = F.array(
        *[
            F.struct(F.lit(role).alias("role"), F.col(f"artifact.{role}").alias("file_id"))
            for role in ("diffuse", "normal", "image")
        ]
    )
    named = entries.select("run_id", F.col("artifact.id").alias("id"), F.inline(roles)).filter(
        F.col("file_id").isNotNull()
    )
    return named.join(files.select("file_id"), "file_id", "left_anti")
