"""Image files and inference payloads as pixel rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions.columns import cells
from pixelloom.model import PIXEL
from pixelloom.sources import files

DECODED_SCHEMA = "image_id string, width int, height int, data binary, reason string"
DECODED = pa.schema(
    [("image_id", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary()), ("reason", pa.string())]
)
PAYLOAD_SCHEMA = "png_b64 string, rgba array<int>, w int, h int"


def _rows_of(blobs: DataFrame, order: str = "bgra") -> DataFrame:
    """Blob rows (image_id, width, height, channels, data as B,G,R[,A] or in ``order``) to pixel rows.

    Two nested explodes of row and column numbers; the blob stays one value and
    is sliced per scanline first, so a pixel reads from a short binary.
    """
    lines = blobs.withColumn("y", F.explode(cells(F.col("height")))).withColumn(
        "line",
        F.substring(
            F.col("data"),
            F.col("y") * F.col("width") * F.col("channels") + 1,
            F.col("width") * F.col("channels"),
        ),
    )
    # The samples of a pixel as one number, first sample in the highest byte.
    samples = F.substring(F.col("line"), F.col("x") * F.col("channels") + 1, F.col("channels"))
    value = F.conv(F.hex(samples), 16, 10).cast("long")

    def sample(index: int) -> Column:
        shift = 8 * (F.col("channels") - 1 - index)
        return F.call_function("shiftright", F.col("v"), shift).bitwiseAND(F.lit(255)).cast("int")

    gray = F.col("channels") == 1
    return (
        lines.drop("data")
        .withColumn("x", F.explode(cells(F.col("width"))))
        .withColumn("v", value)
        .select(
            "image_id", "width", "height", "x", "y",
            *[F.when(gray, sample(0)).otherwise(sample(order.index(c))).alias(c) for c in "rgb"],
            F.when(F.col("channels") == 4, sample(3)).otherwise(F.lit(255)).alias("a"),
        )
    )


def _image_id(path: str, origin: Column) -> Column:
    """A file's name below the folder ``path``, without extension; the base name where the folder is not in it (as for a glob)."""
    folder = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path).rstrip("/") + "/"
    at = F.locate(folder, origin)
    name = F.when(at > 0, F.substring(origin, at + len(folder), F.length(origin))).otherwise(
        F.regexp_extract(origin, r"([^/]+)$", 1)
    )
    return F.regexp_replace(name, r"(?<=[^/])\.[^./]*$", "")


def read_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pixels and images of the PNG files under ``path``.

    The id is the file's path below ``path`` without its extension, so files of
    one name in different folders stay apart. Files that cannot be decoded are
    listed in the image table with kind ``invalid``, files that would share an
    id with kind ``double``; both have no pixels. Names are listed before,
    without reading the files, so pictures are joined with the list of shared
    ids only where there is one.

    A folder is listed and its plain PNGs (``functions.png.is_plain``) are decoded
    by tasks. Files of other forms, and a ``path`` that is no folder of the
    executors, go to Spark's image source, whose driver holds the list of files.
    """
    folder = files.local_folder(path)
    if folder:
        names = files.listed(spark, folder)
        listed = names.select(_image_id(folder, F.col("path")).alias("image_id"))
        found = _decoded(spark, path, folder, names)
    else:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(_image_id(path, F.col("path")).alias("image_id"))
        found = _by_source(spark, path)
    doubles = listed.groupBy("image_id").count().filter("count > 1").select("image_id", F.lit(True).alias("double"))
    if doubles.isEmpty():
        judged = found.withColumn("double", F.lit(None).cast("boolean"))
    else:
        judged = found.join(doubles, "image_id", "left")
    valid = (F.col("width") > 0) & (F.col("height") > 0)
    blobs = judged.filter(valid & F.col("double").isNull()).select("image_id", "width", "height", "channels", "data")
    images = judged.select(
        "image_id",
        "width",
        "height",
        F.when(F.col("double"), "double").when(valid, "image").otherwise("invalid").alias("kind"),
        F.create_map(F.lit("origin"), F.col("origin")).alias("meta"),
    )
    return _rows_of(blobs), images


def _by_source(spark: SparkSession, path: str) -> DataFrame:
    """The files under ``path`` as Spark's image source decodes them."""
    return (
        spark.read.format("image")
        .option("dropInvalid", "false")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("image.*")
        # the image source gives names in URL encoding, where "+" stands for itself
        .withColumn("origin", F.url_decode(F.replace("origin", F.lit("+"), F.lit("%2B"))))
        .select(_image_id(path, F.col("origin")).alias("image_id"), "origin", "width", "height", F.col("nChannels").alias("channels"), "data")
    )


def _decoded(spark: SparkSession, path: str, folder: str, names: DataFrame) -> DataFrame:
    """The listed files, plain PNGs decoded in the tasks that read them."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pixelloom.functions.png import decode_png, is_plain

        for batch in batches:
            rows = []
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                with suppress(Exception):  # Spark's image source judges what is not decoded here
                    if is_plain(data):
                        image = decode_png(data)
                        rows.append((name, image.shape[1], image.shape[0], image[..., [2, 1, 0, 3]].tobytes()))
                        continue
                rows.append((name, None, None, None))
            columns = zip(*rows) if rows else ((), (), (), ())
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "width", "height", "data"])

    decoded = files.contents(names).mapInArrow(decode, "path string, width int, height int, data binary")
    plain = decoded.filter(F.col("width").isNotNull()).select(
        _image_id(folder, F.col("path")).alias("image_id"), F.concat(F.lit("file://"), "path").alias("origin"),
        "width", "height", F.lit(4).alias("channels"), "data",
    )
    others = decoded.filter(F.col("width").isNull()).select(F.concat(F.lit("file://"), "path").alias("origin"))
    if others.isEmpty():
        return plain
    return plain.unionByName(_by_source(spark, path).join(others, "origin", "left_semi").select(*plain.columns))


def decode_payload(outputs: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Inference output texts to pixels: ``{"rgba", "w", "h"}`` or ``{"png_b64"}``.

    ``outputs`` has image_id and the JSON text. ``rgba`` is flat and row-major.
    Anything else, also a list whose length is not 4*w*h, is rejected with a
    reason. The flat list is cut by built-ins; PNG bytes are decoded in Arrow
    batches.
    """
    parsed = outputs.select(
        "image_id", F.from_json(F.col(column), PAYLOAD_SCHEMA).alias("p")
    ).select("image_id", "p.*")
    is_png = F.col("png_b64").isNotNull()
    is_raw = F.coalesce(
        F.size("rgba") == 4 * F.col("w") * F.col("h"), F.lit(False)
    ) & F.coalesce(F.forall("rgba", lambda v: v.between(0, 255)), F.lit(False))
    raw = parsed.filter(~is_png & is_raw)
    at = (F.col("y") * F.col("w") + F.col("x")) * 4
    from_raw = (
        raw.withColumn("y", F.explode(cells(F.col("h"))))
        .withColumn("x", F.explode(cells(F.col("w"))))
        .select(
            "image_id",
            F.col("w").alias("width"),
            F.col("h").alias("height"),
            "x", "y",
            *[F.get("rgba", at + i).alias(c) for i, c in enumerate("rgba")],
        )
    )
    decoded = decode_png_rows(
        parsed.filter(is_png).select("image_id", F.try_to_binary("png_b64", F.lit("base64")).alias("png"))
    )
    good = decoded.filter(F.col("reason").isNull()).select(
        "image_id", "width", "height", F.lit(4).alias("channels"), "data"
    )
    unknown = parsed.filter(~is_png & ~is_raw).select(
        "image_id", F.lit("ValueError: unrecognized image payload").alias("reason")
    )
    bad = decoded.filter(F.col("reason").isNotNull()).select("image_id", "reason")
    pixels = from_raw.unionByName(_rows_of(good)).select(*PIXEL)
    return pixels, unknown.unionByName(bad)


def decode_outputs(results: DataFrame, column: str = "output") -> tuple[DataFrame, DataFrame]:
    """Pixels of model outputs (request_id, struct of png, rgba, w, h), and the outputs that hold no picture.

    ``rgba`` are 4 * w * h row-major bytes; a PNG is used where there is one. The
    image_id is the request_id.
    """
    taken = results.select(F.col("request_id").alias("image_id"), f"{column}.*")
    flat = F.coalesce(F.octet_length("rgba") == 4 * F.col("w") * F.col("h"), F.lit(False))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pixelloom.functions.png import decode_png

        for batch in batches:
            held, size = [], 0
            for row in batch.to_pylist():
                out = {"image_id": row["image_id"]}
                try:
                    if row["png"] is not None:
                        image = decode_png(row["png"])
                        out |= {"width": image.shape[1], "height": image.shape[0], "data": image.tobytes()}
                    elif row["flat"]:
                        out |= {"width": row["w"], "height": row["h"], "data": row["rgba"]}
                    else:
                        raise ValueError("no picture of 4 * w * h bytes")
                    size += len(out["data"])
                except Exception as error:  # a bad output is a row, not a failed job
                    out["reason"] = f"{type(error).__name__}: {error}"
                held.append(out)
                if size >= files.BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema=DECODED)
                    held, size = [], 0
            yield pa.RecordBatch.from_pylist(held, schema=DECODED)

    # both forms in one pass: the models before it run once
    decoded = taken.select("image_id", "png", "rgba", "w", "h", flat.alias("flat")).mapInArrow(decode, DECODED_SCHEMA)
    good = decoded.filter(F.col("reason").isNull()).select("image_id", "width", "height", F.lit(4).alias("channels"), "data")
    pixels = _rows_of(good, "rgba").select(*PIXEL)
    return pixels, decoded.filter(F.col("reason").isNotNull()).select("image_id", "reason")


def decode_png_rows(rows: DataFrame) -> DataFrame:
    """(image_id, png) to size and B,G,R,A bytes, or the reason it cannot be decoded."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pixelloom.functions.png import decode_png

        for batch in batches:
            held, size = [], 0
            for name, png in zip(batch.column("image_id").to_pylist(), batch.column("png")):
                row = {"image_id": name, "width": None, "height": None, "data": None, "reason": None}
                try:
                    if not png.is_valid:
                        raise ValueError("not base64")
                    image = decode_png(png.as_py())
                    row["height"], row["width"] = image.shape[:2]
                    row["data"] = image[..., [2, 1, 0, 3]].tobytes()
                    size += len(row["data"])
                except Exception as error:  # a bad payload is a row, not a failed job
                    row["reason"] = f"{type(error).__name__}: {error}"
                held.append(row)
                if size >= files.BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema=DECODED)
                    held, size = [], 0
            yield pa.RecordBatch.from_pylist(held, schema=DECODED)

    return rows.mapInArrow(decode, DECODED_SCHEMA)
