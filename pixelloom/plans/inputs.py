"""The given tables, read as images, frames, requests and runs.

Every registered query starts here; all of them read whole tables.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions.columns import idiv
from pixelloom.operators.channels import ensure_rgba
from pixelloom.sources.generate import prompt_images

# The picture size of the pixel-level queries; not square, so swapped axes show.
GLYPH_W, GLYPH_H = 16, 12

# Nodes of the task in run order (task node, its place, tool node, its place).
GRAPH = (
    ("gen", 0, "signup", 0),
    ("spr", 1, "view", 0),
    ("spr", 1, "click", 1),
    ("spr", 1, "purchase", 2),
    ("spr", 1, "error", 3),
)

# Model listing used by the routing queries (adapter, priority, model, ops).
MODELS = (
    ("remote", 0, "model-0", ["text2img", "img2img"]),
    ("remote", 0, "model-1", ["text2vid"]),
    ("local", 1, "model-0", ["text2img"]),
    ("local", 1, "model-2", ["text2img", "img2img"]),
    ("spare", 2, "model-2", ["img2vid"]),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image request per part: the name as prompt, the key as seed."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("image_id"),
        F.col("p_name").alias("prompt"),
        F.col("p_partkey").alias("seed"),
        "p_size",
    )


def glyphs(spark: SparkSession, sf_dir: str, w: int = GLYPH_W, h: int = GLYPH_H) -> DataFrame:
    """A w x h picture of every part."""
    return prompt_images(part_prompts(spark, sf_dir), F.col("prompt"), F.col("seed"), w, h)


def gray_samples(spark: SparkSession, sf_dir: str, gain: float = 1.0) -> DataFrame:
    """Every embedding as an 8 x 8 picture of raw samples v; a gain above 1 leaves 0..255."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("image_id"),
        F.lit(8).alias("width"),
        F.lit(8).alias("height"),
        F.posexplode("embedding").alias("pos", "e"),
    ).select(
        "image_id", "width", "height",
        (F.col("pos") % 8).alias("x"),
        idiv(F.col("pos"), 8).cast("int").alias("y"),
        ((F.col("e").cast("double") * gain + 1.0) * 127.5).alias("v"),
    )


def cutouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 pictures with ragged content: samples above 160 are opaque, the rest nearly clear."""
    gray = ensure_rgba(gray_samples(spark, sf_dir), 1)
    return gray.withColumns(
        {
            "a": F.when(F.col("r") > 160, 255).otherwise(F.col("r") % 100),
            "g": 255 - F.col("r"),
            "b": (F.col("x") * 31 + F.col("y") * 17) % 256,
        }
    )


def line_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as animation frames: the order is the sequence, the part the picture."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("seq_id"),
        (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("frame_no"),
        F.col("l_partkey").cast("string").alias("image_id"),
    )


def part_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame sizes that depend on the part, so that some sequences do not fit together."""
    small = F.col("p_size") <= 40
    return part_prompts(spark, sf_dir).select(
        "image_id",
        "prompt",
        "seed",
        F.when(small, 4).otherwise(6).alias("width"),
        F.when(small, 3).otherwise(5).alias("height"),
    )


def sized_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of every part in the size of ``part_sizes``."""
    sizes = part_sizes(spark, sf_dir)
    small = sizes.filter(F.col("width") == 4)
    large = sizes.filter(F.col("width") == 6)
    return prompt_images(small, F.col("prompt"), F.col("seed"), 4, 3).unionByName(
        prompt_images(large, F.col("prompt"), F.col("seed"), 6, 5)
    )


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events as run events."""
    return as_run_events(table(spark, sf_dir, "events"))


def as_run_events(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", "queued")
        .when(kind == "purchase", "done")
        .when(kind == "error", "error")
        .otherwise("running")
    )
    return events.select(
        "event_id",
        F.col("user_id").cast("string").alias("run_id"),
        "ts",
        status.alias("status"),
        F.least(F.lit(1.0), F.col("value") / 500.0).alias("progress"),
        F.concat(F.lit("RuntimeError: "), F.col("props")).alias("message"),
    )


DELIVERIES = 4


def as_arrivals(events: DataFrame) -> DataFrame:
    """Run events with the delivery they come in: up to two hours late, in weeks of eight days."""
    lag = F.make_dt_interval(secs=(F.col("event_id") * 7919) % 7200)
    return events.withColumn("delivery", idiv(F.dayofmonth(F.col("ts") + lag), 8).cast("int"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream; the table may be one file or a folder of part files."""
    schema = table(spark, sf_dir, "events").schema
    # a pattern, as a stream refuses the plain path of a file
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def as_requests(events: DataFrame) -> DataFrame:
    """Events as generation requests; some name a model that does not serve the op."""
    kind = F.col("event_type")
    op = (
        F.when(kind.isin("view", "click"), "text2img")
        .when(kind == "purchase", "img2img")
        .when(kind == "signup", "text2vid")
        .otherwise("img2vid")
    )
    return events.select(
        F.col("event_id").cast("string").alias("request_id"),
        op.alias("op"),
        F.concat(F.lit("model-"), F.col("user_id") % 4).alias("model_id"),
        F.concat(kind, F.lit(" "), F.col("props")).alias("prompt"),
        F.col("user_id").alias("seed"),
    )


def models(spark: SparkSession) -> DataFrame:
    """The listing as a local relation: its size is known, so routing need not shuffle the requests."""
    columns = ("adapter", "priority", "model_id", "ops")
    listing = pa.table(dict(zip(columns, map(list, zip(*MODELS)))))
    return spark.createDataFrame(
        listing, "adapter string, priority int, model_id string, ops array<string>"
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as recorded runs with one artifact each: pairs, sheets and plain images."""
    flag = F.col("l_returnflag")
    part = F.col("l_partkey").cast("string")
    artifact = F.struct(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.when(flag == "R", "sprite_pair")
        .when(flag == "A", "sprite_sheet")
        .otherwise("image")
        .alias("kind"),
        F.when(flag != "N", F.concat(F.lit("d"), part)).alias("diffuse"),
        F.when(flag == "R", F.concat(F.lit("n"), part)).alias("normal"),
        F.when(flag == "N", F.concat(F.lit("i"), part)).alias("image"),
        F.when(flag == "A", F.col("l_linenumber")).alias("frames"),
        F.when(flag == "A", F.lit(4)).alias("frame_w"),
        F.when(flag == "A", F.lit(3)).alias("frame_h"),
        F.when(flag == "R", F.create_map(F.lit("status"), F.col("l_linestatus"))).alias("meta"),
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"),
        F.lit("single_sprite").alias("task"),
        F.create_map(F.lit("seed"), F.col("l_partkey").cast("string")).alias("params"),
        F.create_map().cast("map<string,string>").alias("choices"),
        F.array(artifact).alias("artifacts"),
    )
