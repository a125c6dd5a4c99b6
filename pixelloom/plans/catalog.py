"""The registered queries: one per operator, over the given tables."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions.columns import idiv
from pixelloom.model import (
    NORMAL,
    PIXEL,
    SINGLE_SPRITE_PARAMS,
    images_of,
    with_meta,
)
from pixelloom.operators import (
    channels,
    extension,
    geometry,
    normals,
    pairs,
    palette,
    quality,
    requests,
    resample,
    runs,
    sheets,
)
from pixelloom.plans import inputs, sprites
from pixelloom.plans.pattern_model import InvertModel, PatternModel
from pixelloom.session import blowup_partitions, checkpoint_dir, ship_package
from pixelloom.sources import artifacts, files, images
from pixelloom.sources.generate import prompt_images
from pixelloom.streaming import generation
from pixelloom.streaming import runs as run_streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register under the name of the function; the workers get the package first."""

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def workplace(spark: SparkSession, name: str) -> str:
    """A new folder of its own inside the shared checkpoint folder of the session."""
    return f"{checkpoint_dir(spark).rstrip('/')}/pixelloom/{name}-{uuid.uuid4().hex}"


def digest(pixels: DataFrame, *values: str, key: str = "image_id") -> DataFrame:
    """One row per image: pixel count and a position-weighted checksum of the channels."""
    weight = (F.col("x").cast("long") + 1) * 31 + (F.col("y").cast("long") + 1) * 1009
    mixed = F.lit(0).cast("long")
    for i, name in enumerate(values):
        mixed = mixed + F.col(name) * F.lit((3, 7, 13, 29, 53, 97, 193)[i])
    return pixels.groupBy(key).agg(
        F.count(F.lit(1)).alias("pixels"), F.sum(weight * (mixed + 1)).alias("checksum")
    )


# --- sources and sinks ------------------------------------------------------


@query
def prompt_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.glyphs(spark, sf_dir)


@query
def prompt_glyphs_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("image_id"), "text"
    )
    return prompt_images(docs, F.col("text"), 7, 5, 4)


@query
def read_png_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workplace(spark, "png")
    artifacts.write_png(inputs.glyphs(spark, sf_dir), folder)
    return images.read_images(spark, folder)[0]


@query
def png_image_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workplace(spark, "png")
    artifacts.write_png(inputs.sized_glyphs(spark, sf_dir), folder)
    return images.read_images(spark, folder)[1].select("image_id", "width", "height", "kind")


@query
def decode_png_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workplace(spark, "png")
    artifacts.write_png(inputs.sized_glyphs(spark, sf_dir), folder)
    payloads = files.contents(files.listed(spark, folder)).select(
        F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("image_id"),
        F.to_json(F.struct(F.base64("content").alias("png_b64"))).alias("payload"),
    )
    return images.decode_payload(payloads)[0]


def _vector_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as inference outputs: flat RGBA lists, or something else for odd labels."""
    samples = F.transform(
        "embedding",
        lambda e: F.floor(F.least(F.greatest((e.cast("double") + 1.0) * 127.5, F.lit(0.0)), F.lit(255.0))).cast("int"),
    )
    payload = F.to_json(F.struct(samples.alias("rgba"), F.lit(8).alias("w"), F.lit(2).alias("h")))
    return inputs.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("image_id"),
        F.when(F.col("label") % 2 == 0, payload)
        .otherwise(F.concat(F.lit('{"frames": '), F.col("label"), F.lit("}")))
        .alias("payload"),
    )


@query
def decode_rgba_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.decode_payload(_vector_payloads(spark, sf_dir))[0]


@query
def decode_payload_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.decode_payload(_vector_payloads(spark, sf_dir))[1]


def _stored(spark: SparkSession, sf_dir: str) -> str:
    folder = workplace(spark, "artifacts")
    shaded = normals.normal_estimate(inputs.sized_glyphs(spark, sf_dir))
    kinds = inputs.part_prompts(spark, sf_dir).select(
        "image_id",
        F.element_at(
            F.array(*[F.lit(k) for k in ("image", "normal_map", "sprite_pair", "sprite_sheet", "mask", "palette")]),
            (F.col("seed") % 6 + 1).cast("int"),
        ).alias("kind"),
        F.create_map(F.lit("prompt"), F.col("prompt")).alias("meta"),
    )
    artifacts.write_artifacts(kinds, shaded, folder, mode="overwrite")
    return folder


@query
def stored_artifact_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.read.parquet(f"{_stored(spark, sf_dir)}/bands")
    pixels = artifacts.from_bands(
        bands.withColumn("image_id", F.concat_ws("/", "kind", "layer", "image_id"))
    )
    return digest(pixels, "r", "g", "b", "a")


@query
def stored_artifact_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.read.parquet(f"{_stored(spark, sf_dir)}/entries")
    return entries.select(
        F.col("id").alias("image_id"), "kind", F.col("meta")["prompt"].alias("prompt")
    )


@query
def stored_layer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, folder = _stored(spark, sf_dir), workplace(spark, "png")
    artifacts.export_png(spark, store, folder)
    # Stored manifest entries, and whether each of their files exists.
    entries = spark.read.parquet(f"{store}/entries")
    recorded = entries.select(
        F.lit("run").alias("run_id"), F.array(F.struct("id", "kind", "diffuse", "normal", "image")).alias("artifacts")
    )
    gone = artifacts.missing_artifacts(recorded, artifacts.stored_files(spark, folder))
    return artifacts.stored_files(spark, folder).select("file_id", F.lit(False).alias("missing")).unionByName(
        gone.select("file_id", F.lit(True).alias("missing"))
    )


@query
def unstorable_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = inputs.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("image_id"),
        F.when(F.col("l_returnflag") == "N", "image_batch")
        .when(F.col("l_linestatus") == "O", "frame_seq")
        .otherwise("image")
        .alias("kind"),
    )
    return artifacts.split_storable(kinds)[1].groupBy("kind", "reason").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def manifest_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workplace(spark, "manifest")
    runs_ = inputs.manifest(spark, sf_dir)
    pair = F.get("artifacts", F.lit(0))["kind"] == "sprite_pair"
    artifacts.append_manifest(runs_.filter(pair), folder)
    artifacts.append_manifest(runs_.filter(~pair), folder)
    return (
        spark.read.parquet(folder)
        .groupBy("run_id", "task")
        .agg(F.count(F.lit(1)).alias("runs"), F.sum(F.size("artifacts")).alias("artifacts"))
    )


@query
def manifest_result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = artifacts.manifest_results(inputs.manifest(spark, sf_dir))
    return rows.withColumns(
        {"meta_status": F.col("meta")["status"], "meta_entries": F.size("meta")}
    ).drop("meta")


@query
def missing_artifact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Files exist for the larger parts; normals only for the largest.
    size = F.col("p_size")
    files = inputs.part_prompts(spark, sf_dir).select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(size > 10, F.concat(F.lit("d"), F.col("image_id"))),
                    F.when(size > 10, F.concat(F.lit("i"), F.col("image_id"))),
                    F.when(size > 30, F.concat(F.lit("n"), F.col("image_id"))),
                )
            )
        ).alias("file_id")
    )
    return artifacts.missing_artifacts(inputs.manifest(spark, sf_dir), files)


# --- projections, filters, scalar functions ------------------------------------


@query
def ensure_rgba_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.ensure_rgba(inputs.gray_samples(spark, sf_dir, gain=6.0), 1)


@query
def ensure_rgba_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = inputs.gray_samples(spark, sf_dir, gain=6.0)
    rgb = raw.withColumns({"r": F.col("v"), "g": 255.0 - F.col("v"), "b": F.col("v") * 0.5}).drop("v")
    return channels.ensure_rgba(rgb, 3)


@query
def ensure_rgba_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = inputs.gray_samples(spark, sf_dir, gain=6.0)
    rgba = raw.withColumns(
        {"r": F.col("v"), "g": 255.0 - F.col("v"), "b": F.col("v") * 0.5, "a": F.col("v") + 100.5}
    ).drop("v")
    return channels.ensure_rgba(rgba, 4)


@query
def hard_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    soft = inputs.cutouts(spark, sf_dir).withColumn("a", F.col("r"))
    return channels.hard_alpha(soft)


@query
def content_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.content_mask(inputs.cutouts(spark, sf_dir))


@query
def content_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.content_pixels(inputs.glyphs(spark, sf_dir))


@query
def luminance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.luminance(inputs.glyphs(spark, sf_dir)).select("image_id", "x", "y", "luma")


@query
def nearest_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.nearest_resize(inputs.glyphs(spark, sf_dir), 11, 17)


@query
def integer_upscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.upscale(inputs.cutouts(spark, sf_dir), 3)


@query
def prompt_retint(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = inputs.part_prompts(spark, sf_dir).filter(F.col("p_size") > 5).select("image_id", "prompt")
    return channels.retint(inputs.glyphs(spark, sf_dir), prompts)


@query
def display_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = inputs.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("image_id"),
        (F.col("p_size") * 7).alias("width"),
        (F.col("p_partkey") % 97 + 1).cast("int").alias("height"),
    )
    return geometry.display_scale(sizes)


def _param_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a command-line parameter text, of every type."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    text = (
        F.when(kind == "view", F.concat(F.lit("seed="), user))
        .when(kind == "click", F.concat(F.lit("strength="), F.col("value").cast("string")))
        .when((kind == "purchase") & (F.col("user_id") % 2 == 0), F.lit("normal=TRUE"))
        .when(kind == "purchase", F.concat(F.lit("prompt=a="), F.col("props")))
        .when((kind == "signup") & (F.col("user_id") % 2 == 0), F.concat(F.lit("seed= -"), user, F.lit(" ")))
        .when(kind == "signup", F.concat(F.lit("scale=."), user, F.lit("e1")))
        .when(F.col("user_id") % 3 == 0, F.concat(F.lit("="), user))
        .otherwise(F.concat(F.lit("no value "), user))
    )
    return inputs.table(spark, sf_dir, "events").select("event_id", text.alias("text"))


@query
def parsed_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.parse_params(_param_texts(spark, sf_dir), "text")[0]


@query
def parsed_param_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.parse_params(_param_texts(spark, sf_dir), "text")[1]


# --- aggregations ---------------------------------------------------------------


@query
def box_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    soft = inputs.glyphs(spark, sf_dir).withColumn("a", F.least(F.col("a"), F.col("r") + F.col("x")))
    return resample.box_downsample(soft, 7, 5)


@query
def box_resample_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One axis shrinks, the other grows.
    return resample.box_downsample(inputs.cutouts(spark, sf_dir), 5, 11)


@query
def pixelize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palette.pixelize(inputs.glyphs(spark, sf_dir), 8, 6, 6)


@query
def pixelize_upscaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palette.pixelize(inputs.cutouts(spark, sf_dir), 6, 5, 4, upscale_by=2)


@query
def pixel_perfect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.pixel_perfect(inputs.cutouts(spark, sf_dir), 3)


@query
def alpha_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.alpha_bbox(inputs.cutouts(spark, sf_dir)).select("image_id", *geometry.BOUNDS)


@query
def quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palette.quantize(inputs.glyphs(spark, sf_dir), 6)


@query
def image_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = palette.palette(palette.pixelize(inputs.glyphs(spark, sf_dir), 8, 6, 6))
    return ranked.withColumn("palette_ix", F.col("palette_ix").cast("int"))


@query
def image_color_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palette.color_counts(inputs.glyphs(spark, sf_dir))


@query
def declared_image_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third picture is not stored, every fourth not declared."""
    stored = inputs.glyphs(spark, sf_dir, 5, 3).filter(F.col("image_id").cast("long") % 3 != 0)
    declared = inputs.part_prompts(spark, sf_dir).filter(F.col("seed") % 4 != 0).select(
        "image_id", F.lit(5).alias("width"), F.lit(3).alias("height")
    )
    return quality.check_images(stored, declared)


@query
def image_color_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = inputs.glyphs(spark, sf_dir)
    sketched = palette.color_estimates(palette.color_sketches(pixels))
    return palette.color_counts(pixels).join(sketched, "image_id").select(
        "image_id", "colors", (F.abs(F.col("estimate") - F.col("colors")) <= F.greatest(F.lit(1.0), 0.05 * F.col("colors"))).alias("close")
    )


@query
def image_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Some images are damaged: a hole, a doubled pixel, or a value out of range.
    size = F.col("seed") % 5
    damaged = inputs.glyphs(spark, sf_dir, 6, 4).join(
        inputs.part_prompts(spark, sf_dir).select("image_id", size.alias("damage")), "image_id"
    )
    corner = (F.col("x") == 5) & (F.col("y") == 3)
    broken = (
        damaged.filter(~((F.col("damage") == 1) & corner))
        .withColumn("x", F.when((F.col("damage") == 2) & corner, 4).otherwise(F.col("x")))
        .withColumn("r", F.when((F.col("damage") == 3) & corner, 300).otherwise(F.col("r")))
    )
    return quality.check_images(broken)


@query
def equal_frame_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.check_frames(inputs.line_frames(spark, sf_dir), inputs.part_sizes(spark, sf_dir))[0]


@query
def unequal_frame_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.check_frames(inputs.line_frames(spark, sf_dir), inputs.part_sizes(spark, sf_dir))[1]


# --- joins ------------------------------------------------------------------------


@query
def crop_to_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.crop_to_content(inputs.cutouts(spark, sf_dir))


@query
def crop_with_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.crop_to_content(inputs.cutouts(spark, sf_dir), padding=2)


@query
def crop_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = inputs.cutouts(spark, sf_dir)
    tagged = geometry.crop_meta(images_of(cut), geometry.alpha_bbox(cut))
    return tagged.select("image_id", F.coalesce(F.col("meta")["cropped"], F.lit("no")).alias("cropped"))


@query
def center_align_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.center_align(inputs.cutouts(spark, sf_dir), 11, 9, "bottom_center")


@query
def center_align_oversize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.center_align(inputs.glyphs(spark, sf_dir), 5, 4, "center")


@query
def align_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = inputs.cutouts(spark, sf_dir)
    placed = geometry.alignment(cut, 11, 9, "bottom_center")
    tagged = geometry.align_meta(
        with_meta(images_of(cut), **palette.pixelize_meta(8, 8, 32)), placed, 11, 9, "bottom_center"
    )
    meta = F.col("meta")
    return tagged.select(
        "image_id", "width", "height",
        *[meta[k].alias(k) for k in ("pixelized", "grid", "colors", "anchor", "canvas")],
        meta["pivot"].alias("pivot_at"),
    )


@query
def paste_on_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_id = F.col("image_id").cast("int")
    return geometry.paste_onto(inputs.cutouts(spark, sf_dir), 10, 9, by_id % 23 - 11, by_id % 7 - 3)


@query
def sprite_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    diffuse, normal = _pair_sides(spark, sf_dir)
    return pairs.sprite_pair(diffuse, normal)[0]


@query
def sprite_pair_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    diffuse, normal = _pair_sides(spark, sf_dir)
    return pairs.sprite_pair(diffuse, normal)[1]


def _pair_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """8 x 8 cut-outs; normals of another size for label 1, none for label 2."""
    cut = inputs.cutouts(spark, sf_dir)
    labels = inputs.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("image_id"), "label"
    )
    labelled = cut.join(labels, "image_id")
    same = labelled.filter(~F.col("label").isin(1, 2)).select(*PIXEL)
    other = resample.nearest_resize(labelled.filter(F.col("label") == 1).select(*PIXEL), 5, 5)
    return cut, normals.normal_estimate(same.unionByName(other))


@query
def relit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = pairs.relight(
        normals.normal_estimate(inputs.glyphs(spark, sf_dir)),
        [pairs.Light(), pairs.Light("left", -0.6, 0.4, 0.05, 200, 220, 255, 0.3, 2.0)],
    )
    return lit


@query
def routed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = inputs.as_requests(inputs.table(spark, sf_dir, "events"))
    routed = requests.route(asked, inputs.models(spark))[0]
    return routed.select("request_id", "op", "model_id", "adapter")


@query
def unroutable_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = inputs.as_requests(inputs.table(spark, sf_dir, "events"))
    rejected = requests.route(asked, inputs.models(spark))[1]
    return rejected.select("request_id", "op", "model_id", "reason")


def _layered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = inputs.table(spark, sf_dir, "events")
    text = F.col("event_type")
    overrides = F.map_filter(
        F.create_map(
            F.lit("k"), F.get_json_object("props", "$.k"),
            F.lit("seed"), F.when(text == "view", F.col("user_id").cast("string")),
            F.lit("width"), F.when(text == "click", F.lit("48")),
            F.lit("prompt"), F.lit(None).cast("string"),
        ),
        # An explicit null prompt is an override of purchases; other nulls are absent.
        lambda k, v: v.isNotNull() | ((k == "prompt") & (text == "purchase")),
    )
    asked = events.select(
        F.col("event_id").cast("string").alias("request_id"),
        F.when(text == "error", "other").otherwise("single_sprite").alias("scope_id"),
        overrides.alias("overrides"),
    )
    declared = spark.createDataFrame(
        [("single_sprite", *row) for row in SINGLE_SPRITE_PARAMS],
        "scope_id string, name string, type string, default_value string",
    )
    return asked, declared


@query
def layered_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, declared = _layered(spark, sf_dir)
    config = requests.config_params(
        {"canvas.width": "64", "canvas.height": "80", "normal.enabled": "true", "pivot": "bottom_center"}
    )
    resolved = requests.resolve_params(asked, declared, config)
    return requests.typed_params(resolved, declared).select("request_id", "name", "type", "value")


@query
def typed_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates in JSON whose numbers, flags and objects keep their type."""
    texts = F.create_map(
        F.lit("user"), F.col("user_id").cast("string"), F.lit("buys"), (F.col("event_type") == "purchase").cast("string"),
        F.lit("kind"), F.col("event_type"),
    )
    types = F.create_map(F.lit("user"), F.lit("int"), F.lit("buys"), F.lit("bool"), F.lit("kind"), F.lit("string"))
    node = '{"seed": "${user}", "note": "${user} x", "on": {"${kind}": ["${buys}", 1, "${kind}"]}}'
    rows = inputs.table(spark, sf_dir, "events").select("event_id", F.lit(node).alias("node"), requests.json_params(texts, types).alias("params"))
    filled, _ = requests.fill_json(rows, "node")
    seed = F.variant_get("node", "$.seed", "bigint")
    return filled.select("event_id", (seed + 1).alias("next_seed"), F.variant_get("node", "$.on['${kind}'][0]", "boolean").alias("buys"), F.to_json("node").alias("node"))



def _templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = inputs.table(spark, sf_dir, "events")
    bad = F.when(F.col("event_type") == "error", "${missing}").otherwise("a${k}")
    node = F.struct(
        F.lit("${kind}").alias("prompt"),
        F.array(F.lit("${k}"), F.lit("fixed"), bad).alias("steps"),
        F.create_map(F.lit("seed"), F.lit("${user}"), F.lit("note"), F.lit("${user} x")).alias("extra"),
    )
    return events.select(
        "event_id",
        node.alias("node_params"),
        F.create_map(
            F.lit("kind"), F.col("event_type"),
            F.lit("user"), F.col("user_id").cast("string"),
            F.lit("k"), F.get_json_object("props", "$.k"),
        ).alias("params"),
    )


@query
def filled_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = requests.fill_templates(_templates(spark, sf_dir), "node_params")[0]
    node = F.col("node_params")
    return filled.select(
        "event_id",
        node["prompt"].alias("prompt"),
        F.array_join(node["steps"], "|").alias("steps"),
        node["extra"]["seed"].alias("seed"),
        node["extra"]["note"].alias("note"),
    )


@query
def undefined_template_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.fill_templates(_templates(spark, sf_dir), "node_params")[1].select(
        "event_id", "reason"
    )


def _candidate_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = inputs.table(spark, sf_dir, "orders")
    run = F.col("o_orderkey").cast("string").alias("run_id")
    nodes = orders.select(
        run,
        F.explode(F.array(F.lit("gen"), F.lit("spr"))).alias("node_id"),
        F.array(F.lit("spritify"), F.lit("variant_F"), F.lit("variant_O")).alias("candidates"),
    )
    choices = orders.filter(F.col("o_orderpriority") != "5-LOW").select(
        run, F.lit("spr").alias("node_id"), F.concat(F.lit("variant_"), "o_orderstatus").alias("pick")
    )
    return nodes, choices


@query
def chosen_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = requests.choose_candidates(*_candidate_sides(spark, sf_dir))[0]
    return chosen.select("run_id", "node_id", "chosen")


@query
def candidate_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.choose_candidates(*_candidate_sides(spark, sf_dir))[1].select(
        "run_id", "node_id", "reason"
    )


# --- windows and ordered operators ----------------------------------------------------


@query
def normal_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normals.normal_estimate(inputs.glyphs(spark, sf_dir))


@query
def normal_maps_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Tiles smaller than the image: halos and tile edges take part.
    shaded = normals.normal_estimate(inputs.cutouts(spark, sf_dir), strength=0.7, tile=3)
    return shaded.select("image_id", "x", "y", *NORMAL)


@query
def ranked_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Short ranges, so that long sequences are really split.
    ranked = sheets.rank_frames(inputs.line_frames(spark, sf_dir), range_rows=3)
    return ranked.select("seq_id", "frame_no", "image_id", F.col("pos").cast("long").alias("pos"))


@query
def sheet_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.pack_sheet(inputs.line_frames(spark, sf_dir), inputs.sized_glyphs(spark, sf_dir))[0]


@query
def packed_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    strip = sheets.pack_sheet(inputs.line_frames(spark, sf_dir), inputs.sized_glyphs(spark, sf_dir))[1]
    return digest(strip, "r", "g", "b", "a", "width", "height")


@query
def sliced_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.slice_sheet(inputs.glyphs(spark, sf_dir), 5, 4)


@query
def sheet_metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = inputs.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("sheet_id"),
        F.create_map(
            F.lit("fps"), (F.col("o_custkey") % 30).cast("string"), F.lit("packed"), F.lit("no")
        ).alias("meta"),
    )
    meta = F.col("meta")
    return sheets.sheet_meta(sequences).select(
        "sheet_id", meta["fps"].alias("fps"), meta["packed"].alias("packed")
    )


def _progress(spark: SparkSession, sf_dir: str, unknown: str) -> tuple[DataFrame, DataFrame]:
    """Tool events against the graph; events of kind ``unknown`` name a tool that it lacks."""
    graph = spark.createDataFrame(
        list(inputs.GRAPH), "task_node string, task_ix int, tool_node string, tool_ix int"
    )
    events = inputs.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") == "signup", "gen").otherwise("spr").alias("task_node"),
        F.when(F.col("event_type") == unknown, "lost").otherwise(F.col("event_type")).alias("tool_node"),
        (F.col("value") / 400.0 - 0.05).alias("fraction"),
    )
    return runs.overall_progress(events, graph)


@query
def task_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _progress(spark, sf_dir, "")[0].select("event_id", "progress")


@query
def unknown_node_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _progress(spark, sf_dir, "error")[1].select("event_id", "reason")


@query
def latest_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status_rows(runs.latest_status(inputs.run_events(spark, sf_dir)))


def _status_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "run_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
        "status", "progress", "message", "error", "terminal",
    )


@query
def primary_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = artifacts.manifest_results(inputs.manifest(spark, sf_dir))
    ordered = rows.withColumn("pos", F.col("id"))
    return runs.primary_artifact(ordered.drop("meta")).select("run_id", "id", "kind", "normal_url")


def _result_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as inference results: the words of the text are the outputs."""
    return inputs.table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        F.when(F.col("role") == "user", F.split("text", " ")).alias("outputs"),
    )


@query
def first_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.first_output(_result_outputs(spark, sf_dir))[0].select("request_id", "output")


@query
def missing_output_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.first_output(_result_outputs(spark, sf_dir))[1].select("request_id", "reason")


# --- set operations --------------------------------------------------------------------


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The pictures rendered twice; the second time the larger parts get another seed."""
    asked = inputs.part_prompts(spark, sf_dir)
    changed = F.when(F.col("p_size") > 40, F.col("seed") + 1).otherwise(F.col("seed"))
    one = prompt_images(asked, F.col("prompt"), F.col("seed"), 6, 5)
    two = prompt_images(asked, F.col("prompt"), changed, 6, 5)
    return one, two


@query
def image_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.diff_images(*_versions(spark, sf_dir))


@query
def differing_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.differing_images(*_versions(spark, sf_dir))


# --- streaming --------------------------------------------------------------------------


def _finish(query_) -> None:
    query_.awaitTermination()


@query
def streamed_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workplace(spark, "status")
    events = inputs.as_run_events(inputs.event_stream(spark, sf_dir))
    status = run_streams.stream_status(events, delay=f"{STREAM_DELAY} seconds")
    with run_streams.rocksdb(spark):
        _finish(generation.start_update_sink(status, f"{folder}/rows", f"{folder}/checkpoint"))
    rows = generation.latest_updates(spark.read.parquet(f"{folder}/rows"), "run_id")
    return _status_rows(rows)


@query
def job_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.job_outcomes(inputs.run_events(spark, sf_dir)).select("run_id", "outcome")


STREAM_DELAY = 3600  # seconds


def _streamed_outcomes(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The events as they arrive, up to two hours out of order, in four deliveries.

    The stream stops after each delivery and goes on from its checkpoint.
    """
    folder = workplace(spark, "timeouts")
    arrived = inputs.as_arrivals(inputs.run_events(spark, sf_dir)).persist()
    schema = arrived.drop("delivery").schema
    try:
        for n in range(inputs.DELIVERIES):
            arrived.filter(F.col("delivery") == n).drop("delivery").write.parquet(f"{folder}/in/{n}")
            stream = spark.readStream.schema(schema).parquet(f"{folder}/in/*")
            _finish(
                run_streams.start_timeouts(
                    stream, f"{folder}/rows", f"{folder}/checkpoint", f"{STREAM_DELAY} seconds", keep=365 * 24 * 3600
                )
            )
    finally:
        arrived.unpersist()
    return run_streams.written(spark, f"{folder}/rows", kind)


@query
def streamed_job_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _streamed_outcomes(spark, sf_dir, run_streams.OUTCOME)
    return rows.select("run_id", F.col("status").alias("outcome"))


@query
def late_run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed_outcomes(spark, sf_dir, run_streams.LATE).select("run_id", "event_id", "status")


@query
def streamed_sprites(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workplace(spark, "sprites")
    asked = inputs.as_requests(inputs.event_stream(spark, sf_dir)).withColumn(
        "image_id", F.col("request_id")
    )
    _finish(
        generation.start_sprite_stream(
            asked, inputs.models(spark), folder, f"{folder}/checkpoint",
            summarize=lambda sprites: digest(sprites, "r", "g", "b", "a", *NORMAL),
            **SPRITE_SIZES,
        )
    )
    return spark.read.parquet(f"{folder}/sprites").drop("batch")


# --- extension surface --------------------------------------------------------------------


@query
def user_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = extension.Toolbox()

    @box.operator("posterize", needs=dict.fromkeys("rgb", "int"), gives=PIXEL)
    def posterize(pixels: DataFrame, levels: int) -> DataFrame:
        step = 256 // levels
        return pixels.withColumns({c: (idiv(F.col(c), step) * step).cast("int") for c in "rgb"})

    return box["posterize"](inputs.glyphs(spark, sf_dir), levels=4)


@query
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    extension.register_sql_functions(spark)
    return inputs.glyphs(spark, sf_dir).select(
        "image_id", "x", "y",
        F.expr("pixel_luma(r, g, b)").alias("luma"),
        F.expr("hard_alpha(a, 128)").alias("alpha"),
        F.expr("prompt_color(image_id, cast(x AS BIGINT))").alias("color"),
    )


@query
def sql_glyph_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    extension.register_sql_functions(spark)
    asked = inputs.part_prompts(spark, sf_dir).repartition(blowup_partitions(spark), "image_id")
    return spark.sql(
        "SELECT image_id, p.* FROM (SELECT image_id, glyph_pixel(prompt_color(prompt, seed), 7, 9, x, y) AS p "
        "FROM {asked} LATERAL VIEW explode(sequence(0, 8)) AS y LATERAL VIEW explode(sequence(0, 6)) AS x)",
        asked=asked,
    )


def _inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = inputs.part_prompts(spark, sf_dir).select(
        F.col("image_id").alias("request_id"),
        F.when(F.col("p_size") > 45, "text2vid").otherwise("text2img").alias("op"),
        F.lit("stub-image").alias("model_id"),
        F.create_map(F.lit("prompt"), F.col("prompt")).alias("inputs"),
        F.create_map(
            F.lit("width"), F.lit("8"), F.lit("height"), F.lit("6"),
            F.lit("seed"), F.col("seed").cast("string"),
        ).alias("params"),
    )
    # a table of one file would be one task of the model
    return extension.infer(asked.repartition(blowup_partitions(spark), "request_id"), PatternModel)


@query
def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, _ = extension.split_errors(_inferred(spark, sf_dir))
    first, _ = requests.first_output(done)
    return images.decode_outputs(first)[0]


@query
def model_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extension.split_errors(_inferred(spark, sf_dir))[1].select("request_id", "op", "reason")


def _asked_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as requests: most paint from the prompt in a size of their own, others change a picture they bring."""
    asked = inputs.part_prompts(spark, sf_dir)
    op = F.when(F.col("p_size") % 3 == 0, "img2img").when(F.col("p_size") > 45, "text2vid").otherwise("text2img")
    own = F.map_filter(
        F.create_map(
            F.lit("width"), F.when(F.col("seed") % 2 == 0, (F.col("seed") % 5 + 4).cast("string")),
            F.lit("seed"), F.col("seed").cast("string"),
        ),
        lambda _, v: v.isNotNull(),
    )
    rows = asked.select(
        F.col("image_id").alias("request_id"), op.alias("op"),
        F.when(F.col("p_size") == 7, "unknown").otherwise("stub-image").alias("model_id"),
        "prompt", op.alias("scope_id"), own.alias("overrides"),
    )
    brought = artifacts.encode_png(inputs.sized_glyphs(spark, sf_dir)).select(
        F.col("image_id").alias("request_id"), F.base64("png").alias("image_b64")
    )
    given = F.map_filter(
        F.create_map(F.lit("prompt"), F.col("prompt"), F.lit("image_b64"), F.when(F.col("op") == "img2img", F.col("image_b64"))),
        lambda _, v: v.isNotNull(),
    )
    return rows.join(brought, "request_id", "left").withColumn("inputs", given).drop("image_b64", "prompt")


def _routed_inference(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Requests, layered parameters, routing, inference: (results, requests without an adapter)."""
    declared = spark.createDataFrame(
        [(op, *one) for op in ("text2img", "img2img") for one in (("width", "int", "8"), ("height", "int", "6"), ("seed", "int", "0"))],
        "scope_id string, name string, type string, default_value string",
    )
    layered = requests.resolve_params(
        _asked_pictures(spark, sf_dir), declared, requests.config_params({"canvas.height": "5", "pivot": "center"})
    )
    adapters = {"invert": InvertModel, "pattern": PatternModel}
    listing = extension.model_listing(spark, [make() for make in adapters.values()])
    routed, rejected = requests.route(layered, listing)
    return extension.infer_routed(routed, adapters, spread=4), rejected


@query
def routed_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, _ = extension.split_errors(_routed_inference(spark, sf_dir)[0])
    return images.decode_outputs(requests.first_output(done)[0])[0]


@query
def routed_inference_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed_inference(spark, sf_dir)[1].select("request_id", "op", "model_id", "reason")


@query
def glyph_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    extension.register_glyph_table(spark)
    asked = inputs.part_prompts(spark, sf_dir).repartition(blowup_partitions(spark), "image_id")
    return spark.sql("SELECT image_id, g.* FROM {asked} a, LATERAL glyph(a.prompt, a.seed, 7, 9) g", asked=asked)


# --- composite pipelines --------------------------------------------------------------------

# Sizes of the flagship in the registered queries; the operator's defaults are the full ones.
SPRITE_SIZES = {"render": 24, "width": 14, "height": 12, "grid_w": 10, "grid_h": 10, "colors": 6}


@query
def spritify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sprites.spritify(
        inputs.cutouts(spark, sf_dir), width=9, height=10, grid_w=6, grid_h=7, colors=5
    )


@query
def single_sprite(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = inputs.part_prompts(spark, sf_dir)
    return sprites.single_sprite(asked, F.col("prompt"), F.col("seed"), **SPRITE_SIZES)


# Declared sprite parameters with small defaults, and the values that requests may take.
REQUESTED = (
    ("prompt", "string", ""), ("seed", "int", "0"), ("width", "int", "14"), ("height", "int", "10"),
    ("grid_w", "int", "10"), ("grid_h", "int", "10"), ("colors", "int", "6"),
)
REQUESTED_RANGES = {
    "seed": (0, 2**31 - 1), "width": (1, 256), "height": (1, 256), "grid_w": (1, 64), "grid_h": (1, 64), "colors": (2, 64),
}


def _requested_sprites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sprite requests of all parts, each with its own sizes, colours and seed, layered and read as integers."""
    medium, large = F.col("p_size").between(21, 40), F.col("p_size") > 40
    turn = F.col("p_partkey") % 5
    given = {
        "prompt": F.col("p_name"),
        "seed": F.when(large, "7").otherwise(F.col("p_partkey").cast("string")),
        "width": F.when(medium, "9").when(large & (turn == 0), "wide"),
        "height": F.when(large, "16"),
        "grid_w": F.when(medium, "7"),
        "grid_h": F.when(large, "8"),
        "colors": F.when(medium, "4"),
    }
    overrides = F.map_filter(
        F.create_map(*(c for k, v in given.items() for c in (F.lit(k), v))),
        lambda k, v: v.isNotNull() | ((k == "colors") & large & (turn == 1)),
    )
    asked = inputs.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("image_id"),
        F.when(F.col("p_size") <= 20, 24).otherwise(20).alias("render"),
        F.lit("sprite").alias("scope_id"),
        overrides.alias("overrides"),
    )
    declared = spark.createDataFrame(
        [("sprite", *row) for row in REQUESTED], "scope_id string, name string, type string, default_value string"
    )
    resolved = requests.resolve_params(asked, declared, requests.config_params({"canvas.height": "12"}))
    return requests.integer_params(resolved, REQUESTED_RANGES)


@query
def requested_sprites(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, _ = _requested_sprites(spark, sf_dir)
    names = ("render", "width", "height", "grid_w", "grid_h", "colors")
    return sprites.single_sprite(asked, F.col("params")["prompt"], F.col("seed"), **{n: F.col(n) for n in names})


@query
def requested_sprite_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requested_sprites(spark, sf_dir)[1].select("image_id", "reason")


@query
def animation_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, strip, _ = sprites.animation_sheet(
        inputs.line_frames(spark, sf_dir), inputs.sized_glyphs(spark, sf_dir)
    )
    return digest(strip, "r", "g", "b", "a", *NORMAL)


@query
def candidate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = inputs.part_prompts(spark, sf_dir).select(F.col("image_id").alias("batch_id"), "prompt")
    _, pixels = sprites.candidate_batch(prompts, 3, 5, 4)
    return pixels


@query
def candidate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = inputs.part_prompts(spark, sf_dir).select(F.col("image_id").alias("batch_id"), "prompt")
    return sprites.candidate_batch(prompts, 3, 5, 4)[0]
