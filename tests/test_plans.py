"""The physical plans: shuffles, pushdown, pruning, and groups that stay bounded."""

from __future__ import annotations

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from pixelloom.model import PIXEL
from pixelloom.operators import channels, geometry, normals, pairs, palette, quality, requests, resample, sheets, tiles
from pixelloom.plans import inputs, sprites
from pixelloom.plans.catalog import QUERIES
from pixelloom.sources import artifacts

# These run jobs while they are built.
EAGER = ("stream", "late_run", "read_png", "png_", "decode_png", "stored_", "manifest_append")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return plan(df).split("+- == Initial Plan ==")[0]


def exchanges(text: str) -> int:
    return len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange hashpartitioning", text))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pixels"))
    inputs.glyphs(spark, SMALL, 20, 14).select(*PIXEL).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(EAGER)])
def test_no_query_pairs_all_rows(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_flagship_shuffles_only_the_requests(spark):
    text = plan(QUERIES["single_sprite"](spark, SMALL))
    assert text.count("Exchange") == 1 and "REPARTITION_BY_NUM" in text
    assert "Window" not in text and "Sort " not in text and "Join" not in text


def test_sizes_per_request_take_no_join(spark):
    asked = spark.createDataFrame([("a", "p", 1, 8, 6, 5)], "image_id string, prompt string, seed int, width int, colors int, grid_w int")
    sizes = {n: F.col(n) for n in ("width", "colors", "grid_w")}
    text = plan(sprites.single_sprite(asked, F.col("prompt"), F.col("seed"), render=12, height=7, grid_h=5, **sizes))
    assert text.count("Exchange") == 1 and "REPARTITION_BY_NUM" in text
    assert "Window" not in text and "Sort " not in text and "Join" not in text


def test_sprite_stream_routes_in_place_and_packs_before_collecting(spark):
    asked = spark.createDataFrame(
        [("a", "text2img", "model-0", "p", 1), ("b", "img2vid", "model-0", "p", 2)],
        "image_id string, op string, model_id string, prompt string, seed int",
    )
    routed, rejected = requests.route(asked, inputs.models(spark))
    assert [r.adapter for r in routed.collect()] == ["remote"] and rejected.count() == 1
    assert "BroadcastHashJoin" in plan(routed) and "SortMergeJoin" not in plan(routed)
    text = plan(sprites.single_sprite(routed, F.col("prompt"), F.col("seed"), render=12, width=8, height=7, grid_w=5, grid_h=6))
    assert re.search(r"partial_collect_list\(packed#", text)
    assert "max(5)" not in text and "max(6)" not in text


def test_one_scope_for_all_requests_takes_a_keyed_join_and_one_map_per_use(spark):
    rows = spark.createDataFrame([("a", {"w": "3"}), ("b", {"w": "x"}), ("c", None)], "id string, overrides map<string,string>")
    declared = spark.createDataFrame([("s", n, "int", "1") for n in "wvu"], "scope_id string, name string, type string, default_value string")
    resolved = requests.resolve_params(rows.withColumn("scope_id", F.lit("s")), declared, {})
    accepted, rejected = requests.integer_params(resolved, {n: (1, 9) for n in "wvu"})
    assert {(r.id, r.w, r.v, r.u) for r in accepted.collect()} == {("a", 3, 1, 1), ("c", 1, 1, 1)}
    assert [(r.id, r.reason) for r in rejected.collect()] == [("b", "ValueError: not usable: w=x")]
    text = plan(rejected.select("id", "reason"))
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text and "SortMergeJoin" not in text
    assert text.count("map_concat") <= 2


def test_stencil_is_one_shuffle_without_windows(stored):
    text = plan(normals.normal_estimate(stored))
    assert exchanges(text) == 1
    assert "Window" not in text and "partial_collect_list" in text


def test_projections_do_not_shuffle(stored):
    for df in (
        channels.hard_alpha(stored),
        channels.luminance(stored),
        resample.nearest_resize(stored, 7, 9),
        resample.upscale(stored, 2),
        geometry.paste_onto(stored, 9, 9, 1, -1),
        sheets.slice_sheet(stored, 5, 7),
    ):
        assert "Exchange" not in plan(df)


def test_scans_are_filtered_and_pruned(stored):
    text = plan(channels.content_pixels(stored).select("image_id"))
    assert "GreaterThanOrEqual(a,128)" in text
    assert re.search(r"ReadSchema: struct<image_id:string,a:int>", text)
    text = plan(geometry.alpha_bbox(stored))
    assert "r:int" not in text.split("ReadSchema")[1]
    assert "partial_min" in text


def test_bounds_are_computed_once_for_align_and_padded_crop(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (geometry.center_align(stored, 9, 8), geometry.crop_to_content(stored, padding=1)):
            assert "ReusedExchange" in final_plan(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_palette_histogram_is_shuffled_once(stored):
    assert "ReusedExchange" in final_plan(palette.palette(stored))


def test_palette_sections_are_not_broadcast(stored):
    assert "Broadcast" not in plan(palette.palette(stored))


def test_integrity_check_is_a_hash_aggregate_of_bits(stored):
    text = plan(quality.check_images(stored))
    assert "partial_bit_or" in text and "Sort" not in text


def test_a_hot_image_is_cut_into_bounded_groups(spark):
    small = inputs.glyphs(spark, SMALL, 16, 12)
    one = spark.sql("SELECT 'hot' AS image_id, 'p' AS prompt, 1 AS seed")
    from pixelloom.sources.generate import prompt_images

    hot = prompt_images(one, F.col("prompt"), F.col("seed"), 700, 300)
    mixed = small.unionByName(hot)
    packed = tiles.pack_tiles(mixed)
    sizes = packed.groupBy("image_id").agg(F.count("*").alias("n"), F.max(F.size("px")).alias("largest"))
    rows = {r.image_id: r for r in sizes.collect()}
    assert rows["hot"].n == 11 * 5 and rows["hot"].largest <= 66 * 66
    bands = artifacts.to_bands(mixed).groupBy("image_id").agg(F.max(F.length("data")).alias("bytes"), F.count("*").alias("n"))
    hot_bands = bands.filter("image_id = 'hot'").first()
    assert hot_bands.n > 1 and hot_bands.bytes <= 4 * artifacts.BAND_PIXELS
    # Tiled and untiled normals agree across every tile border.
    shaded = normals.normal_estimate(hot)
    coarse = normals.normal_estimate(hot, tile=80)
    assert shaded.exceptAll(coarse).count() == 0


def test_a_hot_sequence_is_ranked_in_ranges(spark):
    frames = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("s"), F.col("id") % 50)).otherwise("hot").alias("seq_id"),
        (F.col("id") * 7).alias("frame_no"),
        F.col("id").cast("string").alias("image_id"),
    )
    got = sheets.rank_frames(frames, range_rows=100)
    assert "range_no" not in got.columns
    positions = got.groupBy("seq_id").agg(
        F.count("*").alias("n"), F.count_distinct("pos").alias("d"), F.max("pos").alias("m"), F.min("pos").alias("z"),
        F.corr("pos", F.col("frame_no").cast("double")).alias("c"),
    )
    for row in positions.collect():
        assert (row.d, row.m, row.z) == (row.n, row.n - 1, 0)


def join_inputs(df) -> list[set[str]]:
    """Column names of both sides of every join of the optimised plan."""
    found = []

    def walk(node):
        children = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            found.extend({c.output().apply(i).name() for i in range(c.output().size())} for c in children)
        for child in children:
            walk(child)

    walk(df._jdf.queryExecution().optimizedPlan())
    return found


def test_joins_move_strips_not_pixels(spark, stored):
    prompts = stored.select("image_id").distinct().withColumn("prompt", F.lit("p"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (
            geometry.crop_to_content(stored, padding=1),
            geometry.center_align(stored, 9, 8),
            channels.retint(stored, prompts),
            pairs.sprite_pair(stored, normals.normal_estimate(stored))[0],
            palette.quantize(stored, 5),
        ):
            sides = join_inputs(df)
            assert sides and any("px" in side for side in sides)
            assert not any({"x", "y"} <= side or "rgb" in side for side in sides)
            assert "SortMergeJoin" in plan(df) or "ShuffledHashJoin" in plan(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
