"""Image files, payloads, artifact store and manifest."""

from __future__ import annotations

import base64
import json
import re
import struct
import zlib

import numpy as np
import pytest
from conftest import disc, gradient, noise
from pyspark.sql import functions as F

from pixelloom.functions.png import decode_png, png_parts
from pixelloom.operators import normals, quality
from pixelloom.plans.sprites import candidate_batch
from pixelloom.sources import artifacts
from pixelloom.sources import images as image_source
from pixelloom.sources.generate import prompt_images


def png_with_filters(samples: np.ndarray, color_type: int) -> bytes:
    """A PNG whose lines use the filters 0 to 4 in turn."""
    height, width, channels = samples.shape
    lines = b""
    for y in range(height):
        kind = y % 5
        out = bytearray()
        for x in range(width):
            for c in range(channels):
                left = int(samples[y, x - 1, c]) if x else 0
                up = int(samples[y - 1, x, c]) if y else 0
                corner = int(samples[y - 1, x - 1, c]) if x and y else 0
                estimate = left + up - corner
                paeth = min((abs(estimate - left), 0, left), (abs(estimate - up), 1, up), (abs(estimate - corner), 2, corner))[2]
                guess = (0, left, up, (left + up) // 2, paeth)[kind]
                out.append((int(samples[y, x, c]) - guess) % 256)
        lines += bytes([kind]) + bytes(out)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return (
        b"\x89PNG\r\n\x1a\n"
        + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color_type, 0, 0, 0))
        + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    )


@pytest.mark.parametrize("color_type,channels", [(0, 1), (2, 3), (6, 4)])
def test_png_decoding_of_all_filters_and_spark_reader(spark, images, tmp_path, color_type, channels):
    samples = noise(7, 11, seed=channels)[..., :channels]
    data = png_with_filters(samples, color_type)
    want = np.full((11, 7, 4), 255)
    want[..., :3] = samples[..., :3]
    if channels == 4:
        want[..., 3] = samples[..., 3]
    assert (decode_png(data) == want).all()
    (tmp_path / "one.png").write_bytes(data)
    (tmp_path / "broken.png").write_bytes(b"no image")
    pixels, table = image_source.read_images(spark, str(tmp_path))
    assert (images.arrays(pixels)["one"] == want).all()
    assert {(r.image_id, r.kind) for r in table.collect()} == {("one", "image"), ("broken", "invalid")}


def test_image_ids_lie_below_the_folder_and_doubles_are_listed(spark, images, tmp_path):
    folder = tmp_path / "in put"
    names = ("a.png", "sub/a.png", "sub/b c+d%.x.png", "sub/twice.png", "sub/twice.PNG", ".hid/x.png")
    for i, name in enumerate(names):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(b"".join(png_parts(2, 1, [noise(2, 1, seed=i).astype(np.uint8).tobytes()])))
    for path in (str(folder), f"{folder}/", f"file://{folder}"):
        pixels, table = image_source.read_images(spark, path)
        kinds = sorted((r.image_id, r.kind) for r in table.collect())
        assert kinds == [("a", "image"), ("sub/a", "image"), ("sub/b c+d%.x", "image"), ("sub/twice", "double"), ("sub/twice", "double")]
        assert {r.image_id for r in pixels.collect()} == {"a", "sub/a", "sub/b c+d%.x"}
    (tmp_path / "none").mkdir()
    pixels, table = image_source.read_images(spark, str(tmp_path / "none"))
    assert pixels.count() == table.count() == 0


def test_written_pngs_come_back_also_in_several_bands(spark, images, tmp_path, monkeypatch):
    monkeypatch.setattr(artifacts, "BAND_PIXELS", 40)
    table = images.table(n=noise(13, 9), d=disc(20, 20), wide=noise(50, 3), one=noise(1, 1))
    artifacts.write_png(table, str(tmp_path / "png"))
    assert sorted(p.name for p in (tmp_path / "png").glob("*.png")) == ["d.png", "n.png", "one.png", "wide.png"]
    back, _ = image_source.read_images(spark, str(tmp_path / "png"))
    assert quality.diff_images(table, back).count() == 0
    again = artifacts.from_bands(artifacts.to_bands(table))
    assert quality.diff_images(table, again).count() == 0


def test_payload_forms_and_rejects(spark, images):
    picture = noise(5, 3)
    png = b"".join(png_parts(5, 3, [picture.astype(np.uint8).tobytes()]))
    payloads = {
        "png": json.dumps({"png_b64": base64.b64encode(png).decode()}),
        "raw": json.dumps({"rgba": picture.reshape(-1).tolist(), "w": 5, "h": 3}),
        "short": json.dumps({"rgba": [1, 2, 3], "w": 5, "h": 3}),
        "range": json.dumps({"rgba": [1, 2, 3, 256], "w": 1, "h": 1}),
        "other": json.dumps({"url": "x"}),
        "text": "not json",
        "notpng": json.dumps({"png_b64": base64.b64encode(b"hello").decode()}),
        "notb64": json.dumps({"png_b64": "%%%"}),
    }
    rows = spark.createDataFrame(list(payloads.items()), "image_id string, payload string")
    pixels, rejects = image_source.decode_payload(rows)
    out = images.arrays(pixels)
    assert set(out) == {"png", "raw"}
    assert (out["png"] == picture).all() and (out["raw"] == picture).all()
    assert {r.image_id for r in rejects.collect()} == {"short", "range", "other", "text", "notpng", "notb64"}


def test_artifact_store_layers_and_rejects(spark, images, tmp_path):
    shaded = normals.normal_estimate(images.table(p=disc(8, 8), i=noise(4, 3), n=noise(3, 3), s=noise(6, 2), m=noise(2, 2)))
    kinds = spark.createDataFrame(
        [("p", "sprite_pair", None, None, None, {"pivot": "[1, 2]"}), ("i", "image", None, None, None, {}),
         ("n", "normal_map", None, None, None, None), ("s", "sprite_sheet", 2, 3, 2, {"fps": "12"}), ("m", "mask", None, None, None, {})],
        "image_id string, kind string, frames int, frame_w int, frame_h int, meta map<string,string>",
    )
    path = str(tmp_path / "store")
    rejected = artifacts.write_artifacts(kinds, shaded, path, mode="overwrite")
    assert [r.reason for r in rejected.collect()] == ["ValueError: the store takes no mask"]
    entries = {r.id: r for r in spark.read.parquet(f"{path}/entries").collect()}
    assert entries["p"].normal == "p-normal" and entries["p"].image is None
    assert entries["i"].image == "i-image" and entries["i"].normal is None
    assert entries["p"].meta == {"pivot": "[1, 2]"} and entries["s"].frame_w == 3
    bands = spark.read.parquet(f"{path}/bands")
    layers = {(r.image_id, r.layer) for r in bands.select("image_id", "layer").collect()}
    assert layers == {("p", "diffuse"), ("p", "normal"), ("s", "diffuse"), ("s", "normal"), ("i", "image"), ("n", "image")}
    alpha = artifacts.from_bands(bands.filter("layer = 'normal' OR image_id = 'n'")).select("a").distinct().collect()
    assert [r.a for r in alpha] == [255]
    artifacts.export_png(spark, path, str(tmp_path / "files"))
    pixels, _ = image_source.read_images(spark, str(tmp_path / "files"))
    out = images.arrays(pixels)
    assert set(out) == {"p-diffuse", "p-normal", "s-diffuse", "s-normal", "i-image", "n-image"}
    assert (out["p-diffuse"] == disc(8, 8)).all() and out["p-normal"][0, 0].tolist() == [128, 128, 255, 255]


def test_manifest_append_results_and_missing_files(spark, images, tmp_path):
    schema = (
        "run_id string, task string, params map<string,string>, choices map<string,string>, artifacts array<struct<"
        "id:string,kind:string,diffuse:string,normal:string,image:string,frames:int,frame_w:int,frame_h:int,meta:map<string,string>>>"
    )
    pair = ("a1", "sprite_pair", "d1", "n1", None, None, None, None, None)
    plain = ("a2", "image", None, None, "i1", None, None, None, {"k": "v"})
    path = str(tmp_path / "manifest")
    for run in (("r1", "t", {}, {}, [pair]), ("r2", "t", {}, {}, [plain, pair])):
        artifacts.append_manifest(spark.createDataFrame([run], schema), path)
    manifest = spark.read.parquet(path)
    rows = {(r.run_id, r.pos): r for r in artifacts.manifest_results(manifest).collect()}
    assert len(rows) == 3
    assert rows["r1", 0].diffuse_url == "/api/artifacts/d1" and rows["r1", 0].meta == {} and rows["r1", 0].url is None
    assert rows["r2", 0].url == "/api/artifacts/i1" and rows["r2", 0].meta == {"k": "v"}
    artifacts.write_png(images.table(d1=disc(4, 4), i1=disc(4, 4)), str(tmp_path / "png"))
    files = artifacts.stored_files(spark, str(tmp_path / "png"))
    missing = artifacts.missing_artifacts(manifest, files)
    assert {(r.run_id, r.role, r.file_id) for r in missing.collect()} == {("r1", "normal", "n1"), ("r2", "normal", "n1")}


def test_prompt_images_are_deterministic_and_dense(spark):
    asked = spark.createDataFrame([("a", "x", 7), ("b", "größe 漢字", 1), ("c", None, 0)], "image_id string, prompt string, seed int")
    one = prompt_images(asked, F.col("prompt"), F.col("seed"), 20, 11)
    assert quality.diff_images(one, prompt_images(asked, F.col("prompt"), F.col("seed"), 20, 11)).count() == 0
    assert {r.ok for r in quality.check_images(one).collect()} == {True}
    assert one.filter("a = 255").count() > 0
    members, pixels = candidate_batch(asked.withColumnRenamed("image_id", "batch_id"), 4, 6, 5)
    assert members.count() == 12 and pixels.count() == 12 * 30


def test_gradient_fixture_matches_its_definition(images):
    out = images.arrays(images.table(g=gradient(8, 4)))["g"]
    assert out[3, 7].tolist() == [223, 191, 212, 255]


def test_folders_are_listed_and_read_by_tasks(spark, images, tmp_path):
    artifacts.write_png(images.table(a=disc(4, 4), b=noise(3, 2)), str(tmp_path / "png"))
    pixels, table = image_source.read_images(spark, str(tmp_path / "png"))
    for df in (pixels, table, artifacts.stored_files(spark, str(tmp_path / "png"))):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "FileScan image" not in text and "FileScan binaryFile" not in text
    assert pixels.count() == 16 + 6 and {r.kind for r in table.collect()} == {"image"}
    origins = {r.meta["origin"] for r in table.collect()}
    assert origins == {f"file://{tmp_path}/png/a.png", f"file://{tmp_path}/png/b.png"}


def test_pngs_are_written_in_folders_of_their_tasks_and_moved(spark, images, tmp_path):
    long = "n" * 240  # a name of its own beside it would be too long
    for picture in (noise(3, 2), disc(4, 4)):  # the second run writes over the first
        artifacts.write_png(images.table(**{long: picture, "b": picture, "c.d": picture}), str(tmp_path / "png"), 4)
        assert sorted(p.name for p in (tmp_path / "png").iterdir()) == ["b.png", "c.d.png", f"{long}.png"]
        assert all((decode_png(p.read_bytes()) == picture).all() for p in (tmp_path / "png").iterdir())


def test_file_ids_are_names_without_extension_and_no_regular_expression(spark, tmp_path):
    folder = tmp_path / "some.folder"
    for name in ("a.png", "b.c.png", "x..png", "sp ace é.png", "t.tar.gz", "other.txt", ".hid.png", "deep/d.png"):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(b"x")
    for path in (str(folder), f"file://{folder}", f"{tmp_path}/*.folder"):
        found = artifacts.stored_files(spark, path)
        assert sorted(r.file_id for r in found.collect()) == ["a", "b.c", "sp ace é", "x."]
        assert "regexp" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r.file_id for r in artifacts.stored_files(spark, str(folder), "tar.gz").collect()] == ["t.tar"]


def test_entries_and_layers_of_shaded_pictures_run_in_compiled_code(spark, images, capsys):
    shaded = normals.normal_estimate(images.table(p=disc(8, 8), n=noise(4, 3), i=noise(3, 3)))
    bare = images.table(q=noise(5, 2), m=noise(2, 2)).withColumns({c: F.lit(None).cast("int") for c in ("nr", "ng", "nb")})
    pixels = shaded.unionByName(bare)
    kinds = spark.createDataFrame(
        [("p", "sprite_pair", {}), ("n", "normal_map", {}), ("i", "image", {}), ("q", "sprite_pair", {}), ("m", "normal_map", {}), ("none", "sprite_pair", {})],
        "image_id string, kind string, meta map<string,string>",
    )
    entries, layers = artifacts.artifact_entries(kinds, pixels), artifacts.artifact_layers(kinds, pixels)
    assert {(r.id, r.diffuse, r.normal, r.image) for r in entries.collect()} == {
        ("p", "p-diffuse", "p-normal", None), ("n", None, None, "n-image"), ("i", None, None, "i-image"),
        ("q", "q-diffuse", None, None), ("m", None, None, "m-image"), ("none", "none-diffuse", None, None),
    }
    counts = {(r.image_id, r.layer): r["count"] for r in layers.groupBy("image_id", "layer").count().collect()}
    assert counts == {("p", "diffuse"): 64, ("p", "normal"): 64, ("n", "image"): 12, ("i", "image"): 9, ("q", "diffuse"): 10}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (entries, layers):
            capsys.readouterr()
            df.select("*").explain("codegen")
            text = capsys.readouterr().out
            # the JIT compiles no method of more than 8,000 bytes
            assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text))) < 8000
            assert "lambdafunction" not in text
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
