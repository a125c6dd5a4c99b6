"""Single operators against their stated properties and against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import disc, gradient, noise
from pyspark.sql import functions as F

from pixelloom.functions.mediancut import median_cut
from pixelloom.model import NORMAL, PIXEL, images_of
from pixelloom.operators import channels, geometry, normals, pairs, palette, quality, resample, sheets
from pixelloom.plans import sprites
from pixelloom.sources.artifacts import to_bands


def test_pixelize_size_palette_and_determinism(images):
    source = images.table(g=gradient(128, 128))
    first = palette.pixelize(source, 32, 32, 16)
    out = images.arrays(first)["g"]
    assert out.shape == (32, 32, 4)
    assert len({tuple(c) for c in out[..., :3].reshape(-1, 3)}) <= 16
    assert quality.diff_images(first, palette.pixelize(source, 32, 32, 16)).count() == 0


def test_pixelize_upscale_gives_solid_blocks(images):
    out = images.arrays(palette.pixelize(images.table(g=gradient()), 8, 8, 8, upscale_by=4))["g"]
    assert out.shape == (32, 32, 4)
    blocks = out.reshape(8, 4, 8, 4, 4)
    assert (blocks == blocks[:, :1, :, :1]).all()


def test_pixel_perfect_cells_are_solid_and_odd_sizes_shrink(images):
    out = images.arrays(
        resample.pixel_perfect(images.table(g=gradient(), odd=noise(10, 7), tiny=noise(2, 1)), 4)
    )
    assert out["g"].shape == (64, 64, 4)
    assert out["odd"].shape == (4, 8, 4)
    assert out["tiny"].shape == (4, 4, 4)
    for picture in out.values():
        h, w = picture.shape[:2]
        blocks = picture.reshape(h // 4, 4, w // 4, 4, 4)
        assert (blocks == blocks[:, :1, :, :1]).all()
        assert set(np.unique(picture[..., 3])) <= {0, 255}


@pytest.mark.parametrize("tw,th", [(5, 3), (1, 1), (13, 4), (20, 30), (7, 9)])
def test_box_and_nearest_against_numpy(images, tw, th):
    picture = noise(13, 9, seed=tw)
    source = images.table(p=picture)
    boxed = images.arrays(resample.box_downsample(source, tw, th))["p"]
    near = images.arrays(resample.nearest_resize(source, tw, th))["p"]
    h, w = picture.shape[:2]

    def covered(o, size, target):
        if target > size:
            return [((2 * o + 1) * size) // (2 * target)]
        return [p for p in range(size) if ((2 * p + 1) * target) // (2 * size) == o]

    for oy in range(th):
        for ox in range(tw):
            part = picture[np.ix_(covered(oy, h, th), covered(ox, w, tw))].reshape(-1, 4)
            total = part[:, 3].sum()
            want = [
                (2 * (part[:, c] * part[:, 3]).sum() + total) // (2 * total) if total else 0 for c in range(3)
            ] + [(2 * total + len(part)) // (2 * len(part))]
            assert boxed[oy, ox].tolist() == want
            assert (near[oy, ox] == picture[(2 * oy + 1) * h // (2 * th), (2 * ox + 1) * w // (2 * tw)]).all()


def test_crop_tightens_and_keeps_empty_images(images):
    empty = np.zeros((5, 6, 4), dtype=int)
    out = images.arrays(geometry.crop_to_content(images.table(d=disc(), e=empty)))
    assert out["d"].shape[0] < 64 and out["d"].shape[1] < 64
    assert (out["d"][..., 3] >= 128).any()
    assert (out["e"] == empty).all()
    padded = images.arrays(geometry.crop_to_content(images.table(d=disc(), e=empty), padding=3))
    assert (padded["d"][3:-3, 3:-3] == out["d"]).all()
    assert padded["d"][:3].sum() == 0 and (padded["e"] == empty).all()


def test_center_align_canvas_and_pivot(images):
    source = images.table(d=disc(), e=np.full((5, 7, 4), 10), one=np.full((1, 1, 4), 255))
    out = images.arrays(geometry.center_align(source, 96, 96))
    assert all(p.shape == (96, 96, 4) for p in out.values())
    pivots = {r.image_id: (r.pivot_x, r.pivot_y) for r in geometry.alignment(source, 96, 96).collect()}
    assert {p[1] for p in pivots.values()} == {95}
    assert (out["e"][91:, 44:51] == 10).all() and out["e"].sum() == 5 * 7 * 4 * 10
    assert (out["one"][95, 47] == 255).all()


@pytest.mark.parametrize("anchor", ["center", "bottom_center", "other"])
def test_center_align_of_oversize_content_floors_halves(images, anchor):
    picture = noise(9, 8)
    picture[..., 3] = 255
    out = images.arrays(geometry.center_align(images.table(p=picture), 4, 3, anchor))["p"]
    x, y = (4 - 9) // 2, 3 - 8 if anchor == "bottom_center" else (3 - 8) // 2
    assert (out == picture[-y : -y + 3, -x : -x + 4]).all()


@pytest.mark.parametrize("x,y", [(0, 0), (-3, 2), (9, 9), (-20, 0), (3, -1)])
def test_paste_clips(images, x, y):
    picture = noise(6, 5)
    out = images.arrays(geometry.paste_onto(images.table(p=picture), 8, 7, x, y))["p"]
    want = np.zeros((7, 8, 4), dtype=int)
    for sy in range(5):
        for sx in range(6):
            if 0 <= y + sy < 7 and 0 <= x + sx < 8:
                want[y + sy, x + sx] = picture[sy, sx]
    assert (out == want).all()


def sobel_normals(picture, strength):
    luma = (picture[..., :3] * [299, 587, 114]).sum(axis=-1)
    pad = np.pad(luma, 1, mode="edge")
    h, w = luma.shape
    at = lambda dy, dx: pad[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    gx = at(-1, -1) + 2 * at(0, -1) + at(1, -1) - at(-1, 1) - 2 * at(0, 1) - at(1, 1)
    gy = at(-1, -1) + 2 * at(-1, 0) + at(-1, 1) - at(1, -1) - 2 * at(1, 0) - at(1, 1)
    nx, ny = -gx * max(0.05, strength) / 255000, -gy * max(0.05, strength) / 255000
    norm = np.sqrt(nx * nx + ny * ny + 1)
    unit = np.stack([nx / norm, ny / norm, 1 / norm], axis=-1)
    out = np.floor((unit * 0.5 + 0.5) * 255 + 1e-9).astype(int)
    out[picture[..., 3] < 128] = [128, 128, 255]
    return out


@pytest.mark.parametrize("tile", [1, 4, 64])
@pytest.mark.parametrize("strength", [2.0, 0.0])
def test_normals_against_numpy(images, tile, strength):
    pictures = {"a": noise(13, 9), "b": noise(4, 4, 1), "one": noise(1, 1, 2), "row": noise(17, 1, 3)}
    out = images.arrays(normals.normal_estimate(images.table(**pictures), strength, tile), NORMAL)
    for name, picture in pictures.items():
        assert (out[name] == sobel_normals(picture, strength)).all(), name


def test_normals_flat_values(images):
    out = images.arrays(normals.normal_estimate(images.table(d=disc(48, 48))), NORMAL)["d"]
    assert out.shape == (48, 48, 3)
    assert out[0, 0].tolist() == [128, 128, 255]
    assert out[24, 24].tolist() == [127, 127, 255]


def test_normals_refuse_a_hole(images):
    holed = images.table(d=disc(8, 8)).filter(~((F.col("x") == 3) & (F.col("y") == 3)))
    with pytest.raises(Exception, match="not dense"):
        normals.normal_estimate(holed).collect()


def plain_median_cut(colors, weights, wanted):
    """The contract one box at a time."""
    boxes = [list(range(len(colors)))]
    while len(boxes) < wanted:
        open_ = [(-sum(weights[i] for i in b), n) for n, b in enumerate(boxes) if len(b) > 1]
        if not open_:
            break
        box = boxes[min(open_)[1]]
        spans = [max(colors[i][c] for i in box) - min(colors[i][c] for i in box) for c in range(3)]
        axis = spans.index(max(spans))
        total, top = sum(weights[i] for i in box), max(colors[i][axis] for i in box)
        below = lambda v: sum(weights[i] for i in box if colors[i][axis] < v)
        upper = [i for i in box if colors[i][axis] == top or 2 * below(colors[i][axis]) >= total]
        boxes[min(open_)[1]] = [i for i in box if i not in upper]
        boxes.append(upper)
    out = {}
    for box in boxes:
        total = sum(weights[i] for i in box)
        mean = tuple((2 * sum(colors[i][c] * weights[i] for i in box) + total) // (2 * total) for c in range(3))
        out.update({colors[i]: mean for i in box})
    return out


def test_median_cut_helper_over_several_images():
    rng = np.random.default_rng(5)
    rgb, weight, starts, want = [], [], [], []
    for size in (1, 2, 40, 7, 300):
        colors = sorted({tuple(c) for c in rng.integers(0, 32, (size, 3)).tolist()})
        weights = rng.integers(1, 50, len(colors)).tolist()
        starts.append(len(rgb))
        cut = plain_median_cut(colors, weights, 9)
        for color, w in zip(colors, weights):
            rgb.append((color[0] << 16) | (color[1] << 8) | color[2])
            weight.append(w)
            r, g, b = cut[color]
            want.append((r << 16) | (g << 8) | b)
    got = median_cut(np.array(rgb), np.array(weight), np.array(starts), 9)
    assert got.tolist() == want


def test_a_large_image_is_cut_in_parts_with_the_same_colours(spark, images, monkeypatch):
    from pixelloom.operators import cuts

    smooth = np.dstack([np.add.outer(np.arange(48), np.arange(40)) * k % 256 for k in (1, 2, 3)] + [np.full((48, 40), 255)])
    table = images.table(a=noise(40, 48, 5), b=smooth, c=noise(9, 3, 6), d=np.full((48, 40, 4), 7), e=noise(40, 48, 7) // 128 * 255)
    for colors in (2, 7, 32):
        monkeypatch.setattr(cuts, "CUT_COLORS", 1 << 16)
        whole = images.arrays(palette.quantize(table, colors))
        monkeypatch.setattr(cuts, "CUT_COLORS", 300)
        parted = palette.quantize(table, colors)
        parts = cuts.histogram_parts(table).filter("image_id = 'a'")
        assert parts.count() == 7 and parts.agg(F.max(F.size("hist"))).first()[0] < 450
        got = images.arrays(parted)
        for name, picture in whole.items():
            assert (got[name] == picture).all(), (name, colors)


@pytest.mark.parametrize("colors", [1, 5, 300])
def test_quantize_against_the_contract(images, colors):
    picture = noise(11, 6, seed=9) // 16 * 16
    out = images.arrays(palette.quantize(images.table(p=picture, one=noise(1, 1)), colors))
    flat = [tuple(c) for c in picture[..., :3].reshape(-1, 3).tolist()]
    keys = sorted(set(flat))
    cut = plain_median_cut(keys, [flat.count(k) for k in keys], min(256, max(2, colors)))
    want = np.array([cut[c] for c in flat]).reshape(6, 11, 3)
    assert (out["p"][..., :3] == want).all()
    assert (out["p"][..., 3] == np.where(picture[..., 3] >= 128, 255, 0)).all()


def test_holes_raise(images):
    holed = images.table(p=noise(4, 4)).filter("not (x = 1 and y = 2)")
    with pytest.raises(Exception, match="not dense"):
        palette.pixelize(holed, 4, 4, 4).collect()
    with pytest.raises(Exception, match="not dense"):
        to_bands(holed).collect()


def test_spritify_equals_the_chain_of_operators(images):
    source = images.table(d=disc(40, 30), n=noise(20, 20), e=np.zeros((9, 9, 4), dtype=int))
    small = palette.pixelize(source, 10, 9, 4)
    aligned = geometry.center_align(geometry.crop_to_content(small), 14, 12)
    chain = normals.normal_estimate(aligned)
    fused = sprites.spritify(source, 14, 12, 10, 9, 4)
    assert fused.count() == 3 * 14 * 12
    assert fused.exceptAll(chain.select(fused.columns)).count() == 0


def test_palette_order_and_counts(images):
    picture = noise(20, 10) // 64 * 64
    rows = palette.palette(images.table(p=picture)).orderBy("palette_ix").collect()
    flat = [tuple(c) for c in picture.reshape(-1, 4).tolist()]
    want = sorted(((-flat.count(c), c) for c in set(flat)))
    assert [(-r.n, (r.r, r.g, r.b, r.a)) for r in rows] == want
    assert [r.palette_ix for r in rows] == list(range(len(rows)))


def test_color_sketches_merge_within_their_error(images):
    table = images.table(a=noise(90, 80, 1), b=noise(60, 70, 2), c=np.full((4, 4, 4), 9))
    exact = {r.image_id: r.colors for r in palette.color_counts(table).collect()}
    sketches = palette.color_sketches(table)
    for r in palette.color_estimates(sketches).collect():
        assert abs(r.estimate - exact[r.image_id]) <= max(1, 0.05 * exact[r.image_id])
    total = palette.color_estimates(palette.merged_sketches(sketches)).first()
    every = table.select("r", "g", "b").distinct().count()
    assert abs(total.estimate - every) <= 0.05 * every
    parts = table.withColumn("part", F.col("y") % 5)
    again = palette.merged_sketches(palette.color_sketches(parts, "image_id", "part"), "image_id")
    same = {r.image_id: r.estimate for r in palette.color_estimates(again).collect()}
    assert all(abs(same[n] - exact[n]) <= max(1, 0.05 * exact[n]) for n in exact)


def test_check_images(images):
    good, hole = images.table(good=noise(6, 5)), images.table(hole=noise(6, 5)).filter("NOT (x = 2 AND y = 2)")
    doubled = images.table(twice=noise(3, 3)).withColumn(
        "x", F.when((F.col("x") == 2) & (F.col("y") == 0), 1).otherwise(F.col("x"))
    )
    outside = images.table(out=noise(3, 3)).withColumn("y", F.when(F.col("x") == 0, 7).otherwise(F.col("y")))
    value = images.table(value=noise(3, 3)).withColumn("a", F.col("a") + 200)
    pixels = good.union(hole).union(doubled).union(outside).union(value)
    listed = images_of(pixels).unionByName(
        images_of(images.table(lost=noise(2, 2)))
    )
    ok = {r.image_id: r.ok for r in quality.check_images(pixels, listed).collect()}
    assert ok == {"good": True, "hole": False, "twice": False, "value": False, "lost": False, "out": False}


def test_pack_and_slice_are_inverse(images, spark):
    pictures = {f"f{i}": noise(5, 4, i) for i in range(4)}
    frames = spark.createDataFrame(
        [("s", 10, "f2"), ("s", 11, "f0"), ("s", 15, "f2"), ("s", 40, "f3"), ("t", 1, "f1")],
        "seq_id string, frame_no int, image_id string",
    )
    table = images.table(**pictures)
    sheet, strip, rejected = sheets.pack_sheet(frames, table)
    assert {tuple(r) for r in sheet.collect()} == {("s", 4, 5, 4, 20, 4), ("t", 1, 5, 4, 5, 4)}
    assert rejected.count() == 0
    out = images.arrays(strip)
    want = np.concatenate([pictures[n] for n in ("f2", "f0", "f2", "f3")], axis=1)
    assert (out["s"] == want).all() and (out["t"] == pictures["f1"]).all()
    cut = sheets.slice_sheet(strip, 5, 4)
    back = images.arrays(cut.withColumn("k", F.concat_ws("/", "sheet_id", "frame_no")), key="k")
    for i, name in enumerate(("f2", "f0", "f2", "f3")):
        assert (back[f"s/{i}"] == pictures[name]).all()


def test_slice_of_a_grid_sheet_reads_rows_then_columns(images):
    picture = noise(7, 6)
    cut = sheets.slice_sheet(images.table(p=picture), 3, 2)
    back = images.arrays(cut.withColumn("k", F.col("frame_no").cast("string")), key="k")
    assert len(back) == 6
    for i in range(6):
        x, y = i % 2 * 3, i // 2 * 2
        assert (back[str(i)] == picture[y : y + 2, x : x + 3]).all()


def test_unequal_empty_and_unknown_frames_are_rejected(images, spark):
    frames = spark.createDataFrame(
        [("bad", 0, "a"), ("bad", 1, "b"), ("empty", 0, None), ("lost", 0, "zz"), ("ok", 0, "a")],
        "seq_id string, frame_no int, image_id string",
    )
    table = images.table(a=disc(32, 32), b=disc(16, 16))
    _, strip, rejected = sheets.pack_sheet(frames, table)
    reasons = {r.seq_id: r.reason.split(":")[0] for r in rejected.collect()}
    assert reasons == {"bad": "ValueError", "empty": "ValueError", "lost": "KeyError"}
    assert {r.image_id for r in strip.select("image_id").distinct().collect()} == {"ok"}


def test_sheet_meta_keeps_sequence_meta(spark):
    row = sheets.sheet_meta(spark.sql("SELECT 's' AS sheet_id, map('fps', '12', 'packed', 'x') AS meta")).first()
    assert row.meta == {"fps": "12", "packed": "true"}


def test_pair_without_normal_and_size_mismatch(images):
    diffuse = images.table(a=disc(8, 8), b=disc(6, 6), c=disc(5, 5))
    shaded = normals.normal_estimate(images.table(a=disc(8, 8), b=disc(4, 4)))
    good, rejects = pairs.sprite_pair(diffuse, shaded)
    assert [r.image_id for r in rejects.collect()] == ["b"]
    assert {(r.image_id, r.has_normal) for r in good.select("image_id", "has_normal").distinct().collect()} == {
        ("a", True), ("c", False),
    }
    assert pairs.sprite_pair(diffuse)[0].filter("has_normal").count() == 0


def test_relight_flat_pixel_under_the_light(images):
    white = np.full((1, 1, 4), 255)
    lit = pairs.relight(pairs.sprite_pair(images.table(w=white))[0], [pairs.Light(z=1.0)]).first()
    want = [min(1.0, 0.15 + c / 255 * 1.4 / 1.35) for c in (255, 242, 208)]
    assert [lit.lr, lit.lg, lit.lb] == [int(v * 255 + 0.5) for v in want]
    assert pairs.relight(pairs.sprite_pair(images.table(w=white * 0))[0]).count() == 0


def test_ensure_rgba_rejects_other_shapes(images):
    with pytest.raises(ValueError):
        channels.ensure_rgba(images.table(a=disc(2, 2)), 2)


def test_meta_and_mask_columns(images):
    table = images.table(d=disc(8, 8))
    assert images_of(table).collect()[0].asDict() == {
        "image_id": "d", "width": 8, "height": 8, "kind": "image", "meta": {},
    }
    assert channels.content_mask(table).filter("m = 255").count() == channels.content_pixels(table).count()
    assert table.columns == list(PIXEL)
