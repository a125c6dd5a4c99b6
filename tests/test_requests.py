"""Request, run and extension operators."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from pixelloom.model import PIXEL, PIXEL_SCHEMA
from pixelloom.operators import extension, requests, runs
from pixelloom.plans import sprites
from pixelloom.plans.pattern_model import PatternModel
from pixelloom.sources.artifacts import encode_png
from pixelloom.sources.generate import prompt_images
from pixelloom.sources.images import decode_outputs

TEXTS = [
    "seed=12", "seed= 12 ", "seed=+3", "seed=1_000", "seed=-0", "f=1.5", "f=.5", "f=5.", "f=1e3", "f=-1E-2",
    "f=inf", "f=-Infinity", "f=NaN", "f=1_0.2_5", "b=true", "b=FALSE", "b= true", "s=", "s=a=b", "=x",
    "s=1_", "s=_1", "s=1e", "s=0x10", "s=1,5", "noequals", "", "s=ünï", "s=1.5.2", "s=--1",
]


def test_integer_params_take_or_refuse_requests(spark):
    rows = spark.createDataFrame(
        [(1, {"w": " 12 ", "n": "1_0"}), (2, {"w": "0", "n": "x"}), (3, {"w": None, "n": "3"}), (4, {"n": "3"}), (5, None),
         (6, {"w": "3.0", "n": "3"}), (7, {"w": "99999999999999999999", "n": "64"}), (8, {"w": "+8", "n": "64", "other": "y"})],
        "id int, params map<string,string>",
    )
    accepted, rejected = requests.integer_params(rows, {"w": (1, 100), "n": (2, 64)})
    assert {(r.id, r.w, r.n) for r in accepted.collect()} == {(1, 12, 10), (8, 8, 64)}
    start = "ValueError: not usable: "
    assert {r.id: r.reason for r in rejected.collect()} == {
        2: start + "w=0, n=x", 3: start + "w=null", 4: start + "w=null", 5: start + "w=null, n=null", 6: start + "w=3.0",
        7: start + "w=99999999999999999999",
    }
    assert requests.integer_params(rows.limit(0), {"w": (1, 2)})[0].collect() == []


def test_sprites_with_own_sizes_equal_those_of_one_size(spark):
    kinds = [(20, 9, 8, 5, 6, 4), (16, 12, 11, 7, 8, 6), (16, 9, 11, 5, 8, 30)]
    names = ("render", "width", "height", "grid_w", "grid_h", "colors")
    rows = [(f"i{i}", f"p{i % 4}", i, *kinds[i % 3]) for i in range(12)]
    asked = spark.createDataFrame(rows, "image_id string, prompt string, seed int, " + ", ".join(f"{n} int" for n in names))
    prompt, seed = F.col("prompt"), F.col("seed")
    got = sprites.single_sprite(asked, prompt, seed, **{n: F.col(n) for n in names})
    want = None
    for kind in kinds:
        same = asked.filter(F.struct(*names) == F.struct(*(F.lit(v) for v in kind)))
        one = sprites.single_sprite(same, prompt, seed, **dict(zip(names, kind)))
        want = one if want is None else want.unionByName(one)
    assert got.columns == want.columns
    got, want = sorted(map(tuple, got.collect())), sorted(map(tuple, want.collect()))
    assert got == want and len(got) == 4 * sum(k[1] * k[2] for k in kinds)


def python_value(text):
    """The typing rule in plain Python: bool, then int, then float, else string."""
    if text.lower() in ("true", "false"):
        return "bool"
    for kind in (int, float):
        try:
            kind(text)
            return kind.__name__
        except ValueError:
            pass
    return "string"


def test_parse_params_types_like_python(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    parsed, rejected = requests.parse_params(rows, "text")
    got = {r.text: r for r in parsed.collect()}
    assert {r.text for r in rejected.collect()} == {t for t in TEXTS if "=" not in t}
    for text in TEXTS:
        if "=" not in text:
            continue
        name, value = text.split("=", 1)
        row = got[text]
        assert (row.name, row.type) == (name, python_value(value)), text
        if row.type == "int":
            assert row.int_value == int(value)
        elif row.type == "float":
            same = row.float_value == float(value) or (math.isnan(row.float_value) and math.isnan(float(value)))
            assert same, text
        elif row.type == "string":
            assert row.value == value


def test_layering_presence_and_pass_through(spark):
    declared = spark.createDataFrame(
        [("t", "seed", "int", "0"), ("t", "width", "int", "96"), ("t", "prompt", "string", "")],
        "scope_id string, name string, type string, default_value string",
    )
    asked = spark.createDataFrame(
        [
            ("plain", "t", {}),
            ("over", "t", {"seed": "7", "model": "m"}),
            ("null", "t", {"width": None}),
            ("none", "t", None),
            ("unknown", "u", {"x": "1"}),
        ],
        "request_id string, scope_id string, overrides map<string,string>",
    )
    config = {"width": "64", "normal": "true"}
    params = {r.request_id: r.params for r in requests.resolve_params(asked, declared, config).collect()}
    base = {"seed": "0", "width": "64", "prompt": ""}
    assert params["plain"] == base and params["none"] == base
    assert params["over"] == {**base, "seed": "7", "model": "m"}
    assert params["null"] == {**base, "width": None}
    assert params["unknown"] == {"x": "1"}


def test_templates_fill_exact_strings_at_any_depth(spark):
    rows = spark.createDataFrame(
        [
            (1, ("${p}", ["x", "${q}", None], {"k": ["${p}", "a${p}", "${p} "]}), {"p": "P", "q": None}),
            (2, ("${zz}", ["${yy}"], {"k": ["${p}"]}), {"p": "P"}),
            (3, ("plain", None, None), None),
        ],
        "id int, v struct<a:string,b:array<string>,c:map<string,array<string>>>, params map<string,string>",
    )
    filled, rejected = requests.fill_templates(rows, "v")
    row = {r.id: r.v.asDict() for r in filled.collect()}
    assert row == {
        1: {"a": "P", "b": ["x", None, None], "c": {"k": ["P", "a${p}", "${p} "]}},
        3: {"a": "plain", "b": None, "c": None},
    }
    assert [r.reason for r in rejected.collect()] == ["KeyError: undefined param yy, zz"]


def test_routing_prefers_the_first_adapter_and_never_falls_back(spark):
    models = extension.model_listing(spark, [PatternModel()])
    asked = spark.createDataFrame(
        [("1", "text2img", "stub-image"), ("2", "text2img", "does-not-exist"), ("3", "text2vid", "stub-image")],
        "request_id string, op string, model_id string",
    )
    routed, rejected = requests.route(asked, models)
    assert [(r.request_id, r.adapter) for r in routed.collect()] == [("1", "pattern")]
    assert {r.request_id for r in rejected.collect()} == {"2", "3"}
    assert rejected.filter("request_id = '2'").first().reason == (
        "LookupError: no adapter serves op='text2img' model_id='does-not-exist'"
    )
    first = spark.createDataFrame(
        [("b", 1, "m", ["x"]), ("a", 2, "m", ["x", "y"])],
        "adapter string, priority int, model_id string, ops array<string>",
    )
    asked = spark.createDataFrame([("1", "x", "m"), ("2", "y", "m")], "request_id string, op string, model_id string")
    assert {(r.request_id, r.adapter) for r in requests.route(asked, first)[0].collect()} == {("1", "b"), ("2", "a")}


def test_candidates_default_pick_and_reject(spark):
    nodes = spark.createDataFrame(
        [("r", "a", ["w1", "w2"]), ("r", "b", ["w1"]), ("q", "a", ["w1"])],
        "run_id string, node_id string, candidates array<string>",
    )
    picks = spark.createDataFrame([("r", "a", "w2"), ("r", "b", "w9")], "run_id string, node_id string, pick string")
    chosen, rejected = requests.choose_candidates(nodes, picks)
    assert {(r.run_id, r.node_id, r.chosen) for r in chosen.collect()} == {("r", "a", "w2"), ("q", "a", "w1")}
    assert [r.node_id for r in rejected.collect()] == ["b"]


def test_progress_is_nested_and_ends_at_one(spark):
    graph = spark.createDataFrame(
        [("gen", 0, "t2i", 0), ("spr", 1, "px", 0), ("spr", 1, "pair", 1)],
        "task_node string, task_ix int, tool_node string, tool_ix int",
    )
    events = spark.createDataFrame(
        [("gen", "t2i", 0.5), ("spr", "px", -1.0), ("spr", "pair", 1.0), ("spr", "pair", 9.0)],
        "task_node string, tool_node string, fraction double",
    )
    placed, unknown = runs.overall_progress(events.unionByName(events.limit(1).withColumn("tool_node", F.lit("x"))), graph)
    assert sorted(r.progress for r in placed.collect()) == [0.25, 0.5, 1.0, 1.0]
    assert [r.reason for r in unknown.collect()] == ["LookupError: gen/x is no node of the graph"]


ASKED = "request_id string, op string, model_id string, inputs map<string,string>, params map<string,string>"


def small_png(spark):
    pixels = spark.createDataFrame([("p", 2, 1, 0, 0, 10, 20, 30, 40), ("p", 2, 1, 1, 0, 1, 2, 3, 255)], PIXEL_SCHEMA)
    return encode_png(pixels).select(F.base64("png")).first()[0]


def test_infer_gives_errors_as_rows_and_decodes(spark):
    asked = spark.createDataFrame(
        [
            ("1", "text2img", "stub-image", {"prompt": "hello"}, {"width": "6", "height": "4"}),
            ("2", "text2img", "nope", {}, {}),
            ("3", "text2img", "stub-image", {}, {"width": "six"}),
            ("4", "img2img", "stub-image", {"prompt": "x", "image_b64": small_png(spark)}, {}),
            ("5", "img2img", "stub-image", {"prompt": "x"}, {}),
        ],
        ASKED,
    )
    done, failed = extension.split_errors(extension.infer(asked, PatternModel))
    assert {r.request_id: r.reason.split(":")[0] for r in failed.collect()} == {"2": "LookupError", "3": "ValueError", "5": "ValueError"}
    first, none = requests.first_output(done)
    assert none.count() == 0
    pixels, rejects = decode_outputs(first)
    assert pixels.filter("image_id = '1'").count() == 24 and rejects.count() == 0
    turned = pixels.filter("image_id = '4' AND x = 0").first()
    assert (turned.width, turned.height, turned.r, turned.g, turned.b, turned.a) == (2, 1, 245, 235, 225, 40)


def counting_model():
    """Its pictures report how many of its models this process has open."""

    class Counting(PatternModel):
        name, live = "counting", [0]

        def __init__(self):
            self.live[0] += 1

        def supports(self, op, model_id):
            return True

        def close(self):
            self.live[0] -= 1

        def run_batch(self, op, model_id, jobs):
            return [{"rgba": bytes([self.live[0]] * 4), "w": len(jobs), "h": 1} for _ in jobs]

    return Counting


def test_routed_inference_opens_one_model_at_a_time(spark):
    def broken():
        raise OSError("no weights")

    rows = [(f"{i}", "text2img", f"m{i % 3}", {}, {}, "counting") for i in range(60)]
    rows += [("x", "text2img", "m0", {}, {}, "absent"), ("y", "text2img", "m0", {}, {}, "broken"), (None, "text2img", None, None, None, "counting")]
    routed = spark.createDataFrame(rows, ASKED + ", adapter string")
    adapters = {"counting": counting_model(), "broken": broken}
    out = {r.request_id: r for r in extension.infer_routed(routed, adapters, at_once=7).collect()}
    assert len(out) == 63
    assert out["x"].error == "LookupError: no adapter is called absent" and out["y"].error == "OSError: no weights"
    fine = [r.outputs[0] for r in out.values() if r.outputs]
    assert len(fine) == 61 and {bytes(o.rgba)[0] for o in fine} == {1}  # never two at once
    assert max(o.w for o in fine) == 7
    dealt = extension.infer_routed(routed, adapters, spread=5)
    assert dealt.filter("error IS NULL").count() == 61
    assert extension.infer_routed(routed.limit(0), adapters).count() == 0


def test_outputs_without_a_picture_are_rejected(spark):
    kinds = "request_id string, output struct<png: binary, rgba: binary, w: int, h: int>"
    rows = [("a", (None, b"abcd", 1, 1)), ("b", (None, b"abc", 1, 1)), ("c", (None, None, None, None)), ("d", (b"no png", None, None, None)), ("e", None)]
    pixels, rejects = decode_outputs(spark.createDataFrame(rows, kinds))
    assert [tuple(r)[5:] for r in pixels.collect()] == [(97, 98, 99, 100)]
    assert {r.image_id for r in rejects.collect()} == {"b", "c", "d", "e"}


def test_toolbox_checks_names_parameters_and_columns(spark):
    box = extension.Toolbox()

    @box.operator("double", needs={"x": "int"}, gives=("x", "y"))
    def double(df, by):
        return df.withColumn("y", F.col("x") * by)

    with pytest.raises(ValueError, match="taken"):
        box.operator("double")(lambda df: df)
    with pytest.raises(ValueError, match="no kind"):
        box.operator("other", kind="magic")(lambda df: df)
    with pytest.raises(TypeError, match="takes no frame"):
        box.operator("other")(lambda: None)
    with pytest.raises(KeyError):
        box["missing"]
    four = spark.sql("SELECT 4 AS x")
    assert box["double"](four, by=3).first().y == 12
    with pytest.raises(TypeError, match="'by'"):
        double(four)
    with pytest.raises(TypeError, match=r"x \(string\)"):
        double(spark.sql("SELECT '4' AS x"), by=3)
    with pytest.raises(TypeError, match=r"x \(missing\)"):
        double(spark.range(1), by=3)
    with pytest.raises(TypeError, match="did not make"):
        box.operator("lazy", gives=("z",))(lambda df: df)(four)
    assert list(box) == ["double", "lazy"]


def test_glyph_table_function_equals_the_generator(spark):
    extension.register_glyph_table(spark)
    asked = [("a", "red fox", 3, 7, 9), ("b", "", 0, 1, 1), ("c", "é", -5, 20, 3)]
    df = spark.createDataFrame([*asked, ("n", None, 1, 2, 2), ("z", "p", 1, 0, 4)], "image_id string, prompt string, seed long, w int, h int")
    got = spark.sql("SELECT image_id, w AS width, h AS height, g.* FROM {df} d, LATERAL glyph(d.prompt, d.seed, d.w, d.h) g", df=df)
    rows = {tuple(r) for r in got.collect()}
    want = set()
    for name, prompt, seed, w, h in asked:
        one = spark.createDataFrame([(name, prompt, seed)], "image_id string, prompt string, seed long")
        want |= {tuple(r) for r in prompt_images(one, F.col("prompt"), F.col("seed"), w, h).select(*PIXEL).collect()}
    assert rows == want
    assert spark.sql("SELECT count(*) FROM glyph('one', 2L, 5, 4)").first()[0] == 20


def test_json_templates_keep_types(spark):
    import json

    types = {"i": "int", "f": "float", "b": "bool", "s": "string", "bad": "int", "none": "int"}
    texts = {"i": "7", "f": "2.5", "b": "TRUE", "s": 'q"\\ $1 ${i}', "bad": "x7", "none": None, "free": "9"}
    rows = [
        (1, '{"a": "${i}", "b": ["${f}", "${b}", {"c": "${s}"}], "${i}": "${bad}", "d": "x ${i}", "e": "${none}", "g": "${free}"}'),
        (2, '"${i}"'), (3, '["${i}","${i}"]'), (4, '{"a": "say \\"${i}", "b": "\\"${i}\\""}'), (5, '["${nope}", "${also}"]'),
        (6, "{broken"), (7, None), (8, '{"deep": {"er": [[["${tree}"]]]}}'),
    ]
    df = spark.createDataFrame([(i, t, texts, types) for i, t in rows], "id int, node string, texts map<string,string>, types map<string,string>")
    params = F.map_concat(requests.json_params(F.col("texts"), F.col("types")), F.create_map(F.lit("tree"), F.lit('{"x": [1, true]}')))
    filled, rejected = requests.fill_json(df.withColumn("params", params), "node")
    got = {r.id: r.node and json.loads(r.node) for r in filled.select("id", F.to_json("node").alias("node")).collect()}
    assert got == {
        1: {"a": 7, "b": [2.5, True, {"c": texts["s"]}], "${i}": "x7", "d": "x ${i}", "e": None, "g": "9"},
        2: 7, 3: [7, 7], 4: {"a": 'say "${i}', "b": '"${i}"'}, 7: None, 8: {"deep": {"er": [[[{"x": [1, True]}]]]}},
    }
    assert {r.id: r.reason for r in rejected.collect()} == {5: "KeyError: undefined param also, nope", 6: "ValueError: no JSON"}
    kind = filled.filter("id = 1").select(F.schema_of_variant("node")).first()[0]
    assert "a: BIGINT" in kind and "d: STRING" in kind


def test_strict_mode_fails_with_the_reason(spark):
    rejects = spark.sql("SELECT 'a' AS id, 'ValueError: bad' AS reason")
    with pytest.raises(Exception, match="ValueError: bad"):
        extension.require_none(rejects).collect()
    assert extension.require_none(rejects.limit(0)).collect() == []


def test_outputs_are_decoded_in_one_pass_of_the_model(spark):
    rows = [(f"r{i}", "text2img", "stub-image", {"prompt": "p"}, {"width": "3", "height": "2", "seed": str(i)}) for i in range(40)]
    kinds = "request_id string, op string, model_id string, inputs map<string,string>, params map<string,string>"
    done, _ = extension.split_errors(extension.infer(spark.createDataFrame(rows, kinds), PatternModel))
    pixels, _ = decode_outputs(requests.first_output(done)[0])
    text = pixels._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in text and text.count("MapInArrow") == 2
    assert pixels.count() == 40 * 6


def test_cuts_take_bounded_slices():
    import pyarrow as pa

    from pixelloom.operators import cuts

    lists = [[1, 2]] * 1500 + [[0] * (cuts.CUT_ENTRIES + 5), [], [3]]
    batch = pa.RecordBatch.from_pydict({"px": pa.array(lists, pa.list_(pa.int64()))})
    parts = list(cuts.bounded([batch.slice(1)], "px"))
    assert [x for p in parts for x in p.column("px").to_pylist()] == lists[1:]
    assert max(p.num_rows for p in parts) <= cuts.CUT_IMAGES
    assert all(p.num_rows == 1 or len(p.column("px").flatten()) <= cuts.CUT_ENTRIES for p in parts)
