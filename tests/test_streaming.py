"""Streams over several files must equal the batch operators."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pixelloom.operators import runs
from pixelloom.plans import inputs
from pixelloom.session import checkpoint_dir
from pixelloom.streaming import generation
from pixelloom.streaming import runs as run_streams

SCHEMA = "event_id int, run_id string, ts timestamp, status string, progress double, message string"
START = datetime(2024, 1, 1)


def events(*rows):
    return [
        (i, run, START + timedelta(seconds=second), status, 0.5, f"m{i}")
        for i, (run, second, status) in enumerate(rows)
    ]


def write_files(spark, path, rows, size):
    """Consecutive files, oldest first."""
    for n, start in enumerate(range(0, len(rows), size)):
        spark.createDataFrame(rows[start : start + size], SCHEMA).coalesce(1).write.parquet(f"{path}/{n:03d}")


ROWS = events(
    ("fast", 0, "queued"), ("fast", 10, "running"), ("slow", 20, "queued"), ("fast", 30, "done"),
    ("fail", 40, "queued"), ("slow", 50, "running"), ("fail", 60, "error"), ("late", 70, "queued"),
    ("edge", 100, "queued"), ("slow", 640, "done"), ("edge", 700, "done"), ("late", 900, "running"),
    ("fast", 950, "running"), ("late", 1000, "done"), ("open", 1900, "queued"), ("open", 1950, "running"),
)


def stream_of(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_status_stream_equals_batch(spark, tmp_path):
    write_files(spark, tmp_path / "in", ROWS, 3)
    query = generation.start_update_sink(
        run_streams.stream_status(stream_of(spark, tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")
    )
    query.awaitTermination()
    got = generation.latest_updates(spark.read.parquet(str(tmp_path / "out")), "run_id")
    want = runs.latest_status(spark.createDataFrame(ROWS, SCHEMA))
    columns = want.columns
    assert {tuple(r) for r in got.select(columns).collect()} == {tuple(r) for r in want.collect()}
    done = want.filter("run_id = 'edge'").first()
    assert done.progress == 1.0 and done.terminal and done.error is None
    assert want.filter("run_id = 'fail'").first().error == "m6"


def drain(spark, path, size, tmp, rows, delay):
    """Files of `size` events, one per micro-batch: (outcomes, late event ids, events of no output)."""
    write_files(spark, path, rows, size)
    sink = str(tmp / f"out-{path.name}")
    run_streams.start_timeouts(stream_of(spark, path), sink, str(tmp / f"cp-{path.name}"), delay).awaitTermination()
    done = run_streams.written(spark, sink, run_streams.OUTCOME).collect()
    assert len({r.run_id for r in done}) == len(done), "one outcome per run"
    late = run_streams.written(spark, sink, run_streams.LATE).collect()
    assert len({r.event_id for r in late}) == len(late)
    return {r.run_id: (r.at, r.status) for r in done}, {r.event_id for r in late}


def batch_outcomes(spark, rows, late=(), delay=0):
    kept = spark.createDataFrame([r for r in rows if r[0] not in late], SCHEMA)
    return {r.run_id: (r.submitted, r.outcome) for r in runs.job_outcomes(kept, delay=delay).collect()}


def test_timeouts_in_one_or_many_batches_equal_batch(spark, tmp_path):
    want = batch_outcomes(spark, ROWS)
    assert {k: v[1] for k, v in want.items()} == {"fast": "done", "slow": "timeout", "fail": "error", "late": "timeout", "edge": "done"}
    assert drain(spark, tmp_path / "a", len(ROWS), tmp_path, ROWS, "0 seconds") == (want, set())
    assert drain(spark, tmp_path / "b", 2, tmp_path, ROWS, "0 seconds") == (want, set())


def test_files_out_of_order_give_the_batch_outcomes_and_the_late_events(spark, tmp_path):
    import random

    draw = random.Random(8)
    rows = events(*[
        (f"r{draw.randint(0, 12)}", second, draw.choice(["queued", "running", "running", "done", "error"]))
        for second in sorted(draw.sample(range(1, 4000), 70))
    ])
    shuffled = sorted(rows, key=lambda r: r[2] + timedelta(seconds=draw.randint(0, 500)))
    got, late = drain(spark, tmp_path / "wide", 9, tmp_path, shuffled, "600 seconds")
    assert late == set() and got == batch_outcomes(spark, rows, delay=600)
    got, late = drain(spark, tmp_path / "narrow", 9, tmp_path, shuffled, "60 seconds")
    # an event is late when it is at or behind the watermark of the files before its own
    expected = {
        r[0] for i, r in enumerate(shuffled)
        if i >= 9 and r[2] <= max(x[2] for x in shuffled[: i // 9 * 9]) - timedelta(seconds=60)
    }
    assert late == expected and late
    assert got == batch_outcomes(spark, rows, late, delay=60)


def test_status_state_ends(spark, tmp_path):
    rows = events(*[(f"r{i // 3}", 100 * i, ("queued", "running", "done")[i % 3]) for i in range(60)])
    write_files(spark, tmp_path / "in", rows, 6)
    with run_streams.rocksdb(spark):
        query = generation.start_update_sink(
            run_streams.stream_status(stream_of(spark, tmp_path / "in"), delay="10 seconds", keep=900),
            str(tmp_path / "out"), str(tmp_path / "cp"),
        )
        query.awaitTermination()
    states = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    got = generation.latest_updates(spark.read.parquet(str(tmp_path / "out")), "run_id")
    want = runs.latest_status(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in got.select(want.columns).collect()} == {tuple(r) for r in want.collect()}
    kept = spark.read.format("statestore").load(str(tmp_path / "cp"), stateVarName="run")
    # 20 runs went by; only those of the last 900 seconds are held
    assert 0 < kept.count() <= 6, kept.count()
    assert len(states) >= 10


def test_sprite_stream_routes_and_stores(spark, tmp_path):
    asked = [(f"i{n}", "text2img" if n % 3 else "text2vid", "m", f"p{n}", n) for n in range(7)]
    schema = "image_id string, op string, model_id string, prompt string, seed int"
    for n in range(0, 7, 3):
        spark.createDataFrame(asked[n : n + 3], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    models = spark.createDataFrame([("a", 0, "m", ["text2img"])], "adapter string, priority int, model_id string, ops array<string>")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    generation.start_sprite_stream(
        stream, models, str(tmp_path / "out"), str(tmp_path / "cp"), render=16, width=10, height=10, grid_w=8, grid_h=8, colors=4
    ).awaitTermination()
    sprites = spark.read.parquet(str(tmp_path / "out" / "sprites"))
    counts = {r.image_id: r["count"] for r in sprites.groupBy("image_id").count().collect()}
    assert counts == {f"i{n}": 100 for n in range(7) if n % 3}
    rejected = spark.read.parquet(str(tmp_path / "out" / "rejected"))
    assert {r.image_id for r in rejected.collect()} == {"i0", "i3", "i6"}
    assert rejected.filter(F.col("reason").isNull()).count() == 0


def test_event_stream_reads_a_file_and_a_folder(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for name, parts in (("file", 0), ("folder", 3)):
        if parts:
            table.repartition(parts).write.parquet(str(tmp_path / name / "events.parquet"))
            source = str(tmp_path / name)
        else:
            source = "/root/testdata/sf0.001"
        stream = inputs.event_stream(spark, source)
        stream.writeStream.format("memory").queryName(f"seen_{name}").trigger(availableNow=True).start().awaitTermination()
        assert spark.table(f"seen_{name}").count() == table.count()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Elsewhere())
