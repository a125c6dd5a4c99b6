"""Requests as a stream: route, render, spritify, store."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pixelloom.operators.requests import route
from pixelloom.plans.sprites import single_sprite

# The trigger where none is given: what is there, then stop.
AVAILABLE_NOW = {"availableNow": True}


def start_sprite_stream(
    requests: DataFrame,
    models: DataFrame,
    path: str,
    checkpoint: str,
    summarize: Callable[[DataFrame], DataFrame] = lambda sprites: sprites,
    trigger: dict[str, Any] | None = None,
    **sizes: int,
) -> StreamingQuery:
    """Turn a stream of requests into stored sprites, batch by batch, without state.

    ``requests`` has image_id, op, model_id, prompt, seed. A micro-batch is
    routed with one join and written to its own ``batch`` folder, overwritten
    when the batch is retried. Rejected requests go to ``rejected``.
    """

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            routed, rejected = route(held, models)
            sprites = single_sprite(routed, F.col("prompt"), F.col("seed"), **sizes)
            summarize(sprites).write.mode("overwrite").parquet(f"{path}/sprites/batch={number}")
            rejected.write.mode("overwrite").parquet(f"{path}/rejected/batch={number}")
        finally:
            held.unpersist()

    return (
        requests.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def start_update_sink(
    rows: DataFrame, path: str, checkpoint: str, trigger: dict[str, Any] | None = None
) -> StreamingQuery:
    """Write an update-mode stream to one folder per micro-batch (safe to retry)."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        rows.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def latest_updates(updates: DataFrame, key: str) -> DataFrame:
    """The newest row per key of a table written by ``start_update_sink``."""
    row = F.struct(*[c for c in updates.columns if c not in (key, "batch")])
    return updates.groupBy(key).agg(F.max_by(row, "batch").alias("row")).select(key, "row.*")
