"""Runs: progress, latest status, timeouts, primary artifact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Run states and the time a job may take.
TERMINAL = ("done", "error")
TIMEOUT_SECONDS = 600


def node_fraction(index: Column, total: Column, fraction: Column) -> Column:
    """Progress of node ``index`` of ``total`` at an inner fraction, clamped to 0..1."""
    inner = F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0))
    return index / total + (F.lit(1.0) / total) * inner


def overall_progress(events: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Progress of the whole task at each tool event, and the events of no node.

    ``events`` (run_id, ts, task_node, tool_node, fraction); ``nodes``
    (task_node, task_ix, tool_node, tool_ix) lists the graph in run order. A
    tool's fraction is nested in its workflow and that in the task. The counts
    come from the graph, not from the events, so there is no window per run.
    """
    tools = nodes.groupBy("task_node").agg(F.count(F.lit(1)).alias("tools"))
    tasks = nodes.agg(F.count_distinct("task_node").alias("tasks")).scalar()
    graph = nodes.join(tools, "task_node").withColumn("tasks", tasks)
    joined = events.join(graph, ["task_node", "tool_node"], "left")
    known = F.col("task_ix").isNotNull()
    inner = node_fraction(F.col("tool_ix"), F.col("tools"), F.col("fraction"))
    own = ("tools", "tasks", "task_ix", "tool_ix")
    placed = joined.filter(known).withColumn(
        "progress", F.col("task_ix") / F.col("tasks") + (F.lit(1.0) / F.col("tasks")) * inner
    ).drop(*own)
    name = F.concat_ws("/", F.coalesce("task_node", F.lit("null")), F.coalesce("tool_node", F.lit("null")))
    reason = F.concat(F.lit("LookupError: "), name, F.lit(" is no node of the graph"))
    return placed, joined.filter(~known).drop(*own).withColumn("reason", reason)


def status_columns(events: DataFrame) -> DataFrame:
    """Progress is 1.0 when done, and the error text is the message of an error."""
    return events.withColumns(
        {
            "progress": F.when(F.col("status") == "done", F.lit(1.0)).otherwise(F.col("progress")),
            "error": F.when(F.col("status") == "error", F.col("message")),
        }
    )


def latest_status(events: DataFrame, tie: str = "event_id") -> DataFrame:
    """The last event of each run (by time, then ``tie``) and whether it is terminal.

    ``max_by`` combines map-side: a run with most of the events costs one row
    per task.
    """
    state = F.struct("ts", "status", "progress", "message", "error")
    return (
        status_columns(events)
        .groupBy("run_id")
        .agg(F.max_by(state, F.struct("ts", tie)).alias("state"))
        .select("run_id", "state.*")
        .withColumn("terminal", F.col("status").isin(*TERMINAL))
    )


def job_outcomes(
    events: DataFrame, seconds: int = TIMEOUT_SECONDS, tie: str = "event_id", delay: int = 0
) -> DataFrame:
    """Per run: done, error or timeout, from its first event and its first terminal one.

    Decided are the runs whose first terminal event or deadline lies at or
    before the last event of the table less ``delay`` seconds; the others are
    left out. Aggregates only.
    """
    terminal = F.col("status").isin(*TERMINAL)
    runs = events.groupBy("run_id").agg(
        F.min("ts").alias("submitted"),
        F.min_by(
            F.when(terminal, F.struct("ts", "status")),
            F.when(terminal, F.struct("ts", tie)),
        ).alias("end"),
    )
    now = events.agg((F.max("ts") - F.make_dt_interval(secs=F.lit(delay))).alias("now")).scalar()
    deadline = F.col("submitted") + F.make_dt_interval(secs=F.lit(seconds))
    ended = F.col("end.ts") <= F.least("deadline", "now")
    return (
        runs.withColumns({"deadline": deadline, "now": now})
        .withColumn(
            "outcome",
            F.when(ended, F.col("end.status")).when(
                (F.col("deadline") <= F.col("now")) & (F.col("end.ts").isNull() | (F.col("end.ts") > F.col("deadline"))),
                F.lit("timeout"),
            ),
        )
        .filter(F.col("outcome").isNotNull())
        .select("run_id", "submitted", "outcome")
    )


def primary_artifact(results: DataFrame) -> DataFrame:
    """The artifact to show of each run: the first with a normal map, else the first.

    ``results`` has run_id, pos (order in the result) and normal_url.
    """
    order = F.struct(F.col("normal_url").isNull().alias("plain"), "pos")
    row = F.struct(*[c for c in results.columns if c != "run_id"])
    return results.groupBy("run_id").agg(F.min_by(row, order).alias("row")).select("run_id", "row.*")
