"""Session builder used by the bench and the tests.

A cluster brings its own session; nothing in the library depends on this one.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pixelloom", cores: int | None = None, **extra: str) -> SparkSession:
    """Local session with AQE on, UTC, and one shuffle partition per core."""
    cores = cores or os.cpu_count() or 4
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.driver.memory", os.environ.get("PIXELLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    Needed where it is neither installed on the executors nor passed with
    --py-files; the Arrow helpers import it there.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="pixelloom-")) / "pixelloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a fresh one only in local mode.

    On a cluster a folder of one machine would lose rows, so there it must be named.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="pixelloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to a new folder in the shared checkpoint folder and read back: cuts the lineage."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/pixelloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def blowup_partitions(spark: SparkSession) -> int:
    """Partition count for a small frame that is about to explode into pixel rows.

    An explicit number keeps AQE from coalescing the (still tiny) input back
    into one task before the blow-up.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")),
               spark.sparkContext.defaultParallelism)
