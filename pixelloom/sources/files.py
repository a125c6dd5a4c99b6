"""Folders of many files, listed and read by tasks: the driver holds no list of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.session import blowup_partitions, saved

# Names and bytes of one Arrow batch.
NAMES, BATCH_BYTES = 8192, 1 << 22


def _hidden(name: str) -> bool:
    """What Spark's file sources pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def local_folder(path: str) -> str | None:
    """The folder behind ``path`` if tasks can list it by its name; None for patterns, other stores and what is no folder."""
    import os

    folder = re.sub(r"^file:(//)?(?=/)", "", path)
    if "://" in folder or re.search(r"[*?\[\]{}\\]", folder) or not os.path.isdir(folder):
        return None
    return os.path.abspath(folder)


def listed(spark: SparkSession, folder: str, suffix: str = "", recursive: bool = True) -> DataFrame:
    """(path) of the files in a folder that all executors see, listed as a stream by one task and stored."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        def names() -> Iterator[str]:
            folders = [top for batch in batches for top in batch.column(0).to_pylist()]
            while folders:
                with os.scandir(folders.pop()) as entries:
                    for entry in entries:
                        if _hidden(entry.name):
                            continue
                        if entry.is_dir():
                            if recursive:
                                folders.append(entry.path)
                        elif entry.name.endswith(suffix):
                            yield entry.path

        held: list[str] = []
        for name in names():
            held.append(name)
            if len(held) == NAMES:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["path"])
                held = []
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["path"])

    top = spark.range(1, numPartitions=1).select(F.lit(folder).alias("folder"))
    return saved(top.mapInArrow(walk, "path string"), "files")


def contents(files: DataFrame) -> DataFrame:
    """``files`` (path) with the bytes of each as ``content``; the names are dealt over all tasks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(data, pa.binary())], ["path", "content"])

        for batch in batches:
            names, data, size = [], [], 0
            for path in batch.column(0).to_pylist():
                with open(path, "rb") as file:
                    data.append(file.read())
                names.append(path)
                size += len(data[-1])
                if size >= BATCH_BYTES:
                    yield flushed()
                    names, data, size = [], [], 0
            yield flushed()

    dealt = files.select("path").repartition(blowup_partitions(files.sparkSession))
    return dealt.mapInArrow(read, "path string, content binary")
