"""Arrow tasks that can import this package on every executor."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship_package(spark: SparkSession) -> None:
    """Hand the package's code to the executors, once for each application (as ``--py-files`` would)."""
    context = spark.sparkContext
    if getattr(context, "_panelwright_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="panelwright-code-")
    os.makedirs(os.path.join(folder, "src"))
    package = os.path.basename(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(os.path.join(_ROOT, package), os.path.join(folder, "src", package), ignore=shutil.ignore_patterns("__pycache__"))
    archive = shutil.make_archive(os.path.join(folder, package), "zip", os.path.join(folder, "src"))
    context.addPyFile(os.path.realpath(archive))
    context._panelwright_shipped = True


def release_memory() -> None:
    """Hand freed memory back to the system; a worker that is used again would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with the package at hand; a task leaves its worker without the memory it used."""
    ship_package(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(task, schema)
