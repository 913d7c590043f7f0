"""Sends this package's code to the executors, and frees what one operator's tasks leave for the next one's."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

ARCHIVE = "evispark_llm_code.zip"


def with_code(spark: SparkSession) -> SparkSession:
    """Add the operators' code to the session once, as --py-files would."""
    context = spark.sparkContext
    if not any(str(f).endswith(ARCHIVE) for f in context.listFiles):
        package = Path(__file__).resolve().parent
        path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="code-")), ARCHIVE)
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for module in package.parent.rglob("*.py"):
                archive.write(module, str(module.relative_to(package.parent.parent)))
        context.addPyFile(path)
    return spark


_KEPT: dict[str, dict] = {}


def give_back() -> None:
    """Return what a worker has freed to the system; the C library would keep most of it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def kept_tables(owner: str) -> dict:
    """What an operator keeps in a Python worker from task to task. A worker keeps things of one operator at a time.

    Workers outlive stages; the tasks of another operator drop what earlier ones kept and give the memory back.
    """
    if owner not in _KEPT:
        _KEPT.clear()
        give_back()
        _KEPT[owner] = {}
    return _KEPT[owner]
