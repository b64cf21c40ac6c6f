"""Helpers that every operator of this package shares."""

from __future__ import annotations

import atexit
import ctypes
import glob
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words, as a character class body for Java and DuckDB.
SPACE = r"\x20\x09-\x0D"
#: The same for Python's re over bytes or Latin-1 strings.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

_local_root: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; the path may be one that only Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name under spark.checkpoint.dir, the folder that all executors share.

    Only where that setting is absent and the session runs in one process a temporary folder is made; elsewhere its absence is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local_root:
            _local_root.append(tempfile.mkdtemp(prefix="sieveline-"))
            atexit.register(shutil.rmtree, _local_root[0], ignore_errors=True)
        root = _local_root[0]
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and survives lost executors."""
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a frame made by written(), once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    for path in {p.rpartition("/")[0] for p in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def one_core_each() -> None:
    """Let the matrix products of this worker use one thread: a task has one core, and threads of neighbours only wait for each other.

    Where numpy brings another library than OpenBLAS nothing changes.
    """
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), os.pardir, "numpy.libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)


def give_back() -> None:
    """Return what this process has freed to the system; allocators keep it otherwise, and an executor's idle workers count like busy ones."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The step for mapInArrow, after which its worker holds none of the step's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def trimmed(text: Column) -> Column:
    """Text (null: empty) without white space at its ends."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def words(text: Column) -> Column:
    """array<string> of the words of a text; empty array where there is none."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, rf"[{SPACE}]+"))
