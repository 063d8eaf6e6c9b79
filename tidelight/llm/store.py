"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; sets one of its own only where none is named and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidelight-")
        spark.sparkContext.setCheckpointDir(named)
    return named if "://" in named or named.startswith("file:") else f"file://{named}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and a lost executor costs one stage."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: An Arrow batch of texts, at most: JVM and Python hold batches whole, and texts may be long.
LEAN = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


@contextmanager
def lean_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most LEAN for the actions inside; the session's settings are as before afterwards."""
    old = {k: spark.conf.get(k) for k in LEAN}
    try:
        for k, v in LEAN.items():
            if not 0 < _number(old[k]) <= v:
                spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def _number(setting: str) -> int:
    """A count, or bytes with a unit."""
    m = re.fullmatch(r"(-?\d+)([kmg]?)b?", setting.strip().lower())
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[m[2]] if m else -1


def released(run: Callable) -> Callable:
    """A mapInArrow function that gives freed memory back when its task ends, since Python workers outlive their tasks."""

    @functools.wraps(run)
    def wrapped(*args):
        try:
            yield from run(*args)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped
