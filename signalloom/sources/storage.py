"""Cutting lineage through files that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary one of our own only where it is unset and the session runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loom")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written() within is deleted at the end, unless it is kept; no frame that reads it may be used later."""
    before = _SCRATCH.set(paths := [])
    try:
        yield
    finally:
        _SCRATCH.reset(before)
        for path in paths:
            removed(spark, path)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The same rows, written to and read again from the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if (paths := _SCRATCH.get()) is not None and not keep:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, which=None) -> tuple[DataFrame, int]:
    """As written(), with the number of rows (those that fulfil ``which``), which is counted on the way."""
    seen = Observation()
    out = written(df.observe(seen, F.count_if(F.lit(True) if which is None else which).alias("n")), name)
    return out, seen.get["n"]
