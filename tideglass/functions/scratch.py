"""Scratch tables in the folder that driver and executors share; they are removed when the driver ends."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """What the session names in spark.checkpoint.dir; a folder of our own only where it names none, on one machine."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _OWN.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="tideglass-"))


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{folder(spark)}/tideglass/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written once and read back: what follows costs a reread, not the lineage, when an executor is lost."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _sweep() -> None:
    for spark, path in _WRITTEN:
        with contextlib.suppress(Exception):
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
