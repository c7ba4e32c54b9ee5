"""Shared scratch tables: lineage is cut with Parquet under the folder the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []
_PATHS: dict[int, tuple[DataFrame, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tideglass-")
    return _OWN[app]


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/tideglass/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write df once and read it back: a lost executor then costs a reread, not the whole lineage."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(table)] = table, path  # held here, so the id stays its own
    return table


def release(*tables: DataFrame | None) -> None:
    """Remove tables that materialize wrote, once nothing reads them any more; others are left alone."""
    for table in tables:
        if table is not None and id(table) in _PATHS:
            held, path = _PATHS.pop(id(table))
            remove(held.sparkSession, path)


@atexit.register
def _sweep() -> None:
    for spark, path in _WRITTEN:
        remove(spark, path)


def width(spark: SparkSession) -> int:
    """Partitions for an exchange that the caller deals out itself."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
