"""Versioned tables: models and statistics that are published as a whole, found again, reused, merged and retired.

A version is written aside, under a name of its own, and counts from the moment its commit marker appears, by a rename
that either happens or doesn't. The newest version whose marker stands and whose files are all there is the table; a
write that broke off leaves data without a marker, or a marker whose files don't add up, and the version before stays
what readers see. Times are given, never now.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.functions.scratch import new_path, written

DAY = datetime.timedelta(hours=24)


@dataclass(frozen=True)
class Version:
    """A committed version: its name, when it was made, and the files and bytes that it consists of."""

    name: str
    created: datetime.datetime
    files: int
    size: int


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _listed(spark: SparkSession, path: str) -> list:
    fs, where = _fs(spark, path)
    return list(fs.listStatus(where)) if fs.exists(where) else []


def _held(spark: SparkSession, base: str, name: str) -> tuple[int, int]:
    """Files and bytes of a version's data."""
    sizes = [f.getLen() for f in _listed(spark, f"{base}/data/{name}") if f.getPath().getName().endswith(".parquet")]
    return len(sizes), sum(sizes)


def publish(df: DataFrame, base: str, at: datetime.datetime) -> Version:
    """Write df as the version of that time and commit it; of versions of one time the later one counts."""
    spark = df.sparkSession
    name = f"{at:%Y%m%dT%H%M%S%f}-{len(_listed(spark, f'{base}/data')):06d}-{uuid.uuid4().hex[:8]}"
    df.write.option("compression", "zstd").parquet(f"{base}/data/{name}")
    files, size = _held(spark, base, name)
    fs, aside = _fs(spark, f"{base}/aside/{name}.json")
    out = fs.create(aside, False)
    out.write(json.dumps({"created": at.isoformat(), "files": files, "size": size}).encode())
    out.close()
    _, marker = _fs(spark, f"{base}/commits/{name}.json")
    fs.mkdirs(marker.getParent())
    if not fs.rename(aside, marker):
        raise OSError(f"version {name} could not be committed")
    return Version(name, at, files, size)


def versions(spark: SparkSession, base: str) -> list[Version]:
    """Committed versions whose data is whole, the newest first. Broken markers and data without one are passed over."""
    found = []
    for status in _listed(spark, f"{base}/commits"):
        name = status.getPath().getName().removesuffix(".json")
        try:
            told = json.loads("".join(r[0] for r in spark.read.text(status.getPath().toString(), wholetext=True).collect()))
            version = Version(name, datetime.datetime.fromisoformat(told["created"]), told["files"], told["size"])
        except (ValueError, KeyError, TypeError):
            continue
        if _held(spark, base, name) == (version.files, version.size):
            found.append(version)
    return sorted(found, key=lambda v: v.name, reverse=True)


def load(spark: SparkSession, base: str, version: Version | None = None) -> DataFrame:
    """The newest version of the table, or a given one."""
    version = version or next(iter(versions(spark, base)), None)
    if version is None:
        raise LookupError(f"no version in {base}")
    return spark.read.parquet(f"{base}/data/{version.name}")


def reuse(spark: SparkSession, base: str, build: Callable[[], DataFrame], at: datetime.datetime, age: datetime.timedelta = DAY) -> DataFrame:
    """The newest version if it is younger than age at that time, else what build makes, published."""
    newest = next(iter(versions(spark, base)), None)
    if newest is None or newest.created + age <= at:
        newest = publish(build(), base, at)
    return load(spark, base, newest)


def merge(base: str, updates: DataFrame, keys: list[str], at: datetime.datetime) -> dict[str, int]:
    """Publish the newest version with updates (of its columns) put in by keys: how many rows were created, updated (to
    other values) and unchanged. Without a version all are created. Rows of one key among the updates are refused."""
    spark = updates.sparkSession
    fresh = written(updates, "updates")
    if fresh.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError("a key has two updates")
    others = [c for c in fresh.columns if c not in keys]
    newest = next(iter(versions(spark, base)), None)
    if newest is None:
        publish(fresh, base, at)
        return {"created": fresh.count(), "updated": 0, "unchanged": 0}
    now = load(spark, base, newest).select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*others).alias("_old"), F.lit(True).alias("_here"))
    same = F.lit(True)
    for k in keys:
        same &= fresh[k].eqNullSafe(now[f"_{k}"])
    met = fresh.withColumn("_new", F.struct(*others)).withColumn("_fresh", F.lit(True)).join(now, same, "full")
    change = F.when(F.col("_here").isNull(), "created").when(F.col("_fresh").isNull(), "kept").when(F.col("_new").eqNullSafe(F.col("_old")), "unchanged").otherwise("updated")
    value = lambda c: F.when(F.col("_fresh").isNull(), F.col(f"_old.{c}")).otherwise(F.col(c)).alias(c)
    key = lambda k: F.when(F.col("_fresh").isNull(), F.col(f"_{k}")).otherwise(F.col(k)).alias(k)
    merged = written(met.select(*[key(k) for k in keys], *[value(c) for c in others], change.alias("_change")), "merged")
    counts = {r["_change"]: r["count"] for r in merged.groupBy("_change").count().collect()}
    publish(merged.select(*fresh.columns), base, at)
    return {c: counts.get(c, 0) for c in ("created", "updated", "unchanged")}


def expire(spark: SparkSession, base: str, keep: int = 3) -> list[str]:
    """Retire all but the newest `keep` versions (at least one), markers first, and data that no marker names: names."""
    stay = {v.name for v in versions(spark, base)[: max(1, keep)]}
    gone = []
    for folder, end in (("commits", ".json"), ("data", "")):
        for status in _listed(spark, f"{base}/{folder}"):
            name = status.getPath().getName().removesuffix(end)
            if name not in stay:
                fs, where = _fs(spark, status.getPath().toString())
                fs.delete(where, True)
                gone.append(name)
    return sorted(set(gone))


def _model_of_two_days(base_model: DataFrame, other_model: DataFrame) -> DataFrame:
    """A model published one day, reused within the day, merged with another the next day, and loaded."""
    spark = base_model.sparkSession
    base, day = new_path(spark, "model"), datetime.datetime(2024, 1, 1)
    reuse(spark, base, lambda: base_model, day)
    reuse(spark, base, lambda: other_model, day + datetime.timedelta(hours=23))
    counts = merge(base, other_model, ["src", "dst"], day + DAY)
    return load(spark, base).select("src", "dst", F.round("p", 9).alias("p"), *[F.lit(n).cast("bigint").alias(f"n_{c}") for c, n in counts.items()])


FUNCTIONS = {
    "d10_model_store": (
        _model_of_two_days,
        ["base_model", "other_model"],
        """WITH j AS (SELECT coalesce(o.src, b.src) AS src, coalesce(o.dst, b.dst) AS dst, coalesce(o.p, b.p) AS p, b.src IS NULL AS fresh, o.src IS NOT NULL AND b.src IS NOT NULL AS shared, o.p = b.p AS same FROM base_model AS b FULL JOIN other_model AS o ON b.src = o.src AND b.dst = o.dst)
        SELECT src, dst, round(p, 9) AS p, count(*) FILTER (fresh) OVER () AS n_created, count(*) FILTER (shared AND NOT same) OVER () AS n_updated, count(*) FILTER (shared AND same) OVER () AS n_unchanged FROM j""",
    ),
}
