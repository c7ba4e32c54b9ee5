"""Versioned tables: a broken write leaves the old version readable."""

import datetime
import os

import pytest

from tideglass.functions.scratch import new_path
from tideglass.sources import versions

DAY0 = datetime.datetime(2024, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def local(path):
    return path.removeprefix("file://")


def test_newest_whole_version_counts(spark):
    base = new_path(spark, "table")
    with pytest.raises(LookupError):
        versions.load(spark, base)
    one = spark.createDataFrame([(1, "a")], "k long, v string")
    first = versions.publish(one, base, DAY0)
    # A write that dies before its commit.
    spark.createDataFrame([(9, "z")], "k long, v string").write.parquet(f"{base}/data/20250101T000000000000-000001-dead0000")
    assert rows(versions.load(spark, base)) == [(1, "a")]
    # A marker whose data never came, one that is cut off, and one whose data has lost a file.
    folder = local(f"{base}/commits")
    for name, text in (("20260101T000000000000-000002-dead0001", '{"created": "2026-01-01T00:00:00", "files": 1, "size": 10}'), ("20270101T000000000000-000003-dead0002", '{"created": "20')):
        with open(f"{folder}/{name}.json", "w") as f:
            f.write(text)
    second = versions.publish(spark.createDataFrame([(2, "b")], "k long, v string"), base, DAY0 + datetime.timedelta(1))
    assert [v.name for v in versions.versions(spark, base)] == [second.name, first.name] and rows(versions.load(spark, base)) == [(2, "b")]
    data = local(f"{base}/data/{second.name}")
    for f in os.listdir(data):
        if f.endswith(".parquet"):
            os.remove(f"{data}/{f}")
    assert rows(versions.load(spark, base)) == [(1, "a")] and rows(versions.load(spark, base, first)) == [(1, "a")]


def test_reuse_within_a_day(spark):
    base, built = new_path(spark, "table"), []

    def build():
        built.append(1)
        return spark.createDataFrame([(len(built),)], "n long")

    for hours, want in ((0, 1), (23, 1), (24, 2), (30, 2), (48, 3)):
        assert rows(versions.reuse(spark, base, build, DAY0 + datetime.timedelta(hours=hours))) == [(want,)]


def test_merge_counts(spark):
    base = new_path(spark, "table")
    put = lambda r, d: versions.merge(base, spark.createDataFrame(r, "k long, j string, v double, w string"), ["k", "j"], DAY0 + datetime.timedelta(d))
    assert put([(1, "x", 1.0, None), (None, "x", 2.0, "a")], 0) == {"created": 2, "updated": 0, "unchanged": 0}
    assert put([(1, "x", 1.0, None), (None, "x", 2.0, "b"), (2, None, 3.0, "c")], 1) == {"created": 1, "updated": 1, "unchanged": 1}
    assert sorted(map(str, rows_any(versions.load(spark, base)))) == sorted(map(str, [(1, "x", 1.0, None), (None, "x", 2.0, "b"), (2, None, 3.0, "c")]))
    with pytest.raises(ValueError):
        put([(5, "x", 1.0, None), (5, "x", 2.0, None)], 2)
    assert len(versions.versions(spark, base)) == 2


def rows_any(df):
    return [tuple(r) for r in df.collect()]


def test_retention(spark):
    base = new_path(spark, "table")
    names = [versions.publish(spark.range(i + 1), base, DAY0 + datetime.timedelta(i)).name for i in range(4)]
    spark.range(1).write.parquet(f"{base}/data/20250101T000000000000-000001-dead0000")
    gone = versions.expire(spark, base, 2)
    assert gone == sorted([*names[:2], "20250101T000000000000-000001-dead0000"]) and versions.load(spark, base).count() == 4
    assert versions.expire(spark, base, 0) == [names[2]] and versions.load(spark, base).count() == 4
