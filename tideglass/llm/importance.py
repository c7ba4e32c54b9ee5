"""Importance resampling towards a target distribution, over hashed word n-grams.

Features of a text are its runs of 1 to n words, hashed into buckets. A bucket's gain says how much more frequent it is
in the target than in the pool; a document's weight is its mean gain, and the documents with the highest weights after
Gumbel noise are a sample without replacement that follows the target.

Long texts are skewed work: they are cut at word boundaries into chunks that carry n - 1 words and own starting
positions (`cuts`), so every feature is counted once. Chunks are counted and weighed where they lie; counts and gains
of a document's chunks are summed afterwards.

Words are lower-cased in A-Z only. Null text has no feature and weight 0. Rows of one key are weighed and drawn
one by one, with the same noise; a null key counts as an empty one for the noise and comes last among ties. Other
columns are not read. Empty tables give empty results, and an empty target is a uniform one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.llm.cuts import pieces, words
from tideglass.llm.store import materialize, release, width

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BUCKETS = 10_000
SEED = 2024


def hashed(texts: DataFrame, key: str, text: str, n: int, buckets: int) -> DataFrame:
    """Pieces of texts as bucket numbers: key, row, n_words (whose starts the piece owns), found."""
    cut = pieces(texts, key, text, WORD, carry=n - 1).select("key", "row", "own", words("text", WORD).alias("ws"))
    here = cut.select("key", "row", F.coalesce("own", F.size("ws")).alias("n_words"), "ws")
    bucket = lambda s: F.pmod(F.crc32(s), F.lit(buckets)).cast("int")

    def runs(k: int) -> Column:
        if n == 1:
            return F.transform("ws", bucket)
        last = F.least(F.col("n_words"), F.size("ws") - (k - 1))
        starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice("ws", i, F.lit(k)), " ")))

    return here.select("key", "row", "n_words", F.concat(*[runs(k) for k in range(1, n + 1)]).alias("found"))


def gains(pool: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of each bucket in thousandths, rounded down; add-one counts on both sides. One row a bucket comes back."""
    count = lambda t, name: t.select(F.explode("found").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))
    both = pool.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = both.join(count(pool, "s"), "bucket", "left").join(count(target, "t"), "bucket", "left").fillna(0).toArrow()
    s, t = (both.column(c).to_numpy().astype(float) for c in ("s", "t"))
    out = np.zeros(buckets, np.int64)
    out[both.column("bucket").to_numpy()] = np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))))
    return out


def weighed(pool: DataFrame, gain: np.ndarray) -> DataFrame:
    """Documents of hashed pieces: key, n_words, n_features, weight."""
    shared = pool.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(3)
            sums = np.concatenate([[0], np.cumsum(shared.value[found.flatten().to_numpy()])])
            n = found.value_lengths().to_numpy().astype(np.int64)
            ends = np.cumsum(n)
            yield pa.record_batch([*batch.columns[:3], pa.array(n), pa.array(sums[ends] - sums[ends - n])], names=["key", "row", "n_words", "n", "gain"])

    kind = pool.schema["key"].dataType.simpleString()
    parts = pool.mapInArrow(add, f"key {kind}, row bigint, n_words int, n bigint, gain bigint")
    n_words = F.sum(F.col("n_words").cast("bigint")).alias("n_words")
    long = parts.where("row IS NOT NULL").groupBy("row").agg(F.first("key").alias("key"), n_words, F.sum("n").alias("n"), F.sum("gain").alias("gain"))
    every = parts.where("row IS NULL").select("key", F.col("n_words").cast("bigint").alias("n_words"), "n", "gain").unionByName(long.drop("row"))
    mean = F.when(F.col("n") > 0, F.expr("(gain - pmod(gain, n)) div n")).otherwise(F.lit(0).cast("bigint"))
    return every.select("key", "n_words", F.col("n").alias("n_features"), mean.alias("weight"))


def noise(key: str, seed: int) -> Column:
    """Gumbel noise of a key in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def numbered(rows: DataFrame, percent: int, least: int) -> DataFrame:
    """rows (key, n_words, score; written) with rank: 1, 2, 3 ... for the drawn ones, else null.

    Scores are thousandths of logarithms of counts, so they have some ten thousand values however many rows there are;
    their histogram gives the last score that is drawn. Rows up to it are dealt by ranges of (score, key), sorted, and
    numbered from where their range begins.
    """
    able = F.col("n_words") >= least
    steps = rows.where(able).groupBy("score").count().orderBy(F.desc("score")).collect()
    draw, seen, cut = percent * sum(r["count"] for r in steps) // 100, 0, None
    for r in steps:
        if seen >= draw:
            break
        seen, cut = seen + r["count"], r["score"]
    unranked = F.lit(None).cast("bigint").alias("rank")
    if cut is None:
        return rows.select("*", unranked)
    order = [F.desc("score"), F.asc_nulls_last("key"), F.asc("salt")]
    top = rows.where(able & (F.col("score") >= cut)).withColumn("salt", F.rand(SEED))
    dealt = top.repartitionByRange(width(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = materialize(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")).drop("salt"), "drawn")
    begins, before = {}, 0
    for r in placed.groupBy("part").count().orderBy("part").collect():  # a row a range
        begins[r["part"]], before = before - (r["part"] << 33) + 1, before + r["count"]
    base = F.create_map(*[F.lit(v).cast("bigint") for pair in begins.items() for v in pair])
    rank = F.col("at") + base[F.col("part").cast("bigint")]
    others = rows.where(~(able & (F.col("score") >= cut)))
    return placed.withColumn("rank", F.when(rank <= draw, rank)).drop("part", "at").unionByName(others.select("*", unranked))


def resample(
    docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, percent: int = 10, least: int = 20, seed: int = SEED, key: str = "doc_id", text: str = "text", target_text: str = "text"
) -> DataFrame:
    """One row per row of docs: key, n_features, weight, score, rank (null if not drawn). percent of the documents with
    at least `least` words are drawn, highest scores first, ties to the smaller key."""
    pool = materialize(hashed(docs, key, text, n, buckets), "importance-pool")
    wanted = materialize(hashed(target.withColumn("_none", F.lit(0)), "_none", target_text, n, buckets), "importance-target")
    gain = gains(pool, wanted, buckets)
    release(wanted)
    scored = materialize(weighed(pool, gain).withColumn("score", F.col("weight") + noise("key", seed)), "importance-scores")
    release(pool)
    return numbered(scored, percent, least).select(F.col("key").alias(key), "n_features", "weight", "score", "rank")
