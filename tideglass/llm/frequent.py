"""The most frequent keys of a table of counts, of which at most a given number is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.store import materialize

_BUCKETS = 1024
#: Rows that meet() broadcasts.
HEAD = 4096


def most_frequent(counted: DataFrame, key: str, most: int) -> DataFrame:
    """Rows of counted (key, n > 0; written) with the largest n, at most `most` of them.

    Counts fall into classes of sixteenth powers of two. Whole classes are taken from the top while they fit, then
    whole hash buckets of the class that doesn't; so the bound holds however many keys are equally frequent, and only
    the two histograms (some thousand rows) come to the driver.
    """
    order = F.floor(16 * F.log2(F.col("n").cast("double"))).cast("int")
    held, least = 0, None
    for row in counted.groupBy(order.alias("class")).count().orderBy(F.desc("class")).collect():
        if held + row["count"] > most:
            least = row["class"]
            break
        held += row["count"]
    if least is None:
        return counted
    bucket = F.pmod(F.xxhash64(key), F.lit(_BUCKETS)).cast("int")
    last = -1
    for row in counted.where(order == least).groupBy(bucket.alias("bucket")).count().orderBy("bucket").collect():
        if held + row["count"] > most:
            break
        held += row["count"]
        last = row["bucket"]
    return counted.where((order > least) | (order == least) & (bucket <= last))


def meet(left: DataFrame, right: DataFrame, on: list[str], head: int = HEAD) -> DataFrame:
    """left joined (inner) with right, which has one row for each key and n, how many rows of left have it (both written).

    Rows of left with one of the `head` most frequent keys meet right where they are read, so no key's rows gather in
    one task; the others are shuffled. n is left out.
    """
    often = materialize(most_frequent(right, on[0], head), "frequent-keys")
    near = left.join(F.broadcast(often), on)
    far = left.join(F.broadcast(often.select(*on)), on, "left_anti").join(right, on)
    return near.unionByName(far).drop("n")
