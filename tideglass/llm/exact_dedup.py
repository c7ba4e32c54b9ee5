"""Exact dedup with a heavy-hitter split.

A Misra-Gries summary finds digests that may be frequent, an exact count verifies them, and their winners (at most
`frequent` rows, so the size is bounded) are broadcast: all but the winner of such a group leave before any shuffle.
The other digests take an ordinary shuffle; each is rarer than rows / frequent, but for what the summary's error
(rows / tracked) may hide. Only DataFrame functions are used.

Rows with null text count as empty text. Of equal texts the row with the largest doc_id stays (null is smallest); of
equal texts with equal doc_id exactly one row stays. An empty table gives an empty result. Columns other than the key
and the text are carried along untouched, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.llm.store import materialize

TRACKED = 4096
FREQUENT = 512


def text_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 text, null as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def frequent_digests(digests: DataFrame, column: str, tracked: int = TRACKED, frequent: int = FREQUENT) -> DataFrame:
    """Candidates of a Misra-Gries summary with `tracked` counters: one column of at most `frequent` digests.

    approx_top_k keeps such a summary in every task and merges them; any digest above rows / tracked is in it. The
    estimates are not used: candidates are counted exactly afterwards.
    """
    found = digests.select(F.call_function("approx_top_k", F.col(column), F.lit(frequent), F.lit(tracked)).alias("top"))
    return found.select(F.explode("top").alias("top")).select(F.col("top.item").alias(column)).where(F.col(column).isNotNull())


def annotate(rows: DataFrame, tracked: int = TRACKED, frequent: int = FREQUENT) -> DataFrame:
    """Verdict on every row of (doc_id, text_sha256): doc_id, keep_id, group_size, kept, text_sha256.

    The digests are written once with a row number, so a tie on doc_id has one winner even after a task is retried.
    """
    keyed = materialize(rows.select("doc_id", "text_sha256", F.monotonically_increasing_id().alias("row")), "digests")
    best = (F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    candidates = frequent_digests(keyed, "text_sha256", tracked, frequent)
    verified = keyed.join(F.broadcast(candidates), "text_sha256", "left_semi").groupBy("text_sha256").agg(*best)
    winners = materialize(verified.coalesce(1), "winners")  # at most `frequent` rows
    heavy = keyed.join(F.broadcast(winners), "text_sha256")
    rest = keyed.join(F.broadcast(winners), "text_sha256", "left_anti")
    light = rest.join(rest.groupBy("text_sha256").agg(*best), "text_sha256")
    return heavy.unionByName(light).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", tracked: int = TRACKED, frequent: int = FREQUENT) -> DataFrame:
    """The rows of docs that stay, with exactly its columns.

    Losers of frequent groups are dropped where they are read; what is left is ranked within its digest after one
    shuffle. A frequent group meets again only as its winner (and rows that tie with it on the key).
    """
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    at, body = inner[names.index(key)], inner[names.index(text)]
    hashed = docs.toDF(*inner).withColumn("digest", text_digest(F.col(body)))
    only = hashed.select(F.col(at).alias("best"), "digest")
    candidates = frequent_digests(only, "digest", tracked, frequent)
    verified = only.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(F.max("best").alias("best"), F.lit(True).alias("heavy"))
    winners = materialize(verified.coalesce(1), "winners")
    left = hashed.join(F.broadcast(winners), "digest", "left").where(F.col("heavy").isNull() | F.col(at).eqNullSafe(F.col("best")))
    # Of rows that tie on text and key each task keeps one before the shuffle.
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("digest").orderBy(F.col(at).desc_nulls_last())))
    return ranked.where(F.col("rank") == 1).select(*inner).toDF(*names)
