"""Mixing sources to target weights by Poisson replication.

A source with target share w of a budget has the mean repetition rate w * budget / size. Each document is repeated as
often as a Poisson variable of that mean says, drawn by inverting its distribution at a number hashed from seed and
doc_id; so the draw needs no state and is the same after any retry. Copies are then ordered by a hash of seed, doc_id
and copy number: one global shuffle.

Null sources are a source of their own; null or empty texts have size 0; a source without any size has rate 1; a
source that a given target does not name has rate 0. Rows with equal doc_id draw equal counts and have equal shuffle keys; a
null doc_id draws as the empty string. An empty table gives an empty result. All columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.llm.store import materialize, width

SEED = 20
#: Means above this are drawn as sums of Poisson variables of smaller means, so that exp(-mean) stays a normal number.
PART = 500.0
#: Numbers that are broadcast at most: 32 MB of cumulative probabilities. HEAD sources have fewer, as each has at most
#: PART + 12 * PART ** 0.5 + 21.
MAX_NUMBERS = 4_000_000
HEAD = 4000
ADDED = ("copy_no", "rate", "shuffle_key")


def uniform(*parts: Column) -> Column:
    """52 bits of the MD5 of the parts joined by colons, as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, source: str = "source", text: str = "text", targets: dict[str | None, float] | None = None, smoothing: float = 0.5, budget: float | None = None) -> DataFrame:
    """Mean repetition rate of each source: source, size, rate. Without targets, shares follow size ** smoothing; without a budget it is the total size."""
    sizes = docs.select(docs[source].alias("source"), F.coalesce(F.length(docs[text]), F.lit(0)).cast("bigint").alias("size")).groupBy("source").agg(F.sum("size").alias("size"))
    sizes = materialize(sizes, "source-sizes")
    if targets is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(smoothing))
    else:
        named = [(k, v) for k, v in targets.items()]
        weight = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in named], F.lit(0.0)) if named else F.lit(0.0)
    total = sizes.agg(F.sum("size").cast("double").alias("size"), F.sum(weight).alias("weight")).first()
    goal = float(total["size"] if budget is None else budget) if total["size"] is not None else 0.0
    share = weight / F.lit(float(total["weight"] or 1.0))
    return sizes.select("source", "size", F.when(F.col("size") == 0, 1.0).otherwise(share * F.lit(goal) / F.col("size")).alias("rate"))


def distribution(rate: Column) -> Column:
    """Cumulative Poisson probabilities for 0, 1, 2, ... until they are 1 for all purposes."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.exp(-rate)
    step = lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * rate / k)).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), last), F.struct(start.alias("p"), F.array(start).alias("cdf")), step, lambda acc: acc["cdf"])


def replicate(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", targets: dict[str | None, float] | None = None, smoothing: float = 0.5, budget: float | None = None, seed: int = SEED, added: bool = True) -> DataFrame:
    """docs repeated and shuffled: its columns, then copy_no (from 1), rate and shuffle_key, in the order of shuffle_key
    and, where keys repeat, of a hash of key, source and text. Columns of docs with one of those three names are
    replaced by them; with added=False nothing is added and all of docs' columns stay."""
    spark = docs.sparkSession
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    at, where, body = (inner[names.index(c)] for c in (key, source, text))
    mean = rates(docs, source, text, targets, smoothing, budget)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    table = materialize(mean.select(F.col("source").alias("of"), "size", "rate", parts.alias("parts"), distribution(F.col("rate") / parts).alias("cdf")), "rates")
    held = table.agg(F.sum(F.size("cdf")).alias("numbers"), F.count(F.lit(1)).alias("sources")).first()
    renamed = docs.toDF(*inner)
    on = F.col(where).eqNullSafe(F.col("of"))
    if (held["numbers"] or 0) <= MAX_NUMBERS:
        drawn = renamed.join(F.broadcast(table.drop("size")), on)
    else:
        # The largest sources go to every task; each of the others holds a small part of all rows and is shuffled.
        head = materialize(table.orderBy(F.desc("size"), "of").limit(HEAD), "largest-sources")
        tail = table.join(F.broadcast(head.select("of")), table["of"].eqNullSafe(head["of"]), "left_anti")
        drawn = renamed.join(F.broadcast(head.drop("size")), on).unionByName(renamed.join(F.broadcast(head.select("of")), on, "left_anti").join(tail.drop("size"), on))
    ident = F.coalesce(F.col(at).cast("string"), F.lit(""))
    # The draws stand in an array of their own: each is hashed once, and not again for every element of the distribution.
    draws = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda j: uniform(F.lit(str(seed)), F.col("ident"), j.cast("string")))
    copies = F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter("cdf", lambda c: c <= u)))
    counted = drawn.withColumn("ident", ident).select(*inner, "rate", "ident", copies.alias("copies")).where("copies > 0")
    many = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    mixed = many.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), "ident", F.col("copy_no").cast("string"))))
    # Keys are uniform, so their leading bits deal them out evenly and in order: no sample, no second draw.
    n = width(spark)
    place = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("double") / float(1 << 32) * n).cast("int")
    dealt = mixed.withColumn("place", place).repartitionById(n, F.col("place")).sortWithinPartitions("shuffle_key", F.xxhash64(at, where, body))
    if not added:
        return dealt.select(*inner).toDF(*names)
    stay = [i for i, c in enumerate(names) if c not in ADDED]
    return dealt.select(*[inner[i] for i in stay], *ADDED).toDF(*[names[i] for i in stay], *ADDED)
