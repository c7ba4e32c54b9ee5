"""Bottom-k document fingerprints.

A fingerprint is the sorted k smallest 64-bit hashes of a text's distinct word shingles, as base64 of little-endian
unsigned 64-bit integers; fewer than k hashes mean that the whole set is held. Fingerprints of parts merge into the
fingerprint of their union. Null text counts as empty; the fingerprint of a text without words is the empty string.
Two empty fingerprints are alike (1.0); an empty and another one are not (0.0).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.llm.shingles import SIZE, shingle_sets
from tideglass.llm.store import width

K = 256


def sketch(shingles: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest of sorted distinct hashes."""
    return shingles[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Fingerprint of the union of two parts."""
    return np.union1d(a, b)[:k]


def encode(values: np.ndarray) -> str:
    return base64.b64encode(values.astype("<u8").tobytes()).decode("ascii")


def decode(fingerprint: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint or ""), "<u8").astype(np.uint64)


def distinct_count(values: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    if len(values) < k:
        return float(len(values))
    return (k - 1) / ((float(values[k - 1]) + 1.0) / 2.0**64)


def _common(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The union's sample, where it holds members of a, and how many of those are in both."""
    union = merge(a, b, k)
    in_a = np.isin(union, a, assume_unique=True)
    return union, in_a, int((in_a & np.isin(union, b, assume_unique=True)).sum())


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; exact when both sets are held whole and together have at most k members."""
    if not len(a) and not len(b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) == len(b) and (a == b).all():
        return 1.0
    union, _, both = _common(a, b, k)
    return both / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1.0 for an empty a."""
    if not len(a):
        return 1.0
    if not len(b):
        return 0.0
    _, in_a, both = _common(a, b, k)
    return both / max(1, int(in_a.sum()))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, k: int = K) -> DataFrame:
    """One fingerprint per row of docs: key, n_shingles_estimate, fingerprint."""
    pairs = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    schema = pa.schema([("key", _arrow_type(pairs)), ("n_shingles_estimate", pa.float64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [sketch(s, k) for s in shingle_sets(part.column(1), size)]
                yield pa.record_batch([part.column(0), pa.array([distinct_count(v, k) for v in found]), pa.array(list(map(encode, found)))], schema=schema)

    kind = pairs.schema["key"].dataType.simpleString()
    return pairs.mapInArrow(run, f"key {kind}, n_shingles_estimate double, fingerprint string").withColumnRenamed("key", key)


def merged(marks: DataFrame, by: str, fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """The fingerprint of the union of each group's texts: by, n_shingles_estimate, fingerprint. A null group is a group.

    Fingerprints are merged where they are read, then once more by group; a group of any size meets as one fingerprint
    from each task, and those are merged as they come.
    """
    pairs = marks.select(marks[by].alias("key"), marks[fingerprint].cast("string").alias("fingerprint"))
    schema = pa.schema([("key", _arrow_type(pairs)), ("fingerprint", pa.string())])
    kind = pairs.schema["key"].dataType.simpleString()

    def out(held: dict) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(held), schema[0].type), pa.array([encode(v) for v in held.values()], pa.string())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for key, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key not in held and len(held) >= 10_000:
                    yield out(held)
                    held = {}
                held[key] = merge(held[key], decode(mark), k) if key in held else decode(mark)
        yield out(held)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups arrive one after another."""
        held: dict = {}
        for batch in batches:
            done: dict = {}
            for key, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key not in held:
                    done |= held
                    held = {key: decode(mark)}
                else:
                    held[key] = merge(held[key], decode(mark), k)
            yield out(done)
        yield out(held)

    whole = pairs.mapInArrow(run, f"key {kind}, fingerprint string").repartition("key").sortWithinPartitions("key").mapInArrow(last, f"key {kind}, fingerprint string")
    sized = pa.schema([schema[0], ("n_shingles_estimate", pa.float64()), schema[1]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([distinct_count(decode(v), k) for v in batch.column(1).to_pylist()], pa.float64()), batch.column(1)], schema=sized)

    return whole.mapInArrow(count, f"key {kind}, n_shingles_estimate double, fingerprint string").withColumnRenamed("key", by)


def _arrow_type(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[0].dataType)


def bisect(bounds: Column, n: int, value: Column) -> Column:
    """How many of n sorted bounds are at most value; null for null."""
    start = F.struct(F.lit(0).alias("low"), F.lit(n).alias("high"))
    mid = lambda acc: F.floor((acc["low"] + acc["high"]) / 2).cast("int")

    def step(acc: Column, _: Column) -> Column:
        right = (acc["low"] < acc["high"]) & (F.get(bounds, mid(acc)) <= value)
        return F.when(acc["low"] >= acc["high"], acc).when(right, F.struct((mid(acc) + 1).alias("low"), acc["high"].alias("high"))).otherwise(F.struct(acc["low"].alias("low"), mid(acc).alias("high")))

    return F.when(value.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length() + 1)), start, step, lambda acc: acc["low"]))


EDITED_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles_estimate double, edited_containment double"


def with_edited(docs: DataFrame, size: int = SIZE, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, which borrows the head of the next document.

    Order is by doc_id (null first), then text, so rows with one doc_id follow each other in a defined order; the last
    document is followed by the first. Ranges of doc_id are cut at quantiles that are doc_ids of the table, so the
    document that follows a range is known before the shuffle and travels to it as well: one exchange of the texts, a
    task for each range, no global window. Rows of one doc_id stay in one range, where they are streamed.

    An empty table gives an empty result. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    parts = width(spark)
    shares = [i / parts for i in range(parts)]
    seen = rows.agg(
        F.min("doc_id").alias("low"),
        F.percentile_approx("doc_id", shares, max(10_000, 50 * parts)).alias("cuts"),
        F.sum(F.col("doc_id").isNull().cast("bigint")).alias("nulls"),
    ).first()
    cuts = sorted({seen["low"], *(seen["cuts"] or [])} - {None})
    bounds = F.array(*[F.lit(c).cast("bigint") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    below = F.coalesce(bisect(bounds, len(cuts), F.col("doc_id")), F.lit(0))
    at_cut = F.get(bounds, F.col("below") - 1) == F.col("doc_id")
    first = F.col("doc_id").isNull() if seen["nulls"] else F.col("doc_id") == F.lit(seen["low"]).cast("bigint")
    starts = F.coalesce(first | at_cut & (F.col("doc_id") != F.lit(seen["low"]).cast("bigint")), F.lit(False))
    before = F.when(first, F.lit(max(0, len(cuts) - 1))).otherwise(F.col("range") - 1)
    own = F.struct("range", F.lit(0).alias("last"))
    dealt = (
        rows.withColumn("below", below)
        .withColumn("range", F.greatest(F.lit(0), F.col("below") - 1))
        .withColumn("copies", F.when(starts, F.array(own, F.struct(before.alias("range"), F.lit(1).alias("last")))).otherwise(F.array(own)))
        .select("doc_id", "text", F.explode("copies").alias("copy"))
        .select("copy.range", "copy.last", "doc_id", "text")
        .repartitionById(max(1, len(cuts)), F.col("range"))
        .sortWithinPartitions("range", "last", F.asc_nulls_first("doc_id"), "text")
    )
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), *((c, pa.float64()) for c in ("near_edited", "near_next", "n_shingles_estimate", "edited_containment"))])

    def edit(text: str, following: str) -> str:
        quarter = len(text) // 4
        return text[: len(text) - quarter] + following[:quarter]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the row that waits for the one after it: range, last, doc_id, text, fingerprint
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                marks = [sketch(s, k) for s in shingle_sets(batch.column(3), size)]
                row = held + list(zip(*(batch.column(i).to_pylist() for i in range(4)), marks, strict=True))
                pairs = [(a, b) for a, b in zip(row[:-1], row[1:], strict=True) if a[0] == b[0] and not a[1]]
                held = row[-1:]
                texts = [edit(a[3], b[3]) for a, b in pairs]
                others = [sketch(s, k) for s in shingle_sets(pa.array(texts, pa.large_string()), size)]
                out = [
                    (a[2], len(a[3]), hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest(), encode(a[4]), encode(o), resemblance(a[4], o, k), resemblance(a[4], b[4], k), distinct_count(a[4], k), containment(a[4], o, k))
                    for (a, b), t, o in zip(pairs, texts, others, strict=True)
                ]
                if out:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return dealt.mapInArrow(run, EDITED_SCHEMA)
