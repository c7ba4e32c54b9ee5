"""URL filters as a Bloom filter cascade.

A rule is a key "host/path..." (the host, then the path its urls start with). Level 0 of a cascade encodes the listed
keys; level 1 the keys of the corpus that level 0 takes for listed and that are not; level 2 the listed keys that
level 1 takes for those; and so on until a level errs on nothing. Over the universe it was built for, which is every
key that any url of the corpus can match, membership is exact and takes no join. Bits are bounded by MAX_BITS a level,
whatever the list's size; a list too large for that leaves more false positives and so more levels, and keys that are
still undecided after MAX_LEVELS are kept as an exact set, or refused if that is not small.

A url without "://", or null, has an empty host and path and meets no rule: verdict allow. Repeated rows each get
their verdict, very long urls too; a host has no more candidate keys than the deepest rule has labels, whatever its
dots. An empty table gives an empty result. Columns other than page_id and url are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm.store import materialize

BITS_PER_KEY = 12
MAX_BITS = 1 << 27
MAX_LEVELS = 24
MAX_EXACT = 100_000


def host_of(url: Column) -> Column:
    """After the first "://", up to "/", "?", "#" or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: str, path: str, lengths: list[int], labels: int) -> list[str]:
    """Every key that the url can match, given the lengths of the rules' paths and the labels of their longest host;
    longest first."""
    parts = host.rsplit(".", labels) if host else []
    if len(parts) > labels:
        parts = parts[1:]
    found = {".".join(parts[i:]) + path[:n] for i in range(len(parts)) for n in lengths if n <= len(path)}
    return sorted(found, key=lambda k: (-len(k), k))


@dataclass(frozen=True)
class Bloom:
    """A Bloom filter over UTF-8 keys."""

    bits: np.ndarray
    hashes: int
    salt: int

    def places(self, key: str) -> list[int]:
        digest = hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16, salt=self.salt.to_bytes(8, "little")).digest()
        a, b = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little") | 1
        size = len(self.bits) * 8
        return [(a + i * b) % size for i in range(self.hashes)]

    def __contains__(self, key: str) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.places(key))


@dataclass(frozen=True)
class Cascade:
    """Alternating levels; what the last one still confuses is listed exactly."""

    levels: tuple[Bloom, ...]
    exact: frozenset[str] = frozenset()

    def __contains__(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if key not in level:
                return i % 2 == 1
        return key in self.exact


def encode(keys: DataFrame, n: int, salt: int, bits_per_key: float = BITS_PER_KEY) -> Bloom:
    """Bits are set in every task and combined by position, 4096 bytes a row."""
    size = min(MAX_BITS, max(64, 1 << math.ceil(math.log2(max(1, n) * bits_per_key))))
    hashes = max(1, min(16, round(size / max(1, n) * math.log(2))))
    empty = Bloom(np.zeros(size // 8, np.uint8), hashes, salt)
    page = min(4096, size // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for key in batch.column(0).to_pylist():
                for p in empty.places(key):
                    at, here = divmod(p >> 3, page)
                    if at not in own:
                        own[at] = np.zeros(page, np.uint8)
                    own[at][here] |= 1 << (p & 7)
        yield pa.record_batch([pa.array(list(own), pa.int32()), pa.array([v.tobytes() for v in own.values()], pa.binary())], names=["page", "bits"])

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bits = None, None
        for batch in batches:
            for at, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(raw, np.uint8)
                if at == last:
                    bits = bits | part
                    continue
                if last is not None:
                    yield pa.record_batch([pa.array([last], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["page", "bits"])
                last, bits = at, part
        if last is not None:
            yield pa.record_batch([pa.array([last], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["page", "bits"])

    bits = np.zeros(size // 8, np.uint8)
    pages = keys.mapInArrow(run, "page int, bits binary").repartition("page").sortWithinPartitions("page").mapInArrow(combined, "page int, bits binary")
    for row in pages.collect():  # at most MAX_BITS
        bits[row["page"] * page : (row["page"] + 1) * page] = np.frombuffer(row["bits"], np.uint8)
    return Bloom(bits, hashes, salt)


def only_in(keys: DataFrame, level: Bloom) -> DataFrame:
    """The keys that the level takes for its own."""
    shared = keys.sparkSession.sparkContext.broadcast((level.bits, level.hashes, level.salt))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(*shared.value)
        for batch in batches:
            found = [k for k in batch.column(0).to_pylist() if k in own]
            yield pa.record_batch([pa.array(found, pa.string())], names=["key"])

    return keys.mapInArrow(run, "key string")


def build(listed: DataFrame, universe: DataFrame, bits_per_key: float = BITS_PER_KEY) -> Cascade:
    """listed, universe: one string column `key` each. Exact for every key of either.

    Joins occur only here, between the listed keys and the universe's keys that a level errs on.
    """
    inside = materialize(listed.select("key").where(F.col("key").isNotNull()).distinct(), "listed")
    outside: DataFrame | None = None
    levels: list[Bloom] = []
    mine, n = inside, inside.count()
    while n and len(levels) < MAX_LEVELS:
        level = encode(mine, n, len(levels), bits_per_key)
        levels.append(level)
        if outside is None:
            others = only_in(universe.select("key").where(F.col("key").isNotNull()), level).distinct().join(inside, "key", "left_anti")
        else:
            others = only_in(outside, level)
        others = materialize(others, "confused")
        mine, outside, n = others, mine, others.count()
    exact: frozenset[str] = frozenset()
    if n:
        # Keys on either side that no level tells apart: the listed ones among them, if few, are kept as they are.
        left = mine if len(levels) % 2 == 0 else outside
        few = [r[0] for r in left.limit(MAX_EXACT + 1).collect()]
        if len(few) > MAX_EXACT:
            raise ValueError(f"more than {MAX_EXACT} keys are undecided after {MAX_LEVELS} levels; raise MAX_BITS")
        exact = frozenset(few)
    elif len(levels) % 2 == 1:
        # The last level is of listed keys and errs on nothing: whatever passes it is listed.
        return Cascade((*levels, Bloom(np.zeros(8, np.uint8), 1, MAX_LEVELS)))
    return Cascade(tuple(levels), exact)


RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def candidates(pages: DataFrame, lengths: list[int], labels: int) -> DataFrame:
    """The complete key universe of the urls of pages, a key a row, with repeats removed in each task."""
    parts = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {k for h, p in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k in keys_of(h, p, lengths, labels)}
            yield pa.record_batch([pa.array(sorted(seen), pa.string())], names=["key"])

    return parts.mapInArrow(run, "key string")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, default: str = "allow", listed: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url).

    rules: (verdict, key); there is a cascade for each verdict. The longest key that fits wins; a key under both
    verdicts is refused. listed: rules as a table (verdict, key) instead, for lists that are not small.
    """
    spark: SparkSession = pages.sparkSession
    if listed is None:
        listed = spark.createDataFrame(list(rules), "verdict string, key string")
    listed = materialize(listed.select("verdict", "key").where("key IS NOT NULL").distinct(), "rules")
    if listed.groupBy("key").count().where("count > 1").limit(1).count():
        raise ValueError("a key has two verdicts")
    lengths = sorted(r[0] for r in listed.select(F.length(F.regexp_extract("key", r"(?s)^[^/]*(.*)$", 1))).distinct().collect())
    verdicts = sorted(r[0] for r in listed.select("verdict").distinct().collect())
    labels = listed.select(F.max(F.size(F.split(F.regexp_extract("key", r"^[^/]*", 0), r"\."))).alias("n")).first()["n"] or 0
    universe = candidates(pages, lengths, labels)
    cascades = {v: build(listed.where(F.col("verdict") == v), universe) for v in verdicts}
    # Plain values, at most MAX_BITS a level.
    shared = spark.sparkContext.broadcast({v: ([(x.bits, x.hashes, x.salt) for x in c.levels], sorted(c.exact)) for v, c in cascades.items()})
    from pyspark.sql.pandas.types import to_arrow_type

    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    kind = rows.schema["page_id"].dataType
    schema = pa.schema([("page_id", to_arrow_type(kind)), *((n, pa.string()) for n in ("host", "path", "rule", "verdict"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {v: Cascade(tuple(Bloom(*x) for x in levels), frozenset(exact)) for v, (levels, exact) in shared.value.items()}
        for batch in batches:
            out: list[tuple[str | None, str]] = []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                hit = next(((k, v) for k in keys_of(host, path, lengths, labels) for v in verdicts if k in known[v]), (None, default))
                out.append(hit)
            yield pa.record_batch([*batch.columns, pa.array([k for k, _ in out], pa.string()), pa.array([v for _, v in out], pa.string())], schema=schema)

    return rows.mapInArrow(run, f"page_id {kind.simpleString()}, host string, path string, rule string, verdict string")
