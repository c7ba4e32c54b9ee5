"""Evidence whose word set is like that of a longer kept one, by groups: a similarity join that stays on names of sets.

Word sets are made anew from the texts where they are needed and written only where a pair is to be decided exactly. In
between a set is its 64-bit name, its size and a bitmap of 1024 bits: the bitmaps of two sets differ in no more bits than
the sets differ in words. Among n distinct sets two share a name with a chance of about n * n / 2 ** 65.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.functions import scratch

BITS = 1024
#: Members of a block that are paired at once; larger blocks lose what their first members take before that.
SMALL = 64
#: Bits of the number of counters that workers hold, at most.
COUNTERS = 24
_KEY = "struct<n: long, id: long, u: long>"


def written(df: DataFrame) -> DataFrame:
    return scratch.written(df, "evidence")


def _words(batch: pa.RecordBatch) -> Iterator[tuple[int, str, str, list[str]]]:
    """Row, group, text, sorted distinct words."""
    for i, (grp, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
        yield i, grp, text or "", sorted(set((text or "").lower().split()))


def _name(grp: str, words: list[str]) -> int:
    # Words hold no space, so joined words are equal where the sets are.
    return int.from_bytes(hashlib.blake2b(f"{grp}\n{' '.join(words)}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _codes(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def _slots(codes: np.ndarray, grp: str, bits: int) -> np.ndarray:
    """A counter of each word of a group."""
    mixed = (codes * np.uint64(0x85EBCA6B) + np.uint64(zlib.crc32(grp.encode()) * 0xC2B2AE35 % (1 << 32))) & np.uint64(0xFFFFFFFF)
    return ((mixed ^ (mixed >> np.uint64(15))) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _bitmap(codes: np.ndarray) -> bytes:
    at = (codes * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)) >> np.uint64(22)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=BITS).astype(np.uint8) & 1).tobytes()


def _folded(bitmap: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps (rows of bytes) of fewer bits: words meet in a bit as they did or more often, so bounds still hold."""
    return np.bitwise_xor.reduce(bitmap.reshape(len(bitmap), -1, bits // 8), axis=1)


def _width(size: int) -> int:
    """Bits that tell sets of a size apart from unrelated ones."""
    return 256 if size <= 600 else 512 if size <= 1200 else BITS


def _facts(lines: DataFrame) -> DataFrame:
    """grp, id, n (characters), u (the set's name), size, bitmap of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, u, size, bitmap = [], [], [], []
            for _, grp, text, words in _words(batch):
                n.append(len(text))
                u.append(_name(grp, words))
                size.append(len(words))
                bitmap.append(_bitmap(_codes(words)) if words else b"")
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(u, pa.int64()), pa.array(size, pa.int64()), pa.array(bitmap, pa.binary())], names=["grp", "id", "n", "u", "size", "bitmap"])

    return lines.mapInArrow(run, "grp string, id long, n long, u long, size long, bitmap binary")


def _tally(rows: DataFrame, slots: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> bytes:
    """A byte for each of 2 ** bits counters: how often it is hit, up to 128, then in eighths of a doubling."""
    width = 1 << bits - 8

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for at in slots(batch):
                np.add.at(own, at, 1)
        for r in range(256):
            piece = own[r * width : (r + 1) * width]
            if piece.any():
                yield pa.record_batch([pa.array([r], pa.int32()), pa.array([zlib.compress(np.minimum(piece, 65535).astype(np.uint16).tobytes(), 1)], pa.binary())], names=["r", "data"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sums.setdefault(r, np.zeros(width, np.int64))
                own += np.frombuffer(zlib.decompress(data), np.uint16)
        for r, own in sums.items():
            byte = np.where(own <= 128, own, np.minimum(255, 128 + 8 * np.log2(np.maximum(own, 128) / 128))).astype(np.uint8)
            yield pa.record_batch([pa.array([r], pa.int32()), pa.array([byte.tobytes()], pa.binary())], names=["r", "data"])

    out = bytearray(1 << bits)
    for r in rows.mapInArrow(count, "r int, data binary").repartition("r").mapInArrow(total, "r int, data binary").collect():
        out[r["r"] * width : (r["r"] + 1) * width] = r["data"]
    return bytes(out)


def _postings(lines: DataFrame, threshold: float, often, bits: int) -> DataFrame:
    """key, u, size, at, bitmap: sets of a group that are alike share one of these keys, the first words of either in one order of all
    words, rarest in their group first; at is the word's place in it. Words that no other row of the group has are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.frombuffer(often.value, np.uint8), set()
        for batch in batches:
            keys, names, sizes, places, bitmaps = [np.zeros(0, np.int64)], [], [], [], []
            for _, grp, _, words in _words(batch):
                u = _name(grp, words)
                if not words or u in seen:
                    continue
                seen.add(u)
                codes = _codes(words)
                n = counts[_slots(codes, grp, bits)]
                first = np.lexsort((codes, n))[: len(words) - math.ceil(threshold * len(words) - 1e-9) + 1]
                place = np.flatnonzero(n[first] > 1)
                key, where = np.unique(codes[first][place], return_index=True)
                keys.append((key | np.uint64(zlib.crc32(grp.encode()) << 32)).view(np.int64))
                names.append(np.full(len(key), u, np.int64))
                sizes.append(np.full(len(key), len(words), np.int64))
                places.append(place[where])
                bitmaps += [_folded(np.frombuffer(_bitmap(codes), np.uint8)[None], _width(len(words))).tobytes()] * len(key)
            columns = [pa.array(np.concatenate(c)) for c in (keys, [keys[0], *names], [keys[0], *sizes], [keys[0], *places])]
            yield pa.record_batch([*columns, pa.array(bitmaps, pa.binary())], names=["key", "u", "size", "at", "bitmap"])

    return lines.mapInArrow(run, "key long, u long, size long, at long, bitmap binary")


def _met(postings: DataFrame, threshold: float, small: int) -> DataFrame:
    """key, u, v: the pairs of each block of at most `small` members that may be alike by sizes, bitmaps and what is left
    behind the block's word; of larger blocks their members, without v."""
    limit, least = (1 - threshold) / (1 + threshold), threshold / (1 + threshold)

    def blocks(key: np.ndarray, u: np.ndarray, size: np.ndarray, place: np.ndarray, bitmap: np.ndarray) -> pa.RecordBatch:
        new = np.r_[True, (key[1:] != key[:-1]) | (u[1:] != u[:-1])]
        key, u, size, place, bitmap = key[new], u[new], size[new], place[new], bitmap[new]
        widths = np.array([len(b) * 8 for b in bitmap])
        maps = []
        for bits in (256, 512, BITS):
            own = np.zeros((len(key), bits // 64), np.uint64)
            for w in (w for w in (256, 512, BITS) if w >= bits):
                if (at := np.flatnonzero(widths == w)).size:
                    own[at] = _folded(np.frombuffer(b"".join(bitmap[at].tolist()), np.uint8).reshape(len(at), -1), bits).view(np.uint64)
            maps.append((bits, own))
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        members = np.diff(np.r_[begin, len(key)])
        out = [(np.zeros(0, np.int64),) * 2]
        for m in np.unique(members[(members > 1) & (members <= small)]):
            x, y = np.triu_indices(m, 1)
            at = begin[members == m][:, None]
            a, b = (at + x).ravel(), (at + y).ravel()
            # Of the first word that two sets share, no more words are shared than what is left of either from there on.
            rest = np.minimum(size[a] - place[a], size[b] - place[b])
            near = (np.minimum(size[a], size[b]) > threshold * np.maximum(size[a], size[b]) - 1e-9) & (rest > least * (size[a] + size[b]) - 1e-9)
            a, b = a[near], b[near]
            for bits, own in maps:
                told = np.minimum(widths[a], widths[b]) >= bits
                near = np.ones(len(a), bool)
                near[told] = np.bitwise_count(own[a[told]] ^ own[b[told]]).sum(1, dtype=np.int64) <= limit * (size[a[told]] + size[b[told]]) + 1e-9
                a, b = a[near], b[near]
            out.append((u[a], u[b]))
        pairs = np.unique(np.stack([np.concatenate(c) for c in zip(*out, strict=True)], axis=1), axis=0)
        large = np.repeat(members > small, members)
        k = pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(key[large])])
        v = pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(int(large.sum()), pa.int64())])
        return pa.record_batch([k, pa.array(np.r_[pairs[:, 0], u[large]]), v], names=["key", "u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [*[np.zeros(0, np.int64)] * 4, np.zeros(0, object)]
        for batch in batches:
            held = [np.r_[h, c.to_numpy(zero_copy_only=False)] for h, c in zip(held, batch.columns, strict=True)]
            if len(held[0]):
                last = np.searchsorted(held[0], held[0][-1])  # the last block may go on
                if last:
                    yield blocks(*[h[:last] for h in held])
                    held = [h[last:] for h in held]
        if len(held[0]):
            yield blocks(*held)

    return postings.repartition("key").sortWithinPartitions("key", "u").mapInArrow(run, "key long, u long, v long")


def _close(pairs: DataFrame, threshold: float) -> DataFrame:
    """a, b of pairs (a, b, x, y, p, q: keys, sizes, bitmaps) that may be alike by sizes and bitmaps."""
    limit = (1 - threshold) / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            x, y = (batch.column(i).to_numpy() for i in (2, 3))
            p, q = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(len(x), -1) for i in (4, 5))
            near = (np.minimum(x, y) > threshold * np.maximum(x, y) - 1e-9) & (np.bitwise_count(p ^ q).sum(1, dtype=np.int64) <= limit * (x + y) + 1e-9)
            yield batch.select([0, 1]).filter(pa.array(near))

    return pairs.select("a", "b", "x", "y", "p", "q").mapInArrow(run, f"a {_KEY}, b {_KEY}")


def _every(large: DataFrame, threshold: float) -> DataFrame:
    """a, b: pairs within each block of large (key, k, size, bitmap) that may be alike by sizes and bitmaps, some hundred
    thousand comparisons at a time."""
    limit = (1 - threshold) / (1 + threshold)

    def pairs(keys: pa.Array, size: np.ndarray, bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, 200_000 // len(size))
        for at in range(0, len(size), step):
            # Members are in the order of their sizes: those that are too large for these come last.
            stop = int(np.searchsorted(size, (size[min(at + step, len(size)) - 1] + 1e-9) / threshold, "right"))
            x, y = size[at : at + step, None], size[None, at:stop]
            near = (x > threshold * y - 1e-9) & (np.bitwise_count(bitmap[at : at + step, None] ^ bitmap[None, at:stop]).sum(2, dtype=np.int64) <= limit * (x + y) + 1e-9)
            i, j = np.nonzero(np.triu(near, 1))
            yield pa.record_batch([keys.take(pa.array(i + at)), keys.take(pa.array(j + at))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from pairs(t.column("k").combine_chunks(), t.column("size").to_numpy(), np.frombuffer(b"".join(t.column("bitmap").to_pylist()), np.uint64).reshape(t.num_rows, -1))

        for batch in (b for b in batches if b.num_rows):
            key = batch.column(0).to_numpy()
            for part in np.split(np.arange(len(key)), np.flatnonzero(key[1:] != key[:-1]) + 1):
                piece = batch.slice(int(part[0]), len(part))
                if held and held[0].column(0)[0].as_py() != int(key[part[0]]):
                    yield from block()
                    held = []
                held.append(piece)
        if held:
            yield from block()

    found = large.select("key", "k", "size", "bitmap").repartition("key").sortWithinPartitions("key", "size").mapInArrow(run, f"a {_KEY}, b {_KEY}")
    before = F.col("a") < F.col("b")
    return found.select(F.when(before, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(before, F.col("b")).otherwise(F.col("a")).alias("b"))


def _bags(lines: DataFrame, wanted, bits: int) -> DataFrame:
    """u, words (joined by spaces) of each set whose name hits one of the wanted counters (some others' too), once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit, seen = np.frombuffer(wanted.value, np.uint8), set()
        for batch in batches:
            names, bags = [], []
            for _, grp, _, words in _words(batch):
                u = _name(grp, words)
                if hit[u & (1 << bits) - 1] and u not in seen:
                    seen.add(u)
                    names.append(u)
                    bags.append(" ".join(words))
            yield pa.record_batch([pa.array(names, pa.int64()), pa.array(bags, pa.string())], names=["u", "words"])

    return lines.mapInArrow(run, "u long, words string").dropDuplicates(["u"])


def jaccard_evidence(lines: DataFrame, threshold: float = 0.85, rounds: int = 3, small: int = SMALL) -> DataFrame:
    """Within each group, evidence whose word set is like that of a longer kept one goes: grp, id. Longest first, then
    by id; rows without words stay.

    Equal sets count once. Candidates share a word of their prefixes and are alike in size and bitmap. Pairs of small
    blocks are decided at once. A set with nothing open before it, in its pairs and in its large blocks, is kept and takes
    what is like it; so large groups of near copies leave in `rounds` passes with one pair a member and block. Pairs among
    those still open are then decided, and sets are settled in order.
    """
    spark = lines.sparkSession
    # A null group is one too, and joins don't meet nulls.
    named = F.coalesce(F.concat(F.lit("+"), F.col("grp").cast("string")), F.lit("-"))
    rows = lines.select(named.alias("grp"), F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    facts = written(_facts(rows))
    bare = facts.where("size = 0").select("grp", "id")
    least = F.min(F.struct((-F.col("n")).alias("n"), "id", "u"))
    sets = written(facts.where("size > 0").groupBy("u").agg(F.first("grp").alias("grp"), least.alias("k"), F.first("size").alias("size"), F.first("bitmap").alias("bitmap")))
    n, total = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    bits = min(COUNTERS, max(12, int(2 * total).bit_length()))
    often = _tally(rows, lambda batch: (_slots(_codes(words), grp, bits) for _, grp, _, words in _words(batch)), bits)
    met = written(_met(_postings(rows, threshold, spark.sparkContext.broadcast(often), bits), threshold, small))
    one = sets.select(F.col("u").alias("u"), F.col("k").alias("a"), F.col("size").alias("x"), F.col("bitmap").alias("p"))
    two = sets.select(F.col("u").alias("v"), F.col("k").alias("b"), F.col("size").alias("y"), F.col("bitmap").alias("q"))
    close = _close(met.where("v IS NOT NULL").select("u", "v").distinct().join(one, "u").join(two, "v"), threshold)
    before = F.col("a") < F.col("b")
    near = written(close.select(F.when(before, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(before, F.col("b")).otherwise(F.col("a")).alias("b")))
    large = written(met.where("v IS NULL").select("key", "u").join(sets.select("u", "k", "size", "bitmap"), "u").select("key", "k", "size", "bitmap"))

    def names(pairs: DataFrame) -> DataFrame:
        return pairs.select("a.u").unionByName(pairs.select("b.u"))

    held = min(COUNTERS, max(12, int(8 * n).bit_length()))
    wanted = _tally(names(near).unionByName(large.select("k.u")).distinct(), lambda batch: iter([batch.column(0).to_numpy() & (1 << held) - 1]), held)
    bags = written(_bags(rows.where("text IS NOT NULL"), spark.sparkContext.broadcast(wanted), held))

    def alike(pairs: DataFrame) -> DataFrame:
        found = pairs.join(bags.select(F.col("u").alias("au"), F.col("words").alias("u")), F.col("a.u") == F.col("au")).join(bags.select(F.col("u").alias("bu"), F.col("words").alias("v")), F.col("b.u") == F.col("bu"))
        found = found.select("a", "b", F.split("u", " ").alias("u"), F.split("v", " ").alias("v")).withColumn("shared", F.size(F.array_intersect("u", "v")))
        return found.where(F.col("shared") > F.lit(threshold) * (F.size("u") + F.size("v") - F.col("shared"))).select("a", "b")

    edges = written(alike(near))
    left = written(edges.select(F.col("a").alias("k")).unionByName(edges.select(F.col("b").alias("k"))).unionByName(large.select("k")).distinct())
    kept = sets.select("k").join(left, "k", "left_anti")
    blocks: DataFrame | None = large
    passes = 0
    while left.limit(1).count():
        if blocks is not None and (passes >= rounds or not blocks.limit(1).count()):
            edges, blocks = written(edges.unionByName(alike(written(_every(blocks, threshold).distinct()))).distinct()), None
        waiting = edges.select(F.col("b").alias("k"))
        if blocks is not None:
            heads = blocks.groupBy("key").agg(F.min(F.struct("k", "size", "bitmap")).alias("head"))
            placed = blocks.join(heads, "key").where(F.col("k") != F.col("head.k"))
            waiting = waiting.unionByName(placed.select("k"))
        sure = written(left.join(waiting.distinct(), "k", "left_anti"))
        gone = edges.join(sure.withColumnRenamed("k", "a"), "a", "left_semi").select(F.col("b").alias("k"))
        if blocks is not None:
            stars = placed.join(sure.select(F.col("k").alias("a")), F.col("head.k") == F.col("a"), "left_semi")
            stars = _close(stars.select(F.col("head.k").alias("a"), F.col("k").alias("b"), F.col("head.size").alias("x"), F.col("size").alias("y"), F.col("head.bitmap").alias("p"), F.col("bitmap").alias("q")), threshold)
            gone = gone.unionByName(alike(written(stars.distinct())).select(F.col("b").alias("k")))
        done = written(sure.unionByName(gone).distinct())
        left = written(left.join(done, "k", "left_anti"))
        edges = written(edges.join(done.withColumnRenamed("k", "a"), "a", "left_anti").join(done.withColumnRenamed("k", "b"), "b", "left_anti"))
        if blocks is not None:
            blocks = written(blocks.join(done, "k", "left_anti").select("key", "k", "size", "bitmap"))
        kept = kept.unionByName(sure)
        passes += 1
    own = sets.select("grp", "k").join(kept, "k", "left_semi").select("grp", F.col("k.id").alias("id"))
    grp = F.when(F.col("grp") != "-", F.col("grp").substr(F.lit(2), F.length("grp"))).alias("grp")
    return bare.unionByName(own).select(grp, "id")
