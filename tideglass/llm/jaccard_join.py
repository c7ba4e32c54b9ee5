"""Exact Jaccard join of word-shingle sets, as a join in a metric space.

Jaccard distance and the number of shingles in which two sets differ are metrics, so pivots and the triangle inequality
can part a space into regions that are joined on their own:

1. Neighbourhoods. Linked sets share a shingle among the first n - ceil(t n) + 1 of either, under one order of all
   shingles (frequent ones, found beforehand, come last). Sets that share such a shingle form a region; regions with
   equal members count once.
2. Leaves. A region of at most LEAF sets proposes a spanning forest of its possible links, never all its pairs: bitmaps
   bound the distances of each member to those that it is not connected with. Proposals are then decided exactly, once
   each. A region whose proposals all hold is settled. Of the others only members are left that may still be linked with
   one that they are not connected with anywhere. Regions whose remaining members have the same least one become one
   cell, as regions of near copies differ little; a cell gets its members' whole sets, once each, and goes on by itself.
   Members that several were compared with are its pivots: by the triangle inequality two sets are at least as far apart
   as their exact distances from a pivot differ. It proposes again without what that rules out, in proportion to what
   failed, until it has no proposal left. So tables hold members of regions, never their pairs.
3. Pivots. A larger region is first cut into shells, by distance from the empty set (the number of shingles), and each
   shell into the Voronoi regions of elected pivots, which are settled on their own.
4. Windows. Whatever is not connected with most of its region by then may have partners in other Voronoi regions: it is
   replicated into each that the triangle inequality leaves room for. Regions that are still too large elect pivots
   again; what pivots can't part (sets that are all equally far from each other) is settled block against block.

Equal sets are one point. Nothing is capped. Sets are known by 64-bit hashes of their shingles and of themselves. The
shingle that gives a region its name is dealt out over several tasks if it is frequent, large regions too.

A text without words, or null, has an empty set, is linked with nothing and is its own component. Equal doc_ids and
repeated rows each get their row; a null doc_id is never the name of a component that has another. An empty table
gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.frequent import most_frequent
from tideglass.llm.shingles import SIZE, shingle_sets
from tideglass.llm.store import materialize, release, width

PERCENT = 75
FREQUENT = 200_000
#: Sets of a region that elect no pivots any more. Fewer would part more regions than disks hold (README has figures).
LEAF = 4096
#: Pivots that a cell elects at a time, at most.
PIVOTS = 64
#: Sets that are compared in one task, where pivots can't part them.
BLOCK = 4096
HOT = 2000
SPREAD = 50_000
#: Shingles of all sets of a cell that is compared in one task: 32 MB.
WEIGHT = 4_000_000
#: Edges that one task connects: 16 MB.
TOGETHER = 1_000_000
_KNOWN = 200_000
_DOCS = 2000


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def set_id(shingles: np.ndarray) -> int:
    """64-bit name of a set, as a signed integer."""
    value = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return value - (1 << 64) if value >> 63 else value


def frequent_shingles(scanned: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` shingles, those seen most often, among those that several of two thousand neighbouring documents
    have: sorted hashes and how often each was seen."""
    counted = materialize(scanned.where("times IS NOT NULL").groupBy("shingle").agg(F.sum("times").alias("n")), "frequent")
    found = most_frequent(counted, "shingle", most).toArrow()
    release(counted)
    hashes, counts = (found.column(c).to_numpy().astype(np.int64) for c in ("shingle", "n"))
    hashes = hashes.view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def prefix(shingles: np.ndarray, hashes: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n - ceil(t n) + 1 shingles: infrequent ones by hash, then frequent ones by count and hash; and how
    often each was seen (0: infrequent)."""
    n = len(shingles)
    take = n - (percent * n + 99) // 100 + 1
    if not len(hashes):
        return shingles[:take], np.zeros(take, np.int64)
    at = np.minimum(np.searchsorted(hashes, shingles), len(hashes) - 1)
    often = hashes[at] == shingles
    rare = shingles[~often]
    if len(rare) >= take:
        return rare[:take], np.zeros(take, np.int64)
    rest, seen = shingles[often], counts[at[often]]
    order = np.lexsort((rest, seen))[: take - len(rare)]
    return np.concatenate([rare, rest[order]]), np.concatenate([np.zeros(len(rare), np.int64), seen[order]])


def scan(docs: DataFrame, size: int) -> DataFrame:
    """One pass over the texts, written once. A row for each document: doc_id, n_shingles, sid (null for an empty set),
    bits (its bitmap); and rows (shingle, times) of shingles that are frequent among two thousand documents."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("n_shingles", pa.int64()), ("sid", pa.int64()), ("bits", pa.binary()), ("shingle", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _DOCS):
                batch = whole.slice(at, _DOCS)
                sets = shingle_sets(batch.column(1), size)
                own = [pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), pa.array([parity(s).tobytes() if len(s) else None for s in sets], pa.binary())]
                yield pa.record_batch([batch.column(0), *own, *(pa.nulls(len(sets), pa.int64()) for _ in range(2))], schema=schema)
                found, n = np.unique(np.concatenate(sets), return_counts=True)
                many = n > 3
                empty = [pa.nulls(int(many.sum()), f.type) for f in list(schema)[:4]]
                yield pa.record_batch([*empty, pa.array(_signed(found[many])), pa.array(n[many].astype(np.int64))], schema=schema)

    return materialize(rows.mapInArrow(run, f"doc_id {kind.simpleString()}, n_shingles bigint, sid bigint, bits binary, shingle bigint, times bigint"), "points")


def _region_names(starts: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A name for each run of x, the same for equal members."""
    with np.errstate(over="ignore"):
        mixed = (x.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        summed = np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), starts)
        return _signed((summed ^ (summed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93))


def neighbourhoods(docs: DataFrame, scanned: DataFrame, size: int, percent: int) -> DataFrame:
    """Regions of sets that share a prefix shingle: g, x; written once, regions with equal members once.

    Postings of a shingle that was seen more than SPREAD times are dealt out over several tasks and come together
    under the shingle's own name; so are runs that are too long to be held.
    """
    spark = docs.sparkSession
    often = spark.sparkContext.broadcast(frequent_shingles(scanned))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, _DOCS):
                names, firsts, spread = [], [], []
                for s in shingle_sets(whole.column(0).slice(at, _DOCS), size):
                    if not len(s) or (sid := set_id(s)) in seen:
                        continue
                    if len(seen) < _KNOWN:
                        seen.add(sid)
                    p, times = prefix(s, *often.value, percent)
                    firsts.append(p)
                    names.append(np.full(len(p), sid, np.int64))
                    spread.append(np.where(times > SPREAD, 1 + sid % (times // SPREAD + 1), 0))
                if names:
                    yield pa.record_batch([pa.array(_signed(np.concatenate(firsts))), pa.array(np.concatenate(spread).astype(np.int32)), pa.array(np.concatenate(names))], names=["shingle", "share", "x"])

    posted = docs.select("text").mapInArrow(post, "shingle bigint, share int, x bigint").repartition(width(spark), "shingle", "share").sortWithinPartitions("shingle", "share", "x")

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3  # the run at hand, which may go on in the next batch
        passed: tuple | None = None  # the key of a run that was too long to be held
        seen: set[int] = set()

        def rows(g: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(g), pa.array(x)], names=["g", "x"])

        def regions(s: np.ndarray, share: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole runs."""
            if not len(s):
                return
            step = (s[1:] != s[:-1]) | (share[1:] != share[:-1])
            fresh = np.concatenate([[True], step | (x[1:] != x[:-1])])
            s, share, x, step = s[fresh], share[fresh], x[fresh], np.concatenate([[True], step])[fresh]
            starts = np.flatnonzero(step)
            lengths = np.diff(starts, append=len(s))
            own = (share[starts] > 0) | np.array([passed == (a, b) for a, b in zip(s[starts[:1]], share[starts[:1]], strict=True)] + [False] * (len(starts) - 1))
            many = np.repeat((lengths > 1) | own, lengths)
            if not many.any():
                return
            s, x, own, lengths = s[many], x[many], own[(lengths > 1) | own], lengths[(lengths > 1) | own]
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            names = np.where(own, s[starts], _region_names(starts, x))
            fresh = np.zeros(len(names), bool)
            fresh[np.unique(names, return_index=True)[1]] = True
            fresh |= own
            for i in np.flatnonzero(fresh & ~own):
                if (g := int(names[i])) in seen:
                    fresh[i] = False
                elif len(seen) < _KNOWN:
                    seen.add(g)
            yield rows(np.repeat(names, lengths)[np.repeat(fresh, lengths)], x[np.repeat(fresh, lengths)])

        for batch in batches:
            s, share, x = (np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True))
            if not len(s):
                continue
            before = np.flatnonzero((s != s[-1]) | (share != share[-1]))
            cut = int(before[-1]) + 1 if len(before) else 0
            yield from regions(s[:cut], share[:cut], x[:cut])
            held = [s[cut:], share[cut:], x[cut:]]
            if len(held[0]) > _KNOWN:
                passed = (int(s[-1]), int(share[-1]))
                part = np.unique(held[2])
                yield rows(np.full(len(part), s[-1]), part)
                held = [c[:0] for c in held]
        yield from regions(*held)

    # A run that was passed on in parts has its last part under the same name.
    return materialize(posted.mapInArrow(group, "g bigint, x bigint").distinct(), "regions")


def parity(shingles: np.ndarray) -> np.ndarray:
    """A bitmap of two to four bits a shingle in which each shingle turns one bit. Two sets differ in at least as many
    shingles as their bitmaps differ in bits; halves laid over each other give the bitmap of half the size."""
    size = bitmap_bits(len(shingles))
    bits = np.bincount(((shingles >> np.uint64(7)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little")


def bitmap_bits(n: int) -> int:
    return 64 << max(0, int(2 * n - 1).bit_length() - 6)


def fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    while len(bitmap) > size:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def differ(n: int, a: bytes, m: int, b: bytes) -> int:
    """In how many shingles two sets differ at least, by their sizes and bitmaps."""
    size = min(len(a), len(b))
    x, y = (fold(np.frombuffer(v, np.uint8), size) for v in (a, b))
    return max(abs(n - m), int(np.bitwise_count(x ^ y).sum()))


def room(n: np.ndarray | int, m: np.ndarray | int, differ: np.ndarray | int, percent: int) -> np.ndarray | bool:
    """Whether sets of n and m shingles that differ in at least `differ` may be linked."""
    return 100 * (n + m - differ) >= percent * (n + m + differ)


def forest(n: list[int], bits: list[bytes], home: list[bool], root: list[int], failed: dict[tuple[int, int], int], spare: int, percent: int) -> list[tuple[int, int]]:
    """Pairs of positions that may be linked, in order of size: a spanning forest of all such pairs between different
    roots, one of them at home, that have not failed; before that, `spare` pairs regardless of each other.

    failed has the exact distances of pairs that were compared. A member that several were compared with is a pivot:
    two members are at least as far apart as their distances from it differ (triangle inequality)."""
    m = len(n)
    out: list[tuple[int, int]] = []
    if m <= 8:
        # Small regions are most of all: plain integers are faster here.
        pivots = _pivots(failed, m)
        maps = [(int.from_bytes(b, "little"), 8 * len(b)) for b in bits]
        root = list(root)
        for i in range(m):
            for j in range(i + 1, m):
                if root[i] == root[j] or not (home[i] or home[j]) or 100 * n[i] < percent * n[j] or (i, j) in failed:
                    continue
                (a, size), (b, other) = maps[i], maps[j]
                while other > size:
                    other //= 2
                    b = (b >> other) ^ (b & ((1 << other) - 1))
                least = max(n[j] - n[i], (a ^ b).bit_count(), *(abs(d[i] - d[j]) for d in pivots if d[i] >= 0 and d[j] >= 0))
                if room(n[i], n[j], least, percent):
                    out.append((i, j))
                    if spare > 0:
                        spare -= 1
                    else:
                        old, new = root[j], root[i]
                        root = [new if r == old else r for r in root]
        return out
    roots = np.array(root, np.int64)
    for k, at in near(n, bits, home, roots, failed, percent):
        if len(at) <= spare:
            out += [(k, int(j)) for j in at]
            spare -= len(at)
            continue
        spare = 0
        for j in at[np.sort(np.unique(roots[at], return_index=True)[1])]:
            out.append((k, int(j)))
            roots[roots == roots[j]] = roots[k]
    return out


def near(n: list[int], bits: list[bytes], home: list[bool], roots: np.ndarray, failed: dict[tuple[int, int], int], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each position, those after it that it may be linked with, nearest first, as forest has it; roots may change
    from one position to the next."""
    m, pivots = len(n), _pivots(failed, len(n))
    sizes, at_home = np.array(n, np.int64), np.array(home, bool)
    lengths = np.array([len(b) for b in bits])
    stops = np.searchsorted(sizes, 100 * sizes // percent, "right")
    matrix, low, length = np.zeros((0, 0), np.uint64), 0, 0
    for k in range(m - 1):
        if lengths[k] != length:
            # Partners are at most a third larger, so their bitmaps have this size or twice it.
            low, length = k, int(lengths[k])
            high = int(np.searchsorted(lengths, 2 * length, "right"))
            matrix = np.stack([fold(np.frombuffer(bits[i], np.uint8), length) for i in range(low, high)]).view(np.uint64)
        at = k + 1 + np.flatnonzero(roots[k + 1 : stops[k]] != roots[k])
        if not at_home[k]:
            at = at[at_home[at]]
        if not len(at):
            continue
        differ = np.maximum(np.bitwise_count(matrix[at - low] ^ matrix[k - low]).sum(axis=1, dtype=np.int64), sizes[at] - sizes[k])
        for d in pivots:
            if d[k] >= 0:
                differ = np.maximum(differ, np.where(d[at] >= 0, np.abs(d[at] - d[k]), 0))
        fits = room(sizes[at], sizes[k], differ, percent)
        at, differ = at[fits], differ[fits]
        if failed and len(at):
            fresh = np.array([(k, j) not in failed for j in at.tolist()], bool)
            at, differ = at[fresh], differ[fresh]
        if len(at):
            yield k, at[np.argsort(differ, kind="stable")]


def _pivots(failed: dict[tuple[int, int], int], m: int, most: int = 16) -> list[np.ndarray]:
    """Known distances from the members that most others were compared with: -1 where none is known."""
    met: dict[int, list[tuple[int, int]]] = {}
    for (i, j), apart in failed.items():
        met.setdefault(i, []).append((j, apart))
        met.setdefault(j, []).append((i, apart))
    out = []
    for i in sorted((i for i in met if len(met[i]) > 1), key=lambda i: (-len(met[i]), i))[:most]:
        known = np.full(m, -1, np.int64)
        known[[j for j, _ in met[i]]] = [apart for _, apart in met[i]]
        known[i] = 0
        out.append(known)
    return out


CELL = "g bigint, x bigint, n bigint, bits binary, home boolean, label bigint"


def _roots(labels: list[int]) -> list[int]:
    """For each position the first one that has its label."""
    first: dict[int, int] = {}
    return [first.setdefault(label, i) for i, label in enumerate(labels)]


def _each(cells: DataFrame, failed: DataFrame | None, act: Callable[[list[tuple], list[tuple]], list[tuple]], columns: list[str]) -> DataFrame:
    """g and the columns of act's rows for each cell. act gets the cell's rows x, p, apart of failed, and its members in
    order of size: n, x, home, label, bits."""
    spark = cells.sparkSession
    rows = cells.select("g", F.lit(1).alias("member"), "n", "x", F.lit(0).cast("bigint").alias("p"), "home", "label", "bits")
    if failed is not None:
        rows = rows.unionByName(failed.select("g", F.lit(0).alias("member"), F.col("apart").alias("n"), "x", "p", F.lit(False).alias("home"), F.lit(0).cast("bigint").alias("label"), F.lit(b"").alias("bits")))
    placed = rows.repartition(width(spark), "g").sortWithinPartitions("g", "member", "n", "x")
    names = ["g", *(c.split()[0] for c in columns)]
    types = [pa.int64(), *(pa.bool_() if c.endswith("boolean") else pa.int64() for c in columns)]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: int | None = None
        known: list[tuple] = []
        held: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            for g, member, n, x, p, home, label, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != key:
                    if len(held) > 1:
                        out += [(key, *row) for row in act(known, held)]
                    key, known, held = g, [], []
                if member:
                    held.append((n, x, home, label, bits))
                else:
                    known.append((x, p, n))
            yield batch_of(out)
            out = []
        if len(held) > 1:
            yield batch_of([(key, *row) for row in act(known, held)])

    return placed.mapInArrow(run, ", ".join(["g bigint", *columns]))


def propose(cells: DataFrame, percent: int) -> DataFrame:
    """g, x, p: pairs that may be linked, as few as connect each cell; of the two, p has fewer shingles or the lesser id."""

    def close(known: list[tuple], held: list[tuple]) -> list[tuple]:
        n, x, home, label, bits = (list(c) for c in zip(*held, strict=True))
        return [(x[j], x[i]) for i, j in forest(n, bits, home, _roots(label), {}, 0, percent)]

    return _each(cells, None, close, ["x bigint", "p bigint"])


def still_open(cells: DataFrame, failed: DataFrame, percent: int) -> DataFrame:
    """g, least, x, n, home, label: members of each cell that may be linked with one of another label, and the least of
    them. failed: g, x, p, apart of pairs that are not linked."""

    def close(known: list[tuple], held: list[tuple]) -> list[tuple]:
        n, x, home, label, bits = (list(c) for c in zip(*held, strict=True))
        place = {v: i for i, v in enumerate(x)}
        apart = {(min(i, j), max(i, j)): d for i, j, d in ((place[a], place[b], d) for a, b, d in known)}
        some = np.zeros(len(n), bool)
        for k, at in near(n, bits, home, np.array(_roots(label)), apart, percent):
            some[k] = True
            some[at] = True
        left = np.flatnonzero(some).tolist()
        least = min((x[i] for i in left), default=0)
        return [(least, x[i], n[i], home[i], label[i]) for i in left]

    return _each(cells, failed, close, ["least bigint", "x bigint", "n bigint", "home boolean", "label bigint"])


class Sets:
    """Whole sets of the documents that proposals name, read from the texts once and kept as a table."""

    def __init__(self, docs: DataFrame, firsts: DataFrame, size: int):
        self.docs, self.firsts, self.size = docs, firsts, size
        self.held: DataFrame | None = None

    def of(self, pairs: DataFrame) -> DataFrame:
        """sid, bits (all shingles) of at least the sets in pairs."""
        ids = pairs.select(F.col("x").alias("sid")).union(pairs.select("p")).distinct()
        missing = materialize(ids if self.held is None else ids.join(self.held.select("sid"), "sid", "left_anti"), "wanted")
        if self.held is None or missing.limit(1).count():
            found = materialize(self._read(missing), "sets")
            self.held = found if self.held is None else self.held.unionByName(found)
        release(missing)
        return self.held

    def _read(self, wanted: DataFrame) -> DataFrame:
        """The wanted sets, one row each, from the documents that are their first. Only those documents' texts are
        looked at; Spark broadcasts the ids if they are few, and else shuffles texts by id, once."""
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    sets = [s for s in shingle_sets(whole.column(0).slice(at, 1000), size) if len(s)]
                    yield pa.record_batch([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "bits"])

        places = self.firsts.join(wanted, "sid", "left_semi").select(F.xxhash64("first").alias("place"))
        texts = self.docs.select(F.xxhash64("doc_id").alias("place"), "text").join(places, "place", "left_semi").select("text")
        # Other documents of the same id may have come along.
        return texts.mapInArrow(run, "sid bigint, bits binary").join(wanted, "sid", "left_semi").groupBy("sid").agg(F.first("bits").alias("bits"))


def compare(a: np.ndarray, b: np.ndarray, percent: int) -> tuple[bool, int]:
    """Whether two sets (sorted, not empty) are linked, and in how many shingles they differ."""
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common), len(a) + len(b) - 2 * common


def decide(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """x, p, ok, apart for distinct pairs (x, p): whether they are linked, and in how many shingles they differ; written
    once."""
    one = sets.select(F.col("sid").alias("x"), F.col("bits").alias("one"))
    other = sets.select(F.col("sid").alias("p"), F.col("bits").alias("other"))
    met = pairs.join(one, "x").join(other, "p").select("x", "p", "one", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, apart = [], []
            for one, other in zip(batch.column(2), batch.column(3), strict=True):
                holds, far = compare(*(np.frombuffer(v.as_buffer(), np.uint64) for v in (one, other)), percent)
                ok.append(holds)
                apart.append(far)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ok, pa.bool_()), pa.array(apart, pa.int64())], names=["x", "p", "ok", "apart"])

    return materialize(met.mapInArrow(run, "x bigint, p bigint, ok boolean, apart bigint"), "decided")


def resolve(x: list[int], home: list[bool], label: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (x, p) that connect all members of a cell that are connected by labels and by links of which an end is at
    home. Every distance that was found rules out others (forest)."""
    order = sorted(range(len(x)), key=lambda i: (len(sets[i]), x[i]))
    x, home, label, sets = ([c[i] for i in order] for c in (x, home, label, sets))
    n, bits, root = [len(s) for s in sets], [parity(s).tobytes() for s in sets], np.array(_roots(label))
    out: list[tuple[int, int]] = []
    failed: dict[tuple[int, int], int] = {}
    # As many pairs at once as failed before, so that the work grows with what is near.
    while pairs := forest(n, bits, home, root, failed, 4 * len(failed), percent):
        for i, j in pairs:
            if root[i] == root[j]:
                continue
            ok, apart = compare(sets[i], sets[j], percent)
            if ok:
                out.append((x[j], x[i]))
                root[root == root[j]] = root[i]
            else:
                failed[i, j] = apart
    return out


def finish(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (x, p) of cells (g, x, home, label), decided where all sets of a cell are together."""
    rows = cells.join(sets.select(F.col("sid").alias("x"), "bits"), "x").select("g", "x", "home", "label", "bits")
    placed = rows.repartition(width(cells.sparkSession), "g").sortWithinPartitions("g", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: int | None = None
        held: list[tuple] = []

        def links() -> pa.RecordBatch:
            found = resolve(*(list(c) for c in zip(*held, strict=True)), percent) if held else []
            return pa.record_batch([pa.array([r[j] for r in found], pa.int64()) for j in range(2)], names=["x", "p"])

        for batch in batches:
            for i, (g, x, home, label) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)):
                if g != key:
                    yield links()
                    key, held = g, []
                held.append((x, home, label, np.frombuffer(batch.column(4)[i].as_py(), np.uint64)))
        yield links()

    return placed.mapInArrow(run, "x bigint, p bigint")


def joined(opened: DataFrame) -> DataFrame:
    """g, x, home, label of what is still open: cells with the same least member are one, if that is no larger than a
    leaf, and each member is in it once; cells of much weight are dealt out block against block."""
    columns = ["g", "x", "n", "home", "label"]
    met = opened.groupBy(F.col("least").alias("g"), "x").agg(F.first("n").alias("n"), F.max("home").alias("home"), F.first("label").alias("label"))
    met = materialize(met, "met")
    # Of cells beyond these bounds there are few for the rows, so their names are broadcast and no cell gathers in a task.
    large = F.broadcast(met.groupBy("g").count().where(F.col("count") > LEAF).select("g"))
    own = opened.join(large.withColumnRenamed("g", "least"), "least", "left_semi").select(*columns)
    cells = materialize(met.join(large, "g", "left_anti").unionByName(own), "joined")
    heavy = F.broadcast(cells.groupBy("g").agg(F.sum("n").alias("weight")).where(F.col("weight") > WEIGHT).select("g"))
    parts = blocks(sized(cells.join(heavy, "g", "left_semi").withColumn("bits", F.lit(b""))))
    return cells.join(heavy, "g", "left_anti").unionByName(parts.select(*columns)).select("g", "x", "home", "label")


def settle(cells: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """Links (x, p) that connect, with those that labels stand for, all sets of each cell that are connected by links
    within it. cells may be read twice; each x has one label."""
    spark = cells.sparkSession
    proposed = materialize(propose(cells, percent), "proposed")
    pairs = materialize(proposed.select("x", "p").distinct(), "pairs")
    if not pairs.limit(1).count():
        release(proposed, pairs)
        return spark.createDataFrame([], "x bigint, p bigint")
    decided = decide(pairs, sets.of(pairs), percent)
    linked = decided.where("ok").select("x", "p")
    failed = materialize(proposed.join(decided.where("NOT ok").select("x", "p", "apart"), ["x", "p"]).select("g", "x", "p", "apart"), "failed")
    again = materialize(failed.select("g").distinct(), "unsettled")
    release(proposed, pairs)
    if not again.limit(1).count():
        release(failed, again)
        return linked
    left = materialize(cells.join(again, "g", "left_semi"), "cells")
    # What is connected anywhere is connected here.
    labels = components(linked.unionByName(left.where("x != label").select("x", F.col("label").alias("p"))))
    named = left.join(labels, F.col("x") == F.col("node"), "left").select("g", "x", "n", "bits", "home", F.coalesce("node_label", "x").alias("label"))
    opened = materialize(still_open(named, failed, percent), "opened")
    release(failed, again, left, labels)
    if not opened.limit(1).count():
        release(opened)
        return linked
    rest = materialize(joined(opened), "rest")
    found = materialize(finish(rest, sets.of(rest.select("x", F.col("x").alias("p"))), percent), "found")
    release(opened, rest)
    return linked.unionByName(found)


def shells(regions: DataFrame, percent: int) -> DataFrame:
    """Large regions cut by distance from the empty set, the number of shingles: a set is at home among those with
    bitmaps of its size, and a guest among smaller ones if it is close enough to them to be linked with one."""
    length = F.octet_length("bits")
    most = 2 * length  # shingles that a bitmap of half the size stands for at most
    own = F.struct(length.alias("length"), F.lit(True).alias("home"))
    guest = F.when((length > 8) & (F.col("n") * percent <= most * 100), F.struct((length / 2).cast("int").alias("length"), F.lit(False).alias("home")))
    cut = regions.withColumn("shell", F.explode(F.array_compact(F.array(own, guest))))
    return cut.select(F.xxhash64("g", "shell.length").alias("g"), "shell.length", "x", "n", "bits", F.col("shell.home").alias("home"), "label")


def sized(cells: DataFrame) -> DataFrame:
    """cells with what is known of their cell: members, and main, the label that most of them have. Cells without two
    labels or anything at home have no open pair and are left out."""
    labels = cells.groupBy("g", "label").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("home"))
    known = labels.groupBy("g").agg(F.sum("n").alias("members"), F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels"), F.max("home").alias("any_home"))
    return cells.join(known.where("labels > 1 AND any_home").select("g", "members", "main"), "g")


def voronoi(cells: DataFrame, level: int, windows: bool, percent: int) -> DataFrame:
    """Cells (sized) cut into the Voronoi regions of their pivots: g, length, x, n, bits, home, label, parent (members of
    the cell that was cut).

    A cell elects about two pivots for each LEAF members and at most about PIVOTS, by hash. Distances are those of bitmaps of the cell's length.
    Linked sets differ in at most a part of n shingles, the radius. With windows, a member that is not connected with
    most of its cell is also replicated, as a guest, into the regions of other pivots that are at most two radii
    farther away than its own: any partner's region is among them. Large cells are dealt out over several tasks.
    """
    spark = cells.sparkSession
    wanted = F.least(F.lit(PIVOTS), F.ceil(2 * F.col("members") / LEAF))
    elected = cells.where("home").withColumn("spin", F.pmod(F.xxhash64("x", F.lit(level)), F.lit(1 << 30)))
    pivots = elected.where(F.col("spin") < wanted * (1 << 30) / F.col("members")).select("g", F.ceil(F.col("members") / HOT).cast("int").alias("shares"), "x", "bits", "length")
    pivots = pivots.select("g", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("member"), "length", "x", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("home"), F.lit(0).cast("bigint").alias("label"), F.lit(False).alias("stray"), F.lit(0).cast("bigint").alias("members"), "bits")
    stray = F.lit(windows) & ((F.col("label") != F.col("main")) | ~F.col("home"))
    rows = cells.select("g", F.pmod(F.xxhash64("x"), F.ceil(F.col("members") / HOT)).cast("int").alias("share"), F.lit(1).alias("member"), "length", "x", "n", "home", "label", stray.alias("stray"), "members", "bits")
    placed = rows.unionByName(pivots).repartition(width(spark), "g", "share").sortWithinPartitions("g", "share", "member", "x")
    names = ["g", "length", "x", "n", "bits", "home", "label", "parent"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, maps = None, np.zeros(0, np.int64), np.zeros((0, 0), np.uint64)
        found: list[tuple[int, np.ndarray]] = []
        for batch in batches:
            out: list[tuple] = []
            for g, share, member, length, x, n, home, label, stray, members, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, share) != key:
                    key, found, ids = (g, share), [], np.zeros(0, np.int64)
                bits = fold(np.frombuffer(raw, np.uint8), length)
                if not member:
                    found.append((x, bits))
                    continue
                if len(ids) != len(found):
                    ids = np.array([i for i, _ in found], np.int64)
                    maps = np.stack([b for _, b in found]).view(np.uint64)
                if not len(ids):  # no pivot was elected: the cell stays as it is
                    out.append((g, length, x, n, raw, home, label, members))
                    continue
                far = np.bitwise_count(maps ^ bits.view(np.uint64)).sum(axis=1, dtype=np.int64)
                nearest = int(far.argmin())
                near = np.flatnonzero(far <= far[nearest] + 2 * ((100 - percent) * n // percent)) if stray else [nearest]
                for i in near:
                    out.append((_mix(g, int(ids[i])), length, x, n, raw, home and int(i) == nearest, label, members))
            yield pa.record_batch([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names=names)

    return placed.mapInArrow(run, "g bigint, length int, x bigint, n bigint, bits binary, home boolean, label bigint, parent bigint")


def _mix(a: int, b: int) -> int:
    """A signed 64-bit name of two."""
    value = xxhash.xxh3_64_intdigest(a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True))
    return value - (1 << 64) if value >> 63 else value


def blocks(cells: DataFrame) -> DataFrame:
    """Cells (sized) block against block: members at home by strays, which are all that is guest or not of the main
    label. Every open pair has a stray and a member at home. Blocks are bounded in members and in shingles."""
    parts = lambda which: F.ceil(F.greatest(F.count_if(which) / max(1, BLOCK // 2), F.sum(F.when(which, F.col("n")).otherwise(0)) / max(1, WEIGHT // 2))).cast("int")
    stray = (F.col("label") != F.col("main")) | ~F.col("home")
    counts = cells.groupBy("g").agg(parts(F.col("home")).alias("rows"), F.greatest(F.lit(1), parts(stray)).alias("cols"))
    spin = lambda n, seed: F.pmod(F.xxhash64("x", F.lit(seed)), n).cast("int")
    own = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda j: F.struct(spin(F.col("rows"), 5).alias("i"), j.alias("j"))))
    across = F.when(stray, F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.struct(i.alias("i"), spin(F.col("cols"), 6).alias("j"))))
    empty = F.array().cast("array<struct<i:int,j:int>>")
    placed = F.array_distinct(F.concat(F.coalesce(own, empty), F.coalesce(across, empty)))
    cut = cells.join(counts, "g").withColumn("at", F.explode(placed))
    return cut.select(F.xxhash64("g", "at.i", "at.j").alias("g"), "x", "n", "bits", "home", "label")


def cells_of(large: DataFrame, windows: bool, percent: int) -> DataFrame:
    """Large regions as cells of a bounded size; written. With windows they hold every open pair of their region."""
    spark = large.sparkSession
    columns = [c.split()[0] for c in CELL.split(", ")]
    done = spark.createDataFrame([], CELL)
    now = materialize(sized(shells(large, percent)), "shells")
    level = 0
    while now.limit(1).count():
        done = done.unionByName(now.where(F.col("members") <= LEAF).select(*columns))
        cut = voronoi(now.where(F.col("members") > LEAF), level, windows, percent)
        if not windows:
            # Whatever is large still is taken in parts: this is but a first round.
            parts = sized(cut.drop("parent"))
            part = F.pmod(F.xxhash64("x", F.lit(3)), F.ceil(F.col("members") / BLOCK))
            done = done.unionByName(parts.select(F.xxhash64("g", part).alias("g"), *columns[1:]))
            break
        parts = materialize(sized(cut), "voronoi")
        parted = F.col("members") * 4 <= F.col("parent") * 3
        done = done.unionByName(blocks(parts.where((F.col("members") > LEAF) & ~parted)).select(*columns))
        now = parts.where((F.col("members") <= LEAF) | parted).drop("parent")
        level += 1
    return materialize(done, "cells")


def links(docs: DataFrame, scanned: DataFrame, firsts: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Links (x, p) between sets that connect all sets within the distance, directly or through others."""
    regions = neighbourhoods(docs, scanned, size, percent)
    one = scanned.where("sid IS NOT NULL").groupBy("sid").agg(F.first("n_shingles").alias("n"), F.first("bits").alias("bits"))
    one = materialize(one.join(regions.select(F.col("x").alias("sid")).distinct(), "sid", "left_semi"), "bitmaps")
    rows = regions.join(one, F.col("x") == F.col("sid")).select("g", "x", "n", "bits", F.lit(True).alias("home"), F.col("x").alias("label"))
    large = materialize(regions.groupBy("g").count().where(F.col("count") > LEAF).select("g"), "large")
    sets = Sets(docs, firsts, size)
    some = bool(large.limit(1).count())
    cells = rows
    if some:
        whole = materialize(rows.join(large, "g", "left_semi"), "large-regions")
        parts = cells_of(whole, False, percent)
        cells = rows.join(large, "g", "left_anti").unionByName(parts)
    found = settle(cells, sets, percent)
    if some:
        # What is connected by now needs no comparison; the rest of each large region is looked at again, through windows.
        labels = components(found)
        named = whole.join(labels, F.col("x") == F.col("node"), "left").select("g", "x", "n", "bits", "home", F.coalesce("node_label", "x").alias("label"))
        parts_again = cells_of(materialize(named, "labelled"), True, percent)
        found = found.unionByName(settle(parts_again, sets, percent))
        release(whole, parts, parts_again)
    release(regions, large, one)
    return found


def _connect(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of edges (u, v) that are not the least of their component, and that least node."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        # Each end's own label moves too, so trees are hooked onto trees.
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, low)
        while not (new == new[new]).all():
            new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def components(edges: DataFrame, together: int = TOGETHER) -> DataFrame:
    """node, node_label (the least node of its component) for all nodes of edges (x, p) but those least ones; written.

    Edges are contracted by large-star and small-star rounds; when not more than `together` are left, one task connects
    them.
    """
    edges = edges.select(F.greatest("x", "p").alias("u"), F.least("x", "p").alias("v")).where("u != v").distinct()
    state = None
    edges = materialize(edges, "edges")

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(c.to_numpy(zero_copy_only=False) for c in b.columns) for b in batches]
        if held:
            u, v = (np.concatenate(c) for c in zip(*held, strict=True))
            yield pa.record_batch([pa.array(c) for c in _connect(u, v)], names=["node", "node_label"])

    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now[0] <= together:
            return materialize(edges.coalesce(1).mapInArrow(connect, "node bigint, node_label bigint"), "connected")
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("node_label"))
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        old, edges = edges, materialize(small, "small-star")
        release(old, large)


def cluster(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id."""
    rows = docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text"))
    scanned = scan(rows, size)
    named = scanned.where("n_shingles IS NOT NULL").select("doc_id", "n_shingles", "sid")
    first = materialize(named.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("first")), "firsts")
    labels = components(links(rows, scanned, first, size, percent))
    labelled = materialize(first.join(labels, F.col("sid") == F.col("node"), "left").select("sid", "first", F.coalesce("node_label", "sid").alias("label")), "labels")
    names = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    by_set = materialize(labelled.join(names, "label").select("sid", "component_id"), "components")
    release(first, labelled)
    known = named.where("sid IS NOT NULL").join(by_set, "sid").select("doc_id", "n_shingles", "component_id")
    empty = named.where("sid IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.unionByName(empty).withColumnRenamed("doc_id", key)


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that another row of their group stands for: the one with the least (key, row) stays, null
    keys last. Its columns may have any names.

    Rows are numbered and written once, so equal and null keys are told apart and a tie has one winner even after a
    task is retried. Only numbers of rows to go meet the documents.
    """
    inner = [f"c{i}" for i in range(len(docs.columns))]
    at, body = inner[docs.columns.index(key)], inner[docs.columns.index(text)]
    numbered = materialize(docs.toDF(*inner).withColumn("row", F.monotonically_increasing_id()), "numbered")
    groups = cluster(numbered, "row", body).select("row", "component_id")
    placed = materialize(groups.join(numbered.select("row", F.col(at).alias("key")), "row"), "placed")
    least = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("best")
    stay = placed.groupBy("component_id").agg(least).select(F.col("best.row").alias("row"))
    gone = materialize(placed.select("row").join(stay, "row", "left_anti"), "gone")
    release(placed)
    return numbered.join(gone, "row", "left_anti").select(*inner).toDF(*docs.columns)
