"""Packing token sequences into windows by non-negative least squares.

Every document is tokenized once; an end id follows its ids. Full windows are cut off its front, which leaves at most
one tail per document, shorter than a window. The histogram of tail lengths (window - 1 counters, whatever the input's
size) is all that planning needs: all combinations of two or three lengths that fill a window are columns, their
repeat counts are solved by non-negative least squares, rounded down and capped by what is there. Tails that no
combination takes are laid end to end, longest first, and cut where a window ends; what is left at the very end is cut
into powers of two, which need no padding. So nothing is padded.

Places follow from a tail's rank among tails of its length, which is its rank in its task plus what the tasks before
hold: no exchange of ids by length, and no hot length.

Null or empty text is the end id alone. Each row is a document of its own, repeated rows too. An empty table gives an
empty result. Columns other than the key and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideglass.llm.store import materialize
from tideglass.llm.worker import kept

WINDOW = 1024
END_ID = 0
#: Both libraries cut texts alike whose code points are all below this one.
PLAIN_TOP = "԰"


class Ids:
    """ids of texts as tokenizers gives them. Texts of plain Latin, Greek or Cyrillic take a faster library with the same ranks."""

    def __init__(self, path: str, ranks: str | None):
        self.path = path
        self.loaded = None
        self.fast = None
        if ranks:
            import base64
            import json

            import public_tokenizers
            import tiktoken

            with open(path, encoding="utf-8") as f:
                self.special = [t["content"] for t in json.load(f)["added_tokens"]]
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    @property
    def whole(self):  # noqa: ANN201 - a tokenizers.Tokenizer, loaded when a text first needs it
        if self.loaded is None:
            from tokenizers import Tokenizer

            self.loaded = Tokenizer.from_file(self.path)
        return self.loaded

    def __call__(self, text: str) -> list[int]:
        if self.fast and (text.isascii() or max(text) < PLAIN_TOP) and not any(s in text for s in self.special):
            return self.fast(text)
        return self.whole.encode(text, add_special_tokens=False).ids


def ids_of(path: str, ranks: str | None) -> Callable[[str], list[int]]:
    return kept(f"ids:{path}:{ranks}", lambda: Ids(path, ranks))


def combinations(window: int) -> np.ndarray:
    """All multisets of two or three lengths that fill the window, a row each; 0 stands for no third."""
    a = np.arange(1, window)
    two = np.stack([a, window - a, 0 * a], axis=1)[: window // 2]
    x, y = np.meshgrid(a, a, indexing="ij")
    z = window - x - y
    three = np.stack([x, y, z], axis=-1)[(x <= y) & (y <= z)]
    return np.concatenate([two, three])


def non_negative_least_squares(combos: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes |A x - histogram| small, A's columns being the combinations; accelerated projected gradient."""
    size = len(histogram)

    def ahead(x: np.ndarray) -> np.ndarray:
        out = np.bincount(combos.ravel(), np.repeat(x, combos.shape[1]), size)
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return r[combos].sum(axis=1)

    v = np.ones(len(combos))
    for _ in range(30):
        v = back(ahead(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(ahead(y) - histogram) / (1.01 * norm))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


@dataclass(frozen=True)
class Plan:
    """For each length: uses of it, in order: first rank, how many times one sequence has it, first sequence, offset there; then the ranks that are left over, and where those begin."""

    firsts: list[np.ndarray]
    times: list[np.ndarray]
    sequences: list[np.ndarray]
    offsets: list[np.ndarray]
    used: np.ndarray
    left_at: np.ndarray
    left_total: int
    n_sequences: int


def plan(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """histogram[l]: tails of length l, for 0 < l < window."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    combos = combinations(window)
    combos = combos[(left[combos] > 0).sum(axis=1) == (combos > 0).sum(axis=1)]
    uses: list[list[tuple[int, int, int, int]]] = [[] for _ in range(window)]
    used = np.zeros(window, np.int64)
    sequence = 0
    if len(combos):
        x = np.floor(non_negative_least_squares(combos, left.astype(float)) + 1e-9).astype(np.int64)
        for i in np.argsort(-x, kind="stable"):
            if x[i] <= 0:
                break
            parts = {int(length): int((combos[i] == length).sum()) for length in combos[i] if length}
            n = int(min(x[i], *(left[length] // k for length, k in parts.items())))
            if n <= 0:
                continue
            offset = 0
            for length, k in parts.items():
                uses[length].append((int(used[length]), k, sequence, offset))
                used[length] += n * k
                left[length] -= n * k
                offset += length * k
            sequence += n
    lengths = np.arange(window)
    mass = left * lengths
    at = np.concatenate([np.cumsum(mass[::-1])[::-1][1:], [0]])  # longest first
    cols = [[np.array([u[j] for u in us], np.int64) for us in uses] for j in range(4)]
    return Plan(*cols, used, at, int(mass.sum()), sequence)


def places(p: Plan, length: int, rank: int, window: int) -> list[tuple[int, int, int, int]]:
    """Pieces of a tail as (start in the tail, length, sequence, offset)."""
    if rank < p.used[length]:
        i = int(np.searchsorted(p.firsts[length], rank, "right")) - 1
        nth, slot = divmod(rank - int(p.firsts[length][i]), int(p.times[length][i]))
        return [(0, length, int(p.sequences[length][i]) + nth, int(p.offsets[length][i]) + slot * length)]
    out = []
    at = int(p.left_at[length]) + (rank - int(p.used[length])) * length
    whole = p.left_total // window * window
    start = 0
    while start < length:
        here = at + start
        if here < whole:
            sequence, offset, room = here // window, here % window, window - here % window
        else:
            # The last, partial window: sequences of powers of two, largest first.
            sequence, base, rest = whole // window, whole, p.left_total - whole
            size = 1 << (rest.bit_length() - 1)
            while here >= base + size:
                base += size
                rest -= size
                sequence += 1
                size = 1 << (rest.bit_length() - 1)
            offset, room = here - base, base + size - here
        n = min(room, length - start)
        out.append((start, n, p.n_sequences + sequence, offset))
        start += n
    return out


def tokenize(docs: DataFrame, path: str, ranks: str | None, key: str, text: str, window: int) -> DataFrame:
    """Written once: key, task, doc_tokens, full windows' checksums and first number, tail's length, rank in its task, and ids."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    kind = rows.schema["key"].dataType
    schema = pa.schema([("key", to_arrow_type(kind)), ("task", pa.int32()), ("doc_tokens", pa.int64()), ("full", pa.list_(pa.int64())), ("first", pa.int64()), ("tail", pa.int32()), ("rank", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encode = ids_of(path, ranks)
        ranks_here = [0] * window
        windows = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out: list[list] = [[] for _ in range(7)]
                for value in batch.column(1).to_pylist():
                    ids = np.array([*encode(value or ""), END_ID], "<u4")
                    n = len(ids)
                    full, tail = divmod(n, window)
                    row = (task, n, [zlib.crc32(ids[i * window : (i + 1) * window].tobytes()) for i in range(full)], windows, tail, ranks_here[tail], ids[full * window :].tobytes())
                    ranks_here[tail] += 1
                    windows += full
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                yield pa.record_batch([batch.column(0), *(pa.array(c, f.type) for c, f in zip(out, list(schema)[1:], strict=True))], schema=schema)

    ddl = f"key {kind.simpleString()}, task int, doc_tokens bigint, full array<bigint>, first bigint, tail int, rank bigint, ids binary"
    return materialize(rows.mapInArrow(run, ddl), "packing")


def pack(docs: DataFrame, path: str, ranks: str | None = None, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    path: a tokenizers file; ranks: the same vocabulary as ranks, for speed.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    held = tokenize(docs, path, ranks, key, text, window)
    kind = held.schema["key"].dataType
    counts = held.groupBy("task", "tail").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("full")).alias("windows"))
    counts = materialize(counts, "packing-counts")
    histogram = np.zeros(window, np.int64)
    windows = 0
    for row in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.sum("windows").alias("windows")).collect():  # at most `window` rows
        histogram[row["tail"]] = row["n"]
        windows += row["windows"]
    shared = spark.sparkContext.broadcast(tuple(vars(plan(histogram, window)).values()))  # plain values
    # What earlier tasks hold: by task, the full windows and one array of `window` counters.
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("task", "tail", F.sum("n").over(before.partitionBy("tail")).alias("n"))
    ranks = ranks.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("tail", "n"))).alias("ranks"))
    by_task = counts.groupBy("task").agg(F.sum("windows").alias("windows"))
    by_task = by_task.select("task", F.coalesce(F.sum("windows").over(before), F.lit(0)).alias("windows")).join(ranks, "task")
    by_task = materialize(by_task, "packing-tasks")
    based = held.join(by_task, "task").select(
        "key", "doc_tokens", "full", (F.col("first") + F.col("windows")).alias("first"), "tail", (F.col("rank") + F.coalesce(F.col("ranks")[F.col("tail")], F.lit(0))).alias("rank"), "ids"
    )
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([("key", to_arrow_type(kind)), *((n, pa.int64()) for n in names[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Plan(*shared.value)
        for batch in batches:
            out: list[tuple] = []
            for doc, total, full, first, tail, rank, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i, crc in enumerate(full):
                    out.append((doc, i * window, window, crc, total, first + i, 0))
                base = len(full) * window
                for start, n, sequence, offset in places(p, tail, rank, window) if tail else ():
                    out.append((doc, base + start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), total, windows + sequence, offset))
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    ddl = ", ".join([f"key {kind.simpleString()}", *(f"`{n}` bigint" for n in names[1:])])
    return based.mapInArrow(run, ddl).withColumnRenamed("key", key)
