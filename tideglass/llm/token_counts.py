"""Token counts of a sentencepiece BPE model, without ever materialising ids.

The model writes a space as U+2581 and puts one in front of a text. None of its pieces holds that mark after another
character, so no merge crosses the step from a word to the next mark: a text falls into pre-tokens, each a run of marks
and the word after it, whose counts add up to the text's. Every distinct pre-token is counted once.

Frequent pre-tokens (at most `head` of them, a fixed bound) are counted first and sent to all workers; each text sums
them where it is read. The other pre-tokens go, with their frequencies in each document, to one place per pre-token,
where each is counted once and its counts are added up by document.

Null text counts as empty (0 tokens, 0 bytes). Each row of the input gives one row, repeated rows too; other columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.frequent import most_frequent
from tideglass.llm.store import materialize, release, width
from tideglass.llm.worker import kept

MARK = "▁"
HEAD = 400_000
FLUSH = 400_000
_RUNS = re.compile(" +[^ ]+| +$")


class Pieces:
    """Counts pieces of pre-tokens; a pre-token is held without its first mark, which the model puts back."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.vocab_size()
        inner = [p for p in map(self.model.id_to_piece, range(size)) if MARK in p.lstrip(MARK)]
        if inner or self.model.encode("a  b", out_type=str) == self.model.encode("a b", out_type=str) or self.model.encode("ﬁ a", out_type=str) == self.model.encode("fi a", out_type=str):
            raise ValueError("this model merges across words or rewrites its input; pre-tokens can't be counted apart")

    def count(self, pretokens: list[str]) -> list[int]:
        return [len(ids) if p else 1 for p, ids in zip(pretokens, self.model.encode(pretokens, num_threads=1), strict=True)]


def pieces(path: str) -> Pieces:
    return kept(f"pieces:{path}", lambda: Pieces(path))


def pretokens(text: str | None) -> list[str]:
    """Pre-tokens in order, each without its first mark; a lone mark is ''."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [x[1:] for x in _RUNS.findall(" " + text)]


def _arrow(cols: list[tuple[list, pa.DataType]], names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in cols], names=names)


def frequent(docs: DataFrame, model: str, head: int = HEAD) -> dict[str, int]:
    """Piece counts of at most `head` pre-tokens, the most frequent ones; each is counted once, on an executor."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            twice = [(p, n) for p, n in found.items() if n > 1]
            found.clear()
            return _arrow([([p for p, _ in twice], pa.string()), ([n for _, n in twice], pa.int64())], ["pretoken", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(pretokens(text))
                if len(found) > FLUSH:
                    yield out()
        yield out()

    seen = materialize(docs.select("text").mapInArrow(local, "pretoken string, n bigint").groupBy("pretoken").agg(F.sum("n").alias("n")), "pretokens")
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(pieces(model).count(batch.column(0).to_pylist()), pa.int32())], names=["pretoken", "pieces"])

    best = most_frequent(seen, "pretoken", head).select("pretoken").mapInArrow(counted, "pretoken string, pieces int").toArrow()
    release(seen)
    return dict(zip(best.column(0).to_pylist(), best.column(1).to_pylist(), strict=True))


def count_tokens(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", limit: int = 4096, head: int = HEAD) -> DataFrame:
    """One row per row of docs: key, n_bytes, n_tokens, over_limit."""
    spark = docs.sparkSession
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    known = spark.sparkContext.broadcast(frequent(rows, model, head))
    kind = rows.schema["key"].dataType

    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("key", to_arrow_type(kind)), ("row", pa.int64()), ("n_bytes", pa.int64()), ("n", pa.int64()), ("rare", pa.list_(pa.string())), ("times", pa.list_(pa.int32()))])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        head_of = known.value.get
        row = TaskContext.get().partitionId() << 36
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                cols: list[list] = [[], [], [], [], []]
                for value in batch.column(1).to_pylist():
                    total, rare = 0, Counter()
                    for p in pretokens(value):
                        n = head_of(p)
                        if n is None:
                            rare[p] += 1
                        else:
                            total += n
                    for c, v in zip(cols, (row, len((value or "").encode("utf-8", "surrogatepass")), total, list(rare), list(rare.values())), strict=True):
                        c.append(v)
                    row += 1
                yield pa.record_batch([batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True))], schema=schema)

    held = materialize(rows.mapInArrow(split, f"key {kind.simpleString()}, row bigint, n_bytes bigint, n bigint, rare array<string>, times array<int>"), "token-counts")
    rare = (
        held.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
        .select(F.col("x.rare").alias("pretoken"), "row", F.col("x.times").alias("times"))
        .repartition(width(spark), "pretoken")
        .sortWithinPartitions("pretoken")
    )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pre-tokens arrive in order, so each is counted when it first appears; sums are kept by document."""
        last, n = None, 0
        sums: dict[int, int] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            fresh = [p for i, p in enumerate(names) if p != (names[i - 1] if i else last)]
            counts = iter(pieces(model).count(fresh))
            for p, row, times in zip(names, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if p != last:
                    last, n = p, next(counts)
                sums[row] = sums.get(row, 0) + n * times
            if len(sums) > FLUSH:
                yield _arrow([(list(sums), pa.int64()), (list(sums.values()), pa.int64())], ["row", "n"])
                sums = {}
        yield _arrow([(list(sums), pa.int64()), (list(sums.values()), pa.int64())], ["row", "n"])

    tail = rare.mapInArrow(summed, "row bigint, n bigint")
    total = held.select("row", "n", "key", "n_bytes").unionByName(tail, allowMissingColumns=True).groupBy("row").agg(F.sum("n").alias("n_tokens"), F.max("key").alias("key"), F.max("n_bytes").alias("n_bytes"))
    return total.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
