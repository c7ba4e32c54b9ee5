"""Long texts cut at word boundaries, so that no task works through one of them alone."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.store import width

#: Texts of more bytes are cut.
LONG = 65_536
#: Words whose starts a chunk owns.
OWN = 4_096


def pieces(docs: DataFrame, key: str, text: str, word: str, carry: int = 0, long: int = LONG, own: int = OWN) -> DataFrame:
    """Texts of docs in pieces: key, row, own, text.

    A text of at most `long` bytes is one piece with null row and own. A longer one is cut into chunks, each of which
    owns the starts of `own` words (matches of the pattern `word`; the last chunk owns what is left) and carries the
    `carry` words after them, so that every run of up to carry + 1 words lies whole in the chunk that owns its start.
    Chunks of one row share `row` and are dealt over all tasks. Null text is one piece of null text; repeated keys are
    rows of their own.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    kind = rows.schema["key"].dataType
    schema = pa.schema([("key", to_arrow_type(kind)), ("row", pa.int64()), ("part", pa.int32()), ("own", pa.int32()), ("text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, find = TaskContext.get().partitionId() << 36, re.compile(word).finditer
        for batch in batches:
            for i in range(batch.num_rows):
                body, spans, part = batch.column(1)[i].as_py(), [], 0

                def piece(n: int) -> pa.RecordBatch:
                    held = body[spans[0][0] : spans[-1][1]] if spans else ""
                    return pa.record_batch([batch.column(0).slice(i, 1), *(pa.array([v], f.type) for v, f in zip((row, part, n, held), list(schema)[1:], strict=True))], schema=schema)

                for m in find(body):
                    spans.append(m.span())
                    if len(spans) == own + carry:
                        yield piece(own)
                        spans, part = spans[own:], part + 1
                yield piece(len(spans))
                row += 1

    size = F.coalesce(F.octet_length("text"), F.lit(0))
    nothing = [F.lit(None).cast("bigint").alias("row"), F.lit(None).cast("int").alias("own")]
    whole = rows.where(size <= long).select("key", *nothing, "text")
    cuts = rows.where(size > long).mapInArrow(cut, f"key {kind.simpleString()}, row bigint, part int, own int, text string")
    return whole.unionByName(cuts.repartition(width(docs.sparkSession), "row", "part").select("key", "row", "own", "text"))


def words(text: str, pattern: str):
    """Words of a column in order, A-Z (and nothing else) in lower case; none for null."""
    capitals = "".join(map(chr, range(65, 91)))
    low = lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, capitals, capitals.lower()))
    return F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({pattern})"), F.lit(1)), low)
