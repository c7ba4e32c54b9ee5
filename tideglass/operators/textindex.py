"""Weighted full-text search: an inverted index over fields, BM25 by field, best field or all of them.

An index is two Parquet tables: postings (term, field, id, tf, length), sorted by term so that a search's terms prune row
groups, and statistics of each field (documents with text, mean length). Document frequencies are counts of postings, so
a search counts those of its own terms. An index is written once and opened as often as it is searched.

Words are maximal runs of letters and digits in lower case. A null or empty field has no words and doesn't count in its
field's statistics; rows of one id are one document whose fields lie end to end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.functions import scratch
from tideglass.functions.scratch import new_path
from tideglass.operators.matching import match_phrases

WORD = r"[\p{L}\p{N}]+"
#: Query terms that are broadcast; beyond, terms and postings are shuffled to each other.
FEW_TERMS = 200_000


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


@dataclass(frozen=True)
class Index:
    """A written index: its postings and its field statistics."""

    postings: DataFrame
    fields: DataFrame


def _rows(docs: DataFrame, fields: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """id, field, ws (words) of ids that one row has, and of ids that several have; only these need be brought together."""
    several = scratch.written(docs.groupBy(docs[key].alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "repeated-ids")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), terms(docs[f]).alias("ws")) for f in fields])).alias("x")
    rows = docs.select(docs[key].alias("id"), each).select("id", "x.field", "x.ws")
    if not several.limit(1).count():
        return rows, rows.where("false")
    return rows.join(several, "id", "left_anti"), rows.join(several, "id", "left_semi")


def postings(once: DataFrame, again: DataFrame) -> DataFrame:
    """term, field, id, tf, length (words of the document's field). Words are counted where their document is."""
    words = _counted(again)
    tf = words.groupBy("term", "field", "id").agg(F.sum("tf").alias("tf"))
    length = words.groupBy("field", "id").agg(F.sum("tf").alias("length"))
    return _counted(once).unionByName(tf.join(length, ["field", "id"]))


def _counted(rows: DataFrame) -> DataFrame:
    """term, field, id, tf, length of each row."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out, tf, length = [], [], [], []
            for i, words in enumerate(batch.column(2).to_pylist()):
                counts = Counter(words)
                at += [i] * len(counts)
                out += counts
                tf += counts.values()
                length += [len(words)] * len(counts)
            where = pa.array(at, pa.int64())
            columns = [pa.array(out, pa.string()), batch.column(1).take(where), batch.column(0).take(where), pa.array(tf, pa.int64()), pa.array(length, pa.int64())]
            yield pa.record_batch(columns, names=["term", "field", "id", "tf", "length"])

    return rows.mapInArrow(run, f"term string, field string, id {kind}, tf long, length long")


def write_index(docs: DataFrame, fields: list[str], path: str, key: str = "report_id", files: int | None = None) -> Index:
    """Write the index of docs to a folder and open it. Ids that are null name no document and are left out."""
    once, again = _rows(docs.where(docs[key].isNotNull()), fields, key)
    held = postings(once, again)
    spark = docs.sparkSession
    # Dealt by ranges of terms (and ids, as one term may have most postings), so each file covers few terms.
    dealt = held.repartitionByRange(files, "term", "id") if files else held.repartitionByRange("term", "id")
    dealt.sortWithinPartitions("term", "field", "id").write.option("compression", "zstd").mode("overwrite").parquet(f"{path}/postings")
    sizes = once.select("field", F.size("ws").cast("long").alias("length")).unionByName(again.groupBy("field", "id").agg(F.sum(F.size("ws")).alias("length")).select("field", "length"))
    sizes.where("length > 0").groupBy("field").agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean")).write.mode("overwrite").parquet(f"{path}/fields")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/fields"))


def search(index: Index, queries: DataFrame, boosts: dict[str, float], top: int = 10, k1: float = 1.2, b: float = 0.75, others: float = 0.0) -> DataFrame:
    """The `top` documents of each query (query_id, text): query_id, id, rank, score, field (the best one).

    A field's score is its boost times the sum of the BM25 scores of the query's words (a repeated word counts as often
    as it is repeated); a document's is that of its best field, plus `others` times the scores of its other fields. Ties
    go to the smaller id. Queries without a known word have no rows; of rows of one query_id the words are taken together.
    """
    spark = queries.sparkSession
    asked = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    weights = spark.createDataFrame([(f, float(v)) for f, v in boosts.items()], "field string, boost double")
    fields = index.fields.join(weights, "field")  # a row a field
    known = asked.select("term").distinct()
    few = known.limit(FEW_TERMS + 1).count() <= FEW_TERMS
    # Postings of asked terms only; then as many rows as queries and postings share.
    met = index.postings.join(F.broadcast(known) if few else known, "term", "left_semi")
    df = met.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"))
    wanted = asked.join(df, "term").join(F.broadcast(fields), "field")
    hit = index.postings.join(F.broadcast(wanted) if few else wanted, ["term", "field"])
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    by_field = hit.groupBy("query_id", "id", "field").agg((F.max("boost") * F.sum(part)).alias("s"))
    best = F.max_by("field", F.struct(F.round("s", 9), "field"))
    doc = by_field.groupBy("query_id", "id").agg(F.max("s").alias("m"), F.sum("s").alias("all"), best.alias("field"))
    scored = doc.select("query_id", "id", "field", F.round(F.col("m") + others * (F.col("all") - F.col("m")), 6).alias("score"))
    # A rank limit within a window keeps `top` rows of each task before the shuffle.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= top).select("query_id", "id", "rank", "score", "field")


def _reports(reports: DataFrame, queries: DataFrame) -> DataFrame:
    index = write_index(reports, ["name", "description", "techniques"], new_path(reports.sparkSession, "text-index"))
    return search(index, queries, {"name": 3.0, "description": 2.0, "techniques": 1.0})


def graph_search(techniques: DataFrame, entities: DataFrame, queries: DataFrame, top: int = 10, words: int = 5, long: int = 3) -> DataFrame:
    """Techniques and entities whose names hold a query or its words: query_id, kind, id, rank, score.

    A technique (id, name, description) is found if its name or description holds the whole query, or its name one of the
    query's first `words` words of more than `long` characters; scores are 1 / rank, by number of those words and name.
    An entity (id, name, n) is found if its name holds the whole query; scores are 0.8 / rank, by n. Ranks restart.
    All names are read once for all queries (`matching`).
    """
    q = queries.select("query_id", F.lower(F.trim("text")).alias("whole")).where("whole <> ''")
    first = F.slice(F.filter(F.split("whole", r"\s+"), lambda w: F.length(w) > long), 1, words)
    keys = q.select("query_id", F.explode(F.array_union(F.array("whole"), first)).alias("phrase"), "whole")
    keys = keys.groupBy("query_id", "phrase").agg(F.max(F.col("phrase") == F.col("whole")).alias("is_whole"))
    phrases = keys.select("phrase").distinct()
    in_names = match_phrases(techniques, phrases, "id", "name").select("id", "phrase", F.lit(True).alias("in_name"))
    in_texts = match_phrases(techniques, phrases, "id", "description").select("id", "phrase", F.lit(False).alias("in_name"))
    met = in_names.unionByName(in_texts).join(keys, "phrase").where("in_name OR is_whole")
    found = met.groupBy("query_id", "id").agg(F.sum(F.when(F.col("in_name"), 1).otherwise(0)).alias("n"))
    named = found.join(techniques.select("id", "name"), "id")
    rank = lambda *order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("bigint")
    one = named.withColumn("rank", rank(F.desc("n"), "name", "id")).where(F.col("rank") <= top).select("query_id", F.lit("technique").alias("kind"), "id", "rank", F.round(1.0 / F.col("rank"), 6).alias("score"))
    held = match_phrases(entities, phrases, "id", "name").join(keys.where("is_whole"), "phrase").select("query_id", "id").distinct()
    counted = held.join(entities.select("id", "name", "n"), "id")
    two = counted.withColumn("rank", rank(F.desc("n"), "name", "id")).where(F.col("rank") <= top).select("query_id", F.lit("entity").alias("kind"), "id", "rank", F.round(0.8 / F.col("rank"), 6).alias("score"))
    return one.unionByName(two)


FUNCTIONS = {
    "l21_report_search": (
        _reports,
        ["report_fields", "search_queries"],
        r"""WITH f AS (SELECT report_id AS id, field, unnest(regexp_extract_all(lower(body), '[\p{L}\p{N}]+')) AS term FROM (SELECT report_id, 'name' AS field, name AS body FROM report_fields UNION ALL SELECT report_id, 'description', description FROM report_fields UNION ALL SELECT report_id, 'techniques', techniques FROM report_fields)),
        l AS (SELECT field, id, count(*) AS len FROM f GROUP BY field, id), m AS (SELECT field, count(*) AS docs, avg(len) AS mean FROM l GROUP BY field), t AS (SELECT term, field, id, count(*) AS tf FROM f GROUP BY term, field, id), d AS (SELECT term, field, count(*) AS df FROM t GROUP BY term, field),
        q AS (SELECT query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM search_queries), b(field, boost) AS (VALUES ('name', 3.0::DOUBLE), ('description', 2.0), ('techniques', 1.0)),
        s AS (SELECT query_id, id, field, boost * sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))) AS s FROM q JOIN t USING (term) JOIN d USING (term, field) JOIN l USING (field, id) JOIN m USING (field) JOIN b USING (field) GROUP BY query_id, id, field, boost),
        r AS (SELECT query_id, id, round(max(s), 6) AS score, arg_max(field, (round(s, 9), field)) AS field FROM s GROUP BY query_id, id)
        SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, score, field FROM r QUALIFY rank <= 10""",
    ),
    "g04_graph_search": (
        graph_search,
        ["named_techniques", "named_entities", "name_queries"],
        r"""WITH q AS (SELECT query_id, lower(trim(text)) AS whole FROM name_queries WHERE trim(text) <> ''), k AS (SELECT query_id, whole, list_filter(regexp_split_to_array(whole, '\s+'), lambda w: length(w) > 3)[:5] AS ws FROM q),
        u AS (SELECT DISTINCT query_id, unnest(list_append(ws, whole)) AS phrase, whole FROM k),
        h AS (SELECT query_id, id, name, count(*) FILTER (strpos(lower(name), phrase) > 0) AS n, count(*) FILTER (phrase = whole AND strpos(lower(description), phrase) > 0) AS d FROM u JOIN named_techniques ON strpos(lower(name), phrase) > 0 OR phrase = whole AND strpos(lower(description), phrase) > 0 GROUP BY query_id, id, name),
        e AS (SELECT query_id, id, name, n FROM q JOIN named_entities ON strpos(lower(name), whole) > 0)
        SELECT * FROM (SELECT query_id, 'technique' AS kind, id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, name, id) AS rank, round(1.0::DOUBLE / rank, 6) AS score FROM h QUALIFY rank <= 10) UNION ALL
        SELECT * FROM (SELECT query_id, 'entity', id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, name, id) AS rank, round(0.8::DOUBLE / rank, 6) FROM e QUALIFY rank <= 10)""",
    ),
}
