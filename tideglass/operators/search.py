"""Vector and keyword search, fusion, reranking, chunking and semantic dedup."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.functions.sqlop import Op
from tideglass.sources.rules import match_keywords

# Keyword scores count a document's hits of a query's words; ranks feed the fusion.
_KEYWORD = "kw AS (SELECT doc_id, (length(lower(text)) - length(replace(lower(text), :word, ''))) / length(:word) AS hits FROM {documents} WHERE contains(lower(text), :word)), kr AS (SELECT doc_id, row_number() OVER (ORDER BY hits DESC, doc_id) AS rank FROM kw)"

OPS = {
    "g04_keyword_search": Op("Documents by a word with reciprocal-rank scores.", f"WITH {_KEYWORD} SELECT doc_id, round(1.0 / rank, 6) AS score FROM kr WHERE rank <= :top", word="tion", top=50),
    "g05_rank_fusion": Op(
        "Weighted reciprocal-rank fusion of a keyword list and a length list, best rank of each id in each list.",
        f"WITH {_KEYWORD}, lr AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM {{documents}}), u AS (SELECT doc_id, CAST(0.4 AS DOUBLE) / (60 + rank) AS s FROM kr WHERE rank <= 100 UNION ALL SELECT doc_id, CAST(0.6 AS DOUBLE) / (60 + rank) FROM lr WHERE rank <= 100), f AS (SELECT doc_id, round(sum(s), 9) AS score FROM u GROUP BY doc_id) SELECT doc_id, score FROM f ORDER BY score DESC, doc_id LIMIT :top",
        word="tion",
        top=50,
    ),
    "g06_context": Op("Up to five neighbours of each technique over two kinds of edge, revoked ones left out.", "SELECT technique, kind, other FROM (SELECT u.technique, kind, other, row_number() OVER (PARTITION BY u.technique ORDER BY kind, other) AS rn FROM (SELECT technique, 'detects' AS kind, strategy AS other FROM {detects} UNION ALL SELECT technique, 'mitigates', mitigation FROM {mitigates}) AS u JOIN {techniques} AS t ON u.technique = t.technique WHERE NOT coalesce(t.revoked, FALSE)) AS r WHERE rn <= :top", top=5),
    "g07_filtered_search": Op("Hits above a score in a phase; the two best of all if none is.", f"WITH {_KEYWORD}, s AS (SELECT kr.doc_id, d.lang, 1.0 / rank AS score, rank FROM kr JOIN {{documents}} AS d ON kr.doc_id = d.doc_id), hit AS (SELECT * FROM s WHERE score >= :least AND lang = :phase), n AS (SELECT count(*) AS n FROM hit) SELECT doc_id, round(score, 6) AS score FROM hit UNION ALL SELECT doc_id, round(score, 6) FROM s CROSS JOIN n WHERE n.n = 0 AND rank <= 2", word="tion", least=0.1, phase="en"),
    "g08_context_rerank": Op("Scores (technique, family, is_sub, score) raised for sub-techniques of found parents and for usual companions.", "SELECT technique, round(score * (CASE WHEN is_sub AND family IN :found THEN 1.3 ELSE 1.0 END) * (CASE WHEN family IN :related THEN 1.2 ELSE 1.0 END), 6) AS score FROM {scored_hits}", found=["Brand#11", "Brand#13"], related=["Brand#12", "Brand#4"]).against(
        "SELECT technique, round(score * list_product([1.0::DOUBLE, CASE WHEN is_sub AND list_contains(['Brand#11', 'Brand#13'], family) THEN 1.3 END, CASE WHEN list_contains(['Brand#12', 'Brand#4'], family) THEN 1.2 END]), 6) AS score FROM {scored_hits}"
    ),
    "g09_missing_phases": Op(
        "Phases that an episode of two phases or more lacks: initial access always, persistence after execution, exfiltration after collection, command and control from four phases; with the lowest techniques of each.",
        """WITH c AS (SELECT episode, collect_set(k.tactic) AS phases FROM {et} AS e JOIN {kill_chain} AS k ON e.technique = k.technique GROUP BY episode),
        g AS (SELECT episode, explode(filter(array(CASE WHEN NOT array_contains(phases, 'initial-access') THEN 'initial-access' END, CASE WHEN array_contains(phases, 'execution') AND NOT array_contains(phases, 'persistence') THEN 'persistence' END, CASE WHEN array_contains(phases, 'collection') AND NOT array_contains(phases, 'exfiltration') THEN 'exfiltration' END, CASE WHEN size(phases) > 3 AND NOT array_contains(phases, 'command-and-control') THEN 'command-and-control' END), p -> p IS NOT NULL)) AS phase FROM c WHERE size(phases) >= 2),
        best AS (SELECT technique, tactic, row_number() OVER (PARTITION BY tactic ORDER BY technique) AS rn FROM {kill_chain})
        SELECT g.episode, g.phase, b.technique AS suggestion FROM g LEFT JOIN best AS b ON g.phase = b.tactic AND b.rn <= :top""",
        top=3,
    ).against("""WITH p AS (SELECT DISTINCT episode, tactic FROM {et} JOIN {kill_chain} USING (technique)), n AS (SELECT episode, count(*) AS k FROM p GROUP BY episode HAVING count(*) > 1),
        rules(has, least, lacks) AS (VALUES (NULL, 2, 'initial-access'), ('execution', 2, 'persistence'), ('collection', 2, 'exfiltration'), (NULL, 4, 'command-and-control')),
        g AS (SELECT n.episode, lacks AS phase FROM n, rules AS r WHERE k >= least AND (has IS NULL OR (n.episode, has) IN (SELECT (episode, tactic) FROM p)) AND (n.episode, lacks) NOT IN (SELECT (episode, tactic) FROM p))
        SELECT episode, phase, b.technique AS suggestion FROM g LEFT JOIN (SELECT * FROM {kill_chain} QUALIFY row_number() OVER (PARTITION BY tactic ORDER BY technique) <= :top) AS b ON b.tactic = phase"""),
}


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def knn(vectors: DataFrame, every: int = 50, top: int = 10, label_filter: bool = False, block: int = 4096) -> DataFrame:
    """Exact cosine neighbours of the vectors whose id is a multiple of `every`: query, neighbour, rank, score.

    Queries are sent out in blocks of about `block`; every batch of the table multiplies itself with a block and keeps
    its best `top` of each query; those meet by query. With label_filter a fetch of three times as many is filtered to
    the query's label, so fewer may be left.
    """
    from pyspark.sql import Window

    spark = vectors.sparkSession
    fetch = max(3 * top, 30) if label_filter else top
    rows = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("bigint").alias("label"))
    queries = rows.where(F.col("id") % every == 0)
    n_blocks = queries.count() // block + 1

    def neighbours(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, labels, qs = shared.value
            for batch in batches:
                own, own_labels = (np.array(batch.column(i).to_pylist(), np.int64) for i in (0, 2))
                score = np.round(qs @ unit(np.array(batch.column(1).to_pylist(), float).reshape(len(own), -1)).T, 6) if len(own) and len(ids) else np.zeros((0, 0))
                out: list[tuple] = []
                for i in range(len(score)):
                    for j in np.lexsort((own, -score[i]))[: fetch + 1]:
                        if own[j] != ids[i]:
                            out.append((int(ids[i]), int(labels[i]), int(own[j]), int(own_labels[j]), float(score[i, j])))
                cols = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 4, pa.float64()), strict=True)], names=["query", "ql", "neighbour", "nl", "score"])

        return rows.mapInArrow(run, "query long, ql long, neighbour long, nl long, score double")

    best = None
    for b in range(n_blocks):
        held = queries.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).collect()  # a block
        q = (np.array([r["id"] for r in held], np.int64), np.array([r["label"] for r in held], np.int64), unit(np.array([r["v"] for r in held], float).reshape(len(held), -1)))
        part = neighbours(spark.sparkContext.broadcast(q))
        best = part if best is None else best.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "neighbour"))
    fetched = best.withColumn("rank", rank).where(F.col("rank") <= fetch)
    if label_filter:
        fetched = fetched.where("ql = nl").withColumn("rank", rank).where(F.col("rank") <= top)
    return fetched.select("query", "neighbour", F.col("rank").cast("bigint").alias("rank"), "score")


SAMPLE = 20_000
MOST_CELLS = 4096
BLOCK = 4096
SHARE = 20_000


def fit_cells(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = 8) -> np.ndarray:
    """Centres of cells by spherical k-means over at most `sample` vectors (id, v), chosen by hash; the only bounded
    part of the index, which then holds every row."""
    total = vectors.count()
    spin = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30))
    rows = vectors.where(spin < F.lit(int(min(1.0, 0.9 * sample / max(1, total)) * (1 << 30)) + 1)).select("id", "v").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    points = unit(np.array([r["v"] for r in sorted(rows, key=lambda r: r["id"])], float))
    centres = points[np.linspace(0, len(points) - 1, min(cells, len(points))).astype(int)]
    for _ in range(rounds):
        own = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres = np.where((np.abs(sums).sum(axis=1) > 0)[:, None], unit(sums), centres)
    return centres


def knn_indexed(vectors: DataFrame, every: int = 50, top: int = 10, cells: int | None = None, probes: int | None = None) -> DataFrame:
    """Cosine neighbours by an inverted file: query, neighbour, rank, score, of the vectors whose id is a multiple of
    `every`. Every row is in the cell of its nearest centre; a query looks into the `probes` cells nearest to it, three
    quarters of all by default: vectors without clusters need that many, others fewer.

    Scores are exact, but a neighbour in another cell is missed; tests hold recall to 0.9. A cell's rows are dealt out
    in shares and its queries in blocks, so neither gathers in one task, and each pair of a share and a block keeps the
    best `top` of each query.
    """
    from pyspark.sql import Window

    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    n_cells = cells or max(1, min(MOST_CELLS, int(rows.count() ** 0.5)))
    shared = spark.sparkContext.broadcast(fit_cells(rows, n_cells))  # at most MOST_CELLS centres
    look = probes or -(-3 * n_cells // 4)

    def placed(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = shared.value
            for batch in (b for b in batches if b.num_rows):
                v = unit(np.array(batch.column(1).to_pylist(), float))
                near = np.argsort(-(v @ centres.T), axis=1, kind="stable")[:, :n]
                at = np.repeat(np.arange(len(v)), near.shape[1])
                yield pa.record_batch([pa.array(near.ravel().astype(np.int64)), batch.column(0).take(pa.array(at)), pa.array(v[at].tolist(), pa.list_(pa.float64()))], names=["cell", "id", "v"])

        return run

    schema = "cell long, id long, v array<double>"
    members = rows.mapInArrow(placed(1), schema)
    queries = rows.where(F.col("id") % every == 0).mapInArrow(placed(look), schema)
    sizes = members.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
    sizes = sizes.join(queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "cell")  # a row for each cell
    deal = lambda t, own, n, each, m: t.join(F.broadcast(sizes), "cell").withColumn(own, F.pmod(F.xxhash64("id"), F.col(n)).cast("int")).withColumn(each, F.explode(F.sequence(F.lit(0), F.col(m) - 1)))
    both = deal(members, "share", "shares", "block", "blocks").select("cell", "share", "block", F.lit(1).alias("member"), "id", "v")
    both = both.unionByName(deal(queries, "block", "blocks", "share", "shares").select("cell", "share", "block", F.lit(0).alias("member"), "id", "v"))
    met = both.repartition("cell", "share", "block").sortWithinPartitions("cell", "share", "block", "member", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, held = None, [], []

        def best() -> pa.RecordBatch:
            out: list[tuple[int, int, float]] = []
            if asked and held:
                own = np.array([i for i, _ in held])
                score = np.round(np.array([v for _, v in asked]) @ np.array([v for _, v in held]).T, 6)
                for (q, _), line in zip(asked, score, strict=True):
                    out += [(q, int(own[j]), float(line[j])) for j in np.lexsort((own, -line))[: top + 1] if own[j] != q][:top]
            cols = list(zip(*out, strict=True)) or [[]] * 3
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query", "neighbour", "score"])

        for batch in batches:
            for cell, share, block, member, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cell, share, block) != key:
                    yield best()
                    key, asked, held = (cell, share, block), [], []
                (held if member else asked).append((i, v))
                if len(held) >= 2048:
                    yield best()
                    held = []
        yield best()

    found = met.mapInArrow(run, "query long, neighbour long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "neighbour"))
    return found.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= top).select("query", "neighbour", "rank", "score")


def sentence_ends(text: str) -> list[int]:
    """Where sentences end: after a full stop, question or exclamation mark and white space; not after abbreviations."""
    return [m.end() for m in re.finditer(r"(?<!\b[A-Z])(?<!\be\.g)(?<!\bi\.e)(?<!\betc)[.!?]\s+", text)]


def chunk(docs: DataFrame, target: int = 1200, overlap: int = 150) -> DataFrame:
    """Chunks of about `target` characters that overlap, cut at the last sentence end in their last fifth: doc_id, chunk_no, start, stop, text."""

    def cut(text: str) -> Iterator[tuple[int, int]]:
        ends, start = sentence_ends(text), 0
        while start < len(text):
            stop = min(start + target, len(text))
            if stop < len(text):
                fit = [e for e in ends if start + target * 4 // 5 < e <= stop]
                stop = fit[-1] if fit else stop
            yield start, stop
            if stop == len(text):
                return
            start = max(stop - overlap, start + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, i, a, b, t[a:b]) for d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i, (a, b) in enumerate(cut(t or ""))]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "chunk_no", "start", "stop", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, chunk_no long, start long, stop long, text string")


def merge_chunks(chunks: DataFrame, most: int = 2000) -> DataFrame:
    """Neighbouring chunks of a document merged while they fit: doc_id, chunk_no, text."""

    def fold(acc, x):
        fits = (F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + F.length(x) + 2 <= most)
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit("\n\n"), x)))).otherwise(F.concat(acc, F.array(x)))

    ordered = chunks.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))), lambda s: s["text"]).alias("texts"))
    merged = ordered.select("doc_id", F.aggregate("texts", F.array().cast("array<string>"), fold).alias("texts"))
    return merged.select("doc_id", F.posexplode("texts").alias("chunk_no", "text")).select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "text")


def embed(rows: DataFrame, encode: Callable[[list[str]], np.ndarray], text: str = "text", batch: int = 256) -> DataFrame:
    """rows with a column embedding: what a model makes of each text, in batches; null for blank or null texts. encode is
    sent to the workers, which call it with up to `batch` texts."""
    names = rows.columns
    from pyspark.sql.types import ArrayType, FloatType, StructType

    schema = StructType([f for f in rows.schema.fields if f.name != "embedding"]).add("embedding", ArrayType(FloatType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                texts = part.column(part.num_columns - 1).to_pylist()
                live = [i for i, t in enumerate(texts) if t and t.strip()]
                out: list = [None] * len(texts)
                for i, v in zip(live, encode([texts[i] for i in live]) if live else [], strict=True):
                    out[i] = np.asarray(v, np.float32).tolist()
                yield pa.record_batch([*part.columns[:-1], pa.array(out, pa.list_(pa.float32()))], names=[f.name for f in schema])

    return rows.select(*[rows[c] for c in names if c != "embedding"], rows[text].cast("string").alias("_body")).mapInArrow(run, schema)


def hashed_encoder(dimensions: int = 64) -> Callable[[list[str]], np.ndarray]:
    """An encoder without a model: counts of lower-cased words by hash, of unit length."""

    def encode(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dimensions), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                out[i, zlib.crc32(w.encode()) % dimensions] += 1
        return unit(out)

    return encode


def extract_chunked(docs: DataFrame, find: Callable[[DataFrame], DataFrame], target: int = 4000, overlap: int = 150) -> DataFrame:
    """Techniques of whole texts by chunks: each text is cut into overlapping chunks of about `target` characters, as
    many as it takes; find gives claims (chunk, technique, confidence) for a table (chunk, text); claims are put back on
    their documents and merged: doc_id, technique, confidence (the highest, two more for each further chunk, at most
    100), n_chunks, first_chunk. What asks a language model does so in find."""
    pieces = chunk(docs, target, overlap).select("doc_id", "chunk_no", F.concat_ws(":", "doc_id", "chunk_no").alias("chunk"), "text")
    claims = find(pieces.select("chunk", "text")).join(pieces.select("chunk", "doc_id", "chunk_no"), "chunk")
    one = claims.groupBy("doc_id", "technique", "chunk_no").agg(F.max("confidence").alias("confidence"))
    merged = one.groupBy("doc_id", "technique").agg(F.max("confidence").alias("best"), F.count(F.lit(1)).alias("n_chunks"), F.min("chunk_no").alias("first_chunk"))
    return merged.select("doc_id", "technique", F.least(F.lit(100).cast("double"), F.col("best") + 2 * (F.col("n_chunks") - 1)).alias("confidence"), "n_chunks", "first_chunk")


def _by_keywords(docs: DataFrame, index: DataFrame) -> DataFrame:
    def find(pieces: DataFrame) -> DataFrame:
        return match_keywords(pieces.withColumnRenamed("chunk", "doc_id"), index).select(F.col("doc_id").alias("chunk"), "technique", F.least(F.lit(90.0), 60.0 + F.length("keyword")).alias("confidence"))

    return extract_chunked(docs, find)


def semantic_dedup(items: DataFrame, threshold: float = 0.95, most: int = 50, family: str | None = None, apart: float = 0.98) -> DataFrame:
    """Within each group of (grp, id, size, v): an item is a duplicate if its cosine with a kept one is above the
    threshold; the larger replaces. With a column `family` (technique ids like T1059.001) a technique is never merged
    with its own parent, and techniques of different families only above `apart`. In groups above `most` items only equal vectors are duplicates, of the least id; those
    groups are never collected."""

    def least(a: str | None, b: str | None) -> float:
        """The cosine that merges two techniques."""
        if a is None or b is None or a == b:
            return threshold
        (top_a, dot_a, _), (top_b, dot_b, _) = a.partition("."), b.partition(".")
        if top_a == top_b:
            return threshold if dot_a and dot_b else 2.0  # a parent and its sub-technique stay apart
        return max(threshold, apart)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for grp, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                members.sort(key=lambda m: m["id"])
                vs = unit(np.array([m["v"] for m in members], float))
                kept: list[int] = []
                owner: dict[int, int] = {}
                for i, m in enumerate(members):
                    near = next((k for k in kept if float(vs[i] @ vs[k]) > least(m["family"], members[k]["family"])), None)
                    if near is None:
                        kept.append(i)
                        owner[i] = i
                    elif m["size"] > members[near]["size"]:
                        kept[kept.index(near)] = i
                        owner = {a: i if b == near else b for a, b in owner.items()} | {i: i}
                    else:
                        owner[i] = near
                out += [(grp, m["id"], members[owner[i]]["id"]) for i, m in enumerate(members)]
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["grp", "id", "keep_id"])

    kin = F.col(family).cast("string") if family else F.lit(None).cast("string")
    items = items.select(F.col("grp").cast("long").alias("grp"), "id", "size", "v", kin.alias("family"))
    sizes = items.groupBy("grp").agg((F.count(F.lit(1)) > most).alias("large")).withColumnRenamed("grp", "g")
    placed = items.join(sizes, F.col("grp").eqNullSafe(F.col("g")))
    small = placed.where(~F.col("large")).groupBy("grp").agg(F.collect_list(F.struct("id", "size", "v", "family")).alias("members"))
    # Equal vectors of different techniques of one family are not merged here, as one may be the other's parent.
    large = placed.where("large").select("grp", "id", "v", F.coalesce("family", F.lit("")).alias("family"))
    first = large.groupBy(F.col("grp").alias("g"), F.col("v").alias("w"), F.col("family").alias("k")).agg(F.min("id").alias("keep_id"))
    equal = large.join(first, F.col("grp").eqNullSafe(F.col("g")) & F.col("v").eqNullSafe(F.col("w")) & (F.col("family") == F.col("k")))
    return small.mapInArrow(run, "grp long, id long, keep_id long").unionByName(equal.select("grp", F.col("id").cast("long").alias("id"), F.col("keep_id").cast("long").alias("keep_id")))


def _cosine(e: DataFrame) -> DataFrame:
    """Cosine of neighbouring vectors by id, 0 where a norm is 0; array functions only."""
    v = e.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norms = F.sqrt(dot("v", "v")) * F.sqrt(dot("w", "w"))
    return both.select("vec_id", F.round(F.coalesce(F.try_divide(dot("v", "w"), norms), F.lit(0.0)), 5).alias("cosine"))


_KNN = "WITH s AS (SELECT q.vec_id AS query, e.vec_id AS neighbour, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score{extra} FROM embeddings AS q JOIN embeddings AS e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) AS rank FROM s) "
FUNCTIONS = {
    "g01_knn": (knn, ["embeddings"], _KNN.replace("{extra}", "") + "SELECT query, neighbour, rank, score FROM r WHERE rank <= 10"),
    "g01_knn_indexed": (knn_indexed, ["embeddings"], None),
    "g02_knn_filtered": (lambda e: knn(e, label_filter=True), ["embeddings"], _KNN.replace("{extra}", ", q.label = e.label AS same") + ", f AS (SELECT query, neighbour, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) AS rank FROM r WHERE rank <= 30 AND same) SELECT * FROM f WHERE rank <= 10"),
    "g10_embedding": (lambda d: embed(d.select("doc_id", "text"), hashed_encoder()).select("doc_id", "embedding"), ["documents"], None),
    "g13_keyword_match": (
        match_keywords,
        ["documents", "keyword_index"],
        "SELECT doc_id, keyword, technique FROM documents AS d JOIN keyword_index AS k ON CASE WHEN contains(keyword, ' ') THEN contains(lower(text), keyword) AND list_contains(regexp_extract_all(lower(text), '[a-z0-9_.%$#@+\\-]+'), split_part(keyword, ' ', 1)) ELSE list_contains(regexp_extract_all(lower(text), '[a-z0-9_.%$#@+\\-]+'), keyword) END",
    ),
    "m17_chunked_extraction": (_by_keywords, ["documents", "keyword_index"], None),
    "g16_technique_dedup": (
        lambda e: semantic_dedup(e.select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), (F.col("vec_id") % 13).alias("size"), F.col("embedding").alias("v"), F.concat(F.lit("T"), (F.col("vec_id") % 9).cast("string"), F.when(F.col("vec_id") % 4 > 0, F.concat(F.lit("."), (F.col("vec_id") % 4).cast("string"))).otherwise("")).alias("kin")), 0.3, family="kin", apart=0.4),
        ["embeddings"],
        None,
    ),
    "g11_chunks": (chunk, ["documents"], None),
    "g12_merged_chunks": (lambda d: merge_chunks(chunk(d)), ["documents"], None),
    "g14_semantic_dedup": (lambda e: semantic_dedup(e.select((F.col("label") * 10 + F.col("vec_id") % 10).alias("grp"), F.col("vec_id").alias("id"), (F.col("vec_id") % 13).alias("size"), F.col("embedding").alias("v")), 0.3), ["embeddings"], None),
    "g17_cosine": (_cosine, ["embeddings"], "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings AS a JOIN embeddings AS b ON b.vec_id = a.vec_id + 1"),
}
