"""Main text of HTML pages: gradient-boosted trees over DOM-node features, decoded over the tree.

Every block of a page (`dom`) gets a probability of being article text from boosted trees over its features: density and
links of its subtree, its element and attribute tokens and those above it, depth, and its siblings. A page is then
decoded as a whole: a block is article throughout, or is none throughout, or is mixed, and only a mixed block lets its
children decide. So no block inside a dropped one is kept, none inside a kept one is dropped, and the labelling with the
highest likelihood under these rules wins; each mixed block costs MIXED.

The trees are Spark's GBTClassifier, fitted on blocks of PAGES composed pages (`samples`), whose sentences come from at
most SENTENCE_PAGES pages of the input, those with the least hashes; both are bounds of the training sample alone.
Pages without any text are learned from made-up words. Extraction reads every page and the whole of it.

Null and empty html give an empty text, as do pages where nothing is article. Rows are treated one by one: repeated
rows and null ids fare like others. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm.dom import GROUP, N_FEATURES, Page, features
from tideglass.llm.samples import MARK, compose
from tideglass.llm.store import materialize, release, width

PAGES = 1500
SENTENCE_PAGES = 300
TREES = 40
DEPTH = 5
#: Cost, in log-likelihood, of a block whose children differ.
MIXED = 2.0
#: Cost, in log-likelihood, of a page without any article.
NONE = 4.0
#: Log-odds of one block are held within this.
SURE = 6.0
#: Rows of features that are scored at once.
BATCH = 20_000

Trees = tuple[np.ndarray, np.ndarray, np.ndarray]


def sentences(pages: DataFrame, text: str, most: int = SENTENCE_PAGES) -> list[str]:
    """Sentences of at most `most` pages, those whose hashes are least; made-up ones if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([Page(t).text() for t in batch.column(0).to_pylist()], pa.string())], names=["text"])

    chosen = pages.select(pages[text].cast("string").alias("html")).where("html IS NOT NULL").groupBy(F.sha2("html", 256).alias("h")).agg(F.first("html").alias("html")).orderBy("h").limit(most)
    found = {s.strip() + "." for r in chosen.select("html").mapInArrow(run, "text string").collect() for s in r["text"].split(". ") if s.strip()}
    return sorted(found) or [f"{'lorem' * k} ipsum, dolor {'sit' * k} amet." for k in range(1, 6)]


def examples(spark: SparkSession, said: list[str], pages: int = PAGES, seed: int = 12) -> DataFrame:
    """Blocks of composed pages that are article throughout (label 1) or not at all (label 0): label, weight, features.
    On each page both labels weigh the same, so short articles count like long ones."""
    shared = spark.sparkContext.broadcast(said)  # sentences of SENTENCE_PAGES pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            labels, weights, rows = [], [], []
            for number in batch.column(0).to_pylist():
                page = Page(compose(number, shared.value, seed))
                yes, no = [0] * len(page.tags), [0] * len(page.tags)
                for node, _, run_, _ in page.texts:
                    if run_.strip():
                        (yes if MARK in run_ else no)[node] += 1
                page.texts = [(a, b, t.replace(MARK, ""), d) for a, b, t, d in page.texts]
                for i in range(len(page.tags) - 1, 0, -1):
                    yes[page.parents[i]] += yes[i]
                    no[page.parents[i]] += no[i]
                pure = [(float(yes[i] > 0), row) for i, row in zip(*features(page, known), strict=True) if bool(yes[i]) != bool(no[i])]
                share = [1 / max(1, sum(y == x for y, _ in pure)) for x in (0.0, 1.0)]
                labels += [y for y, _ in pure]
                weights += [share[int(y)] for y, _ in pure]
                rows += [row for _, row in pure]
            yield pa.record_batch([pa.array(labels, pa.float64()), pa.array(weights, pa.float64()), pa.array(rows, pa.list_(pa.float64()))], names=["label", "weight", "features"])

    return spark.range(0, pages, 1, min(pages, width(spark))).mapInArrow(run, "label double, weight double, features array<double>")


def fit(spark: SparkSession, said: list[str], pages: int = PAGES, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees as arrays, a row a tree: the feature and the threshold at each inner node of a full tree of that
    depth, and the values of its leaves, weighted."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    held = materialize(examples(spark, said, pages), "html-examples")
    rows = held.select("label", "weight", array_to_vector("features").alias("features"))
    model = GBTClassifier(weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.2, maxBins=32, seed=12, cacheNodeIds=False).fit(rows)
    release(held)
    feature, threshold, leaf = np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth))

    def fill(t: int, node, at: int, level: int, weight: float) -> None:
        if node.getClass().getSimpleName() == "LeafNode":
            # The value of a leaf above the last level holds for all places below it.
            span = 2 ** (depth - level)
            begin = (at + 1 - 2**level) * span
            leaf[t, begin : begin + span] = weight * node.prediction()
            return
        feature[t, at], threshold[t, at] = node.split().featureIndex(), node.split().threshold()
        fill(t, node.leftChild(), 2 * at + 1, level + 1, weight)
        fill(t, node.rightChild(), 2 * at + 2, level + 1, weight)

    for t, (tree, weight) in enumerate(zip(model.trees, model.treeWeights, strict=True)):
        fill(t, tree._call_java("rootNode"), 0, 0, weight)
    return feature, threshold, leaf


def log_odds(rows: np.ndarray, trees: Trees) -> np.ndarray:
    """Log-odds of being article; the boosted sum is half of them, as the loss is log(1 + exp(-2yF))."""
    feature, threshold, leaf = trees
    depth = int(math.log2(leaf.shape[1]))
    out = np.zeros(len(rows))
    every = np.arange(len(rows))
    for f, x, v in zip(feature, threshold, leaf, strict=True):
        at = np.zeros(len(rows), np.int64)
        for _ in range(depth):
            at = 2 * at + 1 + (rows[every, f[at]] > x[at])
        out += v[at - (2**depth - 1)]
    return np.clip(2 * out, -SURE, SURE)


def decode(page: Page, seen: list[int], odds: list[float], mixed: float = MIXED, none: float = NONE) -> list[bool]:
    """Which nodes' own texts are kept: the likeliest labelling of all blocks.

    A page has one region, the subtree of one block, outside of which nothing is article; or none, at a cost. Inside it
    a block is article throughout, not at all, or mixed, and a mixed one lets its children decide.
    """
    n = len(page.tags)
    yes, no, own, kids, best = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    bare = [True] * n
    for i, o in zip(seen, odds, strict=True):
        yes[i], own[i] = -math.log1p(math.exp(-o)), -math.log1p(math.exp(o))
        no[i] = own[i]
    down = sorted(seen)
    for i in reversed(down):
        # yes and no hold those of the whole subtree by now, as children come after parents.
        best[i] = max(yes[i], no[i]) if bare[i] else max(yes[i], no[i], kids[i] - mixed)
        if i:
            p = page.parents[i]
            yes[p] += yes[i]
            no[p] += no[i]
            kids[p] += best[i]
            bare[p] = False
    keep = [False] * n
    if not down:
        return keep
    # What a region costs: its inside, and all outside of it dropped; blocks around it are neither.
    around = [0.0] * n
    region, most = -1, no[0] - none
    for i in down:
        around[i] = around[page.parents[i]] + own[page.parents[i]] if i else 0.0
        score = (yes[i] if bare[i] else max(yes[i], kids[i] - mixed)) + no[0] - no[i] - around[i]
        if score > most:
            region, most = i, score
    state: list[bool | None] = [False] * n
    for i in down:
        if i == region:
            state[i] = True if bare[i] or yes[i] >= kids[i] - mixed else None
        elif i:
            above = state[page.parents[i]]
            state[i] = above
            if above is None and (bare[i] or max(yes[i], no[i]) >= kids[i] - mixed):
                state[i] = yes[i] > no[i]
        keep[i] = bool(state[i])
    return keep


def extract(pages: DataFrame, key: str = "page_id", text: str = "html", url: str | None = "url", trees: Trees | None = None) -> DataFrame:
    """One row per row of pages: key, url (if named), text, n_chars."""
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(trees or fit(spark, sentences(pages, text)))
    kept = [pages[key].alias("key"), *([pages[url].alias("url")] if url else [])]
    rows = pages.select(*kept, pages[text].cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        body = GROUP["#text"]
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                held, rows_, start = [], [], at
                while at < whole.num_rows and len(rows_) < BATCH:
                    page = Page(whole.column(whole.num_columns - 1)[at].as_py() or "")
                    seen, found = features(page, known)
                    held.append((page, seen))
                    rows_ += found
                    at += 1
                table = np.array(rows_, float).reshape(len(rows_), N_FEATURES)
                odds, done, texts = log_odds(table, shared.value).tolist(), 0, []
                for page, seen in held:
                    keep = decode(page, seen, odds[done : done + len(seen)])
                    done += len(seen)
                    texts.append(page.text(keep))
                batch = whole.slice(start, at - start)
                yield pa.record_batch([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:-1])
    found = rows.mapInArrow(run, f"{kind}, text string, n_chars bigint")
    return found.select(F.col("key").alias(key), *([F.col("url").alias(url)] if url else []), "text", "n_chars")
