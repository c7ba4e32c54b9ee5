"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 lower-cased letters (each character that is no letter counts as a break),
weighted by their share in the text times an inverse document frequency that is counted over every learnable document.
Weights come from follow-the-regularised-leader with elastic-net penalties, one pass per epoch over a bounded sample
(at most SAMPLE rows, drawn by hash of key and text, spread evenly over the at most MOST_LANGS languages with the most
rows; rarer labels are not learned), and a temperature is then fitted on a part of the sample that the
weights have not seen.

Null text, or text without letters (Unicode's; digits and symbols like ² or ① are none), is `und` with score 0; so is
every text when nothing can be learned (no labelled row). A null doc_id counts as the empty string; rows
without an id are still drawn by their texts. Repeated rows each
get their row, with equal predictions; equal texts always have equal predictions. An empty table gives an empty result.
Columns other than those named are not read by train and identify; predict and reject keep them all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.llm.worker import kept

BITS = 18
SAMPLE = 6000
#: Languages that are learned, the most frequent ones; of others nothing is known. Bounds the weights.
MOST_LANGS = 256
CHUNK = 1 << 20
UNKNOWN = "und"
SCALE = 64.0


@dataclass(frozen=True)
class Penalties:
    """Parameters of the learner."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    epochs: int = 2


@dataclass(frozen=True)
class Model:
    """Weights times inverse document frequencies, by feature and language, and the temperature."""

    langs: tuple[str, ...]
    weights: np.ndarray
    temperature: float


def _low(point: int) -> int:
    """The lower-case letter of a code point; a space for anything that is no letter."""
    c = chr(point)
    low = c.lower()
    return (ord(low) if len(low) == 1 else point) if c.isalpha() else 32


def _letters() -> np.ndarray:
    """Letters of the first plane by code point."""
    return np.array([_low(i) for i in range(0x10000)], np.uint32)


def letters(points: np.ndarray) -> np.ndarray:
    """Lower-case letters and spaces for code points."""
    out = kept("letters", _letters)[np.minimum(points, 0xFFFF)]
    beyond = np.flatnonzero(points > 0xFFFF)
    if len(beyond):
        found, which = np.unique(points[beyond], return_inverse=True)
        out[beyond] = np.array([_low(int(p)) for p in found], np.uint32)[which]
    return out


def grams(texts: list[str], bits: int = BITS) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For n-gram lengths 1 to 3: features and whether the n-gram counts (it starts or ends with a letter), over all
    texts laid end to end; then where the n-grams of each text start. Two spaces stand before each text and after the
    last, so no n-gram has letters of two texts: one that starts in a text or in the spaces before it ends there or in
    the spaces behind."""
    gap = "  "
    points = np.frombuffer((gap + gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = letters(points)
    starts = np.cumsum([0, *(len(t) + len(gap) for t in texts[:-1])])
    shift = np.uint32(32 - bits)
    found, live = [], []
    mixed = low * np.uint32(0x9E3779B1)
    letter = low != 32
    found.append(mixed >> shift)
    live.append(letter)
    for n in (2, 3):
        mixed = np.concatenate([((mixed[:-1] ^ (mixed[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B)) ^ (low[n - 1 :] * np.uint32(0xC2B2AE35)), np.zeros(1, np.uint32)])[: len(low) - n + 1]
        spread = (mixed ^ (mixed >> np.uint32(16))) * np.uint32(0x27D4EB2F)
        found.append(np.concatenate([spread >> shift, np.zeros(n - 1, np.uint32)]))
        live.append(np.concatenate([letter[: len(low) - n + 1] | letter[n - 1 :], np.zeros(n - 1, bool)]))
    return found, live, starts


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about CHUNK characters, with where they begin."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t or "")
        size += len(held[-1])
        if size >= CHUNK:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def document_frequencies(texts: DataFrame, bits: int = BITS) -> np.ndarray:
    """In how many texts each feature occurs; summed in every task, then by feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            for _, part in chunks(batch.column(0).to_pylist()):
                found, live, starts = grams(part, bits)
                ends = [*starts[1:], len(live[0])]
                for a, b in zip(starts, ends, strict=True):
                    for f, ok in zip(found, live, strict=True):
                        seen[f[a:b][ok[a:b]]] = True
                    hit = np.flatnonzero(seen)
                    total[hit] += 1
                    seen[hit] = False
        hit = np.flatnonzero(total)
        yield pa.record_batch([pa.array(hit.astype(np.int32)), pa.array(total[hit])], names=["feature", "n"])

    out = np.zeros(1 << bits)
    for row in texts.mapInArrow(run, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect():  # at most 2**bits rows
        out[row[0]] = row[1]
    return out


def sparse(texts: list[str], idf: np.ndarray, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """TF-IDF vectors as (features, values)."""
    out = []
    found, live, starts = grams(texts, bits)
    ends = [*starts[1:], len(live[0])]
    for a, b in zip(starts, ends, strict=True):
        at, n = np.unique(np.concatenate([f[a:b][ok[a:b]] for f, ok in zip(found, live, strict=True)]), return_counts=True)
        out.append((at, (SCALE * n / max(1, n.sum()) * idf[at]).astype(np.float32)))
    return out


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], n_langs: int, size: int, p: Penalties) -> np.ndarray:
    """Weights by per-coordinate follow-the-regularised-leader over the rows (label, features, values), in order."""
    z = np.zeros((size, n_langs))
    n = np.zeros((size, n_langs))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        out = -(z[at] - np.sign(z[at]) * p.l1) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2)
        out[np.abs(z[at]) <= p.l1] = 0
        return out

    for _ in range(p.epochs):
        for label, at, x in rows:
            w = weights(at)
            error = softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error[None, :]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / p.alpha
            z[at] += g - step * w
            n[at] += g * g
    return weights(slice(None))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log likelihood, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        chances = softmax(logits / math.exp(log_t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(chances, 1e-12)).mean())

    low, high, ratio = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE, bits: int = BITS, penalties: Penalties = Penalties()) -> Model:
    """Learn from the labelled documents that are not held out. Only the weights come from a bounded sample."""
    learn = docs.where(~held_out(docs[key]) & docs[label].isNotNull() & docs[text].isNotNull()).select(docs[key].cast("string").alias("key"), docs[text].cast("string").alias("text"), docs[label].cast("string").alias("label"))
    sizes = {row[0]: row[1] for row in learn.groupBy("label").count().orderBy(F.desc("count"), "label").limit(MOST_LANGS).collect()}
    langs = tuple(sorted(sizes))
    if not langs:
        return Model((), np.zeros((1 << bits, 0), np.float32), 1.0)
    learn = learn.where(F.col("label").isin(*langs))
    total = sum(sizes.values())
    df = document_frequencies(learn.select("text"), bits)
    idf = np.log((1 + total) / (1 + df)) + 1
    # A quarter more is drawn by hash of key and text than is kept, so the sort by label is of a bounded sample.
    each = max(1, sample // len(langs))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, 1.25 * each / sizes[lang] + 64 / sizes[lang]))])
    spin = F.pmod(F.xxhash64("key", "text", F.lit(17)), F.lit(1 << 40)) / float(1 << 40)
    drawn = learn.withColumn("spin", spin).where(F.col("spin") < share[F.col("label")])
    chosen = drawn.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("spin", "key"))).where(F.col("place") <= each).drop("place")
    index = {lang: i for i, lang in enumerate(langs)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in chunks(batch.column("text").to_pylist()):
                found = sparse(part, idf, bits)
                cut = batch.slice(at, len(part))
                yield pa.record_batch([cut.column("spin"), pa.array([index[x] for x in cut.column("label").to_pylist()], pa.int32()), pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.float32()))], names=["spin", "label", "at", "x"])

    def learner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(s, y, a.values.to_numpy(), x.values.to_numpy()) for b in batches for s, y, a, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True)]
        rows = sorted(((s * 1e6 % 1, s, y, a, x) for s, y, a, x in rows), key=lambda r: (r[0], r[1], len(r[3]), r[2]))
        cut = len(rows) // 5
        fit, check = [r[2:] for r in rows[cut:]], [r[2:] for r in rows[:cut]]
        w = ftrl(fit, len(langs), 1 << bits, penalties)
        logits = np.array([x @ w[a] for _, a, x in check]).reshape(len(check), len(langs))
        heat = fit_temperature(logits, np.array([y for y, _, _ in check], int))
        live = np.flatnonzero(np.abs(w).sum(axis=1))
        yield pa.record_batch([pa.array([heat]), pa.array([live.astype(np.int32)], pa.list_(pa.int32())), pa.array([w[live].ravel()], pa.list_(pa.float64()))], names=["heat", "at", "w"])

    got = chosen.mapInArrow(vectors, "spin double, label int, at array<int>, x array<float>").repartition(1).mapInArrow(learner, "heat double, at array<int>, w array<double>").first()
    weights = np.zeros((1 << bits, len(langs)), np.float32)
    live = np.array(got["at"], int)
    weights[live] = np.array(got["w"]).reshape(len(live), len(langs)) * idf[live][:, None] * SCALE
    return Model(langs, weights, got["heat"])


def predict(docs: DataFrame, model: Model, text: str = "text", bits: int = BITS) -> DataFrame:
    """docs with the columns lang_pred and score at the end, in place of any that are called so; its other columns are
    kept as they are. What is predicted for a text depends on that text alone."""
    spark = docs.sparkSession
    # 2**bits weights for each of at most MOST_LANGS languages, whatever the input's size; as plain values.
    shared = spark.sparkContext.broadcast((model.langs, model.weights, model.temperature))

    from pyspark.sql.types import StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for whole in batches:
            texts = whole.columns[-1].to_pylist()
            for at, part in chunks(texts):
                scores = np.zeros((len(part), len(m.langs)))
                count = np.zeros(len(part))
                found, live, starts = grams(part, bits)
                known = np.logical_or.reduceat(live[0], starts) & bool(m.langs)
                for f, ok in zip(found, live, strict=True):
                    for c in range(len(m.langs)):
                        # In single steps from each text's start, so sums don't depend on the texts around it.
                        scores[:, c] += np.add.reduceat((m.weights[:, c][f] * ok).astype(np.float64), starts)
                    count += np.add.reduceat(ok.astype(np.float64), starts)
                if m.langs:
                    chances = softmax(scores / np.maximum(count, 1)[:, None] / m.temperature)
                    best = chances.argmax(axis=1)
                langs = [m.langs[best[i]] if ok else UNKNOWN for i, ok in enumerate(known)]
                score = [float(chances[i, best[i]]) if ok else 0.0 for i, ok in enumerate(known)]
                cut = whole.slice(at, len(part))
                yield pa.record_batch([*cut.columns[:-1], pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[*cut.schema.names[:-1], "lang_pred", "score"])

    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    renamed = docs.toDF(*inner)
    stay = [i for i, n in enumerate(names) if n not in ("lang_pred", "score")]
    schema = StructType([renamed.schema[i] for i in stay]).add("lang_pred", "string").add("score", "double")
    body = F.col(inner[names.index(text)]).cast("string").alias("text")
    return renamed.select(*[inner[i] for i in stay], body).mapInArrow(run, schema).toDF(*[names[i] for i in stay], "lang_pred", "score")


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs; learned from docs unless a model is given."""
    rows = docs.select("doc_id", "text", "lang")
    found = predict(rows.select("doc_id", "text"), model or train(rows))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def reject(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without the rows whose text has no identifiable language: `und`, or a score under `least`."""
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    found = predict(docs.toDF(*inner), train(docs), inner[names.index("text")])
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*inner).toDF(*names)
