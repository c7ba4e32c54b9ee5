"""The pipeline end to end, and the queries of the corpus operators against their oracles."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.oracle import connect, same  # noqa: E402
from tideglass.llm import jaccard_join, queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_oracle(spark, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir), connect(sf_dir), queries.oracle_sql()[name])


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == start.columns, name
        if name == "exact dedup":
            assert docs.count() == before.select("text").distinct().count()
        if name == "n-gram Jaccard join":
            assert docs.count() == jaccard_join.cluster(before).select("component_id").distinct().count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).agg({"sum(length)": "max"}).first()[0] <= 1024
    firsts = packed.where("start = 0").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in firsts} == {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()}


def test_planted_copies_go(spark):
    body = " ".join(f"word{i} runs the and of" for i in range(60))
    rows = [(i, f"{body} tail{i}", "en", "s", 1) for i in range(4)] + [(9, body + " tail0", "en", "s", 1)]
    rows += [(20 + i, " ".join(f"q{i}z{j} and the" for j in range(50)), "en", "s", 1) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "")
    assert sorted(r["doc_id"] for r in docs.collect()) == [1, *range(20, 30)]


def table(seed=11):
    """Rows of documents with nulls in every column, empty and long texts, ties, repeated rows and copies."""
    rng = random.Random(seed)
    words = {"en": [f"the{i}ing" for i in range(300)], "de": [f"und{i}sch" for i in range(300)]}
    rows = [(None, None, None, None, None), (0, "", "en", "s", 0), (1, "12 34 !", "en", "s", 7), (2, "x", "de", None, 1)]
    for i in range(60):
        lang = rng.choice(["en", "de"])
        body = rng.choices(words[lang], k=rng.choice([3, 40, 90]))
        rows.append((10 + i, " ".join(body), lang if i % 5 else None, rng.choice(["s", "t", None]), None if i % 7 == 0 else 5))
        if i % 3 == 0:
            near = list(body)
            near[rng.randrange(len(near))] = "zzz"
            rows.append((rng.choice([None, 10 + i, 200 + i]), " ".join(near), lang, "t", 1))
        if i % 4 == 0:
            rows += [(rng.choice([None, 10 + i, 300 + i]), " ".join(body), lang, "s", 2)] * 2
    rows += [(900, " ".join(rng.choices(words["en"], k=15_000)), "en", "long", 1), (901, "the quick " * 9000, "en", "long", 1)]
    return rows


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_equal_brute_force(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    from tests.llm.test_sets import components
    from tideglass.llm import language_id

    extra = {c: c for c in ("digest", "rank", "best", "row", "rate", "copy_no", "score", "lang_pred", "sid", "label", "c0")}
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(table(), COLUMNS).repartition(4).withColumns({c: F.lit(v) for c, v in extra.items()})
    key = lambda r: (r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"])
    stages = [f for _, f in corpus_pipeline.STAGES]

    known = language_id.predict(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("n")), language_id.train(docs))
    want = Counter(((r["doc_id"], r["text"]) for r in known.collect() if r["lang_pred"] != "und" and r["score"] >= 0.5))
    one = stages[0](spark, docs, "").cache()
    assert Counter((r["doc_id"], r["text"]) for r in one.collect()) == want and one.columns == docs.columns and one.count() > 60
    assert {r["rate"] for r in one.collect()} == {"rate"}

    groups = defaultdict(list)
    for r in one.collect():
        groups[r["text"]].append(r)
    two = stages[1](spark, one, "").cache()
    got = {r["text"]: r["doc_id"] for r in two.collect()}
    assert two.count() == len(groups) and two.columns == docs.columns
    assert got == {t: max((r["doc_id"] for r in rs if r["doc_id"] is not None), default=None) for t, rs in groups.items()}

    rows = sorted(two.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"]))
    own, _ = components({i: r["text"] for i, r in enumerate(rows)})
    three = stages[2](spark, two, "").cache()
    kept = Counter(own[i] for i, r in enumerate(rows) if any(r == s for s in three.collect()))
    assert set(kept) == set(own.values()) and three.count() == len(kept)
    least = {own[i]: rows[own[i]]["doc_id"] for i in own}
    assert Counter(r["doc_id"] for r in three.collect()) == Counter(least.values()) and three.columns == docs.columns

    size, rate = defaultdict(int), {}
    for r in three.collect():
        size[r["source"]] += len(r["text"])
    for s, n in size.items():
        rate[s] = math.sqrt(n) / sum(map(math.sqrt, size.values())) * sum(size.values()) / n
    want = Counter()
    for r in three.collect():
        ident = "" if r["doc_id"] is None else str(r["doc_id"])
        u = int(hashlib.md5(f"20:{ident}:1".encode()).hexdigest()[:13], 16) / 2**52
        n, p, total = 0, math.exp(-rate[r["source"]]), 0.0
        while True:
            total += p
            if u < total:
                break
            n += 1
            p *= rate[r["source"]] / n
        want[key(r)] += n
    four = stages[3](spark, three, "").cache()
    assert Counter(map(key, four.collect())) == +want and four.columns == docs.columns

    encode = Tokenizer.from_file(path("byte_bpe_50k.json")).encode
    texts = defaultdict(list)
    for r in four.collect():
        texts[r["doc_id"]].append([*encode(r["text"], add_special_tokens=False).ids, 0])
    five = stages[4](spark, four, "").collect()
    full = Counter()
    for r in five:
        ids = next(t for t in texts[r["doc_id"]] if len(t) == r["doc_tokens"] and zlib.crc32(b"".join(x.to_bytes(4, "little") for x in t[r["start"] : r["start"] + r["length"]])) == r["ids_crc32"])
        full[r["sequence_id"]] += r["length"]
        assert len(ids) == r["doc_tokens"]
    assert sum(full.values()) == sum(len(t) for ts in texts.values() for t in ts) and set(full) == set(range(len(full)))
    assert sum(n < 1024 for n in full.values()) <= 10 and all(n == 1024 or n & (n - 1) == 0 for n in full.values())


def test_empty_table_passes_every_stage(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
