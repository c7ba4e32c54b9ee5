"""Spelling variants and importance resampling against brute force, nulls, ties, repeated rows and very long texts included."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tideglass.llm import importance, queries, spelling
from tideglass.llm.cuts import pieces
from tests.oracle import connect, same

CAPITALS = {c: c + 32 for c in range(65, 91)}


def low(text):
    return (text or "").translate(CAPITALS)


def corpus(seed=4, n=60):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdé", k=rng.randint(4, 7))) for _ in range(60)]

    def vary(w):
        i = rng.randrange(len(w))
        return rng.choice([w, w, w[:i] + w[i + 1 :], w[:i] + rng.choice("abcdÀ") + w[i:], w[:i] + rng.choice("abcdß") + w[i + 1 :], w.upper()])

    texts = [None, "", " \n ", "×÷×÷× ÉCOLE École école", "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa", "𝒜𝒜 \x00 \x7f 日本語 ", " ".join(vary(rng.choice(base)) for _ in range(20_000))]
    while len(texts) < n:
        texts.append(rng.choice([" ", "-", ", "]).join(vary(rng.choice(base)) for _ in range(rng.randint(1, 200))))
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[-1]), (None, texts[-2]), (3, texts[8]), (3, texts[8])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string").select("*", F.lit("x").alias("word"), F.lit(1).alias("n"), F.lit("y").alias("key")).repartition(3)


def vocabulary(rows, drop=97):
    found = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop and h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += len(run) >= 5
    return {w: n for w, n in found.items() if n >= 3}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(vocab):
    out = {}
    for w, n in vocab.items():
        mates = [x for x in vocab if near(w, x)]
        best = min(mates, key=lambda x: (-vocab[x], x), default=None)
        form = best if best and vocab[best] >= 2 * n else None
        out[w] = (form, n, len(mates), vocab[form] if form else None)
    for w in vocab:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] += (root,)
    return out


@pytest.mark.parametrize("drop", [97, 3, 0])
def test_vocabulary(spark, docs, drop):
    got = {r["word"]: r["n"] for r in spelling.vocabulary(docs, drop=drop).collect()}
    assert got == vocabulary([(r["doc_id"], r["text"]) for r in docs.collect()], drop) and len(got) > 50


@pytest.mark.parametrize("shard", [50_000, 20])
def test_variants_equal_brute_force(spark, docs, shard, monkeypatch):
    """Small shards deal the halves of one name into several automata."""
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (shard,))
    vocab = spelling.vocabulary(docs, drop=5)
    want = variants({r["word"]: r["n"] for r in vocab.collect()})
    rows = spelling.variants(vocab).collect()
    assert {r["word"]: (r["form"], r["n"], r["n_near"], r["form_n"], r["root"]) for r in rows} == want and len(rows) == len(want)
    assert sum(v[2] for v in want.values()) > 100 and any(v[4] not in (v[0], w) for w, v in want.items())


def test_near_words_of_every_kind(spark):
    """Edits at both ends, in the middle, beside equal letters, in words of five code points and in long ones."""
    words = {"aaaaa", "aaaaaa", "aaaaaaa", "baaaa", "aaaab", "aabaa", "abcde", "bcdef", "bcde" + "f" * 40, "abcde" + "f" * 40, "abcde" + "f" * 41, "éèêëé", "éèêëe", "éèêë", "xéèêëé", "abdce"}
    got = {(r["a"], r["b"]) for r in spelling.near_pairs(spark.createDataFrame([(w, 3) for w in words], "word string, n long")).collect()}
    assert {tuple(sorted(p)) for p in got} == {(a, b) for a in words for b in words if a < b and near(a, b)}
    assert len(got) == len({tuple(sorted(p)) for p in got})


def test_roots_of_long_chains(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}" if i < 40 else None) for i in range(41)] + [("alone", None)], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(chain).collect()} == {f"w{i}": "w40" for i in range(41)} | {"alone": "alone"}


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(empty)).collect() == []
    assert spelling.variants(spelling.vocabulary(spark.createDataFrame([(None, None), (1, "ab cd")], "doc_id long, text string"))).collect() == []


def test_pieces_own_every_start_once(spark):
    texts = [(1, " ".join(f"w{i}" for i in range(100))), (1, "x" * 300), (None, ";" * 500), (2, None), (3, "short")]
    rows = pieces(spark.createDataFrame(texts, "k long, t string"), "k", "t", "[a-z0-9]+", carry=2, long=50, own=7).collect()
    starts = defaultdict(list)
    for r in rows:
        words = re.findall("[a-z0-9]+", r["text"] or "")
        assert r["row"] is None or len(words) <= 9
        starts[r["key"]] += words[: len(words) if r["own"] is None else r["own"]]
    assert sorted(starts[1]) == sorted([f"w{i}" for i in range(100)] + ["x" * 300]) and starts[3] == ["short"] and starts[None] == [] and starts[2] == []


def weigh(rows, target, n, buckets=10_000):
    def grams(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)

    s, t = Counter(b for _, x in rows for b in grams(x)[0]), Counter(b for x in target for b in grams(x)[0])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    out = []
    for i, x in rows:
        g, words = grams(x)
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return Counter(r[:4] for r in out), [(r[3], r[0]) for r in able[: 10 * len(able) // 100]]


@pytest.mark.parametrize("n", [1, 3])
def test_importance_equals_brute_force(spark, docs, n):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    target = [None, "", rows[10][1], "Abcde ABCDE wörter 12"]
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), n=n).collect()
    want, drawn = weigh(rows, target, n)
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == want
    assert [(r["score"], r["doc_id"]) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn and len(drawn) == 5
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_importance_of_equal_scores(spark):
    """Rows of one id tie; each is drawn at most once and ranks have no gap."""
    rows = spark.createDataFrame([(None, "w " * 30)] * 50 + [(7, "w " * 30)] * 50 + [(8, "few words")], "doc_id long, text string")
    got = importance.resample(rows, rows.select("text"), percent=60).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 61)) and len(got) == 101


def test_importance_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(empty, empty).collect() == []
    got = importance.resample(spark.createDataFrame([(1, "w " * 30)], "doc_id long, text string"), empty, percent=100).collect()
    assert [(r["n_features"], r["rank"]) for r in got] == [(30, 1)]


@pytest.mark.parametrize("name", ["op11_spelling", "op13_importance"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir), connect(sf_dir), queries.oracle_sql()[name])
