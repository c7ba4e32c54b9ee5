"""Fingerprints, exact dedup and the Jaccard join against brute force, nulls, ties and odd texts included."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.llm import exact_dedup, fingerprint, jaccard_join
from tideglass.llm.shingles import shingle_set, shingle_sets

LONG = "word " * 30_000


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t\n", "one", "One", "one two three four", LONG, "ä ö ü ß é", "x" * 5000]
    while len(texts) < n:
        if rng.random() < 0.5 and len(texts) > 12:
            base = (rng.choice(texts[9:]) or "").split()
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
        else:
            texts.append(" ".join(rng.choices(words, k=rng.randint(6, 120))))
    return [(i, t, "en", None if i % 9 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), COLUMNS).repartition(5).cache()


def components(texts):
    ids = sorted(texts)
    sets = {i: shingles(texts[i]) for i in ids}
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = defaultdict(list)
    for i in ids:
        for j in {j for s in sets[i] for j in seen[s]}:
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for s in sets[i]:
            seen[s].append(i)
    return {i: find(i) for i in ids}, sets


def test_components_equal_brute_force(docs):
    want, sets = components({r["doc_id"]: r["text"] for r in docs.collect()})
    got = jaccard_join.cluster(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) for r in got)


def test_one_document_of_each_group_stays(docs):
    want, _ = components({r["doc_id"]: r["text"] for r in docs.collect()})
    assert sorted(r["doc_id"] for r in jaccard_join.keep_first(docs).collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("leaf", [2, 8, 40])
def test_large_regions_recurse_and_stay_exact(spark, monkeypatch, leaf):
    """Drifting copies, copies of changing length, near misses, and unrelated texts with one passage: no region is small
    enough, so shells, Voronoi regions, windows and blocks all have their part."""
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "BLOCK", leaf)
    monkeypatch.setattr(jaccard_join, "HOT", 7)
    monkeypatch.setattr(jaccard_join, "SPREAD", 20)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    texts = []
    for i in range(60):
        texts.append(" ".join(base))
        base[rng.randrange(80)] = f"n{i}"
        if i % 10 == 9:
            for k in range(12):
                base[rng.randrange(80)] = f"m{i}-{k}"
    long = [f"l{i}" for i in range(200)]
    texts += [" ".join(long[: 60 + 5 * i]) for i in range(28)]
    for i in range(40):
        near = list(long[:90])
        for k in rng.sample(range(90), 2 + i % 4):
            near[k] = f"e{i}-{k}"
        texts.append(" ".join(near))
    passage = [f"p{i}" for i in range(12)]
    texts += [" ".join(passage + [f"u{i}-{k}" for k in range(i)]) for i in range(30)]
    rows = list(enumerate(texts))
    want, _ = components(dict(rows))
    got = jaccard_join.cluster(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_forest_connects_what_all_pairs_connect():
    rng = np.random.default_rng(4)
    for m in (5, 8, 9, 30):
        for _ in range(40):
            base = rng.integers(0, 2**63, 60).astype(np.uint64)
            sets = sorted((np.unique(np.concatenate([rng.choice(base, rng.integers(20, 60), replace=False), rng.integers(0, 2**63, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(m)), key=len)
            n, bits = [len(s) for s in sets], [jaccard_join.parity(s).tobytes() for s in sets]
            home = [bool(rng.integers(0, 3)) for _ in range(m)]
            fits = [(i, j) for i in range(m) for j in range(i + 1, m) if (home[i] or home[j]) and 100 * n[i] >= 75 * n[j] and jaccard_join.room(n[i], n[j], jaccard_join.differ(n[i], bits[i], n[j], bits[j]), 75)]
            common = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i, j in fits}
            apart = {(i, j): n[i] + n[j] - 2 * c for (i, j), c in common.items()}
            linked = {(i, j) for (i, j), c in common.items() if 100 * c >= 75 * (n[i] + n[j] - c)}
            failed = {p: apart[p] for p in fits if p not in linked and rng.random() < 0.5}
            for spare in (0, 3, 10_000):
                got = jaccard_join.forest(n, bits, home, list(range(m)), failed, spare, 75)
                assert set(got) <= set(fits) - set(failed)
                root = joined(got, m)
                assert all(root[i] == root[j] for i, j in linked)
                if not failed:
                    assert all(root[i] == root[j] for i, j in fits)


def test_pivots_prune_by_the_triangle_inequality():
    """Two groups at exact distances 0 and 30 from a pivot that bitmaps can't tell apart are never proposed to each other."""
    n, bits = [20] * 12, [b"\0" * 8] * 12
    failed = {(0, j): 12 if j < 6 else 34 for j in range(1, 12)}
    got = jaccard_join.forest(n, bits, [True] * 12, list(range(12)), failed, 10_000, 75)
    assert got and all((i < 6) == (j < 6) for i, j in got)


def test_pivots_decide_on_a_whole_table(spark, monkeypatch):
    """With fewer sets to a leaf, a whole table's regions go through Voronoi regions; groups are the same."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r["doc_id"]: r["component_id"] for r in jaccard_join.cluster(docs).collect()}
    monkeypatch.setattr(jaccard_join, "LEAF", 1)
    calls = []
    cut = jaccard_join.voronoi

    def counted(cells, level, windows, percent):
        calls.append((level, windows, cells.count()))
        return cut(cells, level, windows, percent)

    monkeypatch.setattr(jaccard_join, "voronoi", counted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.cluster(docs).collect()}
    assert got == want and any(not windows and n for _, windows, n in calls)


def near_copies(n, seed=11):
    """Copies of one text: two of three have one word changed and are linked with each other; every third one has three
    words changed elsewhere, and is a near miss of the former (96 of 136 shingles) that bitmaps don't rule out."""
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        words = [f"b{k}" for k in range(120)]
        for k in rng.sample(range(60, 115, 6), 3) if i % 3 == 2 else [rng.randrange(5, 55)]:
            words[k] = f"e{i}-{k}"
        texts.append(" ".join(words))
    return list(enumerate(texts))


def test_rows_grow_with_a_group_and_not_with_its_square(spark, monkeypatch):
    """Near misses between the members of a group are compared, but never written as a row for each pair and region."""
    written = Counter()
    write = jaccard_join.materialize

    def counted(df, tag, *rest):
        table = write(df, tag, *rest)
        written[size] += table.count()
        return table

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    for size in (40, 200):
        rows = near_copies(size)
        want, _ = components(dict(rows))
        got = jaccard_join.cluster(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want
        assert 1 < len(set(want.values())) < size
    assert written[200] < 8 * written[40]


@pytest.mark.parametrize(("leaf", "weight"), [(4096, 4_000_000), (4096, 2500), (15, 4_000_000), (15, 900)])
def test_open_cells_are_joined_parted_and_stay_exact(spark, monkeypatch, leaf, weight):
    """What is still open after the first proposals meets in one cell, in the cells it came from where that would be
    larger than a leaf, and block against block where sets are heavy."""
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "BLOCK", leaf)
    monkeypatch.setattr(jaccard_join, "WEIGHT", weight)
    rows = near_copies(70, seed=2) + [(1000 + i, t.replace("b", "c")) for i, t in near_copies(25, seed=3)]
    want, _ = components(dict(rows))
    got = jaccard_join.cluster(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_cells_are_resolved_like_all_pairs():
    rng = np.random.default_rng(6)
    for m in (2, 7, 12, 40):
        for _ in range(15):
            base = rng.integers(0, 2**63, 60).astype(np.uint64)
            sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(44, 60), replace=False), rng.integers(0, 2**63, rng.integers(0, 8)).astype(np.uint64)])) for _ in range(m)]
            home = [bool(rng.integers(0, 3)) for _ in range(m)]
            label = [int(rng.integers(0, m)) for _ in range(m)]
            linked = {(i, j) for i in range(m) for j in range(i + 1, m) if 4 * len(np.intersect1d(sets[i], sets[j])) >= 3 * len(np.union1d(sets[i], sets[j]))}
            known = [(label.index(v), i) for i, v in enumerate(label)]
            got = jaccard_join.resolve(list(range(m)), home, label, sets, 75)
            assert {(min(p), max(p)) for p in got} <= {(i, j) for i, j in linked if home[i] or home[j]}
            root, want = joined(known + got, m), joined(known + [(i, j) for i, j in linked if home[i] or home[j]], m)
            assert len(set(root)) == len(set(want)) and len(set(zip(root, want, strict=True))) == len(set(root))


def joined(pairs, m):
    root = list(range(m))
    for i, j in pairs:
        old, new = root[j], root[i]
        root = [new if r == old else r for r in root]
    return root


def test_bitmaps_never_exceed_the_distance():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        assert jaccard_join.differ(len(a), jaccard_join.parity(a).tobytes(), len(b), jaccard_join.parity(b).tobytes()) <= len(a) + len(b) - 2 * common


@pytest.mark.parametrize("together", [0, 1_000_000])
def test_components_of_paths_and_random_graphs(spark, together):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(25)]
    root = {n: n for p in pairs for n in p}
    for _ in range(100):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["node_label"] for r in jaccard_join.components(spark.createDataFrame(pairs, "x long, p long"), together).collect()}
    assert {n: got.get(n, n) for n in root} == root
    assert jaccard_join.components(spark.createDataFrame([], "x long, p long"), together).count() == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert jaccard_join.cluster(empty).count() == 0
    assert fingerprint.with_edited(empty).count() == 0
    assert exact_dedup.deduplicate(empty).count() == 0
    assert exact_dedup.annotate(empty.select("doc_id", exact_dedup.text_digest(empty["text"]).alias("text_sha256"))).count() == 0


def test_fingerprints_of_edited_texts(docs):
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    got = {r["doc_id"]: r for r in fingerprint.with_edited(docs).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        text, nxt = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + nxt[:q]
        g = got[r["doc_id"]]
        assert g["n_chars"] == len(text) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text), shingles(edited)
        assert g["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0, abs=1e-12)
        assert (g["fingerprint"] == g["edited_fingerprint"]) == (a == b)
        c = shingles(nxt)
        assert g["near_next"] == pytest.approx(len(a & c) / len(a | c) if a | c else 1.0, abs=1e-12)
        assert g["edited_containment"] == pytest.approx(len(a & b) / len(a) if a else 1.0, abs=1e-12)


def test_sketches_merge_and_estimate():
    rng = random.Random(1)
    words = [f"v{i}" for i in range(5000)]
    x, y = (" ".join(rng.choices(words, k=4000)) for _ in range(2))
    sx, sy = shingle_set(x), shingle_set(y + " " + x)
    a, b = fingerprint.sketch(sx), fingerprint.sketch(sy)
    both = fingerprint.sketch(np.union1d(sx, sy))
    assert (fingerprint.merge(a, b) == both).all()
    assert fingerprint.distinct_count(both) == pytest.approx(len(np.union1d(sx, sy)), rel=0.2)
    assert fingerprint.resemblance(a, b) == pytest.approx(0.5, abs=0.12)
    assert fingerprint.containment(a, b) == 1.0
    assert (fingerprint.decode(fingerprint.encode(a)) == a).all()


def test_fingerprints_of_groups_are_those_of_their_union(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", None]), " ".join(f"q{rng.randrange(3000)}" for _ in range(rng.choice([0, 3, 400])))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, part string, text string").withColumn("key", F.lit("x")).repartition(7)
    marks = fingerprint.fingerprints(docs).join(docs.select("doc_id", "part"), "doc_id")
    got = {r["part"]: r for r in fingerprint.merged(marks, "part").collect()}
    assert set(got) == {"a", "b", None}
    for part, r in got.items():
        whole = np.unique(np.concatenate([shingle_set(t) for _, p, t in rows if p == part]))
        assert r["fingerprint"] == fingerprint.encode(whole[: fingerprint.K])
        assert r["n_shingles_estimate"] == pytest.approx(len(whole), rel=0.25)
    assert fingerprint.merged(marks.limit(0), "part").count() == 0


def test_fingerprints_with_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (1, "x"), (1, "x"), (2, None)]
    got = fingerprint.with_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and {r["n_chars"] for r in got} == {0, 1, 11}
    plain = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    assert plain.count() == 4


def test_exact_dedup_with_ties_and_extra_columns(spark):
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "a"), (5, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_tg_best", F.lit("mine")).withColumn("group_size", F.lit(0))
    got = exact_dedup.annotate(docs.select("doc_id", exact_dedup.text_digest(docs["text"]).alias("text_sha256"))).collect()
    assert len(got) == 7 and sum(r["kept"] for r in got) == 3
    assert {r["group_size"] for r in got if r["keep_id"] == 2} == {4}
    clash = docs.withColumns({c: F.lit(c) for c in ("digest", "best", "heavy", "rank", "c0", "c1", "_tg_digest")})
    kept = exact_dedup.deduplicate(clash)
    assert kept.columns == clash.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5]
    assert {r["best"] for r in kept.collect()} == {"best"}


@pytest.mark.parametrize("frequent", [1, 512])
def test_exact_dedup_of_long_repeated_and_null_rows(spark, frequent):
    rows = [(None, LONG)] * 30 + [(1, LONG + "x"), (1, LONG + "x"), (2, None), (None, ""), (3, "q")] + [(4, "tie")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    kept = exact_dedup.deduplicate(docs, frequent=frequent).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == {(None, LONG): 1, (1, LONG + "x"): 1, (2, None): 1, (3, "q"): 1, (4, "tie"): 1}
    got = exact_dedup.annotate(docs.select("doc_id", exact_dedup.text_digest(docs["text"]).alias("text_sha256")), frequent=frequent).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == 5 and sorted({r["group_size"] for r in got}) == [1, 2, 20, 30]


def test_frequent_digests_are_found(spark):
    digests = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("d"))
    found = {r[0] for r in exact_dedup.frequent_digests(digests, "d", tracked=64, frequent=16).collect()}
    assert "hot" in found and len(found) <= 16


def test_rows_with_repeated_and_null_ids_are_told_apart(spark):
    near = " ".join(f"a{i}" for i in range(80))
    rows = [(1, near), (2, near + " end"), (2, " ".join(f"b{i}" for i in range(80))), (None, " ".join(f"c{i}" for i in range(80))), (None, " ".join(f"c{i}" for i in range(80)) + " end"), (None, near + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("row", "key", "c0", "component_id", "_tg_gone", "sid", "label")})
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert {r["row"] for r in kept} == {"row"}
    assert sorted(((r["doc_id"] or 0, r["text"][:2]) for r in kept)) == [(0, "c0"), (1, "a0"), (2, "b0")]


def test_join_of_repeated_and_null_ids_with_extra_columns(spark):
    near = " ".join(f"a{i}" for i in range(80))
    rows = [(None, near), (5, near + " end"), (5, near + " end"), (None, None), (7, ""), (7, "solo"), (8, near + " " + LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("sid", "component_id", "n_shingles", "label")})
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.cluster(docs).collect())
    assert got == {(None, 76, 5): 1, (5, 77, 5): 2, (None, 0, None): 1, (7, 0, 7): 1, (7, 1, 7): 1, (8, 81, 5): 1}
