"""Operators read all of their input: small cases in which a part of it used to be left out."""

import math
import random

from pyspark.sql import functions as F

from tideglass.functions import scratch
from tideglass.operators import cooccurrence, extraction, graph, review, search, simulation
from tideglass.plans import bindings


def test_profiles_read_every_episode(spark):
    use = [("x", e, "A") for e in range(200)] + [("x", 200, "B"), ("y", 300, "A"), ("y", 301, "C"), ("y", 302, "C"), ("z", 400, "C")]
    eta = spark.createDataFrame(use, "actor string, episode long, technique string")
    got = {(r["actor"], r["technique"]): r for r in cooccurrence.OPS["a04_actor_profiles"](part_use=eta).collect()}
    assert (got["x", "A"]["frequency"], got["x", "A"]["total_episodes"], got["x", "A"]["signature_rank"]) == (200, 201, 1)
    assert got["x", "B"]["tfidf"] == round(math.log(3) / 201, 9) and got["x", "B"]["signature_rank"] is None
    pairs = {(r["actor_a"], r["actor_b"]): r for r in cooccurrence.OPS["a05_actor_similarity"](part_use=eta).collect()}
    assert pairs["y", "z"]["similarity"] == round(2 / math.sqrt(5), 6)


def _greedy(items, threshold=0.85):
    kept, out = [], []
    for text, i in sorted(((t, i) for i, t in items), key=lambda x: (-len(x[0]), x[1])):
        words = set(text.lower().split())
        if not any(len(words & k) > threshold * len(words | k) for k in kept):
            kept.append(words)
            out.append(i)
    return sorted(out)


def test_large_groups_of_evidence_are_deduplicated(spark):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(30)]
    items = []
    for i in range(300):
        words = base[:]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(30)] = f"w{rng.randint(0, 60)}"
        items.append((i, " ".join(words) if i % 10 else ""))
    items += [(300 + i, " ".join(rng.sample(base, 12))) for i in range(40)]
    lines = spark.createDataFrame([(g, i, t) for g in ("a", None) for i, t in items], "grp string, id long, text string")
    want = _greedy(items)
    assert len(want) < len(items)
    for rounds in (0, 3):
        got = extraction.jaccard_evidence(lines, rounds=rounds).collect()
        assert all(sorted(r["id"] for r in got if r["grp"] == g) == want for g in ("a", None))


def test_evidence_is_settled_over_names_of_sets(spark, monkeypatch):
    rng = random.Random(11)
    common, items = [f"c{i}" for i in range(40)], []
    for i in range(80):  # families of near copies, and what shares common words alone
        own = [f"x{i}y{j}" for j in range(rng.randint(1, 60))] + rng.sample(common, rng.randint(0, 40))
        for j in range(rng.choice([1, 1, 2, 12])):
            words = [w if rng.random() > 0.04 else f"z{rng.randrange(10**6)}" for w in own]
            items.append((i * 100 + j, " ".join(rng.sample(words, len(words)))))
    items += [(9000, items[0][1]), (9001, ""), (9001, " "), (9002, "ÄB äb"), (9003, "äb")]
    lines = spark.createDataFrame([(g, i, t) for g in ("a", "b", None) for i, t in items] + [("b", 9100, None)], "grp string, id long, text string")
    want, tables, write = _greedy(items), [], scratch.written
    monkeypatch.setattr(scratch, "written", lambda df, tag: (tables.append(df), write(df, tag))[1])
    # All blocks small; nearly all of them large, with and without passes before their pairs.
    for rounds, small in ((3, 64), (2, 2), (0, 2)):
        got = extraction.jaccard_evidence(lines, rounds=rounds, small=small).collect()
        for g in ("a", "b", None):
            assert sorted(r["id"] for r in got if r["grp"] == g) == want + [9100] * (g == "b")
    # Words are written for sets of candidate pairs alone.
    assert tables and not [d for d in tables if "words" in d.columns and "u" not in d.columns]


def test_large_groups_of_vectors_lose_equal_ones(spark):
    rows = [(1, i, 1, [float(i % 30), 1.0]) for i in range(60)] + [(2, 100 + i, i, [1.0, 0.0]) for i in range(3)]
    got = {r["id"]: r["keep_id"] for r in search.semantic_dedup(spark.createDataFrame(rows, "grp long, id long, size long, v array<float>")).collect()}
    assert all(got[i] == i % 30 for i in range(60)) and all(got[100 + i] == 102 for i in range(3))


def test_near_names_need_not_agree_in_anything_else(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(60)})
    part = spark.createDataFrame([(i, n, f"Brand#{i}") for i, n in enumerate(names + ["abc", "abc"])] + [(99, None, "x")], "p_partkey long, p_name string, p_brand string")
    got = extraction.near_names(part).collect()

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    every = sorted({*names, "abc"})
    want = {(a, b, edits(a, b)) for a in every for b in every if a < b and edits(a, b) <= 2}
    assert {(r["name"], r["near_name"], r["edits"]) for r in got if r["p_partkey"] is None} == want
    assert sorted(r["p_partkey"] for r in got if r["near_name"] is None) == list(range(len(names) + 2))


def _documents(spark, lengths):
    return spark.createDataFrame([(i, "x" * n, n) for i, n in enumerate(lengths)], "doc_id long, text string, n_chars long")


def test_windows_reach_the_end(spark):
    got = extraction.OPS["p04_windows"](documents=_documents(spark, [0, 99, 100, 6150])).collect()
    assert sorted((r["doc_id"], r["start"], r["n"]) for r in got) == [(2, 0, 100)] + [(3, i, min(500, 6150 - i)) for i in range(0, 6150, 400) if 6150 - i >= 100]


def test_spans_and_chunks_reach_the_end(spark):
    lengths = [0, 89, 90, 601, 7000]
    docs = _documents(spark, lengths)
    spans = [(d, i, i * 137, i * 137 + 90) for d, n in enumerate(lengths) for i in range(n) if i * 137 + 90 <= n]
    chunks = [(d, i, i * 500, min(i * 500 + 600, n)) for d, n in enumerate(lengths) for i in range(n) if i * 500 < n]
    tables = {t: spark.sql(bindings.VIEWS[t], documents=docs) for t in ("chunk_ranges", "span_ranges")}
    run = lambda name: extraction.OPS[name](**{t: tables[t] for t in extraction.OPS[name].tables})
    got = sorted(tuple(r) for r in run("p02_span_chunks").select("doc_id", "span_no", "chunk_no").collect())
    assert got == sorted((d, i, j) for d, i, a, b in spans for e, j, x, y in chunks if d == e and a < y and b > x)
    dealt = {(r["doc_id"], r["span_no"]): r["chunk"] for r in run("p03_redistribution").collect()}
    assert dealt.keys() == {(d, i) for d, i, _, _ in spans} and dealt[4, 50] == 2
    merged = run("p11_merged_evidence").where("doc_id = 4").collect()
    assert sum(r["n"] for r in merged) == 51 + 14 and max(r["b"] for r in merged) == 50 * 137 + 90


def test_lineage_and_paths_read_all_edges(spark):
    et = spark.createDataFrame([(1, "A"), (900, "A"), (900, "B"), (901, "B"), (902, "C")], "episode long, technique string")
    assert {r["node"]: r["hops"] for r in graph._lineage(et).collect()} == {"e1": 0, "A": 1, "e900": 2, "B": 3}
    rare = spark.createDataFrame([("click", "view", 1), ("buy", "view", 500)], "src string, dst string, n long")
    assert {r["node"]: r["hops"] for r in graph._paths(rare).collect()} == {"click": 0, "view": 1, "buy": 2}


def test_paths_grow_until_none_goes_on(spark):
    edges = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.7), ("c", "d", 0.9), ("c", "a", 0.1), ("x", "y", 1.0), ("z", "z", 1.0)], "src string, dst string, p double")
    got = {tuple(r["path"]): (r["steps"], r["confidence"]) for r in extraction.maximal_paths(edges).collect()}
    assert got == {tuple("abcd"): (3, 0.7), tuple("bcd"): (2, 0.8), tuple("bca"): (2, 0.4), tuple("cd"): (1, 0.9), tuple("cab"): (2, 0.3), tuple("xy"): (1, 1.0)}
    assert ["".join(r["path"]) for r in extraction.path_report(edges, top=2).collect()] == ["xy", "cd"]


def test_techniques_and_their_parents_stay_apart(spark):
    same, near = [1.0, 0.0], [0.97, 0.2431]
    rows = [(1, 1, 1, same, "T1"), (1, 2, 1, same, "T1.001"), (1, 3, 1, same, "T1.002"), (1, 4, 1, near, "T2"), (1, 5, 1, same, "T3"), (2, 6, 1, near, "T1"), (2, 7, 1, same, "T1")]
    items = spark.createDataFrame(rows, "grp long, id long, size long, v array<double>, kin string")
    got = {r["id"]: r["keep_id"] for r in search.semantic_dedup(items, 0.9, family="kin").collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 1, 6: 6, 7: 6}
    large = {r["id"]: r["keep_id"] for r in search.semantic_dedup(items, 0.9, most=1, family="kin").collect()}
    assert large == {i: i for i in range(1, 8)}


def test_chunked_extraction_reads_to_the_end(spark):
    texts = [(1, "alpha. " * 900 + "omega"), (2, "nothing here"), (3, None), (4, "omega " + "beta gamma. " * 700)]
    index = spark.createDataFrame([("omega", "T1"), ("beta gamma", "T2")], "keyword string, technique string")
    got = {(r["doc_id"], r["technique"]): (r["n_chunks"] > 1, r["confidence"]) for r in search._by_keywords(spark.createDataFrame(texts, "doc_id long, text string"), index).collect()}
    assert set(got) == {(1, "T1"), (4, "T1"), (4, "T2")} and got[1, "T1"] == (False, 65.0) and got[4, "T2"][0]


def test_embedding_of_blank_texts_is_null(spark):
    rows = [(1, "a b a"), (2, " "), (3, None), (4, "a b a")]
    got = {r["doc_id"]: r["embedding"] for r in search.embed(spark.createDataFrame(rows, "doc_id long, text string").withColumn("embedding", F.lit("old")), search.hashed_encoder(16)).collect()}
    assert got[2] is None and got[3] is None and got[1] == got[4] and abs(sum(x * x for x in got[1]) - 1) < 1e-6


def test_paths_of_any_length(spark):
    edges = spark.createDataFrame([("a", "b", 10, 0.5), ("b", "c", 1, 0.5), ("c", "d", 1, 1.0), ("d", "a", 1, 1.0), ("b", "d", 9, 0.1)], "src string, dst string, n long, p double")
    found = {r["path"]: r["p"] for r in simulation.best_paths(edges, ["a"], 5, 0.0, 50).collect()}
    assert found == {"a>b": 0.5, "a>b>c": 0.25, "a>b>c>d": 0.25, "a>b>d": 0.05}
    for most in (1, 2, 3):
        best = [(r["path"], r["p"]) for r in simulation.best_paths(edges, ["a"], 5, 0.0, most).collect()]
        assert best == sorted(found.items(), key=lambda x: (-x[1], x[0]))[:most]
    sure = {r["path"]: r["confidence"] for r in simulation.path_confidence(edges, ["a"], 5).collect()}
    assert sure["a>b>c>d"] == 0.2125 and sure["a>b>d"] == round(0.05 * 0.8, 9)
    assert {r["state"]: r["pct"] for r in simulation.interdiction_impact(edges, ["a"], ["d"]).collect()} == {"b": 100.0, "c": 50.0}
    assert {r["path"] for r in simulation.what_if(edges, ["a"], ["c"], ["d"]).collect()} == {"a>b", "a>b>d"}


def test_hubs_are_never_joined_with_their_edges(spark, monkeypatch):
    pairs = [(f"e{i}", f"t{i % 3}") for i in range(60)] + [(f"e{i}", f"t{i % 5 + 10}") for i in range(0, 60, 2)] + [("e1", None), ("x", "y"), ("x", "y"), (None, "z"), ("t1", "t1")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, front = {"e1": 0}, ["e1"]
    for hop in range(1, 5):
        front = sorted({m for k in front if k is not None for m in near[k]} - set(want), key=str)
        want |= dict.fromkeys(front, hop)
    tables, write = [], scratch.written
    monkeypatch.setattr(scratch, "written", lambda df, tag: (tables.append(df), write(df, tag))[1])
    for few in (100_000, 0):
        monkeypatch.setattr(graph, "FEW", few, raising=False)
        got = [(r["node"], r["hops"]) for r in graph.shortest(edges, "e1", 4).collect()]
        assert len(got) == len(set(got)) and dict(got) == want and len(got) == len(want)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in tables]
    assert any("LeftSemi" in p for p in plans) and not any("Join Inner" in p for p in plans)


def _shuffled(node):
    """Rows that the exchanges of a plan that has run wrote."""
    kind = node.nodeName()
    if kind.startswith("AdaptiveSparkPlan"):
        return _shuffled(node.executedPlan())
    if "QueryStage" in kind:
        return _shuffled(node.plan())
    own = node.metrics().get("shuffleRecordsWritten").get().value() if kind == "Exchange" else 0
    return own + sum(_shuffled(node.children().apply(i)) for i in range(node.children().size()))


def test_actors_of_flows_are_counted_without_a_row_for_each(spark):
    op, rng = review.OPS["p01_attribution"], random.Random(2)
    for n in (25, 150):
        part_use = spark.createDataFrame([("x", e if e else None, t) for e in range(120) for t in sorted(rng.sample(range(40), rng.randint(1, 6)))] + [("y", 3, 0), ("x", 121, None), ("x", 122, 99)], "actor string, episode long, technique long")
        uses = spark.createDataFrame([(f"a{a}", t) for t in range(40) for a in range(n) if rng.random() < 0.8], "actor string, technique long")
        for top in (10, 3):
            got = op(part_use=part_use, uses=uses, top=top)
            want = spark.sql(op.sql(top=top), part_use=part_use, uses=uses)
            assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
        # Five rows of masks at most for each row of part_use, and the words' best.
        assert _shuffled(got._jdf.queryExecution().executedPlan()) < part_use.count() * n * 0.4
