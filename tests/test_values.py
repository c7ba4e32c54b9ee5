"""Values of the operators that SQL can't express, against plain Python on small cases."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tideglass.operators import clustering, extraction, names, search, simulation
from tideglass.streaming import windows


def test_communities_are_cliques(spark):
    rows = [(e, t) for e in range(40) for t in (("a", "b", "c") if e % 2 else ("x", "y", "z"))] + [(100, "c"), (100, "x"), (200, "lone"), (201, "lone")]
    got = {r["technique"]: r["cluster"] for r in clustering.communities(spark.createDataFrame(rows, "episode long, technique string")).collect()}
    groups = defaultdict(set)
    for t, c in got.items():
        groups[c].add(t)
    assert sorted(map(sorted, groups.values())) == [["a", "b", "c"], ["x", "y", "z"]]


def test_actor_bundles_bring_something_new(spark):
    episodes = {1: "ab", 2: "ab", 3: "abc", 4: "cd", 5: "cd", 6: "cd", 7: "e", 8: "abcd"}
    eta = spark.createDataFrame([("x", e, t) for e, ts in episodes.items() for t in ts], "actor string, episode long, technique string")
    got = [tuple(r) for r in clustering.actor_bundles(eta).orderBy("position").collect()]
    assert got == [("x", 1, "c|d", 3), ("x", 2, "a|b", 2)]


def test_cover_is_greedy(spark):
    rng = random.Random(4)
    edges = sorted({(s, rng.randrange(8), f"t{rng.randrange(15)}") for s in ("p", "q") for _ in range(40)})
    got = defaultdict(list)
    for r in clustering.greedy_cover(spark.createDataFrame(edges, "scope string, item long, technique string"), "scope").orderBy("scope", "step").collect():
        got[r["scope"]].append((r["item"], r["newly_covered"], r["left"]))
    for s in ("p", "q"):
        sets = defaultdict(set)
        for scope, item, t in edges:
            if scope == s:
                sets[item].add(t)
        left, want = set().union(*sets.values()), []
        while left and len(want) < 10:
            item = min(sets, key=lambda k: (-len(sets[k] & left), -len(sets[k]), k))
            want.append((item, len(sets[item] & left), len(left - sets[item])))
            left -= sets[item]
        assert got[s] == want


EDGES = [("a", "b", 8, 0.8), ("a", "c", 2, 0.2), ("b", "d", 5, 1.0), ("c", "d", 5, 1.0), ("d", "e", 4, 1.0)]


def test_walks_follow_probabilities_and_seeds(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string, n long, p double")
    got = {r["path"]: r for r in simulation.rollouts(edges, ["a"], ["e"], 4000, 8).collect()}
    assert set(got) == {"a>b>d>e", "a>c>d>e"} and sum(r["n"] for r in got.values()) == 4000 and all(r["reached"] for r in got.values())
    assert abs(got["a>b>d>e"]["n"] - 3200) < 5 * math.sqrt(4000 * 0.16)
    again = {r["path"]: r["n"] for r in simulation.rollouts(edges, ["a"], ["e"], 4000, 8).collect()}
    assert again == {k: r["n"] for k, r in got.items()}
    short = {r["path"] for r in simulation.rollouts(edges, ["a"], [], 50, 1).collect()}
    assert short <= {"a>b", "a>c"}


def test_choke_points_of_a_bridge(spark):
    got = {r["state"]: r for r in simulation.choke_points(spark.createDataFrame(EDGES, "src string, dst string, n long, p double"), ["a"], ["e"]).collect()}
    assert [s for s, r in got.items() if r["articulation"]] == ["d"] == [s for s, r in got.items() if r["in_cut"]]
    assert {s: r["dominates"] for s, r in got.items() if r["dominates"]} == {"d": 1}
    # Shortest paths by -ln p: a to d and e go through b; everything to e goes through d.
    assert got["d"]["betweenness"] == round(3 / 12, 6) and got["b"]["betweenness"] == round(2 / 12, 6) and got["c"]["betweenness"] == 0


def test_chunks_cover_texts_and_merge_back(spark):
    rng = random.Random(8)
    texts = {i: " ".join(f"Word{rng.randrange(99)} is here{rng.choice(['.', ',', '!', ''])}" for _ in range(n)) for i, n in enumerate([0, 1, 40, 300, 900])}
    docs = spark.createDataFrame([*texts.items(), (9, None)], "doc_id long, text string")
    chunks = defaultdict(list)
    for r in search.chunk(docs, 500, 80).collect():
        chunks[r["doc_id"]].append(r)
    assert set(chunks) == {i for i, t in texts.items() if t}
    for i, rows in chunks.items():
        rows.sort(key=lambda r: r["chunk_no"])
        assert rows[0]["start"] == 0 and rows[-1]["stop"] == len(texts[i]) and [r["chunk_no"] for r in rows] == list(range(len(rows)))
        assert all(r["text"] == texts[i][r["start"] : r["stop"]] and r["stop"] - r["start"] <= 500 for r in rows)
        assert all(b["start"] == a["stop"] - 80 for a, b in zip(rows, rows[1:]))
    merged = defaultdict(list)
    for r in search.merge_chunks(search.chunk(docs, 500, 80), 1200).orderBy("doc_id", "chunk_no").collect():
        merged[r["doc_id"]].append(r["text"])
    for i, rows in chunks.items():
        want: list[str] = []
        for r in rows:
            if want and len(want[-1]) + len(r["text"]) + 2 <= 1200:
                want[-1] += "\n\n" + r["text"]
            else:
                want.append(r["text"])
        assert merged[i] == want


def test_similar_names_are_merged_unless_kin(spark):
    rows = [("g", "powershell", 90.0, "T1"), ("g", "powershel", 50.0, "T2"), ("g", "Powershell", 40.0, "T1"), ("g", "cmd", 10.0, "T3"), ("h", "powershel", 5.0, "T9")]
    entities = spark.createDataFrame(rows, "grp string, name string, confidence double, family string")
    got = sorted((r["grp"], r["name"], r["kept"]) for r in names.merge_names(entities).collect())
    assert got == [("g", "Powershell", "Powershell"), ("g", "cmd", "cmd"), ("g", "powershel", "powershell"), ("g", "powershell", "powershell"), ("h", "powershel", "powershel")]


def test_sentences_of_unbroken_texts(spark):
    long = "One is here. Two is there! Is three? " + "four " * 30
    rows = [(1, long), (2, "Short. Text."), (3, "a\nb\nc. d"), (4, "x" * 101)]
    got = {r["doc_id"]: r["n_lines"] for r in extraction.split_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 4, 2: 1, 3: 3, 4: 1}


def test_batches_hold_every_update_once(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    got = windows.update_batches(events, 70).collect()
    assert max(r["n"] for r in got) <= 70
    held = Counter()
    for r in got:
        held[r["event_type"]] += r["n"]
    assert held == Counter({r["event_type"]: r["count"] for r in events.groupBy("event_type").count().collect()})
    assert len({(r["event_type"], r["share"], r["batch"]) for r in got}) == len(got)


def test_ignore_rules(spark):
    names = ["", "  ", None, "Unit 42", "notes.TXT", ".txt", "loader", "malware", "a1b2", "emotet", "x.tar.gz"]
    rules = [("vendor", "unit 42"), ("extension", ".txt"), ("extension", ".tar.gz"), ("generic", "Malware"), ("pattern", "[a-z][0-9][a-z][0-9]$")]
    got = extraction.not_ignored(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(rules, "kind string, value string"))
    assert sorted(r["name"] for r in got.collect()) == ["emotet", "loader"]
    none = spark.createDataFrame([], "kind string, value string")
    assert extraction.not_ignored(spark.createDataFrame([("a",)], "name string").withColumn("end", F.lit(1)), none).count() == 1


def test_indexed_neighbours_are_found(spark, monkeypatch):
    """Recall against brute force on the given vectors; with all cells probed, in many shares and blocks, all of them."""
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = {(r["query"], r["neighbour"]) for r in search.knn(vectors).collect()}
    got = {(r["query"], r["neighbour"]) for r in search.knn_indexed(vectors).collect()}
    assert len(want) >= 100 and len(want & got) / len(want) >= 0.9
    monkeypatch.setattr(search, "SHARE", 7)
    monkeypatch.setattr(search, "BLOCK", 3)
    small = vectors.where("vec_id < 400")
    exact = sorted(map(tuple, search.knn(small).collect()))
    assert sorted(map(tuple, search.knn_indexed(small, cells=5, probes=5).collect())) == exact
    assert search.knn_indexed(vectors.limit(0)).count() == 0
