"""Hand-computed values on a small fixture: six episodes over four techniques."""

import math
import random

import pandas as pd
import pytest

from tideglass.functions.sqlop import literal
from tideglass.operators import clustering, cooccurrence, graph, names, search, sequences, simulation

EPISODES = {"e1": "ABC", "e2": "AB", "e3": "ACD", "e4": "BC", "e5": "ABCD", "e6": "D"}


@pytest.fixture(scope="module")
def et(spark):
    return spark.createDataFrame([(e, t) for e, ts in EPISODES.items() for t in ts], "episode string, technique string")


def test_global_metrics(et):
    got = {(r["technique_a"], r["technique_b"]): r for r in cooccurrence.OPS["a01_global_cooccurrence"](et=et, min_pair=1).collect()}
    assert got["A", "B"]["n_both"] == 3 and got["A", "B"]["lift"] == 0.9375
    assert (got["A", "B"]["pmi"], got["A", "B"]["npmi"], got["A", "B"]["jaccard"]) == (-0.093109, -0.126342, 0.6)
    assert (got["A", "D"]["confidence_b_a"], got["A", "D"]["npmi"]) == (1.0, 0.243529)
    assert got["B", "D"]["jaccard"] == 0.2
    kept = cooccurrence.OPS["a01_global_cooccurrence"](et=et).collect()
    assert ("B", "D") not in {(r["technique_a"], r["technique_b"]) for r in kept}


def test_pair_in_every_episode_has_no_npmi(spark):
    et = spark.createDataFrame([(e, t) for e in "xyz" for t in "AB"], "episode string, technique string")
    assert cooccurrence.OPS["a01_global_cooccurrence"](et=et).first()["npmi"] is None


def test_actor_metrics(et):
    from pyspark.sql import functions as F

    got = {(r["technique_a"], r["technique_b"]): r for r in cooccurrence.OPS["a02_actor_cooccurrence"](eta=et.withColumn("actor", F.lit("x"))).collect()}
    assert (got["A", "B"]["lift"], got["A", "B"]["npmi"]) == (0.98, 0.067473)
    assert (got["B", "D"]["lift"], got["B", "D"]["npmi"]) == (0.7, -0.160964)


def test_bundles(et):
    got = {tuple(r["techniques"]): r for r in cooccurrence.bundles(et, min_support=1).collect()}
    one = got["A", "B", "C"]
    assert (one["lift"], one["lift_reference"]) == (pytest.approx(0.28125), pytest.approx(0.09375))
    assert got["A", "C", "D"]["confidence"] == pytest.approx(2 / 3) and got["B", "C", "D"]["support"] == 1


def test_bundles_of_three_to_five(spark):
    from collections import Counter
    from itertools import combinations

    rng = random.Random(6)
    episodes = {e: rng.sample("ABCDEFGH", rng.randint(1, 7)) for e in range(30)}
    rows = [(e, t) for e, ts in episodes.items() for t in ts]
    et = spark.createDataFrame(rows + rows[:20], "episode long, technique string")
    want = Counter(c for ts in episodes.values() if len(ts) >= 3 for k in (3, 4, 5) for c in combinations(sorted(ts), k))
    single, n = Counter(t for _, t in rows), sum(len(ts) >= 3 for ts in episodes.values())
    got = {tuple(r["techniques"]): r for r in cooccurrence.bundles(et, min_support=3).collect()}
    assert {c: r["support"] for c, r in got.items()} == {c: k for c, k in want.items() if k >= 3} and {len(c) for c in got} == {3, 4, 5}
    for c, r in got.items():
        assert r["confidence"] == pytest.approx(r["support"] / min(single[t] for t in c))
        assert r["lift"] == pytest.approx(r["support"] / (n * math.prod(single[t] / n for t in c)))
    assert cooccurrence.bundles(et.limit(0)).count() == 0 and cooccurrence.bundles(et, min_support=1000).count() == 0


def test_directed_statistics(spark):
    rows = [(e, t, i, i, None) for e, ts in EPISODES.items() for i, t in enumerate(ts)]
    rows.append(("e1", None, 9, 9, None))
    actions = spark.createDataFrame(rows, "episode string, technique string, ord long, action_id long, confidence double")
    got = {(r["a"], r["b"]): r for r in sequences.OPS["d02_pair_statistics"](actions=actions).collect()}
    assert (got["A", "B"]["n"], got["A", "B"]["probability"], got["A", "B"]["asymmetry"]) == (3, 0.5, 0.375)
    assert (got["C", "D"]["probability"], got["C", "D"]["asymmetry"]) == (0.375, 0.208333)


def test_empty_input(spark):
    empty = spark.createDataFrame([], "episode string, technique string")
    assert cooccurrence.OPS["a01_global_cooccurrence"](et=empty).count() == 0


def test_literals_are_quoted():
    assert literal("O'Neil") == "'O''Neil'" and literal(["a", 1]) == "('a', 1)"
    with pytest.raises(ValueError):
        literal("a\\b")


def test_louvain_finds_two_cliques():
    edges = [(a, b, 1.0) for group in ("abc", "xyz") for a in group for b in group if a < b] + [("c", "x", 0.1)]
    found = clustering.louvain(pd.DataFrame(edges, columns=["a", "b", "w"]))
    assert len({found[n] for n in "abc"}) == 1 and found["a"] != found["x"]


def test_greedy_cover_takes_the_widest_first(spark):
    edges = spark.createDataFrame([("s", 1, t) for t in (1, 2, 3)] + [("s", 2, t) for t in (3, 4)] + [("s", 3, 4)], "grp string, item long, technique long")
    got = clustering.greedy_cover(edges, "grp").orderBy("step").collect()
    assert [(r["item"], r["newly_covered"], r["left"]) for r in got] == [(1, 3, 1), (2, 1, 0)]


def test_graph_measures():
    line = {"a": {"b": 1.0}, "b": {"c": 1.0}, "c": {}}
    assert simulation.betweenness(line, list("abc"))["b"] == 0.5
    assert simulation.articulation({"a": {"b"}, "b": {"a", "c"}, "c": {"b"}}, list("abc")) == {"b"}
    assert simulation.min_node_cut(line, list("abc"), ["a"], ["c"]) == {"b"}


def test_value_iteration(spark):
    edges = spark.createDataFrame([("a", "t", 0.5), ("a", "b", 0.5), ("b", "t", 1.0)], "src string, dst string, p double")
    got = {r["state"]: r for r in simulation.value_iteration(edges, ["t"]).collect()}
    assert got["b"]["value"] == pytest.approx(10 + 0.95 * 10) and got["a"]["action"] == "t"


def test_knapsack_beats_greedy(spark):
    c = spark.createDataFrame([("x", 10.0, 3.0), ("y", 6.0, 1.5), ("z", 6.0, 1.5)], "state string, weight double, cost double")
    assert simulation.select_interdictions(c, 3.0, "greedy").count() == 1
    assert {r["state"] for r in simulation.select_interdictions(c, 3.0, "optimal").collect()} == {"y", "z"}


def test_alias_chains_end_at_the_root(spark):
    got = names.alias_roots(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "alias string, target string"))
    assert {r["root"] for r in got.collect()} == {"d"}


def test_unknown_relation_is_refused():
    with pytest.raises(ValueError):
        graph.checked(["detects); DROP"])


def test_chunks_cover_the_text(spark):
    text = "A sentence of some words. " * 200
    rows = search.chunk(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("start").collect()
    assert rows[0]["start"] == 0 and rows[-1]["stop"] == len(text) and all(b["start"] <= a["stop"] for a, b in zip(rows, rows[1:]))
    assert {r["doc_id"] for r in rows} == {1}


def test_logarithms_differ_by_operator():
    assert math.isclose(math.log2(0.9375), -0.0931094, abs_tol=1e-6)
