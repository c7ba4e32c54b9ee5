"""Many phrases in one pass, their flags, and full-text search, against plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from tideglass.functions.scratch import new_path
from tideglass.operators import matching, textindex


def hits(text, phrase, whole, cased):
    body, key = (text, phrase) if cased else (matching.fold(text), matching.fold(phrase))
    at = [i for i in range(len(body) - len(key) + 1) if body.startswith(key, i)]
    if whole:
        at = [i for i in at if not (i and text[i - 1].isalnum()) and not text[i + len(key) : i + len(key) + 1].isalnum()]
    return (len(at), at[0]) if at else None


@pytest.mark.parametrize("shard", [200_000, 7])
def test_phrases_equal_a_scan(spark, shard):
    rng = random.Random(5)
    say = lambda n: "".join(rng.choices("abAB é.İ", k=n))
    texts = [(i, say(rng.randint(0, 60))) for i in range(60)] + [(60, None), (60, "ab ab"), (None, "ab"), (61, "x" * 300_000 + " ab")]
    phrases = {(say(rng.randint(1, 3)), rng.random() < 0.4, rng.random() < 0.4) for _ in range(40)} | {("ab", True, False), ("İ", False, True)}
    rows = [*phrases, ("ab", None, None), ("ab", False, False), ("", False, False), (None, True, True)]
    got = Counter(tuple(r) for r in matching.match_phrases(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(rows, "phrase string, whole boolean, cased boolean"), shard=shard).collect())
    want = Counter((i, *p, *h) for i, t in texts for p in phrases | {("ab", False, False)} if t and p[0] and (h := hits(t, *p)))
    assert got == want and len(want) > 300


def test_ten_thousand_phrases_in_one_pass(spark):
    """One scan of the texts, and no join of texts with phrases in the plan."""
    phrases = spark.range(10_000).selectExpr("concat('p', id, 'x') AS phrase")
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('a p', id * 31 % 10000, 'x b P', id, 'X') AS text")
    found = matching.match_phrases(docs, phrases)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Join" not in plan and plan.count("MapInArrow") == 1
    assert Counter(r["doc_id"] for r in found.collect()) == Counter({i: 1 if i * 31 % 10000 == i else 2 for i in range(200)})


def test_normal_forms_and_ladder(spark):
    hints = spark.createDataFrame([(1, "phrase", "spear-phishing", "T1"), (2, "phrase", "don't run", "T2.1"), (3, "pattern", "spear-phishing", "T3"), (4, "tool", "mimi", "T2"), (5, "phrase", "own", "T2")], "ord int, kind string, phrase string, technique string")
    docs = spark.createDataFrame([(1, "Spear phishing"), (2, "spear-phishing"), (3, "dont run mimi"), (4, "MIMI, own"), (5, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["kind"], r["phrase"]) for r in matching.hints(docs, hints).collect()}
    assert got == {(1, "phrase", "spear-phishing"), (2, "phrase", "spear-phishing"), (2, "pattern", "spear-phishing"), (3, "phrase", "don't run"), (3, "tool", "mimi"), (4, "tool", "mimi"), (4, "phrase", "own")}
    wanted = spark.createDataFrame([("T1.5",), ("T2.1",), ("T3",), ("T2",)], "technique string")
    ladder = {(r["doc_id"], r["technique"]): (r["relevance"], r["phrase"]) for r in matching.relevance(docs, hints, wanted).collect()}
    assert ladder == {(1, "T1.5"): (75, "spear-phishing"), (2, "T1.5"): (75, "spear-phishing"), (2, "T3"): (80, "spear-phishing"), (3, "T2.1"): (100, "don't run"), (3, "T2"): (60, "mimi"), (4, "T2.1"): (75, "own"), (4, "T2"): (100, "own")}


def test_spans_of_lines(spark):
    docs = spark.createDataFrame([(1, "They used T1059.001 here\n \nrun PowerShell and mimikatz\nnothing"), (2, None)], "doc_id long, text string")
    patterns = spark.createDataFrame([(r"\bpowershell\b", "execution", 0.85), (r"\bmimikatz\b", "credential-access", 0.3)], "pattern string, tactic string, weight double")
    sections = spark.createDataFrame([("here", 1.2), ("they", 0.8)], "phrase string, weight double")
    words = spark.createDataFrame([("mimikatz",), ("run",)], "phrase string")
    got = {(r["doc_id"], r["line"]): (r["score"], r["tactics"], r["n_keywords"], r["prior"]) for r in matching.span_scores(docs, patterns, sections, words).collect()}
    assert got == {(1, 0): (1.0, "explicit-technique", 0, 1.2), (1, 2): (1.0, "credential-access,execution", 2, 1.0)}


def test_suggestions_know_parents_and_children(spark):
    found = spark.createDataFrame([(1, "T1.2"), (2, "T5.1"), (3, "T1"), (3, "T9.4")], "episode long, technique string")
    pairs = spark.createDataFrame([(1, "T1", "T7"), (2, "T1.2", "T7"), (3, "T5", "T5.1"), (4, "T5.1", "T5"), (5, "T1", "T9"), (6, "T9.4", "T9.4.1")], "ord int, if_found string, check_for string")
    got = {(r["episode"], r["technique"]): r["triggered_by"] for r in matching.suggest_pairs(found, pairs).collect()}
    assert got == {(1, "T7"): "T1", (1, "T9"): "T1", (3, "T7"): "T1", (3, "T9.4.1"): "T9.4"}


def bm25(docs, query, boosts, k1=1.2, b=0.75):
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    best = {}
    for f, boost in boosts.items():
        held = {i: words(d[f]) for i, d in docs.items() if words(d[f])}
        mean = sum(map(len, held.values())) / max(1, len(held))
        for i, ws in held.items():
            s = 0.0
            for w in words(query):
                df, tf = sum(w in x for x in held.values()), ws.count(w)
                s += math.log(1 + (len(held) - df + 0.5) / (df + 0.5)) * tf / (tf + k1 * (1 - b + b * len(ws) / mean)) if tf else 0
            if s:
                best[i] = max(best.get(i, (0, "")), (boost * s, f))
    return sorted(((round(s, 6), f, i) for i, (s, f) in best.items()), key=lambda x: (-x[0], x[2]))


def test_search_by_fields(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["Rot", "blau", "grün", "x1", "y"]) + rng.choice(["", ",", "."]) for _ in range(rng.randint(0, n)))
    docs = {i: {"name": say(3), "body": say(30) if i % 7 else None} for i in range(80)}
    rows = spark.createDataFrame([(i, d["name"], d["body"]) for i, d in docs.items()] + [(None, "rot rot", "rot")], "report_id long, name string, body string")
    path = new_path(spark, "index")
    index = textindex.write_index(rows, ["name", "body"], path, files=3)
    queries = {1: "rot", 2: "Grün x1 rot", 3: "x1 x1 y", 4: "nirgends", 5: ""}
    boosts = {"name": 3.0, "body": 1.0}
    asked = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    for held in (index, textindex.open_index(spark, path)):
        got = textindex.search(held, asked, boosts, top=7).collect()
        for q, text in queries.items():
            mine = [(r["score"], r["field"], r["id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
            assert mine == bm25(docs, text, boosts)[:7]


def test_words_of_one_row_are_counted_where_it_is(spark):
    from tests.test_whole_jobs import _shuffled

    def held(rows):
        docs = spark.createDataFrame(rows, "report_id long, body string")
        df = textindex.postings(*textindex._rows(docs, ["body"], "report_id"))
        got = {(r["term"], r["id"]): (r["tf"], r["length"]) for r in df.collect()}
        return got, _shuffled(df._jdf.queryExecution().executedPlan())

    rows = [(i, f"a b{i} b{i} c{i % 3}") for i in range(50)]
    got, moved = held(rows)
    assert moved == 0 and len(got) == 150 and got["b7", 7] == (2, 4)
    got, moved = held([*rows, (7, "a d"), (8, None)])
    # Words of the repeated ids alone: three and two of id 7, three of id 8.
    assert moved <= 3 * 8 and len(got) == 151 and got["a", 7] == (2, 6) and got["d", 7] == (1, 6) and got["c2", 8] == (1, 4)
