"""Names: every pair of the similarity join, chains of aliases of any length, and merging in order."""

import random

from tideglass.operators import names


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def likeness(a, b):
    if a == b:
        return 1.0
    edit = 1 - distance(a, b) / max(len(a), len(b))
    x, y = ({w for w in n.split(" ") if w} for n in (a, b))
    token = len(x & y) / min(len(x), len(y))
    s, t = sorted((a, b), key=len)
    partial = 1 - min(distance(s, t[i : i + len(s)]) for i in range(len(t) - len(s) + 1)) / len(s)
    return round(max(0.4 * edit + 0.4 * token + 0.2 * partial, token, 0.8 * partial), 9)


def test_no_pair_is_lost(spark):
    rng = random.Random(9)
    base = [" ".join("".join(rng.choices("abcé", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 4))) for _ in range(70)]

    def vary(n):
        i = rng.randrange(len(n))
        return rng.choice([n[:i] + n[i + 1 :], n[:i] + "a" + n[i:], n[:i] + "b" + n[i + 1 :], "the " + n, n.upper(), " ".join(reversed(n.split(" ")))])

    left, right = base[:50] + [vary(n) for n in base], base[20:] + [vary(vary(n)) for n in base]
    frame = lambda ns: spark.createDataFrame([(n,) for n in [*ns, None, " "]], "name string")
    for threshold in (0.85, 0.95):
        got = {(r["a"], r["b"]): r["similarity"] for r in names.similar_names(frame(left), frame(right), threshold).collect()}
        mine, theirs = ({n.lower().strip(" ") for n in ns} - {""} for ns in (left, right))
        want = {(a, b): s for a in mine for b in theirs if (s := likeness(a, b)) >= threshold}
        assert got == want and len(want) > 60


def test_steps_of_resolution(spark):
    known = spark.createDataFrame([(1, "APT 29", "group"), (2, "Cobalt Strike", "tool"), (3, "Cobalt Group", "group"), (4, "Mimikatz", "tool"), (5, None, "tool")], "id long, name string, type string")
    aliases = spark.createDataFrame([("Cozy Bear", 1), ("The Dukes", 1), ("mimi katz", 4), (None, 2)], "alias string, id long")
    asked = [("cozy bear", "group"), ("cozy bear", "tool"), ("apt-29", None), ("cozy baer", None), ("mimikats", "tool"), ("mimi kats", "tool"), ("strike cobalt", None), ("unknown", None), ("Cobalt", "group"), (" ", None), (None, None)]
    got = {(r["name"], r["type"]): (r["id"], r["step"]) for r in names.resolve(spark.createDataFrame(asked, "name string, type string"), known, aliases).collect()}
    assert got == {("cozy bear", "group"): (1, 1), ("cozy bear", "tool"): (None, None), ("apt-29", None): (1, 2), ("cozy baer", None): (None, None), ("mimikats", "tool"): (None, None), ("mimi kats", "tool"): (4, 3), ("strike cobalt", None): (2, 4), ("unknown", None): (None, None), ("cobalt", "group"): (3, 4)}


def test_alias_chains_and_cycles(spark):
    rows = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(200)] + [("x", "y"), ("y", "z"), ("z", "x"), ("in", "y"), ("far", "in"), ("self", "self"), ("two", "b"), ("two", "a"), (None, "q"), ("q", None)]
    got = {r["alias"]: r["root"] for r in names.alias_roots(spark.createDataFrame(rows, "alias string, target string")).collect()}
    assert got == {f"n{i:03d}": "n200" for i in range(200)} | {"x": "x", "y": "x", "z": "x", "in": "x", "far": "x", "self": "self", "two": "a"}
    assert names.alias_roots(spark.createDataFrame([], "alias string, target string")).collect() == []


def test_consolidation_follows_quotes(spark):
    rows = [("APT29", "group", 60, "The APT29, also known as Cozy Bear. It"), ("Cozy Bear", "group", 80, "Cozy Bear acted"), ("cozy bear ", "group", 10, "Cozy Bear acted"), ("Dukes", "group", 50, "Cozy Bear, aka The Dukes, was"), ("the dukes", "tool", 5, None), ("x", "tool", 99, ""), (" ", "tool", 1, "q")]
    got = {(r["name"], r["type"]): (r["aliases"], r["mentions"], r["confidence"]) for r in names.consolidate(spark.createDataFrame(rows, "name string, type string, confidence long, quote string")).collect()}
    assert got[("apt29", "group")][1:] == (3, 95) and "cozy bear" in got[("apt29", "group")][0] and got[("x", "tool")] == ("", 0, 99)


def test_merging_in_order(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abcdefg", k=12)) for _ in range(6)]
    rows = set()
    for i in range(90):
        n = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            n[rng.randrange(12)] = rng.choice("xyz")
        rows.add((str(i % 2), "".join(n), float(rng.randrange(9)), str(rng.randrange(5))))
    want = []
    for grp in ("0", "1"):
        kept = []
        for _, name, c, fam in sorted((r for r in rows if r[0] == grp), key=lambda r: (-r[2], r[1], r[3])):
            home = next((k for k in kept if k[1] != fam and 1 - distance(name, k[0]) / 12 >= 0.85), None)
            if home is None:
                kept.append((name, fam))
            want.append((grp, name, c, fam, home[0] if home else name))
    frame = spark.createDataFrame([*rows, (None, "a", 1.0, "b"), ("0", None, 1.0, "b")], "grp string, name string, confidence double, family string")
    got = sorted((r["grp"], r["name"], r["confidence"], r["family"], r["kept"]) for r in names.merge_names(frame).collect())
    assert got == sorted(want) and any(r[1] != r[4] for r in want)
