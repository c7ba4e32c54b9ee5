"""Rules as YAML: values of the reader, conditions, and thirty rules with their errors."""

import pytest

from tideglass.functions.scratch import new_path
from tideglass.sources import rules as rule_tables
from tideglass.sources import yaml_rules as y


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", None),
        ("a: 1\nb: 2.5\nc: true\nd: ~\ne: x y\nf:\n", {"a": 1, "b": 2.5, "c": True, "d": None, "e": "x y", "f": None}),
        ("---\n# top\na:   # none\n  - 1\n  - x: 1\n    y: 2\n  -\n    z: 3\n  - [1, 'a, b', {k: v, l}]\n", {"a": [1, {"x": 1, "y": 2}, {"z": 3}, [1, "a, b", {"k": "v", "l": None}]]}),
        ("a:\n- 1\n- - 2\n  - 3\nb: 'it''s # no comment'\n", {"a": [1, [2, 3]], "b": "it's # no comment"}),
        ('a: "t\\tq\\"\\u00e9\\\\n"\n', {"a": 't\tq"é\\n'}),
        ("a: |\n  one\n   two\n\n  three # kept\nb: >-\n  x\n  y\n\n  z\nc: |+\n  k\n\n", {"a": "one\n two\n\nthree # kept\n", "b": "x y\nz", "c": "k\n\n\n"}),
        ("a: one\n  two\n  three\nb: [1,\n  2]\n", {"a": "one two three", "b": [1, 2]}),
        ("a|contains|all: 'C:\\x'\nhttp://x/y: 1\n'q: k': 2\n", {"a|contains|all": "C:\\x", "http://x/y": 1, "q: k": 2}),
        ("a:\n  b:\n    c:\n      - d:\n          e: f\n  g: h\n", {"a": {"b": {"c": [{"d": {"e": "f"}}]}, "g": "h"}}),
    ],
)
def test_values(text, want):
    assert y.parse(text) == want


@pytest.mark.parametrize("text", ["a: &x 1", "a: *x", "a: !t 1", "a: [1, 2", "a: 'open", "a: 1\na: 2", "a: 1\n   b: 2\n c: 3", "a:\n\t- 1", "- 1\nb: 2", "a: 1\n---\nb: 2"])
def test_errors_tell_the_line(text):
    with pytest.raises(y.YamlError, match="line [1-3]"):
        y.parse(text)


def test_conditions():
    items = {"sel", "sel_a", "filter_x", "filter_y", "_hidden"}
    used = lambda c: y.condition_names(c, items)
    assert used("sel and not filter_x") == {"sel", "filter_x"} and used("1 of filter_* or (sel AND NOT sel_a)") == {"filter_x", "filter_y", "sel", "sel_a"}
    assert used("all of them") == items - {"_hidden"} and used("sel | count() by x > 5") == {"sel"} and used("not (not (sel))") == {"sel"}
    for broken in ("", "sel and", "(sel", "sel filter_x", "1 of nope_*", "and sel", "sel)"):
        with pytest.raises(ValueError):
            used(broken)


def test_keys_of_any_depth():
    detection = {"sel": [{"A|re": "x"}, {"B": {"C": 1}}], "_priv": {"D": 1, "_e": 2}, "condition": {"F": 1}, "words": ["a", "b"]}
    assert y.detection_keys(detection) == {"A|re", "B", "C", "D"}


def test_thirty_rules(spark):
    files, want = [], {}
    for i in range(30):
        tag, level, product = f"attack.t{1000 + i}.{i:03d}", ["low", "odd"][i % 10 == 9], ["windows", "aws", "apache"][i % 3]
        text = f"title: Rule {i}\nid: {i}\ntags: [attack.initial_access, {tag}]\nlogsource:\n  product: {product}\n  service: sshd\ndetection:\n  s{i}:\n    K{i}: v\n  condition: s{i}\nlevel: {level}\n"
        if i == 3:
            text += "  broken: [\n"
        if i == 4:
            text = text.replace(f"condition: s{i}", "condition: s99")
        if i == 5:
            text += "license: Proprietary\n"
        files.append((f"r{i}.yml", text))
        want[f"r{i}.yml"] = (1 if i in (3, 4, 5) or level == "odd" else 0, sorted({"linux", *y.PRODUCTS[product]}) if i != 3 else [], [tag[7:].upper()] if i != 3 else [])
    files += [("none.yml", None), ("list.yml", "- 1"), ("tags.yml", "title: t\ntags: x\n")]
    got = {r["path"]: r for r in y.rules(spark.createDataFrame(files, "path string, text string")).collect()}
    assert {p: (len(r["errors"]), r["platforms"], r["techniques"]) for p, r in got.items() if p in want} == want
    assert got["none.yml"]["errors"] == ["no rule"] and got["list.yml"]["errors"] == ["no rule"] and got["tags.yml"]["errors"] == ["no condition", "tags are no list"]
    techniques = spark.createDataFrame([("T1000.000",), ("T1001",), ("T1002.002",)], "external_id string")
    edges = rule_tables.link_rules(y.rules(spark.createDataFrame(files, "path string, text string")).where("id IS NOT NULL"), techniques)
    assert {(r["rule"], r["external_id"], r["confidence"]) for r in edges.collect()} == {("0", "T1000.000", 85), ("2", "T1002.002", 85)}


def test_folder(spark):
    path = new_path(spark, "rules")
    import os

    local = path.removeprefix("file://")
    os.makedirs(f"{local}/deep/er")
    for name, text in (("a.yml", "title: A\n"), ("deep/b.yaml", "title: B\n"), ("deep/er/c.yml", "title: [\n"), ("deep/d.txt", "title: D\n")):
        with open(f"{local}/{name}", "w") as f:
            f.write(text)
    got = {r["path"].rsplit("/", 1)[1]: (r["title"], len(r["errors"])) for r in y.read_folder(spark, path).collect()}
    assert got == {"a.yml": ("A", 1), "b.yaml": ("B", 1), "c.yml": (None, 1)}
