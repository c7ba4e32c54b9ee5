"""Bundles, flows, rules and exports on small generated files."""

import json
import uuid

import pytest

from tideglass.sources import attack_flow, rules, stix


def ident(kind, name):
    return f"{kind}--{uuid.uuid5(uuid.NAMESPACE_URL, name)}"


@pytest.fixture()
def bundle(spark, tmp_path):
    def pattern(ext, **more):
        return {"type": "attack-pattern", "id": ident("attack-pattern", ext), "spec_version": "2.1", "name": f"n{ext}", "external_references": [{"source_name": "mitre-attack", "external_id": ext}], "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "execution"}, {"kill_chain_name": "other", "phase_name": "x"}], **more}

    objects = [pattern("T1", description="d", x_mitre_platforms=["Linux"]), pattern("T1.001", x_mitre_is_subtechnique=True), pattern("T9.002"), {"type": "intrusion-set", "id": ident("intrusion-set", "a"), "name": "A", "aliases": ["B"]}]
    uses = {"type": "relationship", "id": ident("relationship", "r"), "relationship_type": "uses", "source_ref": objects[3]["id"], "target_ref": objects[0]["id"]}
    lost = {"type": "relationship", "id": ident("relationship", "m"), "relationship_type": "mitigates", "source_ref": "nobody", "target_ref": objects[0]["id"]}
    bad = {"type": "relationship", "id": "x", "relationship_type": "likes", "source_ref": "a"}
    path = tmp_path / "b.json"
    path.write_text(json.dumps({"type": "bundle", "id": "bundle--1", "objects": [*objects, uses, lost, bad]}))
    return stix.read_bundles(spark, str(path))


def test_bundle_tables(bundle):
    t = {r["external_id"]: r for r in stix.nodes(bundle, "technique").collect()}
    assert set(t) == {"T1", "T1.001", "T9.002"} and t["T1.001"]["is_sub"] and t["T1"]["revoked"] is False
    assert stix.tactic_edges(bundle).count() == 3
    sub = {r["placeholder"]: r for r in stix.subtechnique_edges(bundle).collect()}
    assert sub[False]["parent"] == t["T1"]["stix_id"] and sub[True]["parent"] == "placeholder--T9"
    assert [r["type"] for r in stix.relationship_edges(bundle).collect()] == ["uses"]
    assert {r["id"]: set(r["errors"]) for r in stix.validate(bundle).collect()} == {"x": {"bad id", "id of another type", "incomplete relationship", "unknown relationship"}}
    texts = {r["stix_id"]: r["text"] for r in stix.embedding_text(bundle).collect()}
    assert texts[t["T1"]["stix_id"]] == "nT1 T1\nd\nTactics: execution, x\nPlatforms: Linux"


def test_upsert_counts(bundle):
    t = stix.nodes(bundle, "technique")
    merged, counts = stix.upsert(t.where("external_id = 'T1'"), t)
    assert merged.count() == 3 and tuple(counts.first()) == (2, 1)


def test_assembled_ids_are_stable(spark):
    claims = spark.createDataFrame([("T1", "n", 99.0)], "external_id string, name string, confidence double")
    one, two = (json.loads(stix.assemble(claims).first()["object"]) for _ in range(2))
    assert one == two and one["confidence"] == 85.0


def test_conditions():
    assert attack_flow.holds("os == 'windows' AND admin == 'yes'", {"os": "windows", "admin": "yes"})
    assert attack_flow.holds("os == 'linux' OR os == 'windows'", {"os": "windows"})
    assert not attack_flow.holds("os == 'linux'", {"os": "windows"}) and attack_flow.holds("whatever", {})


def test_flow_takes_the_branch_that_holds(spark, tmp_path):
    objects = [
        {"type": "attack-flow", "id": "f", "start_refs": ["a1"]},
        {"type": "attack-action", "id": "a1", "technique_id": "T1", "effect_refs": ["c"]},
        {"type": "attack-condition", "id": "c", "pattern": "os == 'linux'", "on_true_refs": ["a2"], "on_false_refs": ["a3"]},
        {"type": "attack-action", "id": "a2", "technique_id": "T2"},
        {"type": "attack-action", "id": "a3", "technique_id": "T3", "effect_refs": ["a1"]},
    ]
    (tmp_path / "f.json").write_text(json.dumps({"type": "bundle", "id": "b", "objects": objects}))
    from pyspark.sql import functions as F

    df = stix.read_bundles(spark, str(tmp_path / "f.json")).withColumn("flow_id", F.lit("f"))
    ran = attack_flow.simulate(df, "flow_id", {"os": "windows"}).orderBy("step").collect()
    assert [r["technique_id"] for r in ran] == ["T1", "T3"]
    assert attack_flow.edges(df).count() == 4 and attack_flow.actions(df).count() == 3


def test_rules_link_to_sub_techniques(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"id": "r1", "title": "t", "logsource": {"product": "Windows"}, "detection": {"sel": "a", "cond": "b"}, "tags": ["attack.t1059", "attack.execution"]}) + "\n")
    read = rules.read_rules(spark, str(tmp_path / "r.json"))
    row = read.first()
    assert row["techniques"] == ["T1059"] and row["keys"] == ["cond", "sel"] and row["platform"] == "Windows"
    known = spark.createDataFrame([("T1059",), ("T1059.001",), ("T10591",)], "external_id string")
    assert {r["external_id"] for r in rules.link_rules(read, known).collect()} == {"T1059", "T1059.001"}


def test_keywords_match_words_and_phrases(spark, tmp_path):
    (tmp_path / "k.idx").write_text("# comment\nmimikatz: T1,T2\npass the hash: T3\n")
    index = rules.read_keyword_index(spark, str(tmp_path / "k.idx"))
    docs = spark.createDataFrame([(1, "Ran Mimikatz, then Pass The Hash."), (2, "mimikatzz and pass it"), (3, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["technique"]) for r in rules.match_keywords(docs, index).collect()}
    assert got == {(1, "T3"), (1, "T1"), (1, "T2")} or got == {(1, "T3")} | {(1, t) for t in ("T1", "T2")}


def test_page_text(spark):
    pages = spark.createDataFrame([(1, "<p>a &amp; b</p><script>x<y</script><!-- c -->d"), (2, None)], "page_id long, html string")
    assert [r["text"] for r in rules.page_text(pages).orderBy("page_id").collect()] == ["a & b d", None]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b")], "n long, t string")
    for kind in ("csv", "json", "parquet"):
        rules.export(df, str(tmp_path / kind), kind)
        assert spark.read.option("header", True).format(kind).load(str(tmp_path / kind)).count() == 1
    with pytest.raises(ValueError):
        rules.export(df, str(tmp_path / "x"), "xml")
    assert "| 1 | a\\|b |" in rules.markdown(df, "R")


def test_bundles_of_reports(spark):
    import uuid

    claims = spark.createDataFrame([("r1", "T1", "Phish", "attack-pattern", 90.0), ("r1", "T1", "Phishing", "attack-pattern", 60.0), ("r1", "T2", "Scan", "attack-pattern", 40.0), ("r1", None, "APT X", "intrusion-set", 70.0), ("r1", None, "apt x", "intrusion-set", 80.0)], "report string, external_id string, name string, kind string, confidence double")
    reports = spark.createDataFrame([("r1", "One"), ("r2", "Empty")], "report string, title string")
    got = {r["report"]: r for r in stix.assemble_bundles(claims, reports).collect()}
    one, two = (json.loads(got[r]["bundle"]) for r in ("r1", "r2"))
    by_type = {}
    for o in one["objects"]:
        by_type.setdefault(o["type"], []).append(o)
    assert got["r1"]["n_objects"] == len(one["objects"]) == 6 and {k: len(v) for k, v in by_type.items()} == {"attack-pattern": 2, "intrusion-set": 1, "relationship": 2, "report": 1}
    assert {o["confidence"] for o in by_type["attack-pattern"]} == {85.0, 40.0} and sorted(by_type["report"][0]["object_refs"]) == sorted(o["id"] for o in one["objects"] if o["type"] != "report")
    space = uuid.UUID(stix.NAMESPACE)
    assert by_type["intrusion-set"][0]["id"] == f"intrusion-set--{uuid.uuid5(space, 'intrusion-set:apt x')}"
    assert all(uuid.UUID(o["id"].split("--")[1]).version == 5 for o in one["objects"])
    assert {(o["source_ref"], o["target_ref"]) for o in by_type["relationship"]} == {(by_type["intrusion-set"][0]["id"], o["id"]) for o in by_type["attack-pattern"]}
    assert [o["type"] for o in two["objects"]] == ["report"]


def test_detection_bundle(spark, tmp_path):
    from tideglass.sources import detections

    ref = lambda x: [{"source_name": "mitre-attack", "external_id": x}]
    objects = [
        {"type": "x-mitre-detection-strategy", "id": "s1", "name": "S", "external_references": ref("DET1"), "x_mitre_analytics": ["a1", "gone"]},
        {"type": "x-mitre-detection-strategy", "id": "s2", "name": "Old", "revoked": True},
        {"type": "x-mitre-analytic", "id": "a1", "name": "A", "external_references": ref("AN1"), "x_mitre_log_sources": [{"ref": "l1", "keys": ["b", "a"]}, {"ref": "none"}]},
        {"type": "x-mitre-log-source", "id": "l1", "name": "L"},
        *[{"type": "relationship", "id": f"e{i}", "relationship_type": "detects", "source_ref": s, "target_ref": t} for i, (s, t) in enumerate([("s1", "t1"), ("s1", "t1"), ("s2", "t2"), ("x", "t1")])],
    ]
    (tmp_path / "b.json").write_text(json.dumps({"type": "bundle", "id": "b", "objects": objects}, indent=1))
    bundle = detections.tables(detections.read_bundle(spark, str(tmp_path / "b.json")))
    assert {(r["stix_id"], r["external_id"], r["active"]) for r in bundle["strategies"].collect()} == {("s1", "DET1", True), ("s2", None, False)}
    assert [tuple(r) for r in bundle["has_analytic"].collect()] == [("s1", "a1")]
    assert [(r["analytic"], r["log_source"], r["keys"]) for r in bundle["uses_log_source"].collect()] == [("a1", "l1", ["a", "b"])]
    assert {tuple(r) for r in bundle["detects"].collect()} == {("s1", "t1"), ("s2", "t2")}
    techniques = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "stix_id string")
    assert {tuple(r) for r in detections.coverage(bundle, techniques).collect()} == {("t1", 1, 1, 1), ("t2", 0, 0, 0), ("t3", 0, 0, 0)}


def test_rules_are_unlinked(spark):
    edges = spark.createDataFrame([("r1", "T1"), ("r2", "T1")], "rule string, external_id string")
    assert [r["rule"] for r in rules.unlink_rules(edges, spark.createDataFrame([("r1",), ("r1",)], "id string")).collect()] == ["r2"]
