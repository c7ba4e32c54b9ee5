"""STIX bundles as typed tables: objects, edges, validation and upsert counters.

A bundle is read with a declared schema (nothing is inferred) and exploded into one row an object. Merging a newer
bundle keeps the newest row of each key, so a table is rewritten and never updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REFERENCE = "array<struct<source_name:string,external_id:string,url:string>>"
OBJECT = (
    "type string, id string, spec_version string, created string, modified string, name string, description string, revoked boolean, confidence double, "
    f"external_references {REFERENCE}, kill_chain_phases array<struct<kill_chain_name:string,phase_name:string>>, x_mitre_is_subtechnique boolean, x_mitre_deprecated boolean, x_mitre_shortname string, "
    "x_mitre_platforms array<string>, x_mitre_detection string, aliases array<string>, relationship_type string, source_ref string, target_ref string, pattern string, valid_from string, published string, "
    "technique_id string, start_refs array<string>, effect_refs array<string>, on_true_refs array<string>, on_false_refs array<string>, operator string, object_refs array<string>"
)
BUNDLE = f"type string, id string, objects array<struct<{', '.join(f'{n}:{k}' for n, k in (c.strip().split(' ', 1) for c in OBJECT.split(', ')))}>>"
#: What a relationship of a STIX 2.1 bundle may be called here.
RELATIONSHIPS = ("uses", "mitigates", "indicates", "attributed-to", "targets", "subtechnique-of", "detects", "revoked-by", "related-to")
LABELS = {"attack-pattern": "technique", "intrusion-set": "actor", "tool": "software", "malware": "software", "course-of-action": "mitigation", "x-mitre-tactic": "tactic", "report": "report", "indicator": "indicator", "vulnerability": "vulnerability"}


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """One row for each object of the bundles under a path."""
    read = spark.read.schema(BUNDLE).option("multiLine", True).json(path)
    return read.select(F.explode("objects").alias("o")).select("o.*")


def resolve(index: DataFrame, collection: str, version: str = "latest") -> str | None:
    """Url of a collection's version from an index (collection, version, url, position); the latest is the first."""
    rows = index.where(F.col("collection") == collection)
    rows = rows if version == "latest" else rows.where(F.col("version") == version)
    found = rows.orderBy("position").select("url").first()
    return found[0] if found else None


def external_id() -> Column:
    known = F.filter("external_references", lambda r: r["external_id"].isNotNull())
    return F.try_element_at(known, F.lit(1))["external_id"]


def nodes(objects: DataFrame, label: str) -> DataFrame:
    """Objects of a label, newest of each id: stix_id, external_id, name, description, type, revoked, deprecated, is_sub."""
    kinds = [k for k, v in LABELS.items() if v == label]
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc_nulls_last("modified"), F.desc_nulls_last("name")))
    rows = objects.where(F.col("type").isin(kinds)).withColumn("rn", rank).where("rn = 1")
    return rows.select(
        F.col("id").alias("stix_id"), external_id().alias("external_id"), "name", "description", "type", F.coalesce("revoked", F.lit(False)).alias("revoked"),
        F.coalesce("x_mitre_deprecated", F.lit(False)).alias("deprecated"), F.coalesce("x_mitre_is_subtechnique", F.lit(False)).alias("is_sub"), F.col("x_mitre_shortname").alias("shortname"), "modified",
    )


def tactic_edges(objects: DataFrame, chain: str = "mitre-attack") -> DataFrame:
    """Technique to tactic, by its kill chain phases."""
    phases = objects.where(F.col("type") == "attack-pattern").select(F.col("id").alias("stix_id"), F.explode("kill_chain_phases").alias("p"))
    return phases.where(F.col("p.kill_chain_name") == chain).select("stix_id", F.col("p.phase_name").alias("tactic")).distinct()


def subtechnique_edges(objects: DataFrame) -> DataFrame:
    """Sub-technique to parent by the external id before the dot; a parent that is not there is a placeholder."""
    t = nodes(objects, "technique").where(F.col("external_id").isNotNull())
    child = t.where(F.contains("external_id", F.lit("."))).select(F.col("stix_id").alias("child"), F.split_part("external_id", F.lit("."), F.lit(1)).alias("parent_id"))
    parent = t.select(F.col("stix_id").alias("parent"), F.col("external_id").alias("parent_id"))
    return child.join(parent, "parent_id", "left").select("child", F.coalesce("parent", F.concat(F.lit("placeholder--"), "parent_id")).alias("parent"), F.col("parent").isNull().alias("placeholder"))


def relationship_edges(objects: DataFrame) -> DataFrame:
    """uses (whatever its ends) and mitigates (if both ends are there): src, type, dst."""
    r = objects.where(F.col("type") == "relationship").select(F.col("source_ref").alias("src"), F.col("relationship_type").alias("type"), F.col("target_ref").alias("dst")).distinct()
    ids = objects.select("id").distinct()
    both = r.where("type = 'mitigates'").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return r.where("type = 'uses'").unionByName(both.select("src", "type", "dst"))


def embedding_text(objects: DataFrame) -> DataFrame:
    """What is embedded of a technique: name and id, description, detection, tactics, platforms."""
    part = lambda label, c: F.when(c.isNotNull() & (F.length(c) > 0), F.concat(F.lit(label), c))
    tactics = F.array_join(F.transform("kill_chain_phases", lambda p: p["phase_name"]), ", ")
    text = F.concat_ws("\n", F.concat_ws(" ", "name", external_id()), "description", part("Detection: ", F.col("x_mitre_detection")), part("Tactics: ", tactics), part("Platforms: ", F.array_join("x_mitre_platforms", ", ")))
    return objects.where(F.col("type") == "attack-pattern").select(F.col("id").alias("stix_id"), text.alias("text"))


def validate(objects: DataFrame) -> DataFrame:
    """Objects that break a rule: id, type, errors."""
    rules = [
        F.when(F.col("type").isNull(), "no type"),
        F.when(F.col("id").isNull() | ~F.col("id").rlike(r"^[a-z0-9-]+--[0-9a-fA-F-]{36}$"), "bad id"),
        F.when(F.col("id").isNotNull() & (F.split_part("id", F.lit("--"), F.lit(1)) != F.col("type")), "id of another type"),
        F.when(F.coalesce("spec_version", F.lit("2.1")) != "2.1", "spec version"),
        F.when((F.col("type") == "relationship") & (F.col("source_ref").isNull() | F.col("target_ref").isNull() | F.col("relationship_type").isNull()), "incomplete relationship"),
        F.when((F.col("type") == "relationship") & ~F.coalesce("relationship_type", F.lit("uses")).isin(*RELATIONSHIPS), "unknown relationship"),
        F.when(F.col("type").isin("attack-pattern", "intrusion-set", "tool", "malware") & F.col("name").isNull(), "no name"),
        F.when((F.col("type") == "indicator") & F.col("pattern").isNull(), "no pattern"),
        F.when(F.col("confidence").isNotNull() & ~F.col("confidence").between(0, 100), "confidence out of range"),
    ]
    errors = F.filter(F.array(*rules), lambda e: e.isNotNull())
    return objects.select("id", "type", errors.alias("errors")).where(F.size("errors") > 0)


def upsert(old: DataFrame, new: DataFrame, key: str = "stix_id") -> tuple[DataFrame, DataFrame]:
    """The table after new rows replace old ones of the same key, and how many were created and updated."""
    merged = old.join(new, key, "left_anti").unionByName(new)
    counts = new.join(old.select(key, F.lit(True).alias("known")), key, "left").agg(F.count_if(F.col("known").isNull()).alias("created"), F.count_if(F.col("known").isNotNull()).alias("updated"))
    return merged, counts


#: Fixed value: the namespace of names in URL form (RFC 9562).
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """Name-based UUID, version 5, as text."""
    hexed = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.lower(F.hex(F.lit(8).bitwiseOR(F.conv(F.substring(hexed, 17, 1), 16, 10).cast("int").bitwiseAND(3))))
    return F.concat_ws("-", F.substring(hexed, 1, 8), F.substring(hexed, 9, 4), F.concat(F.lit("5"), F.substring(hexed, 14, 3)), F.concat(variant, F.substring(hexed, 18, 3)), F.substring(hexed, 21, 12))


def ident(kind: str, *parts: Column) -> Column:
    """Stable id of an object from what names it."""
    return F.concat(F.lit(kind + "--"), uuid5(F.concat_ws(":", F.lit(kind), *parts)))


def assemble_bundles(claims: DataFrame, reports: DataFrame, cap: float = 85.0) -> DataFrame:
    """One STIX bundle for each report: report, n_objects, bundle (JSON). claims: report, external_id, name, kind
    (attack-pattern, intrusion-set, malware or tool), confidence; reports: report, title.

    Claims of one object are merged at their highest confidence, at most `cap`. Every other object of a report uses each
    of its attack-patterns; the report refers to all. Ids are name-based, so the same input makes the same bundle. A
    report without claims has a bundle of the report alone."""
    who = F.coalesce("external_id", F.lower("name"))
    merged = claims.groupBy("report", "kind", who.alias("who")).agg(F.max("confidence").alias("confidence"), F.min("name").alias("name"), F.min("external_id").alias("external_id"))
    own = F.concat(F.col("kind"), F.lit("--"), uuid5(F.concat_ws(":", "kind", "who")))
    objects = merged.select("report", "kind", own.alias("id"), "name", F.least("confidence", F.lit(cap)).alias("confidence"), "external_id")
    reference = F.when(F.col("external_id").isNotNull(), F.array(F.struct(F.lit("mitre-attack").alias("source_name"), "external_id")))
    made = objects.select("report", "id", F.to_json(F.struct(F.col("kind").alias("type"), "id", F.lit("2.1").alias("spec_version"), "name", "confidence", reference.alias("external_references"))).alias("object"))
    actors = objects.where("kind <> 'attack-pattern'").select("report", F.col("id").alias("source"), F.col("confidence").alias("c"))
    uses = actors.join(objects.where("kind = 'attack-pattern'").select("report", F.col("id").alias("target"), "confidence"), "report")
    edge = ident("relationship", F.col("source"), F.lit("uses"), F.col("target"))
    edges = uses.select("report", edge.alias("id"), F.to_json(F.struct(F.lit("relationship").alias("type"), edge.alias("id"), F.lit("2.1").alias("spec_version"), F.lit("uses").alias("relationship_type"), F.col("source").alias("source_ref"), F.col("target").alias("target_ref"), F.least("c", "confidence").alias("confidence"))).alias("object"))
    grouped = made.unionByName(edges).groupBy("report").agg(F.array_sort(F.collect_list(F.struct("id", "object"))).alias("parts"))
    all_ = reports.join(grouped, "report", "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<struct<id:string,object:string>>")))
    name = ident("report", F.col("report").cast("string"))
    head = F.to_json(F.struct(F.lit("report").alias("type"), name.alias("id"), F.lit("2.1").alias("spec_version"), F.col("title").alias("name"), F.transform("parts", lambda p: p["id"]).alias("object_refs")))
    body = F.concat_ws(",", F.transform("parts", lambda p: p["object"]), head)
    return all_.select("report", (F.size("parts") + 1).cast("bigint").alias("n_objects"), F.concat(F.lit('{"type":"bundle","id":"'), ident("bundle", F.col("report").cast("string")), F.lit('","objects":['), body, F.lit("]}")).alias("bundle"))


def assemble(claims: DataFrame, cap: float = 85.0) -> DataFrame:
    """Claims (external_id, name, confidence) as STIX objects in JSON with ids named by a hash; confidence is capped."""
    hexed = F.sha2(F.concat(F.lit("attack-pattern:"), "external_id"), 256)
    ident = F.concat(F.lit("attack-pattern--"), F.concat_ws("-", *[F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))
    made = F.struct(F.lit("attack-pattern").alias("type"), ident.alias("id"), F.lit("2.1").alias("spec_version"), "name", F.least("confidence", F.lit(cap)).alias("confidence"), F.array(F.struct(F.lit("mitre-attack").alias("source_name"), "external_id")).alias("external_references"))
    return claims.select("external_id", F.to_json(made).alias("object"))
