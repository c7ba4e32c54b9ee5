"""Detection bundles (strategies, analytics, log sources) as tables, and the coverage that they give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECT = """type string, id string, name string, description string, revoked boolean, x_mitre_deprecated boolean, external_references array<struct<source_name:string,external_id:string>>,
  x_mitre_analytics array<string>, x_mitre_log_sources array<struct<ref:string,keys:array<string>>>, x_mitre_permutations array<string>, platforms array<string>,
  source_ref string, target_ref string, relationship_type string"""
KINDS = {"strategies": "x-mitre-detection-strategy", "analytics": "x-mitre-analytic", "log_sources": "x-mitre-log-source"}


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Objects of STIX bundles, one row each; a bundle is one JSON document, of which a folder may hold many."""
    fields = spark.createDataFrame([], OBJECT).schema
    bundles = spark.read.schema(f"id string, objects array<{fields.simpleString()}>").option("multiLine", True).json(path)
    return bundles.select(F.explode("objects").alias("o")).select("o.*")


def tables(objects: DataFrame) -> dict[str, DataFrame]:
    """Tables of a bundle: strategies, analytics, log_sources (stix_id, external_id, name, active), and edges detects
    (strategy, technique), has_analytic (strategy, analytic), uses_log_source (analytic, log_source, keys). Of objects
    that occur more than once, one stays; edges to what the bundle does not hold are left out."""
    external = F.get(F.filter("external_references", lambda r: r["source_name"] == "mitre-attack"), F.lit(0))["external_id"]
    gone = F.coalesce("revoked", F.lit(False)) | F.coalesce("x_mitre_deprecated", F.lit(False))
    out: dict[str, DataFrame] = {}
    for name, kind in KINDS.items():
        out[name] = objects.where(F.col("type") == kind).groupBy(F.col("id").alias("stix_id")).agg(F.min(external).alias("external_id"), F.min("name").alias("name"), (~F.max(gone)).alias("active"))
    edges = objects.where((F.col("type") == "relationship") & (F.col("relationship_type") == "detects"))
    out["detects"] = edges.join(out["strategies"], F.col("source_ref") == F.col("stix_id"), "left_semi").select(F.col("source_ref").alias("strategy"), F.col("target_ref").alias("technique")).distinct()
    analytics = objects.where(F.col("type") == KINDS["strategies"]).select(F.col("id").alias("strategy"), F.explode("x_mitre_analytics").alias("analytic"))
    out["has_analytic"] = analytics.join(out["analytics"].select(F.col("stix_id").alias("analytic")), "analytic", "left_semi").select("strategy", "analytic").distinct()
    sources = objects.where(F.col("type") == KINDS["analytics"]).select(F.col("id").alias("analytic"), F.explode("x_mitre_log_sources").alias("s")).select("analytic", F.col("s.ref").alias("log_source"), F.array_sort(F.coalesce("s.keys", F.array().cast("array<string>"))).alias("keys"))
    out["uses_log_source"] = sources.join(out["log_sources"].select(F.col("stix_id").alias("log_source")), "log_source", "left_semi").select("analytic", "log_source", "keys").distinct()
    return out


def coverage(bundle: dict[str, DataFrame], techniques: DataFrame) -> DataFrame:
    """For each technique (stix_id): how many active strategies detect it, with how many analytics and log sources."""
    live = bundle["detects"].join(bundle["strategies"].where("active").select(F.col("stix_id").alias("strategy")), "strategy", "left_semi")
    deep = live.join(bundle["has_analytic"], "strategy", "left").join(bundle["uses_log_source"].select("analytic", "log_source"), "analytic", "left")
    n = deep.groupBy("technique").agg(*[F.countDistinct(c).alias(f"n_{c}") for c in ("strategy", "analytic", "log_source")])
    return techniques.select(F.col("stix_id").alias("technique")).join(n, "technique", "left").select("technique", *[F.coalesce(f"n_{c}", F.lit(0).cast("bigint")).alias(f"n_{c}") for c in ("strategy", "analytic", "log_source")])
