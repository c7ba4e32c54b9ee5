"""Detection rules, keyword indexes and pages as tables; results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE = "id string, title string, status string, level string, logsource struct<product:string,service:string,category:string>, detection map<string,string>, tags array<string>, license string"
#: Products of log sources by platform.
PLATFORMS = {"windows": "Windows", "linux": "Linux", "macos": "macOS", "aws": "Cloud", "azure": "Cloud", "gcp": "Cloud"}


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules as JSON lines: id, title, platform, techniques (from tags), detection keys, hash of what they detect."""
    rules = spark.read.schema(RULE).json(path)
    platforms = F.create_map(*[F.lit(x) for pair in PLATFORMS.items() for x in pair])
    technique = F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.rlike(r"^attack\.t\d{4}(\.\d{3})?$"))
    return rules.select(
        "id", "title", "status", "level", platforms[F.lower("logsource.product")].alias("platform"),
        F.transform(technique, lambda t: F.upper(F.substr(t, F.lit(8)))).alias("techniques"), F.array_sort(F.map_keys("detection")).alias("keys"), F.sha2(F.to_json("detection"), 256).alias("hash"),
    )


def link_rules(rules: DataFrame, techniques: DataFrame) -> DataFrame:
    """DETECTS edges from rules to techniques (external_id): the id itself or its sub-techniques; confidence 85."""
    wanted = rules.select(F.col("id").alias("rule"), F.explode("techniques").alias("wanted"))
    parts = techniques.select("external_id", F.explode(F.array_distinct(F.array("external_id", F.split_part("external_id", F.lit("."), F.lit(1))))).alias("wanted"))
    return wanted.join(parts, "wanted").select("rule", "external_id", F.lit(85).alias("confidence")).distinct()


def unlink_rules(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges (rule, ...) without those of the given rules (id): what is left after they were withdrawn."""
    return edges.join(rules.select(F.col("id").alias("rule")).distinct(), "rule", "left_anti")


def read_keyword_index(spark: SparkSession, path: str) -> DataFrame:
    """Lines `keyword: T1,T2`, comments with #: keyword, technique."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & F.contains("value", F.lit(":")))
    return lines.select(F.lower(F.trim(F.split_part("value", F.lit(":"), F.lit(1)))).alias("keyword"), F.explode(F.split(F.split_part("value", F.lit(":"), F.lit(2)), ",")).alias("t")).select("keyword", F.trim("t").alias("technique"))


def match_keywords(docs: DataFrame, index: DataFrame, most: int | None = None) -> DataFrame:
    """Keywords in texts: single words by token, phrases by position. Tokens meet keywords in a join; phrases meet the
    texts that hold their first word. With `most` (SURVEY G13 has 50) that many of a document, longest first."""
    from pyspark.sql import Window

    token = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9_.%$#@+\-]+"), F.lit(0))))
    tokens = docs.select("doc_id", token.alias("token"))
    single = tokens.join(index.where(~F.contains("keyword", F.lit(" "))), F.col("token") == F.col("keyword")).select("doc_id", "keyword", "technique")
    phrases = index.where(F.contains("keyword", F.lit(" "))).withColumn("head", F.split_part("keyword", F.lit(" "), F.lit(1)))
    near = tokens.join(phrases, F.col("token") == F.col("head")).select("doc_id", "keyword", "technique")
    multi = near.join(docs.select("doc_id", "text"), "doc_id").where(F.contains(F.lower("text"), F.col("keyword"))).select("doc_id", "keyword", "technique")
    found = single.unionByName(multi).distinct()
    if most is None:
        return found
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.length("keyword")), "keyword", "technique"))
    return found.withColumn("rn", rank).where(F.col("rn") <= most).drop("rn")


def page_text(pages: DataFrame) -> DataFrame:
    """Visible text of pages: scripts, styles, comments and tags go, common entities are decoded."""
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(c))
    return pages.select("page_id", F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"))


def export(df: DataFrame, path: str, kind: str) -> None:
    """Results as csv (with a header), json or parquet files."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown format: {kind}")
    df.write.mode("overwrite").option("header", True).format(kind).save(path)


def markdown(df: DataFrame, title: str, most: int = 50) -> str:
    """The first rows of a report as a table."""
    rows = df.limit(most).collect()
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([f"# {title}", "", line(df.columns), line("---" for _ in df.columns), *map(line, rows)]) + "\n"
