"""A content-addressed WARC archive.

Payload bytes are stored once, under a strong digest that is checked when they are read; the exact header block of
every record is stored apart; joins put the original records together again. Of records with equal payloads (of at
least a number of bytes) the one with the largest id is a response and the others are revisits that refer to it.

Null payloads count as empty, null urls as an empty target. Repeated ids with equal payloads: one of the largest is
the response, so exactly one is. An empty table gives an empty archive. Columns other than the three named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm.frequent import meet
from tideglass.llm.store import materialize, new_path, release

CRLF = "\r\n"
DATE = "1970-01-01T00:00:00Z"


def base32(hex_digest: Column, digits: int = 40) -> Column:
    """Upper-case base32 of a hex digest whose length is a multiple of ten digits (40 bits)."""
    groups = [F.lpad(F.conv(F.substring(hex_digest, at, 10), 16, 32), 8, "0") for at in range(1, digits, 10)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def sha1_base32(payload: Column) -> Column:
    return base32(F.sha1(payload))


@dataclass(frozen=True)
class Archive:
    """Where the two tables of an archive are."""

    headers: str
    payloads: str


HEADER_COLUMNS = "header string, store_key string"


def record_id(*parts: Column) -> Column:
    """A stable record id: a urn of a hash of the parts."""
    hexed = F.sha2(F.concat_ws(":", F.lit("record"), *parts), 256)
    cut = [F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def header_block(own_id: Column, page_id: Column, url: Column, refers_to: Column, digest: Column, length: Column) -> Column:
    """The exact header block of a record, blank line included; a revisit if it refers to another."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))
    revisit = refers_to.isNotNull()
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", own_id),
        line("WARC-Date", F.lit(DATE)),
        # A line break would end the header line, so it is percent-encoded as in any URI.
        line("WARC-Target-URI", F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(page_id.isNotNull(), line("X-Page-ID", page_id)).otherwise(F.lit("")),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        F.when(revisit, line("WARC-Refers-To", refers_to)).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(length)),
        F.lit(CRLF),
    )


def write(pages: DataFrame, least_bytes: int = 0, key: str = "page_id", url: str = "url", payload: str = "html") -> Archive:
    """Write the archive of pages into the shared folder.

    Digests and lengths are taken where the pages are read; only those are shuffled to find each payload's response,
    and copies of a frequent payload meet theirs without that. Payload bytes then travel once, to be stored once.
    """
    spark = pages.sparkSession
    body = F.coalesce(pages[payload].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages[key].cast("bigint").alias("page_id"), pages[url].cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"sha256": F.sha2("payload", 256), "length": F.octet_length("payload").cast("bigint"), "digest": sha1_base32(F.col("payload")), "row": F.monotonically_increasing_id()})
    slim = materialize(rows.select("page_id", "url", "sha256", "length", "digest", "row"), "warc-rows")
    long = slim.where(F.col("length") >= least_bytes)
    best = materialize(long.groupBy("sha256").agg(F.max(F.struct("page_id", "row")).alias("best"), F.count(F.lit(1)).alias("n")), "warc-responses")
    name = lambda page, row: record_id(F.coalesce(page.cast("string"), F.lit("")), F.col("sha256"), row.cast("string"))
    typed = meet(long, best, ["sha256"]).withColumn("target", F.when(F.col("best.row") != F.col("row"), name(F.col("best.page_id"), F.col("best.row")))).drop("best")
    typed = typed.unionByName(slim.where(F.col("length") < least_bytes).withColumn("target", F.lit(None).cast("string")))
    headers, payloads = new_path(spark, "warc-headers"), new_path(spark, "warc-payloads")
    typed.select(
        header_block(name(F.col("page_id"), F.col("row")), F.col("page_id"), F.col("url"), F.col("target"), F.col("digest"), F.col("length")).alias("header"),
        F.col("sha256").alias("store_key"),
    ).write.option("compression", "zstd").parquet(headers)
    # One copy of each payload: copies of a group meet as (digest, first of equal bytes), combined in every task first.
    rows.groupBy("sha256").agg(F.max("payload").alias("payload")).select(F.col("sha256").alias("store_key"), "payload").write.option("compression", "zstd").parquet(payloads)
    release(slim, best)
    return Archive(headers, payloads)


def payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    """store_key, payload; bytes that do not have their digest are an error."""
    stored = spark.read.schema("store_key string, payload binary").parquet(archive.payloads)
    fits = F.sha2("payload", 256) == F.col("store_key")
    return stored.select("store_key", F.when(fits, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not have its digest")).cast("binary")).alias("payload"))


def headers(spark: SparkSession, archive: Archive) -> DataFrame:
    """header, store_key (of the payload, for revisits too) of every record."""
    return spark.read.schema(HEADER_COLUMNS).parquet(archive.headers)


def field(header: Column, name: str) -> Column:
    """Value of a named header line, null if there is none."""
    found = F.regexp_extract(header, rf"(?s)\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.contains(header, F.lit(f"{CRLF}{name}: ")), found)


def records(spark: SparkSession, archive: Archive, revisits: bool = True) -> DataFrame:
    """The original records, headers and payloads joined: header, payload, its length and digest as measured on the
    stored bytes, and record, the record's own bytes (a revisit has no block). Without revisits, responses only."""
    stored = payloads(spark, archive).select("store_key", "payload", F.octet_length("payload").cast("bigint").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"))
    own = headers(spark, archive)
    if not revisits:
        own = own.where(field(F.col("header"), "WARC-Type") == "response")
    joined = own.join(stored, "store_key")
    block = F.when(field(F.col("header"), "WARC-Type") == "revisit", F.lit(b"").cast("binary")).otherwise(F.col("payload"))
    end = F.lit(CRLF * 2).cast("binary")
    return joined.select("header", "payload", "payload_bytes", "payload_digest", F.concat(F.col("header").cast("binary"), block, end).alias("record"))


def read_back(spark: SparkSession, archive: Archive) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, from the archive's records alone.

    Responses are put together from header and payload; ids, types and references are read off the header blocks,
    lengths and digests off the stored bytes (where they lie: Spark prunes the bytes themselves from the join). A
    revisit is what its WARC-Refers-To says: the response with that record id, of which it has length and digest. A
    header whose digest is not its payload's is an error. Copies of a frequent payload meet it without a shuffle.
    """
    header = F.col("header")
    said = field(header, "WARC-Payload-Digest")
    own = (field(header, "WARC-Record-ID").alias("record_id"), field(header, "X-Page-ID").cast("bigint").alias("page_id"), said.alias("said"))
    fits = F.col("said") == F.concat(F.lit("sha1:"), "payload_digest")
    digest = F.when(fits, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header's digest is not its payload's")).cast("string"))
    responses = records(spark, archive, revisits=False).select(*own, "payload_bytes", "payload_digest")
    responses = materialize(responses.select("record_id", "page_id", "payload_bytes", digest.alias("payload_digest")), "warc-read")
    again = headers(spark, archive).where(field(header, "WARC-Type") == "revisit").select(*own, field(header, "WARC-Refers-To").alias("target")).drop("record_id")
    again = materialize(again, "warc-revisits")
    counts = again.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    target = responses.select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").join(counts, "target")
    met = meet(again, materialize(target, "warc-targets"), ["target"])
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    first = responses.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("bigint")})
    return first.select(*names).unionByName(met.select("page_id", "payload_bytes", digest.alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to"))
