"""Queries of the corpus operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm import exact_dedup, fingerprint, html_text, importance, jaccard_join, language_id, mixing, packing, pii, spelling, token_counts, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edited(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.replicate(table(spark, sf_dir, "documents"))
    return mixed.withColumn("rate", F.round("rate", 6))


#: For this query alone: users bring a secret of their own.
OP3_KEY = b"key of the query, no secret at all"


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents"), OP3_KEY)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_dedup.annotate(docs.select("doc_id", exact_dedup.text_digest(docs["text"]).alias("text_sha256")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.cluster(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(spark, warc.write(table(spark, sf_dir, "pages")))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = """
WITH s AS (SELECT source, sum(length(coalesce(text, '')))::BIGINT AS size FROM documents GROUP BY source),
r AS (SELECT source, CASE WHEN size = 0 THEN 1.0::DOUBLE ELSE sqrt(size::DOUBLE) / sum(sqrt(size::DOUBLE)) OVER () * (sum(size) OVER ())::DOUBLE / size END AS rate FROM s),
c AS (SELECT source, rate, list_transform(range(60), lambda k: list_sum(list_transform(range(k + 1), lambda j: exp(-rate) * pow(rate, j) / gamma(j + 1.0)))) AS cdf FROM r),
d AS (SELECT doc_id, text, lang, documents.source, n_chars, rate,
  len(list_filter(cdf, lambda x: x <= ('0x' || substr(md5('20:' || coalesce(doc_id::VARCHAR, '') || ':1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)) AS n
  FROM documents JOIN c ON documents.source IS NOT DISTINCT FROM c.source),
e AS (SELECT *, unnest(range(1, n + 1))::INT AS copy_no FROM d)
SELECT doc_id, text, lang, source, n_chars, copy_no, round(rate, 6) AS rate, md5('20:order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy_no) AS shuffle_key FROM e
"""

OP5_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""


OP9_SQL = r"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT u.page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY u.page_id)
SELECT u.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""

OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, sha256(b) AS k FROM p),
g AS (SELECT k, max(page_id) AS best FROM d GROUP BY k)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + (i // 8) * 10, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM d JOIN g USING (k)
"""


#: The crc32 of texts, byte by byte: a table of 256 remainders, and a macro-like text over a column of hex digits.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab)"
_CRC = "xor(list_reduce(list_transform(range(length({h}) // 2), lambda i: ('0x' || substr({h}, 2 * i + 1, 2))::BIGINT), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all({_LOW}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY doc_id, run),
x AS (SELECT run, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM r WHERE length(run) >= 5),
y AS (SELECT run, k, {_CRC.format(h="h")} AS c FROM x, crc),
v AS (SELECT CASE WHEN c % 97 = 0 THEN substr(run, 1, (c % length(run))::INT) || substr(run, (c % length(run))::INT + 2) ELSE run END AS word, k FROM y),
w AS (SELECT word, sum(k)::BIGINT AS n FROM v WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
d AS (SELECT DISTINCT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n AS m FROM d AS a JOIN d AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM d AS a JOIN w AS b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM d AS a JOIN w AS b ON a.rest = b.word),
g AS (SELECT word, count(*) AS n_near, arg_min(near, (-m, encode(near))) AS near, max(m) AS m FROM p GROUP BY word),
f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN near END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM w LEFT JOIN g USING (word)),
s(word, here) AS (SELECT word, word FROM f UNION ALL SELECT s.word, f.form FROM s JOIN f ON f.word = s.here WHERE f.form IS NOT NULL),
e AS (SELECT s.word, s.here AS root FROM s JOIN f ON f.word = s.here WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN e USING (word)
"""

OP13_SQL = f"""
WITH {_CRC_TABLE},
f AS (SELECT doc_id, rid, unnest(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM (SELECT doc_id, text, row_number() OVER () AS rid FROM documents)),
q AS (SELECT unnest(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
h AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM f UNION SELECT w FROM q)),
b AS (SELECT w, {_CRC.format(h="h")} % 10000 AS bucket FROM h, crc),
s AS (SELECT bucket, count(*) AS s FROM f JOIN b USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM q JOIN b USING (w) GROUP BY bucket),
g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM q) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
n AS (SELECT rid, count(*) AS n, sum(gain)::BIGINT AS gain FROM f JOIN b USING (w) JOIN g USING (bucket) GROUP BY rid),
d AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce((gain - ((gain % n) + n) % n) // n, 0) AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM (SELECT doc_id, row_number() OVER () AS rid FROM documents) LEFT JOIN n USING (rid)),
e AS (SELECT doc_id, n, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d),
k AS (SELECT *, CASE WHEN n >= 20 THEN row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) END AS place, (count(*) FILTER (n >= 20) OVER ()) * 10 // 100 AS draw FROM e)
SELECT doc_id, n AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN place <= draw THEN place END AS rank FROM k
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_mixing": op2_mixing,
        "op3_surrogates": op3_surrogates,
        "op4_token_counts": op4_token_counts,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_language_id": op6_language_id,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_packing": op8_packing,
        "op9_url_filter": op9_url_filter,
        "op10_warc": op10_warc,
        "op11_spelling": op11_spelling,
        "op12_html_text": op12_html_text,
        "op13_importance": op13_importance,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op9_url_filter": OP9_SQL, "op10_warc": OP10_SQL, "op11_spelling": OP11_SQL, "op13_importance": OP13_SQL}
