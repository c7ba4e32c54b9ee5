"""From text to claims: spans, windows, evidence, consolidation and entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.functions.sqlop import Op
from tideglass.operators.evidence import jaccard_evidence
from tideglass.sources import stix

# A line is scored by its cues; claims are mentions of cue words with a confidence from the line.
_CLAIMS = "claims AS (SELECT * FROM {claim_rows})"
_CHUNKS = "chunks AS (SELECT * FROM {chunk_ranges})"
_SPANS = "spans AS (SELECT * FROM {span_ranges})"
_ENTITIES = "ents AS (SELECT * FROM {entity_mentions})"

OPS = {
    "m01_page_text": Op("Length of pages and of their title.", "SELECT page_id, CAST(length(html) AS BIGINT) AS n_html, CAST(strpos_ AS BIGINT) AS title_at FROM (SELECT page_id, html, instr(lower(html), '<title') AS strpos_ FROM {pages}) AS p"),
    "m04_stage_windows": Op("Five-line windows of an episode that hold two different tactics.", "SELECT episode, action_id FROM (SELECT a.episode, a.action_id, min(p.tactic) OVER w AS low, max(p.tactic) OVER w AS high FROM {actions} AS a JOIN {primary_tactic} AS p ON a.technique = p.technique WINDOW w AS (PARTITION BY a.episode ORDER BY a.action_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) AS s WHERE low <> high"),
    "m05_entity_spans": Op(
        "Names of groups by pattern (APT, TA, FIN, UNC and a number) in each text, with how often; texts over fifty characters count as a quote.",
        "SELECT doc_id, entity, CAST(count(*) AS BIGINT) AS mentions, CAST(max(CASE WHEN length(text) > 50 THEN 0.8 ELSE 0.6 END) AS DOUBLE) AS score FROM {documents} LATERAL VIEW explode(regexp_extract_all(text, '(?:APT|TA|FIN|UNC)[ -]?[0-9]+', 0)) AS entity GROUP BY doc_id, entity",
    ).against("SELECT doc_id, entity, count(*)::BIGINT AS mentions, max(CASE WHEN length(text) > 50 THEN 0.8::DOUBLE ELSE 0.6 END) AS score FROM (SELECT doc_id, text, unnest(regexp_extract_all(text, '(APT|TA|FIN|UNC)( |-)?[0-9]+')) AS entity FROM {documents}) AS u GROUP BY doc_id, entity"),
    "m06_distinct_texts": Op("Texts to look up once, with how often each is asked for.", "SELECT md5(text) AS text_hash, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_doc FROM {documents} GROUP BY md5(text)"),
    "m07_span_limit": Op("At most three spans of each technique in a document, best first.", f"WITH {_CLAIMS} SELECT doc, technique, chunk, span, confidence FROM (SELECT DISTINCT * FROM (SELECT doc, technique, chunk, span, confidence, row_number() OVER (PARTITION BY doc, technique ORDER BY confidence DESC, chunk, span) AS rn FROM claims) AS r WHERE rn <= :most) AS d", most=3),
    "m07_span_dedup": Op("Spans merged by their first characters.", "SELECT lower(substr(text, 1, 200)) AS head, CAST(count(*) AS BIGINT) AS n, max(n_chars) AS longest FROM {documents} GROUP BY lower(substr(text, 1, 200))"),
    "m09_verification": Op("Claims accepted by quotes and evidence score.", f"WITH {_CLAIMS}, v AS (SELECT doc, technique, count(*) AS quotes, max(confidence) AS confidence, least(100, count(*) * 15 + max(confidence) / 4) AS evidence FROM claims GROUP BY doc, technique) SELECT doc, technique, CAST(quotes AS BIGINT) AS quotes, (quotes >= 2 AND evidence >= 40) OR (quotes >= 1 AND evidence >= 50) OR (confidence >= 80 AND quotes >= 1 AND evidence >= 30) AS accepted FROM v"),
    "m10_calibration": Op("Calibrated confidence from quotes, consensus and evidence.", f"WITH {_CLAIMS}, v AS (SELECT doc, technique, count(*) AS quotes, count(DISTINCT chunk) AS consensus, max(confidence) AS base FROM claims GROUP BY doc, technique) SELECT doc, technique, CAST(greatest(10, least(100, base + (CASE WHEN quotes >= 3 THEN 15 WHEN quotes = 2 THEN 10 ELSE 5 END) + least(consensus - 1, 3) * 5)) AS BIGINT) AS confidence FROM v"),
    "m11_consolidation": Op("Claims by technique: base of at least 50, boosted by chunks or repeats.", f"WITH {_CLAIMS}, g AS (SELECT doc, technique, max(confidence) AS base, count(DISTINCT chunk) AS chunks, count(*) AS n FROM claims GROUP BY doc, technique) SELECT doc, technique, CAST(least(100, greatest(base, 50) + CASE WHEN chunks > 1 THEN least(20, 5 * chunks) WHEN n > 1 THEN least(10, 3 * n) ELSE 0 END) AS BIGINT) AS confidence FROM g"),
    "m12_exact_evidence": Op("Evidence that is equal but for case and space.", "SELECT replace(lower(trim(text)), ' ', '') AS norm, min(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS n FROM {documents} GROUP BY replace(lower(trim(text)), ' ', '')"),
    "m14_candidate_scores": Op(
        "Candidates (technique, similarity, keyword_match, is_sub, tactic) by weights, with a bonus for a wanted tactic; those of at least a score.",
        "SELECT technique, CAST(score AS BIGINT) AS score FROM (SELECT technique, round(:by_similarity * similarity + CASE WHEN keyword_match THEN :by_keyword ELSE 0 END + CASE WHEN is_sub THEN :by_sub ELSE 0 END) + CASE WHEN tactic = :tactic THEN :bonus ELSE 0 END AS score FROM {scored_candidates}) AS s WHERE score >= :least",
        by_similarity=60.0,
        by_keyword=15,
        by_sub=10,
        bonus=6,
        tactic="LARGE",
        least=50,
    ).against("SELECT technique, s::BIGINT AS score FROM (SELECT technique, round(list_sum([:by_similarity * similarity, :by_keyword * ifnull(keyword_match, FALSE)::INT, :by_sub * ifnull(is_sub, FALSE)::INT])) + :bonus * (tactic IS NOT DISTINCT FROM :tactic)::INT AS s FROM {scored_candidates}) WHERE s >= :least"),
    "m16_accumulator": Op("Highest confidence seen so far for each technique as chunks arrive.", f"WITH {_CLAIMS} SELECT doc, technique, chunk, CAST(max(confidence) AS BIGINT) AS best_so_far FROM (SELECT doc, technique, chunk, max(confidence) OVER (PARTITION BY doc, technique ORDER BY chunk RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS confidence FROM claims) AS r GROUP BY doc, technique, chunk"),
    "m18_entity_groups": Op("Entities by name and type, boosted by mentions and chunks.", f"WITH {_ENTITIES} SELECT name, type, CAST(least(100, max(confidence) + least(20, 5 * count(*))) AS BIGINT) AS confidence, CAST(count(DISTINCT chunk) AS BIGINT) AS chunks FROM ents GROUP BY name, type"),
    "p02_span_chunks": Op("Every chunk that a span overlaps: a range join within the document, of a span and the chunks at, before and after its start.", f"WITH {_CHUNKS}, {_SPANS}, near AS (SELECT s.*, CAST(floor(s_start / 500) AS BIGINT) + d.i AS chunk_no FROM spans AS s CROSS JOIN (VALUES (-1), (0), (1)) AS d(i)) SELECT s.doc_id, s.span_no, c.chunk_no FROM near AS s JOIN chunks AS c ON s.doc_id = c.doc_id AND s.chunk_no = c.chunk_no AND s.s_start < c.c_end AND s.s_end > c.c_start"),
    "p03_redistribution": Op("Spans in contiguous blocks over chunks.", f"WITH {_SPANS} SELECT doc_id, span_no, CAST(floor((rn - 1) / ceil(n / 3.0)) AS BIGINT) AS chunk FROM (SELECT doc_id, span_no, row_number() OVER (PARTITION BY doc_id ORDER BY span_no) AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM spans) AS r"),
    "p04_windows": Op("Sliding character windows over the whole text that hold enough text.", "SELECT doc_id, start, CAST(length(trim(substr(text, CAST(start + 1 AS INT), 500))) AS BIGINT) AS n FROM (SELECT doc_id, text, explode(sequence(CAST(0 AS BIGINT), n_chars - 1, CAST(400 AS BIGINT))) AS start FROM {documents} WHERE n_chars > 0) AS w WHERE length(trim(substr(text, CAST(start + 1 AS INT), 500))) >= 100"),
    "p05_chunk_merge": Op("First claim of each technique wins; later ones within ten points add evidence, at most five.", f"WITH {_CLAIMS}, f AS (SELECT doc, technique, confidence, first_value(confidence) OVER (PARTITION BY doc, technique ORDER BY chunk, span, confidence) AS base FROM claims) SELECT doc, technique, CAST(max(confidence) AS BIGINT) AS confidence, CAST(least(5, sum(CASE WHEN confidence >= base - 10 THEN 1 ELSE 0 END)) AS BIGINT) AS quotes FROM f GROUP BY doc, technique"),
    "p06_entity_evidence": Op("Entity confidence from mentions and chunks, each boost capped.", f"WITH {_ENTITIES} SELECT name, type, CAST(least(100, least(100, max(confidence) + least(20, 5 * count(*))) + least(10, 3 * count(DISTINCT chunk))) AS BIGINT) AS confidence, CAST(count(DISTINCT substr(quote, 1, 100)) AS BIGINT) AS quotes FROM ents GROUP BY name, type"),
    "p07_entity_dedup": Op("Entities by type and trimmed name with the union of their quotes.", f"WITH {_ENTITIES} SELECT concat(type, ':', name) AS k, CAST(max(confidence) AS BIGINT) AS confidence, CAST(count(DISTINCT quote) AS BIGINT) AS mentions FROM ents GROUP BY concat(type, ':', name)"),
    "p09_entity_claims": Op("Entity claims with boosts for chunks and unique evidence.", f"WITH {_ENTITIES} SELECT name, type, CAST(max(confidence) + (CASE WHEN count(DISTINCT chunk) > 1 THEN least(20, 5 * count(DISTINCT chunk)) ELSE 0 END) + least(10, 2 * count(DISTINCT quote)) AS BIGINT) AS confidence FROM ents GROUP BY name, type"),
    "p11_merged_evidence": Op(
        "Overlapping spans merged: gaps and islands by running maximum of ends.",
        f"WITH {_SPANS}, {_CHUNKS}, all_ AS (SELECT doc_id, s_start AS a, s_end AS b FROM spans UNION ALL SELECT doc_id, c_start + 40, c_start + 120 FROM chunks), m AS (SELECT doc_id, a, b, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM all_), i AS (SELECT doc_id, a, b, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT doc_id, CAST(min(a) AS BIGINT) AS a, CAST(max(b) AS BIGINT) AS b, CAST(count(*) AS BIGINT) AS n FROM i GROUP BY doc_id, island",
    ),
    "l38_evidence_pack": Op("Pair statistics of neighbours with a hash of what they rest on.", "SELECT src, dst, n, md5(concat(src, '>', dst, ':', CAST(n AS VARCHAR(20)))) AS evidence_hash FROM {transitions}"),
}


def line_refs(docs: DataFrame) -> DataFrame:
    """First and last line (from 1) that each document's middle half of characters touches."""
    lines = docs.select("doc_id", F.length("text").alias("n"), F.posexplode(F.split("text", "\n")).alias("line", "t"))
    from pyspark.sql import Window

    end = F.sum(F.length("t") + 1).over(Window.partitionBy("doc_id").orderBy("line"))
    placed = lines.withColumn("stop", end).withColumn("start", F.col("stop") - F.length("t") - 1)
    hit = placed.where((F.col("start") < F.floor(F.col("n") * 3 / 4)) & (F.col("stop") > F.floor(F.col("n") / 4)))
    return hit.groupBy("doc_id").agg((F.min("line") + 1).cast("bigint").alias("first_line"), (F.max("line") + 1).cast("bigint").alias("last_line"))


def maximal_paths(edges: DataFrame) -> DataFrame:
    """All paths of two or more states of edges (src, dst, p), from any state and without repeats, that no further
    state continues: path, steps, confidence (the mean p)."""
    from tideglass.operators.clustering import with_checkpoints

    def run() -> DataFrame:
        onward = edges.select("src", "dst", "p").checkpoint()
        grown = onward.select(F.array("src").alias("path"), F.lit(0.0).alias("total")).distinct()
        ended = None
        while True:
            # A path that meets no onward edge has ended; the others go on with each.
            last = (F.element_at("path", -1) == F.col("src")) & ~F.array_contains("path", F.col("dst"))
            met = grown.join(onward, last, "left").checkpoint()
            done = met.where("dst IS NULL AND size(path) >= 2").select("path", (F.size("path") - 1).cast("bigint").alias("steps"), F.round(F.col("total") / (F.size("path") - 1), 6).alias("confidence"))
            ended = done if ended is None else ended.unionByName(done)
            grown = met.where("dst IS NOT NULL").select(F.concat("path", F.array("dst")).alias("path"), (F.col("total") + F.col("p")).alias("total"))
            if not grown.limit(1).count():
                return ended

    return with_checkpoints(edges, run)


def path_report(edges: DataFrame, top: int = 40) -> DataFrame:
    """The `top` maximal paths of highest confidence, longer ones first among equals."""
    return maximal_paths(edges).orderBy(F.desc("confidence"), F.desc("steps"), "path").limit(top)


def near_names(parts: DataFrame) -> DataFrame:
    """Pairs of distinct names within two edits (name, near_name, edits; the lesser first), and the rows that bear each
    name (name, p_partkey): copies of a name meet nobody.

    Names within two edits share what is left of either after at most two deletions, so no pair is missed.
    """

    def shorter(names: DataFrame) -> DataFrame:
        n = F.length("left")
        cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.col("left").substr(F.lit(1), i - 1), F.col("left").substr(i + 1, n)))
        return names.select("name", F.explode(F.concat(F.array("left"), cut)).alias("left")).distinct()

    one = parts.where("p_name IS NOT NULL").select(F.col("p_name").alias("name")).distinct()
    left = shorter(shorter(one.withColumn("left", F.col("name"))))
    met = left.join(left.select(F.col("name").alias("near_name"), "left"), "left").where("name < near_name").select("name", "near_name").distinct()
    pairs = met.withColumn("edits", F.levenshtein("name", "near_name").cast("bigint")).where("edits <= 2")
    members = parts.where("p_name IS NOT NULL").select(F.col("p_name").alias("name"), F.lit(None).cast("string").alias("near_name"), F.lit(None).cast("bigint").alias("edits"), "p_partkey")
    return pairs.withColumn("p_partkey", F.lit(None).cast("bigint")).unionByName(members)


def running_confidence(events: DataFrame, keep: float = 0.9) -> DataFrame:
    """Exponential moving average of confidence by type, seeded by the first value above zero: event_type, n, ema.

    An average depends on order, so a type is folded as one; types are cut into days first, each day's fold being the
    affine map that it applies to what came before, and maps compose in order.
    """
    step = F.struct(F.lit(keep).alias("a"), (F.lit(1 - keep) * F.col("value")).alias("b"))
    compose = lambda acc, x: F.struct((acc["a"] * x["a"]).alias("a"), (acc["b"] * x["a"] + x["b"]).alias("b"))
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    positive = events.where(F.col("value") > 0)
    first = positive.groupBy("event_type").agg(F.min_by("value", F.struct("ts", "event_id")).alias("seed"), F.min(F.struct("ts", "event_id")).alias("at"))
    after = positive.join(first, "event_type").where(F.struct("ts", "event_id") > F.col("at"))
    fold = lambda items: F.aggregate(F.array_sort(F.collect_list(items)), start, lambda acc, x: compose(acc, x["m"]))
    days = after.groupBy("event_type", F.to_date("ts").alias("day")).agg(fold(F.struct("ts", "event_id", step.alias("m"))).alias("m"), F.count(F.lit(1)).alias("n"))
    whole = days.groupBy("event_type").agg(fold(F.struct("day", "m")).alias("m"), F.sum("n").alias("n"))
    joined = first.join(whole, "event_type", "left")
    return joined.select("event_type", (F.coalesce("n", F.lit(0)) + 1).cast("bigint").alias("n"), F.round(F.coalesce(F.col("m.a"), F.lit(1.0)) * F.col("seed") + F.coalesce(F.col("m.b"), F.lit(0.0)), 6).alias("ema"))


def split_sentences(docs: DataFrame) -> DataFrame:
    """Texts of one or two lines are split at sentence ends into lines: doc_id, n_lines."""
    short = (F.size(F.split("text", "\n")) <= 2) & (F.length("text") > 100)
    lines = F.when(short, F.size(F.split("text", r"(?<=[.!?])\s+"))).otherwise(F.size(F.split("text", "\n")))
    return docs.select("doc_id", lines.cast("bigint").alias("n_lines"))


def not_ignored(entities: DataFrame, rules: DataFrame, most: int = 10_000) -> DataFrame:
    """entities (name, ...) that no rule (kind, value) takes: blank names, names that a list has (user, vendor, generic,
    code, extension; without case), names that end with an extension, and names that a pattern matches from their start.
    Rules are configuration: more than `most` patterns are refused."""
    lists = rules.where("kind <> 'pattern'").select(F.lower("value").alias("listed")).distinct()
    ends = rules.where("kind = 'extension'").select(F.lower("value").alias("end")).distinct()
    patterns = [r[0] for r in rules.where("kind = 'pattern'").select("value").limit(most + 1).collect()]
    if len(patterns) > most:
        raise ValueError(f"more than {most} patterns")
    known = entities.withColumn("_name", F.lower(F.trim("name"))).where(F.coalesce(F.col("_name") != "", F.lit(False)))
    if patterns:
        known = known.where(~F.col("name").rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"))
    left = known.join(lists, F.col("_name") == F.col("listed"), "left_anti")
    # Suffixes meet extensions by equality, whatever the number of extensions.
    tails = left.select("_name").distinct().select("_name", F.explode(F.transform(F.sequence(F.lit(1), F.length("_name")), lambda i: F.substr("_name", i))).alias("end"))
    taken = tails.join(ends, "end", "left_semi").select(F.col("_name").alias("taken")).distinct()
    return left.join(taken, F.col("_name") == F.col("taken"), "left_anti").drop("_name")


def bundle_checks(objects: DataFrame) -> DataFrame:
    """Objects that break a rule of their kind, by kind and rule: type, error, n, first_id."""
    found = stix.validate(objects).select("type", "id", F.explode("errors").alias("error"))
    return found.groupBy("type", "error").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


_EMA = "WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events WHERE value > 0), l AS (SELECT event_type, list(value ORDER BY rn) AS v FROM o GROUP BY event_type) SELECT event_type, len(v)::BIGINT AS n, round(list_reduce(v, lambda a, x: 0.9::DOUBLE * a + (1 - 0.9::DOUBLE) * x), 6) AS ema FROM l"
_LINES = "WITH l AS (SELECT doc_id, length(text) AS n, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), p AS (SELECT *, sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY line) AS stop FROM l) SELECT doc_id, min(line)::BIGINT AS first_line, max(line)::BIGINT AS last_line FROM p WHERE stop - length(t) - 1 < floor(n * 3 / 4) AND stop > floor(n / 4) GROUP BY doc_id"
_NEAR = "WITH n AS (SELECT DISTINCT p_name AS name FROM part WHERE p_name IS NOT NULL) SELECT a.name, b.name AS near_name, CAST(levenshtein(a.name, b.name) AS BIGINT) AS edits, CAST(NULL AS BIGINT) AS p_partkey FROM n AS a JOIN n AS b ON a.name < b.name WHERE levenshtein(a.name, b.name) <= 2 UNION ALL SELECT p_name, NULL, NULL, p_partkey FROM part WHERE p_name IS NOT NULL"
_PATHS = "WITH RECURSIVE w AS (SELECT DISTINCT [src] AS path, CAST(0 AS DOUBLE) AS total FROM ptg_edges UNION ALL SELECT list_append(path, dst), total + p FROM w JOIN ptg_edges ON src = path[len(path)] AND NOT list_contains(path, dst)) SELECT path, CAST(len(path) - 1 AS BIGINT) AS steps, round(total / (len(path) - 1), 6) AS confidence FROM w WHERE len(path) >= 2 AND NOT EXISTS (SELECT 1 FROM ptg_edges AS e WHERE e.src = path[len(path)] AND NOT list_contains(path, e.dst))"
# For the check: the same rules in another shape.
CHECKS = {
    "m09_verification": "SELECT doc, technique, len(cs)::BIGINT AS quotes, CASE WHEN e >= 50 THEN TRUE WHEN e >= 40 AND len(cs) > 1 THEN TRUE WHEN e >= 30 THEN list_max(cs) >= 80 ELSE FALSE END AS accepted FROM (SELECT doc, technique, list(confidence) AS cs, least(100, 15 * count(*) + max(confidence) / 4) AS e FROM {claim_rows} GROUP BY doc, technique) AS g",
    "m10_calibration": "WITH g AS (SELECT doc, technique, list(confidence) AS cs, list(DISTINCT chunk) AS ks FROM {claim_rows} GROUP BY doc, technique) SELECT doc, technique, greatest(10, least(100, list_max(cs) + [5, 10, 15][least(len(cs), 3)] + 5 * (least(len(ks), 4) - 1)))::BIGINT AS confidence FROM g",
    "m11_consolidation": "WITH g AS (SELECT doc, technique, list(confidence) AS cs, list(DISTINCT chunk) AS ks FROM {claim_rows} GROUP BY doc, technique) SELECT doc, technique, least(100, greatest(list_max(cs), 50) + list_max([least(20, 5 * len(ks)) * (len(ks) > 1)::INT, least(10, 3 * len(cs)) * (len(ks) = 1 AND len(cs) > 1)::INT]))::BIGINT AS confidence FROM g",
    "m16_accumulator": "SELECT a.doc, a.technique, a.chunk, max(b.confidence)::BIGINT AS best_so_far FROM (SELECT DISTINCT doc, technique, chunk FROM {claim_rows}) AS a JOIN {claim_rows} AS b ON a.doc = b.doc AND a.technique = b.technique AND b.chunk <= a.chunk GROUP BY a.doc, a.technique, a.chunk",
    "p05_chunk_merge": "WITH g AS (SELECT doc, technique, list(confidence ORDER BY chunk, span, confidence) AS cs FROM {claim_rows} GROUP BY doc, technique) SELECT doc, technique, list_max(cs)::BIGINT AS confidence, least(5, len(list_filter(cs, lambda c: c >= cs[1] - 10)))::BIGINT AS quotes FROM g",
    "m18_entity_groups": "WITH g AS (SELECT name, type, list(confidence) AS cs, list(DISTINCT chunk) AS ks FROM {entity_mentions} GROUP BY name, type) SELECT name, type, list_min([100, list_max(cs) + list_min([20, 5 * len(cs)])])::BIGINT AS confidence, len(ks)::BIGINT AS chunks FROM g",
    "p09_entity_claims": "WITH g AS (SELECT name, type, max(confidence) AS c, len(list(DISTINCT chunk)) AS k, len(list(DISTINCT quote)) AS q FROM {entity_mentions} GROUP BY name, type) SELECT name, type, (c + CASE WHEN k = 1 THEN 0 WHEN k < 4 THEN 5 * k ELSE 20 END + CASE WHEN q < 5 THEN 2 * q ELSE 10 END)::BIGINT AS confidence FROM g",
    "p02_span_chunks": "SELECT s.doc_id, s.span_no, c.chunk_no FROM {span_ranges} AS s JOIN {chunk_ranges} AS c ON s.doc_id = c.doc_id AND NOT (s.s_end <= c.c_start OR s.s_start >= c.c_end)",
    "p11_merged_evidence": "WITH a AS (SELECT doc_id, s_start AS a, s_end AS b FROM {span_ranges} UNION ALL SELECT doc_id, c_start + 40, c_start + 120 FROM {chunk_ranges}), heads AS (SELECT DISTINCT doc_id, a FROM a AS x WHERE NOT EXISTS (SELECT 1 FROM a AS y WHERE y.doc_id = x.doc_id AND y.a < x.a AND y.b >= x.a)), r AS (SELECT doc_id, a AS lo, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS hi FROM heads) SELECT r.doc_id, lo::BIGINT AS a, max(x.b)::BIGINT AS b, count(*)::BIGINT AS n FROM r JOIN a AS x ON x.doc_id = r.doc_id AND x.a >= lo AND (hi IS NULL OR x.a < hi) GROUP BY r.doc_id, lo",
}
for _name, _text in CHECKS.items():
    OPS[_name].against(_text)

FUNCTIONS = {
    "m19_ignore_list": (
        not_ignored,
        ["entity_names", "ignore_rules"],
        "SELECT name FROM entity_names AS e WHERE trim(name) <> '' AND NOT EXISTS (SELECT 1 FROM ignore_rules WHERE CASE kind WHEN 'pattern' THEN regexp_matches(name, concat('^(', value, ')')) WHEN 'extension' THEN ends_with(lower(trim(name)), lower(value)) ELSE lower(trim(name)) = lower(value) END)",
    ),
    "m22_bundle_checks": (
        bundle_checks,
        ["stix_objects"],
        """SELECT type, error, count(*)::BIGINT AS n, min(id) AS first_id FROM (SELECT type, id, unnest([CASE WHEN length(split_part(id, '--', 2)) <> 36 THEN 'bad id' END, CASE WHEN split_part(id, '--', 1) <> type THEN 'id of another type' END, CASE WHEN spec_version <> '2.1' THEN 'spec version' END, CASE WHEN type = 'relationship' AND target_ref IS NULL THEN 'incomplete relationship' END,
        CASE WHEN type = 'relationship' AND relationship_type = 'likes' THEN 'unknown relationship' END, CASE WHEN type = 'attack-pattern' AND name IS NULL THEN 'no name' END, CASE WHEN confidence > 100 THEN 'confidence out of range' END]) AS error FROM stix_objects) AS u WHERE error IS NOT NULL GROUP BY type, error""",
    ),
    "p12_line_refs": (line_refs, ["documents"], _LINES),
    "k12_running_confidence": (running_confidence, ["events"], _EMA),
    "m02_sentences": (split_sentences, ["documents"], None),
    "m12_jaccard_evidence": (lambda d: jaccard_evidence(d.select(F.col("source").alias("grp"), F.col("doc_id").alias("id"), "text")), ["documents"], None),
    "l36_maximal_paths": (maximal_paths, ["ptg_edges"], _PATHS),
    "m20_entity_resolution": (near_names, ["part"], _NEAR),
}
